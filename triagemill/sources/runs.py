"""Run metrics kept as nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: field names of the metrics documents
POINT = (
    "struct<epoch:double,loss:double,average_reward:double,policy_reward:double,oracle_average_reward:double,"
    "reward_efficiency:double,updates:bigint,total_updates:bigint,rows:bigint,rows_seen:bigint,validation_score:double,"
    "best_epoch:bigint,patience_used:bigint,stopping_reason:string,algorithm:string,run_id:string,"
    "action_distribution:map<string,bigint>,action_counts:map<string,bigint>,sample_action_distribution:map<string,bigint>>"
)
DOCUMENT = f"run_id string, algorithm string, status string, config struct<run_id:string,algorithm:string,seed:bigint>, metrics array<{POINT}>"


def read_run_metrics(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per (run, epoch); points without a numeric epoch are dropped.

    The schema is given, so no pass over the files is spent on inferring it.
    """
    docs = spark.read.schema(DOCUMENT).option("multiLine", multi_line).json(path)
    run = F.coalesce("config.run_id", "run_id", F.element_at(F.split("_metadata.file_name", r"\."), 1))
    points = docs.select(
        run.alias("run_id"), F.coalesce("config.algorithm", "algorithm").alias("_algorithm"),
        F.col("config.seed").alias("seed"), F.explode("metrics").alias("p"))
    filled = [F.when(F.size(f"p.{name}") > 0, F.col(f"p.{name}"))
              for name in ("sample_action_distribution", "action_distribution", "action_counts")]
    return points.filter(F.col("p.epoch").isNotNull() & ~F.isnan("p.epoch")).select(
        "run_id", F.coalesce("p.algorithm", "_algorithm").alias("algorithm"), "seed",
        F.col("p.epoch").cast("long").alias("epoch"), F.col("p.loss").alias("loss"),
        F.col("p.average_reward").alias("average_reward"),
        F.coalesce("p.policy_reward", "p.average_reward").alias("policy_reward"),
        F.col("p.reward_efficiency").alias("reward_efficiency"), F.col("p.updates").alias("updates"),
        F.col("p.total_updates").alias("total_updates"), F.coalesce("p.rows_seen", "p.rows").alias("rows_seen"),
        F.col("p.validation_score").alias("validation_score"), F.col("p.best_epoch").alias("best_epoch"),
        F.col("p.stopping_reason").alias("stopping_reason"), F.coalesce(*filled).alias("action_distribution"))
