"""Chat formatting from an event log.

The log of a conversation is replayed in order of ``seq``.  Kinds of events, each about message number ``msg``:

* ``message``: a whole message; its text replaces what the number had before,
* ``delta``: a piece that is appended to the message (streamed output),
* ``edit``: a new text for the message,
* ``regenerate``: the message begins anew, with the text given (normally empty, deltas follow), and all later messages go.

The fold needs no loop: an event counts when no later reset concerns its message, and a message is what its counting
events say, one after another.  Messages are rendered in order of ``msg`` as ``<turn:ROLE>\\nTEXT</turn>\\n``.  In roles and
texts the backslash and the two angle brackets are replaced by two-character escapes, so that markup cannot be forged.

Cases: null text or role counts as empty; events of equal ``seq`` are taken in order of message, kind and text; repeated
rows of a message or edit change nothing, repeated deltas are appended again; a null conversation id is a conversation
of its own; unknown kinds are ignored; an empty log gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn:", "</turn>\n"
# the backslash comes first, so that later replacements are not escaped again
ESCAPES = (("\\", "\\e"), ("<", "\\l"), (">", "\\g"))
TURN = r"<turn:([^<>]*)>\n([^<>]*)</turn>\n"
RESETS = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def fold_events(log: DataFrame) -> DataFrame:
    """Final messages (conv_id, msg, role, text) of a log with conv_id, seq, msg, kind, role, text."""
    kinds = (*RESETS, "delta")
    rows = log.filter(F.col("kind").isin(*kinds)).select(
        "conv_id", "seq", "msg", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("seq").asc_nulls_first(), F.col("msg").asc_nulls_first(), F.col("kind").desc(), "role", "text"]
    # an event is void once the same message is set again, or an earlier one is regenerated, after it
    later = W.partitionBy("conv_id").orderBy(*order).rowsBetween(1, W.unboundedFollowing)
    same = W.partitionBy("conv_id", "msg").orderBy(*order).rowsBetween(1, W.unboundedFollowing)
    cut = F.min(F.when(F.col("kind") == "regenerate", F.col("msg"))).over(later)
    again = F.max(F.col("kind").isin(*RESETS)).over(same)
    live = rows.select("*", cut.alias("_cut"), again.alias("_again")).filter(
        (F.col("_cut").isNull() | (F.col("_cut") >= F.col("msg")) | F.col("msg").isNull())
        & ~F.coalesce("_again", F.lit(False)))
    piece = F.struct("seq", F.struct(F.when(F.col("kind") == "delta", 1).otherwise(0).alias("late")).alias("k"), "role", "text")
    pieces = F.array_sort(F.collect_list(piece))
    return live.groupBy("conv_id", "msg").agg(pieces.alias("_p")).select(
        "conv_id", "msg",
        # the first role that is given holds for all pieces
        F.coalesce(F.get(F.filter(F.transform("_p", lambda x: x["role"]), lambda r: r != ""), F.lit(0)), F.lit("")).alias("role"),
        F.array_join(F.transform("_p", lambda x: x["text"]), "").alias("text"))


def streamed_log(rows: DataFrame, piece: int = 24) -> DataFrame:
    """The event log by which a chat of finished messages (conv_id, msg, role, text; msg from 1, unique in a chat) came about.

    A text of a role other than the assistant's is first sent without its second half and then edited.  An answer has a first draft and a
    message that follows it; both go when it is regenerated, and it arrives as deltas of ``piece`` code points.
    """
    text = F.coalesce("text", F.lit(""))
    n = F.char_length(text)
    half = F.substring(text, F.lit(1), F.floor(n / 2).cast("int"))
    event = lambda kind, said, later=0, role=F.col("role"): F.struct(
        (F.col("msg") + later).alias("msg"), F.lit(kind).alias("kind"), role.alias("role"), said.alias("text"))
    none = F.lit(None).cast("string")
    places = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(piece))
    deltas = F.transform(places, lambda at: event("delta", F.substring(text, at + 1, F.lit(piece)), role=none))
    answer = F.concat(F.array(event("message", half), event("message", half, 1), event("regenerate", none)), deltas)
    other = F.array(event("message", half), event("edit", text))
    told = rows.select("conv_id", F.col("msg").alias("_m"), F.posexplode(F.when(F.col("role") == "assistant", answer).otherwise(other)).alias("_i", "_e"))
    # events of a message lie together: its number in the upper half, theirs in the lower
    return told.select("conv_id", F.struct(F.col("_m").alias("m"), F.col("_i").alias("i")).alias("seq"), "_e.*")


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conversation: ``segments``, the pieces of its training text in order, each with its loss mask, and
    ``spans``, where the mask holds in the training text (code points, end exclusive).

    The mask holds for the texts of role ``learn`` and for nothing else.  The training text is the pieces joined
    (``training_text``).  Pieces are made per message before the shuffle; a conversation must fit a row.
    """
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(">\n"))
    parts = F.array(
        F.struct(head.alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(F.col("text")).alias("text"), (F.col("role") == learn).alias("loss")),
        F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")))
    size = lambda i: F.char_length(F.get("parts", F.lit(i))["text"]).cast("bigint")
    before = F.coalesce(F.sum(size(0) + size(1) + size(2)).over(
        W.partitionBy("conv_id").orderBy("msg").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    turns = messages.select("conv_id", "msg", parts.alias("parts")).withColumn("start", before + size(0)).withColumn(
        "end", F.col("start") + size(1))
    lists = F.array_sort(F.collect_list(F.struct("msg", "start", "end", "parts")))
    learnt = F.filter("_t", lambda t: F.get(t["parts"], F.lit(1))["loss"])
    return turns.groupBy("conv_id").agg(lists.alias("_t")).select(
        "conv_id", F.flatten(F.transform("_t", lambda t: t["parts"])).alias("segments"),
        F.transform(learnt, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("spans"))


def training_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a training text, unescaped."""
    roles = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1))
    texts = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2))
    return F.zip_with(roles, texts, lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, from a training text and its spans."""
    said = F.transform(spans, lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return unescape(F.array_join(said, ""))
