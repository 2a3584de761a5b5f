"""Token ids in binary shards with Elias-Fano document boundaries.

Documents go into shards in order of their id: the rows are dealt by range of id, tokenised where they arrive, and cut
into shards of bounded size.  A shard is one record of a file (layout below): the concatenated ids in the narrowest
width, the document ids and the boundaries, both Elias-Fano coded.  A boundary costs about ``2 + log2(ids per document)``
bits; sampled ones give ``select``, so an offset is read without decoding the rest and without a table of 64-bit numbers.
Offsets over all shards come from the shards' totals alone, a table with a row per shard.

The files are written by Spark's committer (a record per line of text, ended by a line feed), so repeated tasks leave
nothing behind and any file system Spark knows will do; they are read back with ``binaryFile``.

Layout, little-endian: magic ``EFTOK001``; u64 bytes of what follows; u32 bytes per id; u64 documents, documents without
id (they come first), ids in all; i64 smallest document id; Elias-Fano block of document ids minus the smallest;
Elias-Fano block of the documents' ends; the ids.  An Elias-Fano block: u64 count, u32 low bits, u32 ones per sample,
u64 bytes of the low part, of the high part and of the samples; then the parts: low bits of each value packed; a one at
place ``high + index`` for each value; u64 places of every 256th one, counted from the start of the block.

Cases: null and empty texts have the end id only; documents without id come first; rows with one id lie side by side,
ordered by the hash of their text; texts are never cut, a text larger than a shard makes a shard of its own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import re
import struct
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triagemill.llm.common import sent, ship
from triagemill.llm.tokencount import tokenizer
from triagemill.session import scratch_path, settle

MAGIC, SAMPLE = b"EFTOK001", 256
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
LATIN = re.compile(f"([A-Za-zÀ-ÖØ-öø-ÿ]+)([{re.escape(SIGNS)}]*)")
SHARD_BYTES = 16 * 1024 * 1024
REMEMBERED = 1_000_000  # distinct words whose ids a worker keeps; beyond, they are encoded again when met again


class EliasFano:
    """A sorted sequence of whole numbers from 0 up."""

    def __init__(self, n: int, low: int, lows: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low, self.lows, self.high, self.samples = n, low, lows, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
        places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        ones = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        ones[places] = 1
        return cls(n, low, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"), np.packbits(ones, bitorder="little"),
                   places[::SAMPLE].astype("<u8"))

    def dump(self) -> bytes:
        parts = self.lows.tobytes(), self.high.tobytes(), self.samples.tobytes()
        return struct.pack("<QIIQQQ", self.n, self.low, SAMPLE, *map(len, parts)) + b"".join(parts)

    @classmethod
    def load(cls, data: memoryview) -> tuple[EliasFano, memoryview]:
        n, low, sample, a, b, c = struct.unpack_from("<QIIQQQ", data)
        if sample != SAMPLE:
            raise ValueError(f"samples of {sample}")
        body, at = data[struct.calcsize("<QIIQQQ"):], a + b
        take = lambda x, y, t: np.frombuffer(body[x:y], t)
        return cls(n, low, take(0, a, np.uint8), take(a, at, np.uint8), take(at, at + c, "<u8")), body[at + c:]

    def select(self, i: int) -> int:
        """Value number ``i``: from the sample before it on, bytes are counted until the one is met."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        at, skip = place // 8, place % 8
        left += int(np.unpackbits(self.high[at:at + 1], bitorder="little")[:skip].sum())
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[at:at + 64], bitorder="little"))
            if left < len(ones):
                place = at * 8 + int(ones[left])
                break
            left, at = left - len(ones), at + 64
        first = i * self.low
        bits = np.unpackbits(self.lows[first // 8:(first + self.low + 7) // 8], bitorder="little")[first % 8:first % 8 + self.low]
        return (place - i) << self.low | sum(int(b) << k for k, b in enumerate(bits))

    def all(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little")).astype(np.uint64)[:self.n] - np.arange(self.n, dtype=np.uint64)
        out = high << np.uint64(self.low)
        if self.low:
            bits = np.unpackbits(self.lows, bitorder="little")[:self.n * self.low].reshape(self.n, self.low).astype(np.uint64)
            out |= (bits << np.arange(self.low, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return out


@contextmanager
def uncollected() -> Iterator[None]:
    """No search for reference cycles meanwhile: words and ids make none, and each search walks all lists there are."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


_id = attrgetter("id")


class Words:
    """Ids of texts for tokenizers that drop white space: each stretch between ASCII white space is encoded once.

    A run of Latin letters and the ASCII signs after it are pre-tokens of their own, so such words share their stem; a
    stem goes to the merges at once.  All other words go through the whole tokenizer.
    """

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        self.known, self.stems, self.signs = {}, {}, {"": b""}
        width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.kind, self.width, self.code = f"<u{width}", width, "H" if width == 2 else "I"
        # byte-level vocabularies write a byte as a printable character: itself, or the next free one from 256 up
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.shown = {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*shown}))}
        self.letters = self._lowers_letters()

    def _lowers_letters(self) -> bool:
        """Whether the tokenizer lower-cases, makes one pre-token of a run of Latin letters and another of the signs
        after it (tried on all letters and pairs of signs)."""
        run = "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7) + "abcdefghijklmnopqrstuvwxyz"
        ids = lambda t: self.tok.encode(t, add_special_tokens=False).ids
        pairs = [a + b for a, b in zip(run, run[1:])] + [run, run[::-1]]
        signs = [a + b for a in SIGNS for b in SIGNS] + [a for a in SIGNS]
        return all(ids(p.upper() if "ß" not in p and "ÿ" not in p else p) == self._merged(p) for p in pairs) and all(
            ids("ab" + s) == ids("ab") + ids(s) for s in signs)

    def _merged(self, word: str) -> list[int]:
        """Merges alone, for a word that is one pre-token."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.shown)
        return list(map(_id, self.tok.model.tokenize(word)))

    def _encoded(self, words: list[str]) -> dict[str, bytes]:
        """Many words in one call; offsets tell whose the tokens are."""
        out, width = {}, self.width
        for i in range(0, len(words), 4000):
            some = words[i:i + 4000]
            joined = " ".join(some)
            got = self.tok.encode(joined, add_special_tokens=False)
            gaps = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), "<u4") == 32)
            starts = np.fromiter((o[0] for o in got.offsets), np.int64, len(got.ids))
            cuts = [*(np.searchsorted(starts, gaps) * width).tolist(), len(starts) * width]
            ids, at = np.array(got.ids, self.kind).tobytes(), 0
            for w, cut in zip(some, cuts, strict=True):
                out[w] = ids[at:cut]
                at = cut
        return out

    def _learn(self, new: list[bytes]) -> None:
        """Keep the ids of words that were not met yet."""
        plain, rest = [], []
        match, stems, signs, known = LATIN.fullmatch, self.stems, self.signs, self.known
        for w, text in zip(new, b"\n".join(new).decode().split("\n")):
            m = match(text) if self.letters else None
            if m:
                plain.append((w, m[1].lower(), m[2]))
            else:
                rest.append((w, text))
        merged, pack, code = self._merged, struct.pack, self.code
        for stem in {x[1] for x in plain}.difference(stems):
            ids = merged(stem)
            stems[stem] = pack(f"<{len(ids)}{code}", *ids)
        signs.update(self._encoded(list({x[2] for x in plain}.difference(signs))))
        known.update([(w, stems[stem] + signs[sign]) for w, stem, sign in plain])
        others = self._encoded([text for _, text in rest])
        known.update([(w, others[text]) for w, text in rest])

    @uncollected()
    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [x.split() for x in texts]
        new = list(set().union(*split).difference(self.known))
        if new:
            self._learn(new)
        out = [b"".join(map(self.known.__getitem__, ws)) for ws in split]
        if len(self.known) > REMEMBERED:
            for w in new:
                del self.known[w]
        for learnt in (self.stems, self.signs):
            if len(learnt) > REMEMBERED:
                learnt.clear()
        self.signs[""] = b""
        return out


def dump_shard(ids: list[int | None], texts: list[bytes], width: int) -> bytes:
    """A shard of documents, ordered by id, and the bytes of their token ids."""
    nulls = sum(i is None for i in ids)
    least = ids[nulls] if nulls < len(ids) else 0
    given = np.array([i - least for i in ids[nulls:]], np.uint64)
    ends = np.cumsum([len(t) // width for t in texts])
    body = struct.pack("<IQQQq", width, len(ids), nulls, int(ends[-1]), least) + EliasFano.of(given).dump() + EliasFano.of(ends).dump()
    body += b"".join(texts)
    return MAGIC + struct.pack("<Q", len(body)) + body


class Shard:
    """Random access to a shard's documents."""

    def __init__(self, body: memoryview):
        self.width, self.n, self.nulls, self.total, self.least = struct.unpack_from("<IQQQq", body)
        self.ids, rest = EliasFano.load(body[struct.calcsize("<IQQQq"):])
        self.ends, rest = EliasFano.load(rest)
        self.tokens = np.frombuffer(rest[:self.total * self.width], f"<u{self.width}")

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.ids.select(i - self.nulls)

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        a, b = self.span(i)
        return self.tokens[a:b]


def shards_of(data: bytes) -> Iterator[Shard]:
    view, at = memoryview(data), 0
    while at < len(view):
        if view[at:at + 8] != MAGIC:
            raise ValueError("no shard begins here")
        size = struct.unpack_from("<Q", view, at + 8)[0]
        yield Shard(view[at + 16:at + 16 + size])
        at += 16 + size + 1


_words: dict = {}


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int = 2, path: str | None = None, key: str = "doc_id",
                 text: str = "text", shard_bytes: int = SHARD_BYTES) -> str:
    """Tokenise and write all documents; returns the folder of the files."""
    spark = docs.sparkSession
    ship(spark)
    path = path or scratch_path(spark, "tokens")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    rows = rows.repartitionByRange(parts, F.col("k").asc_nulls_first()).sortWithinPartitions(
        F.col("k").asc_nulls_first(), F.xxhash64("t"), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _words:
            _words[vocabulary] = Words(vocabulary)
        words = _words[vocabulary]
        end = np.array([end_id], words.kind).tobytes()
        ids, texts, size = [], [], 0
        out = lambda: pa.RecordBatch.from_pydict({"shard": pa.array([dump_shard(ids, texts, words.width)], pa.binary())})
        for b in batches:
            for i in range(0, b.num_rows, 512):
                some = b.slice(i, 512)
                for k, t in zip(some.column(0).to_pylist(), words.encode(some.column(1).to_pylist())):
                    ids.append(k)
                    texts.append(t + end)
                    size += len(t) + len(end)
                    if size >= shard_bytes:
                        yield out()
                        ids, texts, size = [], [], 0
        if ids:
            yield out()

    shards = rows.mapInArrow(run, "shard binary")
    shards.select(F.col("shard").cast("string").alias("value")).write.option("lineSep", "\n").text(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (over all shards), n_tokens and ids_crc32 of every document in the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column("path").to_pylist(), b.column("content")):
                for number, s in enumerate(shards_of(data.as_buffer().to_pybytes())):
                    ends = s.ends.all().astype(np.int64)
                    starts = np.concatenate([[0], ends[:-1]])
                    ids = [None] * s.nulls + (s.ids.all().astype(np.int64) + s.least).tolist()
                    wide = s.tokens.astype("<u4")
                    crc = [zlib.crc32(wide[a:e].tobytes()) for a, e in zip(starts, ends)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([file] * s.n), pa.array([number] * s.n, pa.int64()), pa.array([s.total] * s.n, pa.int64()),
                        pa.array(ids, pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64()),
                        pa.array(range(s.n), pa.int64())], names)

    ship(spark)
    names = ["file", "number", "total", "doc_id", "start", "n_tokens", "ids_crc32", "place"]
    schema = "file string, number long, total long, doc_id long, start long, n_tokens long, ids_crc32 long, place long"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    rows = settle(files.mapInArrow(read, schema), "tokens")
    # a row per shard: those before it are those whose first document comes before; equal ids never leave a file
    first = rows.filter("place = 0").select("file", "number", "total", F.col("doc_id").alias("first"))
    order = W.orderBy(F.col("first").asc_nulls_first(), "file", "number").rowsBetween(W.unboundedPreceding, -1)
    base = settle(first.select("file", "number", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base")), "shards")
    return rows.join(sent(base), ["file", "number"]).select(
        "doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
