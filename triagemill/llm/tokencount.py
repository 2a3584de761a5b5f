"""Token counts with a whole-token shortcut.

Offline, each vocabulary string is put to the tokenizer alone: those that come back as one pre-token and one token are
proven whole.  Texts are then only parted into pre-tokens; a pre-token among the proven strings counts one, and merges
run for the rest alone, once per distinct string that a worker meets.

Some newer code points are letters to one Unicode version and not to another.  A text with a character outside
``PLAIN``, or with the string of an added token, is counted by the tokenizer as a whole.

Cases: null and empty texts have no tokens; texts are never cut; repeated documents give repeated rows; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagemill.llm.common import ship

# fixed values: ranges on which both pattern engines agree about every code point
PLAIN_RANGES = ((0x0, 0x557), (0xCDD, 0x208E), (0x20A0, 0xA7CD), (0xA7F2, 0xAB6B), (0xAB6E, 0xFFFF), (0x1F000, 0x1FFFF))
PLAIN = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in PLAIN_RANGES) + "]*"
# fixed value: the split pattern of byte-level vocabularies
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 400_000  # distinct strings whose counts a worker keeps; beyond, they are merged again when met again

_tokenizers: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per process, on one thread."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that alone are one pre-token and one token."""
    import json

    tok = tokenizer(path)
    with open(path, encoding="utf-8") as f:
        kind = json.load(f)["pre_tokenizer"]
    if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True):
        raise ValueError("the split pattern is that of byte-level vocabularies without a prefix space")
    added = {t.content for t in tok.get_added_tokens_decoder().values()}
    ids = [i for s, i in tok.get_vocab(with_added_tokens=False).items() if s not in added]
    texts = [(i, s) for i, s in zip(ids, tok.decode_batch([[i] for i in ids], skip_special_tokens=False)) if s and "�" not in s]
    found, piece = [], regex.compile(PIECE)
    for (i, s), e in zip(texts, tok.encode_batch([s for _, s in texts], add_special_tokens=False)):
        if e.ids == [i] and piece.findall(s) == [s] and len(tok.pre_tokenizer.pre_tokenize_str(s)) == 1:
            found.append(s)
    return frozenset(found)


class Counter:
    """Token counts of texts; keeps what it has learnt about strings that are not whole tokens."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.tok, self.cost = tokenizer(path), dict.fromkeys(whole, 1)
        self.piece, self.plain = regex.compile(PIECE), regex.compile(PLAIN)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]

    def counts(self, texts: list[str]) -> list[int]:
        pieces = [self.piece.findall(x) if self._simple(x) else None for x in texts]
        new = [p for p in set().union(*(p for p in pieces if p)) if p not in self.cost]
        self.cost.update(zip(new, map(len, self.tok.encode_batch_fast(new, add_special_tokens=False))))
        cost = self.cost.__getitem__
        out = [len(self.tok.encode(x, add_special_tokens=False)) if p is None else sum(map(cost, p)) for x, p in zip(texts, pieces)]
        if len(self.cost) > REMEMBERED:
            for p in new:
                self.cost.pop(p, None)
        return out

    def _simple(self, text: str) -> bool:
        return self.plain.fullmatch(text) is not None and not any(a in text for a in self.added)


_counters: dict = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens and over_limit of every row."""
    ship(docs.sparkSession)
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # at most the vocabulary
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = Counter(path, whole.value)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                some = b.slice(i, 256)
                texts = [x or "" for x in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(_counters[path].counts(texts), pa.int64())],
                    [key, "n_bytes", "n_tokens"])

    rows = docs.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
