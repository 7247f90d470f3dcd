"""Helpers that the training-data operators share: tables, scratch folders, hashed words.

Texts reach Python as Arrow string arrays and are cut into words with numpy over
the raw UTF-8 bytes, so no Python object is made for a word. A word is a run of
bytes outside ``[\\x20\\x09-\\x0D]``; its identity is a 64-bit hash of its bytes.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words.
BLANKS = "\t\n\x0b\x0c\r "
CHUNK = 2 << 20

_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[ord(c) for c in BLANKS]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs in one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="fieldloom-")
    return f"{base.rstrip('/')}/fieldloom-{uuid.uuid4().hex}/{name}"


def keep(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(column: str, k: int):
    """crc32 of the identifier as text, modulo k."""
    return F.crc32(F.col(column).cast("string")) % k


#: Most bytes of text in a training sample of a classifier.
SAMPLE_BYTES = 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, train, bound: int, bound_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """At most ``bound`` (text, label) pairs of at most ``bound_bytes`` for fitting a classifier, in order of a hash of doc_id.

    The bounds are the documented caps on a training sample; a text that alone has more than
    a 64th of the bytes isn't taken. Nothing else is capped. Rows without a label or an identifier are left out.
    """
    chosen = (
        labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & train)
        .groupBy("doc_id").agg(F.max(column).cast("int").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    # bounded by `bound` rows of two numbers
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).where(F.octet_length("_text") <= bound_bytes // 64).join(F.broadcast(chosen), "doc_id")
    out, size = [], 0
    # rows come one partition at a time, so that the driver never holds more than the bound and one partition of at most `bound` rows
    for r in rows.select("_text", "_label").orderBy(F.xxhash64("doc_id"), "_text").limit(bound).toLocalIterator():
        size += len(r[0].encode("utf-8", "replace"))
        if size > bound_bytes:
            break
        out.append((r[0], r[1]))
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def strings(column: pa.Array) -> pa.Array:
    """A plain string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


class Words:
    """The words of some whole texts: ``first[i]:first[i + 1]`` are those of text i."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        self.offsets = at - at[0]
        self.data = _LOWER[raw] if lower else raw
        word = ~_IS_BLANK[self.data]
        before, after = np.zeros(len(word), bool), np.zeros(len(word), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        inner = self.offsets[(self.offsets > 0) & (self.offsets < len(word))]
        before[inner], after[inner - 1] = False, False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64 bits for each word, from its bytes alone."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eights = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(self.data) + 1, 8), (1, 1))
        length = self.end - self.start
        out = mix(length.astype(np.uint64) * _C1 + _C3)
        left, where, k = length, np.arange(len(length)), 0
        while len(where):
            part = np.ascontiguousarray(eights[self.start[where] + k]).view(np.uint64).ravel() & _KEEP[np.minimum(left, 8)]
            out[where] = mix((out[where] ^ part) * _C1 + np.uint64(k + 1))
            more = left > 8
            where, left, k = where[more], left[more] - 8, k + 8
        return out

    def text(self, i: int, kept: np.ndarray | None = None) -> bytes:
        """The (kept) words of text i, joined by one space."""
        a, b = self.first[i], self.first[i + 1]
        idx = np.arange(a, b) if kept is None else a + np.flatnonzero(kept)
        if not len(idx):
            return b""
        base, length = self.start[idx[0]], int(self.end[idx[-1]] - self.start[idx[0]])
        mark = np.zeros(length + 2, np.int32)
        np.add.at(mark, self.start[idx] - base, 1)
        np.add.at(mark, self.end[idx] - base + 1, -1)
        inside = np.cumsum(mark)[: length + 1] > 0  # every word and one character behind it
        piece = np.concatenate([self.data[base : base + length], np.full(1, 32, np.uint8)])
        ends = self.end[idx] - base
        piece = piece.copy()
        piece[ends] = 32
        return piece[inside].tobytes()[:-1]


def pieces(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of some whole texts of about ``size`` bytes together."""
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1)
        yield lo, hi
        lo = hi


def grams(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of ``length`` words, by doubling: the runs of 2n words are made of those of n words."""
    if len(words) < length:
        return np.zeros(0, np.uint64)
    have, span, out, done = words, 1, None, 0
    n = length
    while n:
        if n & 1:
            if out is None:
                out, done = have, span
            else:
                m = len(words) - done - span + 1
                out = mix(out[:m] * _C1 + have[done : done + m] + np.uint64(done))
                done += span
        n >>= 1
        if n:
            m = len(have) - span
            have, span = mix(have[:m] * _C1 + have[span : span + m] + np.uint64(span)), span * 2
    return out


def doubled(half: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the runs of 2 x ``length`` words from those of ``length`` words."""
    m = max(0, len(half) - length)
    return mix(half[:m] * _C1 + half[length : length + m] + np.uint64(length))


def slide(values: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """The least (or other best) of every ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        values, span = best(values[:-span], values[span:]), span * 2
    rest = width - span
    return best(values[: len(values) - rest], values[rest:]) if rest else values


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def folded(docs: DataFrame, without: str = "") -> DataFrame:
    """doc_id and text, and the row (but for one column) in a struct, so that no other column can clash with those used inside."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != without]).alias("_all"))
