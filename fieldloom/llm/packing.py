"""Mixture-controlled packing by deficit round-robin (operator 5).

Documents are queued by source. In every round each queue is credited with its target share of a
window of tokens; what it can't spend on whole documents is its deficit, carried to later rounds, so
that queues keep their proportions across windows and partitions. A document leaves whole. One of
more than ``unit`` tokens leaves in equal units of at most ``unit``, so that it can't hold the stream.
Beyond that, pieces end at the edges of windows alone.

The rounds have a closed form: a queue of rate x has been credited with r x tokens before round r,
fractions too, so none is lost. A unit leaves in the round that credits the point at the share p
of it. So a queue overdraws at most a share 1 - p of a unit and pays it back:
it is never more than a unit ahead of its credit, nor behind. The shares p are spread evenly over sources in order of
their sizes, so that alike queues of low rates don't send in the same round.

No task waits for another: documents get their place in their queue by running sums inside the tasks
that read them and over those tasks; the tokens sent before a block of ``SPAN`` rounds are running
sums over blocks; a block's units are sorted in one task, by round, source and place, and
cut every ``window`` tokens. The plan is the same for any number of sources.

Targets default to the sources' own shares of tokens. Sources without a target
follow when those with one are through, by their own shares.

A null text is empty: one token, the end id. A null source is the source with the empty name. Rows
with a null doc_id are packed as others are. Very long texts are packed whole, in units. Repeated
rows are packed as often as they occur. Columns other than doc_id, text and source are not
read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, strings, table

WINDOW, UNIT, END, CACHE = 4096, 2048, 2, 300_000
SPAN, FAR = 64, 1024  # rounds in a block; blocks over which places are summed at once
STEPS = 0.6180339887498949, 0.7548776662466927  # multiples of these, modulo 1, spread evenly
#: Python's split() also cuts at these, the tokenizer's \s does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"
SPACE = re.compile(rf"[^\S{SEPARATORS}]+")
#: Letters that stay single and alike under composition, and that lower() treats as the tokenizer does.
LETTERS = [chr(c) for c in (*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100))]
LATIN = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+([.,!?;:]?)")


class WordIds(dict):
    """A run without blanks -> its ids as bytes of unsigned 16 or 32-bit integers, by the tokenizer's own parts."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        self.whole = any(t.normalized for t in added)  # these show only in the normalised text
        self.type = np.uint16 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.code = np.dtype(self.type).char
        self.normal, self.cut, self.model = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.model.tokenize
        self.spelt = {ord(c): "".join(p for p, _ in self.cut(c)) for c in LETTERS}  # letters as the model reads them
        self.old: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        got = self.known.get(part)
        if got is None:
            if len(self.known) > 2 * CACHE:
                self.known.clear()
            got = self.known[part] = array(self.code, [t.id for t in self.model(part)]).tobytes()
        return got

    def __missing__(self, run: str) -> bytes:
        got = self.old.get(run)
        if got is None:
            if plain := LATIN.fullmatch(run):  # a plain word, or one and a mark: two matches
                low = run.lower()
                word = low[:-1] if plain[1] else low
                got = self._part(word if word.isascii() else word.translate(self.spelt)) + (self._part(plain[1]) if plain[1] else b"")
            else:
                got = b"".join([self._part(p) for p, _ in self.cut(self.normal(run))]) if run else b""
        if len(self) >= CACHE:  # the last generation stays in reach
            self.old = dict(self)
            self.clear()
        self[run] = got
        return got

    def ids(self, text: str) -> bytes:
        """The ids of a text: no match of the tokenizer's pattern holds a blank, so runs stand for themselves. Texts with an added token go through the tokenizer whole."""
        if self.whole or any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()
        runs = SPACE.split(text) if any(c in text for c in SEPARATORS) else text.split()
        return b"".join(map(self.__getitem__, runs))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def _tokens(path: str, end: int):
    """Ids of each document, and how many tokens of its queue the task had before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_ids(path)
        tail, width = np.array([end], own.type).tobytes(), np.dtype(own.type).itemsize
        sent: dict[str, int] = {}
        for batch in batches:
            texts, queue = strings(batch.column("text")), batch.column("source").to_pylist()
            for lo in range(0, len(texts), 500):
                got, ahead = [own.ids(x.as_py()) + tail for x in texts.slice(lo, 500)], []
                for q, x in zip(queue[lo : lo + 500], got):
                    ahead.append(before := sent.get(q, 0))
                    sent[q] = before + len(x) // width
                cols = [batch.column(c).slice(lo, 500) for c in ("doc_id", "source", "task")]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(ahead, pa.int64()), pa.array([len(x) // width for x in got], pa.int64()), pa.array([width] * len(got), pa.int32()), pa.array(got, pa.binary())],
                    ["doc_id", "source", "task", "inside", "doc_tokens", "width", "ids"],
                )

    return run


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts`` parts of each row: the row, and the number of the part."""
    k = np.repeat(np.arange(len(counts)), counts)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(counts) - counts, counts)


def _units(batch: pa.RecordBatch, unit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents in equal units of at most ``unit`` tokens: document, round, first token in the document, and tokens."""
    ahead, tokens, first, rate, phase = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("ahead", "doc_tokens", "first", "rate", "phase"))
    parts = -(-tokens // unit)
    doc, i = _spread(parts)
    start, stop = i * tokens[doc] // parts[doc], (i + 1) * tokens[doc] // parts[doc]
    due = (ahead[doc] + start + phase[doc] * (stop - start)) / rate[doc]
    return doc, first[doc] + np.floor(due).astype(np.int64), start, stop - start


def _cut(at: np.ndarray, size: np.ndarray, start: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units cut at the ends of windows; units of one document that are neighbours in a window are one piece: unit, start, begin, length."""
    k, inner = _spread((at + size - 1) // window - at // window + 1)
    edge = (at[k] // window + inner) * window
    begin, end = np.maximum(at[k], edge), np.minimum((at + size)[k], edge + window)
    start, doc = start[k] + (begin - at[k]), doc[k]
    glue = np.zeros(len(k), bool)
    glue[1:] = (begin[1:] % window != 0) & (doc[1:] == doc[:-1])
    head = np.flatnonzero(~glue)
    return k[head], start[head], begin[head], np.add.reduceat(end - begin, head) if len(head) else end - begin


def _wide(ids: pa.Scalar, width: int) -> bytes:
    return np.frombuffer(ids.as_buffer(), np.uint16 if width == 2 else np.uint32).astype("<u4").tobytes()


def _block_sizes(unit: int):
    """How many tokens leave in each block of rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                _, r, _, size = _units(batch, unit)
                block, back = np.unique(r // SPAN, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(np.bincount(back, size, len(block)).astype(np.int64))], ["block", "n"])

    return run


def _block_units(unit: int):
    """The units with their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 200):
                batch = whole.slice(lo, 200)
                doc, r, start, size = _units(batch, unit)
                width, raw = batch.column("width").to_pylist(), batch.column("ids").to_pylist()
                ids = [raw[i][s * width[i] : (s + n) * width[i]] for i, s, n in zip(doc.tolist(), start.tolist(), size.tolist())]
                cols = [batch.column(c).take(pa.array(doc)) for c in ("doc_id", "source", "doc_tokens", "ahead", "width")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(r // SPAN), pa.array(r), pa.array(start), pa.array(size), pa.array(ids, pa.binary())], ["doc_id", "source", "doc_tokens", "ahead", "width", "block", "round", "start", "size", "ids"])

    return run


def _placed(window: int):
    """The pieces of one block of rounds."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("round", "ascending"), ("source", "ascending"), ("ahead", "ascending"), ("start", "ascending")]).combine_chunks()
        size, start, ahead = (rows.column(c).to_numpy() for c in ("size", "start", "ahead"))
        at = rows.column("before").to_numpy() + np.cumsum(size) - size
        # a document is known by its source and its place there; its units in one round are neighbours
        source = rows.column("source").combine_chunks().dictionary_encode().indices.to_numpy()
        new = np.ones(len(size), bool)
        new[1:] = (source[1:] != source[:-1]) | (ahead[1:] != ahead[:-1])
        k, start, begin, length = _cut(at, size, start, np.cumsum(new), window)
        view = memoryview(b"".join(_wide(x, w) for x, w in zip(rows.column("ids").combine_chunks(), rows.column("width").to_pylist())))
        crcs = [zlib.crc32(view[4 * b : 4 * (b + n)]) for b, n in zip((begin - at[0]).tolist(), length.tolist())]
        doc_id, tokens, source = (rows.column(c).take(pa.array(k)) for c in ("doc_id", "doc_tokens", "source"))
        return pa.table([doc_id, pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), tokens, pa.array(begin // window), pa.array(begin % window), source], OUT)

    return run


OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]


def _rates(sums: DataFrame, window: int, targets: dict[str, float] | None) -> DataFrame:
    """source, rate, first, phase."""
    wanted = sums.sparkSession.createDataFrame(list((targets or {}).items()), "source string, target double")
    shares = sums.join(wanted, "source", "left").withColumn("led", F.coalesce(F.col("target") > 0, F.lit(False)))
    shares = keep(shares.select("source", "n", "led", F.when(F.col("led"), F.col("target")).otherwise(F.col("n").cast("double")).alias("share")), "shares")
    of = {r["led"]: r["s"] for r in shares.groupBy("led").agg(F.sum("share").alias("s")).collect()}  # two rows
    rate = F.col("share") * float(window) / F.when(F.col("led"), F.lit(of.get(True, 1.0))).otherwise(F.lit(of.get(False, 1.0)))
    shares = shares.withColumn("rate", rate)
    last = shares.where("led").agg(F.max(F.ceil(F.col("n") / F.col("rate")) + 1).alias("r")).first()["r"] or 0
    place = F.monotonically_increasing_id()  # of sorted rows: the partition, and from bit 33 down the row in it
    phase = F.pmod((F.shiftright(place, 33) + 0.5) * STEPS[1] + place.bitwiseAND(F.lit((1 << 33) - 1)) * STEPS[0], F.lit(1.0))
    first = F.when(F.col("led"), F.lit(0)).otherwise(F.lit(last)).cast("long")
    return keep(shares.orderBy("n", "source").select("source", "rate", first.alias("first"), phase.alias("phase")), "rates")


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end: int = END, targets: dict[str, float] | None = None, unit: int = UNIT) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    ``targets``: a share of the window's tokens for each source; by default the
    sources' own shares, so that all queues end together. A queue that runs dry
    leaves its part of the round to the others. All sequences but the last are full.
    """
    kind = dict(docs.dtypes)["doc_id"]
    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    rows = docs.select("doc_id", "text", source.alias("source"), F.spark_partition_id().alias("task"))
    ids = keep(rows.mapInArrow(_tokens(vocabulary, end), f"doc_id {kind}, source string, task int, inside long, doc_tokens long, width int, ids binary"), "ids", compression="zstd")
    # places in the queues: running sums inside the tasks that read them, then over the tasks
    heads = keep(ids.groupBy("source", "task").agg(F.sum("doc_tokens").alias("n")), "heads")
    rates = _rates(heads.groupBy("source").agg(F.sum("n").alias("n")), window, targets)
    over = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    heads = heads.select("source", "task", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before")).join(rates, "source")
    heads = keep(heads, "places")  # of known size, so that the ids need no shuffle while it is below Spark's limit for broadcasts
    placed = ids.join(heads, ["source", "task"]).withColumn("ahead", F.col("before") + F.col("inside"))
    placed = placed.select("doc_id", "source", "ahead", "doc_tokens", "rate", "phase", "first", "width", "ids")
    sizes = placed.select("ahead", "doc_tokens", "rate", "phase", "first").mapInArrow(_block_sizes(unit), "block long, n long").groupBy("block").agg(F.sum("n").alias("n"))
    sizes = keep(sizes.withColumn("far", F.floor(F.col("block") / FAR)), "sizes")
    inner = Window.partitionBy("far").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("far").rowsBetween(Window.unboundedPreceding, -1)  # a row for 65,536 rounds
    far = sizes.groupBy("far").agg(F.sum("n").alias("n")).select("far", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("head"))
    starts = sizes.select("far", "block", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("inner")).join(far, "far").select("block", (F.col("head") + F.col("inner")).alias("before"))
    units = placed.mapInArrow(_block_units(unit), f"doc_id {kind}, source string, doc_tokens long, ahead long, width int, block long, round long, start long, size long, ids binary")
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
    return units.join(starts, "block").groupBy("block").applyInArrow(_placed(window), schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
