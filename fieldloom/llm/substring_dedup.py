"""Substring dedup by level-wise doubling (operator 1).

Level one looks at runs of half the window's length. Of these only anchors are
shuffled: in every window of ``window`` words, the half-length runs with the
least hash. Equal windows have equal anchors, so a window whose anchors
all occur in one document alone can't repeat. Where anchors occur in more than
one document, the next level hashes the runs of twice the length, the full windows, and again
only those that repeat survive.

Removal needs no longer runs than the window, as each word of a longer repeat is in a window
that repeats. ``longest_repeats`` goes on from there: a run of
twice the length is a candidate where both its halves repeat, and levels
follow until no candidate survives. For an odd window, the second
level hashes the full length directly.

Counting goes through partial aggregation; what survives is joined back by sort
merge joins of written tables, whose hot keys Spark splits.

Words are runs outside ``[\\x20\\x09-\\x0D]``. Null and empty texts have no words. A
document never counts against itself or against rows of the same doc_id; rows
with a null doc_id keep all words and take none from others. Windows are
judged on the input. Window identity is 96 bits of hash. Very long texts are read whole.
An empty table gives an empty result. Other columns, whatever their names, play no part and are kept by ``strip_documents``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TOP, Words, doubled, folded, grams, keep, pieces, signed, slide, strings, table


def _valid(w: Words, length: int) -> np.ndarray:
    """Which words start a run of ``length`` words inside one text."""
    left = np.repeat(w.first[1:], w.counts) - np.arange(w.first[-1])
    return left >= length


def _full(x: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, TOP, np.uint64)
    out[: len(x)] = x
    return out


def _anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes; hashes of the half-length runs at each word; the least of them in the window at each word; which runs are anchors."""
    half, n = window // 2, len(w.start)
    words = w.hashes()
    runs = _full(grams(words, half), n)
    runs[~_valid(w, half)] = TOP
    span = window - half + 1
    if n < window:
        return words, runs, np.zeros(0, np.uint64), np.zeros(n, bool)
    least = slide(runs, span)
    least = np.where(_valid(w, window)[: len(least)], least, np.uint64(0))
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(n - len(least), np.uint64)])
    reach = slide(padded, span, np.maximum)[:n]
    return words, runs, least, (runs == reach) & (runs != TOP)


def _pairs(ids: np.ndarray, *cols: np.ndarray) -> list[np.ndarray]:
    """The distinct rows."""
    order = np.lexsort((*cols[1:], cols[0], ids))
    rows = [x[order] for x in (ids, *cols)]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in rows])
    return [x[new] for x in rows]


def _level_one(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, hi in pieces(texts):
                w = Words(texts.slice(lo, hi - lo))
                _, runs, _, anchor = _anchors(w, window)
                doc = np.repeat(ids[lo:hi], w.counts)[anchor].astype(np.int64)
                doc, run_ = _pairs(doc, runs[anchor])
                yield pa.RecordBatch.from_arrays([signed(run_), pa.array(doc)], ["run", "doc_id"])

    return run


def _member(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    if not len(found):
        return np.zeros(len(x), bool)
    found = np.sort(found)
    at = np.minimum(np.searchsorted(found, x), len(found) - 1)
    return found[at] == x


def _listed(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    x = batch.column(name)[i].values
    return np.zeros(0, np.uint64) if x is None else x.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _level_two(window: int):
    """The windows around the surviving anchors of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column("text"))
            out: list[list[np.ndarray]] = []
            for i in range(batch.num_rows):
                if batch.column("runs")[i].values is None:
                    continue
                w = Words(texts.slice(i, 1))
                if len(w.start) < window:
                    continue
                words, runs, least, _ = _anchors(w, window)
                # equal windows have equal least runs, so the least run of a window that repeats has survived
                at = np.flatnonzero(_member(least[: len(words) - window + 1], _listed(batch, "runs", i)))
                if not len(at):
                    continue
                full = doubled(runs, window // 2) if window % 2 == 0 else grams(words, window)
                first = words[at]
                out.append(_pairs(np.full(len(at), batch.column("doc_id")[i].as_py(), np.int64), full[at], (first >> np.uint64(32)).astype(np.uint64)))
                if sum(len(x[0]) for x in out) > 200_000:
                    yield _windows(out)
                    out = []
            if out:
                yield _windows(out)

    return run


def _level_up(window: int, length: int):
    """The runs of twice ``length`` words of each document of which both halves repeat; ``length`` is the window or a doubling of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column("text"))
            for i in range(batch.num_rows):
                words = Words(texts.slice(i, 1)).hashes()
                if len(words) < 2 * length:
                    continue
                runs, have = doubled(_full(grams(words, window // 2), len(words)), window // 2)[: len(words) - window + 1] if window % 2 == 0 else grams(words, window), window
                while have < length:
                    runs, have = doubled(runs, have), 2 * have
                alive = _member(runs, _listed(batch, "runs", i))
                at = np.flatnonzero(alive[:-length] & alive[length:])
                for lo in range(0, len(at), 200_000):
                    part = at[lo : lo + 200_000]
                    own = np.full(len(part), batch.column("doc_id")[i].as_py(), np.int64)
                    yield _windows([_pairs(own, doubled(runs, length)[part], (words[part] >> np.uint64(32)).astype(np.uint64))])

    return run


def _windows(rows: list[list[np.ndarray]]) -> pa.RecordBatch:
    doc, run, more = (np.concatenate(x) for x in zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([signed(run), pa.array(more.astype(np.uint32).view(np.int32)), pa.array(doc)], ["run", "more", "doc_id"])


def _kept(text: pa.Array, n: int, found: np.ndarray, window: int) -> np.ndarray:
    """Which of a text's n words stay."""
    hashes = Words(text).hashes()
    full = doubled(_full(grams(hashes, window // 2), n), window // 2) if window % 2 == 0 else grams(hashes, window)
    at = np.flatnonzero(_member(full[: n - window + 1], found))
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + window, -1)
    return np.cumsum(mark)[:n] == 0


def _strip(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column("text"))
            longs, removed, digests, kept_text = [], [], [], []
            for lo, hi in pieces(texts):
                w = Words(texts.slice(lo, hi - lo))
                for i in range(hi - lo):
                    n, found = int(w.counts[i]), _listed(batch, "runs", lo + i)
                    kept = _kept(texts.slice(lo + i, 1), n, found, window) if len(found) else None
                    text = w.text(i, kept)
                    longs.append(n)
                    removed.append(0 if kept is None else n - int(kept.sum()))
                    digests.append(hashlib.sha256(text).hexdigest())
                    kept_text.append(text.decode("utf-8", "replace") if removed[-1] else None)
            own = [batch.column(c) for c in batch.schema.names if c not in ("runs", "text")]
            yield pa.RecordBatch.from_arrays(
                [*own, batch.column("text"), pa.array(longs, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_text, pa.string())],
                [*(c for c in batch.schema.names if c not in ("runs", "text")), "text", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def _repeated(rows: DataFrame) -> DataFrame:
    """(run, more, a): of the runs those in more than one document, and the smallest doc_id."""
    return rows.groupBy("run", "more").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("run", "more", "a")


def _two_levels(docs: DataFrame, window: int) -> DataFrame:
    """(run, more, doc_id, a): every window that starts in more than one document, by document."""
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    seen = keep(texts.mapInArrow(_level_one(window), "run long, doc_id long"), "anchors")
    again = keep(seen.groupBy("run").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("run"), "again")
    alive = seen.join(again, "run").groupBy("doc_id").agg(F.collect_set("run").alias("runs"))  # bounded by the document's own length
    full = texts.join(alive, "doc_id").mapInArrow(_level_two(window), "run long, more int, doc_id long")
    full = keep(full, "windows")
    return full.join(keep(_repeated(full), "first"), ["run", "more"])


def repeated_windows(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, runs): for each document its windows that also start in a document with a smaller doc_id."""
    return _two_levels(docs, window).where("doc_id > a").groupBy("doc_id").agg(F.collect_set("run").alias("runs"))


def longest_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, longest): for each document with a repeated window the greatest of window, 2 window, 4 window ... words that a run of it which is also in another document has."""
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    length, found = window, keep(_two_levels(docs, window).select("run", "more", "doc_id"), "level")
    out = found.select("doc_id").distinct().withColumn("longest", F.lit(window))
    while not found.isEmpty():
        alive = found.groupBy("doc_id").agg(F.collect_set("run").alias("runs"))  # bounded by the document's own length
        full = keep(texts.join(alive, "doc_id").mapInArrow(_level_up(window, length), "run long, more int, doc_id long"), "candidates")
        length *= 2
        found = keep(full.join(keep(_repeated(full), "first"), ["run", "more"]).select("run", "more", "doc_id"), "level")
        out = out.union(found.select("doc_id").distinct().withColumn("longest", F.lit(length)))
    return out.groupBy("doc_id").agg(F.max("longest").alias("longest"))


def _stripped(docs: DataFrame, window: int) -> DataFrame:
    found = repeated_windows(docs, window).withColumnRenamed("doc_id", "_id")
    both = docs.join(found, docs["doc_id"].cast("long") == found["_id"], "left").drop("_id")
    schema = ", ".join(f"{c} {t}" for c, t in docs.dtypes if c != "text")
    return both.mapInArrow(_strip(window), schema + ", text string, n_words long, n_removed long, kept_sha256 string, kept_text string")


def substring_dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and kept_text where words were removed (else null)."""
    return _stripped(docs.select("doc_id", "text"), window).drop("text")


def strip_documents(docs: DataFrame, window: int = 50) -> DataFrame:
    """The rows of ``docs`` with their columns; texts without the repeated words, and no row of which nothing is left."""
    out = _stripped(folded(docs, without="text"), window).where("n_removed = 0 or n_removed < n_words")
    cut = F.col("n_removed") > 0
    new = {"text": F.when(cut, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("kept_text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("_all.n_chars"))
    return out.select(*[(new[c] if c in new else F.col(f"_all.`{c}`")).alias(c) for c in docs.columns])


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


ORACLE = r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda v: v <> '') AS w FROM documents),
  p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t),
  k AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 49 <= len(w) THEN md5(array_to_string(w[i : i + 49], ' ')) END AS run FROM p),
  f AS (SELECT run, min(doc_id) AS a FROM k WHERE run IS NOT NULL GROUP BY 1),
  m AS (SELECT k.doc_id, k.i, k.word, coalesce(bool_or(f.a < k.doc_id) OVER (PARTITION BY k.doc_id ORDER BY k.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone FROM k LEFT JOIN f USING (run)),
  s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS g, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY 1)
  SELECT t.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(g, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN s USING (doc_id)"""
