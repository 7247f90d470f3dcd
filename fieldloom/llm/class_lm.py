"""LM scoring by a Brown class-based bigram model (operator 4).

All training documents are counted, and every word gets its class by exchange. The most frequent words
(``k``) start it: exchange clustering on the counts of their bigrams, collected from
the whole corpus, until none moves (at most k x k numbers reach the driver). From there the whole vocabulary
takes part, in ``rounds`` over the corpus: every word's neighbours are counted by class, over all blocks, and the
word moves to the class that gains most. Neighbours count with the class that they have by
then: in the first round those are the frequent words, in further ones all. What is counted is summed over all blocks before a word moves, so the
classes, and the scores, don't depend on how the input is cut into files and blocks. All words of a round move at
once, so the gain is that of the class bigrams of the round before. Words none of whose neighbours has a
class share a class of their own. The model tells the frequent words of a class from the others. One round is
the default: each further one moves fewer words and writes about as much again as the input.

A text's probability is the
product of class transitions and word emissions; transitions are smoothed
with the classes' own shares, and words that training lacks take the
share that words seen once have after the same class (Good-Turing).

Texts are kept as blocks of some MB: the distinct words of a block, and its tokens as their
places. The words of blocks meet the vocabulary in sort merge joins, and a block and
the classes of its words meet in a cogroup. The vocabulary is never broadcast; what is summed for a word comes
as one row from each block that holds it, by parts of some ``FOLD`` blocks and then one row from each part, so no group grows with the input.

Words are lower-cased (A-Z) runs outside ``[\\x20\\x09-\\x0D]``, known by 64 bits of
hash; every text ends with an end token. Null texts are empty: the end token alone.
Without training texts every token has probability 1 / (V + 1) as in the base,
with V = 0. Repeated rows count as often as they occur. Ties in frequency go to the smaller hash, ties
between classes to the smaller number. A very long text is a block of its own. Other columns play no part, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, keep, remainder, signed, strings, table

K, CLASSES, ROUNDS = 1000, 40, 1
#: Bytes of text in a block, rows of evidence that are summed in one group, and words of blocks that are packed together.
BLOCK, BUCKET, PACK = 16 << 20, 400_000, 1_000_000
#: Blocks whose evidence of a word meets in one group; of more blocks it is summed in parts first, which changes no sum.
FOLD = 4096
EVIDENCE = "word long, cls int, near binary"
END = np.uint64(0x51ED270B7F2A94C3)
ONCE = 128  # the bit of a word that training holds once


def _sequence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts, each text closed by the end token; and where texts begin."""
    w = Words(texts, lower=True)
    first = w.first + np.arange(len(w.first))
    out = np.full(first[-1], END, np.uint64)
    inside = np.ones(first[-1], bool)
    inside[first[1:] - 1] = False
    out[inside] = w.hashes()
    return out, first


def _blocks(bound: int):
    """Rows -> blocks: distinct words, their training counts, tokens as places of words, where texts begin, identifiers and split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            seq, first = _sequence(strings(rows.column("text")))
            split = rows.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            words, at = np.unique(seq, return_inverse=True)
            train = ~np.repeat(split, np.diff(first))
            n = np.bincount(at[train], minlength=len(words)).astype(np.uint32)
            whole = pa.array([0, len(split)], pa.int32())
            data = [pa.array([x.tobytes()], pa.binary()) for x in (words, n, at.astype(np.uint32), first.astype(np.int64))]
            return pa.RecordBatch.from_arrays([rows.column("row").slice(0, 1), *data, pa.ListArray.from_arrays(whole, rows.column("doc_id")), pa.ListArray.from_arrays(whole, rows.column("held_out"))], ["block", "words", "n", "seq", "first", "ids", "held"])

        for batch in batches:
            sizes = np.diff(np.frombuffer(strings(batch.column("text")).buffers()[1], np.int64)[: batch.num_rows + 1]) if batch.num_rows else []
            lo = 0
            for k, n in enumerate(sizes):
                size += int(n) + 1
                if size > bound:
                    held.append(batch.slice(lo, k + 1 - lo))
                    yield out()
                    held, size, lo = [], 0, k + 1
            if lo < batch.num_rows:
                held.append(batch.slice(lo))
        if held:
            yield out()

    return run


class _Block:
    """A row of ``_blocks``, read back."""

    def __init__(self, row: dict):
        self.words, self.n = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["n"], np.uint32)
        if "seq" in row:
            self.seq, self.first, self.split = np.frombuffer(row["seq"], np.uint32), np.frombuffer(row["first"], np.int64), np.array(row["held"], bool)

    def training(self) -> np.ndarray:
        """The tokens of training texts, one text after another; each ends with the end token."""
        return self.seq[~np.repeat(self.split, np.diff(self.first))]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(name)[k].as_py() for name in batch.schema.names}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        block = _Block(row)
        some = block.n > 0
        yield pa.RecordBatch.from_arrays([signed(block.words[some]), pa.array(block.n[some].astype(np.int64))], ["word", "n"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        words = np.frombuffer(row["words"], np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), row["block"], np.int64)), pa.array(np.arange(len(words), dtype=np.int32)), signed(words)], ["block", "place", "word"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, place, cls, n) in any order -> for each block, lists of them as bytes."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        block, place, cls, n = (np.concatenate([x[k] for x in held]) for k in range(4))
        order = np.lexsort((place, block))
        block, place, cls, n = (x[order] for x in (block, place, cls, n))
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
        lists = [[x[lo:hi].astype(kind).tobytes() for lo, hi in zip(cuts[:-1], cuts[1:])] for x, kind in ((place, "<u4"), (cls, "<i2"), (n, "<i8"))]
        return pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), *(pa.array(x, pa.binary()) for x in lists)], ["block", "place", "cls", "n"])

    for batch in batches:
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "place", "cls", "n")])
        size += batch.num_rows
        if size > PACK:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def _lookup(sorted_words: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places, and which are right."""
    if not len(sorted_words):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_words, x), len(sorted_words) - 1)
    return at, sorted_words[at] == x


def _bigrams(frequent: np.ndarray):
    """Counts of neighbours in training texts that are both frequent; the end token stands before every text."""
    k = len(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        end = _lookup(frequent, np.array([END]))[0]
        for row in _rows(batches):
            block = _Block(row)
            at, known = _lookup(frequent, block.words)
            at, known = (np.concatenate([x, of[block.training()]]) for x, of in ((end, at), ([True], known)))
            both = known[1:] & known[:-1]
            total += np.bincount((at[:-1] * k + at[1:])[both], minlength=k * k)
        pairs = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(total[pairs])], ["pair", "n"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def exchange(bigrams: np.ndarray, classes: int) -> np.ndarray:
    """The exchange algorithm: each word moves to the class that makes the class bigrams likeliest, until none moves."""
    k = len(bigrams)
    c = np.arange(k) % classes
    one = np.eye(classes)
    right, left = bigrams @ one[c], bigrams.T @ one[c]  # by word: counts of the classes behind and before it
    n = one[c].T @ right
    moved = k
    while moved:  # ends, as every move raises the likelihood
        moved = 0
        for w in range(k):
            a, own = c[w], bigrams[w, w]
            r, l = right[w].copy(), left[w].copy()
            r[a] -= own
            l[a] -= own
            n[a] -= r
            n[:, a] -= l
            n[a, a] -= own
            base = _xlogx(n)
            gain = (_xlogx(n + r) - base).sum(axis=1) + (_xlogx(n.T + l) - base.T).sum(axis=1)
            d = np.arange(classes)
            gain += _xlogx(n[d, d] + r + l + own) + base[d, d] - _xlogx(n[d, d] + r) - _xlogx(n[d, d] + l)
            rows, cols, tr, tl = n.sum(axis=1) + l, n.sum(axis=0) + r, r.sum() + own, l.sum() + own  # wherever the word goes, its neighbours' classes count it
            gain -= _xlogx(rows + tr) - _xlogx(rows) + _xlogx(cols + tl) - _xlogx(cols)
            b = int(np.argmax(gain)) if gain.max() > gain[a] + 1e-9 else a
            n[b] += r
            n[:, b] += l
            n[b, b] += own
            if b != a:
                c[w], moved = b, moved + 1
                right[:, a] -= bigrams[:, w]
                right[:, b] += bigrams[:, w]
                left[:, a] -= bigrams[w]
                left[:, b] += bigrams[w]
    return c


_ENTRY = np.dtype([("code", "u1"), ("n", "<u4")])
_SUM = np.dtype([("code", "u1"), ("n", "<i8")])


def _neighbours(block: _Block, cls: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct place * 2 classes + code, and their counts, of the neighbours in training texts: code c behind a word, ``classes`` + c before it. ``cls``: by place, -1 for none."""
    seq = block.training()
    of = cls[seq]
    word = block.words[seq] != END
    keys = []
    for subject, near, shift in ((slice(0, -1), slice(1, None), 0), (slice(1, None), slice(0, -1), classes)):
        ok = word[subject] & (of[near] >= 0)
        keys.append(seq[subject][ok].astype(np.int64) * (2 * classes) + shift + of[near][ok])
    return np.unique(np.concatenate(keys), return_counts=True)


def _gains(place: np.ndarray, code: np.ndarray, n: np.ndarray, size: int, affinity: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For some places after others (``place`` is sorted): the counts of their neighbours by code, and the gain of each class."""
    behind, before = affinity
    classes = len(behind)
    for lo in range(0, size, 20_000):
        hi = min(size, lo + 20_000)
        a, b = np.searchsorted(place, [lo, hi])
        m = np.bincount((place[a:b] - lo) * (2 * classes) + code[a:b], n[a:b], (hi - lo) * 2 * classes).reshape(-1, 2 * classes)
        yield lo, hi, m, m[:, :classes] @ behind.T + m[:, classes:] @ before.T


def _evidence(block: _Block, cls: np.ndarray, classes: int) -> pa.Table:
    """For each word of a block the classes of its neighbours with counts."""
    key, n = _neighbours(block, cls, classes)
    at = key // (2 * classes)
    places, packed = _pack(at, key % (2 * classes), n, _ENTRY)
    return pa.table([signed(block.words[places]), pa.array(cls[places].astype(np.int32)), packed], ["word", "cls", "near"])


def _pack(at: np.ndarray, code: np.ndarray, n: np.ndarray, kind: np.dtype) -> tuple[np.ndarray, pa.Array]:
    """The distinct places of ``at`` (sorted), and the codes and counts of each as bytes."""
    entries = np.empty(len(at), kind)
    entries["code"], entries["n"] = code, n
    heads = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    offsets = (np.r_[heads, len(at)] * kind.itemsize).astype(np.int32)
    return at[heads], pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(entries.tobytes())])


def _in_parts(evidence: pa.Table, block: int, parts: int) -> pa.Table:
    """Evidence with the part of its block, if there are parts."""
    if parts == 1:
        return evidence
    mixed = (block * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 40
    return evidence.append_column("part", pa.array(np.full(len(evidence), mixed % parts, np.int32)))


def _unpack(rows: pa.Table, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words, their classes, the place of each entry's word among them, and the entries."""
    near = rows.column("near").to_pylist()
    lengths = np.array([len(x) // kind.itemsize for x in near], np.int64)
    words, at = np.unique(rows.column("word").to_numpy(), return_inverse=True)
    cls = np.full(len(words), -1, np.int64)
    np.maximum.at(cls, at, rows.column("cls").to_numpy())
    return words, cls, np.repeat(at, lengths), np.frombuffer(b"".join(near), kind)


def _fold(rows: pa.Table) -> pa.Table:
    """Evidence of some words in some blocks -> one row a word."""
    words, cls, place, entries = _unpack(rows, _ENTRY)
    key, at = np.unique(place * 256 + entries["code"], return_inverse=True)
    n = np.zeros(len(key), np.int64)
    np.add.at(n, at, entries["n"].astype(np.int64))
    places, packed = _pack(key // 256, key % 256, n, _SUM)
    return pa.table([pa.array(words[places]), pa.array(cls[places].astype(np.int32)), packed], ["word", "cls", "near"])


def _first_evidence(frequent: np.ndarray, of: np.ndarray, classes: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = _Block(row)
            at, known = _lookup(frequent, block.words)
            cls = np.where(known & (block.words != END), of[at], -1)
            yield from _in_parts(_evidence(block, cls, classes), row["block"], parts).to_batches()

    return run


def _by_place(named: pa.Table, size: int, none: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes (``none`` where there is none) and counts by place."""
    cls, n = np.full(size, none, np.int64), np.zeros(size, np.int64)
    for row in _rows(named.to_batches()):
        at = np.frombuffer(row["place"], "<u4")
        cls[at], n[at] = np.frombuffer(row["cls"], "<i2"), np.frombuffer(row["n"], "<i8")
    return cls, n


def _next_evidence(classes: int, parts: int):
    def run(blocks: pa.Table, named: pa.Table) -> pa.Table:
        row = next(_rows(blocks.to_batches()))
        block = _Block(row)
        return _in_parts(_evidence(block, _by_place(named, len(block.words), -1)[0], classes), row["block"], parts)

    return run


def affinities(joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a neighbour of class c behind (or before) a word speaks for class g: log of joint over chance. ``joint``: class, class behind it."""
    joint = joint + 0.5
    log = np.log(joint * joint.sum() / np.outer(joint.sum(axis=1), joint.sum(axis=0)))
    return log, log.T


def _assign(affinity: tuple[np.ndarray, np.ndarray], kind: np.dtype):
    """All evidence of some words -> the class of each that gains most; and the sums of their neighbours by class (rows without a word)."""
    classes = len(affinity[0])

    def run(rows: pa.Table) -> pa.Table:
        words, old, place, entries = _unpack(rows, kind)
        new = old.copy()
        joint = np.zeros((classes, 2 * classes))
        order = np.argsort(place, kind="stable")
        for lo, hi, m, gain in _gains(place[order], entries["code"][order].astype(np.int64), entries["n"][order], len(words), affinity):
            was = old[lo:hi]
            stay = (was >= 0) & (gain[np.arange(hi - lo), np.maximum(was, 0)] >= gain.max(axis=1) - 1e-9)
            new[lo:hi] = np.where(stay, was, gain.argmax(axis=1))
            np.add.at(joint, new[lo:hi], m)
        sums = np.flatnonzero(joint)
        nothing = pa.nulls(len(sums), pa.int64())
        assigned = pa.table([pa.array(words), pa.array(new.astype(np.int32)), pa.array(new != old), pa.nulls(len(words), pa.int32()), pa.nulls(len(words), pa.float64())], ["word", "cls", "moved", "at", "n"])
        summed = pa.table([nothing, pa.nulls(len(sums), pa.int32()), pa.nulls(len(sums), pa.bool_()), pa.array(sums.astype(np.int32)), pa.array(joint.ravel()[sums])], ["word", "cls", "moved", "at", "n"])
        return pa.concat_tables([assigned, summed])

    return run


def _documents(total: int, distinct: int, mass: np.ndarray, unknown: int):
    """A block and the classes and counts of its words -> for each document the counts and sums, and its sequence of classes."""

    def run(blocks: pa.Table, named: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "emission", "classes"]
        block = _Block(next(_rows(blocks.select(["words", "n", "seq", "first", "held"]).to_batches())))
        cls, n = _by_place(named, len(block.words), unknown)
        base = np.log10((n + 1) / (total + distinct + 1))
        emit = np.where(n > 0, np.log10(np.maximum(n, 1) / np.maximum(1, mass[cls])), 0.0)
        code = (cls | np.where(n == 1, ONCE, 0)).astype(np.uint8)
        head = block.first[:-1]
        sums = [np.add.reduceat(x[block.seq], head) for x in ((n > 0).astype(np.int64), base, emit)]
        c = code[block.seq]
        rows = [c[x:y].tobytes() for x, y in zip(block.first[:-1].tolist(), block.first[1:].tolist())]
        ids, held = (blocks.column(x).combine_chunks().flatten() for x in ("ids", "held"))
        return pa.table([ids, held, pa.array(np.diff(block.first)), *map(pa.array, sums), pa.array(rows, pa.binary())], names)

    return run


def _context(c: np.ndarray, unknown: int, end: int) -> np.ndarray:
    """The class before each token: the last that isn't of an unknown word; before a text, the end class."""
    known = np.where(c == unknown, -1, np.arange(len(c)))
    last = np.maximum.accumulate(np.concatenate([[-1], known[:-1]]))
    return np.where(last < 0, end, c[np.maximum(last, 0)])


def _transitions(classes: int, unknown: int, end: int):
    """Class bigrams of training texts, and how many of them lead to words seen once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * classes * classes, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                c = np.frombuffer(b"".join(batch.column("classes").slice(lo, 500).to_pylist()), np.uint8).astype(np.int64)
                once, c = c >> 7, c & (ONCE - 1)
                total += np.bincount((once * classes + _context(c, unknown, end)) * classes + c, minlength=len(total))  # a text ends with the end class, so texts can stand one after another
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    return run


def transition_logs(counts: np.ndarray, unknown: int, prior: float = 20.0) -> np.ndarray:
    """log10 of the probability of a class after a class; ``counts`` [2, class, class], the second of words seen once."""
    n, once = counts.sum(axis=0).astype(float), counts[1].sum(axis=1).astype(float)
    n[:, unknown] = 0
    rows = n.sum(axis=1)
    share = n.sum(axis=0) / max(1.0, n.sum())
    overall = (once.sum() + 0.5) / (rows.sum() + 1.0)
    miss = np.minimum(0.5, (once + prior * overall) / (rows + prior))
    p = (n + prior * share) / (rows + prior)[:, None] * (1 - miss)[:, None]
    p[:, unknown] = miss
    return np.log10(np.maximum(p, 1e-300))


def _round(evidence: DataFrame, bucket: int, parts: int, joint: np.ndarray) -> tuple[DataFrame, np.ndarray, bool]:
    """One exchange of all words that have evidence: (word, cls), the class bigrams that it leaves behind, and whether words moved."""
    classes = len(joint)
    of = lambda n: F.pmod(F.xxhash64("word"), F.lit(n)).alias("bucket")
    if parts > 1:
        evidence = evidence.groupBy(of(1 + bucket // parts), "part").applyInArrow(_fold, EVIDENCE)
    out = evidence.groupBy(of(bucket)).applyInArrow(_assign(affinities(joint), _SUM if parts > 1 else _ENTRY), "word long, cls int, moved boolean, at int, n double")
    out = keep(out, "assigned")
    sums = np.zeros((classes, 2 * classes))
    for r in out.where("word is null").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most 2 classes^2 numbers
        sums.flat[r["at"]] = r["n"]
    return out.where("word is not null").select("word", "cls"), sums[:, :classes] + sums[:, classes:].T, not out.where("moved").isEmpty()


def _named_places(blocks: DataFrame, named: DataFrame) -> DataFrame:
    """(block, place, cls, n), packed: what ``named`` has of the words of each block."""
    places = blocks.select("block", "words").mapInArrow(_places, "block long, place int, word long")
    return places.join(named.hint("merge"), "word").select("block", "place", "cls", "n").mapInArrow(_packed, "block long, place binary, cls binary, n binary")


def cluster(blocks: DataFrame, counts: DataFrame, k: int, classes: int, rounds: int) -> tuple[DataFrame, list[int]]:
    """(word, n, cls, frequent) for all training words, cls from 0, null without evidence; and the k most frequent words."""
    spark = blocks.sparkSession
    top = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(k).collect()]  # at most k
    frequent = np.unique(np.append(np.array(top, np.int64).view(np.uint64), END))
    pairs = blocks.mapInArrow(_bigrams(frequent), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # at most k * k
    bigrams = np.zeros(len(frequent) ** 2)
    bigrams[pairs["pair"].to_numpy()] = pairs["n"].to_numpy()
    bigrams = bigrams.reshape(len(frequent), -1)
    order = np.argsort(-bigrams.sum(axis=0), kind="stable")
    of = np.empty(len(frequent), np.int64)
    of[order] = exchange(bigrams[order][:, order], min(classes, len(frequent)))
    one = np.eye(classes)[of]
    joint = one.T @ bigrams @ one
    size = blocks.agg(F.sum(F.octet_length("words") / 8).alias("rows"), F.count(F.lit(1)).alias("blocks")).first()
    bucket, parts = 1 + int(size["rows"] or 0) // BUCKET, max(1, -(-size["blocks"] // FOLD))
    schema = EVIDENCE if parts == 1 else EVIDENCE + ", part int"
    evidence = blocks.mapInArrow(_first_evidence(frequent, of, len(joint), parts), schema)
    named, joint, _ = _round(evidence, bucket, parts, joint)
    for _ in range(rounds - 1):
        places = _named_places(blocks, named.withColumn("n", F.lit(0).cast("long")))
        evidence = blocks.groupBy("block").cogroup(places.groupBy("block")).applyInArrow(_next_evidence(classes, parts), schema)
        named, joint, moved = _round(evidence, bucket, parts, joint)
        if not moved:
            break
    chosen = spark.createDataFrame([(w,) for w in top], "word long").withColumn("frequent", F.lit(True))
    return counts.join(named.hint("merge"), "word", "left").join(F.broadcast(chosen), "word", "left").select("word", "n", "cls", F.coalesce("frequent", F.lit(False)).alias("frequent")), top


def score_documents(docs: DataFrame, held_out, k: int = K, classes: int = CLASSES, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; rows where ``held_out`` is false train the model."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", held_out.alias("held_out"), F.monotonically_increasing_id().alias("row"))
    blocks = keep(rows.mapInArrow(_blocks(block), f"block long, words binary, n binary, seq binary, first binary, ids array<{kind}>, held array<boolean>"), "blocks", compression="zstd")
    counts = keep(blocks.select("words", "n").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    sums = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = sums["n"] or 0, sums["v"]
    words, _ = cluster(blocks.select("block", "words", "n", "seq", "first", "held"), counts, k, classes, rounds)
    # classes 0..: frequent words, and as many for the other words of the same classes; then the end token, words without evidence, unknown words
    end, alone, unknown = 2 * classes, 2 * classes + 1, 2 * classes + 2
    own = F.when(F.col("word") == int(END.astype(np.int64)), end).when(F.col("cls").isNull(), alone).when(F.col("frequent"), F.col("cls")).otherwise(F.col("cls") + classes)
    vocabulary = keep(words.select("word", "n", own.alias("cls")), "vocabulary")
    mass = np.zeros(unknown + 1)
    for r in vocabulary.groupBy("cls").agg(F.sum("n").alias("n")).collect():
        mass[r["cls"]] = r["n"]
    places = _named_places(blocks, vocabulary)
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, emission double, classes binary"
    read = keep(blocks.groupBy("block").cogroup(places.groupBy("block")).applyInArrow(_documents(total, distinct, mass, unknown), schema), "sequences", compression="zstd")
    size = unknown + 1
    flat = np.zeros(2 * size * size, np.int64)
    for r in read.where("not held_out").select("classes").mapInArrow(_transitions(size, unknown, end), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        flat[r["at"]] = r["n"]
    logs = transition_logs(flat.reshape(2, size, size), unknown)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, emitted in zip(batch.column("classes"), batch.column("emission").to_pylist()):
                c = np.frombuffer(x.as_buffer(), np.uint8) & (ONCE - 1)
                out.append(float(logs[_context(c, unknown, end), c].sum()) + emitted)
            cols = [batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([total] * batch.num_rows, pa.int64()), batch.column("base_score"), pa.array(out, pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return read.mapInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), F.coalesce(remainder("doc_id", 7) == 2, F.lit(False)))
