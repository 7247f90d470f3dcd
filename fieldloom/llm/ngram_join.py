"""N-gram Jaccard join with Bayesian candidate pruning (operator 10).

A document is the set of its runs of five words (a text of one to four words is
one run). Equal sets are one node, so copies cost nothing further. MinHash bands
propose candidates: nodes of a bucket are tied to the bucket's least node, its
hub. Every node keeps a tie to its least hub, and ties between hubs hold the rest
together, so there are as many ties as nodes and not one a band; components of
ties say which nodes can be similar at all.

A component that fits a block is compared in one task, in numpy: MinHash values
are compared step by step, pairs whose posterior probability of reaching the
threshold has fallen below the tolerance are dropped, and the rest are verified by the exact
sets. Pairs never become rows.

A larger component is first measured against a center H: the runs that most of one chunk's
nodes hold, of those near the node that most others are tied to. With
d runs of the center missing from a node and a runs of its own, two nodes share at
least |H| - d - d' runs of at most |H| + a + a', so whether a pair is linked for sure is
seen from two numbers, and such links are counted from a histogram of these, without
comparing the nodes. What the center doesn't settle is compared in blocks of two chunks, where a
pair whose distances to the center differ by more than the threshold's distance is left out
(triangle inequality). Any center gives the same links, a good one gives them sooner. So near copies of one text cost linear work; a
large component of texts unlike each other is still compared block by block.

Result: one row per document with rep_id (smallest doc_id with the same set),
class_id (smallest doc_id linked to it by any chain), n_links (other sets at or above
the threshold) and n_copies (documents with the same set).

Null and empty texts have no runs and stand alone. Null doc_ids come after all
others. Repeated rows are copies of each other. Other columns play no part, whatever their
names. Very long texts are sketched whole; chunks are bounded by bytes as well as by
nodes. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TOP, Words, folded, grams, keep, mix, pieces, signed, strings, table

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-9
#: A pair at the threshold misses all of 24 bands of 4 values with a probability of 3e-6.
BANDS, ROWS = 24, 4
STEP, STEPS = 16, 6
#: Most nodes of a chunk; about as many bytes of sets go to one chunk, and to one bundle of small components.
CHUNK, CHUNK_BYTES, BUNDLE_BYTES = 256, 16 << 20, 2 << 20
_ODD = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_XOR = mix(np.arange(1001, 1257, dtype=np.uint64))


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The runs of all texts, one text after another, distinct and sorted within a text; and where texts begin."""
    w = Words(texts)
    words = w.hashes()
    runs = np.full(len(words), TOP, np.uint64)
    full = grams(words, size)
    runs[: len(full)] = full
    left = np.repeat(w.first[1:], w.counts) - np.arange(len(words))
    valid = left >= size
    for i in np.flatnonzero((w.counts > 0) & (w.counts < size)):
        a, n = w.first[i], int(w.counts[i])
        runs[a], valid[a] = grams(words[a : a + n], n)[0], True
    doc = np.repeat(np.arange(len(texts)), w.counts)[valid]
    runs = runs[valid]
    order = np.lexsort((runs, doc))
    doc, runs = doc[order], runs[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (doc[1:] != doc[:-1])
    doc, runs = doc[new], runs[new]
    return runs, np.searchsorted(doc, np.arange(len(texts) + 1))


def minhash(runs: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """k values for each set that isn't empty."""
    heads = first[:-1][np.diff(first) > 0]
    out = np.empty((len(heads), k), np.uint64)
    for j in range(k if len(heads) else 0):
        out[:, j] = np.minimum.reduceat((runs ^ _XOR[j]) * _ODD[j], heads)
    return out


def _sketch(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column("text"))
            for lo, hi in pieces(texts):
                runs, first = shingles(texts.slice(lo, hi - lo))
                some = np.diff(first) > 0
                sig = minhash(runs, first, bands * rows)
                keys = np.zeros((len(sig), bands), np.uint64)
                for r in range(rows):
                    keys = mix(keys * _ODD[0] + sig[:, r::rows])
                heads = first[:-1][some]
                sums = np.add.reduceat(mix(runs), heads) if len(heads) else np.zeros(0, np.uint64)
                ids = np.zeros(hi - lo, np.uint64)
                ids[some] = mix(sums + np.diff(first)[some].astype(np.uint64))
                counts = np.where(some, bands, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), signed(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("th").slice(lo, hi - lo), pa.array(ids.view(np.int64), mask=~some), lists, pa.array(np.diff(first).astype(np.int64))], ["doc_id", "th", "node", "bands", "size"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of (a, b) edges: the least node that it is tied to.

    The graph is contracted: each node moves to its least neighbour, edges are rewritten
    to where their ends have moved, and loops and repeated edges vanish, until no
    edge is left. The moves, read backwards, name the root. Node ids are
    hashes, so each round takes away a good part of the nodes.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, moves = keep(ordered, "edges"), []
    while not edges.isEmpty():
        move = keep(edges.groupBy("a").agg(F.min("b").alias("p")), "moves")
        moves.append(move)
        far = move.select(F.col("a").alias("b"), F.col("p").alias("q"))
        new = edges.join(move.hint("merge"), "a").join(far.hint("merge"), "b", "left").select("p", F.coalesce("q", "b").alias("q")).where("p <> q")
        edges = keep(new.select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).distinct(), "edges")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = moves.pop()
    while moves:
        move = moves.pop()
        up = move.join(out.select(F.col("a").alias("p"), F.col("p").alias("r")), "p", "left").select("a", F.coalesce("r", "p").alias("p"))
        out = keep(up.union(out.join(move, "a", "left_anti")), "roots")
    out = out.select(F.col("a").alias("node"), F.col("p").alias("root"))
    return out.union(out.select(F.col("root").alias("node"), "root").distinct())


def hub_ties(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) between nodes and hubs, about one a node; and (node, tied): how many nodes have the node as least hub."""
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("bucket"))
    shared = keep(buckets.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").select("bucket", "hub"), "buckets")
    # at most one hub a band
    hubs = buckets.join(shared.hint("merge"), "bucket").groupBy("node").agg(F.min("hub").alias("least"), F.collect_set("hub").alias("hubs"))
    hubs = keep(hubs, "hubs")
    between = hubs.select(F.explode("hubs").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
    return hubs.select(F.col("node").alias("a"), F.col("least").alias("b")).union(between), hubs.groupBy("least").agg(F.count(F.lit(1)).alias("tied")).withColumnRenamed("least", "node")


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """After each step: the fewest matches with which a pair may still reach the threshold (posterior under a flat prior)."""
    s = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(STEP, STEP * STEPS + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(s) + (n - m) * np.log1p(-s)
            weight = np.exp(log - log.max())
            if weight[s >= threshold].sum() / weight.sum() >= tolerance:
                break
        out.append(m)
    return np.array(out)


def linked(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float, least: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) of sets reach the threshold: pruned by MinHash, then verified exactly."""
    sizes = np.array([len(x) for x in sets])
    first = np.r_[0, np.cumsum(sizes)]
    sig = minhash(np.concatenate(sets), first, STEP * STEPS)
    alive = np.flatnonzero(np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]) - 1e-9)
    matches = np.zeros(len(a), np.int32)
    for k, need in enumerate(least):
        if not len(alive):
            break
        part = sig[:, k * STEP : (k + 1) * STEP]
        matches[alive] += (part[a[alive]] == part[b[alive]]).sum(axis=1)
        alive = alive[matches[alive] >= need]
    out = np.zeros(len(a), bool)
    if not len(alive):
        return out
    used = np.unique(np.r_[a[alive], b[alive]])
    whole, place = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    if len(alive) > 200 and len(used) * len(whole) <= 24_000_000:
        grid = np.zeros((len(used), len(whole)), np.float32)
        grid[np.repeat(np.arange(len(used)), sizes[used]), place] = 1
        shared = (grid @ grid.T)[np.searchsorted(used, a[alive]), np.searchsorted(used, b[alive])]
    else:
        shared = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a[alive].tolist(), b[alive].tolist())])
    union = sizes[a[alive]] + sizes[b[alive]] - shared
    out[alive] = shared >= threshold * union - 1e-9
    return out


def _least_label(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _found(nodes: list[np.ndarray], links: list[np.ndarray], roots: list[np.ndarray]) -> pa.Table:
    flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (nodes, links, roots)]
    return pa.table([pa.array(x.astype(np.int64)) for x in flat], ["node", "links", "root"])


def _verify(threshold: float, tolerance: float):
    """The links of each node of small components, and the least node of those that they tie together."""

    def run(rows: pa.Table) -> pa.Table:
        least = least_matches(threshold, tolerance)
        comp, node = (rows.column(c).to_numpy() for c in ("comp", "node"))
        raw = rows.column("runs").to_pylist()
        order = np.lexsort((node, comp))
        nodes, links, roots = [], [], []
        cuts = np.flatnonzero(np.r_[True, comp[order][1:] != comp[order][:-1], True])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            own = order[lo:hi]
            own = own[np.r_[True, node[own][1:] != node[own][:-1]]]  # a node is there once
            if len(own) < 2:
                continue
            sets = [np.frombuffer(raw[x], np.uint64) for x in own]
            a, b = np.triu_indices(len(own), 1)
            hit = linked(sets, a, b, threshold, least)
            a, b = a[hit], b[hit]
            nodes.append(node[own])
            links.append(np.bincount(a, minlength=len(own)) + np.bincount(b, minlength=len(own)))
            roots.append(node[own][_least_label(len(own), a, b)])
        return _found(nodes, links, roots)

    return run


def _center(rows: pa.Table, hubs: pa.Table) -> pa.Table:
    """One chunk of a component and the set of its most tied node -> the runs that most of the nodes near this one hold."""
    if not hubs.num_rows:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.binary())], ["comp", "chunks", "center"])
    hub = np.frombuffer(hubs.column("hub_runs")[0].as_py(), np.uint64)
    sets = [np.frombuffer(x, np.uint64) for x in rows.column("runs").to_pylist()]
    sets = [x for x in sets if 5 * len(np.intersect1d(x, hub, assume_unique=True)) >= 3 * max(len(x), len(hub))] + [hub]
    runs, n = np.unique(np.concatenate(sets), return_counts=True)
    center = runs[2 * n > len(sets)]
    return pa.table([hubs.column("hub_comp").slice(0, 1), hubs.column("hub_chunks").slice(0, 1), pa.array([(center if len(center) else hub).tobytes()], pa.binary())], ["comp", "chunks", "center"])


def _near_center(threshold: float):
    """A chunk of a large component and the center -> for each node its weight, the room that a pair has, and its distance.

    ``threshold`` as p / q: a pair is linked for sure if the weights (q d + p a) of both
    together are at most (q - p) |H|.
    """
    q = 1000
    p = round(threshold * q)

    def run(rows: pa.Table, hubs: pa.Table) -> pa.Table:
        hub = np.frombuffer(hubs.column("center")[0].as_py(), np.uint64)
        out = []
        for raw in rows.column("runs").to_pylist():
            own = np.frombuffer(raw, np.uint64)
            shared = len(np.intersect1d(own, hub, assume_unique=True))
            missing, more = len(hub) - shared, len(own) - shared
            out.append((q * missing + p * more, (q - p) * len(hub), 1 - shared / (len(hub) + more)))
        w, room, far = (np.array(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table([rows.column("node"), rows.column("comp"), pa.array(w.astype(np.int64)), pa.array(room.astype(np.int64)), pa.array(far.astype(np.float64))], ["node", "comp", "w", "room", "far"])

    return run


def _sure(rows: pa.Table) -> pa.Table:
    """The histogram of weights of one component -> how many links are sure for a node of each weight."""
    w, n, room = (rows.column(c).to_numpy() for c in ("w", "n", "room"))
    order = np.argsort(w)
    w, n = w[order], n[order]
    upto = np.r_[0, np.cumsum(n)][np.searchsorted(w, room[0] - w, side="right")]
    return pa.table([rows.column("comp"), pa.array(w), pa.array(upto - (2 * w <= room[0]))], ["comp", "w", "sure"])


def _unsettled(threshold: float, tolerance: float):
    """Two chunks of a large component (or one with itself): the links that the center left open."""

    def run(rows: pa.Table) -> pa.Table:
        least = least_matches(threshold, tolerance)
        node, w, room, far, side = (rows.column(c).to_numpy() for c in ("node", "w", "room", "far", "side"))
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("runs").to_pylist()]
        if i == j:
            a, b = np.triu_indices(len(node), 1)
        else:
            a, b = (x.ravel() for x in np.meshgrid(np.flatnonzero(side == i), np.flatnonzero(side == j), indexing="ij"))
        open_ = (w[a] + w[b] > room[a]) & (np.abs(far[a] - far[b]) <= 1 - threshold + 1e-9)
        a, b = a[open_], b[open_]
        if not len(a):
            return _found([], [], [])
        hit = linked(sets, a, b, threshold, least)
        a, b = a[hit], b[hit]
        return _found([node], [np.bincount(a, minlength=len(node)) + np.bincount(b, minlength=len(node))], [node[_ranked(node, a, b)]])

    return run


def _ranked(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each node the place of the least node that pairs tie it to."""
    order = np.argsort(node)
    rank = np.argsort(order)
    return order[_least_label(len(node), rank[a], rank[b])][rank]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = strings(batch.column("text"))
        for lo, hi in pieces(texts):
            runs, first = shingles(texts.slice(lo, hi - lo))
            sets = [runs[x:y].tobytes() for x, y in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(c).slice(lo, hi - lo) for c in ("node", "comp", "chunks")] + [pa.array(sets, pa.binary())], ["node", "comp", "chunks", "runs"])


def _large(sets: DataFrame, tied: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(node, links, root) pieces of the components with more than one chunk."""
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    hubs = sets.select("node", "comp", "chunks").join(tied, "node").groupBy("comp", "chunks").agg(F.max_by("node", F.struct("tied", "node")).alias("node"))
    hubs = hubs.join(sets.select("node", "runs"), "node").dropDuplicates(["comp"]).select(F.col("comp").alias("hub_comp"), F.col("chunks").alias("hub_chunks"), F.col("runs").alias("hub_runs"))
    sets = sets.withColumn("chunk", chunk)
    centers = sets.where("chunk = 0").groupBy("comp").cogroup(hubs.groupBy("hub_comp")).applyInArrow(_center, "comp long, chunks int, center binary")
    centers = keep(centers, "centers")
    each = centers.select(F.col("comp").alias("c"), "center", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("k"))
    near = sets.groupBy("comp", "chunk").cogroup(each.groupBy("c", "k")).applyInArrow(_near_center(threshold), "node long, comp long, w long, room long, far double")
    near = keep(near.dropDuplicates(["node"]), "near")
    # links for sure, by weight; all of these nodes are linked to the one of least weight
    sure = near.groupBy("comp", "room", "w").agg(F.count(F.lit(1)).alias("n")).groupBy("comp").applyInArrow(_sure, "comp long, w long, sure long")
    inmost = near.groupBy("comp").agg(F.min_by("node", F.struct("w", "node")).alias("hub"))
    # a table of its own for what a component knows once: so Spark can split the hot side of the join
    sure = near.join(keep(sure.where("sure > 0").join(inmost, "comp"), "sure").hint("merge"), ["comp", "w"])
    sure = keep(sure.select("node", F.col("sure").alias("links"), F.least("node", "hub").alias("root"), "hub"), "settled")
    sure = sure.select("node", "links", "root").union(sure.select(F.col("hub").alias("node"), F.lit(0).cast("long").alias("links"), "root").distinct())
    # the rest: outer nodes against each other and against the inner ones
    outer = 2 * F.col("w") > F.col("room")
    load = near.groupBy("comp").agg(F.count_if(outer).alias("n_out"), F.count_if(~outer).alias("n_in")).where("n_out > 0")
    load = centers.select("comp", "chunks").join(load, "comp").select("comp", *[F.ceil(F.col(n) * F.col("chunks") / (F.col("n_out") + F.col("n_in"))).cast("int").alias(c) for n, c in (("n_out", "outs"), ("n_in", "ins"))])
    rest = near.join(keep(load, "load").hint("merge"), "comp")
    # chunks 0.. hold outer nodes, chunks outs.. hold inner ones
    side = F.when(outer, F.pmod(F.xxhash64("node"), F.col("outs"))).otherwise(F.col("outs") + F.pmod(F.xxhash64("node"), F.greatest("ins", F.lit(1)))).cast("int")
    other = F.when(outer, F.sequence(F.lit(0), F.col("outs") + F.col("ins") - 1)).otherwise(F.sequence(F.lit(0), F.col("outs") - 1))
    rest = rest.withColumn("side", side).join(sets.select("node", "runs").dropDuplicates(["node"]).hint("merge"), "node").withColumn("other", F.explode(other))
    rest = rest.select("comp", "node", "w", "room", "far", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "runs")
    return rest.groupBy("comp", "i", "j").applyInArrow(_unsettled(threshold, tolerance), "node long, links long, root long").union(sure)


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, chunk: int = CHUNK) -> DataFrame:
    """doc_id, th (hash of the text), rep_id, class_id, n_links, n_copies, and keep_th of the class's first row."""
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    sketch = keep(texts.mapInArrow(_sketch(BANDS, ROWS), f"doc_id {kind}, th long, node long, bands array<long>, size long"), "sketch")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th"))
    nodes = sketch.where("node is not null").groupBy("node").agg(first.alias("first"), F.count(F.lit(1)).alias("n_copies"), F.first("bands").alias("bands"), F.first("size").alias("size"))
    nodes = keep(nodes, "nodes")
    ties, tied = hub_ties(nodes)
    ties = keep(components(ties).join(nodes.select("node", "first", "size"), "node"), "tied")
    load = ties.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("runs"))
    chunks = F.greatest(F.ceil(F.col("n") / chunk), F.ceil(F.col("runs") * 8 / CHUNK_BYTES)).cast("int")
    large = keep(load.select("root", chunks.alias("chunks")).where("chunks > 1"), "large")
    chosen = ties.join(large.hint("merge"), "root", "left")
    chosen = keep(chosen.select("node", F.col("root").alias("comp"), F.coalesce("chunks", F.lit(1)).alias("chunks"), F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th"), "size"), "chosen")
    bundles = 1 + (chosen.agg(F.sum("size")).first()[0] or 0) * 8 // BUNDLE_BYTES
    # one plan at every size: the candidates grow with the corpus
    read = texts.join(chosen.drop("size").withColumnRenamed("doc_id", "own").hint("merge"), (texts["th"] == chosen["th"]) & texts["doc_id"].eqNullSafe(F.col("own"))).select("text", "node", "comp", "chunks")
    sets = keep(read.mapInArrow(_sets, "node long, comp long, chunks int, runs binary"), "sets")
    small = sets.where("chunks = 1").withColumn("bundle", F.pmod(F.xxhash64("comp"), F.lit(bundles)))
    found = small.groupBy("bundle").applyInArrow(_verify(threshold, tolerance), "node long, links long, root long")
    found = keep(found.union(_large(sets.where("chunks > 1"), tied, threshold, tolerance)), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    root = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = keep(nodes.drop("bands", "size").join(links, "node", "left").join(root, "node", "left").select("node", "first", "n_copies", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("root", "node").alias("root")), "named")
    best = keep(named.where("n_links > 0").groupBy("root").agg(F.min("first").alias("best")), "best")
    named = named.join(best.hint("merge"), "root", "left").withColumn("best", F.coalesce("best", "first"))
    named = keep(named.select("node", "n_copies", "n_links", F.col("first.doc_id").alias("rep_id"), F.col("best.doc_id").alias("class_id"), F.col("best.th").alias("keep_th")), "classes")
    out = sketch.drop("bands", "size").join(named, "node", "left")
    alone = F.col("node").isNull()
    return out.select(
        "doc_id", "th", F.when(alone, F.col("doc_id")).otherwise(F.col("rep_id")).alias("rep_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.when(alone, F.col("th")).otherwise(F.col("keep_th")).alias("keep_th"),
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns: of each class its first row alone."""
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    classes = jaccard_classes(docs)
    stay = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("th") == F.col("keep_th"))).select(F.col("doc_id").alias("_id"), F.col("th").alias("_stay")).distinct()
    rows = folded(docs).withColumn("_th", th)
    rows = rows.join(keep(stay, "stay"), (F.col("_th") == F.col("_stay")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return rows.dropDuplicates(["_th", "doc_id"]).select("_all.*")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "rep_id", "class_id", "n_links", "n_copies")
