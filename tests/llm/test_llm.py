"""The training-data operators on small awkward tables, against brute force."""

import hashlib
import random
import zlib
from array import array

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldloom.llm import byte_bpe, class_lm, curve_search, exact_dedup, ngram_join, packing, quality, sharding, substring_dedup, toxicity
from fieldloom.llm.common import keep

RND = random.Random(4)
WORDS = [f"w{k}" for k in range(300)]
LONG = " ".join(RND.choice(WORDS) for _ in range(4000))
SHARED = " ".join(RND.choice(WORDS) for _ in range(70))
BASE = [RND.choice(WORDS) for _ in range(120)]
NEAR = [*BASE[:60], "other", *BASE[61:]]


def plain(n):
    return " ".join(RND.choice(WORDS) for _ in range(n))


ROWS = [
    (1, LONG, "a"), (2, " ".join(BASE), "a"), (3, " ".join(NEAR), "a"), (4, "  ".join(BASE) + " \n", "b"), (5, None, None), (6, "", "a"), (7, "one two three", "c"), (7, "one two three", "c"),
    (8, plain(30) + " " + SHARED + " " + plain(30), "a"), (9, SHARED + ". " + plain(10), "b"), (10, "x " * 200, "a"), (11, "x " * 120, "a"), (12, "ÄÖ 漢字 😀 it's 123!!", "b"), (None, "lost row", "a"), (13, LONG, "z"), (14, "one two", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, s, "node", 5, k) for k, (i, t, s) in enumerate(ROWS)]
    # extra columns whose names clash with those used inside
    return keep(spark.createDataFrame(rows, "doc_id long, text string, source string, node string, runs int, row int"), "fixture")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def words(text):
    return (text or "").encode().split()


def test_substring_dedup(docs, none):
    got = {(r["doc_id"], r["n_words"]): r for r in substring_dedup.substring_dedup(docs).collect()}
    first = {}
    for i, t, _ in ROWS:
        w = words(t)
        for k in range(len(w) - 49) if i is not None else ():
            key = tuple(w[k : k + 50])
            first[key] = min(i, first.get(key, i))
    for i, t, _ in ROWS:
        w = words(t)
        stay = np.ones(len(w), bool)
        for k in range(len(w) - 49) if i is not None else ():
            if first[tuple(w[k : k + 50])] < i:
                stay[k : k + 50] = False
        r = got[i, len(w)]
        assert r["n_removed"] == int((~stay).sum()) and r["kept_sha256"] == hashlib.sha256(b" ".join(x for x, s in zip(w, stay) if s)).hexdigest()
    assert got[13, 4000]["n_removed"] == 4000
    assert substring_dedup.substring_dedup(none).count() == 0
    assert substring_dedup.strip_documents(docs).columns == docs.columns


@pytest.mark.parametrize("window", [6, 5])
def test_longest_repeats(spark, window):
    rnd = random.Random(9)
    parts = [[rnd.choice(WORDS) for _ in range(n)] for n in (13, 30, 50, 101)]
    rows = [(k, " ".join(sum(([rnd.choice(WORDS) for _ in range(9)] + p for p in rnd.sample(parts, rnd.randrange(3))), []))) for k in range(25)] + [(30, None), (31, " ".join(parts[0] * 3)), (31, " ".join(parts[0] * 3))]
    want = {}
    length = window
    while True:
        seen = {}
        for i, t in rows:
            w = words(t)
            for k in range(len(w) - length + 1):
                seen.setdefault(tuple(w[k : k + length]), set()).add(i)
        found = {i for ids in seen.values() if len(ids) > 1 for i in ids}
        if not found:
            break
        want |= dict.fromkeys(found, length)
        length *= 2
    got = {r["doc_id"]: r["longest"] for r in substring_dedup.longest_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window).collect()}
    assert got == want and max(want.values()) >= 16 * window


def test_exact_dedup(docs, none, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    key = lambda rows: sorted(map(str, rows))
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({exact_dedup.ORACLE})").fetchall()
    assert key(tuple(r) for r in exact_dedup.exact_dedup(docs).select(*cols).collect()) == key(want)
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.drop_copies(docs).count() == sum(r[3] for r in want)


def test_index_of_several_runs(docs):
    index = exact_dedup.MergeIndex(docs.sparkSession)
    index.flush(docs.where("row < 8"))
    index.flush(docs.where("row >= 8"))
    assert index.compact().agg(F.sum("group_size")).first()[0] == len(ROWS)
    assert index.false_hits(index.compact()).count() == 0
    small = exact_dedup.MergeIndex(docs.sparkSession, memtable=200)  # a few rows, or one text
    small.flush(docs)
    assert small.false_hits(small.compact()).count() == 0
    digest = hashlib.sha256("".join(ROWS[1][1].split()).encode()).digest()
    assert sorted(r["doc_id"] for r in index.lookup([digest]).collect()) == sorted(r["doc_id"] for r in small.lookup([digest]).collect()) == [2, 4]


def test_repair_of_false_hits_reads_all_runs(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda column, bits: F.lit("00" * 32))  # every text has the same digest
    monkeypatch.setattr(exact_dedup, "_digest", lambda normal: b"\0" * 32)
    index = exact_dedup.MergeIndex(docs.sparkSession)
    index.flush(docs.where("row < 8"))
    index.flush(docs.where("row >= 8"))
    got = exact_dedup.verdicts(index).collect()
    texts = ["".join((t or "").split()) for _, t, _ in ROWS]
    assert sorted(r["group_size"] for r in got) == sorted(texts.count(t) for t in texts)
    assert sum(r["kept"] for r in got) == len(set(texts))


def test_byte_bpe(docs, none):
    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    got = sorted(byte_bpe.encode_texts(docs, path, P.PATTERN).collect(), key=str)
    want = sorted((i, len(ids := enc.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in ROWS if i is not None)
    assert sorted(tuple(r)[:4] for r in got if r["doc_id"] is not None) == want
    codec = byte_bpe.codec(path, P.PATTERN)
    for _ in range(400):
        s = "".join(RND.choice("  \n\tabcdeéüß漢字 ’'sLL012...--😀") for _ in range(RND.randrange(50)))
        assert list(array("I", codec.encode(s))) == enc.encode_ordinary(s) and codec.decode(codec.encode(s), 3) == s
    s = "ab" * 2000 + "q" * 500
    assert list(array("I", codec.encode(s))) == enc.encode_ordinary(s)
    stream, raw = byte_bpe.Utf8Stream(), "aé漢😀".encode() + b"\xff\xe2\x82"
    assert "".join(stream.feed(raw[k : k + 1]) for k in range(len(raw))) + stream.feed(b"", True) == raw.decode("utf-8", "replace")
    assert byte_bpe.encode_texts(none, path, P.PATTERN).count() == 0


def test_byte_bpe_cuts_and_bounds(monkeypatch):
    own = {bytes((b,)): b for b in range(256)} | {b"\n ": 256, b" \n": 257}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own, special_tokens={})
    codec = byte_bpe.Codec(own, P.PATTERN)
    for s in ["x\n \ny", "x\n ", " \nx", "a   b", "a  b", "", " ", "\n \n", "a \u3000 b"]:
        assert list(array("I", codec.encode(s))) == enc.encode_ordinary(s), s
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for name in ["STATES", "PAIRS", "TOKENS", "CACHE"]:
        monkeypatch.setattr(byte_bpe, name, 25)
    codec = byte_bpe.Codec(ranks, P.PATTERN)
    for _ in range(150):
        s = "".join(RND.choice("abcdefgh éß漢 '12-") for _ in range(200))
        assert list(array("I", codec.encode(s))) == enc.encode_ordinary(s)
    assert max(len(codec), len(codec.old), len(codec.tokens), len(codec.machine.states), len(codec.machine.good)) <= 26


def test_packing(docs, none):
    path = P.path("word_bpe_49k.json")
    got = packing.pack(docs, path).toPandas()
    tokenizer = Tokenizer.from_file(path)
    want = sorted(zlib.crc32(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for _, t, _ in ROWS)
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in ROWS)
    assert got["length"].sum() == total
    whole = got[got["length"] == got["doc_tokens"]]
    assert set(whole["ids_crc32"]) <= set(want)
    place = got.sort_values(["sequence_id", "offset"])
    ends = (place["offset"] + place["length"]).groupby(place["sequence_id"]).shift(1).fillna(0)
    assert (place["offset"] == ends).all()
    sizes = place.groupby("sequence_id")["length"].sum()
    assert (sizes.iloc[:-1] == 4096).all() and len(sizes) == -(-total // 4096)
    assert packing.pack(none, path).count() == 0


def test_packing_ids_are_the_tokenizers():
    path = P.path("word_bpe_49k.json")
    own, tokenizer = packing.WordIds(path), Tokenizer.from_file(path)
    texts = ["a\x1cb", "a\x1fb", "\x1d", " \x1e x\x1c\x1c y ", "x <|endoftext|> y", "x<|startoftext|>É\x1cy<|endoftext|>", "x <|ENDOFTEXT|> y", "<|endoftext|>"]
    texts += [f"a{chr(c)}b {chr(c)} É{chr(c)}" for c in (*range(0x100), 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
    texts += ["".join(RND.choice(["a", "É", "e\u0301", "ΑΣ", "'s", "9", " ", "\u0301", "\x1c", "\x85", "<|endoftext|>", "<|", "漢", "."]) for _ in range(30)) for _ in range(300)]
    texts += ["".join(RND.choice([chr(c) for c in (*range(0x41, 0x7B), *range(0xC0, 0x100))] + [*".,!?;:'"]) for _ in range(RND.randint(1, 9))) for _ in range(3000)]
    texts += ["ÜBER, ﬁ ÿ. ß! Äx; ª µ º × ÷ a×b Ÿ \u0130 über\u0308 ü\u0301."]
    for s in texts:
        assert np.frombuffer(own.ids(s), own.type).tolist() == tokenizer.encode(s, add_special_tokens=False).ids, repr(s)


def _packed(spark, sizes, **options):
    """Pieces of documents of ten tokens by source, after checks that they hold every token once and fill the windows."""
    rows = [(k, "one two three four five six seven eight nine", s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), P.path("word_bpe_49k.json"), 100, **options).toPandas()
    got["source"] = got["doc_id"].map({k: s for k, _, s in rows})
    place = got.sort_values(["sequence_id", "offset"])
    assert (place["sequence_id"] * 100 + place["offset"]).tolist() == [0, *place["length"].cumsum()[:-1]]
    ids = np.array([*Tokenizer.from_file(P.path("word_bpe_49k.json")).encode(rows[0][1], add_special_tokens=False).ids, 2], "<u4")
    assert len(ids) == 10 and all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(got["start"], got["length"], got["ids_crc32"]))
    for _, g in got.groupby("doc_id"):
        g = g.sort_values("start")
        assert g["start"].tolist() == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() == 10
    return got


def test_packing_carries_deficits(spark):
    sizes = {"hot": 2000, "low": 8, "mid": 28}  # of 100 tokens: 98.2, 0.39 and 1.4
    got = _packed(spark, sizes)
    sent = got.groupby(["source", "sequence_id"])["length"].sum()
    for s, n in sizes.items():
        have = sent[s].reindex(range(-(-2036 * 10 // 100)), fill_value=0).cumsum()
        # a queue is less than a document off its credit; the hot one also takes what the others leave
        assert (abs(have - (have.index + 1) * 100 * n / 2036)[:-1] <= (21 if s == "hot" else 11)).all(), s
    # whole documents: cuts at the edges of windows alone
    cut = got[got["length"] < got["doc_tokens"]]
    assert ((cut["offset"] == 0) | (cut["offset"] + cut["length"] == 100)).all() and len(got) <= 2036 + 204


def test_packing_many_sources_and_targets(spark):
    sizes = {f"s{k:03d}": 3 for k in range(150)} | {"hot": 450}
    got = _packed(spark, sizes)
    assert set(got["source"]) == set(sizes) and len(got) <= 900 + 90
    hot = got[got["source"] == "hot"].groupby("sequence_id")["length"].sum()
    assert len(hot) == 90 and hot.between(40, 60).all()
    for sizes in ({"a": 60, "b": 60, "c": 10}, {f"s{k:03d}": 1 for k in range(70)} | {"a": 60, "b": 60}):
        got = _packed(spark, sizes, targets={"a": 0.75, "b": 0.25})
        sent = got[got["sequence_id"] < 7].groupby(["sequence_id", "source"])["length"].sum().unstack(fill_value=0)
        # within a document at either edge of a window, and over all seven within a document
        assert set(sent.columns) == {"a", "b"} and sent["a"].between(60, 90).all() and abs(sent["a"].sum() - 525) <= 10, sizes


def test_packing_against_rounds_played_out(spark):
    """The closed form against queues that are credited round by round and send what is due."""
    rng = np.random.default_rng(5)
    for unit in (7, 40):
        rows, queues = [], {}
        for k in range(300):
            s, n = "abcdefg"[min(6, int(rng.exponential(1.5)))], int(rng.integers(0, 60))
            rows.append((k, "one " * n, s))
            queues.setdefault(s, []).append((k, n + 1))
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
        got = packing.pack(docs, P.path("word_bpe_49k.json"), 64, unit=unit).orderBy("sequence_id", "offset").collect()
        total = {s: sum(n for _, n in q) for s, q in queues.items()}
        order = sorted(queues, key=lambda s: (total[s], s))
        stream, left = [], {s: [] for s in queues}
        for s, q in queues.items():
            phase, ahead = (packing.STEPS[1] / 2 + order.index(s) * packing.STEPS[0]) % 1.0, 0
            for k, n in q:
                parts = -(-n // unit)
                for i in range(parts):
                    lo, hi = i * n // parts, (i + 1) * n // parts
                    left[s].append((ahead + lo + phase * (hi - lo), k, lo, hi))
                ahead += n
            left[s].append((float("inf"), None, 0, 0))
            queues[s] = total[s] / sum(total.values()) * 64
        for r in range(-(-sum(total.values()) // 64) + 1):
            for s in sorted(queues):
                while left[s][0][0] < (r + 1) * queues[s]:
                    _, k, lo, hi = left[s].pop(0)
                    stream += [(k, t) for t in range(lo, hi)]
        assert [(r["doc_id"], r["start"] + t) for r in got for t in range(r["length"])] == stream
        assert all(r["sequence_id"] * 64 + r["offset"] == stream.index((r["doc_id"], r["start"])) for r in got)


def test_sharding(docs, none):
    got = sharding.shard_by_splitters(docs).toPandas()
    assert len(got) == len(ROWS) and set(got["law"]) == {"bytes"}
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert sorted(got["size"]) == sorted(len((t or "").encode()) + 1 for _, t, _ in ROWS)
    assert sharding.shard_by_splitters(none).count() == 0


def _law(rows, got, shards=8):
    """What the law `bytes` asks of (doc_id, text) rows: every row once, near equal bytes, gapless slots, equal texts alike in crc32."""
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    have = sorted((str(None if i != i or i is None else int(i)), int(n), int(c)) for i, n, c in zip(got["doc_id"], got["size"], got["text_crc32"]))
    assert have == want and set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()
    sums = got.groupby("shard")["size"].sum().reindex(range(shards), fill_value=0)
    assert sums.max() - sums.min() <= 2 * got["size"].max() and set(got["shard"]) <= set(range(shards))
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_sharding_keeps_its_law(spark, docs):
    rnd = random.Random(3)
    rows = [(k, None if k % 3 else " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(40)))) for k in range(3000)] + [(5, "same row")] * 500 + [(9999, "long " * 2000)]
    _law(rows, sharding.shard_by_splitters(spark.createDataFrame(rows, "doc_id long, text string")).toPandas())
    _law([(i, t) for i, t, _ in ROWS], sharding.shard_by_splitters(docs).toPandas())


def test_sharding_divides_hot_groups(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(sharding, "keep", lambda df, name, **options: kept.setdefault(name, keep(df, name, **options)))
    rows = spark.range(60_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 > 0 THEN NULL ELSE concat('text of some length ', id) END AS text")
    rows = rows.union(spark.range(20_000).selectExpr("7L AS doc_id", "'one and the same row' AS text"))
    got = sharding.shard_by_splitters(rows)
    assert got.groupBy("shard").agg(F.sum("size").alias("b")).agg(F.max("b") - F.min("b")).first()[0] <= 60
    even = 80_000 / 512
    assert kept["placed"].groupBy("range").count().agg(F.max("count")).first()[0] <= 3 * even


def test_class_lm(docs, none):
    held = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    got = class_lm.score_documents(docs, held).toPandas()
    assert len(got) == len(ROWS) and (got["train_tokens"] == sum(len(words(t)) + 1 for i, t, _ in ROWS if i is None or i % 3)).all()
    assert (got["n_tokens"] >= 1).all() and np.isfinite(got["score"]).all()
    assert class_lm.score_documents(none, held).count() == 0
    assert len(class_lm.score_documents(docs, F.lit(True)).collect()) == len(ROWS)


def test_probabilities_add_up():
    counts = np.random.default_rng(0).integers(0, 20, (2, 6, 6))
    logs = class_lm.transition_logs(counts, 5)
    assert (10**logs).sum(axis=1) == pytest.approx(np.ones(6), abs=1e-6)


def test_exchange_raises_the_likelihood():
    n = np.random.default_rng(3).integers(0, 30, (40, 40)).astype(float)
    n[:20, 20:] *= 6

    def value(c):
        m = np.eye(4)[c].T @ n @ np.eye(4)[c]
        f = class_lm._xlogx
        return f(m).sum() - f(m.sum(axis=0)).sum() - f(m.sum(axis=1)).sum()

    c = class_lm.exchange(n, 4)
    assert value(c) > value(np.arange(40) % 4) and set(c) <= set(range(4))
    best = [max(value(np.r_[c[:w], k, c[w + 1 :]]) for k in range(4)) for w in range(40)]
    assert max(best) <= value(c) + 1e-6  # no single word can move for the better


def test_exchange_goes_on_until_none_moves():
    n = np.random.default_rng(5).poisson(1.0, (200, 200)).astype(float)
    f = class_lm._xlogx

    def value(c):
        m = np.eye(8)[c].T @ n @ np.eye(8)[c]
        return f(m).sum() - f(m.sum(axis=0)).sum() - f(m.sum(axis=1)).sum()

    c = class_lm.exchange(n, 8)
    assert max(value(np.r_[c[:w], k, c[w + 1 :]]) for w in range(200) for k in range(8)) <= value(c) + 1e-6


def _vocabulary(spark, monkeypatch, rows, **options):
    kept = {}
    monkeypatch.setattr(class_lm, "keep", lambda df, name, **o: kept.setdefault(name, keep(df, name, **o)) if name == "vocabulary" else keep(df, name, **o))
    class_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False), **options).count()
    names = sorted({w for _, t in rows for w in t.split()})
    hashed = class_lm._sequence(class_lm.strings(class_lm.pa.array(names)))[0][::2].view(np.int64).tolist()
    cls = {r["word"]: (r["cls"], r["n"]) for r in kept["vocabulary"].collect()}
    return {name: cls[h] for name, h in zip(names, hashed)}


def test_words_without_neighbours_have_a_class(spark, monkeypatch):
    rows = [(k, "a b a b") for k in range(9)] + [(20, "a c"), (21, "lonely"), (22, "forlorn")]
    got = {w: c for w, (c, _) in _vocabulary(spark, monkeypatch, rows, k=3, classes=4).items()}
    assert got["lonely"] == got["forlorn"] == 2 * 4 + 1 and 4 <= got["c"] < 8 and max(got["a"], got["b"]) < 4


def test_rounds_class_words_by_all_their_neighbours(spark, monkeypatch):
    """Words without a frequent neighbour get the class of the words that stand where they stand."""
    rnd = random.Random(12)
    left, right = [f"l{k}" for k in range(40)], [f"r{k}" for k in range(40)]
    rows = [(k, " ".join(f"{rnd.choice(left)} {rnd.choice(right)}" for _ in range(20))) for k in range(120)]
    rows += [(1000 + k, f"{rnd.choice(left)} odd{k % 5} {rnd.choice(left)} odd{k % 5} {rnd.choice(left)}") for k in range(40)]
    got = _vocabulary(spark, monkeypatch, rows, k=12, classes=2, rounds=3, block=3000)
    rare = {w: c for w, (c, _) in got.items() if c >= 2}
    assert len({c for w, c in rare.items() if w[0] == "l"}) == 1 and len({c for w, c in rare.items() if w[0] in "ro"}) == 1
    assert len(set(rare.values())) == 2 and len(rare) > 60


def test_base_scores_against_a_plain_count(docs, spark):
    from collections import Counter
    from math import log10

    held = lambda i: i is not None and i % 3 == 0
    lower = lambda t: (t or "").encode().lower().split()  # noqa: E731  (bytes: A-Z and ASCII blanks alone)
    counts = Counter(w for i, t, _ in ROWS if not held(i) for w in [*lower(t), None])
    total, distinct = sum(counts.values()), len(counts)
    for block in (1 << 20, 500):
        got = class_lm.score_documents(docs, F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False)), block=block).collect()
        want = sorted((str(i), held(i), len(lower(t)) + 1, sum(counts[w] > 0 for w in [*lower(t), None]), total, round(sum(log10((counts[w] + 1) / (total + distinct + 1)) for w in [*lower(t), None]), 6)) for i, t, _ in ROWS)
        assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want


def test_class_model_beats_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = class_lm.score_documents(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2).where("held_out and n_tokens > 20").toPandas()
    assert got["score"].sum() > got["base_score"].sum() and (got["score"] > got["base_score"]).mean() > 0.8


def _brute_classes(rows):
    """n_links and class_id by every pair of sets; rows of (doc_id, text)."""
    sets = {}
    for i, t in rows:
        w = words(t)
        if w:
            sets.setdefault(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))), []).append(i)
    keys = list(sets)
    links, root = [0] * len(keys), list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            if 5 * len(keys[a] & keys[b]) >= 4 * len(keys[a] | keys[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, s in enumerate(keys):
        least[find(k)] = min(least.get(find(k), 1 << 60), *sets[s])
    return {i: (links[k], least[find(k)], min(sets[s]), len(sets[s])) for k, s in enumerate(keys) for i in sets[s]}


def test_components():
    assert ngram_join._ranked(np.array([30, 10, 20, 5]), np.array([0]), np.array([2])).tolist() == [2, 1, 2, 3]


def test_components_of_chains_stars_and_loops(spark):
    rnd = random.Random(1)
    name = [rnd.getrandbits(60) for _ in range(400)]
    pairs = [(k, k + 1) for k in range(120)] + [(200, k) for k in range(201, 300)] + [(300, 301), (301, 302), (302, 300), (310, 310)]
    got = {r["node"]: r["root"] for r in ngram_join.components(spark.createDataFrame([(name[a], name[b]) for a, b in pairs], "a long, b long")).collect()}
    for group in (range(121), range(200, 300), range(300, 303)):
        assert {got[name[k]] for k in group} == {min(name[k] for k in group)}
    assert len(got) == 121 + 100 + 3
    assert ngram_join.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_groups_of_near_copies(spark):
    base = [RND.choice(WORDS) for _ in range(150)]
    rows = [(k, " ".join([*base[:100], f"n{k}", *base[101:]])) for k in range(700)]
    got = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert set(got["class_id"]) == {0} and set(got["n_links"]) == {699}


def test_large_component_that_its_hub_does_not_settle(spark):
    rnd = random.Random(8)
    base, rows = [rnd.choice(WORDS) for _ in range(200)], []
    for k in range(160):  # chains of edits: neighbours are linked, ends are not
        if k % 40 == 0:
            own = list(base)
        for _ in range(rnd.randrange(1, 4)):
            own[rnd.randrange(len(own))] = rnd.choice(WORDS)
        rows.append((k, " ".join(own)))
    rows += [(1000 + k, rows[k][1]) for k in range(0, 160, 7)]
    rows += [(2000, rows[3][1]), (2000, rows[3][1])]
    want = _brute_classes(rows)
    for chunk in (16, 256):  # in blocks of a large component, and as one
        got = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r["n_links"], r["class_id"], r["rep_id"], r["n_copies"]) == want[r["doc_id"]]


def test_near_copies_cost_linear_work(spark, monkeypatch):
    """5,000 near copies: no table that the join writes has more rows than a few a node."""
    written = {}

    def counted(df, name, **options):
        out = keep(df, name, **options)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(ngram_join, "keep", counted)
    base = [RND.choice(WORDS) for _ in range(120)]
    rows = [(k, " ".join([*base[: k % 100], f"n{k}", *base[k % 100 + 1 :]])) for k in range(5000)]
    got = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert set(got["class_id"]) == {0} and set(got["n_links"]) == {4999}
    assert max(written.values()) <= 3 * 5000, written


def test_bayesian_bounds_keep_pairs_at_the_threshold():
    least = ngram_join.least_matches()
    assert (np.diff(least) > 0).all() and least[0] < 0.6 * 16


def test_curve_search(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[30:60] = x[30]
    rows = [(k, [float(v) for v in x[k]]) for k in range(400)] + [(400, None), (420, [0.0] * 16), (440, [float("nan")] * 16), (460, [1.0, None] + [0.0] * 14), (None, [1.0] * 16)]
    got = curve_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).toPandas()
    hits = 0
    for q in range(0, 400, 20):
        s = (x.astype(float) * x[q].astype(float)).sum(axis=1)
        s[q] = -np.inf
        g = got[got["query_id"] == q].sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and np.array_equal(g["score"], s[g["vec_id"]])
        hits += len(set(np.lexsort((np.arange(400), -s))[:20]) & set(g["vec_id"]))
    assert hits >= 0.9 * 400 and set(got["query_id"]) == set(range(0, 400, 20))
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>")
    assert curve_search.search(few, F.col("vec_id") % 20 == 0).count() == 4
    assert curve_search.search(few.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_hilbert_is_a_path():
    grid = np.array([(a, b) for a in range(16) for b in range(16)])
    order = np.argsort(curve_search.hilbert(grid, 4))
    assert (abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def test_toxicity(docs, none):
    train = [(f"you are a dreadful{k % 3} fool. {plain(20)}", 1) for k in range(60)] + [(plain(25), 0) for _ in range(200)]
    got = toxicity.score_toxicity(docs, train).toPandas()
    assert got["score"].between(0, 1).all() and len(got) == len(ROWS)
    grammar = toxicity.Grammar(frozenset({"fool"}), frozenset())
    assert grammar.classes("you are a fool. fine")[4] == 1 and grammar.classes("he said you are not a fool")[7] == 1 and grammar.classes("fine")[0] == 0
    assert grammar.classes("no you fool. they kill him")[[5, 12]].tolist() == [1, 1] and grammar.classes("not one two three four fool")[0] == 1
    assert toxicity.score_toxicity(none, train).count() == 0 and toxicity.score_toxicity(docs, []).count() == len(ROWS)


def _clause(words, insults):
    """The classes of one clause, spelled out: kinds by target, report and negation."""
    target, report = any(w in toxicity.TARGETS for w in words), any(w in toxicity.REPORTS for w in words)
    out = set()
    for kind, lexicon in ((0, insults), (1, toxicity.THREATS)):
        seen = [any(x in toxicity.NEGATIONS for x in words[max(0, k - toxicity.REACH) : k]) for k, w in enumerate(words) if w in lexicon]
        if seen:
            out.add(8 * kind + 4 * target + 2 * report + all(seen))
    return out


def test_cascade_against_clauses_spelled_out():
    rnd = random.Random(2)
    insults = frozenset({"fool", "trash"})
    pool = ["fool", "trash", "you", "he", "not", "never", "said", "kill", "stab", "one", "two", "three", "four"]
    grammar = toxicity.Grammar(insults, frozenset())
    for _ in range(300):
        clauses = [[rnd.choice(pool) for _ in range(rnd.randrange(1, 9))] for _ in range(rnd.randrange(1, 5))]
        want = np.zeros(toxicity.Grammar.CLASSES)
        for c in clauses:
            for k in _clause(c, insults):
                want[k] += 1
        assert grammar.classes(". ".join(" ".join(c) for c in clauses)).tolist() == want.tolist()
    assert 1 < len(grammar.machine.states) < 200  # made as they were met


def test_toxicity_labels_and_split(spark, monkeypatch, tmp_path):
    """Held-out labels, lang, source and doc_id change no score."""
    rnd = random.Random(6)
    rows = [(k, (f"you are a dreadful fool. " if k % 4 == 0 else "") + " ".join(rnd.choice(WORDS) for _ in range(12)), "en", "s", int(k % 4 == 0)) for k in range(300)] + [(None, "x", "en", "s", 1)]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 0

    def run(name, rows):
        d = tmp_path / name
        spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(r[0], 1, r[4]) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        return {r["doc_id"]: r for r in toxicity.op2_toxicity(spark, str(d)).collect()}

    a = run("a", rows)
    b = run("b", [(i, t, "fr", "other", 1 - y if held(i) else y) for i, t, _, _, y in rows])
    assert len(a) == len(rows) and all(a[i]["score"] == b[i]["score"] and a[i]["held_out"] == held(i) for i in a)
    assert all(a[r[0]]["predicted"] == r[4] for r in rows if r[0] is not None)


def test_quality(docs, none):
    train = [(plain(40), 1) for _ in range(80)] + [("%%% ### " + " ### ".join(RND.choice(WORDS) for _ in range(20)), 0) for _ in range(40)]
    model = quality.train(train)
    scorer = quality.Scorer(model)
    assert scorer.score(plain(30)) > 0.7 > scorer.score("w1 ### w2 ### w3 ### %%%")
    got = quality.score_quality(docs, model)
    assert got.where("score between 0 and 1").count() == len(ROWS) and quality.score_quality(none, model).count() == 0
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.score_quality(docs, quality.train([])).where("score = 0.5").count() == len(ROWS)


def test_pipeline_stages_on_awkward_rows(spark, docs, none, tmp_path, monkeypatch):
    import corpus_pipeline
    from fieldloom.llm import common

    spark.createDataFrame([(k, k % 2, 0) for k in range(1, 15)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, none):
            out = stage(spark, rows, str(tmp_path))
            assert name == "packing" or out.columns == docs.columns
            n = out.count()
            assert n == 0 if rows is none else name == "quality" or n > 0
    monkeypatch.setattr(common.tempfile, "mkdtemp", lambda **_: pytest.fail("a local folder"))

    class Cluster:
        conf, sparkContext = type("C", (), {"get": staticmethod(lambda *_: None)}), type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        common.scratch(Cluster, "x")


def _drop_by_brute_force(rows):
    """What stays of (doc_id, text) rows after exact, near and substring dedup: doc_id -> text."""
    squash = lambda t: "".join(chr(c) for c in map(ord, t) if c not in (9, 10, 11, 12, 13, 32))
    groups = {}
    for i, t in rows:
        groups.setdefault(squash(t), []).append((-len(t), i, t))
    left = sorted((i, t) for g in groups.values() for _, i, t in [min(g)])
    near = _brute_classes(left)
    left = [(i, t) for i, t in left if i not in near or near[i][1] == i]
    first = {}
    for i, t in left:
        w = words(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    out = {}
    for i, t in left:
        w = words(t)
        gone = {k + x for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for x in range(50)}
        if not gone:
            out[i] = t
        elif len(gone) < len(w):
            out[i] = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
    return out


def test_pipeline_against_brute_force(spark):
    """All stages after the learnt one, on real rows."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = _drop_by_brute_force([(r["doc_id"], r["text"] or "") for r in docs.collect()])
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = keep(stage(spark, docs, ""), name)
    assert {r["doc_id"]: r["text"] or "" for r in docs.collect()} == want


def test_a_text_above_the_size_of_a_piece(spark):
    rnd = random.Random(21)
    long = " ".join(f"w{rnd.randrange(40_000)}" for _ in range(420_000))  # above 2 MB
    assert len(long) > 2 << 20
    rows = spark.createDataFrame([(1, long), (2, "short text of a few words"), (3, long[: len(long) // 2] + " tail")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(rows).collect()}
    assert got[1]["n_removed"] == 0 and got[3]["n_words"] - got[3]["n_removed"] <= 2
    assert {r["doc_id"]: r["class_id"] for r in ngram_join.jaccard_classes(rows).collect()} == {1: 1, 2: 2, 3: 3}
    assert {r["doc_id"]: r["n_tokens"] for r in class_lm.score_documents(rows, F.lit(False)).collect()} == {1: 420_001, 2: 7, 3: got[3]["n_words"] + 1}
    assert sorted(r["size"] for r in sharding.shard_by_splitters(rows).collect())[-1] == len(long) + 1


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        docs = keep(stage(spark, docs, sf), name)
        if name != names[-1]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    after = {n: {r["doc_id"]: r["text"] for r in d.collect()} for n, d in seen.items()}
    exact = after["near_dedup"]
    squash = lambda t: "".join((t or "").split())
    assert len({squash(t) for t in exact.values()}) == len(exact) == len({squash(t) for t in after["exact_dedup"].values()})
    assert set(after["substring_dedup"]) <= set(exact)
    assert docs.agg(F.sum("length")).first()[0] == docs.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]


def test_quality_words_and_generations():
    import zlib

    for word in ["a", "abc", "é漢x", "😀", "longer-word"]:
        raw = f"<{word}>"
        plain = [zlib.crc32(raw.encode(), 7)] + [zlib.crc32(raw[i : i + n].encode()) for n in (2, 3, 4) for i in range(len(raw) - n + 1)]
        assert quality.features(word) == [h % quality.BUCKETS for h in plain]
    model = quality.Model(np.random.default_rng(0).normal(size=quality.BUCKETS).astype(np.float32), 0.1, 0.5)
    small, large = quality.Scorer(model, 100_050), quality.Scorer(model)
    for _ in range(60):
        s = " ".join("".join(RND.choice("abé漢") for _ in range(RND.randint(1, 4))) for _ in range(RND.randint(0, 80)))
        assert abs(small.score(s) - large.score(s)) < 1e-9
    assert small.old[0] and len(small) < len(large)
