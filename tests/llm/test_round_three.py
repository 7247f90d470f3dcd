"""Lexicon BPE, hard negatives and fill-in-the-middle against the library and brute force."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldloom.llm import class_lm, curve_search, fill_middle, hard_negatives, lexicon_bpe, quality, substring_dedup
from fieldloom.llm.common import keep

RND = random.Random(8)
PATH = P.path("byte_bpe_50k.json")
ODD = [" ", "  ", "\n", "\t", " ", " ", "　", "\u0085", "\x1c", "᠎", "é", "漢", "я", "😀", "՘", "࢏", "'s", "'", "12", "<|endoftext|>", "<|endo", "the", "walking", "Straße", "!!", "́"]
TEXTS = ["", None, " ", "a  b", "x " * 3000, "the walking the talking " * 40, "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "q" * 5000, "漢字 " * 50, "line\nline\r\n\n  end \n"] + ["".join(RND.choice(ODD) for _ in range(RND.randrange(1, 60))) for _ in range(300)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x", 1) for k, t in enumerate(TEXTS)] + [(None, "lost row", "x", 1), (3, "a  b", "x", 1), (3, "a  b", "x", 1)]
    return keep(spark.createDataFrame(rows, "doc_id long, text string, ids string, n long"), "fixture").repartition(3)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.mark.parametrize("one_in", [1, 300, 10**9])
def test_lexicon_bpe(docs, one_in):
    """None, some, or all of the words in the lexicon: the same ids, those of the library."""
    tok = Tokenizer.from_file(PATH)
    got = lexicon_bpe.encode_texts(docs, PATH, one_in=one_in)
    want = []
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)), ids))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert lexicon_bpe.encode_texts(docs.where("false"), PATH).count() == 0


def test_frequent_words_are_bounded(docs):
    words = lexicon_bpe.frequent_words(docs, 300)
    assert 0 < len(words) <= 300 and " walking" in words
    assert all(w.startswith(" ") and len(w.encode()) <= lexicon_bpe.LONGEST for w in words)


def test_lexicon_shares_endings():
    stems, ends = [f"st{k}" for k in range(40)], ["", "s", "ing", "ings", "ed"]
    words = {(a + b).encode(): (k, *([7] if b[:3] == "ing" else []), *([9] if b else [])) for k, a in enumerate(stems) for b in ends}
    build = lexicon_bpe.Builder()
    for w in sorted(words):
        build.add(w, words[w])
    packed = build.pack()
    # one end state and the endings once, whatever the number of stems; ids leave where they are certain
    assert len(build.states) < 2 * len(stems)
    own = lexicon_bpe.Lexicon(packed)
    keys = [*words, b"st", b"st4x", b"st1ingsx", b"", b"zz", b"q" * 99]
    data = np.frombuffer(b"".join(keys), np.uint8)
    end = np.cumsum([len(k) for k in keys])
    known, count, ids = own.walk(data, end - [len(k) for k in keys], end)
    assert known.tolist() == [k in words for k in keys]
    assert count.tolist() == [len(words.get(k, ())) for k in keys]
    assert ids.tolist() == [i for k in keys for i in words.get(k, ())]
    with pytest.raises(ValueError):
        build.add(b"a", (1,))


def test_merging_a_long_piece():
    vocabulary = lexicon_bpe.Vocabulary(PATH)
    texts = ["".join(RND.choice("abcdeinorst") for _ in range(n)) for n in (20_000, 101, 100, 99, 2, 1)]
    got = [np.frombuffer(b, np.int32).tolist() for b in vocabulary.words(texts)]
    assert got == [t.ids for t in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(lexicon_bpe, "CACHE", 50)
    vocabulary = lexicon_bpe.Vocabulary(PATH)
    own, tok = lexicon_bpe.Codec(vocabulary, lexicon_bpe.Lexicon(lexicon_bpe.compiled(vocabulary, []))), Tokenizer.from_file(PATH)
    for k in range(20):
        texts = [" ".join(f"wörd{RND.randrange(300)}, x{j}" for _ in range(20)) for j in range(3)]
        ids, first = own.encode(pa.array(texts, pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [t.ids for t in tok.encode_batch(texts, add_special_tokens=False)]
        assert len(own.seen) < 50 + 200 and len(vocabulary.pieces) < 50 + 200


def test_strassen():
    for m, k, n in [(1, 1, 1), (70, 64, 130), (33, 100, 65), (0, 5, 3), (129, 0, 7)]:
        a, b = (np.array([[RND.randrange(-(1 << 28), 1 << 28) for _ in range(c)] for _ in range(r)], np.int64).reshape(r, c) for r, c in ((m, k), (k, n)))
        assert (hard_negatives.product(a, b, leaf=8) == a @ b).all()


def test_heaps_merge_in_any_cut():
    rows = sorted((RND.randrange(1000), RND.randrange(9), RND.randrange(20)) for _ in range(500))  # id, owner, score
    whole, cut = hard_negatives.Heaps(9, 4), hard_negatives.Heaps(9, 4)
    columns = lambda part: tuple(np.array([r[k] for r in part]) for k in (1, 2, 0))
    whole.merge(*columns(rows))
    for k in range(0, 500, 37):
        cut.merge(*columns(rows[k : k + 37]))
    assert all((getattr(whole, c) == getattr(cut, c)).all() for c in ("owner", "score", "id", "bar"))


def _brute_negatives(rows):
    by = {}
    for i, label, v in rows:
        if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * x) for x in v]
            by.setdefault(i, []).append((label, q))
    rows = {i: min(r) for i, r in by.items()}
    out = []
    for a, (label, v) in rows.items():
        if a % 100 == 0:
            score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in rows.items() if i != a}
            first = lambda ids: sorted(ids, key=lambda i: (-score[i], i))[:5]
            for p in first(i for i in score if rows[i][0] == label):
                window = [i for i in score if rows[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
                out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(first(window), 1)]
    return sorted(out)


@pytest.mark.parametrize("strips", [(4096, 16384), (3, 50)])
def test_hard_negatives(spark, monkeypatch, strips):
    """Repeated identifiers, nulls, short and empty vectors, a third of all rows with one vector, cells of many sizes."""
    monkeypatch.setattr(hard_negatives, "ANCHORS", strips[0])
    monkeypatch.setattr(hard_negatives, "CANDIDATES", strips[1])
    monkeypatch.setattr(hard_negatives, "TILE", (2, 16))
    vec = lambda n=6: [RND.gauss(0, 0.4) for _ in range(n)]
    hot = vec()
    rows = [(i * 10, RND.randrange(3), hot if RND.random() < 0.33 else vec()) for i in range(-20, 150)]
    rows += [(i, i % 3, vec(4)) for i in range(1, 60, 9)] + [(500, 1, vec()), (500, 0, vec()), (500, 0, hot), (500, 0, hot)]
    rows += [(None, 1, vec()), (7, None, vec()), (8, 1, None), (9, 1, [0.1, None]), (11, 1, [float("nan")] * 6), (12, 1, [float("inf")] * 6), (13, 1, []), (2900, 0, []), (3000, 99, vec())]
    x = spark.createDataFrame([(*r, 1, "i") for r in rows], "vec_id long, label int, embedding array<float>, v int, i string")
    single = [(i, label, v and [None if y is None else float(np.float32(y)) for y in v]) for i, label, v in rows]
    got = sorted(tuple(r) for r in hard_negatives.mine(x.repartition(5)).collect())
    assert got == _brute_negatives(single) and len(got) > 100
    assert hard_negatives.mine(x.where("false")).collect() == []
    assert hard_negatives.mine(x.where("vec_id <> 0 and vec_id % 100 <> 0")).collect() == []


def test_too_long_vectors_take_no_part(spark):
    rows = [(0, 1, [1.0]), (1, 1, [1e30]), (2, 1, [2.0]), (3, 2, [1.9]), (4, 2, [-1e300])]
    got = hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    assert [(r.positive_id, r.negative_id) for r in got] == [(2, 3)]


def _brute_middle(doc_id, text, unit, changed, spm):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    h = [int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= changed:
        return doc_id, n, "plain", None, None, sha(text), sha(text), text
    form = "spm" if h[3] % 100 < spm else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(text), out


@pytest.mark.parametrize("unit, changed, spm", [("line", 100, 50), ("char", 100, 50), ("line", 40, 90), ("char", 100, 0)])
def test_fill_in_middle(spark, docs, unit, changed, spm):
    lines = ["", "\n", "a\n", "é😀\n", "<P", "S>\n", "<", ">", "漢字 x", "<M>\n", "b\r\n"]
    rows = [(1000 + k, "".join(RND.choice(lines[:9]) for _ in range(RND.randrange(12)))) for k in range(200)] + [(2000 + k, "x<S>\n" * k) for k in range(3)] + [(None, None), (None, "a\nb"), (5000, "long é line\n" * 300_000)]
    x = docs.select("doc_id", "text", F.lit(1).alias("form")).unionByName(spark.createDataFrame([(*r, 2) for r in rows], "doc_id long, text string, form int"))
    got = fill_middle.fill_in_middle(x, fill_middle.Rule(unit=unit, changed=changed, spm=spm)).collect()
    want = [_brute_middle(r.doc_id, r.text, unit, changed, spm) for r in x.collect()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert fill_middle.fill_in_middle(x.where("false")).count() == 0
    with pytest.raises(ValueError):
        list(fill_middle.transform(pa.array(["a"], pa.large_string()), np.zeros((1, 4)), fill_middle.Rule(unit="page")))


def test_exceptions_convert_both_ways():
    text = "".join(RND.choice(["a", "é", "漢", "😀"]) for _ in range(500))
    index = fill_middle.Exceptions(np.frombuffer(text.encode(), np.uint8))
    at = np.arange(501)
    there = index.bytes(at)
    assert there.tolist() == [len(text[:k].encode()) for k in range(501)] and (index.chars(there) == at).all()
    assert len(fill_middle.Exceptions(np.frombuffer(b"plain" * 99, np.uint8)).byte) == 0


def test_curve_search_folds_repeated_identifiers(spark):
    """Every identifier thirty times, some with unlike vectors: each query has its k nearest among the rows that stay."""
    rng = np.random.default_rng(2)
    own = {i: rng.normal(size=8) for i in range(400)}
    rows = [(i, v.tolist()) for i, v in own.items() for _ in range(30)]
    for i in range(0, 400, 7):  # an unlike vector, of a smaller or a greater first component
        other = rng.normal(size=8)
        rows.append((i, other.tolist()))
        own[i] = min(own[i], other, key=lambda v: v.tolist())
    RND.shuffle(rows)
    x = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    got = {}
    for r in curve_search.search(x, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, 400, 20):
        scores = sorted(((-float((own[q] * own[i]).sum()), i) for i in own if i != q))[:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and len({m[1] for m in mine}) == 20
        assert all(m[2] == pytest.approx(float((own[q] * own[m[1]]).sum())) for m in mine)
        hits += len({i for _, i in scores} & {m[1] for m in mine})
    assert hits >= 0.9 * 20 * 20


def test_class_scores_do_not_depend_on_the_layout(spark, docs, monkeypatch):
    """The same scores for 1, 4 and 7 partitions and for blocks of one and of many texts, whether evidence is summed in parts or at once."""
    texts = [" ".join(RND.choice(["the", "a", f"w{RND.randrange(40)}", f"rare{RND.randrange(400)}"]) for _ in range(RND.randrange(60))) for _ in range(250)]
    x = keep(docs.select("doc_id", "text").where("doc_id <> 3").unionByName(spark.createDataFrame([(k + 1000, t) for k, t in enumerate(texts)], "doc_id long, text string")), "texts")
    held = F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False))
    scores = [{r.doc_id: r.score for r in class_lm.score_documents(x.repartition(n), held, k=20, classes=4, block=size).collect()} for n, size in ((1, 16 << 20), (4, 16 << 20), (7, 2000))]
    assert scores[0].keys() == scores[1].keys() and len(scores[0]) > 500
    assert all(s[i] == pytest.approx(v, rel=1e-12) for s in scores[1:] for i, v in scores[0].items())
    score = lambda size: {r.doc_id: r.score for r in class_lm.score_documents(x, held, k=20, classes=4, rounds=2, block=size).collect()}
    whole = score(1000)
    monkeypatch.setattr(class_lm, "FOLD", 5)
    parts = score(1000)
    assert whole.keys() == parts.keys() and all(parts[i] == pytest.approx(v, rel=1e-12) for i, v in whole.items())


def test_folded_evidence_holds_every_count():
    """Counts beyond 32 bits too."""
    rows = [(RND.randrange(5), RND.randrange(3), [(c, RND.randrange(1, 2**32)) for c in sorted(RND.sample(range(80), 6))]) for _ in range(60)]
    near = [np.array(e, class_lm._ENTRY).tobytes() for _, _, e in rows]
    got = class_lm._fold(pa.table([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array(near, pa.binary())], ["word", "cls", "near"]))
    want = {}
    for w, _, entries in rows:
        for c, n in entries:
            want[w, c] = want.get((w, c), 0) + n
    assert {(w, int(e["code"])): int(e["n"]) for w, b in zip(got["word"].to_pylist(), got["near"].to_pylist()) for e in np.frombuffer(b, class_lm._SUM)} == want
    assert dict(zip(got["word"].to_pylist(), got["cls"].to_pylist())) == {w: max(r[1] for r in rows if r[0] == w) for w, _ in want}
    assert max(want.values()) > 2**32


def test_substring_dedup_against_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS FROM '/root/testdata/sf0.001/documents.parquet'")
    got = substring_dedup.op1_substring_dedup(spark, "/root/testdata/sf0.001").select("doc_id", "n_words", "n_removed", "kept_sha256")
    want = con.sql(f"SELECT doc_id, n_words, n_removed, kept_sha256 FROM ({substring_dedup.ORACLE})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and sum(r[2] for r in want) > 1000


def test_quality_learns_from_training_labels_alone(spark, tmp_path):
    """Other labels of held-out rows change no score, other labels of training rows do; neither identifiers, languages nor sources enter."""
    table = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    docs, labels = table("documents"), table("labels")
    out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    flipped = lambda where: labels.withColumn("quality", F.when(where, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = []
    for k, (d, own) in enumerate([(docs, labels), (docs.withColumns({"lang": F.lit("xx"), "source": F.col("doc_id").cast("string")}), flipped(out)), (docs, flipped(~out))]):
        d.write.parquet(str(tmp_path / f"{k}" / "documents.parquet"))
        own.write.parquet(str(tmp_path / f"{k}" / "labels.parquet"))
        rows = quality.op6_quality(spark, str(tmp_path / f"{k}")).collect()
        assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
        assert {r["doc_id"] for r in rows if r["held_out"]} == {r["doc_id"] for r in docs.where(out).collect()}
        scores.append({r["doc_id"]: r["score"] for r in rows})
    assert scores[1] == pytest.approx(scores[0], abs=1e-9)
    assert max(abs(scores[2][i] - v) for i, v in scores[0].items()) > 0.5
