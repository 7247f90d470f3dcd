"""BPE encoding with a memory-mapped lexicon of frequent words (operator 11).

A word is a stretch of text from one space to the next, with the space before it, cut only where the
vocabulary's pattern cuts too. Spark counts the words of all texts; those that are at
least one in ``ONE_IN`` of all (so never more than ``ONE_IN`` words) are encoded on the driver and compiled, in sorted
order, into a minimal acyclic transducer: states that accept the same endings with the same outputs are one,
and ids leave on the earliest arc on which they are certain. The automaton is stored as a double array in one file that Spark hands to
every executor, where all Python workers map the same pages.

A task walks all words of some texts through the automaton side by side, one byte a step, in numpy. A word that
the automaton doesn't hold is cut by the vocabulary's own pattern and merged exactly, and remembered in a table of
bounded size. The lexicon only saves time: results don't depend on what it holds.

Null texts are empty: no ids. The special tokens' strings in a text become their ids, as the library has it. Repeated rows
give repeated rows, an empty table an empty result, null identifiers stay null; other columns play no part, whatever their names.
Very long texts are read whole, and a word of any length is merged in n log n steps.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK, keep, pieces, strings, table

#: A word is frequent if it is at least one in so many of all words; the longest word (in bytes) that the lexicon takes.
ONE_IN, LONGEST = 500_000, 64
#: Most unseen words, and most pieces of them, that a worker remembers; the longest piece that is merged together with others.
CACHE, DIRECT = 300_000, 100
#: What the vocabulary's pattern does to ASCII text, where letters, digits and blanks are beyond doubt.
_ASCII = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII).findall

# bytes that can end, and that can begin, a white-space character; 0x1C-0x1F are taken in to be safe
_ENDS_BLANK, _BEGINS_BLANK = np.zeros(256, bool), np.zeros(256, bool)
for _k in (*range(0x09, 0x0E), *range(0x1C, 0x21)):
    _ENDS_BLANK[_k] = _BEGINS_BLANK[_k] = True
_ENDS_BLANK[0x80:0xC0] = True
_BEGINS_BLANK[[0xC2, 0xE1, 0xE2, 0xE3]] = True


class Vocabulary:
    """A byte-level BPE file of the tokenizers library: exact merging of words, and the tokens' bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        if model["type"] != "BPE" or spec["normalizer"] or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
            raise ValueError("only byte-level BPE without a normaliser and with plain added tokens")
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str  # the file's own pattern; pieces come with a character for each byte
        self.special = {a["content"]: a["id"] for a in added}
        self.find_special = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if added else None
        # the printable characters that stand for bytes: themselves, or from U+0100 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        self.shown = {b: c for c, b in byte_of.items()}
        self.pieces: dict[str, bytes] = {}
        table: dict[int, bytes] = {i: bytes(byte_of[c] for c in t) for t, i in self.ids.items()}
        table |= {i: s.encode() for s, i in self.special.items()}
        self.bytes_of = [table.get(i, b"") for i in range(max(table, default=-1) + 1)]
        self.id_of_char = np.zeros(512, np.int32)
        for c in byte_of:
            self.id_of_char[ord(c)] = self.ids[c]
        self.merged = np.array([self.ids[a + b] for a, b in self.ranks], np.int32)
        keys = np.array([self.ids[a] * len(self.bytes_of) + self.ids[b] for a, b in self.ranks], np.int64)
        self.pair_ranks = np.argsort(keys)
        self.pair_keys = keys[self.pair_ranks]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of tokens; below 0 stands for no token."""
        key = left.astype(np.int64) * len(self.bytes_of) + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], len(self.ranks))

    def _merge_block(self, pieces: list[str]) -> Iterator[bytes]:
        """The ids of some pieces, all at once: a round merges in each of them the pair of the least rank, the leftmost of equals."""
        length = np.array([len(p) for p in pieces])
        columns, never = np.arange(length.max()), len(self.ranks)
        token = np.full((len(pieces), len(columns) + 1), -1, np.int32)
        token[:, :-1][columns < length[:, None]] = self.id_of_char[np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)]
        rank = np.append(self._rank(token[:, :-1], token[:, 1:]), np.full((len(pieces), 1), never), axis=1)  # the last two columns are no pairs
        rows = np.arange(len(pieces))
        while len(rows):
            t, r = token[rows], rank[rows]
            at = r.argmin(axis=1)
            k = np.arange(len(rows))
            least = r[k, at]
            go = least < never
            rows, t, r, at, least, k = rows[go], t[go], r[go], at[go], least[go], k[: go.sum()]
            t = np.append(np.where(columns > at[:, None], t[:, 1:], t[:, :-1]), t[:, -1:], axis=1)
            r = np.append(np.where(columns >= at[:, None], r[:, 1:], r[:, :-1]), r[:, -1:], axis=1)
            t[k, at] = self.merged[least]
            r[k, at] = self._rank(t[k, at], t[k, at + 1])
            left = at > 0
            r[k[left], at[left] - 1] = self._rank(t[k[left], at[left] - 1], t[k[left], at[left]])
            token[rows], rank[rows] = t, r
        count = 4 * (token >= 0).sum(axis=1)
        ends = np.cumsum(count)
        raw = token[token >= 0].tobytes()
        return (raw[a:b] for a, b in zip((ends - count).tolist(), ends.tolist()))

    def merge(self, pieces: list[str], block: int = 4096) -> dict[str, bytes]:
        """The ids of each piece, as bytes of 32-bit integers: of all neighbours that merge, those of the least rank are merged first, from the left."""
        short = sorted((p for p in pieces if len(p) <= DIRECT), key=len)
        out = {p: np.array(self._merge_long(p), np.int32).tobytes() for p in pieces if len(p) > DIRECT}
        for k in range(0, len(short), block):
            out.update(zip(short[k : k + block], self._merge_block(short[k : k + block])))
        return out

    def _merge_long(self, piece: str) -> list[int]:
        """A long piece by itself, by a heap of pairs."""
        parts: list[str | None] = list(piece)
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap = [(r, i) for i, pair in enumerate(zip(piece, piece[1:])) if (r := self.ranks.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            left = parts[i]
            j = after[i]
            if left is None or j >= len(parts) or self.ranks.get((left, parts[j])) != rank:
                continue  # one of the two has been merged since
            parts[i], parts[j] = left + parts[j], None
            after[i] = k = after[j]
            if k < len(parts):
                before[k] = i
                if (r := self.ranks.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := self.ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return [self.ids[p] for p in parts if p is not None]

    def words(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of 32-bit integers."""
        # an ASCII piece without blanks has one name in both kinds of pieces, and others can't be taken for one another
        cut = [_ASCII(t) if t.isascii() else [p for p, _ in self.cut(t)] for t in texts]
        new = {p for c in cut for p in c}.difference(self.pieces)
        names = {p: "".join(map(self.shown.__getitem__, p.encode())) if p.isascii() else p for p in new}
        merged = self.merge(list(set(names.values())))
        own = {p: merged[n] for p, n in names.items()}
        out = [b"".join([own[p] if p in own else self.pieces[p] for p in c]) for c in cut]
        if len(self.pieces) >= CACHE:
            self.pieces.clear()
        self.pieces.update((p, i) for p, i in own.items() if len(p) <= LONGEST)
        return out


class Builder:
    """A minimal acyclic transducer from words in sorted order, each with its ids."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.states: list[tuple] = []  # (ids at a word's end here or None, ((byte, state, ids), ...))
        # the states of the last word, not settled yet: [ids at the end or None, [[byte, state, ids], ...]]
        self.open: list[list] = [[None, []]]
        self.last: bytes | None = None

    def _settle(self, depth: int) -> None:
        while len(self.open) > depth + 1:
            end, arcs = self.open.pop()
            key = (end, tuple(map(tuple, arcs)))
            number = self.known.get(key)
            if number is None:
                number = self.known[key] = len(self.states)
                self.states.append(key)
            self.open[-1][1][-1][1] = number

    def add(self, word: bytes, ids: tuple[int, ...]) -> None:
        if self.last is not None and word <= self.last:
            raise ValueError("words must come sorted, each once")
        shared = len(os.path.commonprefix([self.last or b"", word]))
        self._settle(shared)
        for k in range(shared):  # what the arcs on the shared way say too much moves behind them
            arc = self.open[k][1][-1]
            same = len(os.path.commonprefix([arc[2], ids]))
            if same < len(arc[2]):
                tail, arc[2] = arc[2][same:], arc[2][:same]
                node = self.open[k + 1]
                node[0] = None if node[0] is None else tail + node[0]
                for a in node[1]:
                    a[2] = tail + a[2]
            ids = ids[same:]
        for byte in word[shared:]:
            self.open[-1][1].append([byte, -1, ids])
            self.open.append([None, []])
            ids = ()
        self.open[-1][0] = ids
        self.last = word

    def pack(self) -> bytes:
        """The automaton as a double array: the arc of state s by byte b stands at base[s] + b."""
        self._settle(0)
        states = [*self.states, (self.open[0][0], tuple(map(tuple, self.open[0][1])))]  # the first state comes last
        outputs: dict[tuple, int] = {(): 0}
        number = lambda ids: outputs.setdefault(ids, len(outputs))
        room = sum(len(arcs) for _, arcs in states) * 2 + 4096
        taken = np.zeros(room + 512, bool)
        base = np.zeros(len(states), np.int32)
        low = 256
        for s in sorted(range(len(states)), key=lambda k: -len(states[k][1])):
            arcs = states[s][1]
            if not arcs:
                continue
            at = np.array([a[0] for a in arcs], np.int64) - arcs[0][0]
            while taken[low]:
                low += 1
            start, width = low, 256
            while True:  # the first free place for the first arc where the others are free too
                if start + width + 512 > len(taken):
                    taken = np.concatenate([taken, np.zeros(len(taken), bool)])
                free = start + np.flatnonzero(~taken[start : start + width])
                fits = free[~taken[free[:, None] + at].any(axis=1)] if len(at) > 1 else free
                if len(fits):
                    break
                start, width = start + width, min(width * 2, 1 << 15)
            base[s] = fits[0] - arcs[0][0]
            taken[fits[0] + at] = True
        size = int(np.flatnonzero(taken)[-1]) + 1 if taken.any() else 1
        size += 512
        check, to, out = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
        end = np.full(len(states), -1, np.int32)
        for s, (ids, arcs) in enumerate(states):
            if ids is not None:
                end[s] = number(ids)
            for byte, target, ids in arcs:
                k = base[s] + byte
                check[k], to[k], out[k] = s, target, number(ids)
        ids = np.array([i for o in outputs for i in o], np.int32)
        first = np.concatenate([[0], np.cumsum([len(o) for o in outputs])]).astype(np.int32)
        arrays = [base, check, to, out, end, first, ids]
        return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def spread(values: np.ndarray, first: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches ``values[first[k]:first[k + 1]]`` for each k, one behind the other."""
    length = (first[which + 1] - first[which]).astype(np.int64)
    ends = np.cumsum(length)
    return values[np.repeat(first[which] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]


class Lexicon:
    """The packed automaton, read from a buffer or a mapped file."""

    def __init__(self, buffer):
        sizes = np.frombuffer(buffer, np.int64, 7)
        at, arrays = 56, []
        for n in sizes:
            arrays.append(np.frombuffer(buffer, np.int32, n, at))
            at += 4 * int(n)
        self.base, self.check, self.to, self.out, self.end, self.first, self.ids = arrays

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def walk(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words as stretches of bytes: which are known, how many ids each has, and the ids of those known in order."""
        length = end - start
        state = np.full(len(start), len(self.base) - 1, np.int32)
        known = np.zeros(len(start), bool)
        at = np.flatnonzero((length > 0) & (length <= LONGEST))
        words, outs = [], []
        for k in range(LONGEST):
            if not len(at):
                break
            now = state[at]
            slot = self.base[now] + data[start[at] + k]
            good = self.check[slot] == now
            at, slot = at[good], slot[good]
            state[at] = self.to[slot]
            out = self.out[slot]
            says = out > 0
            words.append(at[says])
            outs.append(out[says])
            done = length[at] == k + 1
            over = at[done]
            last = self.end[state[over]]
            known[over[last >= 0]] = True
            words.append(over[last > 0])
            outs.append(last[last > 0])
            at = at[~done]
        word, out = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (words, outs))
        kept = known[word]
        word, out = word[kept], out[kept]
        order = np.argsort(word, kind="stable")
        word, out = word[order], out[order]
        count = np.bincount(word, self.first[out + 1] - self.first[out], len(start)).astype(np.int64)
        return known, count, spread(self.ids, self.first, out)


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of some texts begin and end, and (as offsets) which are whose.

    A space begins a word unless white space stands on both of its sides: then it may belong to a longer match.
    """
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    space = np.flatnonzero(data == 32)
    after, before = np.append(data, 32)[space + 1], data[space - 1]
    begins = edge.copy()
    begins[offsets[-1]] = False
    begins[space[~(_ENDS_BLANK[before] & (_BEGINS_BLANK[after] | edge[space + 1]))]] = True
    start = np.flatnonzero(begins)
    whose = np.searchsorted(start, offsets)
    end = np.append(start[1:], offsets[-1])
    return np.stack([start, end]), whose


class Codec:
    """Texts to ids and back."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon, self.seen = vocabulary, lexicon, {}
        self.text, self.text_first = self._column(vocabulary.bytes_of)
        self.decimal, self.decimal_first = self._column([f"{i},".encode() for i in range(len(vocabulary.bytes_of))])

    @staticmethod
    def _column(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def _unseen(self, raw: list[bytes]) -> list[bytes]:
        """The ids of each word, as bytes of 32-bit integers; those that are new are merged together."""
        new = {w for w in raw if w not in self.seen}
        ids = dict(zip(new, self.vocabulary.words([w.decode("utf-8", "replace") for w in new])))
        out = [ids[w] if w in ids else self.seen[w] for w in raw]
        if len(self.seen) >= CACHE:
            self.seen.clear()
        self.seen.update((w, i) for w, i in ids.items() if len(w) <= LONGEST)
        return out

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, and where those of each begin; no special tokens."""
        _, offsets, buffer = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
        (start, end), whose = cuts(data, offsets - offsets[0])
        known, count, ids = self.lexicon.walk(data, start, end)
        rare = np.flatnonzero(~known)
        raw = data.tobytes() if len(rare) else b""
        own = self._unseen([raw[a:b] for a, b in zip(start[rare].tolist(), end[rare].tolist())])
        count[rare] = [len(x) // 4 for x in own]
        place = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros(place[-1], np.int32)
        if len(rare):
            of_known = np.repeat(known, count)
            out[of_known] = ids
            out[~of_known] = np.frombuffer(b"".join(own), np.int32)
        else:
            out = ids
        return out, place[whose]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, and where those of each begin."""
        v = self.vocabulary
        if v.find_special is None:
            return self._plain(texts)
        has = pc.match_substring_regex(texts, v.find_special.pattern)
        if not pc.any(has, skip_nulls=True).as_py():
            return self._plain(texts)
        parts, ends = [], [0]  # texts are cut at the special tokens and their pieces encoded each for itself
        marks: list[list[int]] = []
        for text, special in zip(texts.to_pylist(), has.to_pylist()):
            found = list(v.find_special.finditer(text)) if special else []
            at = 0
            for m in found:
                parts.append(text[at : m.start()])
                at = m.end()
            parts.append(text[at:])
            marks.append([v.special[m[0]] for m in found])
            ends.append(len(parts))
        ids, first = self._plain(pa.array(parts, pa.large_string()))
        rows = []
        for k, special in enumerate(marks):
            piece = [ids[first[j] : first[j + 1]] for j in range(ends[k], ends[k + 1])]
            rows.append(np.concatenate([x for a, b in zip(piece, [*special, None]) for x in (a, [] if b is None else [b])]).astype(np.int32))
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])

    def decode(self, ids: np.ndarray, first: np.ndarray) -> Iterator[str]:
        """The texts of the ids; bytes that are no UTF-8 become U+FFFD."""
        data = spread(self.text, self.text_first, ids).tobytes()
        place = np.concatenate([[0], np.cumsum(self.text_first[ids + 1] - self.text_first[ids])])[first].tolist()
        for a, b in zip(place, place[1:]):
            yield data[a:b].decode("utf-8", "replace")

    def decimals(self, ids: np.ndarray, first: np.ndarray) -> Iterator[bytes]:
        """The ids of each text as decimal numbers joined by commas."""
        data = spread(self.decimal, self.decimal_first, ids).tobytes()
        place = np.concatenate([[0], np.cumsum(self.decimal_first[ids + 1] - self.decimal_first[ids])])[first].tolist()
        for a, b in zip(place, place[1:]):
            yield data[a : max(a, b - 1)]


@lru_cache(maxsize=2)
def codec(vocabulary: str, lexicon: str) -> Codec:
    """One codec for each Python worker; the automaton's pages are those of the mapped file."""
    return Codec(Vocabulary(vocabulary), Lexicon.mapped(SparkFiles.get(lexicon)))


def frequent_words(docs: DataFrame, one_in: int = ONE_IN, text: str = "text") -> list[str]:
    """The words of all texts, with the space before them, that are at least one in ``one_in``: at most that many reach the driver."""
    words = docs.select(F.explode(F.split(F.col(f"`{text}`"), " ")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    words = keep(words, "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    found = words.where((F.col("n") >= total / one_in) & F.octet_length("w").between(1, LONGEST - 1)).select("w").toArrow()
    return [" " + w for w in found["w"].to_pylist()]


def compiled(vocabulary: Vocabulary, words: Iterable[str]) -> bytes:
    build, raw = Builder(), sorted({w.encode() for w in words})
    for w, ids in zip(raw, vocabulary.words([w.decode() for w in raw])):
        build.add(w, tuple(np.frombuffer(ids, np.int32).tolist()))
    return build.pack()


def hand_out(spark: SparkSession, packed: bytes) -> str:
    """The name under which every executor has the automaton as a file; Spark hands it to executors that start later, too."""
    name = f"lexicon-{uuid.uuid4().hex}"
    with open(os.path.join(tempfile.mkdtemp(prefix="fieldloom-"), name), "wb") as f:
        f.write(packed)
    spark.sparkContext.addFile(f.name)
    return name


def encode_texts(docs: DataFrame, vocabulary: str, ids: bool = True, text: str = "text", key: str = "doc_id", one_in: int = ONE_IN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked, the ids themselves."""
    lexicon = hand_out(docs.sparkSession, compiled(Vocabulary(vocabulary), frequent_words(docs, one_in, text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, lexicon)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            texts = strings(batch.column(1))
            for a, b in pieces(texts, CHUNK):
                got, first = own.encode(texts.slice(a, b - a))
                cols = [batch.column(0).slice(a, b - a), pa.array(np.diff(first)), pa.array(map(sha, own.decimals(got, first)), pa.string()), pa.array([sha(t.encode()) for t in own.decode(got, first)], pa.string())]
                cols += [pa.LargeListArray.from_arrays(pa.array(first.astype(np.int64)), pa.array(got)).cast(pa.list_(pa.int32()))] * ids
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids)

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)


def op11_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ids=False)
