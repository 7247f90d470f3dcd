"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding (operator 3).

The merges are compiled into a transducer over bytes. A sequence of tokens is
the BPE encoding of its bytes exactly if every two neighbours are the encoding
of theirs; so each prefix of the input has one last token, and the paths through
the boundaries at which a token may still begin are all that must be
remembered. A state is the open suffix (the longest that begins some
token), the token before it, and those paths. States and transitions are made
when first met. What all open paths share is emitted at once, so a token leaves
after a lookahead of at most the longest token.

Whole texts are cut at the matches of the pattern; each match is run through the
transducer once for each worker and remembered in a table of bounded size.

Decoding runs the bytes of a few thousand ids at a time through an incremental UTF-8 state
machine, which holds the sequence that a piece leaves open.

Null texts are empty: no ids. Ids are little-endian unsigned 32-bit integers. Repeated rows
give repeated rows, an empty table an empty result; other columns of the input play no part, whatever
their names. Very long texts are read whole; what a worker remembers is bounded by the constants below.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import strings, table

#: Most chunks, matches, states and token pairs that a worker remembers, and the longest chunk or match that it does.
CACHE, TOKENS, STATES, PAIRS, LONGEST = 200_000, 500_000, 800_000, 1_000_000, 64
_NONE = 1 << 40


class Transducer:
    """Bytes in, token ids out; ``ranks`` are the tokens by their bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.begins = {t[:k] for t in ranks for k in range(1, len(t) + 1)}
        self.good: dict[int, bool] = {}
        self.spines: dict[int, tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]] | None] = {}
        self.nodes: dict[bytes, tuple[list[tuple[int, int]], bytes, list[int]]] = {}
        # a state: (token before or -1, open suffix, a path to each boundary at which a token may begin)
        self.states: list[tuple[int, bytes, tuple[tuple[int, ...], ...]]] = []
        self.number: dict[tuple, int] = {}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}  # state << 8 | byte -> next state, tokens
        self._forget()

    def _forget(self) -> None:
        """Keep the first state alone; the others are made again when met."""
        for memory in (self.states, self.number, self.moves, self.nodes):
            memory.clear()
        self._number((-1, b"", ((),)))

    def _number(self, key: tuple) -> int:
        n = self.number[key] = len(self.states)
        self.states.append(key)
        return n

    def merged(self, text: bytes, least_parts: int = 1) -> list[bytes]:
        """The encoding by the definition: the pair of least rank is merged, again and again."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > least_parts:
            scores = [self.ranks.get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
            if (least := min(scores)) == _NONE:
                break
            i = scores.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _spine(self, token: int):
        """The parts at the left and at the right edge of a token as it is merged, with their ranks; None if it is never made."""
        if token in self.spines:
            return self.spines[token]
        text = self.bytes_of[token]
        out = ([(text, token)], [(text, token)])
        if len(text) > 1:
            parts = self.merged(text, 2)
            if len(parts) != 2 or any(p not in self.ranks for p in parts):
                self.spines[token] = None
                return None
            left, right = (self._spine(self.ranks[p]) for p in parts)
            out = None if left is None or right is None else (left[0] + out[0], right[1] + out[1])
        self.spines[token] = out
        return out

    def _follows(self, a: int, b: int) -> bool:
        """Whether two tokens side by side are the encoding of their bytes: no merge across the border comes before those on its sides."""
        known = self.good.get(key := a << 32 | b)
        if known is not None:
            return known
        right, left = self._spine(a)[1], self._spine(b)[0]
        i = j = 0
        while True:
            grows_a = right[i + 1][1] if i + 1 < len(right) else _NONE
            grows_b = left[j + 1][1] if j + 1 < len(left) else _NONE
            across = self.ranks.get(right[i][0] + left[j][0], _NONE)
            if across < grows_a and across <= grows_b and across != _NONE:
                known = False
                break
            if grows_a == grows_b == _NONE:
                known = True
                break
            if grows_a <= grows_b:
                i += 1
            else:
                j += 1
        if len(self.good) >= PAIRS:
            self.good.clear()
        self.good[key] = known
        return known

    def _node(self, suffix: bytes):
        """For the bytes since the first open boundary: the tokens that end here by boundary, the new suffix, and the boundaries that stay."""
        old = [k for k in range(len(suffix)) if k == len(suffix) - 1 or suffix[k:-1] in self.begins]
        ends = [(n, self.ranks[suffix[k:]]) for n, k in enumerate(old) if suffix[k:] in self.ranks and self._spine(self.ranks[suffix[k:]])]
        stay = [n for n, k in enumerate(old) if suffix[k:] in self.begins]
        out = self.nodes[suffix] = (ends, suffix[old[stay[0]] :] if stay else b"", stay)
        return out

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The next state and the tokens that are now certain."""
        before, suffix, paths = self.states[state]
        suffix += bytes((byte,))
        ends, rest, stay = self.nodes.get(suffix) or self._node(suffix)
        for n, token in ends:  # the boundary that lies furthest back gives the longest token
            path = paths[n]
            last = path[-1] if path else before
            if last < 0 or self._follows(last, token):
                break
        else:
            raise ValueError("a byte is missing from the vocabulary")
        new = path + (token,)
        kept = [paths[n] for n in stay]
        kept.append(new)
        first, shared = kept[0], 0
        if first and new[0] == first[0]:
            shared = len(first)
            for p in kept:
                k = 0
                while k < shared and k < len(p) and p[k] == first[k]:
                    k += 1
                shared = k
        if shared:
            before = first[shared - 1]
            kept = [p[shared:] for p in kept]
        if all(kept):
            before = -1  # every path has a last token of its own: states that differ in the token before are one
        key = (before, rest, tuple(kept))
        n = self.number.get(key)
        if n is None and len(self.states) >= STATES:
            self._forget()
            return self._number(key), first[:shared]  # no move to remember: the state it left is forgotten
        out = self.moves[state << 8 | byte] = (self._number(key) if n is None else n, first[:shared])
        return out

    def encode(self, text: bytes) -> list[int]:
        state, out, moves = 0, [], self.moves
        for byte in text:
            move = moves.get(state << 8 | byte) or self.step(state, byte)
            state = move[0]
            if move[1]:
                out.extend(move[1])
        out.extend(self.states[state][2][-1])
        return out


class Utf8Stream:
    """An incremental UTF-8 state machine: bytes in pieces, text out, broken sequences as U+FFFD.

    Its state is the sequence that the pieces so far have begun and not ended; whole
    sequences are turned into text at once, and the bytes of broken ones are looked at one by one.
    """

    def __init__(self) -> None:
        self.need, self.held, self.low, self.high = 0, bytearray(), 0x80, 0xBF

    def _open(self, b: int) -> bool:
        """Enter the state that a first byte asks for; false if it can't begin a sequence of several bytes."""
        if 0xC2 <= b <= 0xDF:
            self.need, self.low, self.high = 1, 0x80, 0xBF
        elif 0xE0 <= b <= 0xEF:
            self.need, self.low, self.high = 2, (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
        elif 0xF0 <= b <= 0xF4:
            self.need, self.low, self.high = 3, (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
        else:
            return False
        self.held = bytearray((b,))
        return True

    def feed(self, data: bytes, final: bool = False) -> str:
        out: list[str] = []
        i, n = 0, len(data)
        while i < n:
            b = data[i]
            if self.need:
                if self.low <= b <= self.high:
                    self.held.append(b)
                    self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
                    if not self.need:
                        out.append(self.held.decode())
                    i += 1
                else:  # the byte is looked at again as the first of a sequence
                    out.append("\ufffd")
                    self.need = 0
                continue
            end = n
            for k in range(1, min(3, n - i) + 1):  # a sequence may be open at the end of the piece
                if data[n - k] >= 0xC0:
                    end = n - k
                    break
                if data[n - k] < 0x80:
                    break
            try:
                out.append(data[i:end].decode() if i or end < n else data.decode())
                i = end
            except UnicodeDecodeError as e:
                out.append(data[i : i + e.start].decode())
                i += e.start
                if not self._open(data[i]):
                    out.append("\ufffd")
                i += 1
                continue
            if i < n:  # the last sequence of the piece, whole or not
                if not self._open(data[i]):
                    out.append("\ufffd")
                i += 1
        if final and self.need:
            out.append("\ufffd")
            self.need = 0
        return "".join(out)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Codec(dict):
    """Text to ids and back; as a dict, a chunk that follows a space -> its ids as bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.machine, self.find = Transducer(ranks), regex.compile(pattern).findall
        self.tied = regex.compile(r"\s (?:\s|\Z)").search
        self.table = [self.machine.bytes_of.get(i, b"") for i in range(max(ranks.values(), default=0) + 1)]
        self.tokens: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _cut(self, text: str) -> bytes:
        out = []
        for piece in self.find(text):
            ids = self.tokens.get(piece)
            if ids is None:
                raw = piece.encode()
                rank = self.machine.ranks.get(raw)
                ids = array("I", self.machine.encode(raw) if rank is None else [rank]).tobytes()
                if len(self.tokens) >= TOKENS:
                    self.tokens.clear()
                if len(piece) <= LONGEST:
                    self.tokens[piece] = ids
            out.append(ids)
        return b"".join(out)

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self._cut(" " + chunk)
        if len(chunk) > LONGEST:
            return ids
        if len(self) >= CACHE:  # the last generation stays in reach
            self.old = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as bytes."""
        if self.tied(text):
            return self._cut(text)  # a space inside a run of white space belongs to the run's match: no cut there
        first, *rest = text.split(" ")
        return self._cut(first) + b"".join(map(self.__getitem__, rest))

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, array("I", ids)))

    def decode(self, ids: bytes, step: int = 4096) -> str:
        """Streaming decode: pieces of ids through the UTF-8 state machine."""
        stream = Utf8Stream()
        parts = [stream.feed(self.decode_bytes(ids[i : i + 4 * step])) for i in range(0, len(ids), 4 * step)]
        return "".join(parts) + stream.feed(b"", final=True)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker."""
    return Codec(read_ranks(path), pattern)


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, ids: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked, the ids themselves as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for value in strings(batch.column(text)):
                got = own.encode(value.as_py())
                rows[0].append(len(got) // 4)
                rows[1].append(hashlib.sha256(got).hexdigest())
                rows[2].append(hashlib.sha256(own.decode(got).encode()).hexdigest())
                if ids:
                    rows[3].append(got)
            cols = [batch.column(key), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(rows[3], pa.binary())] * ids, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids)

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)
