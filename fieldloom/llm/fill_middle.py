"""Fill-in-the-middle transformation over a sparse exception index (operator 13).

A text is cut into prefix, middle and suffix at two of its units (lines, or code points) and put together
again with a mark before each part, in one of two orders; some texts stay plain. The choices come from a hash of the seed and doc_id
alone, so that a rerun gives the same rows.

Texts stay UTF-8 bytes throughout. ``Exceptions`` holds, for the characters of several bytes alone, where they stand
and how many bytes more than one they have taken so far; a binary search and a subtraction turn a byte cut into a
code-point cut and back, and between exceptions the two differ by a constant. An ASCII text has no exceptions.

A null text counts as empty, and an empty text, or one that holds a mark, is plain. A null identifier hashes as empty text. Repeated rows give
repeated rows, an empty table an empty result; very long texts are read whole, at one byte a byte and 16 for each exception. Columns beside
doc_id and text play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK, pieces, strings, table

#: The marks before prefix, suffix and middle.
MARKS = (b"<P>", b"<S>", b"<M>")
_EXCESS = np.zeros(256, np.int8)
_EXCESS[0xC0:0xE0], _EXCESS[0xE0:0xF0], _EXCESS[0xF0:] = 1, 2, 3


class Exceptions:
    """Where the characters of several bytes stand in some bytes of UTF-8, and what they add up to."""

    def __init__(self, data: np.ndarray):
        self.byte = np.flatnonzero(data >= 0xC0)
        #: Bytes beyond one a character that the first k exceptions have.
        self.excess = np.concatenate([[0], np.cumsum(_EXCESS[data[self.byte]], dtype=np.int64)])
        self.char = self.byte - self.excess[:-1]

    def chars(self, cut: np.ndarray) -> np.ndarray:
        """Code points before a cut given in bytes; cuts lie between characters."""
        return cut - self.excess[np.searchsorted(self.byte, cut)]

    def bytes(self, cut: np.ndarray) -> np.ndarray:
        """Bytes before a cut given in code points."""
        return cut + self.excess[np.searchsorted(self.char, cut)]


@dataclass(frozen=True)
class Rule:
    """Seed, the unit of cuts, and of 100 texts how many change and how many of these are spm."""

    seed: int = 7
    unit: str = "line"
    changed: int = 100
    spm: int = 50


def assemble(text: bytes, a: int, b: int, form: str) -> bytes:
    """The three parts of a text, cut at bytes a and b, in the form's order."""
    p, s, m = MARKS
    if form == "psm":
        return b"".join((p, text[:a], s, text[b:], m, text[a:b]))
    if form == "spm":
        return b"".join((s, text[b:], p, text[:a], m, text[a:b]))
    return text


def restore(output: bytes, form: str) -> bytes:
    """The text that an output was made of. No mark begins inside another or inside a text, so the first of each is the one that was put in."""
    if form == "plain":
        return output
    p, s, m = MARKS
    first, second = (p, s) if form == "psm" else (s, p)
    head, middle = output[len(first) :].split(m, 1)
    one, two = head.split(second, 1)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def transform(texts: pa.Array, hashes: np.ndarray, rule: Rule) -> Iterator[tuple[int, str, int | None, int | None, bytes, bytes]]:
    """For each text: units, form, code points of prefix and middle, output, text."""
    _, offsets, buffer = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffer, np.uint8)[at[0] : at[-1]] if buffer is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    index = Exceptions(data)
    begins = index.chars(at)  # code points before each text
    if rule.unit == "line":
        newline = np.flatnonzero(data == 10) + 1
        first = np.searchsorted(newline, at, side="right")  # newlines that end at or before a text's begin
        length = np.diff(at)
        ended = np.zeros(len(texts), bool)
        ended[length > 0] = data[at[1:][length > 0] - 1] == 10
        units = np.diff(first) + ((length > 0) & ~ended)
    elif rule.unit == "char":
        units = np.diff(begins)
    else:
        raise ValueError(f"no unit {rule.unit}")
    h = hashes.astype(np.int64)
    low, high = np.sort(h[:, :2] % (units + 1)[:, None], axis=1).T
    if rule.unit == "line":  # the k-th line ends behind the k-th newline, the last at the end of the text
        end = lambda k: np.where(k == 0, at[:-1], np.where(k >= units, at[1:], np.append(newline, 0)[np.minimum(first[:-1] + k - 1, len(newline))]))
        cut, cut2 = end(low), end(high)
    else:
        cut, cut2 = index.bytes(begins[:-1] + low), index.bytes(begins[:-1] + high)
    prefix, middle = index.chars(cut) - begins[:-1], index.chars(cut2) - index.chars(cut)
    raw = data.tobytes()
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        text = raw[a:b]
        plain = a == b or h[i, 2] % 100 >= rule.changed or any(m in text for m in MARKS)
        form = "plain" if plain else "spm" if h[i, 3] % 100 < rule.spm else "psm"
        chars = (None, None) if plain else (int(prefix[i]), int(middle[i]))
        yield int(units[i]), form, *chars, assemble(text, int(cut[i]) - a, int(cut2[i]) - a, form), text


def fill_in_middle(docs: DataFrame, rule: Rule = Rule(), output: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, the digests of the output and of the text rebuilt from it, and, if asked, the output itself."""
    kind = dict(docs.dtypes)[key]
    digest = F.sha2(F.concat(F.lit(f"{rule.seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    four = F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            texts = strings(batch.column(1))
            hashes = batch.column(2).flatten().to_numpy().reshape(-1, 4)
            for a, b in pieces(texts, CHUNK):
                rows = [(n, form, p, m, sha(out), sha(restore(out, form)), out) for n, form, p, m, out, _ in transform(texts.slice(a, b - a), hashes[a:b], rule)]
                columns = [batch.column(0).slice(a, b - a), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())))]
                columns += [pa.array([r[6] for r in rows], pa.binary()).cast(pa.string())] * output
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"] + ["output"] * output)

    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"), four).mapInArrow(run, schema + ", output string" * output)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"), output=False)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h FROM documents WHERE doc_id IS NOT NULL),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines, [CAST('0x' || h[8 * k + 1:8 * k + 8] AS BIGINT) FOR k IN range(4)] AS k FROM d),
c AS (
    SELECT *, len(lines) AS n, least(k[1] % (len(lines) + 1), k[2] % (len(lines) + 1)) AS a, greatest(k[1] % (len(lines) + 1), k[2] % (len(lines) + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN k[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM u),
p AS (SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
