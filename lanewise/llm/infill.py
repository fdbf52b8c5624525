"""Fill-in-the-middle transformation (operator 11).

A text's units are runs of ASCII letters and single other code points. A text is held as maximal runs of one class
(letters, or others of one, two, three or four bytes), each with the units, code points and bytes before it. A
cut after so many units is found by a binary search for the run that contains it, and its place within the run follows by
multiplication: a letter run is a single unit, in any other run all units have the same bytes. Nothing is cut by
scanning, and no list of units is made.

Cuts and form are drawn from a hash of the seed and doc_id, so they don't depend on partitions or on other rows.

Cases: a null text is empty; an empty text, and one that contains a marker, stays plain. A null doc_id is drawn for as if
it were written with no digits, so that all rows without doc_id have the same draws (but not the same cuts, as these
depend on the number of units). Repeated rows give repeated results. An empty table gives an empty result; other columns of
the input are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T

SEED = 1
#: Of a hundred documents, how many are transformed, and of these how many begin with the suffix.
RATE, SUFFIX_FIRST = 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Class of a byte: 0 within a code point, else 1 for letters, and 2 to 5 for others of 1 to 4 bytes.
CLASS = np.zeros(256, np.uint8)
CLASS[:0x80], CLASS[0xC0:0xE0], CLASS[0xE0:0xF0], CLASS[0xF0:] = 2, 3, 4, 5
CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Runs:
    """Maximal runs of one class of some texts, one text after another, with totals before each run (and one after all).

    first[r]:first[r + 1] are the runs of text r. Totals go on from text to text, so one binary search serves all.
    """

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        at = np.flatnonzero(CLASS[raw])  # where code points begin
        kind = CLASS[raw[at]]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offs] = True
        new = edge[at]
        new[1:] |= kind[1:] != kind[:-1]
        head = np.flatnonzero(new)
        self.kind = kind[head]
        self.start = np.append(at[head], len(raw))
        chars = np.diff(np.append(head, len(at)))
        self.chars = np.append(head, len(at))
        self.units = np.append(0, np.cumsum(np.where(self.kind == 1, 1, chars)))
        self.first = np.searchsorted(self.start[:-1], offs)

    def counts(self) -> np.ndarray:
        """Units of each text."""
        return np.diff(self.units[self.first])

    def cut(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and code points, from the start of the text, before its unit number units[r]."""
        before = self.first[:-1]
        target = self.units[before] + units
        # the last run that begins at or before the cut, or the end of all runs
        run = np.searchsorted(self.units, target, "right") - 1
        inside = target - self.units[run]
        width = np.append(self.kind, 2)[run].astype(np.int64) - 1  # of letters it is never used: nothing is inside one unit
        return self.start[run] + inside * width - self.start[before], self.chars[run] + inside - self.chars[before]


def _marked(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text contains a marker."""
    out = np.zeros(len(offs) - 1, bool)
    if len(raw) < 3:
        return out
    middles = np.zeros(256, bool)
    middles[[ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)]] = True
    at = np.flatnonzero((raw[:-2] == ord("<")) & (raw[2:] == ord(">")))
    at = at[middles[raw[at + 1]]]
    row = np.searchsorted(offs, at, "right") - 1
    out[row[at + 3 <= offs[row + 1]]] = True
    return out


def _rewritten(raw: np.ndarray, offs: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, ...]:
    """n, form, prefix_chars, middle_chars, and the bytes and offsets of the outputs."""
    runs = Runs(raw, offs)
    n, size = runs.counts(), np.diff(offs)
    one, two = draws[0] % (n + 1), draws[1] % (n + 1)
    (a, a_chars), (b, b_chars) = runs.cut(np.minimum(one, two)), runs.cut(np.maximum(one, two))
    plain = (size == 0) | _marked(raw, offs) | (draws[2] % 100 >= RATE)
    form = np.where(plain, 0, np.where(draws[3] % 100 < SUFFIX_FIRST, 1, 2))
    # each output is up to six stretches, of the markers (put after all texts) and of the text
    marks = np.frombuffer((PREFIX + SUFFIX + MIDDLE).encode(), np.uint8)
    whole = np.concatenate([raw, marks])
    mark = len(raw) + 3 * np.arange(3)
    zero, start, end = np.zeros(len(n), np.int64), offs[:-1], offs[1:]
    p, m, s = (start, a), (start + a, b - a), (start + b, size - b)
    stretches = [
        ([(zero, zero)] * 5 + [(start, size)]),
        [(zero + mark[1], zero + 3), s, (zero + mark[0], zero + 3), p, (zero + mark[2], zero + 3), m],
        [(zero + mark[0], zero + 3), p, (zero + mark[1], zero + 3), s, (zero + mark[2], zero + 3), m],
    ]
    begin = np.stack([np.choose(form, [x[j][0] for x in stretches]) for j in range(6)], 1)
    length = np.stack([np.choose(form, [x[j][1] for x in stretches]) for j in range(6)], 1)
    out, cuts = T.gathered(whole, begin.ravel(), length.ravel())
    return n, form, a_chars, b_chars - a_chars, out, cuts[::6]


def transformed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output (the text that
    a model is trained on)."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(key, 8 * j + 1, 8), 16, 10).cast("long").alias(f"h{j}") for j in range(4)]
    forms = pa.array(["plain", "spm", "psm"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = T.strings(batch.column("text"))
            numbers = np.stack([batch.column(f"h{j}").to_numpy() for j in range(4)]) if batch.num_rows else np.zeros((4, 0), np.int64)
            for lo, hi in T.pieces(offs):
                n, form, prefix, middle, out, cuts = _rewritten(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], numbers[:, lo:hi])
                plain = form == 0
                output = T.string_array(out, cuts).cast(pa.large_string()).cast(pa.string())
                columns = [batch.column("doc_id").slice(lo, hi - lo), pa.array(n), forms.take(pa.array(form)), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), output]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *draws).mapInArrow(T.lean(run), OUT)


def rebuilt(output: Column, form: Column) -> Column:
    """The text from an output and its form alone. No part contains a marker, nor can a part's end and a marker's begin make
    one, so the first marker of each kind is the one that was put in."""
    at = {m: F.locate(m, output) for m in (PREFIX, SUFFIX, MIDDLE)}

    def between(after: str, before: str) -> Column:
        return F.substring(output, at[after] + 3, at[before] - at[after] - 3)

    middle = F.substring(output, at[MIDDLE] + 3, F.char_length(output))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and SHA-256 of the output and of the text rebuilt from it."""
    found = transformed(docs, seed)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(rebuilt(F.col("output"), F.col("form"))).alias("restored_sha256"))
