"""Text embeddings by signed hashing of character n-grams, and counts of n-grams, in Arrow batches.

A slice of a batch is one array of code points. Its n-grams are packed into 64-bit numbers by the place of each code
point among those that the slice has, so that equal ones are found by a hash table of numbers and each different one is
hashed once; a worker keeps the hashes of what it has met.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

# Dimension and n-gram lengths.
DIM, SHORTEST, LONGEST = 256, 3, 5
#: Code points of a slice, and different ones that can be packed.
SLICE, KINDS = 1 << 20, 1 << 12
#: Hashes that a worker keeps from slice to slice; of rarer n-grams they are made again.
KEPT = 200_000
_HASHES: dict[str, bytes] = {}


def normal(text: str | None) -> str:
    """Lower case, white space collapsed, one space on either side."""
    return f" {re.sub(r'\s+', ' ', (text or '').lower().strip())} "


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together have at most SLICE code points, so at most KINDS different ones if they have more
    than one text; a longer text is alone."""
    lo, size, seen = 0, 0, set()
    for i, text in enumerate(texts):
        size += len(text)
        seen |= set(text)
        if i > lo and (size > SLICE or len(seen) > KINDS):
            yield lo, i
            lo, size, seen = i, len(text), set(text)
    if lo < len(texts):
        yield lo, len(texts)


def packed(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of some texts as numbers (equal for equal ones), where each begins, and each one's text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, place = np.unique(points, return_inverse=True)
    row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    count = max(len(points) - n + 1, 0)
    at = np.flatnonzero(row[:count] == row[n - 1 :]) if count else np.empty(0, np.int64)
    place = place.astype(np.uint64)
    if len(kinds) <= KINDS:
        code = np.zeros(len(at), np.uint64)
        for j in range(n):
            code = (code << np.uint64(12)) | place[at + j]
    else:  # one text with more code points than can be packed: ranks of its prefixes
        code = place[at]
        for j in range(1, n):
            code = np.unique(code * np.uint64(len(kinds)) + place[at + j], return_inverse=True)[1].astype(np.uint64)
    return code, at, row[at]


def embed(dim: int = DIM) -> Column:
    """Unit vectors; a text without an n-gram gives zeros."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(texts: pd.Series) -> pd.Series:
        cleaned = [normal(t) for t in texts]
        return pd.Series([v for lo, hi in slices(cleaned) for v in embedded(cleaned[lo:hi], dim)])

    return run


def _hash(gram: str) -> bytes:
    found = _HASHES.get(gram)
    if found is None:
        found = hashlib.blake2b(gram.encode(), digest_size=8).digest()
        if len(_HASHES) < KEPT:
            _HASHES[gram] = found
    return found


def embedded(texts: list[str], dim: int) -> np.ndarray:
    """A row for each of some normalised texts."""
    out = np.zeros((len(texts), dim))
    whole = "".join(texts)
    for n in range(SHORTEST, LONGEST + 1):
        code, at, row = packed(texts, n)
        of, different = pd.factorize(code)
        first = np.empty(len(different), np.int64)
        first[of[::-1]] = at[::-1]
        hashes = np.frombuffer(b"".join(map(_hash, [whole[i : i + n] for i in first.tolist()])), "<u8")
        slot, sign = (hashes % np.uint64(dim)).astype(np.int64), np.where(hashes >> np.uint64(63), 1.0, -1.0)
        out += np.bincount(row * dim + slot[of], sign[of], len(texts) * dim).reshape(out.shape)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length > 0, length, 1)


@F.pandas_udf(StructType([StructField("n_grams", IntegerType()), StructField("n_distinct", IntegerType())]))
def gram_counts(texts: pd.Series) -> pd.DataFrame:
    """How many n-grams each text has, and how many different ones."""
    given = [t or "" for t in texts]
    counts = np.zeros((len(given), 2), np.int64)
    for lo, hi in slices(given):
        for n in range(SHORTEST, LONGEST + 1):
            code, _, row = packed(given[lo:hi], n)
            order = np.lexsort((code, row))
            new = np.append(True, (np.diff(code[order]) != 0) | (np.diff(row[order]) != 0)) if len(code) else np.empty(0, bool)
            counts[lo:hi, 0] += np.bincount(row, minlength=hi - lo)
            counts[lo:hi, 1] += np.bincount(row[order][new], minlength=hi - lo)
    return pd.DataFrame({"n_grams": counts[:, 0], "n_distinct": counts[:, 1]}).astype("int32")
