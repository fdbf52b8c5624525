"""Suffix arrays and permuted common prefixes against plain ones."""

from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
import pytest

from lanewise.llm import _suffix as S
from lanewise.llm import _text as T
from lanewise.llm import suffixes


def plain(t: list[int]) -> list[int]:
    return sorted(range(len(t)), key=lambda i: t[i:])


@pytest.mark.parametrize("most", [2, 5, 512])
@pytest.mark.parametrize("kinds", [1, 2, 3, 20, 300])
def test_random_strings(monkeypatch, most, kinds):
    monkeypatch.setattr(S, "MOST", most)
    rng = np.random.default_rng(kinds)
    for n in (0, 1, 2, 3, 10, 100, 700):
        t = np.append(rng.integers(1, kinds + 1, n), 0)
        assert S.suffix_array(t).tolist() == plain(t.tolist())


@pytest.mark.parametrize("text", [b"", b"a", b"a" * 1500, b"ab" * 700, b"abc" * 300 + b"x" + b"abc" * 300, b"mississippi" * 40 + b"missis", "né語ß".encode() * 90])
def test_prefixes(text):
    data = np.append(np.frombuffer(text, np.uint8), 254).astype(np.uint8)
    t = data.astype(np.int16) + 2
    t[-1] = 0
    order = S.suffix_array(t)
    assert order.tolist() == plain(t.tolist())
    before, size = S.permuted_prefixes(data, order)
    rank = {int(i): k for k, i in enumerate(order)}
    whole = data.tobytes()
    for i in range(len(data)):
        j = int(order[rank[i] - 1]) if rank[i] else -1
        k = 0
        while j >= 0 and max(i, j) + k < len(data) and whole[i + k] == whole[j + k]:
            k += 1
        assert (before[i], size[i]) == (j, k)


def test_real_text():
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet")["text"].to_pylist()
    raw = np.frombuffer("".join(x or "" for x in texts[:200]).encode()[:100_000], np.uint8)
    order = S.suffix_array(np.append(raw.astype(np.int64) + 2, 0))[1:].tolist()
    whole = raw.tobytes()
    assert sorted(order) == list(range(len(raw))) and all(whole[a : a + 5000] <= whole[b : b + 5000] for a, b in zip(order, order[1:]))


@pytest.mark.parametrize("shorter", [0.0, 0.9])
@pytest.mark.parametrize("kinds", [2, 9, 60, 400, 5000])
def test_names_that_decide_their_suffixes(monkeypatch, kinds, shorter):
    """Strings of names in which some, few or nearly all stand once, also at the start and before the end."""
    monkeypatch.setattr(S, "SHORTER", shorter)
    rng = np.random.default_rng(kinds)
    for n in (1, 2, 5, 50, 600):
        for _ in range(5):
            drawn = rng.integers(0, kinds, n)
            if n > 20:
                drawn[n // 2 : n // 2 + n // 4] = drawn[: n // 4]  # a repeated stretch
            name = np.append(np.unique(drawn, return_inverse=True)[1] + 1, 0)
            assert S._names_sorted(name).tolist() == plain(name.tolist())


@pytest.mark.parametrize("kinds", [1, 2, 26])
def test_runs_whose_minimiser_stands_twice(kinds):
    rng = np.random.default_rng(kinds)
    length, gram = 12, 4
    rows = [bytes(rng.integers(97, 97 + kinds, n).astype(np.uint8)) for n in (0, 5, 11, 12, 13, 40, 300)]
    rows += [rows[-1][:20] * 4, b"x" * 60 + rows[-1][:30]]
    raw, offs = np.frombuffer(b"".join(rows), np.uint8), np.append(0, np.cumsum([len(r) for r in rows]))
    start, size, low, inner = suffixes._part(raw, offs, 0, len(rows), length, gram)
    hashes = T.byte_grams(raw, gram)
    assert inner.any() and sum(size) == sum(max(0, len(r) - length + 1) for r in rows)
    for a, n, least, twice in zip(start, size, low, inner):
        own = hashes[a : a + n + length - gram]
        assert own.min() == least and twice == ((own == least).sum() > 1)
