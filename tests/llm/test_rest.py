"""Links that rare shingles find alone: without the blocks of equal min-hashes, in blocks of few rows, by twos."""

from __future__ import annotations

import random

import brute
import corpus
import pytest

from lanewise.llm import jaccard
from lanewise.llm import queries as Q


def near_copies(rng: random.Random) -> list[tuple[int, str]]:
    """Chains of texts that differ by ever more words, groups around one text, and passages that many texts have."""
    docs, base = [], [[f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 40, 70]))] for _ in range(6)]
    for words in base:
        for k in range(14):
            own = list(words)
            for _ in range(k // 3):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9)}"
            docs.append(" ".join(own[: len(own) - k % 4] + ["tail"] * (k % 3)))
    passage = [f"p{k}" for k in range(50)]
    for k in range(25):
        own = [f"y{k}a{j}" for j in range(rng.choice([2, 9, 30]))]
        docs.append(" ".join(own + passage) if k % 2 else " ".join(passage + own + docs[k].split()[:20]))
    rng.shuffle(docs)
    return list(enumerate(docs, 10))


@pytest.mark.parametrize("rows", [2, 5, 512])
@pytest.mark.parametrize("rounds", [0, 1])
def test_every_link_is_found(spark, tmp_path, monkeypatch, rows, rounds):
    monkeypatch.setattr(jaccard, "ROWS", rows)
    monkeypatch.setattr(jaccard, "met", lambda classes, percent, met=jaccard.met: met(classes, percent, 1) if rounds else met(classes, percent, 1).limit(0))
    docs = near_copies(random.Random(rows))
    found = Q.op9_jaccard_join(spark, corpus.write(tmp_path, docs)).collect()
    want = sorted(brute.op9(docs))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == want
    assert len({x[2] for x in want}) < len(docs) - 10
