"""Learned operators: held-out accuracy, what they must not look at, and odd inputs."""

from __future__ import annotations

import math
import random
import zlib

import corpus
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lanewise.llm import language, quality, toxicity
from lanewise.llm import queries as Q
from lanewise.llm._learn import labelled

DATA = "/root/testdata/sf0.01"


def crc(i: int, folds: int) -> int:
    return zlib.crc32(str(i).encode()) % folds


def read(name: str) -> list[dict]:
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def test_language(spark):
    lang = {r["doc_id"]: (r["lang"], r["text"]) for r in read("documents")}
    got = Q.op5_language_id(spark, DATA).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    judged = [r for r in got if r.held_out and lang[r.doc_id][0] and sum(map(str.isalpha, lang[r.doc_id][1] or "")) > 40]
    assert sum(r.lang_pred == lang[r.doc_id][0] for r in judged) >= 0.9 * len(judged)
    assert all(r.lang_pred == "und" for r in got if not any(map(str.isalpha, lang[r.doc_id][1] or "")))


@pytest.mark.parametrize("name, label, folds, fold, least", [("op7_quality", "quality", 4, 2, (0.95, 0.9, 0.99)), ("op8_toxicity", "toxic", 3, 1, (0.85, 0.98, 0.93))])
def test_classifiers(spark, name, label, folds, fold, least):
    """Recall of label 1 and of label 0 at the threshold, and the area under the curve, on the held-out fold."""
    labels = {r["doc_id"]: r[label] for r in read("labels")}
    got = Q.QUERIES[name](spark, DATA).collect()
    assert len(got) == len(read("documents"))
    assert all(r.held_out == (crc(r.doc_id, folds) == fold) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    judged = [(r.score, r.predicted, labels[r.doc_id]) for r in got if r.held_out and labels.get(r.doc_id) is not None]
    ones, zeros = [s for s, _, y in judged if y], [s for s, _, y in judged if not y]
    area = sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))
    recall = sum(p for _, p, y in judged if y) / len(ones), sum(not p for _, p, y in judged if not y) / len(zeros)
    assert (*recall, area) >= least and all(x >= y for x, y in zip((*recall, area), least))


@pytest.mark.parametrize("name", ["op5_language_id", "op7_quality", "op8_toxicity"])
def test_odd_inputs(spark, tmp_path, name):
    docs = [(k, f"good words about rivers and hills number {k}") for k in range(40)] + [(k + 40, f"bad foul junk xx zz qq {k}") for k in range(40)]
    odd = [(None, "no id"), (200, None), (201, ""), (202, "123 !!"), (203, "long " * 30000), (1, docs[1][1])]
    labels = [(i, int(i < 40), int(i >= 40)) for i, _ in docs] + [(None, 1, 1), (5, None, None), (999, 1, 0), (3, 1, 0)]
    langs = ["en" if i < 40 else "xx" for i, _ in docs] + [None] * len(odd)
    got = Q.QUERIES[name](spark, corpus.write(tmp_path, docs + odd, labels, langs=langs)).collect()
    assert len(got) == len(docs) + len(odd)
    assert all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("name", ["op7_quality", "op8_toxicity"])
def test_without_labels(spark, tmp_path, name):
    got = Q.QUERIES[name](spark, corpus.write(tmp_path, [(1, "some text"), (2, None)])).collect()
    assert len(got) == 2 and all(0 <= r.score <= 1 for r in got)


def test_more_languages_than_bits_of_a_word(spark, tmp_path):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [["".join(rng.choice(letters) for _ in range(6)) for _ in range(30)] for _ in range(130)]
    docs = [(k, " ".join(rng.choice(words[k % 130]) for _ in range(40))) for k in range(130 * 8)] + [(9000, " ".join(words[129])), (9001, "?!")]
    langs = [f"l{k % 130:03}" for k in range(130 * 8)] + [None, None]
    got = {r.doc_id: r.lang_pred for r in Q.op5_language_id(spark, corpus.write(tmp_path, docs, langs=langs)).collect()}
    assert all(got[k] == f"l{k % 130:03}" for k in range(130 * 8)) and got[9000] == "l129" and got[9001] == "und"


def test_a_language_with_one_document(spark, tmp_path):
    docs = [(k, "the cat sat on the mat and looked out") for k in range(60)] + [(1001, "xyzzy plugh zork quux"), (1002, "plugh zork xyzzy")]
    got = {r.doc_id: r.lang_pred for r in Q.op5_language_id(spark, corpus.write(tmp_path, docs, langs=["en"] * 60 + ["zz", None])).collect()}
    assert crc(1001, 4) != 2 and got[1002] == "zz" and got[3] == "en"


def test_false_positives_are_corrected():
    rng = np.random.default_rng(3)
    own = [rng.integers(0, 1 << 32, n).astype(np.uint64) for n in (4000, 500)]
    model = language.Filter(["a", "b"], own, 0)
    masks = model.having(np.setdiff1d(rng.integers(0, 1 << 32, 400_000).astype(np.uint64), np.concatenate(own)))
    for i in range(2):
        assert abs(float(model._bit(masks[0], i).mean()) - model.false[i]) < 0.1 * model.false[i] + 2e-4
        assert model._bit(model.having(own[i])[0], i).all()


def plain_kernel(a: str, b: str) -> float:
    def counts(word: str) -> dict:
        text, out = "<" + word + ">", {}
        for i in range(len(text)):
            for j in range(i + 1, min(i + 2 + toxicity.GAP, len(text))):
                for k in range(j + 1, min(j + 2 + toxicity.GAP, len(text))):
                    key = text[i] + text[j] + text[k]
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i - 2)
        return out

    def length(word: str) -> float:  # as if all its subsequences were different
        n = len(word)
        return math.sqrt(sum(max(n - x - y, 0) * toxicity.DECAY ** (2 * (x + y)) for x in range(toxicity.GAP + 1) for y in range(toxicity.GAP + 1)))

    x, y = counts(a), counts(b)
    return sum(v * y.get(k, 0) for k, v in x.items()) / length(a) / length(b)


def test_kernels_are_sums_over_gapped_subsequences():
    words = ["idiot", "iddiot", "idxiot", "moron", "more", "table", "stupid", "stooped"]
    letters, start = np.frombuffer("".join(words).encode(), np.uint8), np.append(0, np.cumsum([len(w) for w in words]))
    marks = np.array([0, 3, 6])
    got = toxicity._kernels(letters, start, marks)
    assert np.allclose(got, [[plain_kernel(a, words[m]) for m in marks] for a in words], atol=1e-3)
    assert plain_kernel("idiot", "idxiot") > 3 * plain_kernel("idiot", "table")
    alpha = np.array([0.5, -1.0, 2.0])
    machine = toxicity.Machine(toxicity._weights(letters, start, marks, alpha), -0.25, np.zeros(4))
    assert np.allclose(machine.values(letters, start), got @ alpha - 0.25, atol=1e-3)


def test_insults_with_gaps_and_letters_put_in(spark, tmp_path):
    rng = random.Random(8)
    insults, plain = ["blockhead", "numbskull", "dunderhead", "nitwits"], ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(plain) for _ in range(n)) + ". "
    docs, labels = [], []
    for k in range(600):
        toxic = int(k % 4 == 0)
        docs.append((k, say(9) + (say(4)[:-2] + " " + rng.choice(insults) + " " + say(3) if toxic else say(8)) + say(7)))
        labels.append((k, 1, toxic))
    unseen = ["block-head", "n u m b s k u l l", "dunderrhead", "b.l.o.c.k.h.e.a.d", "NUMBSKULL!!", "dun_der_head"]
    docs += [(1000 + k, say(8) + f"you {w} there. " + say(6)) for k, w in enumerate(unseen)] + [(2000 + k, say(25)) for k in range(40)]
    folder = corpus.write(tmp_path, docs, labels)
    got = {r.doc_id: r for r in Q.op8_toxicity(spark, folder).collect()}
    assert [got[1000 + k].predicted for k in range(len(unseen))] == [1] * len(unseen)
    assert sum(got[2000 + k].predicted for k in range(40)) == 0
    assert all(got[i].predicted == y for i, _, y in labels if got[i].held_out)
    machine = toxicity.learned(Q.table(spark, folder, "documents"), Q.table(spark, folder, "labels"))
    words = ["blockqhead", "numbyskull", "dxunderhead", "blockhead", *plain]
    value = machine.values(np.frombuffer("".join(words).encode(), np.uint8), np.append(0, np.cumsum([len(w) for w in words])))
    assert (value[:4] > 0).all() and (value[4:] < 0).mean() > 0.9


def test_descent_is_the_plain_one():
    rng = np.random.default_rng(0)
    docs = [(np.sort(rng.choice(60, 12, replace=False)), rng.integers(1, 5, 12).astype(float)) for _ in range(20)]
    labels, dims, epochs, rate, seed = rng.integers(0, 2, 20), 3, 2, 0.4, 5
    got = quality.train(docs, labels, dims, epochs, rate, seed)
    draw = np.random.default_rng(seed)
    v, layer = draw.normal(0, 1 / dims, (quality.FEATURES, dims)).tolist(), [[0.0, 0.0] for _ in range(dims)]
    step = 0
    for _ in range(epochs):
        for i in draw.permutation(20):
            eta, (rows, counts) = rate * (1 - step / (epochs * 20)), docs[i]
            step, share = step + 1, [c / sum(counts) for c in counts]
            mean = [sum(s * v[r][d] for r, s in zip(rows, share)) for d in range(dims)]
            z = [sum(mean[d] * layer[d][c] for d in range(dims)) for c in (0, 1)]
            p = [math.exp(x) / (math.exp(z[0]) + math.exp(z[1])) for x in z]
            error = [p[c] - (labels[i] == c) for c in (0, 1)]
            back = [sum(layer[d][c] * error[c] for c in (0, 1)) for d in range(dims)]
            for d in range(dims):
                for c in (0, 1):
                    layer[d][c] -= eta * mean[d] * error[c]
            for r, s in zip(rows, share):
                for d in range(dims):
                    v[r][d] -= eta * math.sqrt(s) * back[d]
    want = [sum(x * (w[1] - w[0]) for x, w in zip(row, layer)) for row in v]
    assert np.allclose(got, want)


def test_quality_sees_code_points_and_no_case():
    (a, ra), (b, rb) = (quality.features(*quality.folded(pa.array([t]))) for t in ("ÄÖÜ Ä", "äöü ä"))
    assert sorted(a) == sorted(b) and len(a) == 1 + 2 + 1 + 3 and set(ra) == set(rb) == {0}


def test_rare_labels_are_learned_from(spark, tmp_path):
    docs = [(k, f"words about hills {k}") for k in range(3000)]
    labels = [(k, 1, int(k % 1000 == 1)) for k in range(3000)]
    folder = corpus.write(tmp_path, docs, labels)
    found, offset = labelled(Q.table(spark, folder, "documents"), Q.table(spark, folder, "labels"), "toxic", 3, 1, 160)
    kinds = [r.label for r in found.collect()]
    ones = sum(crc(k, 3) != 1 for k in range(1, 3000, 1000))
    assert sum(kinds) == ones and 100 < len(kinds) < 220 and offset < -1
