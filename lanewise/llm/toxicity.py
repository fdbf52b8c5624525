"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks (operator 8).

The kernel compares two words by their common subsequences of three letters, each weighted by DECAY for every letter
left out in between (at most GAP at a time), so an insult with gaps or inserted letters stays close to itself. Words
are the letters of white-space tokens, of the parts of tokens with signs inside, and of runs of single letters.

The machine is trained on sentences of labelled documents, in ROUNDS rounds. In the first, a sentence has its document's
label, and its kernel with a landmark is the sum of its words' kernels. In the others a sentence is as toxic as its
worst word, which stands for it (multiple-instance learning): of documents labelled 1, sentences that the machine takes
for toxic are positive, of those labelled 0 the worst sentences are negative; the words that decide positive sentences are
also learned with a letter put in. Words are mapped to their kernels with LANDMARKS words, whitened (Nyström), and a
linear machine is trained on them with squared hinge loss in numpy. A document's score follows by logistic regression
from its worst word and from how much there is of words above DOUBT, in all and for its length. As the kernel is an
inner product of subsequence counts, the trained machine is one table of weights for hashed subsequences, which scoring
looks up. Learning reads about `sample` labelled documents, chosen by hash for each label, OCCURRENCES words of each at most, and one
of each group of near copies among them.

Cases: null, empty and letterless texts have no words and so a low score; without labels of both kinds every score
is the share of label 1 (0 without labels); repeated rows give a row each; a doc_id labelled more than once counts
with its largest label; a null doc_id is not held out; of very long texts all words are scored; documents and words with
equal values keep their order; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._learn import held_out, labelled

FOLDS, FOLD, THRESHOLD = 3, 1, 0.7
#: Labelled documents that are learned from, about, and different words of sentences of one document at most.
SAMPLE, OCCURRENCES = 4_000, 5_000
GAP, DECAY, BITS = 2, 0.6, 18
LANDMARKS, ROUNDS, SEED = 384, 4, 11
#: Copies of each telling word with an inserted letter that a round learns as well, and their weight together.
VARIANTS, ALTERED = 8, 0.15
#: Sentences of documents labelled 0 in the first round, and of one such document in each further one.
NEGATIVES, WORST = 6_000, 3
STEPS, RIDGE, BALANCE = 20, 1e-3, 0.35
#: Weight, in documents, of the prior of a word's share of toxic documents, by which landmarks are chosen.
PRIOR = 5.0
#: Values up to this count for nothing in a document's sum.
DOUBT = 0.4
#: Rows of a matrix, and letters of units, that are worked on at a time.
ROWS, UNITS = 1 << 12, 1 << 18
#: A spelled-out word has so many single letters, a part of a token so many letters, at least.
LEAST = 3

LETTER = np.zeros(256, bool)
LETTER[0x61:0x7B] = True
LETTER[0x80:] = True
#: Of a longer code point, its later bytes stand for it.
LEAD = np.zeros(256, bool)
LEAD[0xC0:] = True
ENDS = np.zeros(256, bool)
ENDS[[0x21, 0x2E, 0x3F, 0x0A]] = True
HEAD, TAIL = 1, 2


class Units:
    """The words of some rows: of unit u the letters start[u]:start[u + 1]; unit[i] occurs in row[i], sentence[i]."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, sentences: bool = False):
        words = T.Words(raw, offs)
        row = words.rows()
        _, head, of = np.unique(words.hash, return_index=True, return_inverse=True)
        token, at = T.gathered(raw, words.start[head], words.end[head] - words.start[head])
        tokens = np.repeat(np.arange(len(head)), np.diff(at))
        keep = LETTER[token] & ~LEAD[token]
        letters = [token[keep]]
        sizes = [np.bincount(tokens[keep], minlength=len(head))]
        unit, rows, place = [of], [row], [np.arange(len(of))]
        # parts of tokens with signs inside
        start, end, first = T.spans(token, at, ~LETTER)
        long = end - start >= LEAST
        many = np.bincount(np.searchsorted(at, start[long], "right") - 1, minlength=len(head))
        own = np.searchsorted(at, start, "right") - 1
        part = np.flatnonzero(long & (many[own] > 0) & (np.diff(first)[own] > 1))
        if len(part):
            data, cut = T.gathered(token, start[part], end[part] - start[part])
            good = ~LEAD[data]
            letters.append(data[good])
            sizes.append(np.bincount(np.repeat(np.arange(len(part)), np.diff(cut))[good], minlength=len(part)))
            by = np.searchsorted(own[part], np.arange(len(head) + 1))
            count = np.diff(by)[of]
            which = np.arange(count.sum()) + np.repeat(by[:-1][of] - np.append(0, np.cumsum(count)[:-1]), count)
            unit.append(which + len(head))
            rows.append(np.repeat(row, count))
            place.append(np.repeat(np.arange(len(of)), count))
        # words spelled out in single letters
        single = sizes[0][of] == 1
        step = single & np.append(False, single[:-1]) & np.append(False, row[1:] == row[:-1])
        begin = np.flatnonzero(single & ~step)
        run = np.add.reduceat(single.astype(np.int64), begin) if len(begin) else begin
        stop = np.append(begin[1:], len(of)) if len(begin) else begin
        spelled = begin[run >= LEAST]
        if len(spelled):
            size = run[run >= LEAST]
            member, _ = T.gathered(of, spelled, size)
            one = np.append(0, np.cumsum(sizes[0]))[:-1]
            letters.append(letters[0][one[member]])
            sizes.append(size)
            base = sum(len(x) for x in sizes[:-1])
            unit.append(np.arange(len(spelled)) + base)
            rows.append(row[spelled])
            place.append(spelled)
        self.unit, self.row = np.concatenate(unit), np.concatenate(rows)
        self.letters = np.concatenate(letters)
        self.start = np.append(0, np.cumsum(np.concatenate(sizes)))
        if sentences:
            after = np.minimum(words.end, len(raw) - 1)
            last = ENDS[raw[words.end - 1]] | (raw[after] == 0x0A) if len(words) else np.empty(0, bool)
            number = np.append(0, np.cumsum(last)[:-1]) if len(words) else np.empty(0, np.int64)
            self.sentence = number[np.concatenate(place)]


def _marked(letters: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The units with a mark before and after each, and each symbol's unit."""
    n = len(start) - 1
    unit = np.repeat(np.arange(n), np.diff(start) + 2)
    text = np.full(len(letters) + 2 * n, HEAD, np.uint8)
    text[np.arange(len(letters)) + 1 + 2 * np.repeat(np.arange(n), np.diff(start))] = letters
    text[start[1:] + 2 * np.arange(n) + 1] = TAIL
    return text, unit


def subsequences(letters: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Hashed subsequences, their units and their weight, for each combination of gaps."""
    text, unit = _marked(letters, start)
    wide = text.astype(np.uint32)
    for a in range(GAP + 1):
        for b in range(GAP + 1):
            n = len(text) - 2 - a - b
            if n > 0:
                packed = (wide[:n] << np.uint32(16)) | (wide[1 + a : 1 + a + n] << np.uint32(8)) | wide[2 + a + b :]
                inside = unit[:n] == unit[2 + a + b :]
                yield ((packed[inside] * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64), unit[:n][inside], DECAY ** (a + b)


def norms(size: np.ndarray) -> np.ndarray:
    """The length of a unit's subsequence vector, by its number of letters."""
    total = np.zeros(len(size))
    for a in range(GAP + 1):
        for b in range(GAP + 1):
            total += np.maximum(size - a - b, 0) * DECAY ** (2 * (a + b))
    return np.sqrt(np.maximum(total, 1e-9))


def evidence(value: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Of each document, from its words' values: the worst, the sum of those above DOUBT and its density, as logarithms."""
    peak = np.full(rows, -1.0)
    np.maximum.at(peak, row, value)
    above = np.bincount(row, np.clip((value - DOUBT) / (1 - DOUBT), 0, 1), rows)
    words = np.bincount(row, minlength=rows)
    return np.stack([np.ones(rows), peak, np.log1p(4 * above), np.log((above + 0.2) / (words + 40))], 1)


@dataclass
class Machine:
    weights: np.ndarray  # of hashed subsequences
    bias: float
    odds: np.ndarray  # coefficients of a document's evidence

    def values(self, letters: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The machine's decision on each unit; units without letters are plain negatives."""
        total = np.zeros(len(start) - 1)
        for lo, hi in T.pieces(start, UNITS):
            for found, unit, weight in subsequences(letters[start[lo] : start[hi]], start[lo : hi + 1] - start[lo]):
                total[lo:hi] += weight * np.bincount(unit, self.weights[found], hi - lo)
        size = np.diff(start)
        return np.where(size > 0, total / norms(size) + self.bias, -1.0)

    def scores(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        units = Units(raw, offs)
        found = evidence(self.values(units.letters, units.start)[units.unit], units.row, len(offs) - 1)
        return 1 / (1 + np.exp(-np.clip(found @ self.odds, -30, 30)))


def _kernels(letters: np.ndarray, start: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalised kernels of all units with the landmark units; one combination of gaps is held at a time."""
    size = norms(np.diff(start)).astype(np.float32)
    parts = [(h, u, np.full(len(h), w)) for h, u, w in subsequences(*T.gathered(letters, start[landmarks], np.diff(start)[landmarks]))]
    found, unit, weight = (np.concatenate(x) for x in zip(*parts))
    columns, at = np.unique(found, return_inverse=True)
    table = np.zeros((len(columns), len(landmarks)), np.float32)
    np.add.at(table, (at, unit), weight / size[landmarks][unit])
    out = np.zeros((len(start) - 1, len(landmarks)), np.float32)
    for found, unit, weight in subsequences(letters, start):
        at = np.minimum(np.searchsorted(columns, found), len(columns) - 1)
        hit = columns[at] == found
        at, unit = at[hit], unit[hit]
        for lo in range(0, len(at), ROWS):
            part = slice(lo, lo + ROWS)
            head = np.flatnonzero(np.append(True, unit[part][1:] != unit[part][:-1]))
            own = unit[part][head]
            out[own] += np.add.reduceat(table[at[part]], head) * (np.float32(weight) / size[own])[:, None]
    return out


def _weights(letters: np.ndarray, start: np.ndarray, landmarks: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """The table of subsequence weights that gives each unit the sum of alpha times its landmark kernels."""
    letters, start = T.gathered(letters, start[landmarks], np.diff(start)[landmarks])
    share = alpha / norms(np.diff(start))
    out = np.zeros(1 << BITS)
    for found, unit, weight in subsequences(letters, start):
        out += weight * np.bincount(found, share[unit], 1 << BITS)
    return out


def _inserted(letters: np.ndarray, start: np.ndarray, units: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """All units, and after them VARIANTS of each of some with a random letter put in at a random place within."""
    extra = []
    for u in np.repeat(units, VARIANTS):
        word = letters[start[u] : start[u + 1]]
        extra.append(np.insert(word, rng.integers(1, len(word)), rng.integers(0x61, 0x7B)))
    return np.concatenate([letters, *extra]).astype(np.uint8), np.append(start, start[-1] + np.cumsum([len(x) for x in extra], dtype=np.int64))


def _unlike(unit: np.ndarray, doc: np.ndarray, head: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The first document of each group of near copies with one label: those whose two least sentence hashes are equal,
    so that one line in common makes no copies. Occurrences are in order of sentences, which begin at head."""
    hashes = T.mix(np.add.reduceat(T.mix(unit.astype(np.uint64) + T.U64(1)), head))
    own = doc[head]
    order = np.lexsort((hashes, own))
    begin = np.flatnonzero(np.append(True, np.diff(own[order]) != 0))
    last = np.append(begin[1:], len(order)) - 1
    key = np.stack([hashes[order[begin]], hashes[order[np.minimum(begin + 1, last)]], toxic[own[order[begin]]].astype(np.uint64)], 1)
    keep = np.zeros(len(toxic), bool)
    keep[own[order[begin]][np.unique(key, axis=0, return_index=True)[1]]] = True
    return keep


def _ranks(score: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Each sentence's place among those of its document, the highest score first; doc is in order."""
    by = np.lexsort((-score, doc))
    out = np.empty(len(by), np.int64)
    out[by] = np.arange(len(by)) - np.searchsorted(doc, doc[by])
    return out


def _features(letters: np.ndarray, start: np.ndarray, landmarks: np.ndarray, unit: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each sentence its kernels with the landmarks (the sums of its units' kernels), whitened, and what whitens them."""
    used, back = np.unique(unit, return_inverse=True)
    marks, cut = T.gathered(letters, start[landmarks], np.diff(start)[landmarks])
    square = _kernels(marks, cut, np.arange(len(landmarks))).astype(np.float64)
    root, axes = np.linalg.eigh((square + square.T) / 2)
    whiten = (axes * (1 / np.sqrt(np.maximum(root, 1e-3)))).astype(np.float32)
    out = np.zeros((rows, len(landmarks)), np.float32)
    order = np.lexsort((row, back // ROWS))
    back, row = back[order], row[order]
    for lo in range(0, len(used), ROWS):
        own = np.concatenate([used[lo : lo + ROWS], landmarks])
        part, cut = T.gathered(letters, start[own], np.diff(start)[own])
        kernels = _kernels(part, cut, len(own) - len(landmarks) + np.arange(len(landmarks)))
        a, b = np.searchsorted(back // ROWS, [lo // ROWS, lo // ROWS + 1])
        for at in range(a, b, ROWS):
            rows_, units = row[at : min(at + ROWS, b)], back[at : min(at + ROWS, b)] - lo
            head = np.flatnonzero(np.append(True, rows_[1:] != rows_[:-1]))
            out[rows_[head]] += np.add.reduceat(kernels[units], head)
    for lo in range(0, rows, ROWS):
        out[lo : lo + ROWS] = out[lo : lo + ROWS] @ whiten
    return out, whiten


def _machine(x: np.ndarray, sign: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The linear machine of least squared hinge loss, its bias last."""
    w = np.zeros(x.shape[1] + 1)
    margin = lambda w: sign * (x @ w[:-1].astype(np.float32) + w[-1])
    loss = lambda w: (weight * np.maximum(1 - margin(w), 0) ** 2).sum() + RIDGE * (w @ w)
    for _ in range(STEPS):  # Newton's method, with shorter steps where they gain more
        mass = np.where(margin(w) < 1, weight, 0).astype(np.float32)
        curve, slope = RIDGE * np.eye(len(w)), np.append((mass * sign) @ x, (mass * sign).sum())
        for lo in range(0, len(x), ROWS):
            own = lo + np.flatnonzero(mass[lo : lo + ROWS])
            curve[:-1, :-1] += (x[own] * mass[own, None]).T @ x[own]
        curve[-1, :-1] = curve[:-1, -1] = mass @ x
        curve[-1, -1] += mass.sum()
        to = np.linalg.solve(curve, slope)
        best = min((w + k * (to - w) for k in (1, 0.5, 0.25, 0.1, 0.03)), key=loss)
        if loss(best) >= loss(w) - 1e-9:
            break
        w = best
    return w


def train(unit: np.ndarray, doc: np.ndarray, sentence: np.ndarray, letters: np.ndarray, start: np.ndarray, toxic: np.ndarray, offset: float = 0.0) -> Machine:
    """unit, doc and sentence of each word's occurrence; toxic: each document's label; offset: what the log-odds of all
    labelled documents have more than those of these."""
    n, many = len(start) - 1, len(toxic)
    if not n or not toxic.any() or toxic.all():
        share = toxic.mean() if many else 0.0
        return Machine(np.zeros(1 << BITS), -1.0, np.array([np.log((share + 1e-9) / (1 - share + 1e-9)), 0, 0, 0]))
    rng = np.random.default_rng(SEED)
    order = np.lexsort((unit, sentence))
    unit, doc, sentence = unit[order], doc[order], sentence[order]
    keep = _unlike(unit, doc, np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1])), toxic)[doc]
    unit, doc, sentence = unit[keep], doc[keep], sentence[keep]
    own, doc = np.unique(doc, return_inverse=True)
    toxic, many = toxic[own], len(own)
    head = np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1]))
    size, of = np.diff(np.append(head, len(unit))), doc[head]
    bad = toxic[of]
    # landmarks: words that toxic documents have more often than others, common ones, and some of the rest
    both = np.unique(doc.astype(np.int64) * n + unit)
    seen = [np.bincount((both % n)[toxic[both // n] == x], minlength=n) for x in (True, False)]
    usual = toxic.mean()
    excess = seen[0] * ((seen[0] + PRIOR * usual) / (seen[0] + seen[1] + PRIOR) - usual)
    third = LANDMARKS // 3
    telling = np.argsort(-excess, kind="stable")[:third]
    common = np.setdiff1d(np.argsort(-seen[1], kind="stable")[:third], telling)
    others = np.setdiff1d(np.flatnonzero(np.diff(start) > 1), np.concatenate([telling, common]))
    drawn = rng.choice(others, min(len(others), third), replace=False)
    clean = np.flatnonzero(~bad)
    negative = np.zeros(len(unit), bool)
    machine, value = None, None
    for _ in range(ROUNDS):
        more, cut = letters, start
        if machine is None:
            # all sentences of documents labelled 1, and some of the others, each with all its words
            chosen = np.append(np.flatnonzero(bad), rng.choice(clean, min(len(clean), NEGATIVES), replace=False))
            chosen.sort()
            inside = np.repeat(np.isin(np.arange(len(head)), chosen), size)
            units, row = unit[inside], np.repeat(np.arange(len(chosen)), size[chosen])
            sign = np.where(bad[chosen], 1.0, -1.0)
            # documents labelled 1 weigh alike, however many sentences they have
            weight = np.where(bad[chosen], BALANCE / toxic.sum() / np.bincount(of, minlength=many)[of[chosen]], (1 - BALANCE) / max((~bad[chosen]).sum(), 1))
        else:
            # a sentence is as toxic as its worst word, which stands for it: of documents labelled 1, sentences that the
            # machine takes for toxic, of others the worst ones
            score = np.maximum.reduceat(value[unit], head)
            decides = value[unit] == np.repeat(score, size)
            rank = _ranks(score, of)
            positive = decides & np.repeat(bad & (score > 0), size)
            if not positive.any():
                break
            # earlier rounds' negatives stay, or the machine would forget ordinary words
            negative |= decides & np.repeat(~bad & (rank < WORST), size)
            words = [np.unique(unit[positive | negative]), np.unique(unit[positive][np.diff(start)[unit[positive]] > LEAST])]
            more, cut = _inserted(letters, start, words[1], rng)
            altered = np.arange(n, len(cut) - 1)
            count = [np.bincount(unit[x], minlength=n)[words[0]] for x in (positive, negative)]
            units = np.concatenate([words[0], words[0], altered])
            sign = np.repeat([1.0, -1.0, 1.0], [len(words[0]), len(words[0]), len(altered)])
            weight = np.concatenate([BALANCE * count[0] / max(count[0].sum(), 1), (1 - BALANCE) * count[1] / max(count[1].sum(), 1), np.full(len(altered), ALTERED / max(len(altered), 1))])
            units, sign, weight = units[weight > 0], sign[weight > 0], weight[weight > 0]
            row = np.arange(len(units))
        landmarks = np.unique(np.concatenate([telling, common, drawn]))
        x, whiten = _features(more, cut, landmarks, units, row, len(sign))
        w = _machine(x, sign, weight)
        del x
        machine = Machine(_weights(letters, start, landmarks, whiten @ w[:-1]), float(w[-1]), np.zeros(4))
        value = machine.values(letters, start)
        # the next round's drawn landmarks are words of clean documents that this machine takes for toxic
        wrong = np.flatnonzero((value > -0.5) & (seen[1] > 0))
        drawn = wrong[np.argsort(-(value[wrong] + 1) * np.sqrt(seen[1][wrong]), kind="stable")][:third] if len(wrong) >= third // 2 else drawn
    found = evidence(value[unit], doc, many)
    odds = np.zeros(found.shape[1])
    cost = lambda c: np.logaddexp(0, found @ c * np.where(toxic, -1, 1)).sum() + 0.05 * (c @ c)
    for _ in range(100):  # Newton's method on the logistic loss, with a slight ridge
        p = 1 / (1 + np.exp(-np.clip(found @ odds, -30, 30)))
        slope = found.T @ (p - toxic) + 0.1 * odds
        to = np.linalg.solve((found * (p * (1 - p))[:, None]).T @ found + 0.1 * np.eye(len(odds)), slope)
        best = min((odds - k * to for k in (1, 0.5, 0.25, 0.1, 0.03, 0.01)), key=cost)
        if cost(best) >= cost(odds) - 1e-6:
            break
        odds = best
    return Machine(machine.weights, machine.bias, odds + np.array([offset, 0, 0, 0]))


def _lower(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return T.strings(pc.utf8_lower(column))


def learned(docs: DataFrame, labels: DataFrame, n: int = SAMPLE) -> Machine:
    """The machine, trained by one task on the bounded sample; only the machine comes to the driver."""
    chosen, offset = labelled(docs, labels, "toxic", FOLDS, FOLD, n)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = _lower(batch.column("text"))
            for lo, hi in T.pieces(offs, UNITS):
                units = Units(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], sentences=True)
                key = _bounded(np.unique(np.stack([units.row, units.sentence, units.unit], 1), axis=0), OCCURRENCES)
                cut = pa.array(np.searchsorted(key[:, 0], np.arange(hi - lo + 1)).astype(np.int32))
                words = T.string_array(units.letters, units.start).cast(pa.binary()).take(pa.array(key[:, 2]))
                lists = (pa.ListArray.from_arrays(cut, x) for x in (pa.array(key[:, 1].astype(np.int32)), words))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo), *lists], ["doc_id", "label", "sentences", "words"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("sentences", pa.list_(pa.int32())), ("words", pa.list_(pa.binary()))]))
        if rows.num_rows:
            made = list(_occurrences(rows.sort_by("doc_id").combine_chunks()))
            del rows
            found = train(*(made.pop(0) for _ in range(6)), offset)  # nothing else holds what train() reworks
            yield pa.RecordBatch.from_arrays([pa.array([found.weights.astype("<f8").tobytes()], pa.binary()), pa.array([found.bias]), pa.array([found.odds.tolist()])], ["weights", "bias", "odds"])

    parts = chosen.select("doc_id", "label", "text").mapInArrow(T.lean(gather), "doc_id long, label int, sentences array<int>, words array<binary>")
    found = next(iter(parts.repartition(1).mapInArrow(T.lean(fit), "weights binary, bias double, odds array<double>").collect()), None)
    if found is None:
        return train(*(np.empty(0, np.int64) for _ in range(3)), np.empty(0, np.uint8), np.zeros(1, np.int64), np.empty(0, bool))
    return Machine(np.frombuffer(found.weights, "<f8"), found.bias, np.array(found.odds))


def _bounded(key: np.ndarray, most: int) -> np.ndarray:
    """Rows of (document, sentence, word), in order: of documents with more than most, only those of sentences that
    have the least hashes of their numbers."""
    many = np.bincount(key[:, 0]) if len(key) else np.empty(0, np.int64)
    keep = np.ones(len(key), bool)
    for d in np.flatnonzero(many > most):
        a, b = np.searchsorted(key[:, 0], [d, d + 1])
        order = np.argsort(T.mix(key[a:b, 1].astype(T.U64)), kind="stable")
        keep[a + order[most:]] = False
    return key[keep]


def _occurrences(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """What train() takes, from doc_id, label and lists of sentences and words; copies, so that Arrow's memory goes."""
    doc = np.repeat(np.arange(rows.num_rows, dtype=np.int32), pc.list_value_length(rows.column("words")).to_numpy())
    own = pc.list_flatten(rows.column("sentences")).to_numpy()
    # sentences are numbered through: a new one wherever the document or the number within it changes
    sentence = np.cumsum(np.append(True, (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])), dtype=np.int32)
    words = pc.dictionary_encode(pc.list_flatten(rows.column("words")).combine_chunks())
    letters, start = T.strings(words.dictionary)
    return words.indices.to_numpy().copy(), doc, sentence, letters.copy(), start.copy(), rows.column("label").to_numpy() > 0


def scored(docs: DataFrame, labels: DataFrame, n: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("held_out", held_out(FOLDS, FOLD))
    sent = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, n))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _scores(sent.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return texts.mapInArrow(T.lean(score), "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, n: int = SAMPLE) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, n))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(sent.value, batch.column(at)) < THRESHOLD))

    return docs.mapInArrow(T.lean(keep), docs.schema)


def _scores(machine: Machine, text: pa.Array) -> np.ndarray:
    raw, offs = _lower(text)
    parts = [machine.scores(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]) for lo, hi in T.pieces(offs)]
    return np.concatenate(parts) if parts else np.empty(0)
