"""Plain versions of the operators, straight from their contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

SPACED = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(0x41, 0x5B)}

Docs = list[tuple[int, str | None]]


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def op1(docs: Docs, length: int = 200) -> set:
    raw = [(i, (t or "").encode()) for i, t in docs]
    starts: dict[bytes, int] = defaultdict(int)
    for _, b in raw:
        for k in range(len(b) - length + 1):
            starts[b[k : k + length]] += 1
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if starts[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k, x in enumerate(gone) if x and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def op2(docs: Docs, items: list[tuple[int, str | None]], window: int = 13) -> list:
    words = lambda t: ALNUM.findall((t or "").translate(UPPER))
    windows: dict[tuple, set] = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - window, 0) + 1 if w else 0):
            windows[tuple(w[k : k + window])].add(i)
    sizes = {len(k) for k in windows}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[g]
        names = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), sha(names.encode()), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def shingles(text: str | None) -> frozenset:
    w = SPACED.findall((text or "").translate(UPPER).encode())
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def op9(docs: Docs, percent: int = 75) -> list:
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def top(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[top(a)] = top(b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(docs):
        least[top(k)] = min(i, least.get(top(k), i))
    return [(i, len(sets[k]), least[top(k)]) for k, (i, _) in enumerate(docs)]


def op10(docs: Docs, window: int = 13) -> list:
    first: dict[tuple, int] = {}
    split = [(i, SPACED.findall((t or "").encode())) for i, t in docs]
    for i, w in split:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(i, first.get(g, i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def op11(docs: Docs) -> list:
    out = []
    for i, text in docs:
        text = text or ""
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        key = sha(f"1:{'' if i is None else i}".encode())
        h = [int(key[8 * j : 8 * j + 8], 16) for j in range(4)]
        n = len(units)
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
        form = "plain" if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        output = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        out.append((i, n, form, None if form == "plain" else len(p), None if form == "plain" else len(m), sha(output.encode()), sha(text.encode())))
    return out


def op12(docs: list[tuple[str | None, str | None]], least: int = 100, longest: int = 5, top: int = 2000) -> list:
    """docs: language and text."""
    found: dict[str, dict[tuple, int]] = defaultdict(lambda: defaultdict(int))
    words: dict[str, int] = defaultdict(int)
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            w = re.findall(r"[^ \t]+", piece)
            words[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for j in range(len(w) - k + 1):
                    found[lang or "und"][tuple(w[j : j + k])] += 1
    out = []
    for lang, f in found.items():
        own, n = {g: a for g, a in f.items() if a >= least and len(g) > 1}, words[lang]
        inner: dict[tuple, int] = defaultdict(int)
        for g, a in own.items():
            for lo in range(len(g)):
                for hi in range(lo + 2, len(g) + 1):
                    if hi - lo < len(g):
                        inner[g[lo:hi]] = max(inner[g[lo:hi]], a)
        rows = []
        for g, a in own.items():
            if inner[g] < a:
                score, _, l, r = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, rank, g.decode(), -a, l, r, n, -score) for rank, (score, a, g, l, r) in enumerate(sorted(rows)[:top], 1)]
    return out


def op13(docs: Docs) -> list:
    groups: dict[str, list] = defaultdict(list)
    for i, t in docs:
        groups[t or ""].append(i)
    out = []
    for t, own in groups.items():
        own = sorted(own, key=lambda i: (i is not None, i or 0), reverse=True)
        out += [(i, own[0], len(own), k == 0, sha(t.encode())) for k, i in enumerate(own)]
    return out
