"""Suffix arrays by induced sorting, one numpy call for each bucket instead of each suffix, and permuted common prefixes.

Suffixes are S (smaller than their successor) or L; a leftmost S (LMS) follows an L. Sorted LMS suffixes induce all
L suffixes in one sweep over the buckets upwards and these all S suffixes in one downwards; within a bucket, a round
handles what the round before has put there (runs of one character). LMS substrings are sorted by the same sweeps,
named, and the string of names is sorted recursively until all names differ. A sweep costs a few numpy calls for each
character, so names of too many kinds are written as two digits each, which keeps their order and leaves an alphabet of the
root of their number. Suffixes that their own name decides aren't sorted again.

Common prefixes of neighbours are computed in the order of the text: where a suffix and its neighbour follow equal
characters, theirs is one less than that of the suffix before; only the others are compared.
"""

from __future__ import annotations

import numpy as np

from . import _text as T

#: Suffixes that are put in their places one by one.
FEW = 12
#: An alphabet may have a character for so many places of the string, and MOST in any string.
SPARSE, MOST = 256, 16
#: Names are written as digits if at most this share of them are leftmost S then; others have many characters for once.
SHORTER = 0.9
#: Characters of a common prefix that are compared for all suffixes together; longer ones follow one by one.
TOGETHER = 512


def _placed(sa: np.ndarray, at: np.ndarray, t: np.ndarray, p: np.ndarray, step: int) -> None:
    """Puts suffixes p, in order, at the heads (step 1) or tails (-1) of their buckets."""
    n = len(p)
    if n <= FEW:
        for x in p.tolist():
            c = t[x]
            sa[at[c] if step > 0 else at[c] - 1] = x
            at[c] += step
        return
    chars = t[p]
    order = chars.argsort(kind="stable")
    chars, p = chars[order], p[order]
    cut = (chars[1:] != chars[:-1]).nonzero()[0]
    head = np.zeros(len(cut) + 1, np.int64)
    head[1:] = cut + 1
    size = np.empty(len(head), np.int64)
    size[:-1], size[-1] = head[1:] - head[:-1], n - head[-1]
    own = chars[head]
    to = at[own]
    if step > 0:
        sa[(to - head).repeat(size) + np.arange(n)] = p
    else:
        sa[(to - 1 + head).repeat(size) - np.arange(n)] = p
    at[own] = to + step * size


def _induced(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes in order, from LMS suffixes in order (or, to sort LMS substrings, in any)."""
    count = np.bincount(t, minlength=sigma)
    end = np.cumsum(count)
    start = end - count
    used = np.flatnonzero(count).tolist()
    lms = lms[np.argsort(t[lms], kind="stable")]
    cut = np.searchsorted(t[lms], np.arange(sigma + 1)).tolist()
    sa = np.full(len(t), -1, np.int64)
    at, first, last = start.copy(), start.tolist(), end.tolist()
    # before the first character there is none: place -1, which is the last one's, is of neither type
    large, small = ~s_type, s_type.copy()
    small[-1] = False
    for c in used:
        lo = first[c]
        while lo < (hi := int(at[c])):
            p = sa[lo:hi] - 1
            p, lo = p[large[p]], hi
            if len(p):
                _placed(sa, at, t, p, 1)
        if cut[c] < cut[c + 1]:
            _placed(sa, at, t, lms[cut[c] : cut[c + 1]] - 1, 1)
    l_end, at = at.tolist(), end.copy()
    sa[0], at[0] = len(t) - 1, 0
    for c in used[::-1]:
        hi = last[c]
        while c and (lo := int(at[c])) < hi:
            p = sa[lo:hi][::-1] - 1
            p, hi = p[small[p]], lo
            if len(p):
                _placed(sa, at, t, p, -1)
        if first[c] < l_end[c]:
            p = sa[first[c] : l_end[c]][::-1] - 1
            p = p[small[p]]
            if len(p):
                _placed(sa, at, t, p, -1)
    return sa


def _leftmost(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are S, and the leftmost ones."""
    rise = np.flatnonzero(t[1:] != t[:-1])  # the last place of each run
    s_type = np.zeros(len(t), bool)
    s_type[: rise[-1] + 1] = np.repeat(t[rise + 1] > t[rise], np.diff(np.append(-1, rise)))
    s_type[-1] = True
    return s_type, np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1


def _names_sorted(name: np.ndarray) -> np.ndarray:
    """The suffixes of a string of names in order; its last name is 0, which is nowhere else.

    A name that stands once decides its suffix's place. Of neighbouring ones only the first is still needed, to end the
    comparisons of the suffixes before it, so the others aren't sorted."""
    count = np.bincount(name)
    once = count[name] == 1
    stays = ~once
    stays[1:] |= ~once[:-1]
    stays[-1] = True
    left = np.flatnonzero(stays)
    there = np.zeros(len(count), bool)
    there[name[left]] = True
    order = left[_sorted((np.cumsum(there) - 1)[name[left]])]
    out, free = np.empty(len(name), np.int64), np.ones(len(name), bool)
    own = (np.cumsum(count) - count)[name[once]]
    out[own], free[own] = np.flatnonzero(once), False
    out[free] = order[~once[order]]
    return out


def _sorted(name: np.ndarray) -> np.ndarray:
    many = int(name.max()) + 1
    if many <= max(MOST, len(name) // SPARSE):
        return suffix_array(name)
    base = int(np.ceil(np.sqrt(many)))
    digits = np.zeros(2 * len(name) + 1, np.int64)
    digits[:-1:2], digits[1::2] = name // base + 1, name % base + 1
    if len(_leftmost(digits)[1]) > SHORTER * len(name):
        return suffix_array(name)
    order = suffix_array(digits)
    return order[(order % 2 == 0) & (order < 2 * len(name))] // 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffixes of t in order; t must end in 0 and have it nowhere else."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    sigma = int(t.max()) + 1
    t = t.astype(np.int16 if sigma < 1 << 15 else np.int32)
    s_type, lms = _leftmost(t)
    if len(lms) > 1:
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = _induced(t, s_type, lms, sigma)
        order = order[is_lms[order]]
        place = (np.cumsum(is_lms) - 1)[order]
        size = np.append(lms[1:] + 1, n)[place] - order
        same = size[1:] == size[:-1]
        same[same] = T.alike(t, order[:-1][same], order[1:][same], size[1:][same])
        name = np.zeros(len(lms), np.int64)
        name[place] = np.cumsum(np.append(False, ~same))
        lms = lms[_names_sorted(name)] if name.max() < len(lms) - 1 else order
    return _induced(t, s_type, lms, sigma)


def permuted_prefixes(data: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each suffix of data (bytes, the last one nowhere else), in the order of the text: the one before it in the
    suffix array (-1 for the first), and the length of their common prefix."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    prior = np.maximum(before, 0) - 1
    own = np.flatnonzero((before < 0) | (prior < 0) | (np.arange(n) == 0) | (data[np.arange(n) - 1] != data[prior]))
    words = np.ndarray((n,), "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))
    size = np.zeros(n, np.int64)
    i = own[before[own] >= 0]
    for k in range(0, TOGETHER, 8):
        if not len(i):
            break
        differs = words[i + k] ^ words[before[i] + k]
        done = differs != 0
        low = differs[done]
        size[i[done]] = k + np.bitwise_count((low & (~low + T.U64(1))) - T.U64(1)).astype(np.int64) // 8
        i = i[~done]
    for a in i.tolist():
        x, y, step = a + TOGETHER, int(before[a]) + TOGETHER, 1 << 12
        while True:
            length = min(step, n - max(x, y))
            other = data[x : x + length] != data[y : y + length]
            if other.any():
                size[a] = x + int(other.argmax()) - a
                break
            x, y = x + length, y + length
    last = np.zeros(n, np.int64)
    last[own] = own
    last = np.maximum.accumulate(last)
    return before, size[last] - (np.arange(n) - last)


def repeated(raw: np.ndarray, offs: np.ndarray, length: int) -> np.ndarray:
    """Whether the stretch of length bytes from each byte on, within its string, also starts anywhere else. The
    strings are UTF-8, in which the bytes 254 and 255 don't occur: these stand for the ends."""
    n = len(offs) - 1
    at = np.arange(len(raw)) + np.repeat(np.arange(n), np.diff(offs))
    data = np.full(len(raw) + n + 1, 255, np.uint8)
    data[at] = raw
    data[-1] = 254
    t = data.astype(np.int16) + 2
    t[data == 255], t[-1] = 1, 0
    room = np.zeros(len(data), np.int64)
    room[at] = np.repeat(offs[1:], np.diff(offs)) - np.arange(len(raw))
    before, size = permuted_prefixes(data, suffix_array(t))
    i = np.flatnonzero((size >= length) & (room >= length))
    found = np.zeros(len(data), bool)
    found[i] = found[before[i]] = True
    return found[at]
