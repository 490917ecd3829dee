"""Vectorised fingerprints: rolling hashes of bytes (uint8) and words, word boundaries, and sliding minima."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_RNG = np.random.default_rng(20240131)
#: Fingerprints are polynomials modulo this prime, at bases drawn from all its residues: two different sequences of n
#: values agree for n of 2**61 bases at most, whatever their structure.
_PRIME = (1 << 61) - 1
_BASES = [int(x) for x in _RNG.integers(1 << 32, _PRIME, 2)]
_POWERS = {}
_P, _LOW32, _LOW29 = _U(_PRIME), _U((1 << 32) - 1), _U((1 << 29) - 1)
_61, _32, _29, _3 = _U(61), _U(32), _U(29), _U(3)
#: Values worked on at a time, so that what is between two steps stays in the processor's cache.
_STEP = 1 << 15

#: White space of `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x):
    """Spread all bits of 64-bit values (finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _fold(x):
    """x modulo the prime, but for x = prime."""
    return (x & _P) + (x >> _61)


def _times(a, high, low):
    """a * (high * 2**32 + low) modulo the prime, below 2**61 + 8; a below 2**62, high below 2**29."""
    a = _fold(a)
    a1, a0 = a >> _32, a & _LOW32
    part = a0 * low
    middle = a1 * low
    middle += a0 * high
    out = part >> _61
    part &= _P
    out += part
    np.multiply(a1, high, out=part)
    part <<= _3
    out += part
    np.right_shift(middle, _29, out=part)
    out += part
    middle &= _LOW29
    middle <<= _32
    out += middle
    return _fold(out)


def _powers(k, n):
    """((high, low) of the powers of base k, likewise of its inverse), n of each at least."""
    up, down = _POWERS.get(k, (None, None))
    if up is None or len(up[0]) < n:
        both = []
        for base in (_BASES[k], pow(_BASES[k], -1, _PRIME)):
            p = np.ones(1, _U)
            while len(p) < max(n, 1 << 16):
                step = pow(base, len(p), _PRIME)
                more = np.concatenate([_times(p[a : a + _STEP], _U(step >> 32), _U(step & 0xFFFFFFFF)) for a in range(0, len(p), _STEP)])
                p = np.concatenate([p, more])
            both.append((p >> _32, p & _LOW32))
        up, down = _POWERS[k] = tuple(both)
    return up, down


def prefix(values, k):
    """Prefix sums of values[i] * base_k**i modulo the prime (or a little above it), with a leading zero."""
    (high, low), _ = _powers(k, len(values) + 1)
    out = np.empty(len(values) + 1, _U)
    out[0] = before = _U(0)
    for a in range(0, len(values), _STEP):
        v = values[a : a + _STEP]
        b = a + len(v)
        if v.dtype == np.uint8:
            v = v.astype(_U) + _U(1)
            most, least = np.cumsum(v * high[a:b]), np.cumsum(v * low[a:b])
        else:
            v = _times(_fold(v), high[a:b], low[a:b])
            most, least = np.cumsum(v >> _32), np.cumsum(v & _LOW32)
        total = most >> _29
        most &= _LOW29
        most <<= _32
        total += most
        total += _fold(least)
        total += before
        out[a + 1 : b + 1] = total = _fold(total)
        before = total[-1]
    return out


def spans(pre, start, end, k):
    """Fingerprints of values[start:end] for arrays of starts and ends; equal sequences have equal ones anywhere."""
    _, (high, low) = _powers(k, len(pre))
    out = np.empty(len(start), _U)
    for a in range(0, len(start), _STEP):
        s = start[a : a + _STEP]
        d = pre[end[a : a + _STEP]] + (_P + _P)
        d -= pre[s]
        d = _times(d, high[s], low[s])
        d[d >= _P] -= _P
        out[a : a + _STEP] = mix(d)
    return out


def byte_prefix(data, k):
    return prefix(data, k)


def words(data, offs):
    """(starts, ends, doc) of the words of concatenated texts; white space is ASCII, and texts don't run together."""
    solid = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs[:-1]] = True
    if len(data) == 0:
        return (np.zeros(0, np.int64),) * 3
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    last = np.zeros(len(data) + 1, bool)
    last[offs[1:]] = True
    ends = np.flatnonzero(solid & (~after | last[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def doc_bounds(doc, n):
    """Offsets of each document's run in a sorted array of document numbers."""
    return np.searchsorted(doc, np.arange(n + 1))


def sliding_min(x, w):
    """Minimum of each x[i:i+w]."""
    if len(x) < w:
        return x[:0]
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def run_cover(starts, length, size):
    """Mask of the `size` positions covered by [s, s+length) for each s."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, size), -1)
    return np.cumsum(edge[:-1]) > 0


def repeated(keys):
    """(seen_before, seen_elsewhere) masks of equal keys, in array order."""
    n = len(keys)
    before, many = np.zeros(n, bool), np.zeros(n, bool)
    if n < 2:
        return before, many
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    before[order[1:][same]] = True
    many[order[1:][same]] = True
    many[order[:-1][same]] = True
    return before, many
