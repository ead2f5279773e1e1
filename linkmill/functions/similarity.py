"""String similarities (S01-S07). The scorers without a built-in are one Arrow-batched UDF for all of them,
which takes a batch of pairs at once.

Values are in [0, 1]. Empty strings: ratio and its partial form of two empty strings are 1, of one
empty string 0; the token-set ratio and Jaro-Winkler with an empty side are 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel (Hyyro) on Python's integers."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    mask = (1 << len(a)) - 1
    row = mask
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & mask
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over the lengths."""
    total = len(a) + len(b)
    return 2 * lcs_length(a, b) / total if total else 1.0


def best_stretch(a: str, b: str) -> float:
    """The best ratio of a to a stretch of b that is no longer than a; b is not shorter."""
    n, best = len(a), 0.0
    letters = set(a)
    for start in range(1 - n, len(b)):
        piece = b[max(start, 0) : start + n]
        if piece[0 if start + n > len(b) else -1] not in letters or 2 * len(piece) <= best * (n + len(piece)):
            continue
        best = max(best, ratio(a, piece))
    return best


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string to a stretch of the longer, no longer than itself; of two equally
    long strings the better of both directions."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    if a in b:
        return 1.0
    best = best_stretch(a, b)
    return max(best, best_stretch(b, a)) if len(a) == len(b) else best


def token_sort_ratio(a: str, b: str) -> float:
    """S03."""
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """S04."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = x & y
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and not (left and right):
        return 1.0
    shared = " ".join(sorted(both))
    first, second = (f"{shared} {left}".strip(), f"{shared} {right}".strip())
    best = ratio(first, second)
    if shared:
        for one in (first, second):
            best = max(best, 2 * len(shared) / (len(shared) + len(one)))
    return best


def jaro_winkler(a: str, b: str) -> float:
    """Prefix weight 0.1, at most four characters."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                matched.append(c)
                break
    m = len(matched)
    if not m:
        return 0.0
    half = sum(c != d for c, d in zip(matched, (b[j] for j in range(len(b)) if used[j]), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    prefix = 0
    for c, d in zip(a[:4], b[:4], strict=False):
        if c != d:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


SCORERS = {"ratio": ratio, "partial": partial_ratio, "tsort": token_sort_ratio, "tset": token_set_ratio, "jw": jaro_winkler}

# Many pairs at once: the same values as above, with a lane of 64-bit words for each pair.
FULL = np.uint64(2**64 - 1)
#: Entries of the tables of places, and lanes, that are held at a time.
MOST_PLACES, MOST_LANES = 1 << 22, 1 << 17


class Strings:
    """The characters of a list of strings as small codes, one behind the other."""

    def __init__(self, texts: list[str]):
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letters, self.codes = np.unique(points, return_inverse=True)
        self.n_letters = max(len(letters), 1)
        self.size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.first = np.cumsum(self.size) - self.size


def places(s: Strings, ids: np.ndarray, words: int, backwards: bool = False) -> np.ndarray:
    """For each string of ``ids`` and each letter the bits of its places, in so many words."""
    out = np.zeros((words, len(ids) * s.n_letters), dtype=np.uint64)
    size, first, row = s.size[ids], s.first[ids], np.arange(len(ids)) * s.n_letters
    for i in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > i)
        at = first[has] + (size[has] - 1 - i if backwards else i)
        out[i // 64][row[has] + s.codes[at]] |= np.uint64(1 << i % 64)
    return out


def walk(masks: np.ndarray, row: np.ndarray, codes: np.ndarray, at: np.ndarray, step: int, size: np.ndarray, whole: np.ndarray | None = None) -> np.ndarray:
    """Each lane's common subsequence of the string of its row and the ``size`` characters from ``at``; with ``whole``,
    the lengths of those strings, the best ratio to what was read so far, after any number of characters."""
    order = np.argsort(-size, kind="stable")
    row, at, size = row[order], at[order], size[order]
    rows = [np.full(len(order), FULL) for _ in masks]
    best = np.zeros(len(order))
    ends = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")  # lanes longer than j
    for j, k in enumerate(ends):
        place, carry = row[:k] + codes[at[:k] + step * j], None
        for w, mask in enumerate(masks):
            v = rows[w][:k]
            hit = v & mask[place]
            total = v + hit
            if len(masks) > 1:
                over = total < v
                if carry is not None:
                    total = total + carry
                    over |= total < carry
                carry = over.astype(np.uint64)
            rows[w][:k] = total | (v - hit)
        if whole is not None:
            found = sum(np.bitwise_count(~r[:k]).astype(np.int64) for r in rows)
            best[:k] = np.maximum(best[:k], 2 * found / (whole[order[:k]] + j + 1))
    found = sum(np.bitwise_count(~r).astype(np.int64) for r in rows)
    out = np.empty(len(order), dtype=float if whole is not None else np.int64)
    out[order] = best if whole is not None else found
    return out


def portions(ids: np.ndarray, weights: np.ndarray, most: int) -> list[np.ndarray]:
    """``ids`` in order, cut so that no portion weighs much more than ``most``."""
    return np.split(ids, np.flatnonzero(np.diff(np.cumsum(weights) // most)) + 1) if len(ids) else []


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """lcs_length of each pair."""
    n, s = len(a), Strings([*a, *b])
    x, y = np.arange(n), np.arange(n, 2 * n)
    x, y = np.where(s.size[x] <= s.size[y], x, y), np.where(s.size[x] <= s.size[y], y, x)
    words, out = (s.size[x] + 63) // 64, np.zeros(n, dtype=np.int64)
    for w in np.unique(words[words > 0]):
        ids = np.flatnonzero(words == w)
        for part in portions(ids, np.full(len(ids), int(w) * s.n_letters), MOST_PLACES):
            rows = np.arange(len(part)) * s.n_letters
            out[part] = walk(places(s, x[part], int(w)), rows, s.codes, s.first[y[part]], 1, s.size[y[part]])
    return out


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    total = np.fromiter(map(len, a), np.int64, len(a)) + np.fromiter(map(len, b), np.int64, len(b))
    return np.where(total > 0, 2 * lcs_lengths(a, b) / np.maximum(total, 1), 1.0)


def partial_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Stretches at the start of the longer string are read in one walk, those at its end in one backwards; each one
    of full length is a lane of its own."""
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    out = np.fromiter((float(x in y and (bool(x) or not y)) for x, y in pairs), float, len(pairs))
    todo = [(k, x, y) for k, (x, y) in enumerate(pairs) if x and not out[k]]
    todo += [(k, y, x) for k, x, y in todo if len(x) == len(y)]
    n, s = len(todo), Strings([x for _, x, _ in todo] + [y for _, _, y in todo])
    own, size, long, first = np.array([k for k, _, _ in todo], dtype=np.int64), s.size[:n], s.size[n:], s.first[n:]
    words, lanes = (size + 63) // 64, long - size + 1
    for w in np.unique(words):
        ids = np.flatnonzero(words == w)
        for part in portions(ids, np.maximum(lanes[ids] * (MOST_PLACES // MOST_LANES), int(w) * s.n_letters), MOST_PLACES):
            rows, m, at = np.arange(len(part)) * s.n_letters, size[part], first[part]
            masks = places(s, part, int(w))
            best = walk(masks, rows, s.codes, at, 1, m - 1, m)
            best = np.maximum(best, walk(places(s, part, int(w), True), rows, s.codes, at + long[part] - 1, -1, m - 1, m))
            each = np.repeat(np.arange(len(part)), lanes[part])
            start = np.arange(len(each)) - np.repeat(np.cumsum(lanes[part]) - lanes[part], lanes[part])
            for lane in np.array_split(np.arange(len(each)), -(-len(each) // MOST_LANES)):
                e = each[lane]
                found = walk(masks, rows[e], s.codes, at[e] + start[lane], 1, m[e])
                np.maximum.at(best, e, 2 * found / (2 * m[e]))
            np.maximum.at(out, own[part], best)
    return out


def token_sort_ratios(a: list[str], b: list[str]) -> np.ndarray:
    ordered = {x: " ".join(sorted(x.split())) for x in {*a, *b}}
    return ratios([ordered[x] for x in a], [ordered[x] for x in b])


def token_set_ratios(a: list[str], b: list[str]) -> np.ndarray:
    sets = {x: frozenset(x.split()) for x in {*a, *b}}
    out, rest, shares, firsts, seconds = np.zeros(len(a)), [], [], [], []
    for k, (x, y) in enumerate(zip(map(sets.get, a), map(sets.get, b), strict=True)):
        if not x or not y:
            continue
        both = x & y
        if both and (len(both) == len(x) or len(both) == len(y)):
            out[k] = 1.0
            continue
        shared = " ".join(sorted(both))
        rest.append(k)
        shares.append(len(shared))
        firsts.append(f"{shared} {' '.join(sorted(x - both))}".strip())
        seconds.append(f"{shared} {' '.join(sorted(y - both))}".strip())
    if rest:
        best, shared = ratios(firsts, seconds), np.array(shares)
        for one in (firsts, seconds):
            best = np.where(shared > 0, np.maximum(best, 2 * shared / (shared + np.fromiter(map(len, one), np.int64, len(one)))), best)
        out[rest] = best
    return out


def jaro_winklers(a: list[str], b: list[str]) -> np.ndarray:
    """Strings of up to 64 characters by their bits, longer ones one by one."""
    n, out = len(a), np.zeros(len(a))
    short = np.fromiter((0 < len(x) <= 64 and 0 < len(y) <= 64 and x != y for x, y in zip(a, b, strict=True)), bool, n)
    for k in np.flatnonzero(~short):
        out[k] = jaro_winkler(a[k], b[k])
    s, one = Strings([*a, *b]), np.uint64(1)
    low = np.array([(1 << k) - 1 for k in range(65)], dtype=np.uint64)
    ids = np.flatnonzero(short)
    for part in portions(ids, np.full(len(ids), s.n_letters), MOST_PLACES):
        masks, rows = places(s, n + part, 1)[0], np.arange(len(part)) * s.n_letters
        x, y, x0, y0 = s.size[part], s.size[n + part], s.first[part], s.first[n + part]
        reach = np.maximum(np.maximum(x, y) // 2 - 1, 0)
        mine, theirs, m = np.zeros(len(part), np.uint64), np.zeros(len(part), np.uint64), np.zeros(len(part), np.int64)
        for i in range(int(x.max())):
            k = np.flatnonzero(x > i)
            within = low[np.minimum(y[k], i + reach[k] + 1)] & ~low[np.minimum(np.maximum(i - reach[k], 0), y[k])]
            free = masks[rows[k] + s.codes[x0[k] + i]] & within & ~theirs[k]
            theirs[k] |= free & (~free + one)
            mine[k] |= (free != 0).astype(np.uint64) << np.uint64(i)
            m[k] += free != 0
        odd, p, q = np.zeros(len(part), np.int64), mine.copy(), theirs.copy()
        for i in range(int(m.max())):
            k = np.flatnonzero(m > i)
            at, to = (np.bitwise_count((v[k] & (~v[k] + one)) - one).astype(np.int64) for v in (p, q))
            odd[k] += s.codes[x0[k] + at] != s.codes[y0[k] + to]
            p[k] &= p[k] - one
            q[k] &= q[k] - one
        some = np.maximum(m, 1)
        jaro = np.where(m > 0, (m / x + m / y + (m - odd // 2) / some) / 3, 0.0)
        prefix, same = np.zeros(len(part), np.int64), np.ones(len(part), bool)
        for i in range(4):
            same &= (x > i) & (y > i)
            same[same] = s.codes[x0[same] + i] == s.codes[y0[same] + i]
            prefix += same
        out[part] = np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)
    return out


MANY = {"ratio": ratios, "partial": partial_ratios, "tsort": token_sort_ratios, "tset": token_set_ratios, "jw": jaro_winklers}


def distinct_scores(kind: str, a: list[str], b: list[str]) -> np.ndarray:
    """The scores of all pairs; equal pairs of a batch are scored once."""
    seen: dict[tuple[str, str], int] = {}
    at = np.fromiter((seen.setdefault(pair, len(seen)) for pair in zip(a, b, strict=True)), np.int64, len(a))
    return MANY[kind]([x for x, _ in seen], [y for _, y in seen])[at] if seen else np.zeros(0)


def scores(pairs: dict[str, tuple[str, Column, Column]]) -> Column:
    """One struct with a double for each name: (scorer, left, right). Each pair of strings crosses once."""
    names = list(pairs)
    kinds = [pairs[n][0] for n in names]
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])

    @F.pandas_udf(schema)
    def scored(*columns: pd.Series) -> pd.DataFrame:
        texts = [c.fillna("").tolist() for c in columns]
        return pd.DataFrame({name: distinct_scores(kind, texts[2 * k], texts[2 * k + 1]) for k, (name, kind) in enumerate(zip(names, kinds, strict=True))})

    return scored(*(c for n in names for c in pairs[n][1:]))


def jaccard(a: Column, b: Column) -> Column:
    """Of two lists as sets, 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))
