"""Suffix arrays by induced sorting in numpy, for a shard of text pieces inside one task.

Suffixes are classified, the substrings between leftmost smaller suffixes are sorted and named, the order of the string of
names is found recursively by doubling, and all other suffixes are induced from it, bucket by bucket, in linear time; whole
buckets at once instead of suffix by suffix. Order is exact for the first `depth` symbols, more is not needed.
"""

from __future__ import annotations

import numpy as np

#: Symbols: 0 separates pieces, UTF-8 byte b is b + 1 (249 at most), PAD stands after the end of a sorted substring.
PAD = 255


def classify(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(small, lms): suffixes smaller than the next one, the last one included, and the leftmost of each run of them."""
    n = len(t)
    differs = np.r_[t[:-1] != t[1:], True]
    nxt = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]  # where the run of equal symbols ends
    small = np.r_[t[:-1] < t[1:], True][nxt]
    lms = np.zeros(n, dtype=bool)
    lms[1:] = small[1:] & ~small[:-1]
    return small, lms


def packed(t: np.ndarray) -> np.ndarray:
    """The eight symbols from each position, big-endian in 64 bits; zeros after the end."""
    w = np.concatenate([t, np.zeros(8, dtype=t.dtype)]).astype(np.uint64)
    for step, bits in ((1, 8), (2, 16), (4, 32)):
        w = (w[:-step] << np.uint64(bits)) | w[step:]
    return w[: len(t)]


def name_substrings(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the substrings of the packed text; one that is the beginning of another counts as larger."""
    names = np.zeros(len(starts), dtype=np.int64)
    for at in range(0, min(int(lengths.max()), depth), 8):
        left = np.clip(lengths - at, 0, 8).astype(np.uint64)
        part = words[np.minimum(starts + at, len(words) - 1)]
        empty = (np.uint64(8) - left) * np.uint64(8)
        fill = np.where(left == 0, ~np.uint64(0), (np.uint64(1) << np.minimum(empty, np.uint64(63))) - np.uint64(1))
        part = np.where(left == 0, ~np.uint64(0), (part & ~fill) | fill)
        _, rank = np.unique(part, return_inverse=True)
        names = rank if at == 0 else np.unique(names * (len(names) + 1) + rank, return_inverse=True)[1]
    return names


def order_names(names: np.ndarray, depth: int, starts: np.ndarray | None = None, symbols: int = 0) -> np.ndarray:
    """The suffixes of the string of names in order, by their first `depth` names at least; or, where it is told where in the text
    each name starts, by names that hold `symbols` symbols.

    A rank is the number of suffixes known to be smaller; each round doubles the names compared, for suffixes of equal rank
    alone, and only while what they have compared is too short."""
    names = names.astype(np.int64)
    n, width = len(names), 1
    counts = np.bincount(names)
    rank = (np.cumsum(counts) - counts)[names]
    tied = np.flatnonzero(counts[names] > 1)
    while width < depth and len(tied):
        if starts is not None:
            tied = tied[(tied + width >= n) | (starts[np.minimum(tied + width, n - 1)] - starts[tied] < symbols)]
        behind = np.where(tied + width < n, rank[np.minimum(tied + width, n - 1)] + 1, 0)
        key = rank[tied] * (n + 1) + behind
        order = np.argsort(key)
        tied, key = tied[order], key[order]
        old = rank[tied]
        place = np.arange(len(tied))
        first = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], place, 0))
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], place, 0))
        rank[tied] = old + first - group
        last = np.r_[key[1:] != key[:-1], True]
        tied = tied[~(last & (first == place))]
        width *= 2
    return np.argsort(rank, kind="stable")


def _deal(lists: list[list[np.ndarray]], t: np.ndarray, suffixes: np.ndarray) -> None:
    """Appends suffixes to the bucket of their first symbol, in order."""
    if not len(suffixes):
        return
    symbols = t[suffixes]
    order = np.argsort(symbols, kind="stable")
    symbols, suffixes = symbols[order], suffixes[order]
    cuts = np.flatnonzero(np.diff(symbols)) + 1
    for part, c in zip(np.split(suffixes, cuts), symbols[np.r_[0, cuts]], strict=True):
        lists[c].append(part)


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of t (uint8 symbols, the last one 0) in the order of their first `depth` symbols."""
    small, lms = classify(t)
    starts = np.flatnonzero(lms)
    if len(starts) == 0:
        return np.argsort(t, kind="stable")
    lengths = np.diff(np.r_[starts, len(t) - 1]) + 1
    names = name_substrings(packed(t), starts, lengths, depth + 8)
    seeds = starts[order_names(names, depth // 2 + 1, starts, depth)]  # a substring has two symbols of its own at least
    sizes = int(t.max()) + 1
    seeded: list[list[np.ndarray]] = [[] for _ in range(sizes)]
    _deal(seeded, t, seeds)
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    large: list[list[np.ndarray]] = [[] for _ in range(sizes)]

    def induce(lists, source, c, wanted_small):
        """Deals out the predecessors of `source` that are of the wanted kind; returns those in bucket c itself."""
        before = source[source > 0] - 1
        before = before[small[before] == wanted_small]
        same = t[before] == c
        _deal(lists, t, before[~same])
        return before[same]

    for c in range(sizes):
        done, now = [], join(large[c])
        if c == 0 and not small[len(t) - 1]:
            now = np.r_[len(t) - 1, now]
        while len(now):
            done.append(now)
            now = induce(large, now, c, False)
        large[c] = done
        induce(large, join(seeded[c]), c, False)
    small_lists: list[list[np.ndarray]] = [[] for _ in range(sizes)]
    out = []
    for c in range(sizes - 1, -1, -1):  # from the largest: each list holds its bucket in falling order
        done, now = [], join(small_lists[c])
        if t[-1] == c:
            now = np.r_[now, len(t) - 1]
        while len(now):
            done.append(now)
            now = induce(small_lists, now, c, True)
        falling = join(done)
        greater = join(large[c])
        induce(small_lists, greater[::-1], c, True)
        out += [falling[::-1], greater]
    return np.concatenate(out[::-1])


def common_prefixes(words: np.ndarray, t: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each suffix in `order` the symbols, up to `most`, that it shares with the one before it there; by position in t,
    0 for others. Permuted: where a suffix and its neighbour follow equal symbols of ones that are neighbours too, the value is one less
    than theirs; only the other, irreducible ones are compared."""
    n = len(t)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, dtype=np.int64)
    has = np.flatnonzero(before >= 0)
    prev = before[has]
    follows = np.zeros(len(has), dtype=bool)
    inner = (has > 0) & (prev > 0)
    follows[inner] = (before[has[inner] - 1] == prev[inner] - 1) & (t[has[inner] - 1] == t[prev[inner] - 1])
    heads = has[~follows]
    i, j, shared = heads.copy(), before[heads], np.zeros(len(heads), dtype=np.int64)
    live = np.arange(len(heads))
    while len(live) and shared[live[0] if len(live) == 1 else live].max() < most:
        a, b = i[live] + shared[live], j[live] + shared[live]
        inside = (a < n) & (b < n)
        same = np.zeros(len(live), dtype=bool)
        same[inside] = words[a[inside]] == words[b[inside]]
        ended = live[~same]
        live = live[same]
        if len(ended):
            a, b = i[ended] + shared[ended], j[ended] + shared[ended]
            x = words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)]
            equal = np.zeros(len(ended), dtype=np.int64)
            for k in range(1, 8):
                equal += (x >> np.uint64(64 - 8 * k)) == 0
            shared[ended] += np.where((a < n) & (b < n), equal, 0)
        shared[live] += 8
    out[heads] = shared
    # positions that follow: the head's value less the distance, never below 0
    head_of = np.maximum.accumulate(np.where(~follows, np.arange(len(has)), 0))
    out[has] = np.maximum(0, out[has[head_of]] - (has - has[head_of]))
    return np.minimum(out, most)


def _reaches(pieces: list[bytes], widths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the first `width` places of all pieces, one after the other: the piece, the place in it, and how many symbols the string
    there shares with one that begins elsewhere, up to 2 * most at least where it is more than most."""
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    t = np.frombuffer(b"\xff".join(pieces) + b"\xff", dtype=np.uint8) + np.uint8(1)  # UTF-8 has no byte 255, so it separates as 0
    firsts = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(len(pieces)), widths)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(widths) - widths, widths)
    at = firsts[owner] + place
    window = np.zeros(len(t), dtype=bool)
    window[at] = True
    array = suffix_array(t, most)
    order = array[window[array]]
    reach = common_prefixes(packed(t), t, order, 2 * int(sizes.max()))
    shared = reach[order[1:]]
    reach[order[:-1]] = np.maximum(reach[order[:-1]], shared)
    return owner, place, reach[at]


def repeated_windows(pieces: list[bytes], widths: list[int], counts: list[int], short: int, long: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each piece, of the strings that begin at its first `width` places, which of `short` and which of `long` bytes also
    begin elsewhere, in another piece or, where its count is 2 or more, in another copy of it. Short ones always fit into
    their piece; a long one that doesn't is no string of its document."""
    owner, place, reach = _reaches(pieces, np.array(widths, dtype=np.int64), long)
    cuts = np.cumsum(widths)[:-1]
    out = []
    for piece, where, got, count in zip(pieces, np.split(place, cuts), np.split(reach, cuts), counts, strict=True):
        out.append(((got >= short) | (count > 1), ((got >= long) | (count > 1)) & (where + long <= len(piece))))
    return out


def repeated_runs(pieces: list[bytes], widths: list[int], counts: list[int], short: int, long: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The bytes that the strings of repeated_windows cover, of `short` and of `long` bytes: how many numbers each piece has, and
    from, to, from, to ... of all pieces."""
    widths, sizes = np.array(widths, dtype=np.int64), np.array([len(p) for p in pieces], dtype=np.int64)
    owner, place, reach = _reaches(pieces, widths, long)
    copied = np.array(counts, dtype=np.int64)[owner] > 1
    edge = owner[1:] != owner[:-1]
    out = []
    for length in (short, long):
        hit = (reach >= length) | copied
        if length == long:
            hit &= place + long <= sizes[owner]
        first, last = hit & np.r_[True, ~hit[:-1] | edge], hit & np.r_[~hit[1:] | edge, True]
        out.append((2 * np.bincount(owner[first], minlength=len(pieces)), np.stack([place[first], place[last] + length], 1).ravel()))
    return out
