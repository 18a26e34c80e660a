"""Word shingles of many texts at once, their compact windows, and the comparison of two stretches (operator 5).

All work is on arrays over a chunk of texts, so a short text costs no call of its own. Tokens are five-word shingles of the
lower-cased (A-Z) whole text; a token is the 64-bit hash of its words. Long texts go through in blocks that end at white
space.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from relscope.llm.common import ASCII_LOWER

SHINGLE, MIN_WORDS, SIMILARITY = 5, 50, 0.8
HASHES, SEED = 4, 17
#: Shingles of the shortest passage.
WIDTH = MIN_WORDS - SHINGLE + 1
#: Bytes of text that are hashed at once, and tokens that one Cartesian tree spans at most.
CHUNK, STRETCH = 1 << 18, 1 << 21
_PLACE = np.uint64((1 << 22) - 1)

_LOWER = np.frombuffer(ASCII_LOWER, np.uint8)
_GAP = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BASE = 0x9E3779B97F4A7C15


def mixed(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@cache
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end) of each word of data (bytes); texts begin at `begins`, where a word ends in any case."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = _LOWER[data]
    gap = _GAP[low]
    fresh = np.zeros(n + 1, bool)
    fresh[begins] = True
    fresh[0] = fresh[n] = True
    before, after = np.concatenate(([True], gap[:-1])), np.concatenate((gap[1:], [True]))
    start = np.flatnonzero(~gap & (before | fresh[:n]))
    end = np.flatnonzero(~gap & (after | fresh[1:])) + 1
    size = 1 << max(n, CHUNK).bit_length()
    up, down = _powers(size, _BASE), _powers(size, pow(_BASE, -1, 1 << 64))
    # a sum of bytes times powers up to each place: the difference of two, shifted back, is the word's own polynomial
    total = np.concatenate(([np.uint64(0)], np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)))
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start, end


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tokens of each text) of the word hashes of consecutive texts with `counts` words each."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    t = np.zeros(n, np.uint64)
    for k in range(width):
        t = t * np.uint64(_BASE) + words[k : k + n]
    ends = np.repeat(np.cumsum(counts), counts)[:n]
    return mixed(t[np.arange(n) + width <= ends]), np.maximum(counts - width + 1, 0)


def _blocks(data: np.ndarray) -> Iterator[np.ndarray]:
    """data in blocks of about CHUNK bytes that end at white space."""
    at, n = 0, len(data)
    while n - at > CHUNK:
        to = at + CHUNK
        while to < n:
            gaps = np.flatnonzero(_GAP[data[to : to + 4096]])
            if len(gaps):
                to += int(gaps[0])
                break
            to = min(n, to + 4096)
        yield data[at:to]
        at = to
    yield data[at:]


def chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, tokens, tokens of each row) of runs of texts, of about CHUNK bytes or one longer text each."""
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        to = min(to, n)
        rows = np.arange(at, to)
        own = data[offsets[at] : offsets[to]]
        if to - at == 1:
            words = np.concatenate([word_hashes(b, np.zeros(0, np.int64))[0] for b in _blocks(own)])
            counts = np.array([len(words)])
        else:
            begins = offsets[at : to + 1] - offsets[at]
            words, start, _ = word_hashes(own, begins)
            counts = np.diff(np.searchsorted(start, begins))
        tokens, sizes = shingle_hashes(words, counts)
        yield rows, tokens, sizes
        at = to


def shingles(text: str | None) -> np.ndarray:
    """The tokens of one text, in order."""
    parts = [t for _, t, _ in chunks(pa.array([text or ""], pa.string()))]
    return np.concatenate(parts)


def salts(hashes: int) -> np.ndarray:
    return mixed((np.arange(hashes, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03) + np.uint64(SEED))


def _spans(place: np.ndarray, value: np.ndarray, first: np.ndarray, last: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place its node's span in the Cartesian tree of its text: from after the last place with a value no larger
    to before the next place with a smaller one, within [lo, hi).

    Places of a text are first..last. A place's next stop jumps over the stops of larger ones, so all places together take
    a logarithmic number of steps.
    """
    m = len(place)
    prev, after = np.arange(m) - 1, np.arange(m) + 1
    todo = np.arange(m)
    while len(todo):
        p = prev[todo]
        todo, p = todo[(ok := p >= first[todo])], p[ok]
        go = value[p] > value[todo]
        todo = todo[go]
        prev[todo] = prev[p[go]]
    todo = np.arange(m)
    while len(todo):
        q = after[todo]
        todo, q = todo[(ok := q <= last[todo])], q[ok]
        go = value[q] >= value[todo]
        todo = todo[go]
        after[todo] = after[q[go]]
    low = np.where(prev >= first, place[prev.clip(0)] + 1, lo)
    high = np.where(after <= last, place[after.clip(max=max(0, m - 1))] - 1, hi - 1)
    return low, high


def windows(tokens: np.ndarray, sizes: np.ndarray, width: int = WIDTH, hashes: int = HASHES) -> np.ndarray:
    """Rows (text number, key, a, c, b) of all compact windows of at least `width` tokens of consecutive texts.

    All sequences that begin in [a, c] and end in [c, b] have their least token hash at c; the key is that hash, its lowest
    three bits name the function. A token spans `width` tokens in its tree exactly if it is the least of some run of
    `width` tokens, so those tokens are found first and the trees are built of them alone; spans are the same. Where one
    token returns within `width` (a text that runs in circles) one of its windows stands for the others: it ends where
    theirs do, has the same key and lies within `width` of them.
    """
    found = []
    ends = np.cumsum(sizes)
    for base in range(0, int(sizes.max(initial=0)), STRETCH) if len(sizes) == 1 else (0,):
        part = tokens[base : base + STRETCH + width - 1] if len(sizes) == 1 else tokens
        stops = np.array([len(part)]) if len(sizes) == 1 else ends
        counts = np.diff(stops, prepend=0)
        n = len(part)
        if n < width:
            continue
        owner = np.repeat(np.arange(len(counts)), counts)
        starts = np.flatnonzero(np.arange(n) + width <= stops[owner])  # runs of width tokens inside one text
        if not len(starts):
            continue
        for k, salt in enumerate(salts(hashes)):
            h = mixed(part ^ salt)
            least, span = h & ~_PLACE | np.arange(n, dtype=np.uint64), 1
            while 2 * span <= width:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            where = (np.minimum(least[starts], least[starts + width - span]) & _PLACE).astype(np.int64)
            place = where[np.concatenate(([True], where[1:] != where[:-1]))]
            value, text = h[place], owner[place]
            new = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
            runs = np.diff(np.append(new, len(text)))
            first = np.repeat(new, runs)
            low, high = _spans(place, value, first, first + np.repeat(runs, runs) - 1, (stops - counts)[text], stops[text])
            order = np.lexsort((place, value, text))
            same = np.concatenate(([False], (value[order][1:] == value[order][:-1]) & (text[order][1:] == text[order][:-1])))
            keep = np.ones(len(place), bool)
            if same.any():
                head = place[order][np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
                cell = (place[order] - head) // width
                keep[order] = ~(same & (cell == np.concatenate(([0], cell[:-1]))))
            zero = (stops - counts)[text] - base
            key = (value & ~np.uint64(7) | np.uint64(k)).view(np.int64)
            found.append(np.stack([text, key, low - zero, place - zero, high - zero], axis=1)[keep])
    return np.concatenate(found) if found else np.zeros((0, 5), np.int64)


#: Windows whose tokens are sorted at once.
WINDOWS = 1 << 13
#: Bands of a window's signature and min-hashes in each: windows at the similarity share a band with 98.6 %.
BANDS, ROWS = 6, 3


def _inside(n: int, sizes: np.ndarray, width: int) -> np.ndarray:
    """For each of the first n places of consecutive texts whether a window that starts there lies in one text."""
    return np.arange(n) + width <= np.repeat(np.cumsum(sizes), sizes)[:n]


def looped(tokens: np.ndarray, width: int = WIDTH, sizes: np.ndarray | None = None) -> np.ndarray:
    """For each token whether it lies in a window that holds a token twice.

    sizes, if given, says how many tokens each of several consecutive texts has.
    """
    n = len(tokens) - width + 1
    if n < 1:
        return np.zeros(len(tokens), bool)
    fewer = Side(tokens).distinct(n, width) < width
    fewer = np.flatnonzero(fewer if sizes is None else fewer & _inside(n, sizes, width))
    return _covering(fewer, fewer + width - 1, len(tokens)) > 0


def hopeful(
    tokens: np.ndarray, common: np.ndarray, width: int = WIDTH, similarity: float = SIMILARITY, circling: np.ndarray | None = None, sizes: np.ndarray | None = None, side: Side | None = None
) -> np.ndarray:
    """For each token whether the window that starts there can be similar to one of another document.

    common says which tokens another document has. Two similar windows share `similarity` of the tokens of either at least.
    circling, if given, says which of the common tokens lie anywhere in a window that holds a token twice. A window without
    those tokens can be similar only to windows of `width` tokens, with which it must share more. sizes, if given, says how
    many tokens each of several consecutive texts has; a window lies in one. side is Side(tokens), if known.
    """
    n = len(tokens) - width + 1
    out = np.zeros(len(tokens), bool)
    if n < 1:
        return out
    side = side or Side(tokens)
    own = side.distinct(n, width)
    after = np.full(len(tokens), len(tokens))
    seen = np.flatnonzero(side.before >= 0)
    after[side.before[seen]] = seen

    def shared(some: np.ndarray) -> np.ndarray:
        lone = np.flatnonzero(~some)  # each counts once a window, at its last place in it
        return own - _covering(np.maximum(lone - width + 1, 0), np.minimum(np.minimum(lone, after[lone] - width), n - 1), n)

    if circling is None:
        out[:n] = shared(common) >= similarity * own - 1e-9
    else:
        out[:n] = (shared(common) >= similarity / (1 + similarity) * (own + width) - 1e-9) | (shared(common & circling) >= similarity * own - 1e-9)
    if sizes is not None:
        out[:n] &= _inside(n, sizes, width)
    return out


def signatures(tokens: np.ndarray, sizes: np.ndarray, width: int = WIDTH, wanted: np.ndarray | None = None) -> np.ndarray:
    """Rows (text number, key, from, to): the windows that start in [from, to] have the key in one of their bands.

    wanted says for each token whether the window that starts there counts; None: all do.
    """
    found = []
    stops = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    n = len(tokens)
    starts = np.flatnonzero(np.arange(n) + width <= stops[owner]) if n else np.zeros(0, np.int64)
    if wanted is not None:
        starts = starts[wanted[starts]]
    if not len(starts):
        return np.zeros((0, 4), np.int64)
    salt = salts(HASHES + BANDS * ROWS)[HASHES:]
    for band in range(BANDS):
        key = np.full(len(starts), band, np.uint64)
        for row in range(ROWS):
            least, span = mixed(tokens ^ salt[band * ROWS + row]), 1
            while 2 * span <= width:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            key = mixed(key * np.uint64(_BASE) + np.minimum(least[starts], least[starts + width - span]))
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (starts[1:] != starts[:-1] + 1)))
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(starts)) - 1
        zero = (stops - sizes)[owner[starts[at]]]
        found.append(np.stack([owner[starts[at]], key[at].view(np.int64), starts[at] - zero, starts[last] - zero], axis=1))
    return np.concatenate(found)


def run_hashes(tokens: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash (a long) of the tokens of each run [begin, end), in order."""
    size = 1 << max(len(tokens), CHUNK).bit_length()
    up, down = _powers(size, _BASE), _powers(size, pow(_BASE, -1, 1 << 64))
    total = np.concatenate(([np.uint64(0)], np.cumsum(mixed(tokens) * up[: len(tokens)], dtype=np.uint64)))
    return mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64)).view(np.int64)


def rarest(
    tokens: np.ndarray, sizes: np.ndarray, count: np.ndarray, usable: np.ndarray, circling: np.ndarray, width: int = WIDTH, similarity: float = SIMILARITY
) -> tuple[np.ndarray, np.ndarray]:
    """(stretch number, token): the rarest tokens of the windows of consecutive stretches, without repeats.

    count orders tokens (equal ones by their value) and is the same for a token everywhere; usable says which tokens the
    documents have that are asked for, circling which of those lie anywhere in a window that holds a token twice. Two similar
    windows share at least `least` tokens of each (as in `hopeful`); the first of these is among the held - least + 1 rarest
    of the held usable tokens of either window, since what comes before it is not shared. So these are all that must meet.
    """
    order = np.lexsort((tokens, count))
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[order][1:] != tokens[order][:-1]
    rank = np.empty(len(tokens), np.int64)
    rank[order] = np.cumsum(new) - 1
    values = tokens[order][new]
    packed = rank * 4 + usable * 2 + circling
    stops, owner = np.cumsum(sizes), np.repeat(np.arange(len(sizes)), sizes)
    starts = np.flatnonzero(np.arange(len(tokens)) + width <= stops[owner]) if len(tokens) else np.zeros(0, np.int64)
    found = [np.zeros((0, 2), np.int64)]
    for at in range(0, len(starts), WINDOWS):
        part = starts[at : at + WINDOWS]
        w = np.sort(packed[part[:, None] + np.arange(width)], axis=1)
        own = np.ones(w.shape, bool)
        own[:, 1:] = w[:, 1:] != w[:, :-1]
        use, n = own & (w & 2 > 0), own.sum(axis=1)
        loops = (use & (w & 1 > 0)).sum(axis=1) >= similarity * n - 1e-9
        least = np.ceil(np.where(loops, similarity * n, similarity / (1 + similarity) * (n + width)) - 1e-9)
        place = use.cumsum(axis=1)
        row, column = np.nonzero(use & (place <= (place[:, -1] - least + 1)[:, None]))
        found.append(np.unique(np.stack([owner[part[row]], w[row, column] >> 2], axis=1), axis=0))
    every = np.unique(np.concatenate(found), axis=0)
    return every[:, 0], values[every[:, 1]]


class Side:
    """A stretch of tokens that others are compared with: its tokens in order of value, then place."""

    def __init__(self, tokens: np.ndarray):
        self.tokens = tokens
        order = np.argsort(tokens, kind="stable")
        ranked = tokens[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        self.values, self.place, self.first = ranked[new], order, order[new]
        self.plain = len(self.values) == len(tokens)
        self.before = np.full(len(tokens), -1)  # where the same token stood last
        same = np.flatnonzero(~new)
        self.before[order[same]] = order[same - 1]
        self.key = (np.cumsum(new) - 1) * (len(tokens) + 1) + order

    def distinct(self, n: int, width: int) -> np.ndarray:
        """How many different tokens each of the first n windows holds."""
        t = np.flatnonzero(self.before >= 0)
        return width - _covering(np.maximum(t - width + 1, 0), np.minimum(self.before[t], n - 1), n)


def _covering(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """For each of n places how many ranges [lo, hi] hold it."""
    ok = lo <= hi
    return np.cumsum((np.bincount(lo[ok], minlength=n + 1) - np.bincount(hi[ok] + 1, minlength=n + 1))[:n])


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [begin, end), one range after the other."""
    many = end - begin
    return np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())


#: Pairs of equal tokens of two stretches up to which all of them say on which diagonals to look first, and diagonals that
#: are tried first where tokens repeat. What they leave open is compared with every window by `_best_of_all`.
MOST_PLACES, MOST_DIAGONALS = 1 << 16, 16
#: Cells of windows of one side and windows of the other that are counted at once.
CELLS = 1 << 20


def _kinds(side: Side, n: int, width: int) -> np.ndarray:
    """A number for each of the first n windows, the same for windows of the same set of tokens (a sum of 64-bit hashes)."""
    h = mixed(side.tokens ^ np.uint64(_BASE))
    t = np.arange(len(h))
    lo, hi = np.maximum(np.maximum(t - width, side.before) + 1, 0), np.minimum(t, n - 1)  # windows where it stands first
    ok = lo <= hi
    total = np.zeros(n + 1, np.uint64)
    np.add.at(total, lo[ok], h[ok])
    np.subtract.at(total, hi[ok] + 1, h[ok])
    return np.cumsum(total[:n], dtype=np.uint64)


def _best_of_all(side: Side, first: Side, asked: np.ndarray, own: np.ndarray, theirs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each asked window of side the similarity of the most similar window of first, and its place: all are compared.

    Windows of the same set of tokens are one on either side, so a text that runs in circles counts each of its windows
    once. A token that both sides have counts for the windows from after its place before to itself on either side: a
    rectangle of pairs of windows, and the sum of those over a pair is how many tokens the two share.
    """
    n, m = len(side.tokens) - width + 1, len(first.tokens) - width + 1
    _, some, back = np.unique(_kinds(side, n, width)[asked], return_index=True, return_inverse=True)
    rows, cols = asked[some], np.sort(np.unique(_kinds(first, m, width), return_index=True)[1])
    order = np.argsort(rows, kind="stable")
    rows, back = rows[order], np.argsort(order, kind="stable")[back]

    def held(s: Side, windows: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [from, to) of the windows in which the tokens at t stand first."""
        return np.searchsorted(windows, np.maximum(t - width, s.before[t]) + 1), np.searchsorted(windows, t, side="right")

    left, right = held(first, cols, first.place)  # in order of value
    kept = np.flatnonzero(left < right)
    left, right, size = left[kept], right[kept], len(first.tokens) + 1
    rank = first.key[kept] // size
    best, place = np.zeros(len(rows)), np.zeros(len(rows), np.int64)
    step = max(1, CELLS // max(len(cols), len(kept)))
    for at in range(0, len(rows), step):
        part = rows[at : at + step]
        t = np.flatnonzero(_covering(part, np.minimum(part + width, len(side.tokens)) - 1, len(side.tokens)))
        up, down = held(side, part, t)
        value = np.searchsorted(first.values, side.tokens[t])
        ok = (up < down) & (value < len(first.values))
        ok[ok] = first.values[value[ok]] == side.tokens[t[ok]]
        up, down, value = up[ok], down[ok], value[ok]
        begin, end = np.searchsorted(rank, value), np.searchsorted(rank, value, side="right")
        many, other = end - begin, _ranges(begin, end)
        shared = np.zeros((len(part) + 1, len(cols) + 1), np.int32)
        for row, sign in ((np.repeat(up, many), 1), (np.repeat(down, many), -1)):
            np.add.at(shared, (row, left[other]), np.int32(sign))
            np.add.at(shared, (row, right[other]), np.int32(-sign))
        c = shared.cumsum(axis=0, dtype=np.int32).cumsum(axis=1, dtype=np.int32)[:-1, :-1]
        which = (c / (own[part, None] + theirs[None, cols]).astype(np.float32)).argmax(axis=1)  # grows with the similarity
        c, union = c[np.arange(len(part)), which], own[part] + theirs[cols[which]]
        best[at : at + step], place[at : at + step] = c / np.maximum(1, union - c), cols[which]
    return best[back], place[back]


def verified(
    mine: np.ndarray, first: np.ndarray | Side, width: int = WIDTH, similarity: float = SIMILARITY, equal: list[tuple[int, int]] | None = None
) -> list[tuple[int, int, int, float]]:
    """Stretches (from, to, first from, least similarity) of mine, in tokens, each window of which has a match in first.

    Stretches (from, to) of which each window has the same tokens as one of first are put into equal, if given.

    Every window of `width` tokens of mine is measured, as a set of tokens, against the equally long window of first on
    each diagonal that half as many tokens share as similar windows do: those are at most one edit apart, so half of what
    they share lies on one diagonal. Where tokens repeat, MOST_DIAGONALS are tried from the most frequent one on, and windows that can
    reach the similarity and have not are compared with all windows of first.
    """
    first = first if isinstance(first, Side) else Side(first)
    n, m = len(mine) - width + 1, len(first.tokens) - width + 1
    if n < 1 or m < 1:
        return []
    at = np.searchsorted(first.values, mine)
    at[at == len(first.values)] = 0
    match = first.values[at] == mine
    least = int(np.ceil(2 * similarity / (1 + similarity) * width - 1e-9))  # common tokens of two sets of `width`
    count = np.cumsum(match)
    few = (count[width - 1 :] - count[:n] + match[:n]).max() < least
    plain = first.plain and len(set(mine.tolist())) == len(mine)
    if few and plain or not count[-1]:
        return []
    hit = np.flatnonzero(match)
    best, diagonal, size = np.zeros(n), np.zeros(n, np.int64), len(first.tokens) + 1
    if plain:
        shift = first.first[at[hit]] - hit
        own = theirs = np.broadcast_to(width, max(n, m))
        wanted = np.ones(n, bool)
    else:
        side = Side(mine)
        own = side.distinct(n, width)
        # distinct tokens of a window that first has at all, each at its first place in the window
        known = _covering(np.maximum(np.maximum(hit - width, side.before[hit]) + 1, 0), np.minimum(hit, n - 1), n)
        theirs = first.distinct(m, width)
        wanted = known >= np.maximum(similarity * own, similarity / (1 + similarity) * (own + theirs.min())) - 1e-9
        if not wanted.any():
            return []
        begin, end = np.searchsorted(first.key, at[hit] * size), np.searchsorted(first.key, (at[hit] + 1) * size)
        if (end - begin).sum() > MOST_PLACES:  # a text that runs in circles: its outermost places first
            shift = np.concatenate([first.place[begin] - hit, first.place[end - 1] - hit])
        else:
            shift = first.place[_ranges(begin, end)] - np.repeat(hit, end - begin)
    low = int(shift.min())
    often = np.bincount(shift - low)
    ways = np.flatnonzero(often >= least // 2) + low
    if np.count_nonzero(often) > 1 and len(ways) and plain:  # between two diagonals of one passage a third can hold most of both
        some = np.flatnonzero(often >= 3) + low
        near = [np.arange(min(a, b), max(a, b) + 1) for a in ways.tolist() for b in some[np.abs(some - a) <= width - least].tolist()]
        ways = np.unique(np.concatenate([ways, *near]))
    elif not plain:
        ways = np.union1d(ways, np.argsort(-often, kind="stable")[:4] + low)
        ways = ways[np.argsort(-often[ways - low], kind="stable")]
    looked = 0
    for d in ways.tolist():
        from_, to = max(0, -d), min(n, m - d)
        if from_ >= to:
            continue
        if not plain:
            looked += (todo := bool((wanted[from_:to] & (best[from_:to] < similarity)).any()))
            if not todo:
                continue
            if looked > MOST_DIAGONALS:
                break
        # a token counts for the windows that hold it here and a place p of it there, one on this diagonal
        if plain:
            p, t = first.first[at[hit]] - d, hit
            lo = np.maximum(t, p) - width + 1
        else:
            a = np.searchsorted(first.key, at[hit] * size + np.clip(hit + d - width + 1, 0, size - 1))
            b = np.maximum(a, np.searchsorted(first.key, at[hit] * size + np.clip(hit + d + width, 0, size - 1)))
            t, p = np.repeat(hit, b - a), first.place[_ranges(a, b)]
            # once a window: from after the token's place before, on both sides
            lo = np.maximum(np.maximum(t - width, side.before[t]), np.maximum(p - width, first.before[p]) - d) + 1
            p = p - d
        common = _covering(np.maximum(lo, 0), np.minimum(np.minimum(t, p), n - 1), n)
        c = common[from_:to]
        sim = c / np.maximum(1, own[from_:to] + theirs[from_ + d : to + d] - c)
        up = np.flatnonzero(sim > best[from_:to]) + from_
        best[up], diagonal[up] = sim[up - from_], d
    if not plain and len(rest := np.flatnonzero(wanted & (best < similarity - 1e-12))):
        all_best, place = _best_of_all(side, first, rest, own, theirs, width)
        up = all_best > best[rest]
        best[rest[up]], diagonal[rest[up]] = all_best[up], place[up] - rest[up]
    if equal is not None:
        equal += [(a, b - 1 + width) for a, b in _runs(best >= 1 - 1e-12)]
    return [(a, b - 1 + width, int(a + diagonal[a]), float(best[a:b].min())) for a, b in _runs(best >= similarity - 1e-12)]


def _runs(good: np.ndarray) -> list[tuple[int, int]]:
    """The ranges [from, to) of true places."""
    turns = np.flatnonzero(np.diff(np.concatenate(([False], good, [False])).astype(np.int8))).tolist()
    return list(zip(turns[::2], turns[1::2], strict=True))
