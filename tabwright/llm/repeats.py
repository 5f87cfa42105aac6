"""Runs: maximal stretches of words in which words q places apart are the same.

Method (Gusfield and Stoye): a suffix tree of the words, as the sorted suffixes with the lengths of the prefixes that
neighbours share. Its leftmost earlier occurrences give the Lempel-Ziv blocks. Squares whose leftmost occurrence has
its centre in a block are found from that block by longest common extensions in both directions: this set covers
the leftmost occurrence of every kind of square. From each of them a walk along suffix links, from the node of a square
to that of the square one word on, completes the vocabulary; it ends where the next word differs or at a node that is marked
already. The suffixes below a node are all occurrences of its square, and occurrences one place apart merge into a run.
Squares that are powers of shorter squares belong to the runs of those and are left out.

All steps work on flat arrays, of many texts at once: a word's code tells its text apart, so nothing is shared between texts.
Before them, an exact sieve: a run of ``least`` words or more is covered by groups of ``least // 2`` words that
occur twice within it, so words outside of all repeated groups of a stretch end that stretch, again and again until nothing changes.
Ordinary prose has no stretch left.

Scale: a map over the scan, without a shuffle; arrays are bounded by a slice of texts, or one longer text. Time and memory
are n log n in its words, for any repetitiveness.

Defined results: null, empty and white-space texts have no words and no runs; repeated rows and null ids are treated like any
others; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabwright.llm.common import Words, lean, text_chunks, text_of

LEAST = 12
SLICE_BYTES = 3_000_000


class Suffixes:
    """Sorted suffixes of an array of codes, by doubling; what is kept of each doubling answers how far two suffixes agree."""

    def __init__(self, codes: np.ndarray):
        n = self.n = len(codes)
        rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
        #: levels[k][i]: class of the 2**k codes that begin at i, shorter at the end
        self.levels = [rank.astype(np.int32)]
        order = np.argsort(rank, kind="stable")
        width = 1
        while True:
            sorted_rank = rank[order]
            first = np.ones(n, bool)
            first[1:] = sorted_rank[1:] != sorted_rank[:-1]
            if first.all():
                break
            # only suffixes that still share a class are sorted anew, by what follows
            alone = first.copy()
            alone[:-1] &= first[1:]
            again = np.flatnonzero(~alone)
            where = order[again]
            after = where + width
            second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
            by = np.lexsort((second, rank[where]))
            where, second = where[by], second[by]
            order[again] = where
            old = rank[where]
            new = np.ones(len(where), bool)
            new[1:] = (old[1:] != old[:-1]) | (second[1:] != second[:-1])
            starts = np.flatnonzero(new)
            place = again[starts]  # a class is named by its first place among the sorted suffixes
            rank = self.named(rank, order, first)
            rank[where] = np.repeat(place, np.diff(np.append(starts, len(where))))
            width *= 2
            self.levels.append(rank.astype(np.int32))
        self.order, self.rank = order, np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        self.shared = np.zeros(n, np.int32)
        if n > 1:
            self.shared[1:] = self.forward(order[:-1], order[1:])

    @staticmethod
    def named(rank: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
        places = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        out = np.empty_like(rank)
        out[order] = places
        return out

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many codes from a and from b on are the same; a differs from b, so no class of the last level holds both."""
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        far, total = np.maximum(a, b), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, width = self.levels[k], 1 << k
            fits = far + total + width <= self.n
            x, y = np.where(fits, a + total, 0), np.where(fits, b + total, 0)
            total += np.where(fits & (level[x] == level[y]), width, 0)
        return total

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many codes up to a and up to b, both included, are the same; a differs from b."""
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        low, total = np.minimum(a, b), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, width = self.levels[k], 1 << k
            fits = low - total - width + 1 >= 0
            x, y = np.where(fits, a - total - width + 1, 0), np.where(fits, b - total - width + 1, 0)
            total += np.where(fits & (level[x] == level[y]), width, 0)
        return total

    def nodes(self, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last sorted suffix of those that begin with the ``length`` codes from ``at`` on."""
        n, k = self.n, 1
        low = [self.shared]  # low[j][i]: least shared length among 2**j neighbours from i on
        while 2 * k <= n:
            low.append(np.minimum(low[-1][: n - 2 * k + 1], low[-1][k : n - k + 1]))
            k *= 2
        first = self.rank[at].copy()
        last = first.copy()
        for j in range(len(low) - 1, -1, -1):
            width = 1 << j
            start = first - width + 1
            fits = start >= 1
            ok = fits & (low[j][np.where(fits, start, 0)] >= length)
            first -= np.where(ok, width, 0)
            start = last + 1
            fits = start + width <= n
            ok = fits & (low[j][np.where(fits, start, 0)] >= length)
            last += np.where(ok, width, 0)
        return first, last

    def blocks(self) -> np.ndarray:
        """Starts of the Lempel-Ziv blocks: each is the longest that occurs from an earlier place on, or one code."""
        order, shared = self.order.tolist(), self.shared.tolist()
        longest = [0] * self.n
        stack: list[tuple[int, int]] = []  # (place, shared length with the one below it)
        for i in range(self.n + 1):
            at, common = (order[i], shared[i]) if i < self.n else (-1, 0)
            while stack and stack[-1][0] > at:
                place, below = stack.pop()
                longest[place] = max(below, common)
                common = min(below, common)
            stack.append((at, common))
        out, at = [], 0
        while at < self.n:
            out.append(at)
            at += max(1, longest[at])
        return np.array(out, np.int64)


def ranges(sizes: np.ndarray) -> np.ndarray:
    """1, 2, ... sizes[0], 1, 2, ... sizes[1], and so on."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1


def covering_squares(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and half lengths of squares that cover the leftmost occurrence of each kind."""
    begin = s.blocks()
    end = np.append(begin[1:], s.n)
    size = end - begin
    next_size = np.append(size[1:], 0)
    # the right half begins in the block and goes on behind it: around the block's end
    k = ranges(size)
    h = np.repeat(end, size)
    q = h - k
    inside = h < s.n
    k, h, q = k[inside], h[inside], q[inside]
    ahead, behind = s.forward(h, q), np.minimum(s.backward(h - 1, np.maximum(q - 1, 0)), np.where(q > 0, s.n, 0))
    start = np.maximum(q - behind, q - k + 1)
    good = (ahead + behind >= k) & (ahead > 0)
    squares, halves = [start[good]], [k[good]]
    # the square begins before the block, its right half begins in it: around the block's start
    k = ranges(size + next_size)
    h = np.repeat(begin, size + next_size)
    q = h + k
    inside = (q <= s.n) & (h > 0)
    k, h, q, edge = k[inside], h[inside], q[inside], np.repeat(end, size + next_size)[inside]
    ahead, behind = s.forward(h, q), s.backward(h - 1, q - 1)
    start = np.maximum(h - behind, h - k)
    good = (ahead + behind >= k) & (behind > 0) & (start + k < edge)
    squares.append(start[good])
    halves.append(k[good])
    return np.concatenate(squares), np.concatenate(halves)


def least_factors(n: int) -> np.ndarray:
    """The least prime factor of every number up to n."""
    out = np.arange(n + 1)
    for p in range(2, int(n**0.5) + 1):
        if out[p] == p:
            own = out[p * p :: p]
            own[own == np.arange(p * p, n + 1, p)] = p
    return out


def primitive(s: Suffixes, at: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether the ``half`` codes from each place on are no power of fewer codes."""
    out = np.ones(len(at), bool)
    if not len(at):
        return out
    factor, rest = least_factors(int(half.max())), half.copy()
    while (open_ := np.flatnonzero(rest > 1)).size:
        p = factor[rest[open_]]
        step = half[open_] // p
        out[open_[s.forward(at[open_], at[open_] + step) >= half[open_] - step]] = False
        rest[open_] //= p
    return out


def unions(start: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches [start, end] of equal keys, those that overlap or touch put together."""
    if not len(start):
        return start, end, key
    by = np.lexsort((start, key))
    start, end, key = start[by], end[by], key[by]
    shift = key * (int(end.max()) + 2)  # keeps the running maximum apart for each key
    top = np.maximum.accumulate(end + shift)
    new = np.ones(len(start), bool)
    new[1:] = (start + shift)[1:] > top[:-1] + 1
    first = np.flatnonzero(new)
    return start[first], np.maximum.reduceat(end, first), key[first]


def runs_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of an array: starts, lengths and periods, in no order. Codes that end a text must be unlike any other's."""
    none = np.zeros(0, np.int64)
    if len(codes) < 2:
        return none, none, none
    s = Suffixes(codes)
    at, half = covering_squares(s)
    keep = primitive(s, at, half)
    at, half = at[keep], half[keep]
    # suffix-link walks: word by word, as long as the word that goes equals the one that comes
    steps = s.forward(at, at + half) - half
    at, to, half = unions(at, at + steps, half)
    sizes = to - at + 1
    at, half = np.repeat(at, sizes) + ranges(sizes) - 1, np.repeat(half, sizes)
    first, last = s.nodes(at, 2 * half)
    _, own = np.unique(first * (s.n + 1) + half, return_index=True)  # each kind of square once
    first, last, half = first[own], last[own], half[own]
    counts = last - first + 1
    place = s.order[np.repeat(first, counts) + ranges(counts) - 1]
    half = np.repeat(half, counts)
    start, last_start, period = unions(place, place, half)
    return start, last_start - start + 2 * period, period


def may_hold(hashes: np.ndarray, owner: np.ndarray, least: int) -> np.ndarray:
    """Stretch of each word that may lie in a run of ``least`` words or more: a number, or -1."""
    g = max(1, least // 2)
    stretch = owner.astype(np.int64)
    n = len(hashes)
    if n < g:
        return np.full(n, -1)
    while True:
        # groups of g neighbouring words of one stretch; hashes are those of the words, so that equal groups never differ
        whole = (stretch[: n - g + 1] == stretch[g - 1 :]) & (stretch[: n - g + 1] >= 0)
        group = np.zeros(n - g + 1, np.uint64)
        for j in range(g):
            group = group * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n - g + 1 + j]
        group = (group ^ (group >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + stretch[: n - g + 1].astype(np.uint64)
        at = np.flatnonzero(whole)
        by = at[np.argsort(group[at])]
        same = group[by][1:] == group[by][:-1]
        twice = np.zeros(len(by), bool)
        twice[1:] |= same
        twice[:-1] |= same
        mark = np.zeros(n + 1, np.int64)
        hit = by[twice]
        mark[hit] += 1
        mark[hit + g] -= 1
        inside = np.cumsum(mark[:-1]) > 0
        new = np.ones(n, bool)
        new[1:] = (stretch[1:] != stretch[:-1]) | (inside[1:] != inside[:-1])
        number = np.where(inside, np.cumsum(new), -1)
        # stretches shorter than a run go at once
        sizes = np.bincount(number[inside], minlength=1) if inside.any() else np.zeros(1, np.int64)
        short = inside & (sizes[np.maximum(number, 0)] < least)
        number[short] = -1
        if (inside & ~short).sum() == (stretch >= 0).sum():
            return number
        stretch = number


class Runs(NamedTuple):
    """Of several texts, sorted by text, start and period."""

    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def find_runs(words: list[list[bytes]], hashes: np.ndarray, least: int = LEAST) -> Runs:
    """Runs of ``least`` words or more, at least twice their period, in texts whose words have these hashes."""
    counts = np.array([len(w) for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), counts)
    begins = np.cumsum(counts) - counts
    stretch = may_hold(hashes, owner, least)
    at = np.flatnonzero(stretch >= 0)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none)
    codes: dict[tuple[int, bytes], int] = {}
    number, text = stretch[at], owner[at]
    exact = np.fromiter((codes.setdefault((s, words[t][i]), len(codes)) for s, t, i in zip(number.tolist(), text.tolist(), (at - begins[text]).tolist(), strict=True)), np.int64, len(at))
    start, length, period = runs_of(exact)
    enough = length >= np.maximum(least, 2 * period)
    start, length, period = at[start[enough]], length[enough], period[enough]
    text = owner[start]
    start = start - begins[text]
    by = np.lexsort((period, start, text))
    return Runs(text[by], start[by], length[by], period[by])


# ---------------------------------------------------------------- tables


def repeated(key: object, n: int) -> np.ndarray | None:
    """Which original word stands at each place, where the digest's rule repeats words; else nothing."""
    if key is None or not n:
        return None
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def dropped_words(counts: np.ndarray, runs: Runs) -> np.ndarray:
    """For all words of all texts: whether a run holds the word after the run's first period."""
    begins = np.cumsum(counts) - counts
    mark = np.zeros(int(counts.sum()) + 1, np.int64)
    first = begins[runs.text] + runs.start
    np.add.at(mark, first + runs.period, 1)
    np.add.at(mark, first + runs.length, -1)
    return np.cumsum(mark[:-1]) > 0


def analysed(keys: list, data: np.ndarray, offsets: np.ndarray, least: int, rule: bool) -> Iterator[tuple[list[bytes], np.ndarray | None, np.ndarray, np.ndarray, np.ndarray]]:
    """Per text: its words, which of them are dropped (None: none is), and starts, lengths and periods of its runs."""
    raw = data.tobytes()
    split = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    spans = Words(data, offsets, lower=False)
    hashes = spans.hashes()
    if rule:
        take = None
        for i, (key, own) in enumerate(zip(keys, split, strict=True)):
            if (place := repeated(key, len(own))) is not None:
                take = np.arange(len(hashes)) if take is None else take
                take[spans.bounds[i] : spans.bounds[i + 1]] = spans.bounds[i] + place
                split[i] = list(map(own.__getitem__, place.tolist()))
        hashes = hashes if take is None else hashes[take]
    runs = find_runs(split, hashes, least)
    drop = dropped_words(spans.counts, runs) if len(runs.text) else None
    edge = np.searchsorted(runs.text, np.arange(len(split) + 1))
    for i, own in enumerate(split):
        a, b = edge[i], edge[i + 1]
        lost = drop[spans.bounds[i] : spans.bounds[i + 1]] if b > a else None
        yield own, lost, runs.start[a:b], runs.length[a:b], runs.period[a:b]


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    keys = batch.column(0).to_pylist()
    for a, b, data, offsets in text_chunks(batch.column(1), SLICE_BYTES):
        yield keys[a:b], data, offsets


def gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to about a slice, as arrays work best on many texts."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SLICE_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield from table.to_batches()


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def find(docs: DataFrame, column: str = "text", key: str = "doc_id", least: int = LEAST) -> DataFrame:
    """Per document: key, runs (sorted by start and period), and its text without repetitions, words joined by single spaces."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            for keys, data, offsets in chunks(batch):
                runs, texts = [], []
                for words, drop, start, length, period in analysed(keys, data, offsets, least, rule=False):
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)])
                    texts.append(b" ".join(kept_words(words, drop)).decode())
                kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(runs, kind), pa.array(texts, pa.string())], names=[key, "runs", "collapsed"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_of(column).alias("text_")).mapInArrow(lean(run, "repeats"), f"`{key}` {kind}, runs array<{RUN}>, collapsed string")


def kept_words(words: list[bytes], drop: np.ndarray | None) -> list[bytes]:
    return words if drop is None else [words[i] for i in np.flatnonzero(~drop).tolist()]


def digests(docs: DataFrame, column: str = "text", key: str = "doc_id", least: int = LEAST) -> DataFrame:
    """Per document: number of runs, the longest, digests of all runs and of the collapsed text, after the fixed rule
    that repeats words in a tenth of the documents (``repeated``)."""
    names = [key, "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            for keys, data, offsets in chunks(batch):
                rows = []
                for words, drop, start, length, period in analysed(keys, data, offsets, least, rule=True):
                    text = "".join(f"{s},{n},{p}\n" for s, n, p in zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
                    best: tuple = (None,) * 4
                    if len(start):
                        i = int(np.lexsort((period, start, -length))[0])
                        best = (int(start[i]), int(length[i]), int(period[i]), int(1000 * length[i] // period[i]))
                    whole = b" ".join(kept_words(words, drop))
                    rows.append((len(start), *best, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(whole).hexdigest()))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *columns], names=names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
    return docs.select(key, text_of(column).alias("text_")).mapInArrow(lean(run, "repeats"), schema)
