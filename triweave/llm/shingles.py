"""Shingle sets, their signatures and bitmaps, and the links between bounded groups of sets: operator 3's work in a task."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from triweave.llm.words import mix, split_words, text_slices, word_hashes, worker_state

SPARE, SPARE_SHARE, CLASS_RATIO = 2, 0.15, 1.5
SIGNATURE_SCHEMA = "doc_id long, n long, set_key binary, sigs array<long>, bits binary"
OPENED_SCHEMA = "a long, b long"
NOMINATED_SCHEMA = "unit long, side int, doc_id long, comp long"
#: Words of bitmaps compared at once.
BLOCK = 1 << 20


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    offsets, codes, vocabulary = split_words(texts)
    h = word_hashes(vocabulary)[codes]
    sizes = np.diff(offsets)
    long = h[: max(len(h) - k + 1, 0)]
    for j in range(1, k):
        long = mix(long) + h[j : j + len(long)]
    long = mix(long)
    out = []
    for start, n in zip(offsets[:-1].tolist(), sizes.tolist(), strict=True):
        if n >= k:
            x = np.sort(long[start : start + n - k + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif n:
            x = np.uint64(n)
            for y in h[start : start + n]:
                x = mix(np.array([x], np.uint64))[0] ^ y
            out.append(mix(np.array([x], np.uint64)))
        else:
            out.append(h[:0])
    return out


class Cuts:
    """Size classes of a threshold num/den and the block borders of a set's signatures."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.tops = [4]
        while self.tops[-1] < 1 << 40:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] * max(CLASS_RATIO, den / num * 1.05))))
        self.tops_array = np.array(self.tops)

    def differ(self, a: int, b: int) -> int:
        """The most shingles in which linked sets of at most these sizes differ."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    @functools.lru_cache(maxsize=1024)  # noqa: B019
    def borders(self, blocks: int) -> np.ndarray:
        return np.array([-(-(i << 64) // blocks) for i in range(1, blocks)], np.uint64)

    @functools.lru_cache(maxsize=4096)  # noqa: B019
    def cut(self, differ: int, top: int) -> tuple[int, int, int]:
        """(blocks, spare, weak): ``differ`` + 1 + ``spare`` blocks for sets of up to ``top`` shingles; blocks of at
        most ``weak`` shingles, as a Poisson law has them, are fewer than the spare ones in most sets."""
        spare = max(SPARE, int((differ + 1) * SPARE_SHARE))
        blocks = differ + 1 + spare
        mean, weak = 0.8 * top / blocks, 0
        term = total = math.exp(-mean)
        while total + term * mean / (weak + 1) <= 0.7 * spare / blocks:
            term *= mean / (weak + 1)
            total += term
            weak += 1
        return blocks, spare, weak

    def instances(self, n: int) -> list[tuple[int, tuple[int, int, int]]]:
        """(number, cut) of the cuts in which a set of this size takes part."""
        i = int(np.searchsorted(self.tops_array, n))
        top, out = self.tops[i], []
        if h := self.differ(top, top):
            out.append((2 * i, self.cut(h, top)))
        if n * self.den >= self.num * (top + 1):  # may be linked with a set of the next class
            out.append((2 * i + 1, self.cut(self.differ(top, top * self.den // self.num), top)))
        if i and n * self.num <= self.den * self.tops[i - 1]:
            below = self.tops[i - 1]
            out.append((2 * i - 1, self.cut(self.differ(below, below * self.den // self.num), below)))
        return out

    def signatures(self, x: np.ndarray) -> np.ndarray:
        """One hash for each block of more than ``weak`` shingles; for weak ones only where there are more than ``spare``."""
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(x ^ np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)))
        out = []
        for number, (blocks, spare, weak) in self.instances(len(x)):
            ends = np.concatenate(([0], np.searchsorted(x, self.borders(blocks)), [len(x)]))
            strong = ends[1:] - ends[:-1] > weak
            sig = mix((sums[ends[1:]] - sums[ends[:-1]]) ^ mix((np.uint64(number << 40) + np.arange(1, blocks + 1, dtype=np.uint64))))
            out.append(sig if blocks - strong.sum() > spare else sig[strong])
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def bitmap(x: np.ndarray) -> np.ndarray:
    """Parities of the shingles in one to two places a shingle: two sets differ in at least as many
    shingles as their bitmaps, folded to one width, differ in places."""
    width = max(64, 1 << max(len(x) - 1, 0).bit_length())
    odd = np.bincount((x & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def sign(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, seen = worker_state(("cuts", num, den), lambda: Cuts(num, den)), set()
        for batch in batches:
            for part in text_slices(batch):
                keys, sizes, sigs, bits = [], [], [], []
                for doc_id, x in zip(part.column("doc_id").to_pylist(), shingle_sets(part.column("text"), k), strict=True):
                    key = xxhash.xxh3_128_digest(x.tobytes())
                    fresh = len(x) and doc_id is not None and key not in seen
                    if fresh and len(seen) < 200_000:  # beyond, sets may be signed again
                        seen.add(key)
                    keys.append(key)
                    sizes.append(len(x))
                    sigs.append(cuts.signatures(x).view(np.int64) if fresh else np.zeros(0, np.int64))
                    bits.append(bitmap(x).tobytes() if fresh else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(sizes, pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sigs]))), pa.int32()), pa.array(np.concatenate(sigs))),
                        pa.array(bits, pa.binary()),
                    ],
                    names=["doc_id", "n", "set_key", "sigs", "bits"],
                )

    return run


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def near_pairs(sizes: list[int], bits: list[np.ndarray], member: np.ndarray, comp: np.ndarray, inner: bool, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) that sizes and bitmaps allow to be linked, likeliest first: of a member with a query of
    another component, or with ``inner`` with another member."""
    order = np.argsort(sizes, kind="stable")
    s, member, comp = np.asarray(sizes, np.int64)[order], member[order], comp[order]
    words = np.array([len(bits[i]) for i in order])
    first, second, apart = [], [], []
    for w in np.unique(words):
        lo, hi = np.searchsorted(words, (w, w + 1))
        ends = np.searchsorted(s * num, s[lo:hi] * den, "right")
        table = np.stack([folded(bits[i], w) for i in order[lo : ends[-1]]])
        at = lo
        while at < hi:
            stop = min(hi, at + max(1, BLOCK // int((ends[-1] - at) * w)))
            far = ends[stop - 1 - lo]
            differ = np.bitwise_count(table[at - lo : stop - lo, None, :] ^ table[None, at - lo : far - lo, :]).sum(-1, dtype=np.int64)
            i, j = np.arange(at, stop)[:, None], np.arange(at, far)[None, :]
            both = s[i] + s[j]
            good = (j > i) & (j < ends[at - lo : stop - lo, None]) & (comp[i] != comp[j]) & (differ * (den + num) <= both * (den - num))
            good &= (member[i] | member[j]) if inner else (member[i] != member[j])
            x, y = np.nonzero(good)
            first.append(x + at)
            second.append(y + at)
            apart.append(differ[x, y] / both[x, y])
            at = stop
    if not first:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(first), np.concatenate(second)
    rank = np.argsort(np.concatenate(apart), kind="stable")
    return order[a[rank]], order[b[rank]]


class Forest:
    """Components of a group's rows, merged as links are found."""

    def __init__(self, comps: list[int]):
        self.root = np.unique(np.asarray(comps, np.int64), return_inverse=True)[1]
        self.up = list(range(len(self.root)))

    def find(self, i: int) -> int:
        x, up = int(self.root[i]), self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def merge(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.up[max(a, b)] = min(a, b)

    def labels(self) -> np.ndarray:
        """The component of each row now."""
        up = np.array(self.up)
        while not np.array_equal(up, above := up[up]):
            up = above
        return up[self.root]


def across(forest: Forest, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """The pairs whose rows are in two components when it is their turn; the caller may merge those."""
    at, step = 0, 256
    while at < len(first):
        a, b = first[at : at + step], second[at : at + step]
        labels = forest.labels()
        some = np.flatnonzero(labels[a] != labels[b])
        for i, j in zip(a[some].tolist(), b[some].tolist(), strict=True):
            if forest.find(i) != forest.find(j):
                yield i, j
        at, step = at + step, min(2 * step, 1 << 16)


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def group_links(ids: list[int], sides: list[int], sets: list[np.ndarray], comps: list[int], inner: bool, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between a group's members (side 1) and queries (side 0), with ``inner``
    among members too.  A query is compared with the members only if its overlap with
    the union of theirs allows a link with one.  Rows of one component need no link.
    """
    member = np.array(sides) == 1
    if not member.any():
        return []
    union = np.unique(np.concatenate([x for x, m in zip(sets, member, strict=True) if m]))
    use = [i for i, x in enumerate(sets) if member[i] or den * shared(x, union) >= num * len(x)]
    if len(use) < 2:
        return []
    at = np.array(use)
    forest, out = Forest([comps[i] for i in use]), []
    first, second = near_pairs([len(sets[i]) for i in use], [bitmap(sets[i]) for i in use], member[at], forest.labels(), inner, num, den)
    for i, j in across(forest, first, second):
        x, y = sets[use[i]], sets[use[j]]
        both = shared(x, y)
        if den * both >= num * (len(x) + len(y) - both):
            forest.merge(i, j)
            out.append((ids[use[i]], ids[use[j]]))
    return out


def open_groups(k: int, num: int, den: int):
    """Links (a, b) within runs of rows (unit, side, doc_id, comp, text) of one unit; among members only in a unit
    that is their own group, which side 1 tells from side 2, members of a group that is asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("plain", dict)
        unit, rows, out = None, [], []

        def close() -> None:
            nonlocal rows
            if len(rows) > 1:
                ids, sides, comps, sets = (list(c) for c in zip(*rows, strict=True))
                out.extend(group_links(ids, [min(x, 1) for x in sides], sets, comps, 1 in sides, num, den))
            rows = []

        for batch in batches:
            for part in text_slices(batch):
                sets = shingle_sets(part.column("text"), k)
                for u, side, doc_id, comp, x in zip(*(part.column(c).to_pylist() for c in ("unit", "side", "doc_id", "comp")), sets, strict=True):
                    if u != unit:
                        close()
                        unit = u
                        if len(out) > 10_000:
                            yield _table(out, ["a", "b"], [pa.int64(), pa.int64()])
                            out = []
                    if len(x):
                        rows.append((doc_id, side, comp, x))
        close()
        yield _table(out, ["a", "b"], [pa.int64(), pa.int64()])

    return run


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def nominate(num: int, den: int, forest_only: bool):
    """Of runs of rows (unit, side, doc_id, comp, n, bits) of one unit, those whose bitmaps allow a link across
    components: for every such pair, or with ``forest_only`` for a spanning forest of the likeliest.  Sides as
    in ``open_groups``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("plain", dict)
        unit, rows, out = None, [], []

        def close() -> None:
            nonlocal rows
            sides, ids, comps, sizes, bits = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [], [])
            rows = []
            if len(ids) < 2:
                return
            forest = Forest(comps)
            first, second = near_pairs(sizes, [np.frombuffer(b, np.uint64) for b in bits], np.array(sides) > 0, forest.labels(), 1 in sides, num, den)
            if forest_only:
                use = set()
                for i, j in across(forest, first, second):
                    forest.merge(i, j)
                    use |= {i, j}
            else:
                use = {*np.unique(first).tolist(), *np.unique(second).tolist()}
            out.extend((unit, sides[i], ids[i], comps[i]) for i in sorted(use))

        for batch in batches:
            for u, *row in zip(*(batch.column(c).to_pylist() for c in ("unit", "side", "doc_id", "comp", "n", "bits")), strict=True):
                if u != unit:
                    close()
                    unit = u
                    if len(out) > 10_000:
                        yield _table(out, ["unit", "side", "doc_id", "comp"], [pa.int64(), pa.int32(), pa.int64(), pa.int64()])
                        out = []
                rows.append(row)
        close()
        yield _table(out, ["unit", "side", "doc_id", "comp"], [pa.int64(), pa.int32(), pa.int64(), pa.int64()])

    return run
