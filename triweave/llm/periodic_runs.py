"""Operator 11, periodic run detection: all maximal repetitions of words in each text, by longest previous factors.

Texts of a slice are one sequence of word numbers, each text with its own numbers and an end mark, so no
repeat leaves its text:

1. Suffix array by prefix doubling, of which only tied suffixes are sorted again.  Every round's ranks are kept
   until no suffix is tied: equal ranks of round k are equal stretches of 2^k words, so the words by which two
   places agree, forwards or backwards, take one look at each round, for many pairs of places at once.
2. The LCP array, and from both the longest previous factor (LPF) of each place, with the place it repeats:
   the nearest smaller entry on either side in the suffix array, with the least LCP on the way.
3. LZ blocks: a block is its first place's LPF, or one word.
4. Main's extensions.  A run of exponent E or more that ends in block i and begins before it begins less than its
   period before block i-1, or that block and the next word would have occurred before.  So (E - 1) times its period is
   less than both blocks' length; for each border and such a period two extensions, to the left and to the right,
   of the border against the place a period before or after it, give every run that crosses or touches a border.
5. Bucketed copying.  A run strictly inside a block is a run inside the place that the block repeats; runs
   are kept by start, and each block, in order, takes over those of its source.

Memory is 4 bytes a word for each round: the logarithm of the longest repeat within one text, for texts of about
``SLICE_BYTES`` together or for one longer text.

Defined results: null or empty texts and texts without words have no words and no runs; words are compared as
they are; repeated rows each get a row; null doc_ids keep their row (and nothing is planted in their text);
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triweave.llm.words import split_words, text_slices, tidy

#: A run has at least LEAST words and EXPONENT times its period.
LEAST, EXPONENT = 6, 4
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
#: Rounds in which all nearest smaller entries are sought at once, before the last ones are sought one by one.
HOPS = 32


class Repeats:
    """Suffix array of a sequence of which the last number occurs once, and how far places of it agree."""

    def __init__(self, numbers: np.ndarray):
        n = len(numbers)
        order = np.argsort(numbers, kind="stable").astype(np.int32)
        first = np.concatenate(([True], np.diff(numbers[order]) != 0))
        rank = np.empty(n, np.int32)
        rank[order] = np.flatnonzero(first).astype(np.int32)[np.cumsum(first) - 1]  # a rank is its first place in the array
        self.ranks, self.array, step = [rank], order, 1
        tied = _tied(first)  # places of the array
        while len(tied):
            at = order[tied]
            key = rank[at].astype(np.int64) << 32 | rank[np.minimum(at + step, n - 1)]
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            order[tied] = at  # ties stay within their stretch of the array
            first = np.concatenate(([True], key[1:] != key[:-1]))
            rank = rank.copy()
            rank[at] = tied[np.flatnonzero(first)][np.cumsum(first) - 1]
            self.ranks.append(rank)
            tied = tied[_tied(first)]
            step *= 2

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The words by which the places agree from there on; ``i`` and ``j`` differ."""
        i, j = i.copy(), j.copy()
        start, last = i.copy(), len(self.array) - 1
        for k in range(len(self.ranks) - 1, -1, -1):
            far = (self.ranks[k][i] == self.ranks[k][j]).astype(np.int64) << k
            i, j = np.minimum(i + far, last), np.minimum(j + far, last)
        return i - start

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The words by which the places agree from there backwards, both included; places below 0 agree with none."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = i - (1 << k) + 1, j - (1 << k) + 1
            same = (a >= 0) & (b >= 0) & (self.ranks[k][np.maximum(a, 0)] == self.ranks[k][np.maximum(b, 0)])
            far = same.astype(np.int64) << k
            i, j = i - far, j - far
        return start - i

    def lcp(self) -> np.ndarray:
        """For each place of the array, the words that its suffix shares with the one before it; 0 for the first."""
        out = np.zeros(len(self.array), np.int64)
        one, two = self.array[:-1].astype(np.int64), self.array[1:].astype(np.int64)
        some = np.flatnonzero(self.ranks[0][one] == self.ranks[0][two])
        out[some + 1] = self.ahead(one[some], two[some])
        return out

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        """(length, source) of the longest previous factor of each place of the sequence; source -1 if there is none."""
        lcp, n = self.lcp(), len(self.array)
        length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        for array, shared in ((self.array, lcp), (self.array[::-1], np.concatenate(([0], lcp[:0:-1])))):
            before, least = _nearest_smaller(array, shared)
            some = np.flatnonzero(least > 0)
            at, least, before = array[some], least[some], array[before[some]]
            better = (least > length[at]) | ((least == length[at]) & (before < source[at]))
            length[at[better]], source[at[better]] = least[better], before[better]
        return length, source


def _tied(first: np.ndarray) -> np.ndarray:
    """The places that are not alone between two marks."""
    return np.flatnonzero(~(first & np.concatenate((first[1:], [True]))))


def _nearest_smaller(values: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, least): the nearest smaller value before each, and the least of ``shared`` from there; ends where that is 0."""
    before, least = np.arange(-1, len(values) - 1), shared.copy()
    active = np.flatnonzero(least > 0)
    active = active[values[before[active]] > values[active]]
    for _ in range(HOPS):
        if not len(active):
            break
        over = before[active]
        least[active] = np.minimum(least[active], least[over])
        before[active] = before[over]
        active = active[least[active] > 0]
        active = active[values[before[active]] > values[active]]
    if len(active):  # in order of place, so all before them are settled and each is passed once
        b, m, v = before.tolist(), least.tolist(), values.tolist()
        for i in active.tolist():
            while m[i] and v[b[i]] > v[i]:
                m[i] = min(m[i], m[b[i]])
                b[i] = b[b[i]]
        before, least = np.array(b, np.int64), np.array(m, np.int64)
    return before, least


def blocks(length: np.ndarray) -> np.ndarray:
    """The starts of the LZ blocks and the end of the last."""
    steps, starts, at = np.maximum(length, 1).tolist(), [], 0
    while at < len(steps):
        starts.append(at)
        at += steps[at]
    return np.array([*starts, len(steps)], np.int64)


def border_runs(repeats: Repeats, numbers: np.ndarray, borders: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """Rows (start, end, period): the runs that cross or touch a border, ascending, each with its smallest period."""
    sizes = np.concatenate(([0], np.diff(borders), [0]))
    most = (sizes[:-1] + sizes[1:]) // (exponent - 1)
    s = np.repeat(borders, most)
    p = np.arange(1, len(s) + 1) - np.repeat(np.cumsum(most) - most, most)
    n, found = len(numbers), [np.zeros((0, 3), np.int64)]
    for sign in (-1, 1):  # against the place a period before, or after
        other = s + sign * p
        inside = (other >= 0) & (other < n)
        right = inside & (s < n) & (numbers[np.minimum(s, n - 1)] == numbers[np.clip(other, 0, n - 1)])
        left = inside & (s > 0) & (other > 0) & (numbers[np.maximum(s - 1, 0)] == numbers[np.clip(other - 1, 0, n - 1)])
        if sign < 0:
            left &= other > 0
        use = np.flatnonzero(right | left)
        a, b, q = s[use], other[use], p[use]
        more, less = np.zeros(len(use), np.int64), np.zeros(len(use), np.int64)
        go = np.flatnonzero(right[use])
        more[go] = repeats.ahead(a[go], b[go])
        go = np.flatnonzero(left[use])
        less[go] = repeats.back(a[go] - 1, b[go] - 1)
        start, end = np.minimum(a, b) - less, np.maximum(a, b) + more
        good = end - start >= np.maximum(least, exponent * q)
        found.append(np.column_stack((start[good], end[good], q[good])))
    rows = np.unique(np.concatenate(found), axis=0)  # of one stretch, the smallest period first
    same = np.zeros(len(rows), bool)
    same[1:] = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
    return rows[~same]


def all_runs(numbers: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, end, period), by start and period, of the runs of a sequence whose last number occurs once."""
    repeats = Repeats(numbers)
    length, source = repeats.factors()
    borders = blocks(length)
    rows = border_runs(repeats, numbers, borders, least, exponent)
    if not len(rows):
        return rows
    bucket: dict[int, list[tuple[int, int]]] = defaultdict(list)  # end and period by start
    for start, end, period in rows.tolist():
        bucket[start].append((end, period))
    starts, ends = borders[:-1], borders[1:]
    after = rows[0, 0]  # no run begins before it, so none is copied from there
    for a, b in zip(*(x[(ends - starts > least + 1) & (ends > after)].tolist() for x in (starts, ends)), strict=True):
        move = a - int(source[a])
        if source[a] < 0:
            continue
        for start in range(a + 1, b - least):
            if (start - move) in bucket:
                bucket[start].extend((end + move, period) for end, period in bucket[start - move] if end + move < b)
    out = np.array([(start, end, period) for start, runs in bucket.items() for end, period in runs], np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 1], out[:, 2], out[:, 0]))]


def _detect(least: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                yield _of_slice(part, least, exponent)

    return run


def _of_slice(part: pa.RecordBatch, least: int, exponent: int) -> pa.RecordBatch:
    offsets, codes, vocabulary = split_words(part.column("text"), lower=False)
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    width = len(vocabulary) + 1  # and a number for the end of each text
    numbers = np.empty(len(codes) + len(n), np.int64)
    at = offsets[:-1] + np.arange(len(n))  # where each text begins in the sequence
    numbers[at + n] = np.arange(len(n)) * width + width - 1
    numbers[np.arange(len(codes)) + doc] = codes + doc * width
    rows = all_runs(numbers, least, exponent) if len(numbers) else np.zeros((0, 3), np.int64)
    of = np.searchsorted(at, rows[:, 0], "right") - 1
    gone = np.zeros(len(codes) + 1, np.int64)  # words from a run's second period on
    np.add.at(gone, rows[:, 0] + rows[:, 2] - of, 1)
    np.add.at(gone, rows[:, 1] - of, -1)
    kept = np.cumsum(gone[:-1]) == 0
    words, spoilt = [vocabulary[c] for c in codes[kept].tolist()], np.concatenate(([0], np.cumsum(kept)))[offsets]
    collapsed = [" ".join(words[a:b]) for a, b in zip(spoilt[:-1].tolist(), spoilt[1:].tolist(), strict=True)]
    inner = [pa.array(x.astype(np.int64)) for x in (rows[:, 0] - at[of], rows[:, 1] - rows[:, 0], rows[:, 2])]
    ends = np.searchsorted(of, np.arange(len(n) + 1)).astype(np.int32)
    runs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(inner, names=["start", "length", "period"]))
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int64)), runs, pa.array(collapsed, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs`` (doc_id, text): runs (start, length, period) of words, by start
    and period, with at least ``least`` words and ``exponent`` periods (2 or more); the text without what runs repeat."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_detect(least, exponent)), SCHEMA)


def planted(doc_id: Column, text: Column) -> Column:
    """The text, or for a tenth of the documents its words with a stretch repeated to the end, as the checksum of the id has it."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def repeated(x: Column) -> Column:
        n, g = F.size(x["w"]).cast("long"), F.floor(x["h"] / 10).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(x["w"], F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # the words are an element of an array, so that they are found once a row and not once a word
    made = F.get(F.transform(F.array(F.struct(words.alias("w"), h.alias("h"))), lambda x: F.when(F.size(x["w"]) > 0, repeated(x)).otherwise("")), 0)
    return F.when(h % 10 == 0, made).otherwise(text)


def runs_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of every document, with stretches planted."""
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    first = F.get("runs", 0)
    better = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    best = F.aggregate("runs", first, better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
