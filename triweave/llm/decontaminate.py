"""Operator 4, benchmark decontamination by latent semantic retrieval.

The benchmark is taken in blocks of items of about BLOCK_WORDS words, each on its own:

1. Words (lower-cased, outer punctuation trimmed) become numbers of the block's vocabulary; other words
   are gaps that keep their place, and punctuation that stands alone is none.  The texts are read and split
   once; their codes are kept as a table.
2. Passages are spans of PASSAGE words of a document.  Document frequencies of the terms over all passages
   give idf weights; one more pass adds up the sketch Z = A'(A R) of the TF-IDF passage matrix A with a
   random R, a matrix of vocabulary by sketch width, and Z gives the leading right singular vectors.
3. Every window of a document, a step of HOP words apart and long enough to hold an item whole wherever it
   starts, is compared with the items of that length by cosine in the latent space.  Items with fewer than
   TERMS terms that weigh anything, or without a share in the leading vectors, are left to step 4.
4. The cosine loses items among other benchmark words, so windows are also retrieved exactly: a match keeps
   all but m of an item's places, so of its m + r rarest places at least r have their word in the window.
   Every window that passes the checks below does so, verbatim items of any length among them.
5. Candidates are checked: the longest common subsequence with the item must reach LCS_SHARE of its words,
   and its answer, the words of its last sentence or its last ANSWER words, must be there by ANSWER_SHARE.
   Items under LEAST words must occur word for word.
6. What only the latent space can find: a window whose cosine is PARAPHRASE_COSINE or more and that fails these
   checks is a paraphrase if the longest common subsequence reaches PARAPHRASE_SHARE when words count as equal whose
   latent vectors have a cosine of CLOSE or more, such words stand for that share of the item's distinct terms
   that weigh anything, the answer is there by ANSWER_SHARE in the same sense, and PARAPHRASE_EXACT of the item's
   words are there themselves and in order, as texts on one subject have close words too.

The cosine of a match is null where the latent space would have lost its best window; ``paraphrase`` tells matches that
step 6 alone made.

Defined results: null and empty texts match nothing, null and empty items neither; items of one text each
match; repeated documents each match; extra columns are ignored; with an empty table there are no matches.
A block's items, vocabulary and basis are what the driver holds and broadcasts at a time.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triweave.llm.words import split_words, text_slices, tidy, worker_state
from triweave.plans.scratch import Scratch

PASSAGE, HOP, RANK, EXTRA, BLOCK_WORDS = 32, 16, 128, 16, 1 << 17
COMMON, TERMS = 0.02, 3
#: Of an item's rarest places, how many more than the checks demand must be in a window; pairs of words and items opened at once.
HITS, PAIRS = 4, 1 << 21
COSINE, LCS_SHARE, ANSWER, ANSWER_SHARE, LEAST = 0.5, 0.6, 8, 0.5, 8
PARAPHRASE_COSINE, PARAPHRASE_SHARE, PARAPHRASE_EXACT, CLOSE = 0.7, 0.8, 0.4, 0.6
PUNCTUATION = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "«»“”„‘’…–—¡¿"
SLICE, LONG = 1 << 19, 64
SPACE = r"[\x20\x09-\x0D]+"


def pieces_of(text: str | None) -> list[str]:
    return [w for w in re.split(SPACE, text or "") if w]


def normal(word: str) -> str:
    return word.strip(PUNCTUATION).lower()


class Vocabulary:
    """Numbers from 0 for a block's words."""

    def __init__(self, words: set[str]):
        keys = sorted(words - {""})
        self.number = dict(zip(keys, range(len(keys)), strict=True))
        self.size = len(keys)
        self.number[None] = -2  # no word: punctuation alone

    def codes(self, words: list[str]) -> np.ndarray:
        get = self.number.get
        return np.array([get(normal(w) or None, -1) for w in words], np.int32)


def _code(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("plain", dict)
        vocabulary = shared.value
        for batch in batches:
            for part in text_slices(batch):
                offsets, codes, words = split_words(part.column("text"))
                flat = vocabulary.codes(words)[codes].astype("<i4") if len(words) else np.zeros(0, "<i4")
                offsets = np.concatenate(([0], np.cumsum(flat > -2)))[offsets]
                flat = flat[flat > -2]
                if vocabulary.size < 1 << 15:
                    flat = flat.astype("<i2")
                ends = pa.py_buffer((offsets * flat.itemsize).astype(np.int64))
                column = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, ends, pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), column.cast(pa.binary())], names=["doc_id", "codes"])

    return run


def _coded(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_ids, offsets, codes) of slices of bounded size; no document is cut."""
    kind = np.dtype("<i2" if size < 1 << 15 else "<i4")
    for batch in batches:
        for part in text_slices(batch, "codes", SLICE):
            column = pa.concat_arrays([part.column("codes").cast(pa.large_binary())])
            ends = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1] // kind.itemsize
            codes = np.frombuffer(column.buffers()[2] or b"", kind)[: ends[-1]].astype(np.int64)
            yield part.column("doc_id"), ends, codes


def _spans(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(span number of each word, first span of each document): spans of ``width`` words from each document's start."""
    n = np.diff(offsets)
    first = np.concatenate(([0], np.cumsum(-(-n // width))))
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], n)
    return np.repeat(first[:-1], n) + at // width, first


def _terms(offsets: np.ndarray, codes: np.ndarray, size: int, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, term, count) of the terms in passages, in order of passage; passages are renumbered."""
    span, _ = _spans(offsets, PASSAGE)
    known = codes >= 0
    if used is not None:
        known &= used[codes]
    key, tf = np.unique(span[known] * size + codes[known], return_counts=True)
    return key // size, key % size, tf


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, passages = np.zeros(size + 1, np.int64), 0
        for _, offsets, codes in _coded(batches, size):
            _, term, _ = _terms(offsets, codes, size)
            df[:size] += np.bincount(term, minlength=size)
            passages += int((-(-np.diff(offsets) // PASSAGE)).sum())
        df[size] = passages  # the last row counts the passages
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(df[seen], pa.int64())], names=["term", "n"])

    return run


def run_sums(rows: np.ndarray, index: np.ndarray, weight: np.ndarray | None, starts: np.ndarray) -> np.ndarray:
    """The sums of ``rows[index] * weight`` over the runs of ``index`` that begin at ``starts``: the first of all
    runs, then the second of those that have one, and so on; long runs as products of their own."""
    times = np.diff(starts, append=len(index))
    order = np.argsort(-times, kind="stable")
    begin, times = starts[order], times[order]

    def place(at: np.ndarray) -> np.ndarray:
        x = np.take(rows, index[at], axis=0)
        return x if weight is None else x * weight[at][:, None]

    long = int(np.searchsorted(-times, -LONG, "left"))  # runs of more than LONG rows
    out = np.empty((len(starts), rows.shape[1]), rows.dtype)
    for r in range(long):
        span = slice(begin[r], begin[r] + times[r])
        ones = np.ones(times[r], rows.dtype) if weight is None else weight[span]
        out[order[r]] = ones @ np.take(rows, index[span], axis=0)
    begin, times = begin[long:], times[long:]
    if len(begin):
        total = place(begin)
        for j in range(1, int(times[0])):
            m = int(np.searchsorted(-times, -j, "left"))
            total[:m] += place(begin[:m] + j)
        out[order[long:]] = total
    return out


def random_matrix(size: int, width: int, seed: int = 4) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, width)).astype(np.float32)


def _sketch(shared, size: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        weighted = random_matrix(size, width) * idf[:, None]
        z = np.zeros((size, width))
        for _, offsets, codes in _coded(batches, size):
            passage, term, tf = _terms(offsets, codes, size, idf > 0)
            if not len(term):
                continue
            tf = tf.astype(np.float32)
            starts = np.flatnonzero(np.diff(passage, prepend=-1))
            y = run_sums(weighted, term, tf, starts)
            own = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(term)))
            order = np.argsort(term, kind="stable")
            ends = np.flatnonzero(np.diff(term[order], prepend=-1))
            z[term[order][ends]] += run_sums(y, own[order], tf[order], ends)
        z *= idf[:, None]
        blocks = range(0, size, 256)
        yield pa.RecordBatch.from_arrays([pa.array([b // 256 for b in blocks], pa.int64()), pa.array([z[b : b + 256].tobytes() for b in blocks], pa.binary())], names=["block", "z"])

    return run


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in table.column("z"))
    return pa.table({"block": pa.array(table.column("block").combine_chunks().slice(0, 1), pa.int64()), "z": pa.array([total.tobytes()], pa.binary())})


def singular_vectors(z: np.ndarray, r: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors of A, and its singular values, from Z = A'A R (Nystroem's formula)."""
    inner = r.T.astype(float) @ z
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    good = values > max(values.max(initial=0), 0) * 1e-9
    if not good.any():
        return np.zeros((len(z), 0), np.float32), np.zeros(0, np.float32)
    v, s, _ = np.linalg.svd(z @ vectors[:, good] / np.sqrt(values[good]), full_matrices=False)
    rank = min(rank, int((s > s[0] * 1e-6).sum()))
    return v[:, :rank].astype(np.float32), s[:rank].astype(np.float32)


def inverse_frequencies(df: np.ndarray, passages: int) -> np.ndarray:
    """Squared log(passages / df).  Terms in more than COMMON of the passages weigh nothing, whatever the
    items: one with fewer than TERMS other terms is left to the exact retrieval and changes no other's."""
    idf = (np.log1p(passages / np.maximum(df, 1)) ** 2).astype(np.float32)
    return np.where(df > COMMON * passages, 0, idf).astype(np.float32)


def latent_basis(spark: SparkSession, codes: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(passages, idf, singular vectors, unit vectors of terms) of the TF-IDF passages of all documents, for each term of the vocabulary.

    A term's unit vector is its row of A'A in the latent space, so terms are close that keep the same company."""
    counts = {r.term: r.n for r in codes.mapInArrow(_frequencies(size), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row a term
    df = np.array([counts.get(t, 0) for t in range(size)], float)
    idf = inverse_frequencies(df, counts.get(size, 0))
    width = RANK + EXTRA
    shared = spark.sparkContext.broadcast(idf)
    parts = codes.mapInArrow(tidy(_sketch(shared, size, width)), "block long, z binary").groupBy("block").applyInArrow(_add, "block long, z binary").collect()
    z = np.zeros((-(-size // 256) * 256, width))
    for p in parts:
        x = np.frombuffer(p.z, np.float64).reshape(-1, width)
        z[p.block * 256 : p.block * 256 + len(x)] = x
    vectors, values = singular_vectors(z[:size], random_matrix(size, width), RANK)
    return df, idf, vectors, np.where((idf > 0)[:, None], unit_rows(vectors * values**2), 0).astype(np.float32)


def lcs(masks: dict[int, int], words: list[int]) -> int:
    """Length of the longest common subsequence; masks: the places of each item word, as bits."""
    row = 0
    for w in words:
        x = row | masks.get(w, 0)
        row = x & ~(x - ((row << 1) | 1))
    return row.bit_count()


class Items:
    """Benchmark items with their latent vectors, by the number of hops of the windows they are compared with."""

    def __init__(self, rows: list[tuple[int, str]], vocabulary: Vocabulary, basis: np.ndarray, used: np.ndarray, df: np.ndarray):
        self.ids, self.words, self.masks, self.answers, groups = [], [], [], [], {}
        hops, need, postings = [], [], []
        for item_id, text in rows:
            pieces = pieces_of(text)
            codes = [int(c) for c in vocabulary.codes(pieces)] if pieces else []
            last = max((i + 1 for i, p in enumerate(pieces[:-1]) if p[-1] in ".?!"), default=0)
            answer = codes[max(last, len(codes) - ANSWER) if len(codes) - last >= 2 else -ANSWER :]
            codes, answer = [c for c in codes if c >= 0], [c for c in answer if c >= 0]
            if not codes:
                continue
            v, terms = basis[codes].sum(axis=0), len({c for c in codes if used[c]})
            if terms >= TERMS and (norm := float(np.linalg.norm(v))):
                groups.setdefault(-(-len(codes) // HOP) + 1, []).append((len(self.words), v / norm))
            least = len(codes) if len(codes) < LEAST else next(k for k in range(1, len(codes) + 1) if k / len(codes) >= LCS_SHARE)
            hits = min(HITS, least)
            rarest, times = np.unique(sorted(codes, key=lambda c: (df[c], c))[: len(codes) - least + hits], return_counts=True)
            postings += [(c, len(self.words), t) for c, t in zip(rarest.tolist(), times.tolist(), strict=True)]
            hops.append(-(-len(codes) // HOP) + 1)
            need.append(hits)
            masks: dict[int, int] = {}
            for i, c in enumerate(codes):
                masks[c] = masks.get(c, 0) | 1 << i
            self.ids.append(item_id)
            self.words.append(codes)
            self.masks.append(masks)
            self.answers.append(answer or codes)
        self.groups = {h: (np.array([n for n, _ in g]), np.array([v for _, v in g], np.float32)) for h, g in groups.items()}
        self.hops, self.need = np.array(hops, np.int64), np.array(need, np.int64)
        table = np.array(sorted(postings), np.int64).reshape(-1, 3)
        self.post_item, self.post_times = table[:, 1], table[:, 2]
        self.posted = np.bincount(table[:, 0], minlength=vocabulary.size)
        self.post_start = np.cumsum(self.posted) - self.posted

    def check(self, number: int, window: list[int]) -> tuple[float, float] | None:
        """(share of the item in the longest common subsequence, share of the answer's words) of a match."""
        item = self.words[number]
        if len(item) < LEAST:
            known = ",".join(map(str, window))
            return (1.0, 1.0) if f",{','.join(map(str, item))}," in f",{known}," else None
        masks = self.masks[number]
        if sum(w in masks for w in window) < LCS_SHARE * len(item):
            return None
        share = lcs(masks, window) / len(item)
        if share < LCS_SHARE:
            return None
        held, answer = set(window), self.answers[number]
        there = sum(w in held for w in answer) / len(answer)
        return (share, there) if there >= ANSWER_SHARE else None


    def paraphrased(self, number: int, window: list[int], terms: np.ndarray, used: np.ndarray) -> tuple[float, float] | None:
        """As ``check``, with words equal whose latent vectors are close."""
        item = self.words[number]
        there = np.unique([w for w in window if w >= 0])
        if len(item) < LEAST or not len(there):
            return None
        own = np.array(list(self.masks[number]))
        near = terms[there] @ terms[own].T >= CLOSE
        near |= there[:, None] == own[None, :]
        weighing = used[own]
        if near.any(axis=0)[weighing].sum() < PARAPHRASE_SHARE * weighing.sum():
            return None
        masks = {w: m for w, row in zip(there.tolist(), near, strict=True) if (m := functools.reduce(int.__or__, (self.masks[number][u] for u in own[row].tolist()), 0))}
        if sum(w in masks for w in window) < PARAPHRASE_SHARE * len(item):
            return None
        share = lcs(masks, window) / len(item)
        if share < PARAPHRASE_SHARE or lcs(self.masks[number], window) < PARAPHRASE_EXACT * len(item):
            return None
        found = set(own[near.any(axis=0)].tolist())
        answer = self.answers[number]
        there_of_answer = sum(w in found for w in answer) / len(answer)
        return (share, there_of_answer) if there_of_answer >= ANSWER_SHARE else None


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of zeros stay."""
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)


def candidates(offsets: np.ndarray, codes: np.ndarray, items: Items, basis: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, ...]:
    """(documents, item numbers, first words, ends, cosines) of the windows near an item in the latent space."""
    found = [[], [], [], [], []]
    hop, first = _spans(offsets, HOP)
    hops = np.zeros((first[-1] + 1, basis.shape[1]), np.float32)
    known = np.flatnonzero((codes >= 0) & used[codes])
    if not len(known):
        return _joined(found)
    starts = np.flatnonzero(np.diff(hop[known], prepend=-1))
    hops[hop[known][starts]] = run_sums(basis, codes[known], None, starts)
    terms = np.bincount(hop[known], minlength=first[-1] + 1)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    end = first[1:][doc]  # no window crosses a document's end
    here = np.arange(first[-1])
    for width, (numbers, vectors) in items.groups.items():
        held = sum(np.where(here + j < end, terms[np.minimum(here + j, len(here) - 1)], 0) for j in range(width))
        some = np.flatnonzero(held >= TERMS)
        for at in range(0, len(some), 4096):
            w = some[at : at + 4096]
            total = hops[w]
            for j in range(1, width):
                inside = np.flatnonzero(w + j < end[w])
                total[inside] += hops[w[inside] + j]
            total /= np.maximum(np.linalg.norm(total, axis=1), 1e-12)[:, None]
            near = total @ vectors.T
            h, i = np.nonzero(near >= COSINE)
            d = doc[w[h]]
            start = offsets[d] + (w[h] - first[d]) * HOP
            for column, x in zip(found, (d, numbers[i], start, np.minimum(start + width * HOP, offsets[d + 1]), near[h, i]), strict=True):
                column.append(x)
    return _joined(found)


def _joined(columns: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns)


def promising(codes: np.ndarray, items: Items, size: int, number: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which windows hold enough words of the item to pass the checks, whatever their order."""
    out, mark = np.zeros(len(number), bool), np.zeros(size + 1, bool)  # the last place: words of no item
    order = np.argsort(number, kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(number[order])) + 1) if len(order) else ():
        words = items.words[number[run[0]]]
        mark[words] = True
        width = int((end[run] - start[run]).max())
        for at in range(0, len(run), 1 << 14):
            part = run[at : at + (1 << 14)]
            place = start[part][:, None] + np.arange(width)
            held = mark[codes[np.minimum(place, len(codes) - 1)]] & (place < end[part][:, None])
            out[part] = held.sum(axis=1) >= (len(words) if len(words) < LEAST else LCS_SHARE * len(words))
        mark[words] = False
    return out


def exact_candidates(offsets: np.ndarray, codes: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """(documents, item numbers, first words, ends) of every window that holds enough of an item's rarest places to pass the checks."""
    found = [[], [], [], []]
    if not len(items.hops):
        return _joined(found)
    hop, first = _spans(offsets, HOP)
    known = np.flatnonzero(codes >= 0)
    known = known[items.posted[codes[known]] > 0]
    if not len(known):
        return _joined(found)
    # a hop's words count once each
    size = len(items.posted)
    at, word = np.divmod(np.unique(hop[known] * size + codes[known]), size)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    widest, n_items = int(items.hops.max()), len(items.hops)
    opened = np.concatenate(([0], np.cumsum(np.bincount(at, items.posted[word], minlength=first[-1]))))
    begin = 0
    while begin < first[-1]:  # windows that start in [begin, stop)
        stop = max(begin + widest, int(np.searchsorted(opened, opened[begin] + PAIRS, "right")) - 1)
        stop = min(stop, int(first[-1]))
        a, b = np.searchsorted(at, (begin, stop + widest - 1))
        times = items.posted[word[a:b]]
        entry = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(items.post_start[word[a:b]], times)
        place, item = np.repeat(at[a:b], times), items.post_item[entry]
        keys = []
        for j in range(widest):
            start = place - j
            good = np.flatnonzero((j < items.hops[item]) & (start >= np.maximum(first[doc[place]], begin)) & (start < stop))
            keys.append(((start[good] * n_items + item[good]) * len(items.post_item) + entry[good]))
        keys = np.unique(np.concatenate(keys))  # a window's words count once each
        if len(keys):
            pair, entry = np.divmod(keys, len(items.post_item))
            heads = np.flatnonzero(np.diff(pair, prepend=-1))
            start, item = np.divmod(pair[heads], n_items)
            enough = np.add.reduceat(items.post_times[entry], heads) >= items.need[item]
            h, i = start[enough], item[enough]
            d = doc[h]
            word_at = offsets[d] + (h - first[d]) * HOP
            for column, x in zip(found, (d, i, word_at, np.minimum(word_at + items.hops[i] * HOP, offsets[d + 1])), strict=True):
                column.append(x)
        begin = stop
    return _joined(found)


MATCH_SCHEMA = "doc_id long, text_hash long, item_id long, lcs_share double, answer_share double, cosine double, paraphrase boolean"


def _scan(shared, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("plain", dict)
        items, basis, used, terms = shared.value
        for doc_ids, offsets, codes in _coded(batches, size):
            best: dict[tuple[int, int], tuple] = {}
            checked: set[tuple[int, int]] = set()
            near = candidates(offsets, codes, items, basis, used)
            for latent, (d, number, start, end, *cosine) in ((True, near), (False, exact_candidates(offsets, codes, items))):
                good = np.flatnonzero(promising(codes, items, size, number, start, end))
                for at, n, x, y, c in zip(*(v[good].tolist() for v in (d, number, start, end, cosine[0] if latent else start)), strict=True):
                    if latent or (n, x) not in checked:
                        result = items.check(n, codes[x:y].tolist())
                        if result and result > best.get((at, n), ((0.0, 0.0),))[0]:
                            best[at, n] = result, items.ids[n], c if latent else None
                    if latent:
                        checked.add((n, x))
            d, number, start, end, cosine = (v[near[4] >= PARAPHRASE_COSINE].tolist() for v in near)
            paraphrases: dict[tuple[int, int], tuple] = {}
            for at, n, x, y, c in zip(d, number, start, end, cosine, strict=True):
                if (at, n) not in best:
                    result = items.paraphrased(n, codes[x:y].tolist(), terms, used)
                    if result and result > paraphrases.get((at, n), ((0.0, 0.0),))[0]:
                        paraphrases[at, n] = result, items.ids[n], c
            ids = doc_ids.to_pylist()
            rows = [(ids[d]["doc_id"], ids[d]["text_hash"], item_id, *found, cosine, held is paraphrases) for held in (best, paraphrases) for (d, _), (found, item_id, cosine) in sorted(held.items())]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "text_hash", "item_id", "lcs_share", "answer_share", "cosine", "paraphrase"])

    return run


def benchmark_matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, lcs_share, answer_share, cosine, paraphrase) of each document and each item that it holds."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    keyed = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")).alias("doc_id"), "text")
    blocks = -(-(items.agg(F.sum(F.size(F.split("text", SPACE)))).first()[0] or 0) // BLOCK_WORDS)
    with Scratch(spark, "decontaminate") as s:
        found = [s.table(_block_matches(spark, keyed, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b), s)) for b in range(blocks)]
        return s.keep(functools.reduce(DataFrame.unionByName, found, spark.createDataFrame([], MATCH_SCHEMA)))


def _block_matches(spark: SparkSession, keyed: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    rows = [(r.item_id, r.text) for r in items.orderBy("item_id", "text").collect()]  # about BLOCK_WORDS words
    vocabulary = Vocabulary({normal(w) for _, text in rows for w in pieces_of(text)})
    if not vocabulary.size:
        return spark.createDataFrame([], MATCH_SCHEMA)
    known = spark.sparkContext.broadcast(vocabulary)
    codes = scratch.table(keyed.mapInArrow(tidy(_code(known)), "doc_id struct<doc_id:long,text_hash:long>, codes binary"))
    df, idf, vectors, terms = latent_basis(spark, codes, vocabulary.size)
    basis, used = vectors * idf[:, None], idf > 0
    shared = spark.sparkContext.broadcast((Items(rows, vocabulary, basis, used, df), basis, used, terms))
    return codes.mapInArrow(tidy(_scan(shared, vocabulary.size)), MATCH_SCHEMA)


def without_benchmark(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item."""
    leaks = benchmark_matches(spark, docs, benchmark).select(F.col("doc_id").alias("_leak"), F.col("text_hash").alias("_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(leaks["_leak"]) & (F.xxhash64(docs["text"]) == leaks["_hash"])  # the row itself, whatever shares its id
    return docs.join(leaks, same, "left_anti").select(docs.columns)
