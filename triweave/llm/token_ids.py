"""Operator 1, token-ID / binary output.

Texts are tokenised whole; ids are replaced by their rank in order of falling corpus frequency and
written in a byte-aligned variable-length code: one to four little-endian bytes for each rank, with the
lengths, two bits each, in separate control bytes.  Readers look the control bytes up in a table, so
decoding is a few numpy gathers.

File format: a Parquet folder ``blocks`` of rows (shard, block, start_in_shard, doc_ids, doc_lens,
n_ids, control, data), shards and blocks in ascending document order, and a Parquet folder ``ranks`` of
(rank, id).  A block holds whole documents.

Defined results: a null text counts as empty (only the end id); null doc_ids come first; rows that share
a doc_id keep a fixed order (length, a hash of the ids, then the ids) and each stay; extra columns are ignored; an empty table
gives empty files.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triweave.llm.words import split_words, text_slices, tidy, worker_state
from triweave.plans.scratch import Scratch

#: Words whose ids a worker remembers, and ids that a block holds before it is closed.
CACHE_WORDS, BLOCK_IDS = 500_000, 1 << 18
#: Bytes of text that are split at a time.
SLICE = 8 << 20
#: Byte lengths of the four ids that a control byte describes.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit numbers."""
    ranks = np.asarray(ranks, "<u4")
    n = len(ranks)
    wider = [np.flatnonzero(ranks >> np.uint32(8 * k)) for k in (1, 2, 3)]
    more = np.zeros(-(-n // 4) * 4, np.uint8)  # bytes after the first
    for at in wider:
        more[at] += 1
    codes = more.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    ends = np.cumsum(more[:n], dtype=np.int64) + np.arange(1, n + 1)
    starts = ends - more[:n] - 1
    data = np.empty(ends[-1] if n else 0, np.uint8)
    data[starts] = ranks.astype(np.uint8)
    for k, at in enumerate(wider, 1):
        data[starts[at] + k] = (ranks[at] >> np.uint32(8 * k)).astype(np.uint8)
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that ``encode_ranks`` coded."""
    lens = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    starts = np.cumsum(lens, dtype=np.int64) - lens
    raw = np.frombuffer(data, np.uint8)
    out = raw[starts].astype(np.uint32)
    for k in (1, 2, 3):
        at = np.flatnonzero(lens > k)
        out[at] |= raw[starts[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def lowered(texts: pa.Array) -> pa.Array:
    """``texts`` with A-Z in lower case where that changes no ids: not before a byte of another script, which may
    be a mark that composes with the capital first, and not in texts that may hold special tokens."""
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])  # from offset 0
    ends = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: ends[-1]].copy() if len(texts) else np.zeros(0, np.uint8)
    if not len(data):
        return texts
    capital = data - np.uint8(65) < 26
    capital[:-1] &= data[1:] < 128
    for i in np.flatnonzero(np.asarray(pc.match_substring(texts, "<|"))).tolist():
        capital[ends[i] : ends[i + 1]] = False
    data += capital.view(np.uint8) << np.uint8(5)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, texts.buffers()[1], pa.py_buffer(data)])


class WordTokenizer:
    """Ids of texts by a tokenizer that drops white space and splits there first, so that each piece
    between ASCII white space can be encoded once and remembered.  Same ids as for the whole text: only pieces
    of ASCII characters are lower-cased here or parted from a stop."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a special token between words keeps them apart when many are encoded in one call
        self.border = next((t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items())
        self.number: dict[str, int] = {}
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.stops = {c: int(self._encode([c])[1][0]) for c in ".,"}

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of words."""
        content, i = self.border
        if any("<|" in w for w in words):  # may hold a special token
            own = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.array([len(x) for x in own], np.int64), np.concatenate(own)
        sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for at in range(0, len(words), 2000):
            x = np.array(self.tokenizer.encode_batch_fast([content.join(words[at : at + 2000]) + content], add_special_tokens=False)[0].ids, np.uint32)
            sizes.append(np.diff(np.flatnonzero(x == i), prepend=-1) - 1)
            ids.append(x[x != i])
        return np.concatenate(sizes), np.concatenate(ids)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of new words; a full stop or comma after ASCII letters is a piece of its own."""
        stops = self.stops
        plain = [w.lower() if w.isascii() and "<|" not in w else w for w in words]
        cut = [w[-1] in stops and w.isascii() and w[:-1].isalpha() for w in plain]
        stems = [w[:-1] if c else w for w, c in zip(plain, cut, strict=True)]
        number = {s: i for i, s in enumerate(dict.fromkeys(stems))}
        special = ["<|" in w for w in number]
        order = sorted(range(len(number)), key=special.__getitem__)  # those that may hold special tokens last
        forms, n = list(number), len(number) - sum(special)
        parts = [self._encode([forms[i] for i in some]) for some in (order[:n], order[n:]) if some]
        sizes, ids = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
        rank = np.empty(len(number), np.int64)
        rank[order] = np.arange(len(number))
        of = rank[np.array([number[s] for s in stems], np.int64)]
        extra = np.array([stops[w[-1]] if c else -1 for w, c in zip(words, cut, strict=True)], np.int64)
        place, ends = _gather((np.cumsum(sizes) - sizes)[of], sizes[of], extra >= 0)
        out = np.append(ids, np.uint32(0))[np.minimum(place, len(ids))].astype(np.uint32)
        out[ends[extra >= 0] - 1] = extra[extra >= 0]
        return np.diff(ends, prepend=0), out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts."""
        offsets, codes, vocabulary = split_words(lowered(texts), lower=False)
        get = self.number.get
        at = np.array([get(w, -1) for w in vocabulary], np.int64)
        fresh = [vocabulary[i] for i in np.flatnonzero(at < 0).tolist() if vocabulary[i]]
        new_sizes, new_ids = self._learn(fresh)
        starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(new_sizes) - new_sizes))
        sizes, flat = np.concatenate((self.sizes, new_sizes)), np.concatenate((self.flat, new_ids))
        at[[i for i in np.flatnonzero(at < 0).tolist() if vocabulary[i]]] = len(self.starts) + np.arange(len(fresh))
        if len(self.number) < CACHE_WORDS:
            self.number.update(zip(fresh, range(len(self.starts), len(starts)), strict=True))
            self.starts, self.sizes, self.flat = starts, sizes, flat
        at = at[codes]
        place, ends = _gather(starts[at], sizes[at])
        return np.concatenate(([0], ends))[offsets], flat[place]


def _gather(starts: np.ndarray, sizes: np.ndarray, longer: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(indices, ends) of runs of a flat array laid one after another, some ``longer`` by one."""
    n = sizes + longer
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, int(starts.max(initial=0))) < 1 << 31 else np.int64
    return np.repeat((starts - (ends - n)).astype(kind), n) + np.arange(total, dtype=kind), ends


def _tokenise(path: str, end_id: int, id_type: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text, SLICE):
                tokenizer = worker_state(("tokenizer", path), lambda: WordTokenizer(path))
                offsets, ids = tokenizer(part.column(text))
                docs = np.insert(ids.astype(id_type), offsets[1:], end_id)
                ends = (offsets + np.arange(len(offsets))) * docs.itemsize
                ids_column = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(docs)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids_column.cast(pa.binary())], names=["doc_id", "ids"])

    return run


def _count(id_type: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids = batch.column("ids").cast(pa.large_binary())
            ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
            n = np.bincount(np.frombuffer(ids.buffers()[2], id_type)[ends[0] // np.dtype(id_type).itemsize : ends[-1] // np.dtype(id_type).itemsize])
            if len(n) > len(total):
                total = np.concatenate((total, np.zeros(len(n) - len(total), np.int64)))
            total[: len(n)] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    return run


BLOCK_SCHEMA = "shard int, block int, start_in_shard long, doc_ids array<long>, doc_lens array<long>, n_ids long, control binary, data binary"


def _encode(rank_of: np.ndarray, id_type: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            all_ids = np.concatenate(ids)
            control, data = encode_ranks(rank_of[all_ids])
            row = [shard, block, start, docs, [len(x) for x in ids], len(all_ids), control, data]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
            names = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                new = np.frombuffer(value.as_buffer(), id_type)
                if held and held + len(new) > BLOCK_IDS:
                    yield close()
                    block, start, docs, ids, held = block + 1, start + held, [], [], 0
                docs.append(doc_id)
                ids.append(new)
                held += len(new)
        if held:
            yield close()

    return run


def write_token_ids(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int, vocab_size: int, text: str = "text") -> dict[str, DataFrame]:
    """Writes the token-ID files of ``docs`` (doc_id, text) and returns their ``blocks`` and ``ranks``.

    The texts are read and tokenised once; the ids are kept as a table in the shared folder while their
    frequencies are counted.  The rank table has at most ``vocab_size`` rows, the only thing sent whole
    to the driver and to every task.
    """
    id_type = "<u2" if vocab_size <= 1 << 16 else "<u4"
    with Scratch(spark, "token-ids") as s:
        tokens = s.table(docs.select("doc_id", text).mapInArrow(_tokenise(tokenizer_path, end_id, id_type, text), "doc_id long, ids binary"))
        counts = tokens.select("ids").mapInArrow(_count(id_type), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
        by_rank = [r.id for r in sorted(counts, key=lambda r: (-r.n, r.id))]
        rank_of = np.zeros(max(by_rank, default=-1) + 1, np.uint32)
        rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        order = "doc_id", F.octet_length("ids"), F.xxhash64("ids")  # the hash parts the rows of one doc_id, null above all
        ordered = tokens.repartitionByRange(n, *order).sortWithinPartitions(*order, "ids")
        blocks = s.keep(ordered.mapInArrow(tidy(_encode(rank_of, id_type)), BLOCK_SCHEMA), "blocks")
        ranks = s.keep(spark.createDataFrame(list(enumerate(by_rank)), "rank long, id long").coalesce(1), "ranks")
    return {"blocks": blocks, "ranks": ranks}


def _decode(starts: dict[int, int], id_of: np.ndarray, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                lens = np.asarray(row["doc_lens"].values, np.int64)
                ids = id_of[decode_ranks(row["control"].as_buffer().to_pybytes(), row["data"].as_buffer().to_pybytes(), row["n_ids"].as_py())]
                ends = np.cumsum(lens)
                first = starts[row["shard"].as_py()] + row["start_in_shard"].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        row["doc_ids"].values,
                        pa.array(first + ends - lens, pa.int64()),
                        pa.array(lens, pa.int64()),
                        pa.array([zlib.crc32(ids[e - n : e]) for e, n in zip(ends, lens, strict=True)], pa.int64())
                        if digest
                        else pa.array([ids[e - n : e].tobytes() for e, n in zip(ends, lens, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    return run


def read_token_ids(spark: SparkSession, blocks: DataFrame, ranks: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids: little-endian unsigned 32-bit integers) of every document, from the files;
    with ``digest`` the ids' crc32 instead, so they need not leave the task."""
    id_of = np.array([r.id for r in sorted(ranks.collect(), key=lambda r: r.rank)], "<u4")
    starts, at = {}, 0
    for r in sorted(blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect(), key=lambda r: r.shard):  # a row for each file
        starts[r.shard] = at
        at += r.n
    return blocks.mapInArrow(_decode(starts, id_of, digest), f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}")


def token_id_output(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1, vocab_size: int = 49_408) -> DataFrame:
    """Writes the files, reads them back and digests each document's ids: (doc_id, start, n_tokens, ids_crc32)."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    files = write_token_ids(spark, docs, tokenizer_path, end_id, vocab_size)
    return read_token_ids(spark, files["blocks"], files["ranks"], digest=True)
