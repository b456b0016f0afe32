"""Token ids in a binary format: canonical length-limited Huffman codes from global counts, decoded by table.

A written corpus is a folder with two Parquet tables:

* ``codebook`` (id int, length int): code lengths; the canonical codes follow from them.
* ``blocks`` (start long, n_docs int, n_tokens long, block binary): consecutive documents in ascending id order. Each
  block decodes on its own. Its bytes: magic ``HUF1``, crc32 of the rest, n_docs, n_tokens, n_bits (u32, u32, u64),
  doc ids (i64), a null flag for each id (u8), token counts (u32), checkpoints (u32 bit offset of every
  CHECKPOINT-th code), then the bit stream, most significant bit first.

Decoding walks all checkpoints of a batch of blocks in step: one table look-up for each lane and step.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.bpe import loaded
from meterlake.llm.common import id_and_text, materialize, release, slices
from meterlake.llm.tokens import LibraryEncoder

MAGIC = b"HUF1"
#: Longest code in bits; three bytes hold a code at any bit position, a 64-bit word several.
MAX_BITS = 16
#: Codes between two bit-offset checkpoints.
CHECKPOINT = 128
#: A block is closed at this many tokens; a longer document is a block of its own.
BLOCK_TOKENS = 1 << 16
#: Words whose ids a worker keeps, in each of two generations; about 250 MB.
KEPT_WORDS = 600_000
#: Blocks that one decoding step handles together.
DECODE_BLOCKS = 24

_HEAD = struct.Struct("<4sIIIQ")


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for positive ``counts``, by package-merge.

    One symbol gets length 1. Ties go to the earlier symbol, so equal counts give equal codes in every run.
    """
    n = len(counts)
    if n == 0:
        return np.zeros(0, np.int64)
    if n == 1:
        return np.ones(1, np.int64)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols don't fit into codes of {max_bits} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    packages = np.zeros(0, np.int64)
    is_leaf = []
    for _ in range(max_bits):
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        is_leaf.append(rank < n)
        both = both[rank]
        even = len(both) // 2 * 2
        packages = both[0:even:2] + both[1:even:2]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for level in reversed(is_leaf):
        chosen = int(level[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical code of a codebook: codes by (length, id), and the table from the next MAX_BITS bits to symbol and length."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, size: int):
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order], lengths[order]
        self.code, self.length = np.zeros(size, np.uint32), np.zeros(size, np.uint8)
        self.table_id, self.table_length = np.zeros(1 << MAX_BITS, np.uint32), np.ones(1 << MAX_BITS, np.uint8)
        width = 1 << (MAX_BITS - lengths)  # entries of the table that begin with the code
        ends = np.cumsum(width)
        self.code[ids], self.length[ids] = (ends - width) >> (MAX_BITS - lengths), lengths
        used = int(ends[-1]) if len(ids) else 0
        self.table_id[:used], self.table_length[:used] = np.repeat(ids, width), np.repeat(lengths, width)

    def pack(self, ids: np.ndarray) -> tuple[np.ndarray, int, bytes]:
        """(checkpoints, number of bits, bit stream) of ``ids``."""
        length = self.length[ids].astype(np.uint64)
        if not len(ids):
            return np.zeros(0, "<u4"), 0, b""
        if not length.all():
            raise ValueError("an id has no code")
        end = np.cumsum(length)
        begin = end - length
        n_bits = int(end[-1])
        word, free = begin >> 6, 64 - (begin & 63)
        over = np.flatnonzero(length > free)  # codes that run on into the next 64-bit word
        code = self.code[ids].astype(np.uint64)
        place = code << (free - length)
        place[over] = code[over] >> (length[over] - free[over])
        out = np.zeros(n_bits // 64 + 2, np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=word[:1] - 1))  # a code is no longer than a word, so each word has a first
        out[: len(first)] = np.bitwise_or.reduceat(place, first)
        out[word[over] + 1] |= code[over] << (64 + free[over] - length[over])
        return begin[::CHECKPOINT].astype("<u4"), n_bits, out.astype(">u8").tobytes()[: (n_bits + 7) // 8]

    def unpack(self, streams: list[bytes], checkpoints: list[np.ndarray], n_tokens: list[int]) -> list[np.ndarray]:
        """Ids of each stream; all checkpoints of all streams advance together."""
        lanes = np.array([(n + CHECKPOINT - 1) // CHECKPOINT for n in n_tokens])
        if not lanes.sum():
            return [np.zeros(0, np.uint32) for _ in streams]
        base = np.cumsum([0, *(len(s) for s in streams)])[:-1]
        raw = np.frombuffer(b"".join(streams) + bytes(8), np.uint8).astype(np.uint32)
        window = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
        at = np.concatenate(checkpoints).astype(np.int64) + np.repeat(base * 8, lanes)
        out = np.empty((CHECKPOINT, len(at)), np.uint32)
        last = (len(window) - 1) * 8
        for step in range(CHECKPOINT):
            bits = (window[at >> 3] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF
            out[step] = self.table_id[bits]
            at += self.table_length[bits]
            np.minimum(at, last, out=at)  # lanes that have ended run on into nothing
        rows, ends = out.T, np.cumsum(lanes)
        return [rows[e - k : e].reshape(-1)[:n] for e, k, n in zip(ends, lanes, n_tokens)]


def write_block(code: Code, doc_ids: list, n_tokens: np.ndarray, ids: np.ndarray) -> bytes:
    checkpoints, n_bits, stream = code.pack(ids)
    null = np.array([d is None for d in doc_ids], np.uint8)
    rest = b"".join([np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(), n_tokens.astype("<u4").tobytes(), checkpoints.tobytes(), stream])
    head = _HEAD.pack(MAGIC, 0, len(doc_ids), len(ids), n_bits)
    return head[:4] + struct.pack("<I", zlib.crc32(head[8:] + rest)) + head[8:] + rest


def read_block(block: bytes):
    """(doc ids, token counts, checkpoints, bit stream, number of tokens); raises ValueError for a damaged block."""
    magic, crc, n_docs, n_tokens, _ = _HEAD.unpack_from(block)
    if magic != MAGIC or crc != zlib.crc32(memoryview(block)[8:]):
        raise ValueError("damaged block")
    at = _HEAD.size
    doc_ids = np.frombuffer(block, "<i8", n_docs, at)
    null = np.frombuffer(block, np.uint8, n_docs, at + 8 * n_docs)
    counts = np.frombuffer(block, "<u4", n_docs, at + 9 * n_docs)
    at += 13 * n_docs
    n_points = (n_tokens + CHECKPOINT - 1) // CHECKPOINT
    points = np.frombuffer(block, "<u4", n_points, at)
    return [None if z else d for d, z in zip(doc_ids.tolist(), null)], counts, points, block[at + 4 * n_points :], n_tokens


def tokenise_in_order(docs: DataFrame, vocabulary: str, end_id: int | None) -> DataFrame:
    """Blocks of documents in ascending id order (nulls first; equal ids by a hash of the text): (part, at, doc_ids, n_tokens, ids, seen, n).

    The texts are dealt by ranges of (id, text hash), so many rows of one id are split too; the parts follow each
    other in order, and ``at`` counts the ids before a block within its part. The last row of a part has no documents
    but the counts of its ids: ``n`` of each id ``seen``; elsewhere both are null.
    """
    tail = [] if end_id is None else [end_id]

    def run(batches):
        encoder, part, before = loaded(LibraryEncoder, vocabulary, KEPT_WORDS), TaskContext.get().partitionId(), 0
        end = np.array(tail, encoder.dtype).tobytes()
        doc_ids, sizes, held, size = [], [], [], 0
        total = np.zeros(encoder.size, np.int64)

        def row(seen=None):
            nonlocal before, doc_ids, sizes, held, size
            ids = b"".join(held)
            if seen is None:
                np.add(total, np.bincount(np.frombuffer(ids, encoder.dtype), minlength=encoder.size), out=total)
            columns = [(part, pa.int32()), (before, pa.int64()), (doc_ids, pa.list_(pa.int64())), (sizes, pa.list_(pa.int64())), (ids, pa.binary()), (seen, pa.list_(pa.int32())), (None if seen is None else total[seen], pa.list_(pa.int64()))]
            before += size
            doc_ids, sizes, held, size = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in columns], ["part", "at", "doc_ids", "n_tokens", "ids", "seen", "n"])

        for batch in slices(batches):
            encoded = encoder.encode(batch.column(1).to_pylist())
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded):
                doc_ids.append(doc_id)
                held.append(ids + end)
                sizes.append(len(held[-1]) // encoder.width)
                size += sizes[-1]
                if size >= BLOCK_TOKENS:
                    yield row()
        if doc_ids:
            yield row()
        yield row(np.flatnonzero(total).astype(np.int32))

    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = id_and_text(docs).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, "part int, at long, doc_ids array<long>, n_tokens array<long>, ids binary, seen array<int>, n array<long>")


def count_ids(parts: DataFrame) -> DataFrame:
    """(id int, n long) over all parts: at most one row for each id and part is shuffled."""
    return parts.where("seen is not null").select(F.explode(F.arrays_zip("seen", "n")).alias("c")).groupBy(F.col("c.seen").alias("id")).agg(F.sum("c.n").alias("n"))


def write_corpus(docs: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", end_id: int | None = 1) -> None:
    """Encodes every text of ``docs`` (doc_id, text) and writes the corpus folder ``path``.

    Null text: empty, so only the end id. Null ids sort first. Repeated rows and ids are all kept. An empty table
    writes an empty codebook and no blocks. Other columns are ignored. The codebook (at most one row for each id of
    the vocabulary) and the token total of each part are the only things that pass through the driver.
    """
    spark = docs.sparkSession
    parts = materialize(tokenise_in_order(docs, vocabulary, end_id), "token-blocks")
    blocks = parts.where("seen is null").drop("seen", "n")
    counts = sorted((r.id, r.n) for r in count_ids(parts).collect())
    ids, n = np.array([c[0] for c in counts], np.int64), np.array([c[1] for c in counts], np.int64)
    lengths = code_lengths(n)
    spark.createDataFrame(list(zip(ids.tolist(), lengths.tolist())), "id int, length int").coalesce(1).write.parquet(f"{path}/codebook")
    total = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    starts, before = {}, 0
    for r in sorted(blocks.groupBy("part").agg(F.sum(total).alias("n")).collect()):
        starts[r.part], before = before, before + r.n

    def run(batches):
        dtype, code = loaded(LibraryEncoder, vocabulary, KEPT_WORDS).dtype, Code(ids, lengths, int(ids.max()) + 1 if len(ids) else 1)
        for batch in slices(batches, 1):
            (row,) = batch.to_pylist()
            n_tokens = np.array(row["n_tokens"])
            block = write_block(code, row["doc_ids"], n_tokens, np.frombuffer(row["ids"], dtype))
            yield pa.RecordBatch.from_arrays(
                [pa.array([starts[row["part"]] + row["at"]], pa.int64()), pa.array([len(n_tokens)], pa.int32()), pa.array([int(n_tokens.sum())], pa.int64()), pa.array([block], pa.binary())],
                ["start", "n_docs", "n_tokens", "block"],
            )

    coded = blocks.mapInArrow(run, "start long, n_docs int, n_tokens long, block binary")
    coded.write.option("compression", "none").parquet(f"{path}/blocks")
    release(parts)


def read_corpus(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids array<int>]) of each document, decoded from the corpus folder.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is the unsigned crc32 of its ids as
    little-endian unsigned 32-bit integers.
    """
    book = [(r.id, r.length) for r in spark.read.schema("id int, length int").parquet(f"{path}/codebook").collect()]
    ids, lengths = np.array([b[0] for b in book], np.int64), np.array([b[1] for b in book], np.int64)
    kept: dict[str, Code] = {}

    def run(batches):
        code = kept.setdefault("code", Code(ids, lengths, int(ids.max()) + 1 if len(ids) else 1))
        for batch in slices(batches, DECODE_BLOCKS):
            read = [read_block(b) for b in batch.column(1).to_pylist()]
            decoded = code.unpack([r[3] for r in read], [r[2] for r in read], [r[4] for r in read])
            out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": [], "ids": []}
            for start, (doc_ids, counts, *_), tokens in zip(batch.column(0).to_pylist(), read, decoded):
                ends = np.cumsum(counts, dtype=np.int64)
                raw = memoryview(tokens.astype("<u4").tobytes())
                spans = [(int(e - c), int(e)) for e, c in zip(ends, counts)]
                out["doc_id"] += doc_ids
                out["start"] += [start + a for a, _ in spans]
                out["n_tokens"] += counts.tolist()
                out["ids_crc32"] += [zlib.crc32(raw[4 * a : 4 * b]) for a, b in spans]
                if with_ids:
                    out["ids"] += [tokens[a:b] for a, b in spans]
            arrays = [pa.array(out[k], pa.int64()) for k in ("doc_id", "start", "n_tokens", "ids_crc32")]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in out["ids"]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    blocks = spark.read.schema("start long, n_docs int, n_tokens long, block binary").parquet(f"{path}/blocks")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return blocks.select("start", "block").mapInArrow(run, schema)
