"""Operator 1, token-ID output: canonical length-limited Huffman coding of ids from global counts.

encode_corpus writes a folder of Parquet files under <path>/blocks and <path>/codebook; decode_corpus reads it back.

File format
    codebook    one row for each symbol in use: symbol int, length int. Codes are canonical: symbols in the order of
                (length, symbol) take consecutive codes, so lengths alone define them.
    blocks      one row for each block of whole documents, under part=<k>, where k ascends with doc_id:
                start       long        index in the corpus of the block's first id
                doc_ids     array<long> ascending, null first
                doc_tokens  array<int>  ids of each document
                lanes       binary      bits of each run of LANE ids (little-endian uint16): prefix sums are bit offsets,
                                        from which the runs are decoded independently of each other
                bits        binary      the codes, first bit highest
    A block is decoded without any other block; a lost executor costs the blocks it held.

Nulls and ties: a null text is an empty one and has the end id alone; a null doc_id sorts first; rows with equal doc_id stay
apart, in order of a hash of their texts, by which many of them are also dealt out. A very long text is one block of its own. An empty table gives an empty
folder of blocks. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, new_path, partitions, release, removed, runs, small_batches, text_bytes, tidy, written
from .tokens import PASS, Encoder, encoder, vocabulary

#: Longest code in bits. Decoding tables have 2**LIMIT entries; 2**LIMIT must be at least the vocabulary's size.
LIMIT = 18
#: Ids between two checkpoints.
LANE = 64
#: Ids in a block, beyond which the next document starts another.
BLOCK = 1 << 18


def limited_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code lengths of at most limit bits with the least total (package-merge). Symbols that don't occur get 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need codes of over {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.float64)
    row, levels = coins, [np.ones(len(coins), bool)]
    for _ in range(limit - 1):
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([coins, packages])
        place = np.argsort(both, kind="stable")
        row = both[place]
        levels.append(place < len(coins))
    taken = 2 * len(coins) - 2
    for leaf in reversed(levels):
        leaves = int(leaf[:taken].sum())
        lengths[order[:leaves]] += 1
        taken = 2 * (taken - leaves)
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols in code order, and each symbol's code."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    top = int(lengths.max(initial=1))
    spans = np.left_shift(1, top - lengths[order].astype(np.int64))
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = (np.cumsum(spans) - spans) >> (top - lengths[order].astype(np.int64))
    return order, codes


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
    """Bits of the ids' codes, and the bits of each lane."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    word, shift = at >> 5, at & 31
    field = codes[ids] << (64 - size - shift).astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    sums = np.add.reduceat(field, first)
    out = np.zeros(int(ends[-1] + 31 >> 5) + 1, np.uint64)
    out[word[first]] = sums >> np.uint64(32)
    out[word[first] + 1] |= sums & np.uint64(0xFFFFFFFF)
    lanes = np.diff(np.append(at[::LANE], ends[-1])).astype("<u2")
    return out.astype(">u4").tobytes()[: int(ends[-1] + 7 >> 3)], lanes.tobytes()


class Decoder:
    def __init__(self, lengths: np.ndarray):
        order, _ = canonical(lengths)
        self.top = int(lengths.max(initial=1))
        spans = np.left_shift(1, self.top - lengths[order].astype(np.int64))
        table = np.repeat(order.astype(np.uint32) << np.uint32(6) | lengths[order], spans)
        self.table = np.concatenate([table, np.full((1 << self.top) - len(table), 1, np.uint32)])

    def __call__(self, bits: bytes, lanes: bytes, n: int) -> np.ndarray:
        raw = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
        peek = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        size = np.frombuffer(lanes, "<u2").astype(np.int64)
        at = np.cumsum(size) - size
        out = np.zeros((LANE, len(size)), np.uint32)
        full, rest = divmod(n, LANE)
        limit, mask = 32 - self.top, np.uint32((1 << self.top) - 1)
        for step in range(LANE):
            live = full + (step < rest)
            if not live:
                break
            p = at[:live]
            entry = self.table[peek[p >> 3] >> (limit - (p & 7)).astype(np.uint32) & mask]
            out[step, :live] = entry >> np.uint32(6)
            at[:live] += entry & np.uint32(63)
        return out.T.ravel()[:n]


TOKENS = "part long, doc_id long, at long, n long, ids binary, counts binary"


def tokenised(batches: Iterator[pa.RecordBatch], e: Encoder, part: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """Ids of the documents without their end ids, PASS bytes of text (or one text) at a time; in the end a row with at = -1 has all ids' number and counts."""
    at, size = 0, max(e.tokenizer.get_vocab_size(), end_id + 1)
    counts, kind = np.zeros(size, np.int64), id_type(size)
    for b in batches:
        data, offsets = text_bytes(b.column("text"))
        for first, last in runs(offsets, PASS):
            ids, cut = e.encode(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            n = np.diff(cut) + 1
            counts += np.bincount(ids, minlength=size)
            counts[end_id] += len(n)
            raw, width = ids.astype(kind).tobytes(), kind.itemsize
            blobs = [raw[width * i : width * j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.record_batch([pa.array(np.full(len(n), part)), b.column("doc_id")[first:last], pa.array(starts), pa.array(n), pa.array(blobs, pa.binary()), pa.nulls(len(n), pa.binary())], ["part", "doc_id", "at", "n", "ids", "counts"])
    yield pa.record_batch([pa.array([part]), pa.array([None], pa.int64()), pa.array([-1]), pa.array([at]), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["part", "doc_id", "at", "n", "ids", "counts"])


def id_type(size: int) -> np.dtype:
    """The narrowest little-endian type for ids below size."""
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def ids_in(blob: bytes, n: int) -> np.ndarray:
    """The n ids that a blob holds, whichever type they were given."""
    return np.frombuffer(blob, f"<u{len(blob) // n}" if n else "<u4")


def encode_corpus(docs: DataFrame, path: str, tokenizer: str, kind: str = "byte", end_id: int = 0, limit: int = LIMIT) -> None:
    """Writes the ids of every whole text, each document ended by end_id, in ascending doc_id order."""
    spark = docs.sparkSession
    small_batches(spark)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tokenised(batches, encoder(tokenizer, kind), TaskContext.get().partitionId(), end_id)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for blob in b.column("counts").to_pylist():
                counts = np.frombuffer(blob, np.int64)
                total = counts.copy() if total is None else total + counts
        if total is not None:
            used = np.flatnonzero(total)
            yield pa.record_batch([pa.array(used), pa.array(total[used])], ["symbol", "n"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(partitions(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    table, tokens = written(ordered.mapInArrow(tidy(tokenise), TOKENS), "tokens")
    release(spark)
    parts = {r["part"]: r["n"] for r in table.where("at = -1").select("part", "n").collect()}  # a row for each partition
    starts, at = {}, 0
    for k in sorted(parts):
        starts[k], at = at, at + parts[k]
    counts = table.where("at = -1").select("counts").mapInArrow(tidy(counted), "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    size = max([r["symbol"] for r in counts], default=0) + 1
    total = np.zeros(size, np.int64)
    for r in counts:
        total[r["symbol"]] = r["n"]
    lengths = limited_lengths(total, limit)
    spark.createDataFrame([(int(s), int(lengths[s])) for s in np.flatnonzero(lengths)], "symbol int, length int").coalesce(1).write.parquet(f"{path}/codebook")
    _, codes = canonical(lengths)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n_held, start = None, [], 0, 0

        def block() -> pa.RecordBatch:
            end = np.array([end_id], np.uint32)
            ids = np.concatenate([x for _, blob, n in held for x in (ids_in(blob, n - 1), end)])
            bits, lanes = pack_bits(ids, lengths, codes)
            return pa.record_batch([pa.array([part]), pa.array([start]), pa.array([[d for d, _, _ in held]], pa.list_(pa.int64())), pa.array([[n for _, _, n in held]], pa.list_(pa.int32())), pa.array([lanes], pa.binary()), pa.array([bits], pa.binary())], ["part", "start", "doc_ids", "doc_tokens", "lanes", "bits"])

        for b in batches:
            for k, d, at, n, blob in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "at", "n", "ids")), strict=True):
                here = starts[k] + at
                if held and (k != part or here != start + n_held or n_held >= BLOCK):
                    yield block()
                    held, n_held = [], 0
                if not held:
                    part, start = k, here
                held.append((d, blob, n))
                n_held += n
        if held:
            yield block()

    table.where("at >= 0").mapInArrow(tidy(blocks), "part long, start long, doc_ids array<long>, doc_tokens array<int>, lanes binary, bits binary").write.partitionBy("part").option("compression", "uncompressed").parquet(f"{path}/blocks")
    removed(spark, tokens)


BLOCKS = "part long, start long, doc_ids array<long>, doc_tokens array<int>, lanes binary, bits binary"


def decode_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids (little-endian uint32, with the end id)."""
    small_batches(spark)
    book = spark.read.schema("symbol int, length int").parquet(f"{path}/codebook").collect()  # at most the vocabulary
    lengths = np.zeros(max([r["symbol"] for r in book], default=0) + 1, np.uint8)
    for r in book:
        lengths[r["symbol"]] = r["length"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for b in batches:
            for start, docs, tokens, lanes, bits in zip(*(b.column(c).to_pylist() for c in ("start", "doc_ids", "doc_tokens", "lanes", "bits")), strict=True):
                cut = np.concatenate([[0], np.cumsum(tokens)])
                raw = decoder(bits, lanes, int(cut[-1])).astype("<u4").tobytes()
                blobs = [raw[4 * i : 4 * j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(start + cut[:-1]), pa.array(np.array(tokens, np.int64)), pa.array(blobs, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(tidy(decode), "doc_id long, start long, n_tokens long, ids binary")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "huffman")
    encode_corpus(documents(spark, sf_dir), path, vocabulary("byte_bpe_50k.json"))
    return decode_corpus(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
