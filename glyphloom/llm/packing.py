"""Operator 10, packing: Karmarkar-Karp multiway differencing of document pieces into windows of near-equal length.

Each task tokenises its documents. A document's full windows of `window` ids leave at once, each as a sequence of its own; the
rest is cut into near-equal pieces of at most `piece` ids. Pieces gather into groups that would fill `group` windows up to
`slack` ids each; differencing then merges the two partial partitions of largest imbalance, largest sums against smallest,
until one remains. Where a window exceeds its capacity, the window count rises and the group is differenced again. No rows move between tasks, and memory is that of
a group and a batch of texts. sequence_id is (task << 40) + a count.

Nulls and ties: a null text is an empty one and has the end id alone; rows with equal or null doc_id are packed each for
itself. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, runs, small_batches, text_bytes, tidy
from .tokens import PASS, encoder, vocabulary

WINDOW, PIECE, GROUP, SLACK = 2048, 400, 64, 12


def differenced(sizes: list[int], k: int) -> list[tuple[int, list[int]]]:
    """k windows, largest first, as (sum, items): Karmarkar-Karp differencing. Empty windows of a partial partition stay implicit."""
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        i, j = max(0, k - len(b)), max(0, k - len(a))  # from these on, both have a window: the largest of a meets the smallest of b
        merged = a[:i] + b[:j] + [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[i:], reversed(b[j:]), strict=True)]
        merged.sort(key=lambda x: -x[0])
        made += 1
        heapq.heappush(heap, (-(merged[0][0] - (merged[-1][0] if len(merged) == k else 0)), made, merged))
    out = []
    for total, tree in heap[0][2] if heap else []:
        items, stack = [], [tree]
        while stack:
            t = stack.pop()
            if isinstance(t, tuple):
                stack += t
            else:
                items.append(t)
        out.append((total, items))
    return out


def packed(sizes: list[int], window: int = WINDOW) -> list[tuple[int, list[int]]]:
    """Windows of at most `window`: as few as the sizes need, and more for as long as one exceeds its capacity."""
    k = -(-sum(sizes) // window)
    while sizes and (out := differenced(sizes, k))[0][0] > window:
        k += 1
    return out if sizes else []


def pack_documents(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 1, window: int = WINDOW, piece: int = PIECE, group: int = GROUP, slack: int = SLACK) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset."""
    small_batches(docs.sparkSession)
    budget = group * (window - slack)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, serial = encoder(tokenizer, kind), TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, int, int, bytes]] = []  # doc_id, start, doc_tokens, ids
        n_held, rows = 0, []

        def batch() -> pa.RecordBatch:
            doc, start, total, blob, sequence, offset = zip(*rows, strict=True)
            rows.clear()
            size = np.fromiter(map(len, blob), np.int64, len(blob)) // 4
            return pa.record_batch([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(size), pa.array(blob, pa.binary()), pa.array(total, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def emit(pieces: list) -> None:
            nonlocal serial
            for _, members in packed([len(x[3]) // 4 for x in pieces], window):
                at = 0
                for i in sorted(members):
                    rows.append((*pieces[i], serial, at))
                    at += len(pieces[i][3]) // 4
                serial += 1

        def hold(doc: int | None, start: int, total: int, blob: bytes) -> None:
            nonlocal held, n_held
            while blob:
                part = blob[: 4 * (budget - n_held)]
                held.append((doc, start, total, part))
                n_held += len(part) // 4
                start, blob = start + len(part) // 4, blob[len(part) :]
                if n_held == budget:
                    emit(held)
                    held, n_held = [], 0

        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            data, offsets = text_bytes(b.column("text"))
            for first, last in runs(offsets, PASS):
                ids, cut = e.encode(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                raw = ids.astype("<u4").tobytes()
                for doc, i, j in zip(b.column("doc_id")[first:last].to_pylist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    blob = raw[4 * i : 4 * j] + end
                    total = j - i + 1
                    full = total // window * window
                    for at in range(0, full, window):
                        rows.append((doc, at, total, blob[4 * at : 4 * (at + window)], serial, 0))
                        serial += 1
                    n = -(-(total - full) // piece)
                    for x in range(n):
                        at, to = full + (total - full) * x // n, full + (total - full) * (x + 1) // n
                        hold(doc, at, total, blob[4 * at : 4 * to])
                    if len(rows) >= 4096:
                        yield batch()
        if held:
            emit(held)
        if rows:
            yield batch()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(tidy(pack), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
