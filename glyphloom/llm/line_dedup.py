"""Operator 5, line dedup by pairwise alignment.

Lines are hashed. The passages around a line are the shortest runs of adjacent lines with at least min_words words that hold it: a
line with as many is one of its own, shorter lines make one with their neighbours. Of each passage the first holder, that with the smallest key, stands for
all: a later document meets one earlier document for each of its passages, so frequent passages make no more pairs than rare ones,
and none is left out.

A later document is aligned with each earlier document that it meets by patience diff over the passages they share: passages
that either holds once (the rare ones) anchor the alignment, their longest increasing run is kept, and gaps between anchors are
aligned in the same way. Aligned passages that follow each other in both documents, but for as many lines without a word, make a
block. Passages that the alignment crosses are aligned in further passes, each a chain that ascends in both documents, until
none is left; further copies of an aligned passage go with it. Blocks are deleted from the later document, so of every passage
that an earlier document holds no line stays.

Nulls and ties: a null text stays null; an empty one stays empty. Rows with a null doc_id are left as they are. Documents of one
doc_id with different texts are ordered by a hash of the text; equal rows are one document and lose the same lines. Lines
without a word are in no passage of their own. A very long text is one row like any other; its lines are hashed in numpy. An empty
table gives no rows. All other columns pass through unchanged.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SpanHash, documents, mix64, release, removed, runs, small_batches, text_bytes, tidy, words_of, written

#: Words that a passage needs.
MIN_WORDS = 5
#: An odd factor of the hashes of passages, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
HASH = SpanHash(seed=5)


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing run of values (patience sorting)."""
    tails: list[int] = []
    last: list[int] = []
    back = [-1] * len(values)
    for n, v in enumerate(values):
        at = bisect_left(tails, v)
        back[n] = last[at - 1] if at else -1
        if at == len(tails):
            tails.append(v)
            last.append(n)
        else:
            tails[at], last[at] = v, n
    chain, n = [], last[-1] if last else -1
    while n >= 0:
        chain.append(n)
        n = back[n]
    return chain[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j) with a[i] == b[j], ascending in both."""
    out, spans = [], [(0, len(a), 0, len(b))]
    while spans:
        i0, i1, j0, j1 = spans.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        once_a, once_b = Counter(a[i0:i1]), Counter(b[j0:j1])
        place = {x: i for i, x in enumerate(a[i0:i1], i0) if once_a[x] == 1 and once_b.get(x) == 1}
        anchors = [(place[x], j) for j, x in enumerate(b[j0:j1], j0) if x in place]
        if not anchors:  # none is single on either side: the first places of all that are in both
            first_a, first_b = ({x: i for i, x in reversed(list(enumerate(s[s0:s1], s0)))} for s, s0, s1 in ((a, i0, i1), (b, j0, j1)))
            anchors = sorted(((first_a[x], j) for x, j in first_b.items() if x in first_a), key=lambda p: p[1])
            if not anchors:
                continue
        chain = [anchors[n] for n in increasing([i for i, _ in anchors])]
        out += chain
        for (i, j), (p, q) in zip([(i0 - 1, j0 - 1), *chain], [*chain, (i1, j1)], strict=True):
            if i + 1 < p and j + 1 < q:
                spans.append((i + 1, p, j + 1, q))
    return sorted(out)


def passes(a: list[int], b: list[int]) -> list[list[tuple[int, int]]]:
    """Alignments of b with a: that by patience, then chains of those members of b that it left, until each distinct one has been aligned."""
    first = patience(a, b)
    out, met = [first], {b[j] for _, j in first}
    where = {x: i for i, x in reversed(list(enumerate(a)))}
    tails: list[int] = []  # negative ends of the chains, ascending
    chains: list[list[tuple[int, int]]] = []
    for j, x in enumerate(b):
        if x in met or x not in where:
            continue
        met.add(x)
        i = where[x]
        at = bisect_right(tails, -i)  # the chain with the largest end below i
        if at == len(tails):
            tails.append(-i)
            chains.append([(i, j)])
        else:
            tails[at] = -i
            chains[at].append((i, j))
    return out + chains


#: An occurrence: position of the first line, number of lines, lines without a word that follow.
Place = tuple[int, int, int]


def block_lines(a: list[tuple[Place, int]], b: list[tuple[Place, int]]) -> set[int]:
    """Lines of b in blocks that are aligned with a. a, b: ((position, lines, blank), passage), ascending."""
    names_a, names_b = [x for _, x in a], [x for _, x in b]
    gone: set[int] = set()
    aligned: set[int] = set()
    for chain in passes(names_a, names_b):
        was = None
        for i, j in chain:
            (p, n, _), (q, m, _) = a[i][0], b[j][0]
            gone.update(range(q, q + m))
            aligned.add(names_b[j])
            if was:
                (p0, n0, e0), (q0, m0, e1) = was
                if e0 == e1 and p0 + n0 + e0 == p and q0 + m0 + e1 == q:
                    gone.update(range(q0 + m0, q))
            was = a[i][0], b[j][0]
    for (q, m, _), x in b:  # further copies
        if x in aligned:
            gone.update(range(q, q + m))
    return gone


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


def passages(hashes: np.ndarray, words: np.ndarray, row: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first line and end of the passages of texts that have the lines row[i]:row[i+1]: around each line with a word the runs of
    min_words words, than which no shorter one is around it."""
    full = np.flatnonzero(words > 0)
    text = np.searchsorted(row, full, "right") - 1
    low, high = row[text], row[text + 1]
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    starts, ends = [], []
    for t in range(min_words + 1):  # runs that start t lines with words before the line
        x, start = full[t:], full[: max(0, len(full) - t)]
        end = np.maximum(np.searchsorted(total, total[start] + min_words), x + 1)
        ok = (start >= low[t:]) & (end <= high[t:])
        if t:
            ok[ok] = total[end[ok]] - total[start[ok] + 1] < min_words
        starts.append(start[ok])
        ends.append(end[ok])
    start, end = np.divmod(np.unique(np.concatenate(starts) * (len(hashes) + 1) + np.concatenate(ends)), len(hashes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(hashes) * _powers(BASE, len(hashes)), dtype=np.uint64)])
    return mix64((sums[end] - sums[start]) * _powers(INVERSE, len(hashes) + 1)[start] + (end - start).astype(np.uint64)), start, end


HELD = "doc_id long, h long, passage long, at array<int>, n int, blank array<int>"


def _held(table: DataFrame, min_words: int) -> DataFrame:
    """A row of HELD for each distinct passage of rows (doc_id, h, text): where it begins, its lines, and the lines without a word after each."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, cuts = text_bytes(b.column("text"))
            for x, y in runs(cuts):
                data, offsets = whole[cuts[x] : cuts[y]], cuts[x : y + 1] - cuts[x]
                breaks = np.flatnonzero(data == 10)
                row = np.searchsorted(breaks, offsets) + np.arange(len(offsets))  # the first line of each text
                first = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
                ends = np.sort(np.concatenate([breaks, offsets[1:]]))
                begins, _, _ = words_of(data, offsets)
                count = np.searchsorted(begins, ends) - np.searchsorted(begins, first)
                hashes, start, end = passages(HASH(data, first, ends), count, row, min_words)
                if not len(hashes):
                    continue
                of = np.searchsorted(row, start, "right") - 1
                full = np.append(np.flatnonzero(count > 0), len(count))
                blank = np.minimum(full[np.searchsorted(full, end)], row[of + 1]) - end
                order = np.lexsort((start, hashes, of))
                of, hashes, start, size, blank = of[order], hashes[order], start[order], (end - start)[order], blank[order]
                new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])))
                lists = pa.array(np.append(new, len(of)), pa.int32())
                at, blank = (pa.ListArray.from_arrays(lists, pa.array(c, pa.int32())) for c in (start - row[of], blank))
                doc = pa.array(of[new] + x)
                yield pa.record_batch([b.column("doc_id").take(doc), b.column("h").take(doc), pa.array(hashes[new].view(np.int64)), at, pa.array(size[new], pa.int32()), blank], ["doc_id", "h", "passage", "at", "n", "blank"])

    return table.mapInArrow(tidy(found), HELD)


def doomed_lines(table: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, h, gone) of rows (doc_id, h, text): the lines that alignments with documents of smaller (doc_id, h) delete."""
    spark = table.sparkSession
    held, held_at = written(_held(table, min_words), "held")
    key = F.struct("doc_id", "h")
    firsts = held.groupBy("passage").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.min_by(F.struct("at", "blank"), key).alias("there")).where("first <> last")
    firsts, firsts_at = written(firsts.select("passage", "first", F.col("there.at").alias("first_at"), F.col("there.blank").alias("first_blank")), "firsts")
    met = held.join(firsts.hint("merge"), "passage").where(key != F.col("first")).select("doc_id", "h", F.struct("first", "passage", "n", "at", "blank", "first_at", "first_blank").alias("m"))
    met = met.groupBy("doc_id", "h").agg(F.collect_set("m").alias("met"))  # at most the passages of one document; equal rows come once

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = []
            for rows in b.column("met").to_pylist():
                pairs: dict[tuple[int, int], tuple[list, list]] = {}
                for r in rows:
                    a, d = pairs.setdefault((r["first"]["doc_id"], r["first"]["h"]), ([], []))
                    a += [((p, r["n"], e), r["passage"]) for p, e in zip(r["first_at"], r["first_blank"], strict=True)]
                    d += [((p, r["n"], e), r["passage"]) for p, e in zip(r["at"], r["blank"], strict=True)]
                gone.append(sorted(set().union(*(block_lines(sorted(a), sorted(d)) for a, d in pairs.values()))))
            yield pa.record_batch([b.column("doc_id"), b.column("h"), pa.array(gone, pa.list_(pa.int32()))], ["doc_id", "h", "gone"])

    gone, _ = written(met.mapInArrow(tidy(align), "doc_id long, h long, gone array<int>"), "gone")
    removed(spark, held_at, firsts_at)
    release(spark)
    return gone


def deduplicated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with aligned common blocks deleted from later documents' text, and the columns n_lines and n_removed (in place of such columns of docs)."""
    small_batches(docs.sparkSession)
    text, own = F.col("text").cast("string"), [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    table = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    gone = doomed_lines(table, min_words).select(F.col("doc_id").alias("__gone_id"), F.col("h").alias("__gone_h"), F.col("gone").alias("__gone"))
    # texts move once, at every size alike; the lists of lines are small and make the hashed side
    joined = docs.select(*own).join(gone.hint("shuffle_hash"), (F.col("doc_id").cast("long") == F.col("__gone_id")) & (F.xxhash64(text) == F.col("__gone_h")), "left")
    lines = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    left = F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n")
    edited = F.when(F.col("__gone").isNull(), text).otherwise(left)
    count = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.translate(text, "\n", "")) + 1)
    return joined.select(*(edited.alias(c) if c == "text" else F.col(c) for c in own), count.alias("n_lines"), F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).alias("n_removed"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated_lines(documents(spark, sf_dir).select("doc_id", "text"))
