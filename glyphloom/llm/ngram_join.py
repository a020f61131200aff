"""Operator 4, n-gram Jaccard join by universe partition and the pigeonhole principle.

A document's set is that of its distinct word shingles, as 64-bit hashes. Two sets link if 100 * |x & y| >= percent * |x | y|;
then at most H = (|x| + |y|) * (100 - percent) / (100 + percent) shingles belong to one alone, and neither is over
100 / percent times the other's size. Sizes fall into bands of that ratio; a pair meets in the band of its smaller set,
so that a set takes part in its own band and the one or two below that its size reaches.

In a band all shingles are hashed into m segments, n1 of them with one deletion allowed, so that 2 * n1 + (m - n1) =
H + 1 + k. Of two sets that link, k + 1 of the undivided segments agree at least, or else one of the others up to a deletion.
`allocate` picks m, n1 and k for each band by cost: the signatures that it makes, and pairs expected from empty segments.

    1  Each task emits the signature of every segment (and of its one-deletion neighbourhood where allowed) of every set it
       hasn't seen, packed by target partition: 6 bytes each, however many partitions there are, as a set goes by its place in a
       chunk. Empty segments count against k and are left out unless a set has more of them; what k leaves, the band and the set's
       fingerprint are noted once for each place.
    2  A target partition sorts its signatures. Buckets of up to CAP sets give pairs with the number of agreeing segments;
       of larger (hot) ones it counts, for each set, in how many it is.
    3  A pair is a candidate if its agreeing segments number k + 1, less the empty and the hot ones that either set has. Hot
       buckets matter only for sets that have more hot segments than k spares; these sets, and no others, are also met by
       their rarest shingles, as many as the linked can't miss each other in. The holders of such a shingle are compared with
       the most central of them, and then, across the components found so far, with each other, block by block inside tasks.
       The links of such sets with each other are counted inside their components, each pair of sets once, block by block.
    4  Candidates are verified on the shingle sets of their whole texts; components of verified links give the result.

Nothing is dropped: a pair that no bucket shows is one that can't link. Equal sets share one node from the start, so
copies never meet in pairs.

Nulls and ties: a null or empty text, or one without words, has no shingles and links with nothing; its component is itself. Rows
of one doc_id with different texts stay apart and their components are told by that id. Rows with a null doc_id are
linked with nothing and have a null component. An empty table gives no rows. Other columns are ignored. Sets and shingles are
told apart by 64-bit fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, SpanHash, documents, mix64, partitions, release, removed, runs, small_batches, text_bytes, tidy, words_of, written
from .components import components

WORDS, PERCENT, CAP = 5, 75, 16
#: Share of H by which k exceeds what empty segments need, for hot segments.
SPARE = 0.08
#: What a set costs, in signatures, in a band with divided segments, where hot segments can't be spared.
HOT_COST = 40
#: Links of one set that a group verifies at once.
CHUNK_LINKS = 128
#: Shingles of the sets of one block, and as how many a set counts at least: at most BLOCK / LEAST sets make a block on average.
BLOCK, LEAST = 1 << 19, 512
#: The same for counting links, and sets that are compared with a block at once.
COUNT_LEAST, STRIP = 128, 512
#: Bytes of signatures in a target partition, which one task sorts.
TARGET = 12 << 20
#: Sets of a chunk, so that a place (set and band) has 16 bits.
PLACES = 1 << 14
#: Sets of a list that is compared by pairs of ids; those of longer lists are compared block by block.
SHORT = 64
#: Shingles whose presence in the sets of two blocks is held as a matrix at once.
COLUMNS = 2048
#: Shingles of the sets of one chunk, on average, that asks for counts together.
CHUNK_SHINGLES = 1 << 17
HASH = SpanHash(fold_case=True, seed=4)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of texts data[offsets[i]:offsets[i+1]], one text after another, and n + 1 offsets; offsets[0] is 0."""
    n = len(offsets) - 1
    starts, ends, cut = words_of(data, offsets)
    key = HASH(data, starts, ends)
    full = np.zeros(max(0, len(key) - words + 1), np.uint64)
    for j in range(words):
        full = mix64(full + key[j : j + len(full)] * np.uint64(2 * j + 3))
    sets = []
    for i in range(n):
        a, b = int(cut[i]), int(cut[i + 1])
        if b - a >= words:
            sets.append(np.unique(full[a : b - words + 1]))
        elif b > a:  # the whole sequence, told apart from longer ones by its length
            h = np.uint64(b - a)
            for j, x in enumerate(key[a:b].tolist()):
                h = mix64(np.array([(int(h) + x * (2 * j + 3)) & (2**64 - 1)], np.uint64))[0]
            sets.append(np.array([h], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)]).astype(np.int64)


def node_of(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set; sets of no shingles get 0."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(h ^ np.uint64(0xA5A5A5A5)), dtype=np.uint64)])
    size = np.diff(cut).astype(np.uint64)
    return np.where(size > 0, mix64(sums[cut[1:]] - sums[cut[:-1]] + size * np.uint64(0x9E3779B97F4A7C15)), np.uint64(0))


@dataclass(frozen=True)
class Bands:
    low: np.ndarray  # first size of each band; the last ends beyond the largest set
    m: np.ndarray
    n1: np.ndarray
    k: np.ndarray


def boundaries(largest: int, percent: int) -> list[int]:
    low = [1]
    while low[-1] <= largest:
        low.append(max(low[-1] + 1, low[-1] * 100 // percent))
    return low


def allocate(sizes: dict[int, int], largest: int, percent: int = PERCENT) -> Bands:
    """sizes: how many sets each band (by index) has."""
    low = boundaries(largest, percent)
    rows = []
    for i, (lo, up) in enumerate(zip(low[:-1], low[1:], strict=True)):
        top = up - 1
        h = (top + top * 100 // percent) * (100 - percent) // (100 + percent)
        n, s = max(1, sizes.get(i, 0)), (lo + top) / 2
        best = None
        for n1 in sorted({0, (h + 1) // 4, (h + 2) // 2}):
            for k in range(0, 4 * h + 8):
                m = n1 + max(0, h + 1 + k - 2 * n1)
                n0 = m - n1
                if m < 1:
                    continue
                none = math.exp(-lo / m)
                empty, spread = n0 * none, math.sqrt(n0 * none * max(0.0, 1 - (1 + lo / m) * none))
                if n0 and k < empty + 3.5 * spread + SPARE * h:
                    continue
                per = n0 * (1 - math.exp(-s / m)) + n1 * (1 + s / m)
                cost = n * per + n1 * (n * math.exp(-s / m)) ** 2 / 2 + (n1 > 0) * n * HOT_COST
                if best is None or cost < best[0]:
                    best = (cost, m, n1, k if n0 else 0)
                break
        rows.append(best[1:])
    m, n1, k = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
    return Bands(np.array(low, np.int64), m, n1, k)


def signatures(h: np.ndarray, cut: np.ndarray, bands: Bands, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each distance of a band from the sets' own: that distance, signatures and their sets; then sets and their spares (k less the empty segments left out)."""
    size = np.diff(cut)
    own = np.searchsorted(bands.low, size, "right") - 1
    least = np.searchsorted(bands.low, -(-size * percent // 100), "right") - 1
    of = np.repeat(np.arange(len(size)), size)
    for back in range(int((own - least).max(initial=-1)) + 1):
        band = own - back
        takes = (size > 0) & (band >= least)
        which = np.flatnonzero(takes)
        if not len(which):
            continue
        band = band[which]
        m, n1 = bands.m[band], bands.n1[band]
        most = np.minimum(size[which] * 100 // percent, bands.low[band + 1] - 1 if back else 1 << 62)  # of a partner here
        k = m + n1 - 1 - (size[which] + most) * (100 - percent) // (100 + percent)  # at least the band's k
        base = np.cumsum(m) - m
        row = np.full(len(size), -1)
        row[which] = np.arange(len(which))
        tokens = takes[of]
        r = row[of[tokens]]
        v = mix64(h[tokens] + np.uint64(0x632BE59BD9B4E019) * (band[r].astype(np.uint64) + np.uint64(1)))
        segment = ((v >> np.uint64(32)) * m[r].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        cell = base[r] + segment
        total = int(m.sum())
        sums, count = np.zeros(total, np.uint64), np.bincount(cell, minlength=total)
        v = mix64(v ^ np.uint64(0x5851F42D4C957F2D))
        np.add.at(sums, cell, v)
        cell_row = np.repeat(np.arange(len(which)), m)
        cell_segment = np.arange(total) - base[cell_row]
        undivided = cell_segment >= n1[cell_row]
        empty = np.bincount(cell_row[undivided & (count == 0)], minlength=len(which))
        left_out = empty <= k
        spare = np.where(left_out & (n1 == 0), k - empty, 0)  # agreement of divided segments isn't counted
        name = mix64(band[cell_row].astype(np.uint64) << np.uint64(40) | cell_segment.astype(np.uint64) + np.uint64(1))
        emit = (count > 0) | ~undivided | ~left_out[cell_row]
        sig, at = [mix64(sums[emit] + name[emit])], [cell_row[emit]]
        if n1.any():
            divided = np.flatnonzero(~undivided[cell])
            sig.append(mix64(sums[cell[divided]] - v[divided] + name[cell[divided]]))
            at.append(r[divided])
        at = np.concatenate(at)
        yield back, np.concatenate(sig), which[at], which, spare


MET = "kind string, a long, b long, spare int, n long"


def _packed(chunk: int, *columns: tuple[np.ndarray, str]) -> bytes:
    return np.array([chunk, len(columns[0][0])], "<u8").tobytes() + b"".join(c.astype(kind).tobytes() for c, kind in columns)


def _unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    """The columns, the last of which is a place, made one among all chunks."""
    chunk, n = np.frombuffer(blob, "<u8", 2).tolist()
    at, out = 16, []
    for kind in kinds:
        out.append(np.frombuffer(blob, kind, n, at))
        at += out[-1].nbytes
    return [*out[:-1], out[-1].astype(np.int64) + (chunk << 16)]


#: Columns of a packed run of signatures (their upper half, place), and of one of sets (fingerprint, spare, place).
SIGNED, NOTED = ("<u4", "<u2"), ("<u8", "<u4", "<u2")


def _met(kind: str, n: int, a: np.ndarray, b: np.ndarray | None = None, spare: np.ndarray | None = None, times: np.ndarray | None = None) -> pa.RecordBatch:
    column = lambda x, t: pa.nulls(n, t) if x is None else pa.array(x.astype(t.to_pandas_dtype()), t)
    return pa.record_batch([pa.array([kind] * n), column(a, pa.int64()), column(b, pa.int64()), column(spare, pa.int32()), column(times, pa.int64())], ["kind", "a", "b", "spare", "n"])


def buckets(sig: np.ndarray, place: np.ndarray, cap: int = CAP) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of places with n equal signatures, and places (a) with n signatures in hot buckets, as rows of MET."""
    order = np.argsort(sig, kind="stable")
    sig = sig[order]
    same = np.flatnonzero(sig[1:] == sig[:-1])
    if not len(same):
        return
    keep = np.zeros(len(sig), bool)
    keep[same] = keep[same + 1] = True
    sig, place = sig[keep], place[order[keep]]
    order = np.lexsort((place, sig))
    sig, place = sig[order], place[order]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (place[1:] != place[:-1])
    sig, place = sig[fresh], place[fresh]
    first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    size = np.diff(np.append(first, len(sig)))
    # equal lists count once, with their number
    _, pick, times = np.unique(np.add.reduceat(mix64(place.view(np.uint64)), first), return_index=True, return_counts=True)
    some = size[pick] > 1
    pick, times = pick[some], times[some]
    first, size = first[pick], size[pick]
    small = np.flatnonzero(size <= cap)
    parts = []
    for s in np.unique(size[small]).tolist():
        of = small[size[small] == s]
        i, j = np.triu_indices(s, 1)
        parts.append(((first[of][:, None] + i).ravel(), (first[of][:, None] + j).ravel(), np.repeat(times[of], len(i))))
    if parts:
        i, j, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        a, b = place[i], place[j]
        key = np.lexsort((b, a))
        a, b, n = a[key], b[key], n[key]
        new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        total, a, b = np.add.reduceat(n, new), a[new], b[new]
        for at in range(0, len(a), 20_000):
            x, y = a[at : at + 20_000], b[at : at + 20_000]
            yield _met("pair", len(x), x, y, times=total[at : at + 20_000])
    if len(hot := np.flatnonzero(size > cap)):
        row = np.repeat(first[hot] - np.cumsum(size[hot]) + size[hot], size[hot]) + np.arange(size[hot].sum())
        a, n = place[row], np.repeat(times[hot], size[hot])
        order = np.argsort(a, kind="stable")
        a, n = a[order], n[order]
        new = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        yield _met("hot", len(new), a[new], times=np.add.reduceat(n, new))


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (u, v) of nodes that link. reps: (node, doc_id) of one document of each set."""
    spark = pairs.sparkSession
    pairs, first = written(pairs.select("u", "v").distinct(), "pairs")
    degree = pairs.groupBy("u").agg(F.ceil(F.count("*") / CHUNK_LINKS).cast("long").alias("chunks"))
    dealt, second = written(pairs.join(degree, "u").select("u", "v", F.pmod(F.xxhash64("v"), "chunks").alias("chunk")), "dealt")
    roles = dealt.select(F.col("v").alias("node"), "u", "chunk").union(dealt.select(F.col("u").alias("node"), "u", "chunk").distinct())
    roles, third = written(roles.join(reps, "node"), "roles")
    rows = of_nodes(docs, roles).select("node", "u", "chunk", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column("text"))
            for i, j in runs(offsets):
                h, cut = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                node = node_of(h, cut).view(np.int64)
                blobs = [h[x:y].tobytes() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                part = pa.record_batch([b.column(c).slice(i, j - i) for c in ("node", "u", "chunk")] + [pa.array(blobs, pa.binary())], ["node", "u", "chunk", "set"])
                yield part.filter(pa.array(node == part.column("node").to_numpy()))  # an id may have more than one text

    def linked(table: pa.Table) -> pa.Table:
        u = table.column("u")[0].as_py()
        held = {n: s for n, s in zip(table.column("node").to_pylist(), table.column("set").to_pylist(), strict=True)}
        hub = np.frombuffer(held[u], np.uint64)
        found = []
        for v, s in held.items():
            other = np.frombuffer(s, np.uint64)
            both = len(np.intersect1d(hub, other, assume_unique=True))
            if v != u and 100 * both >= percent * (len(hub) + len(other) - both):
                found.append(v)
        return pa.table({"u": pa.array([u] * len(found), pa.int64()), "v": pa.array(found, pa.int64())})

    found = rows.mapInArrow(tidy(sets), "node long, u long, chunk long, set binary").groupBy("u", "chunk").applyInArrow(linked, "u long, v long")
    out, _ = written(found, "found")
    release(spark)
    removed(spark, first, second, third)
    return out


def of_nodes(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Texts of nodes' documents: nodes (node, doc_id, ...) with text. Only the ids move where they are few."""
    few = nodes.count() * 40 <= BROADCAST_BYTES
    return docs.join(F.broadcast(nodes) if few else nodes, "doc_id")


def shingle_lists(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, n, lists): the shingles of the nodes' documents."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column("text"))
            for i, j in runs(offsets):
                h, cut = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                part = pa.record_batch([b.column("node").slice(i, j - i), pa.array(np.diff(cut)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(h.view(np.int64)))], ["node", "n", "lists"])
                yield part.filter(pa.array(node_of(h, cut).view(np.int64) == part.column("node").to_numpy()))

    rows = of_nodes(docs, nodes).select("node", "text").mapInArrow(tidy(sets), "node long, n long, lists array<long>")
    return rows.dropDuplicates(["node"])


def rarest(sets: DataFrame, percent: int) -> DataFrame:
    """Of each set's shingles, rarest first, as many as two linked sets can't miss each other in; those of one set alone are left out.

    sets: (node, n, lists). They are dealt into chunks by hash; a chunk adds up what its sets hold and asks for the count of each of its
    shingles once, so that a frequent shingle is shuffled once a chunk and not once a set.
    """
    chunks = max(1, -(-(sets.agg(F.sum("n")).first()[0] or 0) // CHUNK_SHINGLES))
    dealt = sets.withColumn("chunk", F.pmod(F.xxhash64("node"), F.lit(chunks)))
    asked = dealt.select("chunk", F.explode("lists").alias("list")).groupBy("chunk", "list").agg(F.count("*").alias("own"))
    held = asked.groupBy("list").agg(F.sum("own").alias("held")).where("held > 1")
    told = asked.select(F.col("chunk").alias("to"), "list").join(held, "list")

    def chosen(mine: pa.Table, counts: pa.Table) -> pa.Table:
        names = ["list", "node", "n", "middle", "first_held", "first_list"]
        if not counts.num_rows:
            return pa.table([pa.array([], pa.float64() if c == "middle" else pa.int64()) for c in names], names=names)
        order = np.argsort(counts.column("list").to_numpy())
        known, much = counts.column("list").to_numpy()[order], counts.column("held").to_numpy()[order]
        node, n, lists = mine.column("node").to_numpy(), mine.column("n").to_numpy(), mine.column("lists").combine_chunks()
        flat, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
        at = np.searchsorted(known, flat)
        shared = np.zeros(len(flat), bool)
        shared[at < len(known)] = known[at[at < len(known)]] == flat[at < len(known)]
        flat, row, much = flat[shared], row[shared], much[at[shared]]
        order = np.lexsort((flat, much, row))
        flat, row, much = flat[order], row[order], much[order]
        size = np.bincount(row, minlength=len(n))
        start = np.cumsum(size) - size
        middle = np.bincount(row, much, len(n)) / n
        place = np.arange(len(row)) - start[row] + 1 + (n - size)[row]
        keep = place <= (n + n * -percent // 100 + 1)[row]
        head, to = start[row[keep]], row[keep]
        return pa.table([flat[keep], node[to], n[to], middle[to], much[head], flat[head]], names=names)

    return dealt.groupBy("chunk").cogroup(told.groupBy("to")).applyInArrow(chosen, "list long, node long, n long, middle double, first_held long, first_list long").select("list", "node", "n", "middle", F.struct(F.col("first_held").alias("held"), F.col("first_list").alias("list")).alias("first"))


def overlaps(size: np.ndarray, flat: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many members each two sets (of left, of right) share; flat holds the members of all sets, one set after another."""
    _, column, held = np.unique(flat, return_inverse=True, return_counts=True)
    shared = held[column] > 1
    row, column = np.repeat(np.arange(len(size)), size)[shared], (np.cumsum(held > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [at, at + COLUMNS])
        has = np.zeros((len(size), COLUMNS), np.float32)
        has[row[i:j], column[i:j] - at] = 1
        both += has[left] @ has[right].T
    return both


def linked_matrix(size: np.ndarray, flat: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    both = overlaps(size, flat, left, right)
    return 100 * both >= percent * (size[left][:, None] + size[right] - both)


def block_links(size: np.ndarray, flat: np.ndarray, component: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs (of left, of right) that link sets of different components; as few as connect what all such pairs connect."""
    link = linked_matrix(size, flat, left, right, percent) & (component[left][:, None] != component[right])
    a, b = np.nonzero(link)
    _, known = np.unique(component, return_inverse=True)
    ends = np.sort(np.stack([known[left[a]], known[right[b]]], 1), 1)
    _, pick = np.unique(ends[:, 0] * len(size) + ends[:, 1], return_index=True)
    parent = list(range(len(size)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for k in pick.tolist():
        x, y = root(int(ends[k, 0])), root(int(ends[k, 1]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((int(left[a[k]]), int(right[b[k]])))
    return out


def compared(held: DataFrame, own: DataFrame, docs: DataFrame, reps: DataFrame, words: int, percent: int, known: DataFrame) -> DataFrame:
    """Links (u, v) between sets of one list and different components. held: (list, node, n, component, first); own: (node, n, lists) of all its nodes.

    Lists of one component are left out. Lists that hold the same sets as another count once, and so do those whose sets all are on one other list. Of a list of up to
    SHORT sets the pairs are verified that sizes allow and that weren't yet (known: u, v); the sets of a longer list are dealt into blocks by hash, and each pair of blocks is compared by one group; a set moves once for each
    block of its list, not once for each set.
    """
    spark = held.sparkSession
    whole = held.groupBy("list").agg(F.count("*").alias("sets"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("print"), F.min("first").alias("first"), F.max("first").alias("last"), F.min("component").alias("least"), F.max("component").alias("most"), F.ceil(F.sum(F.greatest("n", F.lit(LEAST))) / BLOCK).cast("int").alias("blocks"))
    whole = whole.where("least < most").where((F.col("first") != F.col("last")) | (F.col("first.list") == F.col("list")))
    whole = whole.groupBy("sets", "print").agg(F.min(F.struct("list", "blocks")).alias("own")).select("own.*", "sets")
    listed, first = written(held.join(whole, "list").select("list", "node", "n", "component", "blocks", "sets"), "listed")
    known = known.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    if not listed.take(1):
        removed(spark, first)
        return known.limit(0)

    def later(x: Column) -> Column:
        fits = lambda y: (y["node"] > x["node"]) & (y["component"] != x["component"]) & (100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"]))
        return F.transform(F.filter("held", fits), lambda y: F.struct(x["node"].alias("u"), y["node"].alias("v")))

    short = listed.where(F.col("sets") <= SHORT).groupBy("list").agg(F.collect_list(F.struct("node", "n", "component")).alias("held"))
    pairs = short.select(F.explode(F.flatten(F.transform("held", later))).alias("pair")).select("pair.*").distinct()
    short, _ = written(verified(pairs.join(known, ["u", "v"], "left_anti"), docs, reps, words, percent), "short")
    listed = listed.where(F.col("sets") > SHORT)
    if not listed.take(1):
        removed(spark, first)
        return short
    dealt = listed.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    with_ = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = with_.select("node", "component", F.struct("list", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block").alias("task"))
    rows = own.select("node", "lists").join(tasks, "node").select("node", "component", "lists", "task.*")

    def linked(table: pa.Table) -> pa.Table:
        node, component, block, x, y = (table.column(c).to_numpy() for c in ("node", "component", "block", "x", "y"))
        lists = table.column("lists").combine_chunks()
        every = np.arange(len(node))
        left, right = (every, every) if x[0] == y[0] else (every[block == x[0]], every[block == y[0]])
        pairs = block_links(lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy(), component, left, right, percent)
        return pa.table({"u": pa.array([node[a] for a, _ in pairs], pa.int64()), "v": pa.array([node[b] for _, b in pairs], pa.int64())})

    out, _ = written(rows.groupBy("list", "x", "y").applyInArrow(linked, "u long, v long"), "found")
    release(spark)
    removed(spark, first)
    return short.union(out)


def link_counts(own: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(node, n): with how many others of own (node, n, lists) a set links. labels: (node, component) of all that have a link.

    Sets that link share a component, so each pair of a component's sets is compared once: its sets are dealt into blocks by hash, and each
    two blocks meet in one group. Groups return a count for each set, not pairs.
    """
    members = own.select("node", "n").join(labels, "node")
    blocks = members.groupBy("component").agg(F.count("*").alias("sets"), F.ceil(F.sum(F.greatest("n", F.lit(COUNT_LEAST))) / BLOCK).cast("int").alias("blocks")).where("sets > 1").drop("sets")
    dealt = members.select("node", "component").join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    tasks, at = written(dealt.select("node", "component", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")), "tasks")
    rows = own.select("node", "lists").join(tasks, "node").select("node", "lists", "component", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))

    def linked(table: pa.Table) -> pa.Table:
        node, block, x, y = (table.column(c).to_numpy() for c in ("node", "block", "x", "y"))
        lists = table.column("lists").combine_chunks()
        size, flat = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()
        every = np.arange(len(node))
        left, right = (every, every) if x[0] == y[0] else (every[block == x[0]], every[block == y[0]])
        both, n = overlaps(size, flat, left, right), np.zeros(len(node), np.int64)
        for at in range(0, len(left), STRIP):
            a, shared = left[at : at + STRIP], both[at : at + STRIP]
            link = 100 * shared >= percent * (size[a].astype(np.float32)[:, None] + size[right].astype(np.float32) - shared)
            if x[0] == y[0]:
                link &= a[:, None] < right
            n[a] += link.sum(1)
            n[right] += link.sum(0)
        return pa.table({"node": node[n > 0], "n": n[n > 0]})

    out, _ = written(rows.groupBy("component", "x", "y").applyInArrow(linked, "node long, n long"), "counts")
    release(own.sparkSession)
    removed(own.sparkSession, at)
    return out


def _named(slim: DataFrame, labels: DataFrame, degree: DataFrame | None) -> DataFrame:
    """The result: slim (doc_id, n_shingles, node) with components, and links where degree (node, n_links) is given."""
    named = slim.join(labels, "node", "left")
    counted = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if degree is not None else []
    named = named.join(degree, "node", "left") if degree is not None else named
    named, _ = written(named.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).alias("class"), *counted), "named")
    # a class of one row is its own component
    least, _ = written(named.where("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "least")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id")
    return named.join(least, "class", "left").select("doc_id", "n_shingles", component, *(["n_links"] if counted else []))


def similar_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, cap: int = CAP, count_links: bool = True) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id that links reach), n_links.

    n_links is the number of sets that its set links with. Counting the links of a group of near copies compares all its sets, which
    components alone don't need: without count_links the column is left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column("text"))
            for i, j in runs(offsets):
                h, cut = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                yield pa.record_batch([b.column("doc_id").slice(i, j - i), pa.array(np.diff(cut)), pa.array(node_of(h, cut).view(np.int64))], ["doc_id", "n_shingles", "node"])

    slim, _ = written(plain.mapInArrow(tidy(described), "doc_id long, n_shingles long, node long"), "sets")
    live = slim.where("doc_id is not null and n_shingles > 0")
    whole = live.agg(F.max("n_shingles").alias("largest"), F.sum("n_shingles").alias("all")).first()
    largest = whole["largest"] or 0
    n_parts = max(partitions(spark), -(-(whole["all"] or 0) * 6 // TARGET))
    low = boundaries(largest, percent)
    counts: dict[int, int] = {}
    for r in live.groupBy(F.floor(F.log2("n_shingles") * 8).alias("at")).agg(F.countDistinct("node").alias("n")).collect():  # a few hundred at most
        i = int(np.searchsorted(low, max(1, 2 ** ((r["at"] + 0.5) / 8)), "right")) - 1
        counts[i] = counts.get(i, 0) + r["n"]
    bands = allocate(counts, largest, percent)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        chunk = TaskContext.get().partitionId() << 24
        for b in batches:
            data, offsets = text_bytes(b.column("text"))
            for i, j in ((x, min(x + PLACES, to)) for at, to in runs(offsets) for x in range(at, to, PLACES)):
                h, cut = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                node = node_of(h, cut)
                new = np.zeros(len(node), bool)
                for x, v in enumerate(node.tolist()):
                    if v not in seen:
                        seen.add(v)
                        new[x] = True
                size = np.diff(cut)
                h, cut, node = h[np.repeat(new, size)], np.concatenate([[0], np.cumsum(size[new])]), node[new]
                for back, sig, at, which, spare in signatures(h, cut, bands, percent):
                    part = (sig & np.uint64(0xFFFFFFFF)).astype(np.int64) * n_parts >> 32
                    order = np.argsort(part, kind="stable")
                    sig, place, part = sig[order] >> np.uint64(32), at[order] * 4 + back, part[order]
                    edge = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
                    blobs = [_packed(chunk, *zip((sig[x:y], place[x:y]), SIGNED, strict=True)) for x, y in zip(edge.tolist(), np.append(edge[1:], len(part)).tolist(), strict=True)]
                    if blobs:
                        noted = [_packed(chunk, *zip((node[which], spare, which * 4 + back), NOTED, strict=True))] + [None] * (len(blobs) - 1)
                        yield pa.record_batch([pa.array(part[edge], pa.int32()), pa.array(blobs, pa.binary()), pa.array(noted, pa.binary())], ["part", "blob", "noted"])
                chunk += 1

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            held += [_unpacked(x, *SIGNED) for x in b.column("blob").to_pylist()]
            for x in b.column("noted").drop_null().to_pylist():
                node, spare, place = _unpacked(x, *NOTED)
                yield _met("set", len(node), place, node.astype(np.uint64).view(np.int64), spare)
        if held:
            sig, place = (np.concatenate(c) for c in zip(*held, strict=True))
            del held
            yield from buckets(sig, place, cap)

    # copies of a set that has a row elsewhere stay out, as long as their ids fit a broadcast; else a place of theirs meets others as any set does
    several = live.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    single = live.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows = 1").select("doc_id")
    copies, copies_at = written(live.join(several, "node").where("doc_id <> first").select("doc_id").join(single, "doc_id", "left_semi"), "copies")
    live_docs = plain.where("doc_id is not null and text is not null")
    live_docs = live_docs.join(F.broadcast(copies) if copies.count() * 16 <= BROADCAST_BYTES else copies, "doc_id", "left_anti")
    dealt = live_docs.mapInArrow(tidy(signed), "part int, blob binary, noted binary").repartitionById(n_parts, F.col("part"))
    lists, at = written(dealt.mapInArrow(tidy(met), MET), "buckets")
    release(spark)
    reps = live.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    places = lists.where("kind <> 'pair'").groupBy(F.col("a").alias("place")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hot"), F.max("spare").alias("spare"), F.max("b").alias("node"))
    places, places_at = written(places, "places")
    pairs = lists.where("kind = 'pair'").groupBy("a", "b").agg(F.sum("n").alias("n"))
    for end in ("a", "b"):
        own = places.select(F.col("place").alias(end), F.col("node").alias(f"node_{end}"), (F.col("spare") + 1 - F.col("hot")).alias(f"needed_{end}"))
        pairs = pairs.join(own, end)
    enough = (F.col("n") >= F.greatest("needed_a", "needed_b", F.lit(1))) & (F.col("node_a") != F.col("node_b"))
    candidates, _ = written(pairs.where(enough).select(F.least("node_a", "node_b").alias("u"), F.greatest("node_a", "node_b").alias("v")).distinct(), "candidates")
    over, _ = written(places.where("hot > spare").select("node").distinct().join(reps, "node"), "over")
    removed(spark, at, places_at, copies_at)
    found = verified(candidates, plain, reps, words, percent)
    crowded = bool(over.take(1))
    if crowded:
        own, own_at = written(shingle_lists(plain, over, words), "shingles")
        prefix, _ = written(rarest(own, percent), "prefix")
        release(spark)
        # the holder whose shingles are the most frequent on average is nearest to the middle of a group
        hubs = prefix.groupBy("list").agg(F.max_by("node", F.struct("middle", "node")).alias("u"))
        stars, _ = written(prefix.join(hubs, "list").where("node <> u").select("u", F.col("node").alias("v")).distinct(), "stars")
        found, _ = written(found.union(verified(stars.join(candidates, ["u", "v"], "left_anti"), plain, reps, words, percent)), "found")
        labels = components(found)
        of = prefix.join(labels, "node", "left").select("list", "node", "n", "first", F.coalesce("component", "node").alias("component"))
        of, _ = written(of, "lists")
        found, _ = written(found.union(compared(of, own, plain, reps, words, percent, stars.union(candidates))), "found")
    found = found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    labels = components(found)
    if not count_links:
        return _named(slim, labels, None)
    degree = found
    if crowded:  # links of two sets that both have too many hot segments are counted in their components, all of them
        for end in ("u", "v"):
            degree = degree.join(over.select(F.col("node").alias(end), F.lit(1).alias(f"over_{end}")), end, "left")
        degree = degree.where("over_u is null or over_v is null")
    degree = degree.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    if crowded:
        degree = degree.union(link_counts(own, labels, percent))
        removed(spark, own_at)
    return _named(slim, labels, degree.groupBy("node").agg(F.sum("n").alias("n_links")))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(documents(spark, sf_dir))


ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS} - 1], ' '))
                                                  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS sh FROM d),
n AS (SELECT doc_id, len(sh) AS n, md5(array_to_string(sh, '|')) AS sid FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v, y.sid AS sid, x.sid = y.sid AS same FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
r AS (SELECT doc_id AS u, doc_id AS root FROM n UNION SELECT l.v, r.root FROM r JOIN l ON l.u = r.u WHERE r.root < l.v),
c AS (SELECT u, min(root) AS component_id FROM r GROUP BY u),
k AS (SELECT u, count(DISTINCT sid) FILTER (WHERE NOT same) AS n_links FROM l GROUP BY u)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, c.component_id, coalesce(k.n_links, 0) AS n_links FROM n JOIN c ON c.u = n.doc_id LEFT JOIN k ON k.u = n.doc_id
"""
