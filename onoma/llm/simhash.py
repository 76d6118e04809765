"""SimHash near-duplicates: pivot distance tables over buckets that no linked pair can miss.

Fingerprints within `radius` bits agree on all but `radius` of any blocks they are cut into, so
they meet in a bucket of some choice of `blocks - radius` equal blocks. In a bucket, pairs
are first compared by their distances to reference fingerprints: by the triangle inequality
two rows of that table that differ by more than `radius` in any coordinate can't be linked.
Survivors are verified by their exact distance. Buckets are counted first, and members of those too
large for one task go to buckets of more blocks, which share more bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onoma.llm.common import stage
from onoma.llm.components import connected_components

#: Distances to a random fingerprint tell little alone; so many references reject most far pairs.
N_PIVOTS = 16
PIVOTS = np.random.default_rng(64).integers(0, 2**64, N_PIVOTS, dtype=np.uint64)
#: Buckets up to this size are compared at all offsets at once, others by a breadth-first search.
SMALL = 16
#: Distinct fingerprints in a bucket beyond which its members are dealt to finer buckets, and last to shared variants.
LARGE = 20_000


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    words = text.lower().split()  # ASCII alone: A-Z and the six blanks
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: len(words) - width])).tolist()
        h = xxhash.xxh64_intdigest
        hashes = [h(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
    arr = np.array(hashes, dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(arr), 1 << 16):  # bounds the unpacked bits of a very long text
        counts += np.unpackbits(arr[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(arr), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = np.array([fingerprint(t or b"") for t in b.column("text").cast(pa.binary()).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(f.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): a long for each row; null and wordless texts have 0."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, docs.select("doc_id").schema.add("fp", "long"))


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to the references: one row of bytes per reference."""
    return np.stack([np.bitwise_count(fps ^ p) for p in PIVOTS]).astype(np.int8)


def close(fps: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs (a, b) of indices are linked: pivots discard first, distances decide."""
    alive = np.arange(len(a))
    for row in table:
        alive = alive[np.abs(row[a[alive]] - row[b[alive]]) <= radius]
    return alive[np.bitwise_count(fps[a[alive]] ^ fps[b[alive]]) <= radius]


def search(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of one bucket.

    Breadth first: a fingerprint is compared with those not reached yet, which shrink fast in a
    group of near copies, and among these with the run whose first pivot distance is near enough.
    """
    table = pivot_table(fps)
    left = np.argsort(table[0], kind="stable")
    heads: list[int] = []
    tails: list[int] = []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            x = todo.pop()
            d = table[0][left]
            lo, hi = np.searchsorted(d, table[0][x] - radius), np.searchsorted(d, table[0][x] + radius, side="right")
            near = left[lo:hi]
            hit = close(fps, table, np.full(len(near), x), near, radius)
            if len(hit):
                found = near[hit].tolist()
                heads += [x] * len(found)
                tails += found
                todo += found
                left = np.delete(left, lo + hit)
    return heads, tails


def _links(radius: int):
    """Rows sorted by bucket -> (a, b): links that span each bucket."""

    def solve(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        heads, tails = [], []
        sizes = ends - starts
        for i in np.flatnonzero(sizes > SMALL):
            own = fps[starts[i] : ends[i]]
            h, t = search(own, radius)
            heads.append(own[h])
            tails.append(own[t])
        few = (sizes > 1) & (sizes <= SMALL)
        if few.any():
            at = np.concatenate([np.arange(a, b) for a, b in zip(starts[few], ends[few], strict=True)]) if few.sum() < 1000 else np.flatnonzero(np.repeat(few, sizes))
            own, end = fps[at], np.repeat(np.cumsum(sizes[few]), sizes[few])
            table = pivot_table(own)
            for t in range(1, int(sizes[few].max())):
                a = np.flatnonzero(np.arange(len(own)) + t < end)
                hit = close(own, table, a, a + t, radius)
                heads.append(own[a[hit]])
                tails.append(own[a[hit] + t])
        empty = [np.empty(0, np.uint64)]
        return np.concatenate(heads or empty), np.concatenate(tails or empty)

    def out(fps: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        made = solve(fps, bounds[:-1], bounds[1:])
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in made], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows of the bucket that the last batch may have cut: `large` at most
        for b in batches:
            if not b.num_rows:
                continue
            now = (b.column("t").to_numpy(), b.column("key").to_numpy(), b.column("fp").to_numpy().view(np.uint64))
            if kept and (kept[-1][0][-1], kept[-1][1][-1]) == (now[0][-1], now[1][-1]) and (now[0][0], now[1][0]) == (now[0][-1], now[1][-1]):
                kept.append(now)  # the whole batch is of the bucket that is open
                continue
            t, key, fps = (np.concatenate([x[i] for x in [*kept, now]]) for i in range(3))
            new = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            last = new[-1] if len(new) else 0
            kept = [(t[last:], key[last:], fps[last:])]
            if last:
                yield out(fps[:last], np.concatenate(([0], new)))
        if kept:
            fps = np.concatenate([x[2] for x in kept])
            yield out(fps, np.array([0, len(fps)]))

    return run


def blocks_for(n: int, radius: int = 4) -> int:
    """The fewest blocks for which n random fingerprints fill a bucket with about 8 at most."""
    blocks = radius + 2
    while n > 8 * 2 ** (64 * (blocks - radius) // blocks) and blocks < radius + 6:
        blocks += 1
    return blocks


def masks(blocks: int, radius: int) -> list[int]:
    """For each choice of blocks - radius blocks, the bits that a bucket's fingerprints share."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    part = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    return [sum(part[i] for i in c) for c in combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _variants(radius: int):
    """Each fingerprint with every change of up to radius / 2 bits: linked ones share a variant."""
    flips = np.array([sum(1 << i for i in c) for k in range((radius + 1) // 2 + 1) for c in combinations(range(64), k)], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy().view(np.uint64)
            for i in range(0, len(fps), 500):
                own = fps[i : i + 500]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, len(flips)).view(np.int64)), pa.array((own[:, None] ^ flips).ravel().view(np.int64))], ["fp", "variant"])

    return run


def fingerprint_links(distinct: DataFrame, radius: int = 4, large: int = LARGE, finer: tuple[int, ...] = (2, 4, 6)) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints (column fp) just as all links would.

    Buckets are counted with partial sums before any is dealt to a task. One of more than `large` is
    not searched: its members go to buckets of so many more blocks, where every link has a bucket
    again, and at last to variants of half the radius, of which linked ones share one (2081 rows
    for each member, left to what no choice of blocks tells apart).
    """
    n = distinct.count()
    found: list[DataFrame] = []
    for more in (0, *finer):
        keys = masks(blocks_for(n, radius) + more, radius)
        rows = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(keys)))).alias("x")).select("fp", "x.t", "x.key")
        hot = stage(rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > large).select("t", "key"), "hot")
        some_hot = hot.limit(1).count() > 0
        cold = (rows.join(hot, ["t", "key"], "left_anti") if some_hot else rows).repartition("t", "key").sortWithinPartitions("t", "key")
        found.append(stage(cold.select("fp", "t", "key").mapInArrow(_links(radius), "a long, b long"), "links"))
        if not some_hot:
            return reduce(DataFrame.union, found).distinct()
        distinct = stage(rows.join(hot, ["t", "key"], "left_semi").select("fp").distinct(), "members")
    met = stage(distinct.mapInArrow(_variants(radius), "fp long, variant long"), "variants")
    least = met.groupBy("variant").agg(F.min("fp").alias("a"))
    found.append(met.join(least, "variant").filter("a <> fp").select("a", F.col("fp").alias("b")))
    return reduce(DataFrame.union, found).distinct()


def near_duplicates(docs: DataFrame, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs: component_id is the least doc_id that links reach.

    Rows of equal fingerprint are one node, so copies cost no pairs. Null or wordless texts
    have fingerprint 0 and are linked like others; repeated rows get the same component. Rows
    without a doc_id get the least doc_id of their component, or null. An empty table gives no rows.
    Other columns are not read, whatever their names. A very long text is hashed whole, its bits counted piece by piece.
    """
    rows = stage(fingerprints(docs), "fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = stage(connected_components(fingerprint_links(nodes.select("fp"), radius)), "roots")
    linked = nodes.join(roots, F.col("fp") == F.col("node")).select("fp", "least", "root")
    own = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(own, "root").select("fp", "component_id")
    of = nodes.join(linked.select(F.col("fp").alias("_f"), "component_id"), F.col("fp") == F.col("_f"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component_id", "least").alias("component_id"))
    # a table of its own, so that the join reads plain exchanges: Spark can split the rows of a hot fingerprint
    return rows.join(stage(of, "components"), F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, radius: int = 4) -> DataFrame:
    """docs without all but one document of each component: the rows whose doc_id names it.

    Rows without a doc_id can't be told apart, so they all stay; so do rows that repeat the
    doc_id that stays.
    """
    drop = near_duplicates(docs, radius).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(drop, F.col("doc_id") == F.col("_gone"), "left_anti")
