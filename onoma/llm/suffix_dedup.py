"""Exact substring dedup by a logarithmic family of suffix arrays over anchored suffixes.

Every string of `length` bytes has one anchor, the place of its least k-gram hash, and equal
strings have equal anchors, so only strings with a common anchor hash are compared. The strings
that start in a row and share an anchor are one chunk, about a 150th of the text.

1. Chunks are hashed. One whose anchor hash is nowhere else has no repeat; chunks equal as a
   whole are folded into one cell with a count.
2. The cells of an anchor that has many are cut again by anchors of another hash, as if they were
   texts, so that what many texts share is dealt over all tasks.
3. The cells that are left are the suffixes of an index, dealt by anchor hash. In each task
   new batches of cells get a suffix array (the bytes from the anchor on, with common prefix
   lengths) and one of the reversed bytes before the anchor. A level is merged into the standing
   one of equal size, in both orders, and the merged neighbours are scanned: at each offset of a
   string to its anchor, cells whose right parts lie in one run of the first array, and left parts
   in one run of the second, hold the same string.
4. What the strings found cover is removed, document by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onoma.llm.common import stage, text_or_empty

LENGTH = 400
GRAM = 100
SPAN = LENGTH - GRAM  # an anchor is 0 to SPAN bytes from a string's start
#: Bytes of text whose hashes are held at once, some 100 bytes for each; places in them have 20 bits.
SEGMENT = 1 << 18
PLACES = 1 << 20
ROWS = 256
BATCH = 2048
CELLS_A_TASK = 8192
#: Cells of one anchor hash beyond which they are cut again by anchors of another hash, and how many hashes there are.
SPLIT, HASHES = 256, 3
#: Cells of one anchor of the last hash beyond which their strings, few by then, are counted one by one over all tasks.
LARGE = 256

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_LOW = np.uint64(PLACES - 1)
#: A second hash, modulo a prime: powers of two alone have short strings that collide by their form.
_PRIME, _PRIME_BASE = 2**31 - 1, 1_103_515_245
_tables: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of both bases and of their inverses, kept in the worker process."""
    if not _tables or len(_tables[0]) < n:
        size = max(n, SEGMENT + 2 * LENGTH)
        _tables[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, x, np.uint64)))) for x in (_BASE, _INVERSE)]
        for base in (_PRIME_BASE, pow(_PRIME_BASE, -1, _PRIME)):
            made = np.ones(1, np.uint64)
            while len(made) < size + 1:  # as many again, times the power that follows
                made = np.concatenate((made, made * np.uint64(pow(base, len(made), _PRIME)) % np.uint64(_PRIME)))
            _tables.append(made[: size + 1])
    return [x[:n] for x in _tables]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _sums(buf: np.ndarray) -> np.ndarray:
    """sums[j] - sums[i] is the polynomial hash of bytes i to j, times base^i."""
    return np.concatenate(([np.uint64(0)], np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers(len(buf))[0])))


def _content(buf: np.ndarray, sums: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """64 bits of the bytes `first` to `after`, of both hashes."""
    _, down, up, back = _powers(len(buf) + 1)
    prime = np.uint64(_PRIME)
    other = np.concatenate(([np.uint64(0)], np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)] % prime)))
    other = (other[after] - other[first]) % prime * back[first] % prime
    return _mixed((sums[after] - sums[first]) * down[first] + (after - first).astype(np.uint64)) ^ _mixed(other + np.uint64(1 << 40))


def _least(values: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values, by running minima within blocks of w from both sides."""
    n = len(values)
    blocks = np.concatenate((values, np.full(-n % w, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def _cut(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, salt: int = 0) -> tuple[np.ndarray, ...]:
    """The chunks of texts that lie end to end: (start, strings, offset of the anchor, anchor hash, content hash)."""
    sums, down = _sums(buf), _powers(len(buf))[1]
    n = len(buf) - GRAM + 1
    gram = _mixed((sums[GRAM:] - sums[:n]) * down[:n] ^ np.uint64(salt * 0x5851F42D4C957F2D % 2**64))
    least = _least((gram & ~_LOW) | np.arange(n, dtype=np.uint64), SPAN + 1)
    valid = np.zeros(len(least) + 1, dtype=np.int8)
    long = lengths >= LENGTH
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, (starts + lengths - LENGTH + 1)[long], -1)
    valid = np.cumsum(valid[:-1]) > 0
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    stop = valid.copy()
    stop[:-1] &= new[1:] | ~valid[1:]
    last = np.flatnonzero(stop)
    content = _content(buf, sums, first, last + LENGTH)
    return first, last - first + 1, (least[first] & _LOW).astype(np.int64) - first, (least[first] >> np.uint64(20)).astype(np.int64), content.view(np.int64)


def _segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Buffers of up to SEGMENT bytes, and little more, with (row, place in the text, place in the buffer, length) of each piece.

    A longer text comes in pieces that overlap by length - 1 bytes, so that each string is in one.
    """
    held: list[bytes] = []
    pieces: list[tuple[int, int, int, int]] = []
    size = 0
    step = SEGMENT // 2
    for row, t in enumerate(texts):
        for at in range(0, max(len(t) - LENGTH + 1, 0), step):
            piece = t[at : at + step + LENGTH - 1]
            pieces.append((row, at, size, len(piece)))
            held.append(piece)
            size += len(piece)
            if size >= step:
                yield np.frombuffer(b"".join(held), np.uint8), pieces
                held, pieces, size = [], [], 0
    if size >= LENGTH:
        yield np.frombuffer(b"".join(held), np.uint8), pieces


def _chunks(salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                b = batch.slice(lo, ROWS)
                for buf, pieces in _segments([t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]):
                    row, at, start, length = (np.array(x, dtype=np.int64) for x in zip(*pieces, strict=True))
                    first, count, offset, anchor, content = _cut(buf, start, length, salt)
                    piece = np.searchsorted(start, first, side="right") - 1
                    own = pa.array(row[piece])
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(own), b.column("rid").take(own), pa.array(at[piece] + first - start[piece]), pa.array(count.astype(np.int32)), pa.array(offset.astype(np.int32)), pa.array(anchor), pa.array(content)],
                        ["doc_id", "rid", "at", "n", "offset", "anchor", "content"],
                    )

    return run


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the cells that stand in each document."""
    for b in batches:
        rows = []
        for t, cells in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("cells").to_pylist(), strict=True):
            rows += [(c["anchor"], c["content"], c["offset"], c["whole"], (t or b"")[c["at"] : c["at"] + c["n"] + LENGTH - 1]) for c in cells]
        made = zip(*rows, strict=True) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(made, [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()], strict=True)], ["anchor", "content", "offset", "whole", "bytes"])


def _common(rows: np.ndarray) -> np.ndarray:
    """Common prefix lengths of neighbouring rows."""
    differ = rows[1:] != rows[:-1]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes of one width as values that sort like them."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def _places(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the entries of two sorted arrays of keys stand when they are merged."""
    second = np.searchsorted(one, two, side="right") + np.arange(len(two))
    free = np.ones(len(one) + len(two), bool)
    free[second] = False
    return np.flatnonzero(free), second


class Level:
    """Cells in the order of their suffix array, and for each offset whether the string there is repeated.

    rows holds their columns; right and left the bytes from the anchor on and those before it in
    reverse, each behind the anchor hash; by_left the order of the left rows.
    """

    def __init__(self, rows: list[np.ndarray], right: np.ndarray, left: np.ndarray, by_left: np.ndarray):
        self.rows, self.right, self.left, self.by_left = rows, right, left, by_left

    @classmethod
    def build(cls, cells: list[tuple[int, int, int, bool, bytes]]) -> Level:
        """The suffix array of a new batch."""
        anchor, content, offset, whole = (np.array(x, k) for x, k in zip(list(zip(*cells, strict=True))[:4], (np.int64, np.int64, np.int64, bool), strict=True))
        head = anchor.astype(">i8").view(np.uint8).reshape(-1, 8)
        right, left = (np.concatenate((head, np.zeros((len(cells), n), np.uint8)), axis=1) for n in (LENGTH, SPAN))
        size = np.zeros(len(cells), np.int64)
        for i, (_, _, o, _, raw) in enumerate(cells):
            x = np.frombuffer(raw, np.uint8)
            size[i] = len(x) - o
            right[i, 8 : 8 + size[i]] = x[o:]
            left[i, 8 : 8 + o] = x[:o][::-1]
        order = np.argsort(_keys(right), kind="stable")
        rows = [x[order] for x in (anchor, content, offset, whole, size, np.zeros((len(cells), SPAN + 1), bool))]
        return cls(rows, right[order], left[order], np.argsort(_keys(left[order]), kind="stable")).scanned()

    def __len__(self) -> int:
        return len(self.right)

    def merged(self, other: Level) -> Level:
        """Both orders are merged, not sorted again; then neighbours are scanned."""
        mine, theirs = _places(_keys(self.right), _keys(other.right))

        def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            out = np.empty((len(a) + len(b), *a.shape[1:]), a.dtype)
            out[mine], out[theirs] = a, b
            return out

        by_left = np.empty(len(self) + len(other), np.int64)
        first, second = _places(_keys(self.left[self.by_left]), _keys(other.left[other.by_left]))
        by_left[first], by_left[second] = mine[self.by_left], theirs[other.by_left]
        return Level([both(a, b) for a, b in zip(self.rows, other.rows, strict=True)], both(self.right, other.right), both(self.left, other.left), by_left).scanned()

    def scanned(self) -> Level:
        """With every string that two of the cells share marked."""
        _, _, offset, _, size, found = self.rows
        prefix, suffix = _common(self.right) - 8, _common(self.left[self.by_left]) - 8  # below 0 where anchors differ
        place = np.empty(len(self), np.int64)
        place[self.by_left] = np.arange(len(self))
        near = prefix >= GRAM
        pairs = np.flatnonzero(np.concatenate(([False], near)) | np.concatenate((near, [False])))
        if not len(pairs):
            return self
        for d in range(SPAN + 1):
            live = pairs[(offset[pairs] >= d) & (size[pairs] >= LENGTH - d)]
            if len(live) < 2:
                continue
            run = np.concatenate(([0], np.cumsum(prefix < LENGTH - d)))
            before = np.concatenate(([0], np.cumsum(suffix < d)))[place]
            key = run[live] * len(self) + before[live]
            by = np.argsort(key)
            same = key[by][1:] == key[by][:-1]
            found[live[by[1:][same]], d] = True
            found[live[by[:-1][same]], d] = True
        return self

    def covers(self) -> Iterator[tuple[int, int, list[dict[str, int]]]]:
        """(anchor, content, spans within the chunk) of the cells with a repeated string, but for whole cells."""
        anchor, content, offset, whole, _, found = self.rows
        for i in np.flatnonzero(found.any(axis=1) & ~whole):
            yield int(anchor[i]), int(content[i]), spans_of(offset[i] - np.flatnonzero(found[i])[::-1])


def spans_of(starts: np.ndarray) -> list[dict[str, int]]:
    """What strings at these ascending starts cover."""
    cut = np.flatnonzero(np.diff(starts) > LENGTH) + 1
    return [{"a": int(x[0]), "b": int(x[-1]) + LENGTH} for x in np.split(starts, cut)]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    levels: list[Level] = []
    rows: list[tuple] = []

    def add() -> None:
        levels.append(Level.build(rows))
        rows.clear()
        while len(levels) > 1 and len(levels[-2]) <= len(levels[-1]):
            last = levels.pop()
            levels.append(levels.pop().merged(last))

    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("anchor", "content", "offset", "whole", "bytes")), strict=True):
            rows.append(row)
            if len(rows) == BATCH:
                add()
    if rows:
        add()
    while len(levels) > 1:
        last = levels.pop()
        levels.append(levels.pop().merged(last))
    for level in levels:
        out = list(level.covers())
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [()] * 3, kinds, strict=True)], ["anchor", "content", "spans"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with the hash of each string of each cell."""
    for b in batches:
        raws = [x.as_py() for x in b.column("bytes")]
        for lo in range(0, len(raws), 1024):
            own = raws[lo : lo + 1024]
            sizes = np.array([len(x) for x in own])
            starts, n = np.cumsum(sizes) - sizes, sizes - LENGTH + 1
            buf = np.frombuffer(b"".join(own), np.uint8)
            cell = np.repeat(np.arange(len(own)), n)
            at = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)
            first = starts[cell] + at
            h = _content(buf, _sums(buf), first, first + LENGTH)
            of = pa.array(cell + lo)
            offset = b.column("offset").take(of).to_numpy() - at
            yield pa.RecordBatch.from_arrays([b.column("anchor").take(of), b.column("content").take(of), pa.array(at.astype(np.int32)), pa.array(offset.astype(np.int32)), pa.array(h.view(np.int64))], ["anchor", "content", "at", "d", "h"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [(x, y, spans_of(np.array(sorted(at)))) for x, y, at in zip(*(b.column(c).to_pylist() for c in ("anchor", "content", "at")), strict=True)]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [()] * 3, kinds, strict=True)], ["anchor", "content", "spans"])


COVERS = "anchor long, content long, spans array<struct<a: int, b: int>>"


def _remove(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, spans in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("_spans").to_pylist(), strict=True):
                t, kept, end, gone, runs = t or b"", [], 0, 0, 0
                reach = -1
                for x in sorted((s["a"], s["b"]) for s in spans or []):
                    if x[0] > reach:
                        runs += 1
                        kept.append(t[end : x[0]])
                    gone += max(0, x[1] - max(x[0], reach, 0))
                    reach = max(reach, x[1])
                    end = reach
                kept.append(t[end:])
                out = b"".join(kept)
                rows.append((out, len(t), gone, runs, hashlib.sha256(out).hexdigest()))
            made = zip(*rows, strict=True) if rows else [()] * 5
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *(pa.array(x, k) for x, k in zip(made, kinds, strict=True))], [*columns, "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def repeated_spans(rows: DataFrame, split: int = SPLIT, large: int = LARGE, hashes: int = HASHES, salt: int = 0) -> DataFrame:
    """(doc_id, rid, spans) of rows(doc_id, rid, text): what repeated strings cover, unmerged."""
    read = rows.select("doc_id", "rid", "text")
    schema = read.select("doc_id", "rid").schema
    for c, kind in (("at", "long"), ("n", "integer"), ("offset", "integer"), ("anchor", "long"), ("content", "long")):
        schema = schema.add(c, kind)
    chunks = stage(read.mapInArrow(_chunks(salt), schema), "chunks")
    # a table of its own, so that the join below reads plain exchanges, whose hot anchors Spark can split
    again = stage(chunks.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor"), "anchors")
    chunks = stage(chunks.join(again, "anchor", "left_semi").select(*chunks.columns), "repeated")
    cells = chunks.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*(x for x in chunks.columns if x not in ("anchor", "content")))).alias("one"))
    cells = stage(cells, "cells")
    groups = stage(cells.groupBy(F.col("anchor").alias("_a")).agg(F.count(F.lit(1)).alias("d")).filter("d > 1"), "groups")
    last = salt + 1 >= hashes
    open_ = cells.join(groups, F.col("anchor") == F.col("_a")).select("anchor", "content", (F.col("c") > 1).alias("whole"), "one.*", (F.col("d") > (large if last else split)).alias("hot"))
    open_ = stage(open_, "open")
    n_open, n_hot = open_.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("hot").cast("long")), F.lit(0))).first()
    folded = cells.filter("c > 1")
    covers = folded.select("anchor", "content", F.array(F.struct(F.lit(0).alias("a"), (F.col("one.n") + LENGTH - 1).cast("int").alias("b"))).alias("spans"))

    def bytes_of(some: DataFrame) -> DataFrame:
        lists = some.groupBy(F.col("doc_id").alias("_d"), F.col("rid").alias("_r")).agg(F.collect_list(F.struct("anchor", "content", "offset", "whole", "at", "n")).alias("cells"))
        met = read.join(lists, (F.col("rid") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d"))).select("text", "cells")
        return met.mapInArrow(_contexts, "anchor long, content long, offset int, whole boolean, bytes binary")

    if n_open > n_hot:
        parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_open // CELLS_A_TASK))
        covers = covers.union(bytes_of(open_.filter("not hot")).repartition(parts, "anchor").mapInArrow(_index, COVERS))
    if n_hot:
        hot = bytes_of(open_.filter("hot"))
        if last:
            strings = stage(hot.mapInArrow(_strings, "anchor long, content long, at int, d int, h long"), "strings")
            twice = strings.groupBy("anchor", "d", "h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
            found = strings.join(twice, ["anchor", "d", "h"], "left_semi").groupBy("anchor", "content").agg(F.collect_list("at").alias("at")).mapInArrow(_joined, COVERS)
        else:
            # equal strings of equal anchors have equal anchors of any hash, and stand in different cells
            texts = stage(hot.select(F.col("anchor").alias("doc_id"), F.col("content").alias("rid"), F.col("bytes").alias("text")), "hot")
            inner = repeated_spans(texts, split, large, hashes, salt + 1)
            found = inner.select(F.col("doc_id").alias("anchor"), F.col("rid").alias("content"), F.transform("spans", lambda x: F.struct(x["a"].cast("int").alias("a"), x["b"].cast("int").alias("b"))).alias("spans"))
        covers = covers.union(found.join(folded.select("anchor", "content"), ["anchor", "content"], "left_anti"))
    covers = stage(covers, "covers").select(F.col("anchor").alias("_a"), F.col("content").alias("_c"), "spans")
    met = chunks.join(covers, (F.col("anchor") == F.col("_a")) & (F.col("content") == F.col("_c")))
    spans = met.select("doc_id", "rid", F.transform("spans", lambda s: F.struct((F.col("at") + s["a"]).alias("a"), (F.col("at") + s["b"]).alias("b"))).alias("spans"))
    return spans.groupBy("doc_id", "rid").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def suffix_dedup(docs: DataFrame, split: int = SPLIT, large: int = LARGE, hashes: int = HASHES) -> DataFrame:
    """docs' columns with kept (binary), n_bytes, n_removed, n_spans and kept_sha256, which replace columns of those names.

    Texts are their UTF-8 bytes, null texts empty. Removed is each byte of a 400-byte string that
    starts anywhere else too. A row that stands twice is two documents, so all of it that is long
    enough goes in both. Cells of any number are compared exactly: those of an anchor with more than
    `split` are cut again by the next of `hashes` hashes, and beyond `large` of the last one their
    strings are counted over all tasks. A very long text is cut in overlapping pieces, so that
    memory holds it once, and no more than a piece of hashes. An empty table gives no rows.
    """
    made = ("kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "rid", "_spans")
    columns = [c for c in docs.columns if c not in made]
    rows = docs.select(*columns).withColumn("rid", F.xxhash64("doc_id", text_or_empty()))
    spans = stage(repeated_spans(rows, split, large, hashes).select(F.col("doc_id").alias("_d"), F.col("rid").alias("_r"), F.col("spans").alias("_spans")), "spans")
    met = rows.join(spans, (F.col("rid") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left").select(*columns, "_spans")
    schema = rows.select(*columns).schema
    for c, kind in (("kept", "binary"), ("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string")):
        schema = schema.add(c, kind)
    return met.mapInArrow(_remove(columns), schema)
