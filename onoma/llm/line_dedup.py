"""Line dedup: lines whose normalised form stands in many documents go from all of them.

Normalised lines are exploded as 128-bit hashes, documents are counted per hash, and each
document is reassembled by position without the lines whose hash is over the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onoma.llm.common import stage

BLANKS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()  # bytes.lower() changes A-Z alone


def _hashes(lines: list[bytes], min_chars: int) -> list[bytes | None]:
    """The hash of each line's key; None for keys below min_chars code points."""
    keys = map(line_key, lines)
    return [xxhash.xxh3_128_digest(k) if (len(k) if k.isascii() else len(k.decode())) >= min_chars else None for k in keys]


def _as_longs(hashes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)


def _line_hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [list(dict.fromkeys(h for h in _hashes((t or b"").split(b"\n"), min_chars) if h)) for t in b.column("text").cast(pa.binary()).to_pylist()]
            halves = _as_longs([h for hs in found for h in hs])
            rows = np.repeat(np.arange(len(found)), [len(hs) for hs in found])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows)), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["doc_id", "h1", "h2"])

    return run


def _drop_lines(columns: list[str], min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n_lines, n_dropped, digests = [], [], [], []
            for t, hot in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("_hot").to_pylist(), strict=True):
                lines = (t or b"").split(b"\n")
                kept = lines
                if hot:
                    gone = {np.array([x["h1"], x["h2"]], dtype="<i8").tobytes() for x in hot}
                    kept = [x for x, h in zip(lines, _hashes(lines, min_chars), strict=True) if h not in gone]
                out = b"\n".join(kept)
                texts.append(out.decode())
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                digests.append(hashlib.sha256(out).hexdigest())
            arrays = [pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests, pa.string())], [*columns, "n_lines", "n_dropped", "kept_sha256"])

    return run


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs(doc_id, text, ...) with `text` reduced, and n_lines, n_dropped, kept_sha256 (these replace columns of those names).

    Null and empty texts are one empty line, which stays (its key has no code point). Rows that
    repeat a doc_id count as one document, and each loses its lines; a row without one is a document of
    its own. No input rows: no rows. A very long text is one row, with 16 bytes for each of its lines.
    The plan shuffles (document, hash) pairs twice, partially aggregated, so a line found in
    a third of all documents is no hot key, and the texts once, to meet their lists.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_sha256", "_hot")]
    docs = docs.select(*columns)
    pairs = stage(docs.select("doc_id", "text").mapInArrow(_line_hashes(min_chars), docs.select("doc_id").schema.add("h1", "long").add("h2", "long")), "lines")
    hot = pairs.groupBy("h1", "h2").agg((F.countDistinct("doc_id") + F.count(F.when(F.col("doc_id").isNull(), 1))).alias("n")).filter(F.col("n") >= min_docs).select("h1", "h2")
    hot = stage(hot, "hot")  # a table of its own, so that the join reads plain exchanges: Spark can split a hot line's rows
    lists = pairs.join(hot, ["h1", "h2"], "left_semi").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.struct("h1", "h2")).alias("_hot"))
    joined = docs.join(lists, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(*columns, "_hot")
    schema = docs.schema.add("n_lines", "long").add("n_dropped", "long").add("kept_sha256", "string")
    return joined.mapInArrow(_drop_lines(columns, min_chars), schema)
