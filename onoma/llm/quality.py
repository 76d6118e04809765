"""Quality rules: base word rules, then zstandard compression bands over texts and chunks.

Repetitive text compresses too well, and noise too badly. Both limits depend on the number
of bytes, as short texts carry zstandard's header and have no history to refer to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
LARGE_SCRIPTS = bytes(range(0xE3, 0xF0))  # first of three bytes: kana, Han, Hangul
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, chunk_low double, chunk_high double, kept boolean"


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio bytes / compressed bytes, by length: (from bytes, lowest, lowest of large scripts, highest).

    Below the first length no verdict is given: a header outweighs the content. The lowest are
    just under the ratios of clean text of that length, and below 200 bytes there is none, as
    zstandard stores clean text raw there. Scripts of thousands of characters (kana, Han, Hangul)
    compress less; a mixed text is held to the mean of the compressed sizes by its share of them.
    The whole text must be in its band; of the bytes of its fixed chunks at most `bad_share` may
    be in chunks out of the band of their length. The last chunk is what is left of the text.
    """

    level: int = 3
    chunk: int = 4096
    bad_share: float = 0.2
    limits: tuple[tuple[int, float, float, float], ...] = (
        (60, 0.0, 0.0, 2.4),
        (200, 1.0, 0.95, 2.8),
        (300, 1.08, 0.96, 2.8),
        (400, 1.15, 0.98, 2.8),
        (600, 1.26, 1.05, 2.8),
        (800, 1.33, 1.1, 2.8),
        (1000, 1.38, 1.16, 4.0),
        (1500, 1.46, 1.23, 4.0),
        (2000, 1.53, 1.28, 4.0),
        (4000, 1.7, 1.42, 5.0),
        (8000, 1.85, 1.54, 5.0),
        (16000, 2.0, 1.72, 6.0),
    )

    def band(self, n: int, large: float = 0.0) -> tuple[float, float] | None:
        """Lowest and highest ratio of n bytes, of which a share `large` is of large scripts."""
        found = [x[1:] for x in self.limits if n >= x[0]]
        if not found:
            return None
        low, low_large, high = found[-1]
        return (1 / ((1 - large) / low + large / low_large) if low else 0.0), high


def large_share(text: bytes) -> float:
    """The share of bytes that are of characters of large scripts."""
    return 3 * (len(text) - len(text.translate(None, LARGE_SCRIPTS))) / max(len(text), 1)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """How many words stand in windows of `width` words that the text holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], dtype=np.int64)
    if len(ids) ** width < 2**63:
        key = np.zeros(n, dtype=np.int64)
        for j in range(width):
            key = key * len(ids) + w[j : j + n]
    else:  # name pairs of names, so that keys stay exact
        key = w[:n]
        for j in range(1, width):
            key = np.unique(key * len(ids) + w[j : j + n], return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def base_stats(text: bytes) -> tuple[int, int, int, int, int, bool]:
    words = text.split()  # bytes.split() knows just the six ASCII blanks
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    repeats = repeated_words(words)
    failed = len(words) < 10 or 100 * repeats > 20 * len(words)
    return len(words), len(text.translate(None, BLANKS + CONTINUATION)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats, failed


def chunks_of(text: bytes, bands: Bands) -> list[bytes]:
    """The chunks of a text, the last as long as the rest (none if the text is below a full chunk)."""
    return [text[i : i + bands.chunk] for i in range(0, len(text), bands.chunk)] if len(text) >= bands.chunk else []


def ratio(text: bytes, compress) -> float:
    return len(text) / len(compress(text)) if text else 0.0


def verdict(n_bytes: int, whole: float, chunks: list[float], bands: Bands, large: float = 0.0, parts: list[tuple[int, float]] | None = None) -> bool:
    """By the ratios of the whole text and its chunks, and `parts`: bytes and share of large scripts of each chunk."""
    band = bands.band(n_bytes, large)
    if band is None:
        return True
    parts = parts or [(bands.chunk, 0.0)] * len(chunks)
    limits = [bands.band(*x) or (0.0, float("inf")) for x in parts]
    out = sum(n for (n, _), x, (low, high) in zip(parts, chunks, limits, strict=True) if not low <= x <= high)
    return band[0] <= whole <= band[1] and out <= bands.bad_share * sum(n for n, _ in parts)


def _score(columns: list[str], bands: Bands):
    names = [x.split()[0] for x in STATS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=bands.level).compress
        for b in batches:
            rows = []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                t = t or b""
                stats = base_stats(t)
                parts = chunks_of(t, bands)
                whole, chunks = ratio(t, compress), [ratio(x, compress) for x in parts]
                keep = not stats[-1] and verdict(len(t), whole, chunks, bands, large_share(t), [(len(x), large_share(x)) for x in parts])
                rows.append((*stats, whole, min(chunks, default=whole), max(chunks, default=whole), keep))
            made = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else [()] * 10, [pa.int64()] * 5 + [pa.bool_()] + [pa.float64()] * 3 + [pa.bool_()], strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *made], [*columns, *names])

    return run


def quality_rules(docs: DataFrame, bands: Bands | None = None, carry: list[str] | None = None) -> DataFrame:
    """The `carry` columns of docs (default: all) with the word statistics, compression ratios and `kept`.

    One pass over the rows without a shuffle. Null texts are empty: no words, so base_failed.
    Statistics replace columns of the same names. Repeated rows are judged each; an empty table gives
    no rows. A very long text is judged whole and by all its chunks, one text at a time.
    """
    names = [x.split()[0] for x in STATS.split(", ")]
    columns = [c for c in carry or docs.columns if c not in names]
    read = docs.select(*dict.fromkeys([*columns, "text"]))
    schema = read.select(*columns).schema
    for x in STATS.split(", "):
        schema = schema.add(*x.split())
    return read.mapInArrow(_score(columns, bands or Bands()), schema)
