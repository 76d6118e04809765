"""Weighted edit distance of keys.

Optimal string alignment in which three light letters cost little to insert or delete, and
neighbours change places at less than two edits. Two forms give the same: a column expression of
built-in functions, and an Arrow function that runs the rows of the table for thousands of pairs
at once. The first is interpreted cell by cell, so joins use the second.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from onoma.functions import tables as t
from onoma.functions.text import characters, jamo_key


def _cost(letter: Column) -> Column:
    return F.when(letter.isin(*t.CHEAP), F.lit(t.CHEAP_COST)).otherwise(F.lit(1.0))


def weighted_distance(a: Column, b: Column) -> Column:
    """Of two strings, as a column expression; rows of the table are folded over the letters of a."""

    def table(p: Column) -> Column:
        x, y = p["x"], p["y"]
        first = F.aggregate(y, F.array(F.lit(0.0)), lambda acc, c: F.array_append(acc, F.element_at(acc, -1) + _cost(c)))

        def row(rows: Column, i: Column) -> Column:
            ca = F.get(x, i)

            def cell(cur: Column, j: Column) -> Column:
                cb, up = F.get(y, j), rows["prev"]
                plain = F.when(ca == cb, F.get(up, j)).otherwise(F.least(F.get(up, j + 1) + _cost(ca), F.get(cur, j) + _cost(cb), F.get(up, j) + 1.0))
                swapped = (i > 0) & (j > 0) & (ca == F.get(y, j - 1)) & (F.get(x, i - 1) == cb)
                return F.array_append(cur, F.when(swapped, F.least(plain, F.get(rows["prev2"], j - 1) + t.SWAP_COST)).otherwise(plain))

            cur = F.aggregate(F.sequence(F.lit(0), F.size(y) - 1), F.array(F.get(rows["prev"], F.lit(0)) + _cost(ca)), cell)
            return F.struct(rows["prev"].alias("prev2"), cur.alias("prev"))

        start = F.struct(first.alias("prev2"), first.alias("prev"))
        full = F.aggregate(F.sequence(F.lit(0), F.size(x) - 1), start, row, lambda r: F.element_at(r["prev"], -1))
        total = lambda z: F.aggregate(z, F.lit(0.0), lambda acc, c: acc + _cost(c))
        return F.when(F.size(x) == 0, total(y)).when(F.size(y) == 0, total(x)).otherwise(full)

    pair = F.struct(characters(a).alias("x"), characters(b).alias("y"))
    return F.element_at(F.transform(F.array(pair), table), 1)


def similarity(a: Column, b: Column) -> Column:
    """Of two spellings, by their keys; 0 if either has none."""
    return F.element_at(F.transform(F.array(F.struct(jamo_key(a).alias("a"), jamo_key(b).alias("b"))), lambda p: key_similarity(p["a"], p["b"])), 1)


def key_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), 0.0).otherwise(1 - weighted_distance(a, b) / longest)


def _letters(strings: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all strings end to end, where each starts, and how long it is."""
    sizes = strings.str.len().to_numpy(dtype=np.int64)
    return np.frombuffer("".join([*strings, "\0"]).encode("utf-32-le"), np.uint32), np.cumsum(sizes) - sizes, sizes


def _block(letters: tuple[np.ndarray, np.ndarray, np.ndarray], own: np.ndarray) -> np.ndarray:
    """A column for each string, filled up with zeros."""
    codes, starts, sizes = letters
    row = np.arange(int(sizes[own].max()))[:, None]
    return np.where(row < sizes[own], codes[np.minimum(starts[own] + row, len(codes) - 1)], np.uint32(0))


def _swapped(x: np.ndarray, y: np.ndarray, i: int) -> np.ndarray:
    """Where letters i - 1 and i of x are two neighbours of y the other way round."""
    return (x[i] == y[:-1]) & (x[i - 1] == y[1:])


def _costs(x: np.ndarray, kind: type) -> np.ndarray:
    """In tenths of a point."""
    return np.where(np.isin(x, np.array([ord(c) for c in t.CHEAP], dtype=np.uint32)), 10 * t.CHEAP_COST, 10).astype(kind)


def _table(x: np.ndarray, y: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    cx, cy = _costs(x, float) / 10, _costs(y, float) / 10
    pairs = np.arange(len(la))
    up2, up = None, np.concatenate((np.zeros((1, len(la))), np.cumsum(cy, axis=0)))
    found = up[lb, pairs]  # for empty a
    for i in range(len(x)):
        cur = np.empty_like(up)
        cur[0] = up[0] + cx[i]
        same, other = x[i] == y, np.minimum(up[1:] + cx[i], up[:-1] + 1.0)
        swap = np.where(_swapped(x, y, i), up2[:-2] + t.SWAP_COST, np.inf) if i else None
        for j in range(len(y)):
            cur[j + 1] = np.where(same[j], up[j], np.minimum(other[j], cur[j] + cy[j]))
            if i and j:
                cur[j + 1] = np.minimum(cur[j + 1], swap[j - 1])
        up2, up = up, cur
        ends = la == i + 1  # each pair's answer stands in the row of its own last letter
        found[ends] = cur[lb[ends], pairs[ends]]
    return found


def _bounds(x: np.ndarray, y: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """At most the distances, in whole tenths: small numbers, and equal letters may also be left out for less."""
    cx, cy = _costs(x, np.int16), _costs(y, np.int16)
    pairs, swap_cost = np.arange(len(la)), np.int16(10 * t.SWAP_COST)
    up2, up = None, np.concatenate((np.zeros((1, len(la)), np.int16), np.cumsum(cy, axis=0, dtype=np.int16)))
    found = up[lb, pairs]
    for i in range(len(x)):
        cur = np.empty_like(up)
        cur[0] = up[0] + cx[i]
        best = np.minimum(up[:-1] + (x[i] != y) * np.int16(10), up[1:] + cx[i])
        if i and len(y) > 1:
            np.minimum(best[1:], up2[:-2] + np.where(_swapped(x, y, i), swap_cost, np.int16(1000)), out=best[1:])
        for j in range(len(y)):
            np.minimum(best[j], cur[j] + cy[j], out=cur[j + 1])
        up2, up = up, cur
        ends = la == i + 1
        found[ends] = cur[lb[ends], pairs[ends]]
    return found


def _in_blocks(table, a: pd.Series, b: pd.Series, size: int) -> np.ndarray:
    """table() over all pairs; pairs of like length are one block, all in step."""
    one, two = _letters(a), _letters(b)
    out = np.zeros(len(a))
    order = np.lexsort((two[2], one[2]))
    for at in range(0, len(order), size):
        own = order[at : at + size]
        out[own] = table(_block(one, own), _block(two, own), one[2][own], two[2][own])
    return out


def distances(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Weighted distances of aligned strings."""
    return _in_blocks(_table, a, b, 4096)


def distances_within(a: pd.Series, b: pd.Series, most: pd.Series) -> np.ndarray:
    """The same where a bound leaves it open whether they are at most `most`; not a number elsewhere."""
    short = np.maximum(a.str.len(), b.str.len()).to_numpy() < 1000  # bounds are 16 bits wide
    alive = np.ones(len(a), bool)
    alive[short] = _in_blocks(_bounds, a[short], b[short], 8192) <= 10 * most[short] + 1e-6
    out = np.full(len(a), np.nan)
    if alive.any():
        out[alive] = distances(a[alive], b[alive])
    return out


@F.pandas_udf(DoubleType())
def weighted_distance_arrow(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(distances(a, b))


@F.pandas_udf(DoubleType())
def weighted_distance_within(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series(distances_within(a, b, most))
