"""Benchmark decontamination by winnowing, in DataFrame operations alone.

Of each window of words the least hash of its k-grams is kept, once for all the neighbouring
windows that share it. A document and an item that share a window keep the same hash for it, so
every shared window is found. A place whose hash an item has is extended to the windows
around it, which are compared in full, and these to spans of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onoma.llm.common import count_words, stage, text_or_empty, words_of

#: Distinct benchmark fingerprints in a broadcast (12 bytes each); more of them are joined by a shuffle of fingerprints.
BROADCAST_MARKS = 1_000_000
MARKS = "array<struct<width:int,at:int,mark:bigint>>"


def _grams(hashes: Column, k: int, places: int) -> Column:
    """Hash of each k consecutive entries, whose low bits say where it stands (modulo `places`, a power of two)."""
    gram = lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(k))).bitwiseAND(F.lit(-places)).bitwiseOR((i % places).cast("long"))
    return F.when(F.size(hashes) >= k, F.transform(F.sequence(F.lit(0), F.size(hashes) - k), gram)).otherwise(F.array().cast("array<bigint>"))


def _least(grams: Column, w: int) -> Column:
    """Least of each w consecutive entries."""
    if w == 1:
        return grams
    return F.when(F.size(grams) >= w, F.transform(F.sequence(F.lit(0), F.size(grams) - w), lambda i: F.least(*(F.get(grams, i + j) for j in range(w))))).otherwise(F.array().cast("array<bigint>"))


def _bound(value: Column, body) -> Column:
    """body(value), where value is computed once and not at each use within a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _size(width: int, k: int) -> tuple[int, int, int]:
    """Words of a gram, grams of a window, and a power of two that is not below that."""
    k = min(k, width)
    w = width - k + 1
    return k, w, 1 << (w - 1).bit_length()


def winnowed(words: Column, widths: list[int], k: int = 5) -> Column:
    """(width, at, mark) of the grams that are the least of a window of `width` words, each once: equal windows have one of equal mark."""

    def of(hashes: Column, width: int) -> Column:
        size, w, places = _size(width, k)

        def chosen(least: Column) -> Column:
            # a gram is chosen by a run of windows: its place follows from the low bits, and its first window stands for all
            first = F.filter(F.sequence(F.lit(0), F.size(least) - 1), lambda i: (i == 0) | (F.get(least, i) != F.get(least, i - 1)))
            made = lambda i: F.struct(F.lit(width).alias("width"), (i + F.pmod(F.get(least, i) - i, F.lit(places))).cast("int").alias("at"), F.get(least, i).bitwiseAND(F.lit(-places)).alias("mark"))
            return F.when(F.size(least) > 0, F.transform(first, made)).otherwise(F.array().cast(MARKS))

        return _bound(_grams(hashes, size, places), lambda g: _bound(_least(g, w), chosen))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return _bound(hashes, lambda h: F.concat(*(of(h, width) for width in widths), F.array().cast(MARKS)))


def _windows_around(found: DataFrame, widths: list[int], k: int) -> DataFrame:
    """(doc_id, at, width, window): each window that holds the gram at a place of found(doc_id, words, width, at)."""
    before = F.create_map(*(F.lit(x) for width in widths for x in (width, _size(width, k)[1] - 1)))
    first, last = F.greatest(F.col("at") - F.element_at(before, F.col("width")), F.lit(0)), F.least(F.col("at"), F.size("words") - F.col("width"))
    each = found.select("doc_id", "words", "width", F.explode(F.sequence(first, last)).alias("at"))
    # never null, so no filter on it is inferred, which would run on all places before the join
    return each.select("doc_id", "at", "width", F.coalesce(F.array_join(F.slice("words", F.col("at") + 1, F.col("width")), " "), F.lit("")).alias("window"))


def benchmark_windows(benchmark: DataFrame, width: int = 10) -> DataFrame:
    """(item_id, width, window): each window of each item; the whole of an item that is shorter."""
    words = benchmark.select("item_id", words_of(text_or_empty()).alias("words")).filter(F.size("words") > 0)
    words = words.withColumn("width", F.least(F.size("words"), F.lit(width)))
    each = words.select("item_id", "width", "words", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("width"))).alias("at"))
    return each.select("item_id", "width", F.array_join(F.slice("words", F.col("at") + 1, F.col("width")), " ").alias("window")).distinct()


def window_hits(docs: DataFrame, windows: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, at, width, window): every place of docs(doc_id, text) where a window stands, words counted from 0; places may repeat.

    Texts are read once, for all widths (one, unless there are items below the full width), and
    never shuffled: the fingerprints of each document meet those of the benchmark in a broadcast join.
    A benchmark beyond the bound of a broadcast is joined by a shuffle of the documents' fingerprints,
    and the texts where one is found are read again.
    """
    widths = sorted(r.width for r in windows.select("width").distinct().collect())  # as many as the window width at most
    if not widths:
        return docs.select("doc_id", F.lit(0).alias("at"), F.lit(0).alias("width"), F.lit("").alias("window")).limit(0)
    marks = windows.select(F.explode(F.filter(winnowed(F.split("window", " "), widths, k), lambda m: m["width"] == F.col("width"))).alias("m"))
    marks = stage(marks.select(F.col("m.width").alias("width"), F.col("m.mark").alias("mark")).distinct(), "marks")
    read = docs.select("doc_id", words_of(text_or_empty()).alias("words"))
    if marks.count() <= BROADCAST_MARKS:
        # Hashes are made before the rows are multiplied, so that neither copies the words for each place.
        # The outer form keeps the optimizer from adding a filter that would hash all words once more.
        places = read.select("doc_id", "words", winnowed(F.col("words"), widths, k).alias("m")).select("doc_id", "words", F.explode_outer("m").alias("m"))
        found = places.select("doc_id", "words", "m.*").join(F.broadcast(marks), ["width", "mark"], "left_semi")
    else:
        rid = F.xxhash64("doc_id", text_or_empty()).alias("rid")
        places = docs.select("doc_id", rid, F.explode_outer(winnowed(words_of(text_or_empty()), widths, k)).alias("m")).select("doc_id", "rid", "m.*")
        lists = places.join(marks, ["width", "mark"], "left_semi").groupBy(F.col("doc_id").alias("_d"), F.col("rid").alias("_r")).agg(F.collect_set(F.struct("width", "at")).alias("m"))  # of one text: below its words
        lists = stage(lists, "places")
        met = docs.select("doc_id", "text", rid).join(lists, (F.col("rid") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d")))
        found = met.select("doc_id", words_of(text_or_empty()).alias("words"), "m").select("doc_id", "words", F.explode("m").alias("m")).select("doc_id", "words", "m.*")
    return _windows_around(found, widths, k).join(windows.select("width", "window").distinct(), ["width", "window"], "left_semi").select("doc_id", "at", "width", "window")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, k: int = 5) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs(doc_id, text, ...).

    Null texts and texts without words have no windows, on both sides; an empty benchmark hits
    nothing, an empty table gives no rows. Repeated rows each get the result of their doc_id. Items
    without an id are compared, hit words, and count for no item. Other columns are not read, whatever
    their names. A very long text is one row of the pass, and its hashes 16 bytes a word.
    """
    windows = stage(benchmark_windows(benchmark.select("item_id", "text"), width), "windows")
    hits = stage(window_hits(docs.select("doc_id", "text"), windows, k), "hits")
    spans = hits.select("doc_id", F.explode(F.sequence("at", F.col("at") + F.col("width") - 1)).alias("at")).distinct()
    n_hit = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hit"))
    items = hits.select("doc_id", "width", "window").distinct().join(windows, ["width", "window"]).select("doc_id", F.col("item_id").cast("string").alias("item")).distinct()
    items = items.groupBy(F.col("doc_id").alias("_i")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    of = n_hit.join(items, F.col("doc_id").eqNullSafe(F.col("_i")), "left").select(F.col("doc_id").alias("_d"), "n_hit", "items")
    counts = docs.select("doc_id", count_words(text_or_empty()).alias("n_words"))
    joined = counts.join(of, F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, k: int = 5) -> DataFrame:
    """docs without documents that hold a window of a benchmark item."""
    windows = stage(benchmark_windows(benchmark.select("item_id", "text"), width), "windows")
    hit = stage(window_hits(docs.select("doc_id", "text"), windows, k).select(F.col("doc_id").alias("_hit")).distinct(), "contaminated")
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("_hit")), "left_anti")
