"""Integrity checks of a dictionary, and what a change adds to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onoma.functions import tables as t
from onoma.functions.text import audit_words_en, audit_words_ko, has_syllables, text
from onoma.sources.staging import stage

SHOWN_NAMES = 4


def _list(values: Column) -> Column:
    """Strings as a printed list."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", "), F.lit("]"))


def _issue(category: Column | str, *detail: Column | str) -> list[Column]:
    parts = [F.lit(x) if isinstance(x, str) else x for x in detail]
    return [(F.lit(category) if isinstance(category, str) else category).alias("category"), F.concat(*parts).alias("detail")]


def truncated_originals(terms: DataFrame) -> DataFrame:
    """Primary spellings of more words than an original of one or two: part of it may be lost."""
    n_ko, n_en = F.size(audit_words_ko(F.col("name_ko"))), F.size(audit_words_en(F.col("name_en")))
    found = terms.filter("is_alias = 0").withColumns({"_ko": n_ko, "_en": n_en}).filter("_ko > 0 and _en between 1 and 2 and _ko - _en >= 1")
    return found.select(*_issue(t.TRUNCATED, text(F.col("name_ko")), "  ->  ", text(F.col("name_en")), "   [", F.col("type"), "]"))


def type_overlaps(terms: DataFrame) -> DataFrame:
    """Originals of more than one type; with producers among them, likely an error."""
    found = terms.groupBy(text(F.col("name_en")).alias("name_en")).agg(F.array_sort(F.collect_set("type")).alias("types")).filter(F.size("types") > 1)
    kind = F.when(F.array_contains("types", "producer"), t.TYPES_ERROR).otherwise(t.TYPES_CHECK)
    return found.select(*_issue(kind, F.col("name_en"), ": ", _list(F.col("types"))))


def spellings_without_hangul(terms: DataFrame) -> DataFrame:
    ko = text(F.col("name_ko"))
    return terms.filter((ko != "") & ~has_syllables(ko)).select(*_issue(t.NO_HANGUL, ko, " [", F.col("type"), "]"))


def wrong_originals(terms: DataFrame) -> DataFrame:
    """Originals that are blank, or have Hangul in them."""
    ko, en = text(F.col("name_ko")), text(F.col("name_en"))
    blank = F.trim(en) == ""
    found = terms.filter(blank | has_syllables(en))
    return found.select(F.when(blank, t.NO_ORIGINAL).otherwise(t.MIXED_ORIGINAL).alias("category"), F.when(blank, F.concat(ko, F.lit(" ["), F.col("type"), F.lit("]"))).otherwise(F.concat(ko, F.lit(" -> "), en)).alias("detail"))


def homonyms(terms: DataFrame) -> DataFrame:
    """Spellings of several originals and several entities, with the first originals.

    Whether there are several is told by the least and the greatest; only the few names that are shown
    are ever listed, however many originals a spelling has.
    """
    rows = terms.select(text(F.col("name_ko")).alias("name_ko"), text(F.col("name_en")).alias("name_en"), "canonical_id")
    several = rows.groupBy(F.col("name_ko").alias("_ko")).agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("name_en", "canonical_id") for f in (F.min, F.max)))
    several = several.filter("min_name_en <> max_name_en and min_canonical_id <> max_canonical_id").select("_ko")
    names = rows.select("name_ko", "name_en").distinct().join(several, F.col("name_ko") == F.col("_ko"), "left_semi")
    first = names.withColumn("_n", F.row_number().over(Window.partitionBy("name_ko").orderBy("name_en"))).filter(F.col("_n") <= SHOWN_NAMES)
    shown = first.groupBy("name_ko").agg(F.array_sort(F.collect_list("name_en")).alias("names"))
    return shown.select(*_issue(t.HOMONYM, F.col("name_ko"), ": ", _list(F.col("names"))))


def audit(terms: DataFrame) -> DataFrame:
    """(category, detail), a row for each issue; rows that repeat in the dictionary repeat here.

    Five checks read the dictionary, so what makes it is run once and written.
    """
    terms = stage(terms.select("canonical_id", "type", "is_alias", "name_ko", "name_en"), "terms")
    return reduce(DataFrame.union, (f(terms) for f in (truncated_originals, type_overlaps, spellings_without_hangul, wrong_originals, homonyms)))


def audit_summary(issues: DataFrame, shown: int = 15) -> DataFrame:
    """(category, n, first): how many of each, and the first details in order, as a report shows them.

    Counts are partially aggregated, and each task hands on no more than `shown` details of a category.
    """
    issues = stage(issues, "issues")
    counts = issues.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    ranked = issues.withColumn("_n", F.row_number().over(Window.partitionBy("category").orderBy("detail"))).filter(F.col("_n") <= shown)
    first = ranked.groupBy(F.col("category").alias("_c")).agg(F.array_sort(F.collect_list("detail")).alias("first"))
    return counts.join(first, F.col("category") == F.col("_c")).select("category", "n", "first")


def new_issues(before: DataFrame, after: DataFrame) -> DataFrame:
    """Issues of `after` whose line is not among those of `before`; repeated lines stay repeated."""
    return after.join(before.select("category", "detail").distinct(), ["category", "detail"], "left_anti")


def issue_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(new_issue_count, baseline_issue_count)."""
    new = new_issues(before, after).select(F.lit(1).alias("n"), F.lit(0).alias("b"))
    return new.union(before.select(F.lit(0), F.lit(1))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("new_issue_count"), F.coalesce(F.sum("b"), F.lit(0)).alias("baseline_issue_count"))
