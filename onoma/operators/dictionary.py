"""The term dictionary: editable entries and aliases in, one row per entity and spelling out, and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onoma.functions import tables as t
from onoma.functions.text import canonical_name, flat, jamo_key, key_en, name_display, search_key_en, without_ko_prefix
from onoma.sources.staging import numbered

TERM_COLUMNS = ["canonical_id", "type", "name_ko", "name_ko_primary", "is_alias", "name_en", "name_display", "tier", "key_ko", "key_en", "key_len", "region_group", "ko_source", "wikidata"]
ENTRY_COLUMNS = ["type", "name_ko", "name_en", "tier", "region_group", "ko_source", "is_alias", "_seq"]


def _resolved(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """aliases with `target`, the name as the last entry of that type and key spells it, or null."""
    known = entries.groupBy(F.col("type").alias("_t"), search_key_en(F.col("name_en")).alias("_k")).agg(F.max_by("name_en", "_seq").alias("target"))
    wanted = aliases.withColumn("_key", search_key_en(F.col("name_en")))
    return wanted.join(known, (F.col("type") == F.col("_t")) & (F.col("_key") == F.col("_k")), "left").drop("_t", "_k", "_key")


def resolve_aliases(entries: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Aliases(alias_ko, name_en, type, _seq) as rows like entries, and the orphans, which name no entry."""
    met = _resolved(entries, aliases)
    rows = met.filter("target is not null").select("type", F.col("alias_ko").alias("name_ko"), F.col("target").alias("name_en"), F.lit("").alias("tier"), F.lit("").alias("region_group"), F.lit("alias").alias("ko_source"), F.lit(1).alias("is_alias"), "_seq")
    return rows, met.filter("target is null").select("alias_ko", "name_en", "type", "_seq")


def add_stripped(rows: DataFrame, after: Column) -> DataFrame:
    """rows and, behind them, the producers' names without a generic first word, one level deep."""
    short = rows.filter("type = 'producer'").withColumn("_rest", without_ko_prefix(F.col("name_ko"))).filter("_rest is not null")
    short = short.withColumns({"name_ko": F.col("_rest"), "ko_source": F.lit("stripped"), "is_alias": F.lit(1), "_seq": F.col("_seq") + after}).drop("_rest")
    return rows.unionByName(short.select(*rows.columns))


def assign_canonical(rows: DataFrame) -> DataFrame:
    """rows with canonical_id: one of each type and original name without blanks, numbered by first appearance.

    Numbers are given to distinct entities, in ranges; rows without an original name go by their own key.
    """
    key = flat(search_key_en(F.col("name_en")))
    keyed = rows.withColumn("_ken", F.when(key == "", F.concat(F.lit("ko:"), jamo_key(F.col("name_ko")))).otherwise(key))
    ids = keyed.groupBy(F.col("type").alias("_t"), F.col("_ken").alias("_k")).agg(F.min("_seq").alias("_first"))
    ids = numbered(ids, "_number", "_first").withColumn("canonical_id", canonical_name(F.col("_t"), F.col("_number"))).drop("_number")
    return keyed.join(ids, (F.col("type") == F.col("_t")) & (F.col("_ken") == F.col("_k"))).drop("_t", "_k", "_ken", "_first")


def elect_primary(rows: DataFrame) -> DataFrame:
    """rows with name_ko_primary and `_place`, their order in the election: no alias first, then trusted sources, then short names."""
    priority = F.lit(t.OTHER_PRIORITY)
    for source, p in t.SOURCE_PRIORITY.items():
        priority = F.when(F.col("ko_source") == source, p).otherwise(priority)
    own = Window.partitionBy("canonical_id").orderBy("is_alias", priority, F.length("name_ko"), "_seq")
    placed = rows.withColumn("_place", F.row_number().over(own))
    placed = placed.withColumn("name_ko_primary", F.first("name_ko").over(own))
    return placed.withColumn("is_alias", (F.col("name_ko") != F.col("name_ko_primary")).cast("int"))


def distinct_spellings(rows: DataFrame) -> DataFrame:
    """The first row, in election order, of each entity and spelling."""
    own = Window.partitionBy("canonical_id", "name_ko").orderBy("_place")
    return rows.withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n")


@dataclass(frozen=True)
class Dictionary:
    """terms has TERM_COLUMNS and term_seq, its order."""

    terms: DataFrame
    orphans: DataFrame

    def ordered(self) -> DataFrame:
        return self.terms.orderBy("term_seq").select(*TERM_COLUMNS)

    def summary(self) -> DataFrame:
        return summarise(self.terms)


def summarise(terms: DataFrame) -> DataFrame:
    """(type, n_rows, n_canonical) of each type, and over all of them."""
    counts = [F.count(F.lit(1)).alias("n_rows"), F.countDistinct("canonical_id").alias("n_canonical")]
    return terms.rollup("type").agg(*counts).select(F.coalesce("type", F.lit("all")).alias("type"), "n_rows", "n_canonical")


def build(entries: DataFrame, aliases: DataFrame) -> Dictionary:
    """The dictionary of entries(ENTRY_COLUMNS) and aliases(alias_ko, name_en, type, _seq).

    Orders that the result depends on are in _seq: places of rows in the seeds, types in turn. Rows
    of one entity meet in one window; entities are small whatever the size of the dictionary.
    """
    found, orphans = resolve_aliases(entries, aliases)
    step = F.lit(1 << 40)
    rows = entries.select(*ENTRY_COLUMNS).unionByName(found.withColumn("_seq", F.col("_seq") + step).select(*ENTRY_COLUMNS))
    rows = assign_canonical(add_stripped(rows, F.lit(1 << 41)))
    rows = distinct_spellings(elect_primary(rows))
    rows = rows.withColumns({
        "name_display": name_display(F.col("name_en")),
        "key_ko": jamo_key(F.col("name_ko")),
        "key_en": key_en(F.col("name_en")),
        "wikidata": F.lit(""),
    })
    rows = rows.filter("key_ko <> ''").withColumn("key_len", F.length("key_ko"))
    rows = numbered(rows, "term_seq", "type", "name_ko_primary", "is_alias", "canonical_id", "_place")
    return Dictionary(rows.select("term_seq", *TERM_COLUMNS), orphans)


#: Fields of the runtime records, and what they hold.
RECORD = {"i": "canonical_id", "t": "substring(type, 1, 1)", "ko": "name_ko", "p": "name_ko_primary", "en": "name_en", "d": "name_display", "tr": "tier", "k": "key_ko", "ke": "key_en"}


def compact(terms: DataFrame, *more: str) -> DataFrame:
    """The records of the runtime file: short names, one-letter types; and the columns `more`."""
    return terms.select(*more, *(F.expr(x).alias(c) for c, x in RECORD.items()))


def from_compact(records: DataFrame) -> DataFrame:
    """A searchable dictionary of compact records(_seq, i, t, ko, p, en, d, tr, k, ke)."""
    return records.select(F.col("_seq").alias("term_seq"), F.col("i").alias("canonical_id"), F.col("t").alias("type"), F.col("ko").alias("name_ko"), F.col("en").alias("name_en"), F.col("k").alias("key_ko"), F.col("ke").alias("key_en"))


def freeze(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Back to seeds: entries(type, name_en, name_ko, tier, region_group, ko_source, note) and aliases(alias_ko, name_en, type, note).

    One entry per entity, from its primary rows; spellings that the build makes by itself are left out.
    """
    own = Window.partitionBy("type", "canonical_id").orderBy("term_seq")
    entries = terms.filter("is_alias = 0").withColumn("_n", F.row_number().over(own)).filter((F.col("_n") == 1) & (F.trim("name_en") != ""))
    entries = entries.select("type", "name_en", "name_ko", "tier", "region_group", "ko_source", F.lit("").alias("note"))
    aliases = terms.filter("is_alias = 1 and ko_source <> 'stripped'").select(F.col("name_ko").alias("alias_ko"), "name_en", "type", F.lit("").alias("note")).distinct()
    return entries.orderBy("type", "name_en"), aliases.orderBy("type", "name_en", "alias_ko")


def freeze_counts(terms: DataFrame) -> DataFrame:
    """(what, n): entries by type, aliases, and generated spellings that freeze leaves out."""
    entries, aliases = freeze(terms)
    made = terms.filter("ko_source = 'stripped'").agg(F.lit("stripped").alias("what"), F.count(F.lit(1)).alias("n"))
    return entries.groupBy(F.col("type").alias("what")).agg(F.count(F.lit(1)).alias("n")).union(aliases.agg(F.lit("aliases").alias("what"), F.count(F.lit(1)).alias("n"))).union(made)
