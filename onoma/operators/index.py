"""Search tables of a dictionary: keys, prefixes, words and letter groups as rows, so that lookups are equi-joins.

A dictionary is any table (term_seq long, canonical_id string, type string of one letter, name_ko,
name_en, key_ko, key_en). Prefix rows grow with the summed lengths of keys, not with pairs.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onoma.functions import tables as t
from onoma.functions.text import flat, key_en, jamo_key, token_keys, tokens_en, type_code

#: The token of every key, for queries with too few letters to ask by.
ANY = "*"

TERM = ("term_seq", "canonical_id", "type", "name_ko", "name_en", "key_ko", "key_en")


def heavy_letters(key: Column) -> Column:
    """The letters of a key that no edit gets rid of for less than a whole point, each with which time it stands there."""
    heavy = F.array_sort(F.filter(F.split(key, ""), lambda c: (c != "") & ~c.isin(*t.CHEAP)))
    return F.element_at(F.transform(F.array(heavy), lambda h: F.transform(h, lambda c, i: F.concat(c, (i - F.array_position(h, c) + 2).cast("string")))), 1)


def letter_bits(tokens: str) -> Column:
    """A long with a bit for each of heavy_letters(): bits that a key lacks are letters that it lacks."""
    return F.expr(f"aggregate({tokens}, 0L, (a, x) -> a | shiftleft(1L, pmod(hash(x), 64)))")


def light_counts(key: Column) -> Column:
    """How often each of the light letters stands in a key."""
    return F.array(*(F.length(key) - F.length(F.replace(key, F.lit(c), F.lit(""))) for c in t.CHEAP))


def typo_table(keys: DataFrame) -> DataFrame:
    """keys(key, len, longest) with a row for each heavy letter, and one for ANY: what the typo stage joins.

    longest is the length of the longest name that the key stands for (a head stands for longer ones).
    Keys are dealt to all tasks first: each of their rows meets many queries, so a small table must not be one task.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keys.repartition(parts, "key").withColumn("tokens", heavy_letters(F.col("key"))).withColumns({"bits": letter_bits("tokens"), "light": light_counts(F.col("key"))})
    return rows.withColumn("token", F.explode(F.concat("tokens", F.array(F.lit(ANY)))))


def near_band(length: Column) -> Column:
    """How much longer or shorter than a query of original names a whole name may be."""
    return F.greatest(length * 0.5, F.lit(3.0))


def beyond(length: Column) -> Column:
    """The least length of names that such a query is compared with by their heads."""
    return F.floor(length + near_band(length)) + 1


def _prefixes(word: Column, least: int = 2) -> Column:
    n = F.length(word)
    return F.when(n >= least, F.transform(F.sequence(F.lit(least), n), lambda k: F.substring(word, F.lit(1), k))).otherwise(F.array().cast("array<string>"))


def dictionary(names: DataFrame, order: str, canonical: str = "canonical_id", type_: str = "type", name_ko: str = "name_ko", name_en: str = "name_en") -> DataFrame:
    """A searchable dictionary of any table of names, keys made on the way; a table with both keys keeps them."""
    own = names.select(
        F.col(order).cast("long").alias("term_seq"),
        F.col(canonical).cast("string").alias("canonical_id"),
        type_code(F.col(type_)).alias("type"),
        F.coalesce(F.col(name_ko), F.lit("")).alias("name_ko"),
        F.coalesce(F.col(name_en), F.lit("")).alias("name_en"),
        (F.col("key_ko") if "key_ko" in names.columns else jamo_key(F.col(name_ko))).alias("key_ko"),
        (F.col("key_en") if "key_en" in names.columns else key_en(F.col(name_en))).alias("key_en"),
    )
    return own


@dataclass(frozen=True)
class Index:
    """The tables that lookups join. Build once, cache or write, and use for any number of query batches."""

    terms: DataFrame
    exact_ko: DataFrame
    prefix_ko: DataFrame
    token_ko: DataFrame
    exact_en: DataFrame
    prefix_en: DataFrame
    token_en: DataFrame
    gram_en: DataFrame
    typo_ko: DataFrame
    typo_en: DataFrame

    def tables(self) -> list[DataFrame]:
        return [getattr(self, f.name) for f in fields(self)]

    def cache(self) -> Index:
        for df in self.tables():
            df.cache()
        return self

    def unpersist(self) -> None:
        for df in self.tables():
            df.unpersist()


def build_index(terms: DataFrame) -> Index:
    """Index of a dictionary with the columns TERM."""
    base = terms.select("term_seq", "canonical_id", "type", "name_ko", "name_en", "key_ko", "key_en", F.length("key_ko").alias("ko_len"), F.length("key_en").alias("en_len"), flat(F.col("key_en")).alias("flat_en"))
    base = base.withColumn("flat_len", F.length("flat_en"))
    ko = base.select("term_seq", "canonical_id", "type", "key_ko", "ko_len")
    en = base.filter("flat_en <> ''").select("term_seq", "canonical_id", "type", "name_en", "key_en", "flat_en", "en_len", "flat_len")
    words_ko = base.select("term_seq", "canonical_id", "type", "ko_len", "key_ko", F.explode(token_keys(F.col("name_ko"))).alias("token"))
    words_en = en.select("term_seq", "canonical_id", "type", "en_len", F.explode(tokens_en(F.col("key_en"), F.col("name_en"))).alias("token"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("flat_len") - 2), lambda i: F.substring("flat_en", i, F.lit(3))))
    whole = en.select(F.col("flat_en").alias("key"), F.col("flat_len").alias("len"), F.lit(False).alias("is_head"), F.col("flat_len").alias("longest")).distinct()
    heads = en.select("flat_len", F.explode(F.sequence(F.lit(1), "flat_len")).alias("len"), "flat_en").filter((F.col("len") >= 3) & (F.col("flat_len") >= beyond(F.col("len"))))
    heads = heads.groupBy(F.substring("flat_en", F.lit(1), F.col("len")).alias("key"), "len").agg(F.max("flat_len").alias("longest")).select("key", "len", F.lit(True).alias("is_head"), "longest")
    return Index(
        terms=base,
        exact_ko=ko.withColumnRenamed("key_ko", "key"),
        prefix_ko=ko.select("term_seq", "canonical_id", "type", "ko_len", F.explode(_prefixes(F.col("key_ko"))).alias("key")),
        token_ko=words_ko.select("term_seq", "canonical_id", "type", "ko_len", "key_ko", "token", F.explode(_prefixes(F.col("token"))).alias("key")),
        exact_en=en.select("term_seq", "canonical_id", "type", "en_len", F.col("flat_en").alias("key")),
        prefix_en=en.select("term_seq", "canonical_id", "type", "en_len", "flat_len", F.explode(_prefixes(F.col("flat_en"))).alias("key")),
        token_en=words_en.select("term_seq", "canonical_id", "type", "en_len", "token", F.explode(_prefixes(F.col("token"))).alias("key")),
        gram_en=en.filter("flat_len > 3").select("term_seq", "canonical_id", "type", "en_len", "flat_en", "flat_len", F.explode(grams).alias("gram")),
        typo_ko=typo_table(ko.select(F.col("key_ko").alias("key"), F.col("ko_len").alias("len"), F.col("ko_len").alias("longest")).distinct()),
        typo_en=typo_table(whole.union(heads)),
    )
