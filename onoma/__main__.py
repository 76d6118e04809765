"""Command line: python -m onoma build|audit|freeze|hits, on any paths that Spark opens."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from onoma.operators import audit, dictionary, matching
from onoma.operators.edit import ALIAS_FIELDS, ENTRY_FIELDS, FILES
from onoma.operators.index import build_index
from onoma.operators.index import dictionary as searchable
from onoma.sources import seeds
from onoma.sources.staging import staged


def build(spark: SparkSession, source: str, out: str) -> None:
    """Seeds of a folder to the dictionary: terms (CSV), compact records (JSON) and terms.parquet; the hierarchy is copied if there is one."""
    made = seeds.read_seeds(spark, source).build()
    seeds.write_terms(made.terms, f"{out}/terms.parquet")
    terms = spark.read.parquet(f"{out}/terms.parquet")
    seeds.write_csv(terms.orderBy("term_seq"), f"{out}/terms", dictionary.TERM_COLUMNS)
    seeds.write_compact(terms, f"{out}/compact")
    seeds.copy_table(spark, f"{source}/hierarchy.csv", f"{out}/hierarchy")
    dictionary.summarise(terms).orderBy("type").show(truncate=False)
    made.orphans.select("alias_ko", "name_en", "type").show(10, truncate=False)


def check(spark: SparkSession, source: str) -> None:
    issues = audit.audit(seeds.read_terms(spark, source))
    for row in audit.audit_summary(issues).orderBy("category").collect():  # a row for each category
        print(f"[{row.category}] {row.n}", *(f"    {x}" for x in row["first"]), sep="\n")


def freeze(spark: SparkSession, source: str, out: str) -> None:
    terms = seeds.read_terms(spark, source)
    entries, aliases = dictionary.freeze(terms)
    for file, type_ in FILES.items():
        seeds.write_csv(entries.filter(F.col("type") == type_).orderBy("name_en"), f"{out}/{file}.csv", ENTRY_FIELDS)
    seeds.write_csv(aliases, f"{out}/aliases.csv", ALIAS_FIELDS)
    dictionary.freeze_counts(terms).orderBy("what").show(truncate=False)


def hits(spark: SparkSession, source: str, queries: str, th: float) -> None:
    """The first three candidates of each query, and the share of queries that have any; that is no measure of correctness."""
    terms = seeds.read_terms(spark, source)
    batch = seeds.read_queries(spark, queries, th)
    first, rate = matching.hit_rate(batch, matching.scan(batch, build_index(searchable(terms, "term_seq")).cache()))
    named = first.join(terms.select("term_seq", "name_en"), "term_seq").join(batch.select("qid", "text"), "qid")
    named.orderBy("qid", "rank").select("text", "rank", "name_en", F.round("score", 4).alias("score"), "via").show(1000, truncate=False)
    rate.show()


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="onoma", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, places in (("build", ("source", "out")), ("audit", ("source",)), ("freeze", ("source", "out")), ("hits", ("source", "queries"))):
        command = commands.add_parser(name)
        for place in places:
            command.add_argument(place)
    commands.choices["hits"].add_argument("--th", type=float, default=0.85)
    given = vars(parser.parse_args(args))
    run = {"build": build, "audit": check, "freeze": freeze, "hits": hits}[given.pop("command")]
    spark = SparkSession.builder.appName("onoma").getOrCreate()
    with staged(spark):
        run(spark, **given)


if __name__ == "__main__":
    main()
