"""A training corpus from raw documents: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents; other columns of
docs are not read, whatever their names. An empty table gives an empty one, in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onoma.llm.common import stage, table
from onoma.llm.decontamination import drop_contaminated
from onoma.llm.line_dedup import line_dedup
from onoma.llm.mixing import mix_sources
from onoma.llm.quality import quality_rules
from onoma.llm.simhash import deduplicate

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and the compression bands.

    Null and empty texts have no words, so they go; repeated rows go or stay alike. A very long
    text is judged whole and by all its chunks.
    """
    return quality_rules(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that ten or more share; n_chars follows the text.

    A null text comes out empty. Rows that repeat a doc_id count as one document, and each loses its
    lines; a row without one counts as one. All lines of a very long text are read.
    """
    return line_dedup(docs.select(*COLUMNS)).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id.

    Texts without words are near duplicates of one another. Rows that repeat the doc_id that stays
    all stay, and so do rows without one. All shingles of a very long text count.
    """
    return deduplicate(docs.select(*COLUMNS)).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item.

    Null texts hold none, and items without words are in none. Rows that repeat a doc_id, or have
    none, go together if one of them holds a passage. A very long text is searched to its end.
    """
    return drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document.

    Null and wordless texts have size 0, of which 0 is taken; a null source is a source; repeated
    rows are rows of their own. A very long text counts whole.
    """
    return mix_sources(docs.select(*COLUMNS))


STAGES = [("quality", quality), ("line_dedup", lines), ("simhash", near_duplicates), ("decontamination", decontaminated), ("mixing", mixed)]

#: SQL can't compress a text with zstandard, so the rows are tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
