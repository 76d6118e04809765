"""Files of the name engine: seeds, dictionaries and query lists in, dictionaries and seeds out.

Every schema is explicit and all text, so a name like 1865 stays text and words like NA are names.
Readers take any path that Spark opens. Seeds are read in file order, as their order is part of
the result: one file is one split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from onoma.operators.dictionary import TERM_COLUMNS, compact
from onoma.operators.edit import ALIAS_FIELDS, ENTRY_FIELDS, FILES, Seeds
from onoma.sources.staging import stage

BOM = "﻿"


def read_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a header as `columns`, by name, and _seq, the order of its rows; columns it lacks are empty.

    A byte order mark is dropped; empty fields are empty strings.
    """
    raw = spark.read.option("header", True).option("nullValue", "\u0000").option("emptyValue", "").option("escape", "\"").option("inferSchema", False).option("multiLine", True).csv(path)
    names = {c.lstrip(BOM).strip('"'): c for c in raw.columns}
    picked = raw.select(*(F.coalesce(F.col(f"`{names[c]}`"), F.lit("")).alias(c) if c in names else F.lit("").alias(c) for c in columns))
    # a file read whole is one partition, in which these numbers run by row
    return picked.withColumn("_seq", F.monotonically_increasing_id())


def _present(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def empty_table(spark: SparkSession, columns: list[str]) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns) + ", _seq long")


def read_seeds(spark: SparkSession, folder: str, files: tuple[str, ...] = tuple(FILES)) -> Seeds:
    """The seed tables of a folder: the entry files named must be there, the aliases may be missing."""
    for file in files:
        if not _present(spark, f"{folder}/{file}.csv"):
            raise FileNotFoundError(f"{folder}/{file}.csv")
    entries = {f: read_table(spark, f"{folder}/{f}.csv", ENTRY_FIELDS) for f in files}
    path = f"{folder}/aliases.csv"
    aliases = read_table(spark, path, ALIAS_FIELDS) if _present(spark, path) else empty_table(spark, ALIAS_FIELDS)
    return Seeds(entries, aliases)


def seeds_of(entries: DataFrame, aliases: DataFrame) -> Seeds:
    """Seeds in memory: entries(type, ENTRY_FIELDS, _seq) and aliases(ALIAS_FIELDS, _seq)."""
    return Seeds({f: entries.filter(F.col("type") == type_).select(*ENTRY_FIELDS, "_seq") for f, type_ in FILES.items()}, aliases)


def read_terms(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """A dictionary with TERM_COLUMNS and term_seq, of a CSV file or a DataFrame that has them."""
    if isinstance(source, DataFrame):
        return source
    read = read_table(spark, source, TERM_COLUMNS)
    missing = {"canonical_id", "type", "name_ko", "is_alias", "name_en"} - {c.lstrip(BOM) for c in spark.read.option("header", True).csv(source).columns}
    if missing:
        raise AnalysisException(f"{source} lacks {sorted(missing)}")
    return read.withColumns({"is_alias": F.col("is_alias").cast("int"), "key_len": F.col("key_len").cast("int"), "term_seq": F.col("_seq")}).drop("_seq")


def read_compact(spark: SparkSession, path: str) -> DataFrame:
    """Records (_seq, i, t, ko, p, en, d, tr, k, ke) of a JSON array, or of one record a line."""
    schema = ", ".join(f"{c} string" for c in ("i", "t", "ko", "p", "en", "d", "tr", "k", "ke"))
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("_seq", F.monotonically_increasing_id())


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): the lines of a file, or of a folder's files in the order of their paths, and their places from 0.

    Files are read in blocks by many tasks. Lines are written with their block, so that blocks stay as they are; a
    line's place is that in its block and the sizes of the blocks before it. Blocks are few, lines are not moved.
    """
    block = {"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start")}
    # a block is read whole by one task, in which these numbers run by row
    lines = stage(spark.read.text(path).select("value", *(c.alias(k) for k, c in block.items()), F.monotonically_increasing_id().alias("_id")), "lines")
    sizes = lines.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_least"))
    before = Window.partitionBy(F.lit(0)).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    shifts = stage(sizes.select(*block, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_least")).alias("_shift")), "blocks")
    return lines.join(shifts, list(block)).select((F.col("_id") + F.col("_shift")).alias("n"), "value")


def read_queries(spark: SparkSession, path: str, th: float = 0.85, type_: str = "all") -> DataFrame:
    """Queries (qid, text, th, type): one a line, trimmed, blank lines left out; qid is the line's place from 0."""
    lines = read_lines(spark, path)
    return lines.select(F.col("n").alias("qid"), F.trim("value").alias("text"), F.lit(th).alias("th"), F.lit(type_).alias("type")).filter("text <> ''")


def copy_table(spark: SparkSession, source: str, target: str) -> bool:
    """A CSV table as it is, if it is there: for data that the engine only passes on."""
    if not _present(spark, source):
        return False
    spark.read.option("header", True).option("inferSchema", False).csv(source).write.option("header", True).mode("overwrite").csv(target)
    return True


def write_terms(terms: DataFrame, path: str) -> None:
    """The dictionary as Parquet, in its order, for other jobs."""
    terms.orderBy("term_seq").write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str], mark: bool = True) -> None:
    """One CSV file of an ordered table in the folder `path`, with a byte order mark before its header.

    For tables that people edit: they go through one task.
    """
    def quoted(c: str):
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(v.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    rows = df.select(F.concat_ws(",", *(quoted(c) for c in columns)).alias("value"))
    head = df.sparkSession.createDataFrame([((BOM if mark else "") + ",".join(columns),)], "value string")
    head.coalesce(1).union(rows.coalesce(1)).coalesce(1).write.mode("overwrite").text(path)


def write_compact(terms: DataFrame, path: str) -> None:
    """The runtime file: one JSON array in the folder `path`, a record a line, written by one task without holding it."""
    least = terms.agg(F.min("term_seq")).first()[0]
    records = compact(terms.withColumn("_n", F.col("term_seq")), "_n")
    head = F.when(F.col("_n") == least, "[").otherwise(",") if least is not None else F.lit("")
    lines = records.orderBy("_n").select(F.concat(head, F.to_json(F.struct(*(c for c in records.columns if c != "_n")))).alias("value"))
    end = terms.sparkSession.createDataFrame([("]" if least is not None else "[]",)], "value string")
    lines.coalesce(1).union(end.coalesce(1)).coalesce(1).write.mode("overwrite").text(path)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
