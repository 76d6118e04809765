"""Helpers shared by the corpus operators: staging, text columns and word classes."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onoma.sources.staging import stage

__all__ = ["stage"]

#: White space of the corpus contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
TOKEN = r"[^\x20\x09-\x0D]+"


def _ascii_class(*spans: tuple[int, int]) -> str:
    """Each character by itself: Java tests such a class by one bit set, and a union of ranges ten times slower."""
    return "".join(f"\\x{i:02X}" for a, b in spans for i in range(a, b + 1))


#: Word separators once A-Z is lower-cased: U+0000-2F, U+003A-60, U+007B-7F; and on raw text, where A-Z are letters.
SEPARATOR = f"[{_ascii_class((0, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))}]+"
RAW_SEPARATOR = f"[{_ascii_class((0, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))}]"
RAW_WORD = f"[^{RAW_SEPARATOR[1:]}+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers find this package where the driver does, if it is not installed for them
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. The built-in lower() gives the same on pure ASCII and is faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Words of lower-cased text; an empty array if it has none."""
    return F.array_remove(F.split(ascii_lower(text), SEPARATOR), "")


def count_words(text: Column) -> Column:
    """Number of words without lower-casing the text."""
    return F.regexp_count(text, F.lit(RAW_WORD)).cast("long")


def python_words(text: str) -> list[str]:
    """The words of words_of(), for model code on the executors and for tests."""
    return [w for w in re.split(SEPARATOR, text.translate(str.maketrans(UPPER, LOWER))) if w]
