"""Names, dictionaries and queries made of the driver tables, in Spark and in SQL alike.

The tables hold few distinct names and no Hangul, so Korean spellings are made of integer keys.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onoma.functions.text import jamo_key, key_en
from onoma.operators.edit import ENTRY_FIELDS
from onoma.sources.staging import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers find this package where the driver does, if it is not installed for them
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def syllable(number: Column) -> Column:
    """A Hangul syllable by number."""
    code = F.lit(44032) + F.pmod(number, F.lit(11172))
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _word(key: Column, *terms: tuple[int, int]) -> Column:
    return F.concat(*(syllable(key * a + b) for a, b in terms))


FIRST, SECOND = ((7919, 3), (104729, 11)), ((15485, 5), (31, 2), (7, 4321))


def _word_sql(key: str, terms: tuple[tuple[int, int], ...]) -> str:
    return " || ".join(f"chr((44032 + ({key} * {a} + {b}) % 11172)::INT)" for a, b in terms)


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term_seq, canonical_id, type, name_ko, name_en, w1, w2, rn): distinct names of parts and their kinds; kinds of a name are one entity."""
    part = table(spark, sf_dir, "part")
    by = part.groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("term_seq"))
    entity = part.groupBy(F.col("p_name").alias("_p")).agg(F.min("p_partkey").alias("_c"))
    own = by.join(entity, F.col("p_name") == F.col("_p"))
    w1, w2 = _word(F.col("_c"), *FIRST), _word(F.col("term_seq"), *SECOND)
    named = own.select(
        "term_seq",
        F.concat(F.lit("c"), F.col("_c").cast("string")).alias("canonical_id"),
        F.substring(F.lit("grp"), (F.col("_c") % 3 + 1).cast("int"), F.lit(1)).alias("type"),
        F.concat(w1, F.lit(" "), w2).alias("name_ko"),
        F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("name_en"),
        w1.alias("w1"),
        w2.alias("w2"),
    )
    return _from_zero(named)


def _from_zero(named: DataFrame) -> DataFrame:
    """named with rn, its place by term_seq from 0."""
    return numbered(named, "rn", "term_seq").withColumn("rn", F.col("rn") - 1)


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of names(), a name of its own for every part: two made words in each script, one of them shared by some."""
    key = F.col("p_partkey").cast("long")

    def made(number: Column) -> Column:
        return F.translate(F.conv(F.pmod(number, F.lit(3_200_000)).cast("string"), 10, 20), "0123456789ABCDEFGHIJ", "aeioulnrstmdkbvpgczh")

    w1, w2 = _word(key % 997, *FIRST), _word(key, *SECOND)
    english = F.concat(F.initcap(made(key % 997 * 48271 + 160_000)), F.lit(" "), F.initcap(made(key * 1_047_27 + 400_009)), F.lit(" "), F.split("p_name", " ")[1])
    return _from_zero(table(spark, sf_dir, "part").select(key.alias("term_seq"), F.concat(F.lit("c"), key.cast("string")).alias("canonical_id"), F.substring(F.lit("grp"), (key % 3 + 1).cast("int"), F.lit(1)).alias("type"), F.concat(w1, F.lit(" "), w2).alias("name_ko"), english.alias("name_en"), w1.alias("w1"), w2.alias("w2")))


NAMES = f"""names AS (
  SELECT term_seq, 'c' || c AS canonical_id, substr('grp', (c % 3 + 1)::INT, 1) AS type, w1 || ' ' || w2 AS name_ko, name_en, w1, w2, row_number() OVER (ORDER BY term_seq) - 1 AS rn
  FROM (SELECT term_seq, c, {_word_sql("c", FIRST)} AS w1, {_word_sql("term_seq", SECOND)} AS w2, p_name || ' ' || lower(p_type) AS name_en
        FROM (SELECT p_name, p_type, min(p_partkey) AS term_seq FROM part GROUP BY ALL) JOIN (SELECT p_name, min(p_partkey) AS c FROM part GROUP BY ALL) USING (p_name)))"""


def dictionary_of(named: DataFrame) -> DataFrame:
    return named.select("term_seq", "canonical_id", "type", "name_ko", "name_en", jamo_key(F.col("name_ko")).alias("key_ko"), key_en(F.col("name_en")).alias("key_en"))


#: Kinds of queries by key: original names in full, cut, misspelt; Korean spellings likewise.
_EN = ("upper(name_en)", "substr(name_en, 1, 5)", "reverse(substr(reverse(name_en), 1, 5))", "substr(replace(name_en, ' ', ''), 3, 6)", "substr(name_en, 1, 2) || substr(name_en, 4)", "'Chateau ' || name_en")
_KO = ("name_ko", "w2", "w1", "w1 || w2", "w1 || ' ' || substr(w2, 1, 2)", "'가나 ' || w1 || ' ' || w2 || ' 다라'", "substr(w2, 1, 2)", "substr(w1, 2, 1) || substr(w1, 1, 1) || ' ' || w2")

_ALL = (*_EN, *_KO, "'ㄴㅡㅁㅣㅣ'", "'갣 ' || substr(name_en, 1, 1)", "'  '")


def queries(spark: SparkSession, sf_dir: str, source: str, key: str, kind: str, named: DataFrame | None = None) -> DataFrame:
    """(qid, text, th, type): a query for each row of a table, about a name (of names() if not given) that its key picks."""
    named = names(spark, sf_dir) if named is None else named
    n = named.count()
    rows = table(spark, sf_dir, source).select(F.col(key).cast("long").alias("qid")).withColumn("_rn", F.pmod(F.col("qid") * 5, F.lit(n)))
    met = rows.join(named, F.col("_rn") == F.col("rn"))
    forms = {"en": _EN, "ko": _KO, "all": _ALL}[kind]
    text = F.expr("CASE " + " ".join(f"WHEN pmod(qid, {len(forms)}) = {i} THEN {x}" for i, x in enumerate(forms)) + " END")
    th = F.expr("CASE pmod(qid, 3) WHEN 0 THEN 0.8D WHEN 1 THEN 0.85D ELSE 0.7D END")
    return met.select("qid", text.alias("text"), th.alias("th"), F.expr("CASE WHEN pmod(qid, 4) = 0 THEN type ELSE 'all' END").alias("type"))


def queries_sql(source: str, key: str, kind: str) -> str:
    forms = {"en": _EN, "ko": _KO, "all": _ALL}[kind]
    text = "CASE " + " ".join(f"WHEN qid % {len(forms)} = {i} THEN {x}" for i, x in enumerate(forms)) + " END"
    return f"""queries AS (
  SELECT qid, {text} AS text, CASE qid % 3 WHEN 0 THEN 0.8::DOUBLE WHEN 1 THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END AS th, CASE WHEN qid % 4 = 0 THEN type ELSE 'all' END AS type
  FROM (SELECT {key}::BIGINT AS qid, ({key} * 5) % (SELECT count(*) FROM names) AS _rn FROM {source}) JOIN names ON _rn = rn)"""


_ENTRY = {
    "type": "CASE p_size % 3 WHEN 0 THEN 'grape' WHEN 1 THEN 'region' ELSE 'producer' END",
    "name_en": "CASE WHEN p_partkey % 5 = 0 THEN 'Domaine ' ELSE '' END || p_name || CASE WHEN p_partkey % 7 = 0 THEN ' DOC' ELSE '' END || ' ' || replace(p_brand, 'Brand#', '')",
    "ko_source": "CASE p_partkey % 5 WHEN 0 THEN 'wikidata' WHEN 1 THEN 'manual' WHEN 2 THEN 'added' WHEN 3 THEN 'auto' ELSE 'other' END",
}


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as dictionary entries (type, name_ko, name_en, tier, region_group, ko_source, is_alias, _seq)."""
    part = table(spark, sf_dir, "part").withColumns({k: F.expr(v) for k, v in _ENTRY.items()})
    key = F.col("p_partkey") % 97
    ko = F.concat(F.when(F.col("p_partkey") % 4 == 0, "샤토 ").otherwise(""), _word(key, *FIRST), F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(""), _word(F.col("p_partkey") % 89, *SECOND))
    return part.select("type", ko.alias("name_ko"), "name_en", F.lit("").alias("tier"), F.col("p_brand").alias("region_group"), "ko_source", F.lit(0).alias("is_alias"), F.col("p_partkey").cast("long").alias("_seq"))


ENTRIES = f"""entries AS (
  SELECT {_ENTRY["type"]} AS type, CASE WHEN p_partkey % 4 = 0 THEN '샤토 ' ELSE '' END || {_word_sql("(p_partkey % 97)", FIRST)} || CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE '' END || {_word_sql("(p_partkey % 89)", SECOND)} AS name_ko,
         {_ENTRY["name_en"]} AS name_en, '' AS tier, p_brand AS region_group, {_ENTRY["ko_source"]} AS ko_source, 0 AS is_alias, p_partkey::BIGINT AS _seq FROM part)"""


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(alias_ko, name_en, type, _seq): a customer's key names the part it is an alias of; one in seven names nothing."""
    own = entries(spark, sf_dir).withColumnRenamed("_seq", "_key")
    met = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("_seq")).join(own, F.col("_seq") == F.col("_key"))
    name = F.when(F.col("_seq") % 7 == 0, F.concat(F.lit("Nobody "), F.col("_seq").cast("string"))).otherwise(F.upper("name_en"))
    return met.select(_word(F.col("_seq"), *SECOND).alias("alias_ko"), name.alias("name_en"), "type", "_seq")


ALIASES = f"""aliases AS (
  SELECT {_word_sql("c_custkey", SECOND)} AS alias_ko, CASE WHEN c_custkey % 7 = 0 THEN 'Nobody ' || c_custkey ELSE upper(name_en) END AS name_en, type, c_custkey::BIGINT AS _seq
  FROM customer JOIN entries ON c_custkey = _seq)"""


def supplier_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as seed rows, for edits."""
    rows = table(spark, sf_dir, "supplier")
    named = {"name_en": F.col("s_name"), "name_ko": _word(F.col("s_suppkey"), *FIRST), "tier": F.lit(""), "region_group": F.col("s_nationkey").cast("string"), "ko_source": F.lit("manual"), "note": F.lit("")}
    return rows.select(*(named[c].alias(c) for c in ENTRY_FIELDS), F.col("s_suppkey").cast("long").alias("_seq"))


def supplier_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes, one for each nation: a new row, a row replaced, one of a key that another name has, one without Hangul."""
    n = table(spark, sf_dir, "nation")
    key = F.lpad((F.col("n_nationkey") * 3).cast("string"), 9, "0")
    name = F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("New "), F.col("n_name"))).when(F.col("n_nationkey") % 4 == 1, F.concat(F.lit("Supplier#"), key)).when(F.col("n_nationkey") % 4 == 2, F.concat(F.lit("SUPPLIER "), key)).otherwise(F.col("n_name"))
    ko = F.when(F.col("n_nationkey") % 4 == 3, F.lit("none")).otherwise(_word(F.col("n_nationkey"), *SECOND))
    named = {"name_en": name, "name_ko": ko, "tier": F.lit(None).cast("string"), "region_group": F.lit(" x "), "ko_source": F.lit("added"), "note": F.concat(F.col("n_name"), F.lit(" "))}
    return n.select(*(named[c].alias(c) for c in ENTRY_FIELDS), F.col("n_nationkey").cast("long").alias("_seq"))


EDITS = f"""seeds AS (SELECT s_name AS name_en, {_word_sql("s_suppkey", FIRST)} AS name_ko, '' AS tier, s_nationkey::VARCHAR AS region_group, 'manual' AS ko_source, '' AS note, s_suppkey::BIGINT AS _seq FROM supplier),
changes AS (SELECT CASE n_nationkey % 4 WHEN 0 THEN 'New ' || n_name WHEN 1 THEN 'Supplier#' || lpad((n_nationkey * 3)::VARCHAR, 9, '0') WHEN 2 THEN 'SUPPLIER ' || lpad((n_nationkey * 3)::VARCHAR, 9, '0') ELSE n_name END AS name_en,
  CASE WHEN n_nationkey % 4 = 3 THEN 'none' ELSE {_word_sql("n_nationkey", SECOND)} END AS name_ko, '' AS tier, 'x' AS region_group, 'added' AS ko_source, n_name AS note, n_nationkey::BIGINT AS _seq FROM nation)"""


def nation_changes(spark: SparkSession, sf_dir: str) -> list[tuple[str, str, str]]:
    """(name_en, name_ko, name of the row replaced or '') of a list of changes that is made by hand: one for each nation, in order."""
    n = table(spark, sf_dir, "nation")
    old = F.when((F.col("n_nationkey") % 2 == 1) & (F.col("n_nationkey") < 20), F.concat(F.lit("Supplier#"), F.lpad(F.floor(F.col("n_nationkey") / 2).cast("string"), 9, "0"))).otherwise("")
    rows = n.select("n_nationkey", F.concat(F.lit(" House of "), F.initcap("n_name")).alias("name_en"), _word(F.col("n_nationkey"), *SECOND).alias("name_ko"), old.alias("old")).collect()  # nations are 25
    return [(r.name_en, r.name_ko, r.old) for r in sorted(rows, key=lambda r: r.n_nationkey)]


BATCH = f"""seeds AS (SELECT s_name AS name_en, {_word_sql("s_suppkey", FIRST)} AS name_ko, s_suppkey::BIGINT AS _seq FROM supplier),
asked AS (SELECT n_nationkey AS k, 'House of ' || array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name_en, {_word_sql("n_nationkey", SECOND)} AS name_ko,
  CASE WHEN n_nationkey % 2 = 1 AND n_nationkey < 20 THEN 'Supplier#' || lpad((n_nationkey // 2)::VARCHAR, 9, '0') ELSE '' END AS old FROM nation)"""
