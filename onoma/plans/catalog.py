"""Queries of the name engine over the driver tables, with the SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onoma.functions import distance, text
from onoma.functions import tables as t
from onoma.operators import audit as checks
from onoma.operators import dictionary as build
from onoma.operators import edit, matching
from onoma.operators.index import build_index
from onoma.plans import sql as s
from onoma.plans import tables as d
from onoma.sources import seeds as files
from onoma.sources.staging import numbered, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# ---- scalar functions ----


@query(f"SELECT doc_id, {s.search_key('text')} AS key_en FROM documents")
def norm_key_en(spark, sf):
    """F5 on whole documents."""
    return d.table(spark, sf, "documents").select("doc_id", text.search_key_en(F.col("text")).alias("key_en"))


_HONORED = "CASE p_partkey % 6 WHEN 0 THEN 'Château ' WHEN 1 THEN 'CHATEAU ' WHEN 2 THEN 'dom. ' WHEN 3 THEN 'Dom ' WHEN 4 THEN 'Marques  de ' ELSE 'bodegas' END || p_name"


@query(f"SELECT p_partkey, {s.key_en(f'({_HONORED})')} AS key_en, trim({s.no_honorific(f'({_HONORED})')}) AS rest FROM part")
def prefix_strip_key(spark, sf):
    """the honorific goes before accents do."""
    named = d.table(spark, sf, "part").select("p_partkey", F.expr(_HONORED).alias("x"))
    return named.select("p_partkey", text.key_en(F.col("x")).alias("key_en"), text.trimmed(text.without_en_prefix(F.col("x"))).alias("rest"))


_TIERED = "p_name || CASE p_partkey % 5 WHEN 0 THEN ' DOCG' WHEN 1 THEN '  doc 5' WHEN 2 THEN ' DOCX' WHEN 3 THEN ' do Noval AOC' ELSE '-VDP' END"


@query(f"SELECT p_partkey, {s.display(f'({_TIERED})')} AS name_display FROM part")
def tier_display(spark, sf):
    """F8."""
    return d.table(spark, sf, "part").select("p_partkey", text.name_display(F.expr(_TIERED)).alias("name_display"))


@query(f"WITH {d.ENTRIES} SELECT _seq AS p_partkey, {s.jamo('name_ko')} AS key_ko, length({s.jamo('name_ko')})::INT AS key_len FROM entries")
def jamo_keys(spark, sf):
    """F1, F2, F9."""
    key = text.jamo_key(F.col("name_ko"))
    return d.entries(spark, sf).select(F.col("_seq").alias("p_partkey"), key.alias("key_ko"), text.key_length(key).alias("key_len"))


_TYPED_IN = "CASE n % 3 WHEN 0 THEN name_ko WHEN 1 THEN name_ko || ' 5a' ELSE name_ko || '!' END"


@query(f"WITH {d.ENTRIES} SELECT _seq AS p_partkey, {s.typed('x')} AS typed FROM (SELECT _seq, {_TYPED_IN.replace('n %', '_seq %')} AS x FROM entries)")
def qwerty_recover(spark, sf):
    """F10."""
    return d.entries(spark, sf).select(F.col("_seq").alias("p_partkey"), text.hangul_to_qwerty(F.expr(_TYPED_IN.replace("n %", "_seq %"))).alias("typed"))


@query(
    f"WITH {d.ENTRIES} SELECT src, id, regexp_matches(x, '[가-힣ㄱ-ㅎㅏ-ㅣ]') AS has_hangul, regexp_matches(x, '[A-Za-z]') AS has_latin, regexp_matches(x, '[가-힣]') AS has_syllables FROM "
    "(SELECT 'document' AS src, doc_id AS id, coalesce(text, '') AS x FROM documents UNION ALL SELECT 'spelling', _seq, CASE WHEN _seq % 3 = 0 THEN 'ㅂ' WHEN _seq % 3 = 1 THEN name_ko ELSE name_ko || ' abc' END FROM entries)"
)
def script_route(spark, sf):
    """F11, F14 on whole documents and on spellings."""
    docs = d.table(spark, sf, "documents").select(F.lit("document").alias("src"), F.col("doc_id").alias("id"), text.text(F.col("text")).alias("x"))
    spelled = F.expr("CASE WHEN _seq % 3 = 0 THEN 'ㅂ' WHEN _seq % 3 = 1 THEN name_ko ELSE name_ko || ' abc' END")
    both = docs.union(d.entries(spark, sf).select(F.lit("spelling"), "_seq", spelled))
    return both.select("src", "id", text.has_hangul(F.col("x")).alias("has_hangul"), text.has_latin(F.col("x")).alias("has_latin"), text.has_syllables(F.col("x")).alias("has_syllables"))


@query(
    f"WITH {d.ENTRIES} SELECT _seq, array_to_string({s.tokens('name_ko')}, '|') AS words, CASE WHEN len({s.tokens('name_ko')}) >= 2 THEN array_to_string(list_filter(list_transform({s.tokens('name_ko')}, lambda w: {s.jamo('w')}), lambda k: length(k) >= 2), '|') ELSE '' END AS word_keys, "
    f"regexp_replace({s.key_en('name_en')}, ' ', '|', 'g') AS en_words FROM entries"
)
def tokens(spark, sf):
    """F12."""
    return d.entries(spark, sf).select("_seq", F.array_join(text.tokens_ko(F.col("name_ko")), "|").alias("words"), F.array_join(text.token_keys(F.col("name_ko")), "|").alias("word_keys"), F.array_join(F.split(text.key_en(F.col("name_en")), " "), "|").alias("en_words"))


_COMPAT = [(c, t.compatible(c)) for c in t.conjoining() if t.compatible(c) != c]


@query(f"WITH {d.ENTRIES} SELECT _seq, translate({s.jamo('name_ko')}, '{''.join(a for a, _ in _COMPAT)}', '{''.join(b for _, b in _COMPAT)}') AS letters FROM entries")
def compatibility_letters(spark, sf):
    """F10a on keys, which are conjoining jamo."""
    return d.entries(spark, sf).select("_seq", text.compatibility_jamo(text.jamo_key(F.col("name_ko"))).alias("letters"))


_PARTS = f"list_distinct(list_concat(list_filter(string_split({s.key_en('x')}, ' '), lambda w: w <> ''), list_filter(string_split_regex(lower(strip_accents(x)), '[^a-z0-9]+'), lambda w: length(w) >= 3)))"


@query(f"SELECT p_partkey, array_to_string(list_sort({_PARTS}), '|') AS words FROM (SELECT p_partkey, {_HONORED} AS x FROM part)")
def english_tokens(spark, sf):
    """Words of keys, and of names as written, honorifics too."""
    named = d.table(spark, sf, "part").select("p_partkey", F.expr(_HONORED).alias("x"))
    return named.select("p_partkey", F.array_join(F.array_sort(text.tokens_en(text.key_en(F.col("x")), F.col("x"))), "|").alias("words"))


def _stopped(x: str, words: tuple[str, ...], least: int) -> str:
    return f"list_filter({x}, lambda w: length(w) >= {least} AND NOT list_contains({s._list(list(words))}, w))"


_KO_WORDS = _stopped("string_split_regex(x, '\\s+')", t.KO_STOP, 1)
_EN_WORDS = _stopped("string_split_regex(regexp_replace(lower(strip_accents(y)), '[^a-z0-9 ]+', ' ', 'g'), ' +')", t.EN_STOP, 2)
_SAID = "CASE WHEN _seq % 2 = 0 THEN replace(name_ko, ' ', ' 드 ') ELSE '라 ' || name_ko END"


@query(f"WITH {d.ENTRIES} SELECT _seq, array_to_string({_KO_WORDS}, '|') AS ko_words, array_to_string({_EN_WORDS}, '|') AS en_words FROM (SELECT _seq, {_SAID} AS x, 'The ' || name_en || ' d''Or de la Y' AS y FROM entries)")
def audit_words(spark, sf):
    """F13."""
    said = d.entries(spark, sf).select("_seq", F.expr(_SAID).alias("x"), F.concat(F.lit("The "), "name_en", F.lit(" d'Or de la Y")).alias("y"))
    return said.select("_seq", F.array_join(text.audit_words_ko(F.col("x")), "|").alias("ko_words"), F.array_join(text.audit_words_en(F.col("y")), "|").alias("en_words"))


_SLUG_LETTERS = "array_to_string(list_transform(string_split(coalesce(text, ''), ''), lambda c: CASE WHEN strip_accents(c) <> c THEN strip_accents(c) || '-' ELSE c END), '')"


@query(f"SELECT doc_id, CASE WHEN x = '' THEN 'edit' ELSE x END AS slug FROM (SELECT doc_id, substr(lower(regexp_replace(regexp_replace({_SLUG_LETTERS}, '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), 1, 40) AS x FROM documents)")
def slugs(spark, sf):
    """F16."""
    return d.table(spark, sf, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


_PAIRS = "pairs AS (SELECT DISTINCT a, b FROM (SELECT p_name AS a, lead(p_name) OVER (ORDER BY p_partkey) AS b FROM part) WHERE b IS NOT NULL)"


def _name_pairs(spark, sf):
    part = d.table(spark, sf, "part")
    after = part.select((F.col("p_partkey") - 1).alias("_k"), F.col("p_name").alias("b"))
    return part.join(after, F.col("p_partkey") == F.col("_k")).select(F.col("p_name").alias("a"), "b").distinct()


@query(f"WITH RECURSIVE {_PAIRS}, {s.distances('pairs')} SELECT a, b, round(d, 6) AS d FROM dist")
def weighted_distance(spark, sf):
    """F3 in Arrow batches: names of neighbouring parts."""
    return _name_pairs(spark, sf).select("a", "b", F.round(distance.weighted_distance_arrow("a", "b"), 6).alias("d"))


_SPELLED = f"""{d.ENTRIES}, spelled AS (SELECT DISTINCT {s.jamo("name_ko")} AS k, name_ko FROM entries),
pairs AS (SELECT DISTINCT a, b FROM (SELECT k AS a, lead(k) OVER (ORDER BY name_ko) AS b FROM spelled) WHERE b IS NOT NULL)"""


@query(f"WITH RECURSIVE {_SPELLED}, {s.distances('pairs')} SELECT a, b, round(1 - d / greatest(length(a), length(b)), 6) AS similarity FROM dist")
def similarity_pairs(spark, sf):
    """F4 as a native column: keys of neighbouring spellings."""
    spelled = numbered(d.entries(spark, sf).select("name_ko").distinct().withColumn("a", text.jamo_key(F.col("name_ko"))), "n", "name_ko")
    pairs = spelled.join(spelled.select((F.col("n") - 1).alias("n"), F.col("a").alias("b")), "n").select("a", "b").distinct()
    return pairs.select("a", "b", F.round(distance.key_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


# ---- dictionary build ----

_KEYED = f"{d.ENTRIES}, {d.ALIASES}, keyed AS (SELECT *, {s.search_key('name_en')} AS k FROM entries), known AS (SELECT type, k, max_by(name_en, _seq) AS target FROM keyed GROUP BY ALL), asked AS (SELECT *, {s.search_key('name_en')} AS k FROM aliases)"


@query(f"WITH {_KEYED} SELECT alias_ko AS name_ko, target AS name_en, type, 'alias' AS ko_source, _seq FROM asked JOIN known USING (type, k)")
def alias_resolve(spark, sf):
    """B2."""
    found, _ = build.resolve_aliases(d.entries(spark, sf), d.aliases(spark, sf))
    return found.select("name_ko", "name_en", "type", "ko_source", "_seq")


@query(f"WITH {_KEYED} SELECT alias_ko, name_en, type, _seq FROM asked ANTI JOIN known USING (type, k)")
def alias_orphans(spark, sf):
    """B3."""
    return build.resolve_aliases(d.entries(spark, sf), d.aliases(spark, sf))[1]


_STRIP = f"list_contains({s._list(list(t.KO_PREFIXES))}, split_part(name_ko, ' ', 1)) AND position(' ' IN name_ko) > 0 AND length(substr(name_ko, position(' ' IN name_ko) + 1)) >= 2"


@query(f"WITH {d.ENTRIES} SELECT type, name_ko, name_en, ko_source, is_alias FROM entries UNION ALL SELECT type, substr(name_ko, position(' ' IN name_ko) + 1), name_en, 'stripped', 1 FROM entries WHERE type = 'producer' AND {_STRIP}")
def strip_generate(spark, sf):
    """B4, F15."""
    return build.add_stripped(d.entries(spark, sf), F.lit(1 << 41)).select("type", "name_ko", "name_en", "ko_source", "is_alias")


_BASE = f"""{_KEYED},
base AS (SELECT type, name_ko, name_en, ko_source, is_alias, region_group, _seq FROM entries
  UNION ALL SELECT type, alias_ko, target, 'alias', 1, '', _seq + {1 << 40} FROM asked JOIN known USING (type, k)),
rows_ AS (SELECT * FROM base UNION ALL SELECT type, substr(name_ko, position(' ' IN name_ko) + 1), name_en, 'stripped', 1, region_group, _seq + {1 << 41} FROM base WHERE type = 'producer' AND {_STRIP}),
flat AS (SELECT *, CASE WHEN {s.flat(s.search_key("name_en"))} = '' THEN 'ko:' || {s.jamo("name_ko")} ELSE {s.flat(s.search_key("name_en"))} END AS ken FROM rows_),
ids AS (SELECT type, ken, substr(type, 1, 3) || printf('%05d', row_number() OVER (ORDER BY min(_seq))) AS canonical_id FROM flat GROUP BY type, ken),
numbered AS (SELECT * FROM flat JOIN ids USING (type, ken)),
placed AS (SELECT *, row_number() OVER w AS place, first_value(name_ko) OVER w AS name_ko_primary FROM numbered
  WINDOW w AS (PARTITION BY canonical_id ORDER BY is_alias, CASE ko_source {" ".join(f"WHEN '{k}' THEN {v}" for k, v in t.SOURCE_PRIORITY.items())} ELSE {t.OTHER_PRIORITY} END, length(name_ko), _seq)),
terms AS (SELECT canonical_id, type, name_ko, name_ko_primary, (name_ko <> name_ko_primary)::INT AS is_alias, name_en, {s.display("name_en")} AS name_display, '' AS tier, {s.jamo("name_ko")} AS key_ko, {s.key_en("name_en")} AS key_en,
  length({s.jamo("name_ko")})::INT AS key_len, region_group, ko_source, '' AS wikidata, place FROM placed QUALIFY row_number() OVER (PARTITION BY canonical_id, name_ko ORDER BY place) = 1),
final AS (SELECT *, row_number() OVER (ORDER BY type, name_ko_primary, is_alias, canonical_id, place) AS term_seq FROM terms WHERE key_ko <> '')"""


def _built(spark, sf) -> build.Dictionary:
    return build.build(d.entries(spark, sf), d.aliases(spark, sf))


@query(f"WITH {_BASE} SELECT DISTINCT canonical_id, type, ken FROM numbered")
def canonical_ids(spark, sf):
    """One number sequence over all types."""
    found, _ = build.resolve_aliases(d.entries(spark, sf), d.aliases(spark, sf))
    rows = d.entries(spark, sf).unionByName(found.withColumn("_seq", F.col("_seq") + (1 << 40)))
    ids = build.assign_canonical(build.add_stripped(rows, F.lit(1 << 41)))
    return ids.select("canonical_id", "type", text.flat(text.search_key_en(F.col("name_en"))).alias("ken")).distinct()


@query(f"WITH {_BASE} SELECT DISTINCT canonical_id, name_ko_primary FROM terms")
def primary_election(spark, sf):
    """B6, B7, B9."""
    return _built(spark, sf).terms.select("canonical_id", "name_ko_primary").distinct()


@query(f"WITH {_BASE} SELECT term_seq, {', '.join(build.TERM_COLUMNS)} FROM final")
def build_dictionary(spark, sf):
    """B1 to B11, B13."""
    return _built(spark, sf).terms


@query(f"WITH {_BASE} SELECT coalesce(type, 'all') AS type, count(*) AS n_rows, count(DISTINCT canonical_id) AS n_canonical FROM final GROUP BY ROLLUP (type)")
def type_summary(spark, sf):
    """B12."""
    return _built(spark, sf).summary()


@query(f"WITH {_BASE} SELECT canonical_id AS i, substr(type, 1, 1) AS t, name_ko AS ko, name_ko_primary AS p, name_en AS en, name_display AS d, tier AS tr, key_ko AS k, key_en AS ke FROM final")
def compact_records(spark, sf):
    """The runtime records."""
    return build.compact(_built(spark, sf).terms)


@query(f"WITH {_BASE} SELECT type, name_en, name_ko, tier, region_group, ko_source, '' AS note FROM final WHERE is_alias = 0 AND trim(name_en) <> '' QUALIFY row_number() OVER (PARTITION BY type, canonical_id ORDER BY term_seq) = 1")
def freeze_entries(spark, sf):
    """B14."""
    return build.freeze(_built(spark, sf).terms)[0]


@query(f"WITH {_BASE} SELECT DISTINCT name_ko AS alias_ko, name_en, type, '' AS note FROM final WHERE is_alias = 1 AND ko_source <> 'stripped'")
def freeze_aliases(spark, sf):
    """B14."""
    return build.freeze(_built(spark, sf).terms)[1]


# ---- sources and sinks: files of the shared folder, written and read back ----

_PADDED = f"""padded AS (SELECT type, CASE WHEN _seq % 17 = 0 THEN ' ' ELSE ' ' || name_ko END AS name_ko, CASE WHEN _seq % 19 = 0 THEN 'NA' WHEN _seq % 23 = 0 THEN name_en || ', "x"' ELSE name_en || ' ' END AS name_en, region_group, CASE WHEN _seq % 3 = 0 THEN '' ELSE ko_source END AS ko_source, _seq FROM entries)"""
_READ = "SELECT type, trim(name_ko) AS name_ko, trim(name_en) AS name_en, region_group, CASE ko_source WHEN '' THEN 'manual' ELSE ko_source END AS ko_source, 0 AS is_alias, row_number() OVER (ORDER BY list_position(['grape', 'region', 'producer'], type), _seq) AS place FROM padded"


def _seed_folder(spark, sf) -> str:
    """A folder of seed files: parts with blanks around names, names like NA, quotes and commas; aliases of customers."""
    folder = scratch(spark, "seeds")
    spelled = F.expr("CASE WHEN _seq % 17 = 0 THEN ' ' ELSE ' ' || name_ko END")
    named = F.expr("""CASE WHEN _seq % 19 = 0 THEN 'NA' WHEN _seq % 23 = 0 THEN name_en || ', "x"' ELSE name_en || ' ' END""")
    rows = d.entries(spark, sf).select("type", named.alias("name_en"), spelled.alias("name_ko"), F.lit("").alias("tier"), "region_group", F.expr("CASE WHEN _seq % 3 = 0 THEN '' ELSE ko_source END").alias("ko_source"), F.lit("").alias("note"), "_seq")
    for file, type_ in edit.FILES.items():
        files.write_csv(rows.filter(F.col("type") == type_).orderBy("_seq"), f"{folder}/{file}.csv", edit.ENTRY_FIELDS)
    files.write_csv(d.aliases(spark, sf).withColumn("note", F.lit("")).orderBy("_seq"), f"{folder}/aliases.csv", edit.ALIAS_FIELDS)
    return folder


@query(f"WITH {d.ENTRIES}, {_PADDED} SELECT * FROM ({_READ}) WHERE name_ko <> '' AND name_en <> ''".replace("row_number() OVER (ORDER BY list_position(['grape', 'region', 'producer'], type), _seq)", "_seq"))
def seed_scan(spark, sf):
    """Seeds as CSV files and back, in their order."""
    folder = _seed_folder(spark, sf)
    read = files.read_seeds(spark, folder).all_entries()
    # rows come back in the order of their file, which is that of the parts: place n of a type is its nth part
    own = numbered(read.withColumn("_n", F.col("_seq") % (1 << 36)).withColumn("_file", F.col("type")), "_at", "_file", "_n")
    parts = numbered(d.entries(spark, sf).filter("_seq % 17 <> 0").select(F.col("type").alias("_t"), F.col("_seq").alias("place")), "_at", "_t", "place")
    return own.join(parts, "_at").select("type", "name_ko", "name_en", "region_group", "ko_source", "is_alias", "place")


@query(f"WITH {d.ENTRIES}, {d.ALIASES} SELECT alias_ko, name_en, type, _seq - (SELECT min(_seq) FROM aliases) AS place FROM aliases")
def alias_scan(spark, sf):
    """Aliases as a CSV file and back; there is one for each customer, in order."""
    return files.read_seeds(spark, _seed_folder(spark, sf)).all_aliases().select("alias_ko", "name_en", "type", F.col("_seq").alias("place"))


@query(f"WITH {_BASE} SELECT term_seq - 1 AS term_seq, {', '.join(build.TERM_COLUMNS)} FROM final")
def terms_file(spark, sf):
    """The dictionary as a CSV file and back."""
    path = scratch(spark, "terms.csv")
    files.write_csv(_built(spark, sf).ordered(), path, build.TERM_COLUMNS)
    return files.read_terms(spark, path).select("term_seq", *build.TERM_COLUMNS)


@query(f"WITH {_BASE} SELECT term_seq - 1 AS place, canonical_id AS i, substr(type, 1, 1) AS t, name_ko AS ko, name_ko_primary AS p, name_en AS en, name_display AS d, tier AS tr, key_ko AS k, key_en AS ke FROM final")
def compact_file(spark, sf):
    """The runtime file, one JSON array, and back."""
    path = scratch(spark, "compact.json")
    files.write_compact(_built(spark, sf).terms, path)
    return files.read_compact(spark, path).withColumnRenamed("_seq", "place")


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS qid, trim(c_name) AS text, 0.85::DOUBLE AS th, 'all' AS type FROM customer QUALIFY c_custkey % 5 <> 0")
def query_list(spark, sf):
    """One query a line; blank lines find no query, and count as lines."""
    path = scratch(spark, "queries")
    lines = d.table(spark, sf, "customer").select("c_custkey", F.expr("CASE WHEN c_custkey % 5 = 0 THEN '  ' ELSE ' ' || c_name || ' ' END").alias("value")).orderBy("c_custkey")
    lines.select("value").write.text(path)  # a file for each range of the order, named in turn
    return files.read_queries(spark, path)


@query("SELECT r_name, n_name, n_nationkey::VARCHAR AS n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def hierarchy_copy(spark, sf):
    """A table that is passed on as it is."""
    source, target = scratch(spark, "hierarchy"), scratch(spark, "copied")
    rows = d.table(spark, sf, "nation").join(d.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows.select("r_name", "n_name", "n_nationkey").coalesce(1).write.option("header", True).csv(source)
    files.copy_table(spark, source, target)
    return spark.read.option("header", True).csv(target)


# ---- matching ----


def _index(spark, sf):
    return build_index(d.dictionary_of(d.names(spark, sf)))


_KO_TERMS = f"terms AS (SELECT *, {s.jamo('name_ko')} AS k, length({s.jamo('name_ko')}) AS klen FROM names)"
_EN_TERMS = f"terms AS (SELECT *, {s.key_en('name_en')} AS ke, {s.flat(s.key_en('name_en'))} AS k, length({s.key_en('name_en')}) AS elen, length({s.flat(s.key_en('name_en'))}) AS klen FROM names)"
_OF_TYPE = "(q.type = 'all' OR q.type = x.type)"


def _ko_pushed(frags: str) -> str:
    """kq, ko_pushed of a table of fragments(fid, text, th, type, allow_prefix)."""
    word_keys = f"list_filter(list_transform({s.tokens('x.name_ko')}, lambda w: {s.jamo('w')}), lambda w: length(w) >= 2)"
    cover = "list_max(list_transform(list_filter(x.words, lambda w: starts_with(w, q.k)), lambda w: CASE WHEN w = q.k THEN 0.95::DOUBLE ELSE 0.82::DOUBLE + 0.13::DOUBLE * (q.n::DOUBLE / length(w)) END))"
    return f"""kq AS (SELECT * FROM (SELECT *, {s.jamo("text")} AS k, length({s.jamo("text")}) AS n FROM {frags}) WHERE k <> ''),
kt AS (SELECT *, CASE WHEN len({s.tokens("x.name_ko")}) >= 2 THEN {word_keys} ELSE [] END AS words FROM terms x),
ko_pushed AS (
  SELECT q.fid, canonical_id, term_seq, 1.0::DOUBLE AS score, 0 AS stage, klen FROM kq q JOIN kt x ON q.k = x.k AND {_OF_TYPE}
  UNION ALL SELECT * EXCLUDE (th) FROM (
    SELECT q.fid, canonical_id, term_seq, CASE WHEN starts_with(x.k, q.k) THEN 0.80::DOUBLE + 0.20::DOUBLE * (q.n::DOUBLE / klen) ELSE {cover} END AS score, 1 AS stage, klen, q.th
    FROM kq q JOIN kt x ON {_OF_TYPE} AND allow_prefix AND q.n >= 2) WHERE score >= th)"""


def _ko_typos() -> str:
    """Pairs of what nothing was pushed for, and all that is pushed in the end."""
    return f"""ko_left AS (SELECT * FROM kq ANTI JOIN ko_pushed USING (fid)),
ko_near AS (SELECT q.fid, q.th, q.k AS a, x.k AS b, canonical_id, term_seq, klen, n FROM ko_left q JOIN terms x ON {_OF_TYPE} AND abs(klen - n) <= greatest(n * 0.4::DOUBLE, 3)),
ko_pairs AS (SELECT DISTINCT a, b FROM ko_near), {s.distances("ko_pairs", "ko_dist")},
ko_all AS (SELECT * FROM ko_pushed UNION ALL SELECT * EXCLUDE (th) FROM (SELECT fid, canonical_id, term_seq, 1 - d / greatest(n, klen) AS score, 2 AS stage, klen, th FROM ko_near JOIN ko_dist USING (a, b)) WHERE score >= th)"""


def _top(pushed: str, length: str, out: str) -> str:
    return f"""{out}_first AS (SELECT fid, canonical_id, min(stage * 1000000000000 + term_seq) AS first FROM {pushed} GROUP BY ALL),
{out}_best AS (SELECT * FROM {pushed} QUALIFY row_number() OVER (PARTITION BY fid, canonical_id ORDER BY score DESC, stage, term_seq) = 1),
{out} AS (SELECT fid, row_number() OVER (PARTITION BY fid ORDER BY score DESC, {length}, first) AS rank, canonical_id, term_seq, score, {length} AS length FROM {out}_best JOIN {out}_first USING (fid, canonical_id) QUALIFY rank <= 10)"""


def _en_pushed(queries: str) -> str:
    words = "list_distinct(list_concat(list_filter(string_split(ke, ' '), lambda w: w <> ''), list_filter(string_split_regex(lower(strip_accents(name_en)), '[^a-z0-9]+'), lambda w: length(w) >= 3)))"
    fit = "list_max(list_transform(list_filter(x.words, lambda w: starts_with(w, q.k)), lambda w: CASE WHEN w = q.k THEN 0.97::DOUBLE ELSE 0.84::DOUBLE + 0.13::DOUBLE * (q.n::DOUBLE / length(w)) END))"
    key = s.search_key(s.no_honorific("text"))
    return f"""eq AS (SELECT *, {s.flat("w")} AS k, length({s.flat("w")}) AS n FROM (SELECT *, {key} AS w FROM {queries}) WHERE length(w) >= 2),
et AS (SELECT *, {words} AS words FROM en_terms WHERE k <> ''),
en_exact AS (SELECT q.fid, canonical_id, term_seq, 1.0::DOUBLE AS score, 0 AS stage, elen FROM eq q JOIN et x ON q.k = x.k AND {_OF_TYPE}),
en_fits AS (SELECT q.fid, canonical_id, term_seq, CASE WHEN starts_with(x.k, q.k) THEN 0.80::DOUBLE + 0.20::DOUBLE * (q.n::DOUBLE / klen) WHEN position(' ' IN q.w) = 0 AND {fit} IS NOT NULL THEN {fit}
    WHEN q.n >= 3 AND klen > q.n AND contains(x.k, q.k) THEN 0.75::DOUBLE + 0.20::DOUBLE * (q.n::DOUBLE / klen) END AS score, 1 AS stage, elen, q.th FROM eq q JOIN et x ON {_OF_TYPE}),
en_pushed AS (SELECT * FROM en_exact UNION ALL SELECT * EXCLUDE (th) FROM en_fits WHERE score >= th)"""


def _en_typos() -> str:
    return f"""en_left AS (SELECT *, least(greatest(th - 0.05::DOUBLE, 0.55::DOUBLE), 0.88::DOUBLE) AS tol FROM eq WHERE fid NOT IN (SELECT fid FROM en_exact UNION ALL SELECT fid FROM en_fits WHERE score IS NOT NULL)),
en_near AS (SELECT q.fid, tol, q.k AS a, CASE WHEN abs(klen - n) <= greatest(n * 0.5::DOUBLE, 3) THEN x.k ELSE substr(x.k, 1, n) END AS b, abs(klen - n) <= greatest(n * 0.5::DOUBLE, 3) AS whole, canonical_id, term_seq, elen, klen, n
  FROM en_left q JOIN et x ON {_OF_TYPE} AND (abs(klen - n) <= greatest(n * 0.5::DOUBLE, 3) OR (klen > n AND n >= 3))),
en_pairs AS (SELECT DISTINCT a, b FROM en_near), {s.distances("en_pairs", "en_dist")},
en_all AS (SELECT * FROM en_pushed UNION ALL SELECT fid, canonical_id, term_seq, CASE WHEN whole THEN s ELSE s * 0.95::DOUBLE END, 2, elen FROM (SELECT *, 1 - d / CASE WHEN whole THEN greatest(n, klen) ELSE n END AS s FROM en_near JOIN en_dist USING (a, b)) WHERE s >= tol)"""


def _score(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query(f"WITH {d.NAMES}, {d.queries_sql('customer', 'c_custkey', 'ko')}, {_KO_TERMS} SELECT qid, canonical_id, term_seq FROM (SELECT qid, type, {s.jamo('text')} AS k FROM queries) q JOIN terms x ON q.k = x.k AND {_OF_TYPE}")
def match_exact(spark, sf):
    """M1, M4: queries of all customers."""
    index = _index(spark, sf)
    q = d.queries(spark, sf, "customer", "c_custkey", "ko").select("qid", F.col("type").alias("q_type"), text.jamo_key(F.col("text")).alias("q_key"))
    return q.join(index.exact_ko, F.col("q_key") == F.col("key")).filter(matching.of_type()).select("qid", "canonical_id", "term_seq")


@query(f"WITH {d.NAMES}, {d.queries_sql('customer', 'c_custkey', 'en')}, {_EN_TERMS} SELECT qid, canonical_id, term_seq FROM (SELECT qid, type, {s.flat(s.search_key(s.no_honorific('text')))} AS k FROM queries) q JOIN terms x ON q.k = x.k AND {_OF_TYPE}")
def match_exact_en(spark, sf):
    """M3, M4."""
    index = _index(spark, sf)
    q = d.queries(spark, sf, "customer", "c_custkey", "en").select("qid", F.col("type").alias("q_type"), text.flat(text.query_key_en(F.col("text"))).alias("q_key"))
    return q.join(index.exact_en, F.col("q_key") == F.col("key")).filter(matching.of_type()).select("qid", "canonical_id", "term_seq")


_FRAG_KO = "asked AS (SELECT qid AS fid, text, th, type, true AS allow_prefix FROM queries)"


def _asked(spark, sf, source, key, kind):
    return d.queries(spark, sf, source, key, kind).select(F.col("qid").alias("fid"), "text", "th", F.col("type").alias("q_type"), F.lit(True).alias("allow_prefix"))


_RANKED = "SELECT fid AS qid, rank::INT AS rank, canonical_id, term_seq, round(score, 6) AS score FROM top"


@query(f"WITH RECURSIVE {d.NAMES}, {d.queries_sql('customer', 'c_custkey', 'ko')}, {_KO_TERMS}, {_FRAG_KO}, {_ko_pushed('asked')}, {_ko_typos()}, {_top('ko_all', 'klen', 'top')} {_RANKED}")
def lookup_top10(spark, sf):
    """M5 to M9: Korean spellings, typos included."""
    return _score(matching.lookup_ko(_asked(spark, sf, "customer", "c_custkey", "ko"), _index(spark, sf))).select(F.col("fid").alias("qid"), "rank", "canonical_id", "term_seq", "score")


@query(f"WITH RECURSIVE {d.NAMES}, {d.queries_sql('customer', 'c_custkey', 'en')}, en_{_EN_TERMS}, {_FRAG_KO}, {_en_pushed('asked')}, {_en_typos()}, {_top('en_all', 'elen', 'top')} {_RANKED}")
def lookup_en_top10(spark, sf):
    """Original names, typos included."""
    return _score(matching.lookup_en(_asked(spark, sf, "customer", "c_custkey", "en"), _index(spark, sf))).select(F.col("fid").alias("qid"), "rank", "canonical_id", "term_seq", "score")


def _frags_sql(source: str) -> str:
    """frags(qid, fno, text, is_full, allow_prefix, th, type)."""
    runs = " UNION ALL ".join(f"SELECT qid, th, type, {3 - k} AS step, i, array_to_string(w[i:i + {k - 1}], ' ') AS text, false AS is_full, {'i = n' if k == 1 else 'false'} AS allow_prefix FROM split, unnest(range(1, n - {k - 2})) AS u(i) WHERE n > 1 AND n >= {k}" for k in (3, 2, 1))
    return f"""split AS (SELECT *, {s.tokens("text")} AS w, len({s.tokens("text")}) AS n FROM {source}),
frags AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY step, i) - 1 AS fno, text, is_full, allow_prefix, th, type FROM
  (SELECT qid, th, type, -1 AS step, 0 AS i, text, n > 1 AS is_full, true AS allow_prefix FROM split UNION ALL SELECT * FROM ({runs}) WHERE length(replace(text, ' ', '')) >= 2))"""


@query(f"WITH {d.NAMES}, {d.queries_sql('customer', 'c_custkey', 'ko')}, {_frags_sql('queries')} SELECT qid, fno::INT AS fno, text, is_full, allow_prefix FROM frags")
def ngram_fragments(spark, sf):
    """Fragments of all customers' queries."""
    q = d.queries(spark, sf, "customer", "c_custkey", "ko").withColumnRenamed("type", "q_type")
    return matching.fragments(q).select("qid", "fno", "text", "is_full", "allow_prefix")


_MERGED = """merged AS (SELECT f.qid, f.fno, h.rank, canonical_id, term_seq, score, length, f.text AS frag, is_full FROM ko_top h JOIN frags f ON h.fid = f.qid * 1000 + f.fno),
merged_first AS (SELECT qid, canonical_id, min(fno * 1000 + rank) AS first FROM merged GROUP BY ALL),
kept AS (SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY qid, canonical_id ORDER BY is_full DESC, score DESC, fno) = 1),
spelled AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY is_full DESC, score DESC, length, first) AS rank, canonical_id, term_seq, score, frag, is_full FROM kept JOIN merged_first USING (qid, canonical_id) QUALIFY rank <= 10)"""
_FRAG_IDS = "asked AS (SELECT qid * 1000 + fno AS fid, text, th, type, allow_prefix FROM frags)"
_SCAN_KO = f"{_FRAG_IDS}, {_ko_pushed('asked')}, {_ko_typos()}, {_top('ko_all', 'klen', 'ko_top')}, {_MERGED}"


@query(f"WITH RECURSIVE {d.NAMES}, {d.queries_sql('customer', 'c_custkey', 'ko')}, {_KO_TERMS}, {_frags_sql('queries')}, {_SCAN_KO} SELECT qid, rank::INT AS rank, canonical_id, term_seq, round(score, 6) AS score, frag, is_full FROM spelled")
def scan_fragments(spark, sf):
    """M13, M14."""
    q = d.queries(spark, sf, "customer", "c_custkey", "ko").withColumnRenamed("type", "q_type")
    return _score(matching.scan_ko(q, _index(spark, sf)))


def _renamed(part: str) -> str:
    """A second set of the tables of an English lookup."""
    return re.sub(r"\b(eq|et|en_(?!terms)\w+)\b", r"kb_\1", part)


_EN_LOOKUP = f"{_en_pushed('asked_en')}, {_en_typos()}, {_top('en_all', 'elen', 'en_top')}"
_ROUTED = f"""{d.NAMES}, {d.queries_sql("supplier", "s_suppkey", "all")},
qr AS (SELECT *, latin0 AND NOT hangul AS latin FROM (SELECT qid, trim(text) AS text, th, type, regexp_matches(text, '[가-힣ㄱ-ㅎㅏ-ㅣ]') AS hangul, regexp_matches(text, '[A-Za-z]') AS latin0 FROM queries) WHERE text <> ''),
en_{_EN_TERMS}, {_KO_TERMS}, asked_en AS (SELECT qid AS fid, text, th, type FROM qr WHERE latin), {_EN_LOOKUP},
rest AS (SELECT * FROM qr WHERE qid NOT IN (SELECT fid FROM en_top)), {_frags_sql("rest")}, {_SCAN_KO},
mistyped AS (SELECT qid AS fid, {s.typed("text")} AS text, th, type FROM rest WHERE hangul AND qid NOT IN (SELECT qid FROM spelled)), kb_asked_en AS (SELECT * FROM mistyped WHERE length(text) >= 2), {_renamed(_EN_LOOKUP).replace("FROM asked_en", "FROM kb_asked_en")},
hits AS (SELECT fid AS qid, rank, canonical_id, term_seq, score, NULL::VARCHAR AS frag, false AS is_full, 'en' AS via, NULL::VARCHAR AS typed FROM en_top
  UNION ALL SELECT qid, rank, canonical_id, term_seq, score, frag, is_full, 'ko', NULL FROM spelled
  UNION ALL SELECT h.fid, rank, canonical_id, term_seq, score, NULL, false, 'kbd', text FROM kb_en_top h JOIN kb_asked_en USING (fid))"""


@query(f"WITH RECURSIVE {_ROUTED} SELECT qid, rank::INT AS rank, canonical_id, term_seq, round(score, 6) AS score, frag, is_full, via, typed FROM hits")
def scan_router(spark, sf):
    """M15 over all suppliers' queries in both scripts."""
    return _score(matching.scan(d.queries(spark, sf, "supplier", "s_suppkey", "all"), _index(spark, sf)))


@query(f"WITH RECURSIVE {_ROUTED} SELECT count(*) AS n_queries, count(*) FILTER (qid IN (SELECT qid FROM hits)) AS n_hit, round(avg(CASE WHEN qid IN (SELECT qid FROM hits) THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM queries")
def hit_rate(spark, sf):
    """The share of all suppliers' queries with any candidate."""
    q = d.queries(spark, sf, "supplier", "s_suppkey", "all")
    rate = matching.hit_rate(q, matching.scan(q, _index(spark, sf)))[1]
    return rate.select("n_queries", "n_hit", F.round("hit_rate", 6).alias("hit_rate"))


_ENTRY_KEYS = f"e AS (SELECT term_seq AS seq, name_ko, name_en, {s.jamo('name_ko')} AS k FROM names)"


@query(
    f"WITH RECURSIVE {d.NAMES}, {d.queries_sql('customer', 'c_custkey', 'ko')}, {_ENTRY_KEYS}, q AS (SELECT qid, {s.jamo('text')} AS qk FROM queries), same AS (SELECT qid, seq, name_ko, name_en, 1.0::DOUBLE AS score, true AS same FROM q JOIN e ON qk = k), "
    f"near AS (SELECT qid, qk AS a, k AS b, seq, name_ko, name_en FROM q JOIN e ON abs(length(k) - length(qk)) <= greatest(length(qk) * 0.4::DOUBLE, 3) WHERE qid NOT IN (SELECT qid FROM same)), pairs AS (SELECT DISTINCT a, b FROM near), {s.distances('pairs')}, "
    "found AS (SELECT * FROM same UNION ALL SELECT qid, seq, name_ko, name_en, round_even(1 - d / greatest(length(a), length(b)), 3), false FROM near JOIN dist USING (a, b) WHERE 1 - d / greatest(length(a), length(b)) >= 0.82::DOUBLE) "
    "SELECT qid, rank::INT AS rank, name_ko, name_en AS name_original, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq) AS rank FROM found) WHERE same OR rank <= 5"
)
def library_index(spark, sf):
    """M16, SC11."""
    named = d.names(spark, sf).select(F.col("term_seq").alias("seq"), "name_ko", F.col("name_en").alias("name_original"))
    return matching.index_lookup(d.queries(spark, sf, "customer", "c_custkey", "ko"), named)


# ---- audit ----

_FAULTY = """faulty AS (SELECT canonical_id, type, is_alias, CASE WHEN term_seq % 11 = 0 THEN key_en ELSE name_ko END AS name_ko,
  CASE WHEN term_seq % 13 = 0 THEN ' ' WHEN term_seq % 17 = 0 THEN name_ko || name_en WHEN term_seq % 3 = 0 THEN split_part(name_en, ' ', 2) ELSE name_en END AS name_en FROM final)"""


def _faulty(spark, sf) -> DataFrame:
    """The built dictionary with errors in known places."""
    terms = _built(spark, sf).terms
    return terms.select("canonical_id", "type", "is_alias", F.expr("CASE WHEN term_seq % 11 = 0 THEN key_en ELSE name_ko END").alias("name_ko"), F.expr("CASE WHEN term_seq % 13 = 0 THEN ' ' WHEN term_seq % 17 = 0 THEN name_ko || name_en WHEN term_seq % 3 = 0 THEN split_part(name_en, ' ', 2) ELSE name_en END").alias("name_en"))


_GAP = f"SELECT '{t.TRUNCATED}' AS category, name_ko || '  ->  ' || name_en || '   [' || type || ']' AS detail FROM (SELECT *, len({_KO_WORDS.replace('(x,', '(name_ko,')}) AS n_ko, len({_EN_WORDS.replace('(y)', '(name_en)')}) AS n_en FROM faulty WHERE is_alias = 0) WHERE n_ko > 0 AND n_en BETWEEN 1 AND 2 AND n_ko - n_en >= 1"
_PRINTED = "'[' || array_to_string(list_transform({}, lambda v: '''' || v || ''''), ', ') || ']'"
_OVERLAP = f"SELECT CASE WHEN list_contains(types, 'producer') THEN '{t.TYPES_ERROR}' ELSE '{t.TYPES_CHECK}' END AS category, name_en || ': ' || {_PRINTED.format('types')} AS detail FROM (SELECT name_en, list_sort(list(DISTINCT type)) AS types FROM faulty GROUP BY name_en) WHERE len(types) > 1"
_SCRIPT = f"SELECT '{t.NO_HANGUL}' AS category, name_ko || ' [' || type || ']' AS detail FROM faulty WHERE name_ko <> '' AND NOT regexp_matches(name_ko, '[가-힣]') UNION ALL SELECT CASE WHEN trim(name_en) = '' THEN '{t.NO_ORIGINAL}' ELSE '{t.MIXED_ORIGINAL}' END, CASE WHEN trim(name_en) = '' THEN name_ko || ' [' || type || ']' ELSE name_ko || ' -> ' || name_en END FROM faulty WHERE trim(name_en) = '' OR regexp_matches(name_en, '[가-힣]')"
_HOMONYM = f"SELECT '{t.HOMONYM}' AS category, name_ko || ': ' || {_PRINTED.format('names[1:4]')} AS detail FROM (SELECT name_ko, list_sort(list(DISTINCT name_en)) AS names, count(DISTINCT canonical_id) AS n FROM faulty GROUP BY name_ko) WHERE len(names) > 1 AND n > 1"
_ISSUES = f"issues AS ({_GAP} UNION ALL {_OVERLAP} UNION ALL {_SCRIPT} UNION ALL {_HOMONYM})"


@query(f"WITH {_BASE}, {_FAULTY} {_GAP}")
def audit_word_gap(spark, sf):
    """A1."""
    return checks.truncated_originals(_faulty(spark, sf))


@query(f"WITH {_BASE}, {_FAULTY} {_OVERLAP}")
def audit_type_overlap(spark, sf):
    """A2."""
    return checks.type_overlaps(_faulty(spark, sf))


@query(f"WITH {_BASE}, {_FAULTY} {_SCRIPT}")
def audit_script(spark, sf):
    """A3, A4."""
    terms = _faulty(spark, sf)
    return checks.spellings_without_hangul(terms).union(checks.wrong_originals(terms))


@query(f"WITH {_BASE}, {_FAULTY} {_HOMONYM}")
def audit_homonym(spark, sf):
    """A5."""
    return checks.homonyms(_faulty(spark, sf))


@query(f"WITH {_BASE}, {_FAULTY}, {_ISSUES} SELECT category, count(*) AS n, array_to_string(list_sort(list(detail))[1:15], chr(10)) AS first FROM issues GROUP BY category")
def audit_summary(spark, sf):
    """A6, S14."""
    return checks.audit_summary(checks.audit(_faulty(spark, sf))).withColumn("first", F.array_join("first", "\n"))


@query(f"WITH {_BASE}, {_FAULTY}, {_ISSUES}, clean AS ({_HOMONYM.replace('FROM faulty', 'FROM final')} UNION ALL {_OVERLAP.replace('FROM faulty', 'FROM final')}) SELECT category, detail FROM issues ANTI JOIN clean USING (category, detail)")
def audit_diff(spark, sf):
    """A7, E7."""
    terms = _built(spark, sf).terms
    before = checks.homonyms(terms).union(checks.type_overlaps(terms))
    return checks.new_issues(before, checks.audit(_faulty(spark, sf)))


# ---- edits ----

_CHECKED = f"""{d.EDITS}, known AS (SELECT {s.search_key("name_en")} AS k, min(name_en) AS taken FROM seeds GROUP BY ALL),
checked AS (SELECT c.*, NOT regexp_matches(c.name_ko, '[가-힣]') AS no_ko, (c.name_en = '' OR regexp_matches(c.name_en, '[가-힣]') OR coalesce(taken <> c.name_en, false)) AS bad_en FROM changes c LEFT JOIN known ON {s.search_key("c.name_en")} = k)"""


@query(
    f"WITH {_CHECKED}, good AS (SELECT * FROM checked WHERE NOT no_ko AND NOT bad_en QUALIFY row_number() OVER (PARTITION BY name_en ORDER BY _seq DESC) = 1) "
    f"SELECT coalesce(g.name_en, o.name_en) AS name_en, coalesce(g.name_ko, o.name_ko) AS name_ko, coalesce(g.region_group, o.region_group) AS region_group, coalesce(g.ko_source, o.ko_source) AS ko_source, coalesce(g.note, o.note) AS note, coalesce(o._seq, g._seq + {1 << 40}) AS _seq FROM seeds o FULL JOIN good g ON o.name_en = g.name_en"
)
def edit_upsert(spark, sf):
    """E4, E5 as one batch."""
    kept, _ = edit.upsert(d.supplier_entries(spark, sf), d.supplier_changes(spark, sf))
    return kept.select("name_en", "name_ko", "region_group", "ko_source", "note", "_seq")


@query(f"WITH {_CHECKED} SELECT name_en, name_ko, note, _seq, concat_ws(',', CASE WHEN no_ko THEN 'name_ko' END, CASE WHEN bad_en THEN 'name_en' END) AS errors FROM checked WHERE no_ko OR bad_en")
def edit_reject(spark, sf):
    """E1, E3."""
    _, rejected = edit.upsert(d.supplier_entries(spark, sf), d.supplier_changes(spark, sf))
    return rejected.select("name_en", "name_ko", "note", "_seq", F.array_join("errors", ",").alias("errors"))


@query(f"WITH {_KEYED} SELECT alias_ko, name_en, type FROM asked ANTI JOIN known USING (type, k)")
def edit_targets(spark, sf):
    """E2."""
    return edit.missing_targets(d.aliases(spark, sf).select("alias_ko", "name_en", "type"), d.entries(spark, sf))


_BATCH_GOOD = f"""{d.BATCH}, edited AS (SELECT coalesce(a.name_en, s.name_en) AS name_en, coalesce(a.name_ko, s.name_ko) AS name_ko, _seq FROM seeds s LEFT JOIN asked a ON s.name_en = a.old),
added AS (SELECT name_en, name_ko, (SELECT max(_seq) FROM seeds) + row_number() OVER (ORDER BY k) AS _seq FROM asked WHERE old = '')"""
_REFUSED = (
    ("twice", [edit.Change("producers", "add", {"name_en": "One House", "name_ko": "집"}), edit.Change("producers", "add", {"name_en": "one  house", "name_ko": "집"})], "name_en"),
    ("gone", [edit.Change("producers", "edit", {"name_en": "One House", "name_ko": "집"}, {"name_en": "Supplier#000000001"}), edit.Change("producers", "edit", {"name_en": "Two", "name_ko": "집"}, {"name_en": "Supplier#000000001"})], "match"),
    ("no target", [edit.Change("aliases", "add", {"alias_ko": "집", "name_en": "One House", "type": "producer"})], "name_en"),
    ("same alias", [edit.Change("aliases", "add", {"alias_ko": "집", "name_en": "supplier 000000002", "type": "producer"})] * 2, "alias_ko"),
    ("no hangul", [edit.Change("producers", "add", {"name_en": "One House", "name_ko": "house"})], "name_ko"),
)


@query(
    f"WITH {_BATCH_GOOD} SELECT 'row' AS what, * FROM edited UNION ALL SELECT 'row', * FROM added UNION ALL SELECT 'alias', lower(s_name), '집', 0 FROM supplier WHERE s_suppkey = 2 "
    f"UNION ALL SELECT * FROM (VALUES {', '.join(f'({chr(39)}refused{chr(39)}, {name!r}, {field!r}, {len(batch) - 1})' for name, batch, field in _REFUSED)})"
)
def edit_batch(spark, sf):
    """A list of changes of entries and aliases as one transaction; lists that end at their last change."""
    empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in edit.ALIAS_FIELDS) + ", _seq long")
    seeds = edit.Seeds({"producers": d.supplier_entries(spark, sf)}, empty)
    changes = [edit.Change("producers", "edit" if old else "add", {"name_en": en, "name_ko": ko}, {"name_en": old} if old else None) for en, ko, old in d.nation_changes(spark, sf)]
    # the alias is made before its entry has another name
    now, _ = edit.changed(seeds, [edit.Change("aliases", "add", {"alias_ko": " 집", "name_en": "supplier#000000002", "type": "producer"}), *changes])
    refused = []
    for name, batch, _ in _REFUSED:
        try:
            edit.changed(seeds, batch)
        except edit.ChangeError as error:
            refused.append(("refused", name, error.field, len(batch) - 1))
    rows = now.entries["producers"].select(F.lit("row").alias("what"), "name_en", "name_ko", "_seq")
    return rows.union(now.aliases.select(F.lit("alias"), "name_en", "alias_ko", "_seq")).union(spark.createDataFrame(refused, "what string, name_en string, name_ko string, _seq long"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of all suppliers in both scripts, resolved."""
    return scan_router(spark, sf_dir)
