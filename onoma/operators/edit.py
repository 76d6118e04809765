"""Validated changes of the seeds: a list of them is one transaction.

Seeds are DataFrames and stay so. However long the list, a few jobs read what the seeds have under the
names that the changes speak of; on that little state the changes are checked in turn, each on what
those before left. The new seeds are one join and one union. Nothing is written before all
checks have passed.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onoma.functions import tables as t
from onoma.functions.text import has_syllables, search_key_en, slug
from onoma.operators.audit import audit, issue_counts, new_issues
from onoma.operators.dictionary import Dictionary, build

FILES = {"grapes": "grape", "regions": "region", "producers": "producer"}
ENTRY_FIELDS = ["name_en", "name_ko", "tier", "region_group", "ko_source", "note"]
ALIAS_FIELDS = ["alias_ko", "name_en", "type", "note"]


class ChangeError(ValueError):
    """Why a change is refused, and for which field."""

    def __init__(self, message: str, field: str):
        super().__init__(message)
        self.field = field


@dataclass(frozen=True)
class Change:
    file: str
    action: str
    row: dict[str, str | None] = field(default_factory=dict)
    match: dict[str, str | None] | None = None


@dataclass(frozen=True)
class Seeds:
    """Three tables of entries by file name, with ENTRY_FIELDS and _seq, and one of aliases with ALIAS_FIELDS and _seq."""

    entries: dict[str, DataFrame]
    aliases: DataFrame

    def table(self, file: str) -> DataFrame:
        return self.aliases if file == "aliases" else self.entries[file]

    def with_table(self, file: str, df: DataFrame) -> Seeds:
        return replace(self, aliases=df) if file == "aliases" else replace(self, entries=self.entries | {file: df})

    def all_entries(self) -> DataFrame:
        """Entries of all types as the build reads them: trimmed, named in both scripts, types in turn."""
        parts = []
        for i, (file, type_) in enumerate(FILES.items()):
            if file not in self.entries:
                continue
            clean = self.entries[file].select(*(F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ENTRY_FIELDS), "_seq").filter("name_en <> '' and name_ko <> ''")
            source = F.when(F.col("ko_source") == "", "manual").otherwise(F.col("ko_source"))
            parts.append(clean.select(F.lit(type_).alias("type"), "name_ko", "name_en", "tier", "region_group", source.alias("ko_source"), F.lit(0).alias("is_alias"), (F.col("_seq") + (i << 36)).alias("_seq")))
        return reduce(DataFrame.unionByName, parts)

    def all_aliases(self) -> DataFrame:
        clean = self.aliases.select(*(F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ALIAS_FIELDS), "_seq")
        return clean.filter("alias_ko <> '' and name_en <> ''").select("alias_ko", "name_en", "type", "_seq")

    def build(self) -> Dictionary:
        return build(self.all_entries(), self.all_aliases())


def _clean(row: dict[str, str | None] | None, fields: list[str]) -> dict[str, str]:
    return {c: str((row or {}).get(c) or "").strip() for c in fields}


def entry_errors(name_ko: Column, name_en: Column) -> Column:
    """The fields of entries that break a rule, in the order they are reported: a batch of rows is checked at once."""
    rules = [F.when(~has_syllables(name_ko), "name_ko"), F.when(has_syllables(name_en) | (F.coalesce(name_en, F.lit("")) == ""), "name_en")]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def alias_errors(alias_ko: Column, name_en: Column, type_: Column) -> Column:
    rules = [F.when(~has_syllables(alias_ko), "alias_ko"), F.when(has_syllables(name_en), "name_en"), F.when(~F.coalesce(type_, F.lit("")).isin(*t.TYPES), "type")]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def missing_targets(aliases: DataFrame, entries: DataFrame) -> DataFrame:
    """Aliases(alias_ko, name_en, type) whose type and key no entry has."""
    known = entries.select(F.col("type").alias("_t"), search_key_en(F.col("name_en")).alias("_k")).distinct()
    return aliases.join(known, (F.col("type") == F.col("_t")) & (search_key_en(F.col("name_en")) == F.col("_k")), "left_anti")


ALIAS_KEY = ["alias_ko", "name_en", "type"]


@dataclass
class _Known:
    """What the seeds have under the names that a list of changes speaks of, kept up to date change by change.

    rows: by file and raw key (the name, or an alias's triple) the number of rows and the first of
    them as (its _seq, its fields); keys: rows of each (file, search key); usable: those of them that the build reads.
    """

    rows: dict[tuple, tuple[int, tuple[int, dict] | None]]
    keys: Counter
    usable: Counter
    last: dict[str, int]


def _raw_key(file: str, row: dict[str, str]) -> tuple:
    return (file, *(row[c] for c in (ALIAS_KEY if file == "aliases" else ["name_en"])))


def _rules(spark: SparkSession, changes: list[Change]) -> list[tuple[list[str], str, str]]:
    """For each change the fields that break a rule, and the search keys of its name and of the name it replaces: one job."""
    rows = []
    for i, c in enumerate(changes):
        row, match = _clean(c.row, ["name_en", "name_ko", "alias_ko", "type"]), _clean(c.match, ["name_en"])
        rows.append((i, c.file == "aliases", row["alias_ko"] if c.file == "aliases" else row["name_ko"], row["name_en"], row["type"], match["name_en"]))
    asked = spark.createDataFrame(rows, "i int, is_alias boolean, ko string, en string, type string, old string")
    errors = F.when(F.col("is_alias"), alias_errors(F.col("ko"), F.col("en"), F.col("type"))).otherwise(entry_errors(F.col("ko"), F.col("en")))
    found = asked.select("i", errors.alias("errors"), search_key_en(F.col("en")).alias("key"), search_key_en(F.col("old")).alias("old")).collect()  # a row for each change
    return [(r.errors, r.key, r.old) for r in sorted(found, key=lambda r: r.i)]


def _known(seeds: Seeds, changes: list[Change], rules: list[tuple[list[str], str, str]]) -> _Known:
    """Three jobs, over all files: rows come back for the spellings of the names that the changes speak of, and no others."""
    spark = seeds.aliases.sparkSession
    file_of = {type_: file for file, type_ in FILES.items()}
    wanted, triples = set(), set()
    for c, (_, key, old) in zip(changes, rules, strict=True):
        file = file_of.get(_clean(c.row, ["type"])["type"]) if c.file == "aliases" else c.file
        wanted |= {(file, key), (file, old)} if file in seeds.entries else set()
        if c.file == "aliases":
            triples |= {tuple(_clean(x, ALIAS_KEY).values()) for x in (c.row, c.match)}
    known = _Known({}, Counter(), Counter(), {})
    read = {f: seeds.table(f) for f in [*seeds.entries, "aliases"]}
    lasts = reduce(DataFrame.union, (df.agg(F.lit(f).alias("file"), F.max("_seq").alias("last")) for f, df in read.items()))
    known.last = {r.file: -1 if r["last"] is None else r["last"] for r in lasts.collect()}  # a row for each file

    def first(fields: list[str]) -> list[Column]:
        return [F.count(F.lit(1)).alias("n"), F.min_by(F.struct("_seq", *fields), "_seq").alias("first")]

    if wanted:
        rows = reduce(DataFrame.unionByName, (df.select(F.lit(f).alias("_file"), *ENTRY_FIELDS, "_seq") for f, df in read.items() if f != "aliases"))
        usable = (F.trim(F.coalesce("name_en", F.lit(""))) != "") & (F.trim(F.coalesce("name_ko", F.lit(""))) != "")
        rows = rows.withColumns({"_key": search_key_en(F.col("name_en")), "_usable": usable.cast("int")})
        rows = rows.join(F.broadcast(spark.createDataFrame(sorted(wanted), "_file string, _key string")), ["_file", "_key"], "left_semi")  # two rows for a change at most
        for r in rows.groupBy("_file", "_key", "name_en").agg(*first(ENTRY_FIELDS), F.sum("_usable").alias("usable")).collect():
            known.rows[r["_file"], r.name_en or ""] = (r.n, (r["first"]["_seq"], {c: r["first"][c] or "" for c in ENTRY_FIELDS}))
            known.keys[r["_file"], r["_key"]] += r.n
            known.usable[r["_file"], r["_key"]] += r.usable
    if triples:
        asked = F.broadcast(spark.createDataFrame(sorted(triples), ", ".join(f"{c} string" for c in ALIAS_KEY)))
        for r in read["aliases"].join(asked, ALIAS_KEY, "left_semi").groupBy(*ALIAS_KEY).agg(*first(ALIAS_FIELDS)).collect():
            known.rows["aliases", r.alias_ko, r.name_en, r.type] = (r.n, (r["first"]["_seq"], {c: r["first"][c] or "" for c in ALIAS_FIELDS}))
    return known


def _one(known: _Known, change: Change, rule: tuple[list[str], str, str]) -> tuple[int, dict[str, str], dict[str, str] | None]:
    """(_seq, new row, row before or None) of a change, which `known` has afterwards; ChangeError if a rule is broken."""
    errors, key, old_key = rule
    file, is_alias = change.file, change.file == "aliases"
    row = _clean(change.row, ALIAS_FIELDS if is_alias else ENTRY_FIELDS)
    if errors:
        raise ChangeError(f"{errors[0]} breaks a rule of its field", errors[0])
    if is_alias and not known.usable[{type_: f for f, type_ in FILES.items()}[row["type"]], key]:
        raise ChangeError("no entry has the alias's type and name; add the entry first", "name_en")
    if change.action == "add":
        if known.rows.get(_raw_key(file, row), (0,))[0] if is_alias else known.keys[file, key]:
            raise ChangeError("there is such a row already; edit it instead", "alias_ko" if is_alias else "name_en")
        known.last[file] += 1
        place, before = known.last[file], None
    elif change.action == "edit":
        if not change.match:
            raise ChangeError("an edit must name the row it replaces", "match")
        raw = _raw_key(file, _clean(change.match, ALIAS_KEY))
        n, first = known.rows.get(raw, (0, None))
        if n != 1:
            raise ChangeError("several rows match" if n else "no row matches", "match")
        place, before = first
        del known.rows[raw]
        if not is_alias:
            known.keys[file, old_key] -= 1
            known.usable[file, old_key] -= bool(before["name_en"].strip() and before["name_ko"].strip())
    else:
        raise ChangeError(f"unknown action {change.action}", "action")
    n, held = known.rows.get(_raw_key(file, row), (0, None))
    known.rows[_raw_key(file, row)] = (n + 1, min((x for x in (held, (place, row)) if x), key=lambda x: x[0]))
    if not is_alias:
        known.keys[file, key] += 1
        known.usable[file, key] += 1
    return place, row, before


def changed(seeds: Seeds, changes: list[Change]) -> tuple[Seeds, list[dict]]:
    """The seeds after all changes, each made on what those before left, with {before, after} of each; or ChangeError of the first that fails."""
    if not changes:
        raise ChangeError("there are no changes", "changes")
    spark = seeds.aliases.sparkSession
    known_files = {*seeds.entries, "aliases"}
    sound = next((i for i, c in enumerate(changes) if c.file not in known_files), len(changes))
    rules = _rules(spark, changes[:sound]) if sound else []
    known = _known(seeds, changes[:sound], rules) if sound else None
    old_last = dict(known.last) if known else {}
    done = [_one(known, c, rule) for c, rule in zip(changes, rules, strict=False)]
    if sound < len(changes):
        raise ChangeError(f"unknown file {changes[sound].file}", "file")
    final: dict[str, dict[int, dict]] = {}
    for c, (place, row, _) in zip(changes, done, strict=True):
        final.setdefault(c.file, {})[place] = row
    now = seeds
    for file, rows in final.items():
        fields = ALIAS_FIELDS if file == "aliases" else ENTRY_FIELDS
        new = spark.createDataFrame([(*(r[c] for c in fields), place) for place, r in rows.items()], ", ".join(f"{c} string" for c in fields) + ", _seq long")
        added = new.filter(F.col("_seq") > old_last[file])
        edits = F.broadcast(new.select(F.col("_seq").alias("_at"), F.struct(*fields).alias("_new")))  # a row for each change at most
        df = seeds.table(file).join(edits, F.col("_seq") == F.col("_at"), "left")
        df = df.select(*(F.when(F.col("_at").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in fields), "_seq")
        now = now.with_table(file, df.unionByName(added))
    return now, [{"before": before, "after": row} for _, row, before in done]


def apply_change(seeds: Seeds, change: Change) -> tuple[Seeds, dict]:
    """changed() of one change."""
    now, diffs = changed(seeds, [change])
    return now, diffs[0]


@dataclass(frozen=True)
class Result:
    seeds: Seeds
    diffs: list[dict]
    dictionary: Dictionary
    new_issues: DataFrame
    counts: DataFrame


def apply_changes(seeds: Seeds, changes: list[Change]) -> Result:
    """All changes, each on what those before left, or none: the first error ends it. With the issues they add."""
    now, diffs = changed(seeds, changes)
    dictionary = now.build()
    before, after = audit(seeds.build().terms), audit(dictionary.terms)
    return Result(now, [{"file": c.file, "action": c.action, "diff": d} for c, d in zip(changes, diffs, strict=True)], dictionary, new_issues(before, after), issue_counts(before, after))


def upsert(entries: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A batch of rows by name_en as one plan: (entries with rows replaced in place or appended, rejected changes).

    entries and changes have ENTRY_FIELDS and _seq. Fields of changes are trimmed, null is empty. Changes that
    break a field's rule, or whose key an entry of another name has, are rejected with `errors`; of
    several for one name the last holds. For tables of changes of any size; a list that must hold
    as a whole goes to apply_changes().
    """
    changes = changes.select(*(F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ENTRY_FIELDS), "_seq")
    known = entries.select(search_key_en(F.col("name_en")).alias("_k"), F.col("name_en").alias("_name")).groupBy("_k").agg(F.min("_name").alias("_name"))
    checked = changes.withColumn("_key", search_key_en(F.col("name_en"))).join(known, F.col("_key") == F.col("_k"), "left")
    taken = F.when(F.col("_name").isNotNull() & (F.col("_name") != F.col("name_en")), F.array(F.lit("name_en"))).otherwise(F.array().cast("array<string>"))
    checked = checked.withColumn("errors", F.array_distinct(F.concat(entry_errors(F.col("name_ko"), F.col("name_en")), taken)))
    rejected = checked.filter(F.size("errors") > 0).select(*ENTRY_FIELDS, "_seq", "errors")
    good = checked.filter(F.size("errors") == 0).groupBy(F.col("name_en").alias("_n")).agg(F.max_by(F.struct(*ENTRY_FIELDS), "_seq").alias("new"), F.max("_seq").alias("_at"))
    met = entries.join(good, F.col("name_en") == F.col("_n"), "full")
    kept = met.select(*(F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in ENTRY_FIELDS), F.coalesce("_seq", F.col("_at") + (1 << 40)).alias("_seq"))
    return kept, rejected


def describe(diffs: list[dict], new: DataFrame, shown: int = 10) -> str:
    """A change list and the issues it adds, as text for a reviewer."""
    lines = ["Changes"]
    for d in diffs:
        before, after = d["diff"]["before"], d["diff"]["after"]
        lines.append(f"- {d['file']}: {d['action']}")
        lines += [f"  - {k}: {before.get(k, '')} -> {v}" for k, v in after.items() if before.get(k, "") != v] if before else [f"  - {after}"]
    found: dict[str, list[str]] = {}
    for r in new.orderBy("category", "detail").collect():  # what one edit adds
        found.setdefault(r.category, []).append(r.detail)
    lines.append("New issues" if found else "No new issues")
    for category, details in found.items():
        lines += [f"- {category}: {len(details)}", *(f"  - {x}" for x in details[:shown])]
    return "\n".join(lines)


def branch_name(spark, name: str) -> str:
    """A name as part of a path."""
    return spark.range(1).select(slug(F.lit(name))).first()[0]
