"""Personal data by patterns, and by contexts that the patterns' finds induce.

Seeds are what the base patterns find. The words around identifiers are lexical patterns. On
the graph of patterns and instances, patterns earn confidence by the share of their instances
that are known, instances by the patterns they stand in; what scores high enough joins the
known ones, until nothing joins. Identifiers that only contexts give away are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onoma.llm.common import stage, text_or_empty

KINDS = ("email", "ip", "card", "phone")
# Possessive forms of the base patterns. A match can't start inside a run of its first class, but right
# behind another match (\G), so long runs are read once and not once for each of their places.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: A word with a digit or an at sign, and words of digits that follow it.
IDENTIFIER = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[(]?[0-9][0-9().+-]*+)*+"
CONTEXT = 60
SPANS = "array<struct<kind:int,start:int,end:int>>"


def _digits(x: Column) -> Column:
    return F.translate(x, " ().-+", "")


def _is_ip(x: Column) -> Column:
    return x.rlike(rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z")


def _is_card(x: Column) -> Column:
    """16 to 19 digits that pass the Luhn test: from the right, every other digit doubled, digits of that summed."""
    d = F.translate(x, " -", "")
    n = F.length(d)

    def term(i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 1, 2 * v - F.when(v > 4, 9).otherwise(0)).otherwise(v)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + term(i))
    return F.when(n.between(16, 19), total % 10 == 0).otherwise(False)


def _is_phone(x: Column) -> Column:
    return F.length(_digits(x)).between(8, 15)


def _bound(value: Column, body) -> Column:
    """body(value), where value is computed once and not at each use within a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(sizes: Column, block: int = 128) -> Column:
    """Running sums of an array of numbers, each with its own, in time that grows with their number.

    Arrays can only be appended to by copying, so sums run within blocks, and then over the blocks' totals.
    """

    def sums(x: Column) -> Column:
        return F.aggregate(x, F.array().cast("array<int>"), lambda acc, n: F.array_append(acc, n + F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0))))

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.get(p, F.size(p) - 1))
        return _bound(sums(totals), lambda s: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda n: n + F.when(i == 0, 0).otherwise(F.get(s, i - 1))))))

    def blocks(x: Column) -> Column:
        starts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda i: i * block + 1)
        return _bound(F.transform(starts, lambda i: sums(F.slice(x, i, F.lit(block)))), joined)

    return _bound(sizes, lambda x: F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(blocks(x)))


def _ends(hits: Column, gaps: Column) -> Column:
    """Where each hit ends, if gaps and hits follow one another."""
    return _running(F.transform(hits, lambda h, i: F.length(h) + F.length(F.get(gaps, i))))


def _placed(text: Column, pattern: str, kind: int, valid) -> Column:
    """Spans of the matches of a pattern that are valid, as code points."""

    def spans(p: Column) -> Column:
        span = lambda h, i, ends: F.when(valid(h), F.struct(F.lit(kind).alias("kind"), (F.get(ends, i) - F.length(h)).alias("start"), F.get(ends, i).alias("end")))
        return _bound(_ends(p["h"], p["g"]), lambda ends: F.filter(F.transform(p["h"], lambda h, i: span(h, i, ends)), lambda x: x.isNotNull()))

    none = F.array().cast(SPANS)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    cut = lambda h: _bound(F.struct(h.alias("h"), F.split(text, pattern).alias("g")), spans)
    return _bound(hits, lambda h: F.when(F.exists(h, valid), cut(h)).otherwise(none))


def base_spans(text: Column) -> Column:
    """All base spans, by kind and start."""
    none = F.array().cast(SPANS)
    digits = text.rlike("[0-9]")
    return F.concat(
        F.when(text.contains("@"), _placed(text, EMAIL, 0, lambda x: F.lit(True))).otherwise(none),
        F.when(digits, _placed(text, IP, 1, _is_ip)).otherwise(none),
        F.when(digits, _placed(text, CARD, 2, _is_card)).otherwise(none),
        F.when(text.contains("+"), _placed(text, PHONE, 3, _is_phone)).otherwise(none),
    )


def _shape(x: Column) -> Column:
    """The kind whose identifiers look like x, valid or not; null for other words with digits."""
    n, plain = F.length(_digits(x)), x.rlike(r"\A[0-9().+\x20-]+\z")
    return (
        F.when(x.rlike(r"\A[^@\s]+@[^@\s]+\z"), 0)
        .when(x.rlike(r"\A[0-9]+(?:\.[0-9]+){3}\z"), 1)
        .when(plain & n.between(16, 19), 2)
        .when(plain & n.between(7, 15) & x.rlike(r"[\x20().+-]"), 3)
    )


def _known(x: Column, kind: Column) -> Column:
    """Whether a candidate is one that the base patterns find."""
    return (
        F.when(kind == 0, x.rlike(EMAIL))
        .when(kind == 1, _is_ip(x))
        .when(kind == 2, _is_card(x))
        .otherwise(x.startswith("+") & _is_phone(x))
    )


def candidates(text: Column) -> Column:
    """array<struct<start, end, word, before, after>> of identifier-like words and their surroundings."""
    kind = "array<struct<start:int,end:int,word:string,before:string,after:string>>"

    def one(hit: Column, begin: Column, gap: Column, after: Column) -> Column:
        word = F.regexp_extract(hit, r"[0-9A-Za-z+(](?:.*[0-9A-Za-z)])?", 0)
        first = begin + F.length(F.regexp_extract(hit, r"\A[^0-9A-Za-z+(]*+", 0))
        made = F.struct(first.alias("start"), (first + F.length(word)).alias("end"), word.alias("word"), F.substring(gap, -CONTEXT, CONTEXT).alias("before"), F.substring(after, 1, CONTEXT).alias("after"))
        return F.when(_shape(word).isNotNull(), made)

    def words(p: Column) -> Column:
        each = lambda ends: F.transform(p["h"], lambda h, i: one(h, F.get(ends, i) - F.length(h), F.get(p["g"], i), F.get(p["g"], i + 1)))
        return _bound(_ends(p["h"], p["g"]), lambda ends: F.filter(each(ends), lambda x: x.isNotNull()))

    parts = F.struct(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)).alias("h"), F.split(text, IDENTIFIER).alias("g"))
    return F.when(text.rlike("[0-9@]"), _bound(parts, words)).otherwise(F.array().cast(kind))


def occurrences(rows: DataFrame) -> DataFrame:
    """(doc_id, rid, start, end, kind, word, known, patterns) of the candidates in rows(doc_id, rid, cands)."""
    each = rows.select("doc_id", "rid", F.explode("cands").alias("c")).select("doc_id", "rid", "c.*")
    each = each.withColumn("kind", _shape(F.col("word"))).filter("kind is not null")
    before, after = F.array_remove(F.split(F.lower("before"), r"\s+"), ""), F.array_remove(F.split(F.lower("after"), r"\s+"), "")
    one, two, next_ = F.element_at(F.slice(F.concat(F.array(F.lit("^")), before), -1, 1), 1), F.array_join(F.slice(F.concat(F.array(F.lit("^"), F.lit("^")), before), -2, 2), " "), F.coalesce(F.get(after, F.lit(0)), F.lit("$"))
    patterns = F.array(F.concat(F.lit("b:"), two), F.concat(F.lit("a:"), one, F.lit(" _ "), next_))
    return each.select("doc_id", "rid", "start", "end", "kind", "word", _known(F.col("word"), F.col("kind")).alias("known"), patterns.alias("patterns"))


def bootstrap(found: DataFrame, min_known: int = 3, min_confidence: float = 0.6, min_score: float = 0.9) -> DataFrame:
    """(kind, word) of instances that the patterns of occurrences() accept, without the seeds.

    Edges are distinct, so neither copies nor a hot context weigh more than one; sums over a
    pattern are partially aggregated. What is known only grows, and rounds end when one adds nothing.
    """
    edges = stage(found.select("kind", "word", "known", F.explode("patterns").alias("pattern")).distinct(), "edges")
    accepted, n = edges.select("kind", "word").limit(0), 0
    while True:
        new = accepted.select(F.col("kind").alias("_k"), F.col("word").alias("_w"))
        marked = edges.join(new, (F.col("kind") == F.col("_k")) & (F.col("word") == F.col("_w")), "left").withColumn("k", (F.col("known") | F.col("_w").isNotNull()).cast("int")) if n else edges.withColumn("k", F.col("known").cast("int"))
        trust = marked.groupBy("kind", "pattern").agg(F.sum("k").alias("good"), F.count(F.lit(1)).alias("n"))
        trust = trust.withColumn("confidence", F.col("good") / (F.col("n") + 1)).filter((F.col("good") >= min_known) & (F.col("confidence") >= min_confidence))
        score = edges.filter("not known").join(trust.select("kind", "pattern", "confidence"), ["kind", "pattern"]).groupBy("kind", "word").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        accepted = stage(score.filter(F.col("score") >= min_score).select("kind", "word"), "accepted")
        before, n = n, accepted.count()
        if n == before:
            return accepted


def _apart(added: DataFrame, rows: DataFrame, block: int = 64) -> DataFrame:
    """added(doc_id, rid, kind, start, end) without spans that overlap a base span of their row: a join on blocks of characters."""
    key = [F.col("doc_id").eqNullSafe(F.col("_d")), F.col("rid") == F.col("_r")]
    blocks = lambda a, b: F.explode(F.sequence(F.floor(a / block), F.floor((b - 1) / block))).alias("block")
    own = added.select(F.col("doc_id").alias("_d"), F.col("rid").alias("_r")).distinct()
    base = rows.join(own, key, "left_semi").select("doc_id", "rid", F.explode("base").alias("b"))
    base = base.select(F.col("doc_id").alias("_d"), F.col("rid").alias("_r"), F.col("b.start").alias("_a"), F.col("b.end").alias("_b")).distinct()
    base = base.select("*", blocks(F.col("_a"), F.col("_b")).alias("_block"))
    met = added.select("*", blocks(F.col("start"), F.col("end"))).join(base, [*key, F.col("block") == F.col("_block"), F.col("_a") < F.col("end"), F.col("start") < F.col("_b")], "left_semi")
    gone = met.select(F.col("doc_id").alias("_d"), F.col("rid").alias("_r"), F.col("kind").alias("_k"), F.col("start").alias("_a"), F.col("end").alias("_b")).distinct()
    return added.join(gone, [*key, F.col("kind") == F.col("_k"), F.col("start") == F.col("_a"), F.col("end") == F.col("_b")], "left_anti")


def _text(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, **bounds) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of docs(doc_id, text, ...).

    Null texts are empty and have no spans. Counts and base_sha256 are of the base spans, `spans`
    holds the added ones too, but for those that overlap a base span. Rows that repeat a doc_id each
    get the spans of their own text. An empty table gives no rows. Other columns are not read, whatever
    their names. A very long text is one row; time grows with its length and the number of its spans.
    """
    text = text_or_empty()
    rows = stage(docs.select("doc_id", F.xxhash64("doc_id", text).alias("rid"), base_spans(text).alias("base"), candidates(text).alias("cands")), "found")
    found = stage(occurrences(rows), "occurrences")
    accepted = bootstrap(found, **bounds).select(F.col("kind").alias("_k"), F.col("word").alias("_w"))
    added = found.filter("not known").join(accepted, (F.col("kind") == F.col("_k")) & (F.col("word") == F.col("_w")), "left_semi")
    added = stage(added.select("doc_id", "rid", "kind", "start", "end").distinct(), "added")
    lists = _apart(added, rows).groupBy(F.col("doc_id").alias("_d"), F.col("rid").alias("_r")).agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    met = rows.select("doc_id", "rid", "base").join(lists, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("rid") == F.col("_r")), "left")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return met.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(_text(F.col("base")), 256).alias("base_sha256"),
        _text(F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(SPANS))))).alias("spans"),
    )
