"""Batch resolution of free-text queries against a dictionary: stages as joins, short circuits as anti-joins.

A batch is (qid long, text string, th double, type string): type is `all` or a one-letter code. Each
stage is an equi-join on a key, a prefix, a word or a letter group; only fragments that no stage
answers meet the dictionary in the typo stage, by length and one of their rarest letters.
Ranks are windows per fragment and per query, so no list leaves the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onoma.functions import tables as t
from onoma.functions.distance import weighted_distance_within
from onoma.functions.text import flat, has_hangul, has_latin, hangul_to_qwerty, jamo_key, query_key_en, tokens_ko, trimmed
from onoma.operators.index import ANY, Index, beyond, heavy_letters, letter_bits, light_counts, near_band, typo_table
from onoma.sources.staging import stage

TOP = 10
#: Score formulas, (base, weight of the covered share) or a plain score.
EXACT, PREFIX, TOKEN_KO, TOKEN_KO_PREFIX = 1.0, (0.80, 0.20), 0.95, (0.82, 0.13)
TOKEN_EN, TOKEN_EN_PREFIX, INSIDE, HEAD = 0.97, (0.84, 0.13), (0.75, 0.20), 0.95
TOLERANCE_SLACK, TOLERANCE_LOW, TOLERANCE_HIGH = 0.05, 0.55, 0.88


def _cover(score: tuple[float, float], part: Column, whole: Column) -> Column:
    return F.lit(score[0]) + F.lit(score[1]) * (part / whole)


def of_type() -> Column:
    return (F.col("q_type") == "all") | (F.col("type") == F.col("q_type"))


def _best(pushed: DataFrame, length: str) -> DataFrame:
    """(fid, rank, canonical_id, term_seq, score) of (fid, canonical_id, term_seq, score, stage, length): ten per fragment.

    Each canonical keeps its best row, of equals the one found first; equal scores rank by
    length, then by which canonical was found first.
    """
    own = Window.partitionBy("fid", "canonical_id")
    best = pushed.withColumn("first", F.min(F.struct("stage", "term_seq")).over(own))
    best = best.withColumn("_n", F.row_number().over(own.orderBy(F.desc("score"), "stage", "term_seq"))).filter("_n = 1")
    rank = Window.partitionBy("fid").orderBy(F.desc("score"), length, "first")
    return best.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= TOP).select("fid", "rank", "canonical_id", "term_seq", "score", F.col(length).alias("length"))


def _signs(asked: DataFrame, typo: DataFrame, most: Column) -> DataFrame:
    """asked(q_key, q_len, len, ..) with `token`: a row for each letter that a key within `most` of that length may be found by.

    Every heavy letter that one key has and the other lacks costs a whole point, so a key within
    `most` has one of any floor(most) + 1 letters of the query. The rarest in the dictionary are
    asked for (there are as many kinds as the alphabet has letters); a query of fewer letters asks for ANY.
    """
    kinds = typo.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    own = asked.select("q_key").distinct().withColumn("q_tokens", heavy_letters(F.col("q_key")))
    each = own.select("q_key", F.explode("q_tokens").alias("token")).join(kinds, "token", "left")
    order = each.groupBy("q_key").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("o"))
    order = order.select(F.col("q_key").alias("_q"), F.col("o.token").alias("q_tokens"))
    met = asked.join(order, F.col("q_key") == F.col("_q"), "left").drop("_q").withColumn("q_tokens", F.coalesce("q_tokens", F.array().cast("array<string>")))
    met = met.withColumns({"most": most, "q_bits": letter_bits("q_tokens"), "q_light": light_counts(F.col("q_key"))}).withColumn("_p", F.floor("most").cast("int") + 1)
    met = met.withColumn("sign", F.when(F.size("q_tokens") >= F.col("_p"), F.slice("q_tokens", F.lit(1), F.col("_p"))).otherwise(F.array(F.lit(ANY))))
    return met.withColumn("token", F.explode("sign")).drop("_p", "q_tokens")


def _least_distance() -> Column:
    """What the letters alone cost, wherever they stand: of a query (q_bits, q_light) and a key (bits, light).

    Heavy letters that one side lacks cost a point each, and one of each side go for one. Light
    ones cost less, and nothing where a heavy one that is left over is replaced by them.
    """
    gone = F.bit_count(F.col("q_bits").bitwiseAND(F.bitwise_not("bits"))).cast("double")
    new = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not("q_bits"))).cast("double")
    less = [F.get("q_light", i) - F.get("light", i) for i in range(len(t.CHEAP))]
    light_gone, light_new = (sum((F.greatest(sign * x, F.lit(0)) for x in less), F.lit(0)) for sign in (1, -1))
    free = F.when(gone > new, F.least(gone - new, light_new)).otherwise(F.least(new - gone, light_gone))
    return F.greatest(gone, new) + t.CHEAP_COST * (light_gone + light_new - free)


def typo_pairs(asked: DataFrame, typo: DataFrame, most: Column, on: tuple[str, ...] = ("len",)) -> DataFrame:
    """Pairs of asked(q_key, q_len, len, ..) and keys of typo_table() that agree in `on`, with distance d <= most.

    An equi-join on length and a letter of the query. A pair that meets by several letters is kept by the
    first of them; one whose letters alone cost too much needs no table of edits. Both sides are
    tables of known size, so Spark broadcasts a small one and splits what is hot in large ones;
    what is left is dealt evenly before the tables of edits are made.
    """
    signs = stage(_signs(asked, typo, most), "signs")
    met = signs.join(typo, [*on, "token"]).filter(_least_distance() <= F.col("most"))
    met = met.filter(F.when(F.size("sign") == 1, True).otherwise(F.element_at(F.array_intersect("sign", "tokens"), 1) == F.col("token")))
    met = met.drop("sign", "tokens", "bits", "q_bits", "light", "q_light", "token").repartition("q_key", "key")
    return met.withColumn("d", weighted_distance_within("q_key", "key", "most")).filter(~F.isnan("d") & (F.col("d") <= F.col("most")))


def _lengths_ko(asked: DataFrame) -> DataFrame:
    """A row for each length of keys that a spelling is compared with."""
    wide = F.greatest(F.col("q_len") * 0.4, F.lit(3.0))
    band = F.sequence(F.greatest(F.ceil(F.col("q_len") - wide), F.lit(1)).cast("int"), F.floor(F.col("q_len") + wide).cast("int"))
    return asked.withColumn("len", F.explode(band))


def _lengths_en(asked: DataFrame) -> DataFrame:
    """A row for each length of whole names that an original is compared with, and one for heads of its own length."""
    wide = near_band(F.col("q_len"))
    band = F.sequence(F.greatest(F.ceil(F.col("q_len") - wide), F.lit(1)).cast("int"), F.floor(F.col("q_len") + wide).cast("int"))
    whole = F.transform(band, lambda n: F.struct(n.alias("len"), F.lit(False).alias("is_head")))
    heads = F.when(F.col("q_len") >= 3, F.array(F.struct(F.col("q_len").alias("len"), F.lit(True).alias("is_head"))))
    return asked.withColumn("_x", F.explode(F.concat(whole, F.coalesce(heads, F.array().cast("array<struct<len:int,is_head:boolean>>"))))).select(*asked.columns, "_x.*")


def lookup_ko(frags: DataFrame, index: Index) -> DataFrame:
    """(fid, rank, canonical_id, term_seq, score, length) of frags(fid, text, th, q_type, allow_prefix): Korean spellings.

    Exact keys; prefixes of keys, or of words where the key itself has none; else typos. Empty keys find nothing.
    """
    key = F.col("q_key") if "q_key" in frags.columns else jamo_key(F.col("text"))
    q = frags.select("fid", "th", "q_type", "allow_prefix", key.alias("q_key")).filter("q_key <> ''").withColumn("q_len", F.length("q_key"))
    exact = q.join(index.exact_ko, F.col("q_key") == F.col("key")).filter(of_type()).select("fid", "canonical_id", "term_seq", F.lit(EXACT).alias("score"), F.lit(0).alias("stage"), "ko_len")
    open_ = q.filter("allow_prefix and q_len >= 2")
    whole = open_.join(index.prefix_ko, F.col("q_key") == F.col("key")).filter(of_type())
    whole = whole.withColumn("score", _cover(PREFIX, F.col("q_len"), F.col("ko_len")))
    words = open_.join(index.token_ko, F.col("q_key") == F.col("key")).filter(of_type() & ~F.col("key_ko").startswith(F.col("q_key")))
    word = F.when(F.col("token") == F.col("q_key"), F.lit(TOKEN_KO)).otherwise(_cover(TOKEN_KO_PREFIX, F.col("q_len"), F.length("token")))
    words = words.groupBy("fid", "canonical_id", "term_seq", "ko_len", "th").agg(F.max(word).alias("score"))
    columns = ["fid", "canonical_id", "term_seq", "score", F.lit(1).alias("stage"), "ko_len"]
    pushed = exact.union(whole.filter("score >= th").select(*columns)).union(words.filter("score >= th").select(*columns))
    pushed = stage(pushed, "pushed")
    left = q.join(pushed.select("fid").distinct(), "fid", "left_anti")
    near = typo_pairs(_lengths_ko(left.select("q_key", "q_len", "th").distinct()), index.typo_ko, (1 - F.col("th")) * F.greatest("q_len", "len") + 1e-9)
    near = near.withColumn("score", 1 - F.col("d") / F.greatest("q_len", "len")).filter("score >= th").select(F.col("q_key").alias("_q"), F.col("th").alias("_th"), "key", "score")
    typos = left.join(near, (F.col("q_key") == F.col("_q")) & (F.col("th") == F.col("_th"))).drop("_q", "_th").join(index.exact_ko, "key").filter(of_type())
    return _best(pushed.union(typos.select("fid", "canonical_id", "term_seq", "score", F.lit(2).alias("stage"), "ko_len")), "ko_len")


def lookup_en(queries: DataFrame, index: Index) -> DataFrame:
    """(fid, rank, canonical_id, term_seq, score, length) of queries(fid, text, th, q_type): original names.

    Exact keys; for each name the first that fits of prefix, word (queries of one word) and inner
    part; typos only where none of these fits at all, whatever its score.
    """
    key = F.col("words") if "words" in queries.columns else query_key_en(F.col("text"))
    q = queries.select("fid", "th", "q_type", key.alias("words")).filter(F.length("words") >= 2)
    q = q.select("fid", "th", "q_type", "words", flat(F.col("words")).alias("q_key")).withColumn("q_len", F.length("q_key"))
    exact = q.join(index.exact_en, F.col("q_key") == F.col("key")).filter(of_type()).select("fid", "canonical_id", "term_seq", F.lit(EXACT).alias("score"), F.lit(0).alias("stage"), "en_len")
    found = ["fid", "th", "canonical_id", "term_seq", "en_len"]
    whole = q.join(index.prefix_en, F.col("q_key") == F.col("key")).filter(of_type()).select(*found, F.lit(1).alias("branch"), _cover(PREFIX, F.col("q_len"), F.col("flat_len")).alias("score"))
    word = F.when(F.col("token") == F.col("q_key"), F.lit(TOKEN_EN)).otherwise(_cover(TOKEN_EN_PREFIX, F.col("q_len"), F.length("token")))
    words = q.filter("words = q_key").join(index.token_en, F.col("q_key") == F.col("key")).filter(of_type()).select(*found, F.lit(2).alias("branch"), word.alias("score"))
    parts = q.filter("q_len >= 3").withColumn("gram", F.substring("q_key", 1, 3)).join(index.gram_en, "gram")
    parts = parts.filter(of_type() & (F.col("flat_len") > F.col("q_len")) & F.col("flat_en").contains(F.col("q_key"))).select(*found, F.lit(3).alias("branch"), _cover(INSIDE, F.col("q_len"), F.col("flat_len")).alias("score"))
    fits = whole.union(words).union(parts).groupBy(*found).agg(F.min(F.struct("branch", (-F.col("score")).alias("minus"))).alias("x"))
    fits = fits.select("fid", "th", "canonical_id", "term_seq", (-F.col("x.minus")).alias("score"), F.lit(1).alias("stage"), "en_len")
    fits = stage(fits, "fits")
    pushed = exact.union(fits.filter("score >= th").drop("th"))
    left = q.join(exact.select("fid").union(fits.select("fid")).distinct(), "fid", "left_anti")
    tolerance = F.least(F.greatest(F.col("th") - TOLERANCE_SLACK, F.lit(TOLERANCE_LOW)), F.lit(TOLERANCE_HIGH))
    asked = left.select("q_key", "q_len", "th").distinct().withColumn("tol", tolerance)
    # a name too long to be compared whole is compared by its head; heads are shared by many names, so each is compared once
    longer = F.when(F.col("is_head"), F.col("q_len")).otherwise(F.greatest("q_len", "len"))
    near = typo_pairs(_lengths_en(asked), index.typo_en, (1 - F.col("tol")) * longer + 1e-9, ("is_head", "len"))
    near = near.filter(~F.col("is_head") | (F.col("longest") >= beyond(F.col("q_len")))).withColumn("score", 1 - F.col("d") / longer).filter("score >= tol")
    near = stage(near.select(F.col("q_key").alias("_q"), F.col("th").alias("_th"), F.col("q_len").alias("_n"), "is_head", "key", "score"), "near")
    hit = left.join(near, (F.col("q_key") == F.col("_q")) & (F.col("th") == F.col("_th")))
    found = ["fid", "canonical_id", "term_seq", "score", "en_len"]
    typos = hit.filter("not is_head").join(index.exact_en, "key").filter(of_type()).select(*found)
    by_head = hit.filter("is_head").join(index.prefix_en, "key").filter(of_type() & (F.col("flat_len") >= beyond(F.col("_n")))).withColumn("score", F.col("score") * HEAD).select(*found)
    typos = typos.union(by_head)
    return _best(pushed.union(typos.select("fid", "canonical_id", "term_seq", "score", F.lit(2).alias("stage"), "en_len")), "en_len")


def fragments(queries: DataFrame, most: int = 3) -> DataFrame:
    """(qid, fno, text, is_full, allow_prefix, th, q_type): the text, and runs of three, two and one of its words.

    A text of one word is one fragment that may be a prefix, and not marked full. Of the runs only the
    last single word may be a prefix; runs of one character are left out.
    """
    q = queries.select("qid", "text", "th", "q_type", tokens_ko(F.col("text")).alias("w")).withColumn("n", F.size("w"))

    def runs_of(k: int) -> Column:
        made = F.transform(
            F.sequence(F.lit(0), F.col("n") - k),
            lambda i: F.struct(F.array_join(F.slice("w", i + 1, F.lit(k)), " ").alias("text"), F.lit(False).alias("is_full"), ((i + k == F.col("n")) & (F.lit(k) == 1)).alias("allow_prefix")),
        )
        return F.when((F.col("n") >= k) & (F.col("n") > 1), made).otherwise(F.array().cast("array<struct<text:string,is_full:boolean,allow_prefix:boolean>>"))

    parts = [runs_of(k) for k in range(most, 0, -1)]
    whole = F.array(F.struct(F.col("text").alias("text"), (F.col("n") > 1).alias("is_full"), F.lit(True).alias("allow_prefix")))
    runs = F.filter(F.concat(*parts), lambda f: F.length(flat(f["text"])) >= 2)
    return q.select("qid", "th", "q_type", F.posexplode(F.concat(whole, runs)).alias("fno", "f")).select("qid", "fno", "f.*", "th", "q_type")


def scan_ko(queries: DataFrame, index: Index) -> DataFrame:
    """(qid, rank, canonical_id, term_seq, score, frag, is_full) of queries(qid, text, th, q_type).

    A canonical keeps its hit of the full text, else its best fragment, of equals the first; hits of
    the full text rank before all others.
    """
    # keys are made once and written, not once for each join that reads them
    frags = stage(fragments(queries).withColumns({"fid": F.struct("qid", "fno"), "q_key": jamo_key(F.col("text"))}), "fragments")
    hits = lookup_ko(frags, index)
    hits = hits.select("fid.*", "rank", "canonical_id", "term_seq", "score", "length").join(frags.select("qid", "fno", F.col("text").alias("frag"), "is_full"), ["qid", "fno"])
    own = Window.partitionBy("qid", "canonical_id")
    kept = hits.withColumn("first", F.min(F.struct("fno", "rank")).over(own))
    kept = kept.withColumn("_n", F.row_number().over(own.orderBy(F.desc("is_full"), F.desc("score"), "fno"))).filter("_n = 1")
    rank = Window.partitionBy("qid").orderBy(F.desc("is_full"), F.desc("score"), "length", "first")
    return kept.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= TOP).select("qid", "rank", "canonical_id", "term_seq", "score", "frag", "is_full")


def scan(queries: DataFrame, index: Index) -> DataFrame:
    """(qid, rank, canonical_id, term_seq, score, frag, is_full, via, typed): every query by the script it is written in.

    Latin queries are looked up as original names, and as spellings if that finds none. Hangul queries are
    spellings; if none fits, what was typed on a Latin keyboard is looked up. Others are spellings. Blank queries find nothing.
    """
    q = queries.select("qid", trimmed(F.col("text")).alias("text"), F.col("th").cast("double").alias("th"), F.col("type").alias("q_type")).filter("text <> ''")
    # what a branch found decides what the next one sees, so each is written once and not planned again in all that follow
    q = stage(q.withColumn("hangul", has_hangul(F.col("text"))).withColumn("latin", has_latin(F.col("text")) & ~F.col("hangul")).withColumn("words", query_key_en(F.col("text"))), "queries")
    none = F.lit(None).cast("string")
    columns = ["qid", "rank", "canonical_id", "term_seq", "score"]

    def originals(some: DataFrame, via: str, typed: Column) -> DataFrame:
        found = lookup_en(some.withColumnRenamed("qid", "fid"), index).withColumnRenamed("fid", "qid").select(*columns)
        said = some.select("qid", typed.alias("typed"))
        return found.join(said, "qid").select(*columns, none.alias("frag"), F.lit(False).alias("is_full"), F.lit(via).alias("via"), "typed")

    latin = stage(originals(q.filter("latin"), "en", none), "latin")
    rest = q.join(latin.select("qid").distinct(), "qid", "left_anti")
    spelled = stage(scan_ko(rest.select("qid", "text", "th", "q_type"), index).select(*columns, "frag", "is_full", F.lit("ko").alias("via"), none.alias("typed")), "spelled")
    mistyped = rest.filter("hangul").join(spelled.select("qid").distinct(), "qid", "left_anti").withColumn("text", hangul_to_qwerty(F.col("text"))).filter(F.length("text") >= 2)
    mistyped = stage(mistyped.withColumn("words", query_key_en(F.col("text"))), "mistyped")
    keyboard = originals(mistyped, "kbd", F.col("text"))
    return reduce(DataFrame.union, (latin, spelled, keyboard))


def index_lookup(queries: DataFrame, entries: DataFrame, threshold: float = 0.82, top: int = 5) -> DataFrame:
    """(qid, rank, name_ko, name_original, score) of queries(qid, text) in entries(seq, name_ko, name_original).

    All entries of the same key at 1.0, without a limit; else the `top` nearest, scores rounded to three places, half to even.
    """
    keys = entries.select("seq", "name_ko", "name_original", jamo_key(F.col("name_ko")).alias("key"))
    q = queries.select("qid", jamo_key(F.col("text")).alias("q_key")).withColumn("q_len", F.length("q_key"))
    exact = q.join(keys, F.col("q_key") == F.col("key")).select("qid", "seq", "name_ko", "name_original", F.lit(1.0).alias("score"), F.lit(True).alias("same"))
    left = q.join(exact.select("qid").distinct(), "qid", "left_anti")
    typo = typo_table(keys.select("key", F.length("key").alias("len")).distinct())
    near = typo_pairs(_lengths_ko(left.filter("q_len > 0").select("q_key", "q_len").distinct()), typo, (1 - F.lit(threshold)) * F.greatest("q_len", "len") + 1e-9)
    near = near.withColumn("score", 1 - F.col("d") / F.greatest("q_len", "len")).filter(F.col("score") >= threshold).select("q_key", "key", F.bround("score", 3).alias("score"))
    fuzzy = left.join(near, "q_key").join(keys, "key").select("qid", "seq", "name_ko", "name_original", "score", F.lit(False).alias("same"))
    ranked = exact.union(fuzzy).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "seq")))
    return ranked.filter(F.col("same") | (F.col("rank") <= top)).select("qid", "rank", "name_ko", "name_original", "score")


def hit_rate(queries: DataFrame, hits: DataFrame, top: int = 3) -> tuple[DataFrame, DataFrame]:
    """The first `top` hits of each query, and (n_queries, n_hit, hit_rate): the share of queries with any hit."""
    first = hits.filter(F.col("rank") <= top)
    any_ = hits.select("qid").distinct().withColumn("hit", F.lit(1))
    rate = queries.select("qid").join(any_, "qid", "left").agg(F.count(F.lit(1)).alias("n_queries"), F.count("hit").alias("n_hit"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("hit_rate"))
    return first, rate
