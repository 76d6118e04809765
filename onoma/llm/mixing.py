"""Mixing sources to target weights by Sainte-Laguë apportionment of words.

Each source's documents are laid end to end in a seeded order, in shards of a bounded number
of documents. Words are the seats of an apportionment (blocks of one word, so that small sources
are met too): first among sources, by their targets, then among the shards of each source, by
size. A shard then takes whole rounds of all its words and, for the rest, a run of words from a
seeded start. Seats are not enumerated, so their number costs nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onoma.llm.common import TOKEN, stage, text_or_empty


def sainte_lague(parties: DataFrame, group: list[str], votes: str, seats: str, key: list[str]) -> DataFrame:
    """parties + `quota`: the `seats` of each group go to the parties with the highest quotients votes / (2k + 1).

    With S parties, V votes and N seats the last divisor lies between V / (N + S/2) and
    V / (N - S/2), as rounding moves each party by half a seat at most. So quotients above that
    span win unseen, and only about 2 S of them are ranked, however many seats there are.
    Ties go by `key`, which must tell the parties of a group apart.
    """
    g = Window.partitionBy(*group)
    n, v = F.col(seats).cast("double"), F.col(votes).cast("double")
    party = parties.withColumns({"_v": F.sum(v).over(g), "_s": F.count(F.lit(1)).over(g)})
    low = F.floor(v * F.greatest(n - F.col("_s") / 2, F.lit(0.0)) / F.col("_v") - 0.5)
    high = F.ceil(v * (n + F.col("_s") / 2) / F.col("_v") + 0.5)
    party = party.withColumns({"_low": F.when(v > 0, F.greatest(low, F.lit(0))).otherwise(0).cast("long"), "_high": F.when(v > 0, high).otherwise(0).cast("long")})
    tried = party.filter("_high > _low").select(*group, *key, votes, seats, "_low", F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_k"))
    tried = tried.withColumn("_q", v / (2 * F.col("_k") + 1))
    order = Window.partitionBy(*group).orderBy(F.desc("_q"), *key, "_k")
    sure = party.groupBy(*group).agg(F.sum("_low").alias("_sure"))
    won = (
        tried.withColumn("_rank", F.row_number().over(order))
        .join(sure.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), "_sure"), [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)])
        .filter(F.col("_rank") <= F.col(seats) - F.col("_sure"))
        .groupBy(*(F.col(c).alias(f"_w{i}") for i, c in enumerate([*group, *key])))
        .agg(F.count(F.lit(1)).alias("_won"))
    )
    on = [F.col(c).eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate([*group, *key])]
    return party.join(won, on, "left").withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0))).select(*parties.columns, "quota")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size, n_docs, target): one row per source of sizes(source, size).

    Sources by code point, null last, take the weights in turn. Targets are min(cap, level x weight),
    the fixed point of resharing what is above the caps; the level follows from running sums by cap / weight.
    The unpartitioned windows hold one row per source, not per document.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    turn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("_w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn % len(weights) + 1).cast("int")))
    by = by.withColumns({"_cap": F.col("source_size") * F.lit(float(most)), "_turn": turn})
    whole = Window.partitionBy(F.lit(0))
    order = whole.orderBy(F.col("_cap") / F.col("_w"), "_turn").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumns({"_total": F.sum("source_size").over(whole).cast("double"), "_all_w": F.sum("_w").over(whole), "_caps": F.coalesce(F.sum("_cap").over(order), F.lit(0.0)), "_ws": F.coalesce(F.sum("_w").over(order), F.lit(0.0))})
    by = by.withColumn("_level", (F.col("_total") - F.col("_caps")) / (F.col("_all_w") - F.col("_ws")))
    # the first source, by cap / weight, that its level does not fill sets the level of all that follow
    level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "_turn", "_level"))).over(whole)["_level"]
    by = by.withColumn("target", F.least("_cap", F.coalesce(level * F.col("_w"), F.col("_cap"))))
    return by.select("source", "source_size", "n_docs", "target")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 20, docs_per_shard: int = 4096) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs(doc_id, text, source, ...).

    Shards hold about docs_per_shard documents of a source, dealt by hash, so the windows that lay documents end to
    end stay small whatever share one source has. Null texts and texts without words have size 0
    and take 0; a null source is a source. Rows that repeat a doc_id are separate rows. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    key = F.xxhash64(F.lit(seed), "doc_id", "text").alias("_key")
    sizes = stage(docs.select("doc_id", "source", F.regexp_count(text_or_empty(), F.lit(TOKEN)).cast("long").alias("size"), key), "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    seats = F.lit(total).cast("long")
    targets = stage(source_targets(sizes, weights, most).withColumn("_one", F.lit(0)), "targets")
    quotas = sainte_lague(targets.withColumn("_seats", seats), ["_one"], "target", "_seats", ["source"])
    quotas = quotas.select("source", "source_size", "target", F.col("quota").alias("_quota"), F.ceil(F.col("n_docs") / docs_per_shard).alias("_shards"))
    quotas = stage(quotas, "quotas")
    bounded = quotas.count() <= 1_000_000  # one row per source, below 100 bytes each
    q = quotas.withColumnRenamed("source", "_source")
    rows = sizes.join(F.broadcast(q) if bounded else q, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    rows = rows.withColumn("_shard", F.pmod(F.shiftright("_key", 20), "_shards"))
    shards = rows.groupBy("source", "_shard").agg(F.sum("size").alias("_shard_size"), F.first("_quota").alias("_quota"))
    shards = sainte_lague(shards, ["source"], "_shard_size", "_quota", ["_shard"])
    n = F.greatest(F.col("_shard_size"), F.lit(1))
    shards = shards.withColumns({"_n": n, "_take": F.least(F.col("quota"), n * most)})
    shards = shards.select(F.col("source").alias("_s"), F.col("_shard").alias("_h"), "_shard_size", "_n", "_take")
    own = Window.partitionBy("source", "_shard").orderBy("_key", "doc_id", "size")
    rows = rows.withColumn("_end", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(shards, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_h")), "left")
    rounds, rest = F.floor(F.col("_take") / F.col("_n")), F.col("_take") % F.col("_n")
    first = F.pmod(F.xxhash64(F.lit(seed), "source", "_shard"), "_n")
    rows = rows.withColumns({"_rounds": rounds, "_from": first, "_to": F.least(first + rest, F.col("_shard_size")), "_wrap": F.greatest(first + rest - F.col("_n"), F.lit(0))})

    def shared(a: Column, b: Column) -> Column:
        """Words of the document between positions a and b of its shard."""
        return F.greatest(F.least(F.col("_end"), b) - F.greatest(F.col("_end") - F.col("size"), a), F.lit(0))

    taken = F.col("_rounds") * F.col("size") + shared(F.col("_from"), F.col("_to")) + shared(F.lit(0), F.col("_wrap"))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
