"""License scans: phrases on whole texts, and an exact set-similarity join of lines and word windows with templates.

Tokens are ordered by the number of documents that hold them, rarest first. A line that
contains a share `threshold` of a template's tokens has one of the template's rarest ones
(prefix), enough tokens of its own (length), and enough left after the first that is shared
(position), so only lines that pass these three are compared in full. Notices wrapped over
lines are found in windows of words that ignore line breaks, by the same prefix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onoma.llm.common import RAW_SEPARATOR, ascii_lower, count_words, python_words, text_or_empty, words_of

# The phrases of the scan, each with its label.
PHRASES = {
    "gpl": "gnu general public license",
    "apache": "apache license",
    "cc-by": "cc by",
    "mit": "mit license",
}

#: License notices by label, as sentences. Of each, tokens count once, in any order. A notice of fewer than ten
#: must stand whole at the usual threshold, so names that differ by one word are told apart.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "all rights reserved unauthorized copying of this file via any medium is strictly prohibited"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
)


def _anywhere(phrases: list[str], ahead: bool = False) -> str:
    """A pattern for any of the phrases as whole words of raw text, or for the place before one."""
    any_ = "|".join((RAW_SEPARATOR + "+").join(p.split(" ")) for p in phrases)
    body = f"(?:{any_})(?![^{RAW_SEPARATOR[1:]})"
    return f"(?i)(?<![^{RAW_SEPARATOR[1:]})" + (f"(?={body})" if ahead else body)


def phrase_places(text: Column) -> Column:
    """Words before the first phrase, between phrases and after the last start: one entry more than phrases.

    The text is cut before each phrase. Each cut is between words, so counts of the pieces add up.
    """
    places = _anywhere(list(PHRASES.values()), ahead=True)
    pieces = F.split(F.concat(F.lit("\n"), text), places)  # a cut is never at the start, where it would be dropped
    return F.when(text.rlike(_anywhere(list(PHRASES.values()))), F.transform(pieces, lambda x: count_words(x))).otherwise(F.array(count_words(text)))


def token_ranks(docs: DataFrame, tokens: list[str]) -> dict[str, int]:
    """The tokens in global order, rarest first: rank from 1. Counts cover all documents; rows are one per token."""
    held = docs.select(F.array_intersect(words_of(text_or_empty()), F.array(*map(F.lit, tokens))).alias("held"))
    held = held.select(F.explode_outer("held").alias("token"))  # the inner form would add a filter that splits all texts again
    counts = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}  # len(tokens) rows at most, and null
    return {t: i + 1 for i, t in enumerate(sorted(tokens, key=lambda t: (counts.get(t, 0), t)))}


def template_tokens(templates=TEMPLATES) -> list[str]:
    return sorted({t for _, text in templates for t in python_words(text)})


def template_matches(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.9, ranks: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, line, label, containment) of each line of docs(doc_id, text) and template that meet the threshold."""
    spark = docs.sparkSession
    sets = [(label, sorted(set(python_words(text)))) for label, text in templates]
    ranks = ranks or token_ranks(docs, template_tokens(templates))
    rows = []
    for label, own in sets:
        order, need = sorted(ranks[t] for t in own), math.ceil(threshold * len(own))
        rows += [(label, order, need, rank, i) for i, rank in enumerate(order[: len(order) - need + 1])]
    prefixes = spark.createDataFrame(rows, "label string, template array<int>, need int, rank int, i int")
    words = {rank: t for t, rank in ranks.items()}
    heads = sorted({words[r[3]] for r in rows})
    by_rank = F.array(*(F.lit(words[i + 1]) for i in range(len(words))))
    least = min(r[2] for r in rows)
    any_head = _anywhere(heads)
    lines = docs.select("doc_id", text_or_empty().alias("text")).filter(F.col("text").rlike(any_head))
    lines = lines.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).filter(F.col("text").rlike(any_head))
    held = F.array_intersect(F.split(ascii_lower(F.col("text")), RAW_SEPARATOR + "+"), by_rank)
    blocks = lines.select("doc_id", "line", held.alias("held")).filter(F.size("held") >= least)
    blocks = blocks.select("doc_id", "line", F.array_sort(F.transform("held", lambda t: F.array_position(by_rank, t).cast("int"))).alias("block"))
    tokens = blocks.select("doc_id", "line", "block", F.posexplode("block").alias("j", "_rank"))
    pairs = tokens.join(F.broadcast(prefixes), F.col("_rank") == F.col("rank"))  # as many rows as the template list has prefix tokens
    room = F.least(F.size("template") - F.col("i"), F.size("block") - F.col("j"))  # tokens from the shared one on
    pairs = pairs.filter((F.size("block") >= F.col("need")) & (F.col("j") <= F.size("block") - F.col("need")) & (room >= F.col("need") - F.least("i", "j")))
    shared = F.size(F.array_intersect("block", "template"))
    found = pairs.filter(shared >= F.col("need")).select("doc_id", "line", "label", (shared / F.size("template")).alias("containment"))
    return found.distinct()


def wrapped_matches(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.9, stretch: int = 2, ranks: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, label, containment): the most that a window of words holds of a template, where it meets the threshold.

    Windows run over line breaks and have `stretch` times as many words as the template. A window
    that meets the threshold holds a prefix token, so only words near one are looked at, and a
    row holds no more than the words a window can reach however long the document is.
    """
    ranks = ranks or token_ranks(docs, template_tokens(templates))
    rows = []
    for label, text in templates:
        words = python_words(text)
        order = sorted(ranks[t] for t in set(words))
        need = math.ceil(threshold * len(order))
        rows += [(label, order, need, rank, stretch * len(words)) for rank in order[: len(order) - need + 1]]
    prefixes = docs.sparkSession.createDataFrame(rows, "label string, template array<int>, need int, rank int, reach int")
    words = {rank: t for t, rank in ranks.items()}
    heads = sorted({r[3] for r in rows})
    by_rank = F.array(*(F.lit(words[i + 1]) for i in range(len(words))))
    most = max(r[4] for r in rows)
    texts = docs.select("doc_id", text_or_empty().alias("text")).filter(F.col("text").rlike(_anywhere([words[h] for h in heads])))
    held = F.transform(words_of(F.col("text")), lambda w, i: F.struct(i.alias("at"), F.array_position(by_rank, w).cast("int").alias("rank")))
    held = texts.select("doc_id", F.filter(held, lambda x: x["rank"] > 0).alias("held"))
    hits = held.select("doc_id", "held", F.posexplode("held").alias("_i", "_hit")).filter(F.col("_hit.rank").isin(heads))
    start = F.greatest(F.col("_i") - most, F.lit(0)) + 1  # words of `held` are apart by one at least
    hits = hits.select("doc_id", F.col("_hit.at").alias("at"), F.col("_hit.rank").alias("_rank"), F.slice("held", start, 2 * most + 1).alias("near"))
    pairs = hits.join(F.broadcast(prefixes), F.col("_rank") == F.col("rank"))
    near = F.filter("near", lambda x: F.array_contains("template", x["rank"]) & (F.abs(x["at"] - F.col("at")) < F.col("reach")))
    pairs = pairs.select("doc_id", "label", "template", "need", "reach", near.alias("near")).filter(F.size(F.array_distinct("near.rank")) >= F.col("need"))

    def shared(s: Column) -> Column:
        """How many tokens stand in the window that starts at s."""
        own = F.filter("near", lambda x: (x["at"] >= s["at"]) & (x["at"] < s["at"] + F.col("reach")))
        return F.size(F.array_distinct(F.transform(own, lambda x: x["rank"])))

    found = pairs.select("doc_id", "label", "need", F.size("template").alias("_all"), F.array_max(F.transform("near", shared)).alias("_shared"))
    found = found.filter("_shared >= need").select("doc_id", "label", (F.col("_shared") / F.col("_all")).alias("containment"))
    return found.groupBy("doc_id", "label").agg(F.max("containment").alias("containment"))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.9) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs(doc_id, text, ...).

    A null text is empty: no words, no labels, score 0. score is 1 where a phrase stands, else the
    greatest containment found in a line or in a window over lines. Rows that repeat a doc_id
    share the labels of its lines. An empty table gives no rows. Other columns are not read, whatever
    their names. Of a very long text only words near a template's rare ones go on as rows.
    """
    docs = docs.select("doc_id", "text")
    text = text_or_empty()
    base = docs.select("doc_id", phrase_places(text).alias("_n"), F.array_sort(F.filter(F.array(*(F.when(text.rlike(_anywhere([p])), F.lit(label)) for label, p in PHRASES.items())), lambda x: x.isNotNull())).alias("_base"))
    # the labels are read off the text only where phrases stand
    n_words = F.aggregate("_n", F.lit(0).cast("long"), lambda a, x: a + x)
    base = base.select("doc_id", "_base", n_words.alias("n_words"), (F.size("_n") - 1).cast("long").alias("n_base"), F.element_at("_n", 1).alias("_first"), F.element_at("_n", -1).alias("_tail"))
    ranks = token_ranks(docs, template_tokens(templates))
    found = template_matches(docs, templates, threshold, ranks).select("doc_id", "label", "containment")
    found = found.unionByName(wrapped_matches(docs, templates, threshold, ranks=ranks))
    more = found.groupBy(F.col("doc_id").alias("_d")).agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_most"))
    joined = base.join(more, F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    labels = F.array_sort(F.array_union("_base", F.coalesce("_more", F.array().cast("array<string>"))))
    some = F.col("n_base") > 0
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        F.when(some, F.col("_first")).alias("first_word"),
        F.when(some, F.col("n_words") - F.col("_tail")).alias("last_word"),
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(some, 1.0).otherwise(F.coalesce("_most", F.lit(0.0))).alias("score"),
    )
