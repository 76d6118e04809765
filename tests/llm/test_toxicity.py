"""The field against enumeration, and held-out accuracy."""

import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from onoma.llm import toxicity
from onoma.llm.toxicity import Chains, Toxicity, is_held_out, score_toxicity, train


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    lengths = np.array([3, 1, 5, 2])
    emission = rng.normal(size=lengths.sum()) * 2
    start, change = 0.3, rng.normal(size=(2, 2))
    p, pairs = Chains(lengths).marginals(emission, start, change)
    expected, expected_pairs, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        e = emission[at : at + n]
        at += n
        total, own, moves = 0.0, np.zeros(n), np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(start * tags[0] + sum(e[i] for i in range(n) if tags[i]) + sum(change[a, b] for a, b in zip(tags, tags[1:], strict=False)))
            total += w
            own += w * np.array(tags)
            for a, b in zip(tags, tags[1:], strict=False):
                moves[a, b] += w
        expected += list(own / total)
        expected_pairs += moves / total
    assert np.allclose(p, expected) and np.allclose(pairs, expected_pairs)


def _corpus(n, seed):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(chr(97 + int(x)) for x in rng.integers(0, 26, 6)) for _ in range(400)]
    texts, marks = [], []
    for i in range(n):
        words = [vocabulary[int(x)] for x in rng.integers(0, 400, 60)]
        bad = i % 5 == 0
        if bad:
            for at in rng.integers(0, 60, 3):
                words[int(at)] = ["nasty", "vilest" + vocabulary[int(rng.integers(0, 400))][:2], "Rotten!"][int(rng.integers(0, 3))]
        texts.append(" ".join(words[:30]) + ".\n" + " ".join(words[30:]))
        marks.append(int(bad))
    return texts, marks


def test_training_generalises():
    model = train(*_corpus(600, 1))
    texts, marks = _corpus(300, 1)
    got = [float(model.score(*toxicity.summary(model.tag(x := toxicity.lines_of(t)), [sum(map(len, x))]))[0]) for t in texts]
    assert np.mean([(s >= 0.7) == bool(m) for s, m in zip(got, marks, strict=True)]) > 0.97
    assert model.emission("vilestqq") > 0 > model.emission("quiet")


def test_one_class_gives_a_constant():
    assert train(["a b"], [0]).score(np.array([0.0, 1.0]), np.zeros(2)).tolist() == pytest.approx([0.0, 0.0], abs=1e-5)
    assert isinstance(train([], []), Toxicity)


def test_scores_spans_and_odd_rows(spark, corpus, nothing):
    texts, marks = _corpus(500, 4)
    rows = [(5000 + i, t) for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(d, 1, m) for (d, _), m in zip(rows, marks, strict=True)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    docs = corpus[1].select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = score_toxicity(docs, labels).collect()
    assert len(got) == len(rows) + len(corpus[0])
    assert all(0 <= r.score <= 1 and r.held_out == is_held_out(r.doc_id) for r in got if r.doc_id is not None)
    text = dict(rows)
    for r in got:
        if r.doc_id in text and marks[r.doc_id - 5000] and r.spans:
            assert {text[r.doc_id][s.start : s.end].lower()[:5] for s in r.spans} <= {"nasty", "viles", "rotte"}
    held = [(r.score >= 0.7) == bool(marks[r.doc_id - 5000]) for r in got if r.doc_id in text and r.held_out]
    assert np.mean(held) > 0.95
    assert score_toxicity(nothing, labels).count() == 0
    assert score_toxicity(corpus[1], labels.limit(0)).select("score").distinct().count() == 1


def test_held_out_rule(spark):
    rows = spark.range(50).select("id", (F.crc32(F.col("id").cast("string")) % 3 == 1).alias("h")).collect()
    assert all(r.h == is_held_out(r.id) for r in rows)


def test_held_out_accuracy_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r.score for r in score_toxicity(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).filter("held_out").collect()}
    marks = [x for x in duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall() if x[0] in got]
    assert np.mean([(got[d] >= 0.7) == bool(m) for d, m in marks]) > 0.93
