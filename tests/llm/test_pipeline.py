"""The pipeline stage by stage against brute force, each on its own input."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from onoma.llm.quality import Bands
from onoma.llm.queries import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("steps") / name)
        f(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_return_the_columns_of_documents(spark, steps):
    columns = spark.read.parquet(f"{SF}/documents.parquet").dtypes
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "simhash", "decontamination", "mixing"]
    for _, after in steps[:-1]:
        assert after.dtypes == columns


def test_quality_drops_what_it_rejects(steps):
    before, after = map(rows, steps[0])
    kept = {d for d, r in before.items() if brute.kept(r.text, Bands())}
    assert set(after) == kept and all(after[d] == before[d] for d in kept)
    assert kept == {d for d, r in before.items() if not brute.quality(r.text)[-1]}  # clean documents of the table stay


def test_lines_go(steps):
    before, after = map(rows, steps[1])
    hot = brute.hot_lines((d, r.text) for d, r in before.items())
    for d, r in before.items():
        text = "\n".join(x for x in r.text.split("\n") if brute.line_key(x) not in hot)
        assert (after[d].text, after[d].n_chars, after[d].source, after[d].lang) == (text, len(text), r.source, r.lang)


def test_one_document_of_each_group_stays(steps):
    before, after = map(rows, steps[2])
    ids = sorted(before)
    least = brute.components(ids, [brute.fingerprint(before[d].text) for d in ids])
    assert set(after) == set(least) and all(after[d] == before[d] for d in after)


def test_contaminated_documents_go(steps):
    before, after = map(rows, steps[3])
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    assert set(after) == {d for d, r in before.items() if not brute.contaminated(r.text, items)[-1]}
    assert len(after) < len(before)


def test_the_mix_meets_its_targets(spark, steps):
    before, after = steps[4]
    target = brute.targets((r.source, len(brute.TOKEN.findall(r.text))) for r in before.collect())
    found = after.join(before.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    for r in found:
        assert r.target == pytest.approx(target[r.source]) and abs(r.taken - r.target) <= 3
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, after.collect()))


def test_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs, SF).count() == 0


def test_stages_on_odd_rows(spark, corpus):
    """Nulls, empty and very long texts, ties, repeated rows and columns of clashing names, in every stage."""
    odd, docs = corpus
    stages = dict(corpus_pipeline.STAGES)
    bag = lambda df: Counter((r.doc_id, r.text, r.lang, r.source) for r in df.collect())
    assert bag(stages["quality"](spark, docs, SF)) == Counter((d, t, lang, s) for d, t, lang, s, *_ in odd if brute.kept(t, Bands()))
    hot = brute.hot_lines((r[0], r[1]) for r in odd)
    reduced = Counter((d, "\n".join(x for x in (t or "").split("\n") if brute.line_key(x) not in hot), lang, s) for d, t, lang, s, *_ in odd)
    assert bag(stages["line_dedup"](spark, docs, SF)) == reduced
    least = brute.components([r[0] for r in odd], [brute.fingerprint(r[1]) for r in odd])
    assert bag(stages["simhash"](spark, docs, SF)) == Counter(tuple(r[:4]) for r, c in zip(odd, least, strict=True) if r[0] in (None, c))
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    gone = {r[0] for r in odd if brute.contaminated(r[1], items)[-1]}
    assert bag(stages["decontamination"](spark, docs, SF)) == Counter(tuple(r[:4]) for r in odd if r[0] not in gone)
    mixed = stages["mixing"](spark, docs, SF).collect()
    assert Counter((r.doc_id, r["size"]) for r in mixed) == Counter((r[0], len(brute.TOKEN.findall(r[1] or ""))) for r in odd)
    assert all(0 <= r.taken <= 3 * r["size"] for r in mixed)


def test_registered_queries_return_their_columns(spark):
    expected = {
        "op1_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        "op2_html_text": ["page_id", "url", "text", "n_chars"],
        "op3_mixing": ["doc_id", "size", "source_size", "target", "taken"],
        "op4_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        "op5_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        "op6_simhash": ["doc_id", "fingerprint", "component_id"],
        "op7_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        "op8_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op9_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        "op10_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    }
    assert list(QUERIES)[:10] == list(expected)
    for name, columns in expected.items():
        assert QUERIES[name](spark, SF).columns == columns
