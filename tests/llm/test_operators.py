"""Each operator against brute force, on odd rows and the smallest table."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from onoma.llm import decontamination, simhash, suffix_dedup
from onoma.llm.components import connected_components
from onoma.llm.decontamination import decontaminate, drop_contaminated
from onoma.llm.license_scan import scan_licenses
from onoma.llm.line_dedup import line_dedup
from onoma.llm.mixing import mix_sources, sainte_lague
from onoma.llm.pii import find_pii
from onoma.llm.quality import Bands, quality_rules, repeated_words, verdict
from tests.llm import brute


def same(got, expected):
    """Equal as bags of rows."""
    assert Counter(map(tuple, got)) == Counter(map(tuple, expected))


def test_pii_base_spans(corpus):
    rows, docs = corpus
    got = find_pii(docs).collect()
    expected = []
    for d, t, *_ in rows:
        spans = brute.pii(t)
        n = Counter(k for k, _, _ in spans)
        expected.append((d, n["email"], n["ip"], n["card"], n["phone"], brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))))
    same((r[:6] for r in got), expected)
    by_id = {r.doc_id: set(filter(None, r.spans.split(","))) for r in got}
    for d, t, *_ in rows:
        if d is not None:
            assert {f"{k}:{a}:{b}" for k, a, b in brute.pii(t)} <= by_id[d]


def test_pii_contexts_add_unseen_identifiers(spark):
    seeds = [(i, f"Please call me at +1 (743) 555-{1000 + i} or write a letter") for i in range(30)]
    found = find_pii(spark.createDataFrame([*seeds, (90, "Please call me at 743 555-9999 or write"), (91, "The bridge of 1999 is 743 555-0000 high")], "doc_id long, text string"))
    spans = {r.doc_id: r.spans for r in found.collect()}
    assert spans[90] == "phone:18:30"
    assert spans[91] == ""
    assert spans[3].count("phone") == 1


def test_pii_long_runs_take_linear_time(spark):
    texts = ["a" * 300_000, "1" * 300_000, "a.b" * 100_000, "1." * 150_000, "+1" + "(" * 200_000, "1 " * 100_000]
    got = find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sum(r.n_email + r.n_card + r.n_phone for r in got) == 0


def test_pii_many_identifiers_in_one_text(spark):
    """Time grows with the spans; those before and after the blocks' bounds are in place."""
    texts = [" ".join(f"u{i}@h.org +1 (743) 555-{i % 10_000:04d}" for i in range(n)) for n in (0, 1, 127, 128, 129, 50_000)]
    got = {r.doc_id: r for r in find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        spans = brute.pii(t)
        assert got[i].base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
        assert got[i].n_email == sum(k == "email" for k, _, _ in spans)


def test_pii_rounds_go_on_until_nothing_is_added_and_base_spans_stay(spark):
    rows = [(i, f"call me on +1 (743) 555-{1000 + i} today") for i in range(200)]  # seeds: "me on _", "on _ today"
    rows += [(1100 + i, f"call me on 743 555-{1000 + i} today and dial now 743 555-{1000 + i} please") for i in range(30)]
    rows += [(1200 + i, f"dial now 843 555-{2000 + i} please or ring up 843 555-{2000 + i} later") for i in range(8)]
    rows += [(1300 + i, f"ring up 943 555-{3000 + i} later") for i in range(2)]
    rows += [(1400, "call me on 10.0.0.1 or x@y.org today"), (1100, rows[200][1]), (1100, "another text")]
    got = find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = {}
    for r in got:
        spans.setdefault(r.doc_id, []).append(r.spans)
    assert spans[1103] == ["phone:11:23,phone:43:55"] and spans[1203] == ["phone:9:21,phone:40:52"] and spans[1301] == ["phone:8:20"]
    assert spans[1400] == ["email:23:30,ip:11:19"] and sorted(spans[1100]) == ["", "phone:11:23,phone:43:55", "phone:11:23,phone:43:55"]


def test_licenses(corpus):
    rows, docs = corpus
    got = scan_licenses(docs).collect()
    same(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), ((d, *brute.licenses(t)) for d, t, *_ in rows))
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")
    assert "apache" in next(r.labels for r in got if r.doc_id == 27).split(",")


def test_license_join_finds_what_brute_force_finds(corpus):
    from onoma.llm.common import python_words
    from onoma.llm.license_scan import TEMPLATES, template_matches

    rows, docs = corpus
    for threshold in (0.9, 0.6):
        expected = set()
        for d, t, *_ in rows:
            for i, line in enumerate((t or "").split("\n")):
                held = set(python_words(line))
                for label, text in TEMPLATES:
                    own = set(python_words(text))
                    if len(held & own) >= np.ceil(threshold * len(own)):
                        expected.add((d, i, label, len(held & own) / len(own)))
        assert {tuple(r) for r in template_matches(docs.select("doc_id", "text"), threshold=threshold).collect()} == expected


def _notices():
    """Each template wrapped at three widths; then with words far apart, left out and put in."""
    import textwrap

    from onoma.llm.license_scan import TEMPLATES

    rng = np.random.default_rng(2)
    rows = []
    for _, text in TEMPLATES:
        for width in (20, 40, 72):
            rows.append("int a;\n" + "\n".join(f" * {x}" for x in textwrap.wrap("Copyright by Somebody. " + text.capitalize(), width)) + "\n\nint b;")
    wrapped = len(rows)
    vocabulary = sorted({t for _, text in TEMPLATES for t in text.split()})
    for _, text in TEMPLATES:
        rows.append("\n".join(w + " filler" * 30 for w in text.split()))
        for share in (0.05, 0.3):
            made = [x for w in text.split() for x in ([w] if rng.random() > share else [str(rng.choice(vocabulary)), "other"])]
            rows.append("\n".join(" ".join(made[i : i + 3]) for i in range(0, len(made), 3)))
    return rows, wrapped


def test_licenses_sql_says_the_same_of_wrapped_notices(spark):
    import duckdb

    from onoma.llm.oracles import ORACLES

    rows, _ = _notices()
    got = scan_licenses(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).toPandas()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(x) for x in enumerate(rows)])
    expected = con.execute(ORACLES["op7_license_scan"]).df()[list(got.columns)]
    assert got.sort_values("doc_id").fillna(-1).values.tolist() == expected.sort_values("doc_id").fillna(-1).values.tolist()


def test_license_names_that_differ_by_a_word_are_told_apart(spark):
    texts = {
        "gpl": "under the terms of the GNU General\nPublic License",
        "lgpl": "under the terms of the GNU Lesser\nGeneral Public License",
        "agpl": "under the terms of the GNU Affero General Public License",
        "cc-by": "This work is licensed under a Creative Commons Attribution 4.0\nInternational License.",
        "cc-by-sa": "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.",
        "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 License.",
    }
    got = {r.doc_id: set(r.labels.split(",")) for r in scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()}
    for label, labels in got.items():
        assert label in labels
        assert not labels & {"lgpl", "agpl", "cc-by-sa", "cc-by-nc"} - {label}


def test_licenses_wrapped_over_lines(spark):
    from onoma.llm.common import python_words
    from onoma.llm.license_scan import TEMPLATES, wrapped_matches

    rows, wrapped = _notices()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, source string")
    for threshold in (0.9, 0.6):
        expected = set()
        for i, t in enumerate(rows):
            best = {}
            for label, text in TEMPLATES:
                own, n, w = set(python_words(text)), 2 * len(python_words(text)), python_words(t)
                most = max(len(own & set(w[a : a + n])) for a in range(len(w)))
                if most >= np.ceil(threshold * len(own)):
                    best[label] = max(best.get(label, 0.0), most / len(own))
            expected |= {(i, label, share) for label, share in best.items()}
        assert {tuple(r) for r in wrapped_matches(docs.select("doc_id", "text"), threshold=threshold).collect()} == expected
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    for i in range(wrapped):
        assert TEMPLATES[i // 3][0] in got[i].labels.split(",") and got[i].score == 1.0


@pytest.mark.parametrize("shard", [4096, 7])
def test_mixing(corpus, shard):
    rows, docs = corpus
    got = mix_sources(docs, docs_per_shard=shard)
    size = {}
    for _, t, _, s, *_ in rows:
        size.setdefault(s, []).append(len(brute.TOKEN.findall(t or "")))
    target = brute.targets((s, n) for s, v in size.items() for n in v)
    found = got.join(docs.select("doc_id", "source").filter("doc_id is not null").distinct(), "doc_id").collect()
    same(((r.doc_id, r.size) for r in got.collect()), ((d, len(brute.TOKEN.findall(t or ""))) for d, t, *_ in rows))
    for r in found:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sum(size[r.source])
        assert 0 <= r.taken <= 3 * r.size
    for s in size:
        lost = sum(len(brute.TOKEN.findall(t or "")) for d, t, _, x, *_ in rows if d is None and x == s)
        taken = sum(r.taken for r in found if r.source == s)
        assert abs(taken - target[s]) <= 0.02 * target[s] + 3 * lost + 3
    same(got.collect(), mix_sources(docs.repartition(5), docs_per_shard=shard).collect())


def test_mixing_meets_small_sources_of_a_large_table(spark):
    sizes = {"a": 5_000_000, "b": 170, "c": 400, "d": 1100, "e": 1500, "f": 2100, "g": 3_000_000}
    parts = {s: [n // 10] * 9 + [n - n // 10 * 9] for s, n in sizes.items()}
    rows = [(i, s, n) for i, (s, n) in enumerate((s, n) for s, v in parts.items() for n in v)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n int").select("doc_id", "source", F.expr("repeat('w ', n)").alias("text"))
    target = brute.targets((s, n) for _, s, n in rows)
    of = {i: s for i, s, _ in rows}
    for shard in (4096, 3):
        taken = Counter()
        for r in mix_sources(docs, docs_per_shard=shard).collect():
            taken[of[r.doc_id]] += r.taken
        for s in sizes:
            assert abs(taken[s] - target[s]) <= 3, (s, taken[s], target[s])


def test_mixing_without_words(spark):
    got = mix_sources(spark.createDataFrame([(1, "", "a"), (2, None, None), (3, " ", "a")], "doc_id long, text string, source string"))
    assert sorted(tuple(r) for r in got.collect()) == [(i, 0, 0, 0.0, 0) for i in (1, 2, 3)]


def test_sainte_lague(spark):
    rng = np.random.default_rng(1)
    for seats in (0, 1, 7, 50, 1000):
        votes = [int(x) for x in rng.pareto(1, 12) * 1000] + [0, 5, 5]
        parties = spark.createDataFrame([(0, i, v, seats) for i, v in enumerate(votes)], "g int, k int, v long, n long")
        won = [0] * len(votes)
        for _ in range(seats):
            best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
            won[best] += 1
        assert [r.quota for r in sainte_lague(parties, ["g"], "v", "n", ["k"]).orderBy("k").collect()] == won


def test_suffix_dedup(corpus):
    rows, docs = corpus
    texts = [(t or "").encode() for _, t, *_ in rows]
    expected = []
    for (d, *_), t, cover in zip(rows, texts, brute.repeats(texts), strict=True):
        kept = bytes(np.frombuffer(t, np.uint8)[~cover])
        runs = int((np.diff(np.concatenate(([0], cover.astype(np.int8)))) == 1).sum())
        expected.append((d, len(t), int(cover.sum()), runs, brute.sha(kept)))
    for split, large, hashes in ((suffix_dedup.SPLIT, suffix_dedup.LARGE, 3), (2, 100, 2), (1, 1, 1)):  # by the index, by two hashes, and by counting strings
        same(suffix_dedup.suffix_dedup(docs.select("doc_id", "text", "source"), split, large, hashes).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), expected)


def test_suffix_dedup_passages_that_many_texts_share(spark):
    """Passages of many lengths in texts that differ around them: hot anchors at every hash."""
    rng = np.random.default_rng(6)
    noise = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8))
    passages = [noise(n) for n in (120, 250, 390, 399, 400, 401, 700)]
    texts = [noise(int(rng.integers(100, 500))) + passages[i % 7] + noise(int(rng.integers(100, 500))) for i in range(350)]
    texts += [noise(300) + texts[k] for k in range(0, 60, 7)] + [b"".join(passages), b"\0" * 900, b"ab\0" * 300]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    expected = [(i, len(t), int(c.sum()), brute.sha(bytes(np.frombuffer(t, np.uint8)[~c]))) for i, (t, c) in enumerate(zip(texts, brute.repeats(texts), strict=True))]
    for split, large, hashes in ((20, 10, 2), (20, 1000, 3), (10_000, 1, 1)):
        got = suffix_dedup.suffix_dedup(docs, split, large, hashes)
        same(got.select("doc_id", "n_bytes", "n_removed", "kept_sha256").collect(), expected)


def test_suffix_dedup_hashes_tell_strings_apart_that_a_power_of_two_does_not():
    one = [0]
    while len(one) < 512:  # the Thue-Morse word and its complement
        one += [1 - x for x in one]
    a, b = (np.array([97 + (x ^ y) for x in one], np.uint8) for y in (0, 1))
    buf = np.concatenate((a, b))
    got = suffix_dedup._content(buf, suffix_dedup._sums(buf), np.array([0, 512, 0]), np.array([512, 1024, 512]))
    assert got[0] == got[2] != got[1]
    up, down = suffix_dedup._powers(5000)[2:]
    assert all(int(up[i]) == pow(suffix_dedup._PRIME_BASE, i, suffix_dedup._PRIME) and int(up[i]) * int(down[i]) % suffix_dedup._PRIME == 1 for i in (0, 1, 2, 777, 4999))


def test_suffix_dedup_levels_and_long_texts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH", 8)
    rng = np.random.default_rng(3)
    base = bytes(rng.integers(97, 123, 5000).astype(np.uint8))
    texts = []
    for _ in range(60):
        a, n = int(rng.integers(0, 4000)), int(rng.integers(300, 1000))
        texts.append(bytes(rng.integers(97, 123, 200).astype(np.uint8)) + base[a : a + n] + bytes(rng.integers(97, 123, 150).astype(np.uint8)))
    texts += [b"xy" * 900, texts[0]]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array([t.decode() for t in texts])], ["doc_id", "rid", "text"])
    for segment in (1 << 20, 2048):
        monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
        chunks = [r for b in suffix_dedup._chunks(0)([batch]) for r in b.to_pylist()]
        n = Counter((c["anchor"], c["content"]) for c in chunks)
        one = {(c["anchor"], c["content"]): c for c in chunks}
        cells = [(a, c, x["offset"], n[a, c] > 1, texts[x["doc_id"]][x["at"] : x["at"] + x["n"] + 399]) for (a, c), x in one.items()]
        names = ["anchor", "content", "offset", "whole", "bytes"]
        found = {(r["anchor"], r["content"]): r["spans"] for b in suffix_dedup._index([pa.RecordBatch.from_pylist([dict(zip(names, c, strict=True)) for c in cells])]) for r in b.to_pylist()}
        cover = [np.zeros(len(t), bool) for t in texts]
        for c in chunks:
            key = c["anchor"], c["content"]
            for s in [{"a": 0, "b": c["n"] + 399}] if n[key] > 1 else found.get(key, []):
                cover[c["doc_id"]][c["at"] + s["a"] : c["at"] + s["b"]] = True
        for got, expected in zip(cover, brute.repeats(texts), strict=True):
            assert (got == expected).all()


@pytest.mark.parametrize("bound", [decontamination.BROADCAST_MARKS, 0])
def test_decontamination(spark, corpus, monkeypatch, bound):
    monkeypatch.setattr(decontamination, "BROADCAST_MARKS", bound)  # fingerprints to all tasks, or shuffled
    rows, docs = corpus
    long = " ".join(f"passage{i}" for i in range(5, 40))
    items = [(1, long), (2, long.upper()), (3, None), (4, " ..."), (5, "two words"), (None, "apache license"), (10, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w99999"), (6, "word " * 12), (7, "ÉCOLE straße"), (8, "here again same words here again and a tail"), (9, "again")]
    items += [(100 + i, t) for i, t in enumerate(r[1] for r in rows[60:62])]
    benchmark = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id int")
    got = decontaminate(docs, benchmark).collect()
    # an item without an id hits words and counts for no item
    counted = [brute.contaminated(t, [x for x in items if x[0] is not None]) for _, t, *_ in rows]
    hit_any = [brute.contaminated(t, items) for _, t, *_ in rows]
    expected = [(r[0], h[0], h[1], c[2], c[3], h[4]) for r, c, h in zip(rows, counted, hit_any, strict=True)]
    same((r for r in got if r.doc_id is not None), (x for x in expected if x[0] is not None))
    kept = drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    hit = {r.doc_id for r in got if r.contaminated}
    same(((r.doc_id,) for r in kept.collect()), ((r.doc_id,) for r in got if r.doc_id not in hit))
    none = decontaminate(docs, benchmark.limit(0)).collect()
    assert not any(r.contaminated for r in none) and len(none) == len(rows)


def test_winnowing_keeps_few_places_and_finds_every_window(spark):
    rng = np.random.default_rng(8)
    base = [f"w{int(x)}" for x in rng.integers(0, 400, 3000)]
    items = [(i, " ".join(base[a : a + int(n)])) for i, (a, n) in enumerate(zip(rng.integers(0, 2900, 40), rng.integers(1, 30, 40), strict=True))]
    texts = [" ".join(base), " ".join(f"x{i}" for i in range(3000)), " ".join(["w1 w2"] * 300)]
    texts += [" ".join([*("y" * int(rng.integers(0, 9))), *base[int(a) : int(a) + 25], "z"]) for a in rng.integers(0, 2900, 60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    same(got, ((i, *brute.contaminated(t, items)) for i, t in enumerate(texts)))
    n = docs.select(F.size(decontamination.winnowed(F.split("text", " "), [10])).alias("n")).collect()[1].n
    assert 0.2 < n / 3000 < 0.37  # two in seven


def test_simhash(corpus):
    rows, docs = corpus
    got = simhash.near_duplicates(docs).collect()
    fps = [brute.fingerprint(t) for _, t, *_ in rows]
    least = brute.components([r[0] for r in rows], fps)
    same(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), ((r[0], f, c) for r, f, c in zip(rows, fps, least, strict=True)))
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for c in least}


@pytest.mark.parametrize(("small", "large", "finer"), [(16, 20_000, (2, 4, 6)), (2, 20_000, (2, 4, 6)), (2, 5, ()), (2, 12, (2, 4))])
def test_simhash_links_keep_components(spark, monkeypatch, small, large, finer):
    """Chains, tight groups and far fingerprints: by offsets, by search, by shared variants, and by finer buckets."""
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 2**64, 200, dtype=np.uint64)]
    for c in fps[:6]:
        x = c
        for _ in range(30):
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(b)
            fps.append(x)
        fps += [c ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (40, 2))]
    fps = sorted({*fps, 0, 2**64 - 1})
    frame = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long").repartition(3)
    roots = {r.node: r.root for r in connected_components(simhash.fingerprint_links(frame, large=large, finer=finer)).collect()}
    got = [roots.get(simhash._signed(f), simhash._signed(f)) for f in fps]
    least = brute.components(list(range(len(fps))), fps)
    assert len(set(got)) == len(set(least))
    assert len(set(zip(got, least, strict=True))) == len(set(least))


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(1000, 1001), (1001, 1002), (7, 7)], "a long, b long"))
    found = connected_components(edges).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, groups.values())) == [3, 301]


@pytest.mark.parametrize("blocks", [6, 7, 8, 9, 10, 12])
def test_no_link_escapes_the_buckets(blocks):
    rng = np.random.default_rng(blocks)
    keys = simhash.masks(blocks, 4)
    for _ in range(300):
        diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(diff & m == 0 for m in keys)


def test_line_dedup(corpus):
    rows, docs = corpus
    hot = brute.hot_lines((r[0], r[1]) for r in rows)
    expected = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if brute.line_key(x) not in hot]
        expected.append((d, "\n".join(kept), len(lines), len(lines) - len(kept), brute.sha("\n".join(kept))))
    got = line_dedup(docs)
    assert hot and got.columns[:4] == docs.columns[:4]
    same(((r.doc_id, r.text, r.n_lines, r.n_dropped, r.kept_sha256) for r in got.collect()), expected)


def test_quality(corpus):
    rows, docs = corpus
    got = quality_rules(docs).collect()
    same(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), ((d, *brute.quality(t)) for d, t, *_ in rows))
    assert not any(r.kept and r.base_failed for r in got)
    same(((r.doc_id, r.kept) for r in got), ((d, brute.kept(t, Bands())) for d, t, *_ in rows))
    assert len({r.kept for r in got}) == 2


def test_quality_bands(spark):
    rng = np.random.default_rng(0)
    noise = rng.bytes(6000).hex() + bytes(rng.integers(33, 127, 9000).astype(np.uint8)).decode()
    vocabulary = ["".join(chr(97 + int(x)) for x in rng.integers(0, 26, int(n))) for n in rng.integers(2, 9, 3000)]
    prose = " ".join(vocabulary[min(2999, int(x))] for x in rng.pareto(1, 2500) * 20)
    stutter = " ".join(w for w in vocabulary[:60] for _ in range(4))
    kept = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame([(0, prose), (1, noise), (2, stutter), (3, prose[:500])], "doc_id long, text string")).collect()}
    assert kept == {0: True, 1: False, 2: False, 3: True}
    assert verdict(10, 99.0, [], Bands()) and not verdict(20_000, 2.0, [9.0, 9.0, 2.0], Bands())


def test_quality_rejects_noise_of_all_lengths_and_keeps_large_scripts(spark):
    rng = np.random.default_rng(1)
    letters = [chr(x) for x in [*range(48, 58), *range(65, 91), *range(97, 123)]]
    noise = {n: " ".join("".join(rng.choice(letters, int(k))) for k in rng.integers(3, 11, n // 5))[:n] for n in (900, 2000, 5000, 20_000, 100_000)}
    base64 = {n: " ".join("".join(rng.choice([*letters, "+", "/"], 76)) for _ in range(n // 77 + 1))[:n] for n in (1000, 9000, 50_000)}
    weights = 1 / np.arange(1, 1501)  # Han characters as often as in running text, some 9 bits each
    han = {n: " ".join("".join(chr(0x4E00 + int(x)) for x in rng.choice(1500, 12, p=weights / weights.sum())) for _ in range(n // 37)) for n in (900, 3000, 9000)}
    rows = [*noise.values(), *base64.values(), *han.values()]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in quality_rules(docs).collect()}
    first = len(noise) + len(base64)
    assert not any(kept[i] for i in range(first)) and all(kept[i] for i in range(first, first + len(han)))
    assert not verdict(150, 3.0, [], Bands())  # texts under 200 bytes have a band


def test_quality_chunks_cover_the_whole_text(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["".join(chr(97 + int(x)) for x in rng.integers(0, 26, int(n))) for n in rng.integers(2, 9, 3000)]
    prose = " ".join(vocabulary[min(2999, int(x))] for x in rng.pareto(1, 20_000) * 20)
    counters = "\n".join(f"item {i} of list {i + 7}" for i in range(3000))
    texts = [prose[:51_000] + counters[:49_000], prose[:4096] + counters[:3800], prose[:4096] + counters[:4095], prose[:100_000], prose[:7900]]
    got = quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert not any(r.base_failed for r in got)
    assert {r.doc_id: r.kept for r in got} == {0: False, 1: False, 2: False, 3: True, 4: True}


def test_repeated_words_with_many_distinct_words():
    words = [f"{i}".encode() for i in range(9000)] + [b"0", b"1", b"2", b"3", b"4"]
    assert repeated_words(words) == 10


def test_empty_tables(spark, nothing, corpus):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    for found in (find_pii(nothing), scan_licenses(nothing), mix_sources(nothing), suffix_dedup.suffix_dedup(nothing), decontaminate(nothing, benchmark), decontaminate(nothing, corpus[1].select(F.col("doc_id").alias("item_id"), "text")), simhash.near_duplicates(nothing), line_dedup(nothing), quality_rules(nothing)):
        assert found.count() == 0
