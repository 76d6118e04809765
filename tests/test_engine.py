"""The name engine: keys and distances by golden pairs, the build by hand-written seeds, lookups by hand."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from onoma.functions import distance, tables, text
from onoma.operators import audit, dictionary, edit, matching
from onoma.operators.index import build_index
from onoma.operators.index import dictionary as searchable
from onoma.sources import seeds as files
from onoma.streaming.resolve import parquet_sink, resolve_stream
from tests import by_hand

ENTRIES = [
    ("grape", "Cabernet Sauvignon", "카베르네 소비뇽", "manual"),
    ("grape", "Cabernet Franc", "카베르네 프랑", "wikidata"),
    ("grape", "Sauvignon blanc", "소비뇽 블랑", "added"),
    ("grape", "Montepulciano", "몬테풀치아노", "manual"),
    ("grape", "Pinot noir", "피노 누아르", "manual"),
    ("grape", "Albariño", "알바리뇨", ""),
    ("grape", "Xarel·lo", "사렐로", "manual"),
    ("grape", "Xarel-lo", "자렐로", "manual"),
    ("grape", "", "이름", "manual"),
    ("region", "Montepulciano d'Abruzzo DOC", "몬테풀치아노 다브루초", "manual"),
    ("region", "Montalcino", "몬탈치노", "manual"),
    ("region", "Pauillac", "포이약", "manual"),
    ("producer", "Chateau Margaux", "샤토 마고", "producer"),
    ("producer", "Château Mouton Rothschild", "샤토 무통 로칠드", "producer"),
    ("producer", "Chateau Lafite Rothschild", "샤토 라피트 로칠드", "producer"),
    ("producer", "Chateau d'Yquem", "샤토 디켐", "producer"),
    ("producer", "Chateau Talbot", "샤토 탈보", "producer"),
    ("producer", "Quinta do Noval", "퀸타 두 노발", "auto"),
    ("producer", "Montalcino", "몬탈치노", "auto"),
    ("producer", "Dom Pérignon", "돔 페리뇽", "manual"),
]
ALIASES = [("샤르도네", "Chardonnay", "grape"), ("까베르네 쇼비뇽", "cabernet sauvignon", "grape"), ("알바리노", "Albarino", "grape"), ("무똥", "Chateau Mouton Rothschild", "producer"), ("차렐로", "Xarel lo", "grape"), ("도멘 딸보", "Chateau Talbot", "producer")]


@pytest.fixture(scope="module")
def seeds(spark):
    rows = [(t, en, ko, "", "", s, "", i) for i, (t, en, ko, s) in enumerate(ENTRIES)]
    entries = spark.createDataFrame(rows, "type string, " + ", ".join(f"{c} string" for c in edit.ENTRY_FIELDS) + ", _seq long")
    aliases = spark.createDataFrame([(*a, "", i) for i, a in enumerate(ALIASES)], ", ".join(f"{c} string" for c in edit.ALIAS_FIELDS) + ", _seq long")
    return files.seeds_of(entries, aliases)


@pytest.fixture(scope="module")
def built(seeds):
    made = seeds.build()
    return dictionary.Dictionary(made.terms.cache(), made.orphans)


@pytest.fixture(scope="module")
def index(built):
    return build_index(searchable(built.terms, "term_seq")).cache()


def values(spark, column, *xs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string")
    return [r.y for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_equal_and_near_keys(spark):
    for a, b in [("딸보", "탈보"), ("샤또마고", "샤또 마고"), ("쪼", "쬬"), ("까베르네", "카베르네"), ("샤또 딸보", "샤토 탈보"), ("디상", "디샹")]:
        assert len(set(values(spark, text.jamo_key, a, b))) == 1
    assert len(set(values(spark, text.jamo_key, "샤르도네", "샤도네이"))) == 2


def test_jamo_key_equals_its_rule(spark):
    xs = ["각닭값없 앉·않—", "Dom Pérignon 1865", "1865 와인", "Ǖ ệ Ώ й", "", "간", "아야어여오요우유으이애에얘예와왜외워웨위의", "　넓은 칸"]
    random.seed(1)
    xs += ["".join(chr(random.randint(0xAC00, 0xD7A3)) for _ in range(6)) for _ in range(200)]
    assert values(spark, text.jamo_key, *xs) == [by_hand.jamo(x) for x in xs]
    assert values(spark, text.jamo_key, None) == [""]


def test_english_keys(spark):
    xs = ["Dom Perignon", "Marques de Riscal", "Chateau Margaux", "Château Margaux", "Chateau Talbot", "d'Abruzzo", "Pontet-Canet", "Straße Łódź ø æ", "Ch. Talbot", "Chateau ", "bodegas  Ñandú", "", "Bodega"]
    assert values(spark, text.key_en, *xs) == [by_hand.key_en(x) for x in xs]
    assert values(spark, text.key_en, "Marques de Riscal", "Chateau ", "Dom Perignon") == ["riscal", "chateau", "dom perignon"]
    assert values(spark, text.query_key_en, "Chateau ") == [""]


def test_display_drops_designations_in_any_case(spark):
    assert values(spark, text.name_display, "Quinta do Noval", "Barolo DOCG  x", "São o DOC.", "VDPx", "a-AOC-b") == ["Quinta Noval", "Barolo x", "São o .", "VDPx", "a- -b"]


def test_keyboard(spark):
    assert values(spark, text.hangul_to_qwerty, "ㅊ뮫굳ㅅ", "ㄳ 값", "ab 1", "가!", "") == ["cabernet", "rt rkqt", "ab 1", "", ""]
    assert values(spark, text.compatibility_jamo, "갃 x") == ["ㄱㅏㄳ x"]


def test_scripts_tokens_and_the_rest(spark):
    assert values(spark, text.has_hangul, "ㅊ", "가", "a", "ᄀ", None) == [True, True, False, False, False]
    assert values(spark, text.has_syllables, "ㅊ", "가") == [False, True]
    assert values(spark, text.tokens_ko, " 가 나·다 ", "", "가") == [["가", "나", "다"], [], ["가"]]
    assert values(spark, text.token_keys, "무통 로칠드 으", "가나") == [[by_hand.jamo("무통"), by_hand.jamo("로칠드")], []]
    assert values(spark, lambda x: text.tokens_en(text.key_en(x), x), "Château Calon-Ségur") == [["chateau", "calonsegur", "calon", "segur"]]
    assert values(spark, text.audit_words_en, "The Côte d'Or de la Y or or") == [["cote", "or", "or", "or"]]
    assert values(spark, text.audit_words_ko, "샤토 라 투르 드 팽") == [["샤토", "투르", "팽"]]
    assert values(spark, text.without_ko_prefix, "샤토 디켐", "샤토 가", "디켐 샤토", "샤토") == ["디켐", None, None, None]
    assert values(spark, text.slug, "Château d'Yquem!", "  ", "x" * 50) == ["cha-teau-d-yquem", "edit", "x" * 40]
    xs = ["Château Pétrus", "Ⅷ ½ ﬁn ① Ａｂｃ", "ệ̂", "Straße ø 가나", "𝐀𝟙 🅰", "²ªº™", "--", "e\u0301a"]
    assert values(spark, text.slug, *xs) == [re.sub("[^a-zA-Z0-9]+", "-", unicodedata.normalize("NFKD", x)).strip("-").lower()[:40] or "edit" for x in xs]
    assert values(spark, text.type_label, "g", "x") == [tables.TYPE_LABELS["g"], None]


def test_distances(spark):
    random.seed(2)
    keys = [by_hand.jamo(x) for x in ("탈보", "타르보", "다브루초", "다부르초", "지아코모", "자코모", "가니", "니가")] + ["", "ab", "ba", "cabernat", "cabernet", "a"]
    keys += ["".join(random.choice("abᅳᅮᄅ") for _ in range(random.randint(0, 9))) for _ in range(12)]
    pairs = spark.createDataFrame([(a, b) for a in keys for b in keys], "a string, b string")
    for r in pairs.select("a", "b", distance.weighted_distance(F.col("a"), F.col("b")).alias("x"), distance.weighted_distance_arrow("a", "b").alias("y")).collect():
        assert r.x == pytest.approx(by_hand.distance(r.a, r.b)) == r.y
    found = spark.createDataFrame([("탈보", "타르보"), ("산지오베제", "산조베제"), ("샤르도네", "샤도네이"), ("", "가")], "a string, b string")
    assert [round(r[0], 3) for r in found.select(distance.similarity(F.col("a"), F.col("b"))).collect()] == [0.95, 0.9, 0.8, 0.0]


def test_build(built):
    rows = built.ordered().collect()
    assert [(r.alias_ko, r.name_en, r.type) for r in built.orphans.collect()] == [("샤르도네", "Chardonnay", "grape")]
    by = {(r.type, r.name_ko): r for r in rows}
    assert by["grape", "사렐로"].canonical_id == by["grape", "자렐로"].canonical_id == "gra00007"
    assert by["grape", "카베르네 소비뇽"].canonical_id == by["grape", "까베르네 쇼비뇽"].canonical_id == "gra00001"
    assert (by["grape", "까베르네 쇼비뇽"].name_en, by["grape", "까베르네 쇼비뇽"].is_alias, by["grape", "까베르네 쇼비뇽"].ko_source) == ("Cabernet Sauvignon", 1, "alias")
    assert by["producer", "디켐"].ko_source == "stripped" and by["producer", "디켐"].name_ko_primary == "샤토 디켐"
    assert by["producer", "딸보"].name_en == "Chateau Talbot"
    assert by["region", "몬테풀치아노 다브루초"].name_display == "Montepulciano d'Abruzzo"
    assert by["producer", "퀸타 두 노발"].name_display == "Quinta Noval"
    assert all(r.key_ko == by_hand.jamo(r.name_ko) and r.key_en == by_hand.key_en(r.name_en) and r.key_len == len(r.key_ko) and r.wikidata == "" for r in rows)
    assert ("grape", "이름") not in by and by["grape", "알바리뇨"].ko_source == "manual"
    assert [(r.type, r.name_ko_primary, r.is_alias) for r in rows] == sorted((r.type, r.name_ko_primary, r.is_alias) for r in rows)
    summary = {r.type: (r.n_rows, r.n_canonical) for r in built.summary().collect()}
    assert summary["all"] == (len(rows), len({r.canonical_id for r in rows}))


def test_freeze_is_the_inverse(spark, built):
    entries, aliases = dictionary.freeze(built.terms)
    numbered = lambda df: spark.createDataFrame([(*r, i) for i, r in enumerate(df.collect())], df.schema.add("_seq", "long"))
    again = files.seeds_of(numbered(entries), numbered(aliases)).build()
    known = lambda d: {(r.type, r.name_ko, r.name_en) for r in d.terms.collect()}
    # an entry that became a spelling of another keeps its own name, whose key with blanks is another one
    assert known(again) == known(built) - {("grape", "자렐로", "Xarel-lo")}
    counts = {r.what: r.n for r in dictionary.freeze_counts(built.terms).collect()}
    assert counts["stripped"] == built.terms.filter("ko_source = 'stripped'").count()


QUERIES = ["까베르네", "카베르네 소비뇽", "소비뇽", "몬테", "몬테풀차노", "cabernet", "cabernat", "sauvignon", "Albarino", "xarel-lo", "ㅊ뮫굳ㅅ", "zzzz", "1865", "", "  ", "샤또 딸보", "디켐", "로칠드", "d'abruzzo", "rothschild", "chateau", "yque", "샤토 무통 로칠드 1982", "Montalcin", "a", "마고", "montepulciano abruzo", "!!", None]


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_scan_equals_lookups_by_hand(spark, built, index, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)  # -1: every join as between large tables
    terms = [r.asDict() for r in searchable(built.terms, "term_seq").orderBy("term_seq").collect()]
    batch = [(k, x, th, kind) for k, (x, th, kind) in enumerate((x, th, kind) for x in QUERIES for th, kind in ((0.8, "all"), (0.95, "all"), (0.6, "g"), (0.85, "p")))]
    hits = {}
    found = matching.scan(spark.createDataFrame(batch, "qid long, text string, th double, type string"), index).collect()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for r in found:
        hits.setdefault(r.qid, []).append((r["rank"], r.canonical_id, r.term_seq, round(r.score, 9), r.frag, r.is_full, r.via, r.typed))
    kind_of = {x["canonical_id"]: x["type"] for x in terms}
    for qid, x, th, kind in batch:
        assert sorted(hits.get(qid, [])) == by_hand.scan(terms, x, th, kind), (x, th, kind)
        assert all(kind in ("all", kind_of[h[1]]) for h in hits.get(qid, []))
    count = lambda x, th: len(hits.get(next(q for q, y, t, k in batch if (y, t, k) == (x, th, "all")), []))
    assert count("몬테", 0.8) > count("몬테", 0.95)


def test_library_index_and_hit_rate(spark, index, built):
    entries = spark.createDataFrame([(0, "샤토 탈보", "Chateau Talbot"), (1, "샤또 딸보", "Talbot"), (2, "바롤로", "Barolo"), (3, "피노 누아", "Pinot Noir")], "seq long, name_ko string, name_original string")
    asked = spark.createDataFrame([(0, "샤또탈보"), (1, "바로로"), (2, "삐노 누아르"), (3, "리슬링")], "qid long, text string")
    got = {(r.qid, r.name_original): r.score for r in matching.index_lookup(asked, entries).collect()}
    expected = {(0, "Chateau Talbot"): 1.0, (0, "Talbot"): 1.0}
    for q, x in ((1, "바로로"), (2, "삐노 누아르"), (3, "리슬링")):
        for ko, en in (("샤토 탈보", "Chateau Talbot"), ("바롤로", "Barolo"), ("피노 누아", "Pinot Noir")):
            a, b = by_hand.jamo(x), by_hand.jamo(ko)
            s = 1 - by_hand.distance(a, b) / max(len(a), len(b))
            if s >= 0.82:
                expected[q, en] = round(s, 3)
    assert got == expected
    batch = spark.createDataFrame([(0, "피노 누아르", 0.85, "all"), (1, "zzzz", 0.85, "all")], "qid long, text string, th double, type string")
    first, rate = matching.hit_rate(batch, matching.scan(batch, index))
    assert tuple(rate.first()) == (2, 1, 0.5) and first.count() == 1


def test_audit(spark, built):
    issues = {(r.category, r.detail) for r in audit.audit(built.terms).collect()}
    assert (tables.TYPES_ERROR, "Montalcino: ['producer', 'region']") in issues
    rows = [("a1", "grape", 0, "모스카토 다스티", "Moscato"), ("a2", "grape", 0, "abc", "x"), ("a3", "grape", 1, "가", " "), ("a4", "region", 0, "나", "나x"), ("a5", "grape", 0, "가", "y"), ("a6", "region", 0, None, "y")]
    small = spark.createDataFrame(rows, "canonical_id string, type string, is_alias int, name_ko string, name_en string")
    found = {(r.category, r.detail) for r in audit.audit(small).collect()}
    assert found == {
        (tables.TRUNCATED, "모스카토 다스티  ->  Moscato   [grape]"),
        (tables.TYPES_CHECK, "y: ['grape', 'region']"),
        (tables.NO_HANGUL, "abc [grape]"),
        (tables.NO_ORIGINAL, "가 [grape]"),
        (tables.MIXED_ORIGINAL, "나 -> 나x"),
        (tables.HOMONYM, "가: [' ', 'y']"),
    }
    summary = {r.category: (r.n, r.first) for r in audit.audit_summary(audit.audit(small)).collect()}
    assert summary[tables.NO_HANGUL] == (1, ["abc [grape]"])
    assert audit.new_issues(audit.audit(small), audit.audit(small)).count() == 0


def test_edits(seeds):
    new = {"name_en": "Riesling", "name_ko": "리슬링", "ko_source": "manual", "unknown": "x"}
    done = edit.apply_changes(seeds, [
        edit.Change("grapes", "add", new),
        edit.Change("aliases", "add", {"alias_ko": "리즐링", "name_en": "riesling", "type": "grape"}),
        edit.Change("regions", "edit", {"name_en": "Pauillac", "name_ko": "뽀이약", "tier": None}, {"name_en": "Pauillac"}),
        edit.Change("grapes", "add", {"name_en": "Montalcino", "name_ko": "몬탈"}),
    ])
    spelled = {(r.type, r.name_ko) for r in done.dictionary.terms.collect()}
    assert {("grape", "리슬링"), ("grape", "리즐링"), ("region", "뽀이약")} <= spelled and ("region", "포이약") not in spelled
    assert done.diffs[2]["diff"]["before"]["name_ko"] == "포이약"
    assert "Montalcino" in edit.describe(done.diffs, done.new_issues)
    assert done.counts.first().new_issue_count == 1
    table = {r.name_en: (r.name_ko, r._seq) for r in done.seeds.entries["grapes"].collect()}
    assert table["Riesling"] == ("리슬링", 9) and table["Montalcino"] == ("몬탈", 10) and table["Cabernet Franc"] == ("카베르네 프랑", 1)
    chain = [  # each on what the one before left
        edit.Change("producers", "add", {"name_en": "New House", "name_ko": "새 집"}),
        edit.Change("producers", "edit", {"name_en": "Newer House", "name_ko": " 새 집 "}, {"name_en": "New House"}),
        edit.Change("aliases", "add", {"alias_ko": "새집", "name_en": "newer house", "type": "producer"}),
        edit.Change("aliases", "edit", {"alias_ko": "새옷", "name_en": "newer house", "type": "producer"}, {"alias_ko": "새집", "name_en": "newer house", "type": "producer"}),
        edit.Change("producers", "add", {"name_en": "New House", "name_ko": "헌 집"}),
    ]
    after, diffs = edit.changed(seeds, chain)
    assert [d["before"] and d["before"].get("name_ko", d["before"].get("alias_ko")) for d in diffs] == [None, "새 집", None, "새집", None]
    assert [(r.name_en, r.name_ko) for r in after.entries["producers"].orderBy("_seq").collect()][-2:] == [("Newer House", "새 집"), ("New House", "헌 집")]
    assert [r.alias_ko for r in after.aliases.orderBy("_seq").collect()][-1] == "새옷" and after.aliases.count() == len(ALIASES) + 1
    for broken, field in [
        ([*chain, edit.Change("producers", "edit", {"name_en": "X", "name_ko": "새"}, {"name_en": "New  House"})], "match"),
        ([*chain, chain[2]], None),
        ([*chain, edit.Change("producers", "add", {"name_en": "NEW house", "name_ko": "새"})], "name_en"),
        ([chain[0], edit.Change("aliases", "add", {"alias_ko": "새집", "name_en": "newer house", "type": "producer"}), chain[1]], "name_en"),
        ([chain[0], edit.Change("wines", "add", {})], "file"),
    ]:
        if field is None:
            assert edit.changed(seeds, broken)
            continue
        with pytest.raises(edit.ChangeError) as error:
            edit.changed(seeds, broken)
        assert error.value.field == field
    row = lambda **k: {"name_en": "New", "name_ko": "새", **k}
    for change, field in [
        (edit.Change("wines", "add", row()), "file"),
        (edit.Change("grapes", "drop", row()), "action"),
        (edit.Change("grapes", "add", row(name_ko="abc")), "name_ko"),
        (edit.Change("grapes", "add", row(name_en="")), "name_en"),
        (edit.Change("grapes", "add", row(name_en="새New")), "name_en"),
        (edit.Change("grapes", "add", row(name_en="albarino")), "name_en"),
        (edit.Change("grapes", "edit", row()), "match"),
        (edit.Change("grapes", "edit", row(), {"name_en": "Nobody"}), "match"),
        (edit.Change("aliases", "add", {"alias_ko": "새", "name_en": "Nobody", "type": "grape"}), "name_en"),
        (edit.Change("aliases", "add", {"alias_ko": "새", "name_en": "Albarino", "type": "wine"}), "type"),
        (edit.Change("aliases", "add", dict(zip(edit.ALIAS_FIELDS, ALIASES[1], strict=False))), "alias_ko"),
    ]:
        with pytest.raises(edit.ChangeError) as error:
            edit.apply_change(seeds, change)
        assert error.value.field == field
    with pytest.raises(edit.ChangeError):
        edit.apply_changes(seeds, [])


def test_files(spark, built, seeds, tmp_path):
    folder = tmp_path / "seed"
    folder.mkdir()
    (folder / "grapes.csv").write_text('﻿name_en,name_ko,tier,ko_source\n1865,일팔육오,,\n"A, ""b""",가,NA,null\n', encoding="utf-8")
    with pytest.raises(FileNotFoundError):
        files.read_seeds(spark, str(folder))
    got = files.read_seeds(spark, str(folder), ("grapes",))
    rows = got.all_entries().orderBy("_seq").collect()
    assert [(r.name_en, r.name_ko, r.tier, r.ko_source) for r in rows] == [("1865", "일팔육오", "", "manual"), ('A, "b"', "가", "NA", "null")]
    assert got.aliases.count() == 0
    out = str(tmp_path / "terms")
    files.write_csv(built.ordered(), out, dictionary.TERM_COLUMNS)
    back = files.read_terms(spark, out)
    assert [tuple(r) for r in back.orderBy("term_seq").select(*dictionary.TERM_COLUMNS).collect()] == [tuple(r) for r in built.ordered().collect()]
    files.write_compact(built.terms, str(tmp_path / "compact"))
    read = files.read_compact(spark, str(tmp_path / "compact"))
    assert {(r.i, r.ko, r.k) for r in read.collect()} == {(r.canonical_id, r.name_ko, r.key_ko) for r in built.terms.collect()}
    assert dictionary.from_compact(read).columns == ["term_seq", "canonical_id", "type", "name_ko", "name_en", "key_ko", "key_en"]
    (tmp_path / "q.txt").write_text("피노\n\n  cabernet \n", encoding="utf-8")
    assert [r.text for r in files.read_queries(spark, str(tmp_path / "q.txt")).orderBy("qid").collect()] == ["피노", "cabernet"]
    assert not files.copy_table(spark, str(folder / "none.csv"), str(tmp_path / "x"))
    assert files.copy_table(spark, str(folder / "grapes.csv"), str(tmp_path / "x"))


def test_query_lines_keep_their_places_over_splits_and_files(spark, tmp_path):
    from tests.test_catalog import compared
    from onoma.plans.catalog import ORACLES, QUERIES

    folder = tmp_path / "q"
    folder.mkdir()
    texts = [["피노", "", "  cabernet "], ["x" * 300] + [f" 샤토 {i}" if i % 5 else "  " for i in range(400)], [], [f"b{i}" for i in range(70)]]
    for i, own in enumerate(texts):
        (folder / f"part-{i}.txt").write_text("".join(f"{x}\n" for x in own), encoding="utf-8")
    expected = [[(i, x.strip()) for i, x in enumerate(own) if x.strip()] for own in (texts[1], sum(texts, []))]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        assert spark.read.text(str(folder / "part-1.txt")).rdd.getNumPartitions() > 10
        for path, want in zip((folder / "part-1.txt", folder), expected, strict=True):
            assert [(r.qid, r.text) for r in files.read_queries(spark, str(path)).orderBy("qid").collect()] == want
        assert files.read_queries(spark, str(folder / "part-2.txt")).count() == 0
        got, found = compared(spark, QUERIES["query_list"], ORACLES["query_list"])
        assert got == found
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_stream(spark, index, tmp_path):
    rows = [(0, "피노 누아르", 0.85, "all"), (1, "cabernet", 0.8, "all")]
    spark.createDataFrame(rows, "qid long, text string, th double, type string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid long, text string, th double, type string").parquet(str(tmp_path / "in"))
    query = resolve_stream(stream, index, parquet_sink(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "at")).start()
    query.processAllAvailable()
    query.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r.qid for r in got.collect()} == {0, 1}


def test_numbers_and_staged_tables(spark):
    from onoma.sources import staging

    df = spark.createDataFrame([(i * 7919 % 1009, i % 5) for i in range(1009)], "k int, t int").repartition(3)
    got = staging.numbered(df, "n", "t", "k").orderBy("n").collect()
    assert [(r.t, r.k) for r in got] == sorted((i % 5, i * 7919 % 1009) for i in range(1009)) and [r.n for r in got] == list(range(1, 1010))
    assert staging.numbered(df.limit(0), "n", "t", "k").count() == 0
    kept, staging._written[:] = staging._written[:], []
    table = staging.stage(df, "x")
    assert table.count() == 1009 and staging.drop_staged(spark) == 1
    staging._written[:] = kept


def test_commands(spark, seeds, tmp_path, capsys):
    from onoma.__main__ import main

    source, out = str(tmp_path / "seed"), str(tmp_path / "dist")
    for file, df in seeds.entries.items():
        files.write_csv(df.orderBy("_seq"), f"{source}/{file}.csv", edit.ENTRY_FIELDS)
    files.write_csv(seeds.aliases.orderBy("_seq"), f"{source}/aliases.csv", edit.ALIAS_FIELDS)
    main(["build", source, out])
    main(["audit", f"{out}/terms"])
    assert "Montalcino" in capsys.readouterr().out
    main(["freeze", f"{out}/terms", str(tmp_path / "again")])
    main(["build", str(tmp_path / "again"), str(tmp_path / "dist2")])
    assert spark.read.parquet(f"{out}/terms.parquet").count() - spark.read.parquet(str(tmp_path / "dist2/terms.parquet")).count() == 1
    (tmp_path / "q").write_text("피노 누아르\nzzzz\n", encoding="utf-8")
    main(["hits", f"{out}/terms", str(tmp_path / "q")])
    assert "Pinot noir" in capsys.readouterr().out
