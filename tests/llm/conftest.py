import duckdb
import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, _hot int, rid long"


def odd_texts() -> list[str | None]:
    """Nulls, empty and very long texts, ties, other scripts and characters that are near the rules' edges."""
    line = "A line that stands in many documents, word for word."
    passage = " ".join(f"passage{i}" for i in range(70))
    return [
        None,
        "",
        " \t\n",
        "one",
        "Two Words",
        "\n\n" + line + "\n",
        *[f"Lead {i}\n\t{line.upper()} \nTail {i}" for i in range(12)],
        *[f"start {i} {passage} end {i}" for i in range(4)],
        "ab" * 700,
        "ÉCOLE Straße ΑΣ İstanbul K sign",
        "mail joe@example.org, root@localhost and a@b.c_d@e.f or x@y.z@u.v; 1.2.3.4 256.1.1.1 01.02.03.004.5 4111 1111 1111 1111 4111-1111-1111-1112",
        "call +1 (743) 555-3824 or +49 30 1234 or +(12) and 12345678901234567890 7992739871300000",
        "é😀 +44 20 7946 0958 😀 10.0.0.1.2.3.4.5",
        "Licensed under the Apache License, Version 2.0. GNU General Public License; gnu  general\npublic LICENSE cc by CC-BY cc by cc bypass MIT LICENSE",
        "Licensed under CC BY-NC 4.0.\nunder the License, you may not use this file except in compliance!",
        "mit license",
        "word " * 3000,
        " ".join(f"w{i}" for i in range(20000)),
        "## $$ %% && || << >> ** " * 5,
        "same words here again " * 2 + "and a tail of other words that do not come twice at all",
        "You idiot, what a stupid moron; scum and trash.",
        "dup line\ndup line\n \n \nother",
    ]


@pytest.fixture(scope="session")
def corpus(spark):
    """The odd rows, two of them repeated and two without an id, and the smallest table; extra columns clash with inner names."""
    odd = odd_texts()
    rows = [(i, t, "en", [None, "b", "a"][i % 3], None) for i, t in enumerate(odd)]
    rows += [rows[6], rows[6], (None, "a text without an id", None, None, None), (None, odd[20], None, "z", 1)]
    rows += [(1000 + r[0], *r[1:]) for r in duckdb.sql(f"select doc_id, text, lang, source, n_chars from '{SF}/documents.parquet' order by doc_id").fetchall()]
    rows = [(*r, "x", 1, 2) for r in rows]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
