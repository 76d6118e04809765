"""The engine's expressions in DuckDB's SQL, for oracles: written from the rules, with lists where the engine joins."""

from __future__ import annotations

from onoma.functions import tables as t


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


INITIALS, VOWELS, FINALS = ([t.folded(x) for x in xs] for xs in (t.INITIALS, t.VOWELS, t.FINALS))
KEY_INITIALS, KEY_VOWELS, KEY_FINALS = ([t.keys_of(x) if x else "" for x in xs] for xs in (t.INITIALS, t.VOWELS, t.FINALS))

LETTERS = [t.KEYS.get(chr(i), "") for i in range(0x3131, 0x3164)]


def syllable(c: str, lists: tuple[list[str], list[str], list[str]]) -> str:
    i = f"(unicode({c}) - 44032)"
    return f"{_list(lists[0])}[({i} // 588) + 1] || {_list(lists[1])}[(({i} % 588) // 28) + 1] || {_list(lists[2])}[({i} % 28) + 1]"


def jamo(x: str) -> str:
    """Of syllables, ASCII, blanks and punctuation."""
    kept = f"regexp_replace(translate(coalesce({x}, ''), '·-–—.,''\"()', ''), '\\s+', '', 'g')"
    one = syllable("c", (INITIALS, VOWELS, FINALS))
    return f"array_to_string(list_transform(string_split({kept}, ''), lambda c: CASE WHEN unicode(c) BETWEEN 44032 AND 55203 THEN {one} ELSE c END), '')"


def typed(x: str) -> str:
    """Of syllables, single letters, ASCII letters, digits and blanks; empty if there is anything else."""
    one = syllable("c", (KEY_INITIALS, KEY_VOWELS, KEY_FINALS))
    keys = f"list_transform(string_split({x}, ''), lambda c: CASE WHEN unicode(c) BETWEEN 44032 AND 55203 THEN {one} WHEN unicode(c) BETWEEN 12593 AND 12643 THEN {_list(LETTERS)}[unicode(c) - 12592] WHEN regexp_matches(c, '^[a-zA-Z0-9 ]$') THEN c END)"
    return f"CASE WHEN list_contains(list_transform({keys}, lambda k: k IS NULL), true) THEN '' ELSE trim(array_to_string({keys}, '')) END"


def search_key(x: str) -> str:
    return f"trim(lower(regexp_replace(regexp_replace(strip_accents(coalesce({x}, '')), '[''’-]', '', 'g'), '[^A-Za-z0-9]+', ' ', 'g')))"


def no_honorific(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '(?i)^(?:{t.EN_PREFIX})\\s+', '')"


def key_en(x: str) -> str:
    rest = f"trim({no_honorific(x)})"
    return search_key(f"CASE WHEN {rest} = '' THEN {x} ELSE {rest} END")


def display(x: str) -> str:
    """Of ASCII names."""
    return f"trim(regexp_replace(regexp_replace({x}, '(?i)\\b(?:{t.TIERS})\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


def flat(x: str) -> str:
    return f"replace({x}, ' ', '')"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[\\s·]+'), lambda w: w <> '')"


def cost(c: str) -> str:
    return f"(CASE WHEN {c} IN ({', '.join(repr(x) for x in t.CHEAP)}) THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END)"


def distances(pairs: str, name: str = "dist") -> str:
    """Common table `name`(a, b, d) of a table of distinct pairs(a, b), both not empty: a row of the table of edits at a time."""
    row = f"""list_reduce(list_transform(range(1, length(b) + 1), lambda j: [j::DOUBLE]), lambda acc, x: list_append(acc, least(
        CASE WHEN a[i + 1] = b[x[1]::INT] THEN up[x[1]::INT]
             ELSE least(up[x[1]::INT + 1] + {cost("a[i + 1]")}, acc[x[1]::INT] + {cost("b[x[1]::INT]")}, up[x[1]::INT] + 1) END,
        CASE WHEN i > 0 AND x[1] > 1 AND a[i + 1] = b[x[1]::INT - 1] AND a[i] = b[x[1]::INT] THEN up2[x[1]::INT - 1] + 0.6::DOUBLE ELSE 1e9::DOUBLE END)),
        [up[1] + {cost("a[i + 1]")}])"""
    first = f"list_reduce(list_transform(string_split(b, ''), lambda c: [{cost('c')}]), lambda acc, x: list_append(acc, acc[len(acc)] + x[1]), [0.0::DOUBLE])"
    return f"""{name}_rows(a, b, i, up2, up) AS (
      SELECT a, b, 0, {first}, {first} FROM {pairs}
      UNION ALL SELECT a, b, i + 1, up, {row} FROM {name}_rows WHERE i < length(a)),
    {name} AS (SELECT a, b, up[len(up)] AS d FROM {name}_rows WHERE i = length(a))"""
