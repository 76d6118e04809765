"""Keys, tokens and script tests of names, as column expressions.

Everything is built-in functions, so that one expression serves the dictionary and the queries and
runs on the executors' JVM. Null text gives the result of empty text. Canonical decomposition
covers Hangul, and letters of Latin, Greek and Cyrillic script; other letters are taken as they are.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from onoma.functions import tables as t

HANGUL = "[가-힣]"
_MARKS = r"\p{M}+"
_SEP = "\u0001"
_BLANK = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in t.SPACES) + "]"


def _words_of(joined: str) -> Column:
    """A constant array in one literal, which the optimizer folds."""
    return F.split(F.lit(joined), _SEP)


def _table(words: list[str]) -> Column:
    return _words_of(_SEP.join(words))


def text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def trimmed(value: Column) -> Column:
    """Without white space at the ends; null is empty."""
    return F.regexp_replace(text(value), rf"^{_BLANK}+|{_BLANK}+$", "")


def characters(value: Column) -> Column:
    """Code points, an empty array for empty text."""
    return F.filter(F.split(text(value), ""), lambda c: c != "")


def _syllable(code: Column, tables_: tuple[list[str], list[str], list[str]]) -> Column:
    """The parts of a Hangul syllable, each looked up in its table."""
    i = code - 0xAC00
    first, middle, last = (_table(x) for x in tables_)
    return F.concat(F.get(first, F.floor(i / 588).cast("int")), F.get(middle, F.floor((i % 588) / 28).cast("int")), F.get(last, (i % 28).cast("int")))


def _letter(c: Column, code: Column) -> Column:
    """Canonical decomposition of one character that is no Hangul."""
    out = c
    for a, b in t.LETTER_RANGES:
        out = F.when(code.between(a, b), F.get(_table(t.decomposed(a, b)), (code - a).cast("int"))).otherwise(out)
    return out


@lru_cache
def _folds() -> tuple[list[str], list[str], list[str], list[str]]:
    return [t.folded(x) for x in t.INITIALS], [t.folded(x) for x in t.VOWELS], [t.folded(x) for x in t.FINALS], [t.folded(x) for x in t.conjoining()]


def jamo_key(value: Column) -> Column:
    """Key of a Korean spelling: decomposed, blanks and punctuation dropped, sounds folded, silent initials dropped.

    Other characters stay, so a Latin spelling is its own key, case and marks included.
    """
    initials, vowels, finals, jamo = _folds()
    kept = F.regexp_replace(F.translate(text(value), t.IGNORED, ""), f"{_BLANK}+", "")

    def fold(c: Column) -> Column:
        code = F.ascii(c)
        return (
            F.when(code.between(0xAC00, 0xD7A3), _syllable(code, (initials, vowels, finals)))
            .when(code.between(0x1100, 0x11FF), F.get(_table(jamo), (code - 0x1100).cast("int")))
            .otherwise(_letter(c, code))
        )

    return F.array_join(F.transform(characters(kept), fold), "")


def without_accents(value: Column) -> Column:
    """Marks dropped from letters; letters that do not decompose (ß, ø, ł) stay."""
    whole = text(value)
    stripped = F.regexp_replace(F.translate(whole, *t.plain_letters()), _MARKS, "")
    return F.when(F.octet_length(whole) == F.length(whole), whole).otherwise(stripped)  # pure ASCII has none


def search_key_en(value: Column) -> Column:
    """Words of an original name: no accents, apostrophes and hyphens join, all else parts, lower case."""
    joined = F.regexp_replace(without_accents(value), "['’-]", "")
    return F.trim(F.lower(F.regexp_replace(joined, "[^A-Za-z0-9]+", " ")))


def without_en_prefix(value: Column) -> Column:
    return F.regexp_replace(text(value), rf"(?i)^(?:{t.EN_PREFIX})\s+", "")


def key_en(value: Column) -> Column:
    """search_key_en without the honorific, which is taken off the name as it is written; the whole name if nothing is left."""
    rest = trimmed(without_en_prefix(value))
    return search_key_en(F.when(rest == "", text(value)).otherwise(rest))


def query_key_en(value: Column) -> Column:
    """key_en of a query: nothing is left if it is a honorific alone."""
    return search_key_en(without_en_prefix(value))


def flat(key: Column) -> Column:
    return F.replace(key, F.lit(" "), F.lit(""))


def name_display(value: Column) -> Column:
    """A name without designations of quality, whatever their case."""
    gone = F.regexp_replace(text(value), rf"(?i)(?<![\w\p{{L}}])(?:{t.TIERS})(?![\w\p{{L}}])", " ")
    return trimmed(F.regexp_replace(gone, f"{_BLANK}+", " "))


def key_length(key: Column) -> Column:
    return F.length(key)


def compatibility_jamo(value: Column) -> Column:
    """Conjoining jamo as single letters."""
    jamo = t.conjoining()
    pairs = [(c, t.compatible(c)) for c in jamo if t.compatible(c) != c]
    return F.translate(text(value), "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


@lru_cache
def _keyboard() -> tuple[list[str], list[str], list[str], list[str], list[str]]:
    one = [t.keys_of(x) for x in t.conjoining()]
    letters = [t.KEYS.get(chr(i), "") for i in range(0x3131, 0x3164)]
    return [t.keys_of(x) for x in t.INITIALS], [t.keys_of(x) for x in t.VOWELS], [t.keys_of(x) if x else "" for x in t.FINALS], one, letters


def hangul_to_qwerty(value: Column) -> Column:
    """What was typed, if Hangul came of a keyboard in the wrong mode; empty if any character can't have."""
    initials, vowels, finals, jamo, letters = _keyboard()

    def typed(c: Column) -> Column:
        code = F.ascii(c)
        keys = (
            F.when(code.between(0xAC00, 0xD7A3), _syllable(code, (initials, vowels, finals)))
            .when(code.between(0x1100, 0x11FF), F.get(_table(jamo), (code - 0x1100).cast("int")))
            .when(code.between(0x3131, 0x3163), F.get(_table(letters), (code - 0x3131).cast("int")))
            .when(c.rlike("^[a-zA-Z0-9]$"), c)
        )
        return F.when(c.rlike(f"^{_BLANK}$"), " ").when(keys != "", keys)

    keys = F.transform(characters(value), typed)
    return F.when(F.exists(keys, lambda k: k.isNull()), "").otherwise(F.trim(F.array_join(keys, "")))


def has_hangul(value: Column) -> Column:
    """Syllables or letters of the keyboard."""
    return text(value).rlike("[가-힣ㄱ-ㅎㅏ-ㅣ]")


def has_syllables(value: Column) -> Column:
    return text(value).rlike(HANGUL)


def has_latin(value: Column) -> Column:
    return text(value).rlike("[A-Za-z]")


def tokens_ko(value: Column) -> Column:
    """Words, parted by blanks or middle dots."""
    return F.filter(F.split(F.regexp_replace(text(value), f"(?:{_BLANK}|·)+", " "), " "), lambda w: w != "")


def token_keys(value: Column) -> Column:
    """Keys of at least two letters of the words of a name of several words; else none."""
    words = tokens_ko(value)
    keys = F.filter(F.transform(words, jamo_key), lambda k: F.length(k) >= 2)
    return F.when(F.size(words) >= 2, keys).otherwise(F.array().cast("array<string>"))


def tokens_en(key: Column, name: Column) -> Column:
    """Words of a key, and the parts of the name as written that have three letters; honorifics are parts too."""
    parts = F.filter(F.split(F.lower(without_accents(name)), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    words = F.filter(F.split(text(key), " "), lambda w: w != "")
    return F.array_distinct(F.concat(words, parts))


def audit_words_ko(value: Column) -> Column:
    """Words but for particles, each as often as it stands."""
    words = F.filter(F.split(F.regexp_replace(text(value), f"{_BLANK}+", " "), " "), lambda w: w != "")
    return F.filter(words, lambda w: ~w.isin(*t.KO_STOP))


def audit_words_en(value: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(without_accents(value)), "[^a-z0-9 ]+", " "), " +")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*t.EN_STOP))


def without_ko_prefix(value: Column) -> Column:
    """What follows a generic first word; null if there is none or what follows is a single character."""
    parts = F.split(text(value), " ", 2)
    rest = F.get(parts, F.lit(1))
    return F.when(F.get(parts, F.lit(0)).isin(*t.KO_PREFIXES) & (F.length(rest) >= 2), rest)


def _compatible_letters(value: Column) -> Column:
    """Compatibility decomposition, as far as it brings out ASCII letters and digits: marks stay behind their letters."""

    def parts(c: Column) -> Column:
        code, out = F.ascii(c), c
        for first, letters in t.plain_ranges():
            out = F.when(code.between(first, first + len(letters) - 1), F.get(_table(letters), (code - first).cast("int"))).otherwise(out)
        return out

    return F.array_join(F.transform(characters(value), parts), "")


def slug(value: Column, longest: int = 40, default: str = "edit") -> Column:
    """A name as part of a path: ASCII letters and digits, a hyphen for whatever stands between, marks of letters too."""
    whole = text(value)
    letters = F.when(F.octet_length(whole) == F.length(whole), whole).otherwise(_compatible_letters(whole))
    plain = F.lower(F.regexp_replace(F.regexp_replace(letters, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))
    cut = F.substring(plain, 1, longest)
    return F.when(cut == "", default).otherwise(cut)


def canonical_name(type_: Column, number: Column) -> Column:
    """Three letters of the type and a number of five digits or more."""
    return F.concat(F.substring(type_, 1, 3), F.format_string("%05d", number))


def type_code(type_: Column) -> Column:
    return F.substring(type_, 1, 1)


def type_label(code: Column) -> Column:
    """The display label of a type's code; null for others."""
    out = F.lit(None).cast("string")
    for k, label in t.TYPE_LABELS.items():
        out = F.when(code == k, label).otherwise(out)
    return out
