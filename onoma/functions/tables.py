"""Fixed values of the name engine, and tables that follow from Unicode by rule."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache
from itertools import pairwise

# ---- Fixed values: foldings of conjoining jamo. Tense and aspirated consonants become plain, finals become
# initials (clusters by their sounding part; the final ng is kept), vowels lose their semivowel, in one pass.
CONSONANT_FOLD = {
    "ᄁ": "ᄀ", "ᄏ": "ᄀ", "ᄄ": "ᄃ", "ᄐ": "ᄃ", "ᄈ": "ᄇ", "ᄑ": "ᄇ", "ᄍ": "ᄌ", "ᄎ": "ᄌ", "ᄊ": "ᄉ",
    "ᆨ": "ᄀ", "ᆩ": "ᄀ", "ᆪ": "ᄀ", "ᆫ": "ᄂ", "ᆬ": "ᄂ", "ᆭ": "ᄂ", "ᆮ": "ᄃ", "ᆯ": "ᄅ", "ᆰ": "ᄅ", "ᆱ": "ᄅ", "ᆲ": "ᄅ", "ᆳ": "ᄅ",
    "ᆴ": "ᄅ", "ᆵ": "ᄅ", "ᆶ": "ᄅ", "ᆷ": "ᄆ", "ᆸ": "ᄇ", "ᆹ": "ᄇ", "ᆺ": "ᄉ", "ᆻ": "ᄉ", "ᆽ": "ᄌ", "ᆾ": "ᄌ", "ᆿ": "ᄀ", "ᇀ": "ᄃ",
    "ᇁ": "ᄇ", "ᇂ": "ᄒ",
}
VOWEL_FOLD = {"ᅢ": "ᅦ", "ᅣ": "ᅡ", "ᅤ": "ᅨ", "ᅧ": "ᅥ", "ᅨ": "ᅦ", "ᅫ": "ᅰ", "ᅬ": "ᅰ", "ᅭ": "ᅩ", "ᅲ": "ᅮ"}
SILENT = "ᄋ"
IGNORED = "·-–—.,'\"()"
#: Letters that cost little to insert or delete.
CHEAP = ("ᅳ", "ᅮ", "ᄅ")
CHEAP_COST, SWAP_COST = 0.3, 0.6

# ---- Fixed values: keys of the Korean keyboard, by compatibility jamo; clusters are two keys.
KEYS = {
    "ㄱ": "r", "ㄲ": "R", "ㄳ": "rt", "ㄴ": "s", "ㄵ": "sw", "ㄶ": "sg", "ㄷ": "e", "ㄸ": "E", "ㄹ": "f", "ㄺ": "fr", "ㄻ": "fa",
    "ㄼ": "fq", "ㄽ": "ft", "ㄾ": "fx", "ㄿ": "fv", "ㅀ": "fg", "ㅁ": "a", "ㅂ": "q", "ㅃ": "Q", "ㅄ": "qt", "ㅅ": "t", "ㅆ": "T",
    "ㅇ": "d", "ㅈ": "w", "ㅉ": "W", "ㅊ": "c", "ㅋ": "z", "ㅌ": "x", "ㅍ": "v", "ㅎ": "g",
    "ㅏ": "k", "ㅐ": "o", "ㅑ": "i", "ㅒ": "O", "ㅓ": "j", "ㅔ": "p", "ㅕ": "u", "ㅖ": "P", "ㅗ": "h", "ㅘ": "hk", "ㅙ": "ho",
    "ㅚ": "hl", "ㅛ": "y", "ㅜ": "n", "ㅝ": "nj", "ㅞ": "np", "ㅟ": "nl", "ㅠ": "b", "ㅡ": "m", "ㅢ": "ml", "ㅣ": "l",
}

# ---- Fixed values: words and patterns of names.
EN_PREFIX = r"chateau|ch\.|domaine|dom\.|tenuta|bodegas?|vina|vinedo|weingut|maison|casa|castello|quinta|marchesi|marques\s+de"
KO_PREFIXES = ("샤토", "샤또", "도멘", "메종", "비냐", "비녜도", "테누타", "보데가스", "포데레", "아지엔다", "칸티나", "클로")
TIERS = "DOCG|DOCa|DOC|DOP|IGT|IGP|AOC|AOP|AVA|PGI|PDO|IPR|VR|RDD|VDP|DO"
TYPES = ("grape", "region", "producer")
TYPE_LABELS = {"p": "생산자", "r": "지역", "g": "품종"}
SOURCE_PRIORITY = {"manual": 0, "producer": 0, "added": 1, "wikidata": 2, "auto": 3, "alias": 4, "stripped": 5}
OTHER_PRIORITY = 3
KO_STOP = ("드", "디", "다", "델", "델라", "데", "뒤", "라", "르", "레", "이", "에", "아", "폰", "돈", "앤", "에이")
EN_STOP = ("de", "di", "du", "da", "del", "della", "dello", "dei", "delle", "la", "le", "les", "el", "il", "lo", "y", "e", "et", "and", "the", "of", "von", "van", "d", "l", "a", "au", "aux", "dal")

# ---- Fixed values: categories of the audit.
TRUNCATED, TYPES_ERROR, TYPES_CHECK = "원어명 유실 의심", "타입 중복 (오류 의심)", "타입 중복 (확인 필요)"
NO_HANGUL, NO_ORIGINAL, MIXED_ORIGINAL, HOMONYM = "한글명에 한글 없음", "원어명 비어있음", "원어명에 한글 섞임", "동일 한글명 → 다른 원어"

# ---- By rule. Conjoining jamo are in the order of the syllable formula: 19 initials, 21 vowels, 28 finals.
INITIALS = [chr(0x1100 + i) for i in range(19)]
VOWELS = [chr(0x1161 + i) for i in range(21)]
FINALS = ["", *(chr(0x11A8 + i) for i in range(27))]


def folded(jamo: str) -> str:
    """One letter of a key: a consonant or a vowel folded once, nothing for the silent initial."""
    out = CONSONANT_FOLD.get(jamo, VOWEL_FOLD.get(jamo, jamo))
    return "" if out == SILENT else out


def compatible(jamo: str) -> str:
    """The compatibility jamo of a conjoining one: both are named alike but for their place."""
    name = unicodedata.name(jamo, "")
    for place in ("CHOSEONG", "JUNGSEONG", "JONGSEONG"):
        if f" {place} " in name:
            try:
                return unicodedata.lookup(name.replace(f"HANGUL {place}", "HANGUL LETTER"))
            except KeyError:
                return jamo
    return jamo


def keys_of(jamo: str) -> str:
    return KEYS.get(compatible(jamo), "")


def decomposed(first: int, last: int) -> list[str]:
    """Canonical decompositions of the code points in a range."""
    return [unicodedata.normalize("NFD", chr(i)) for i in range(first, last + 1)]


#: Ranges with precomposed letters of Latin, Greek and Cyrillic script.
LETTER_RANGES = ((0xC0, 0x24F), (0x370, 0x4FF), (0x1E00, 0x1FFF))


def plain_letters() -> tuple[str, str]:
    """Letters that decompose into one letter with marks, and these letters, place by place."""
    pairs = [(chr(a + i), d[0]) for a, b in LETTER_RANGES for i, d in enumerate(decomposed(a, b)) if len(d) > 1 and all(unicodedata.combining(c) for c in d[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@lru_cache
def plain_ranges(gap: int = 48) -> list[tuple[int, list[str]]]:
    """(first code point, compatibility decompositions from there on) of the ranges where any holds an ASCII letter or digit."""
    held = [i for i in range(0x80, sys.maxunicode + 1) if any(c.isascii() and c.isalnum() for c in unicodedata.normalize("NFKD", chr(i)))]
    cuts = [i for i, (a, b) in enumerate(pairwise(held), 1) if b - a > gap]
    ends = zip([0, *cuts], [*cuts, len(held)], strict=True)
    return [(held[a], [unicodedata.normalize("NFKD", chr(c)) for c in range(held[a], held[b - 1] + 1)]) for a, b in ends]


def conjoining() -> str:
    """All conjoining jamo, for text that comes decomposed."""
    return "".join(chr(i) for i in range(0x1100, 0x1200))


#: White space as Java's \s does not know it, but names may hold it.
SPACES = "".join(chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace())
