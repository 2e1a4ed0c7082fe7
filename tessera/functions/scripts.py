"""Names in other scripts as Latin letters, for keys that records are blocked on: near to how they sound, not a standard.

Alphabets have a small table each. Indian scripts follow a rule: Unicode names say how each letter sounds, a consonant
without a vowel sign has the vowel a, unless a word ends there. Other scripts stay as they are. All column expressions;
only names that hold letters of a script pay for it. Survey: NRM1.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.binding import bind

CYRILLIC = dict(zip("абвгдезийклмнопрстуфхыэ", "abvgdeziyklmnoprstufhye")) | {
    "ё": "yo", "ж": "zh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ь": "", "ю": "yu", "я": "ya", "і": "i", "ї": "yi", "є": "ye", "ґ": "g", "ў": "w", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "c", "ђ": "dj", "џ": "dz",
}
GREEK = dict(zip("αβγδεζηικλμνοπρσςτυφω", "avgdeziiklmnoprsstyfo")) | {"θ": "th", "ξ": "x", "χ": "ch", "ψ": "ps"}
ARABIC = dict(zip("ابتجحدرزسصضطظعفقكلمنهويةىأإآءئؤپگکیڤ", "abtjhdrzssdtzafqklmnhwyaaaiaaywpgkyv")) | {"ث": "th", "خ": "kh", "ذ": "dh", "ش": "sh", "غ": "gh", "چ": "ch", "ژ": "zh"}
HEBREW = dict(zip("אבגדהוזחטיכךלמםנןסעפףקרת", "abgdhvzhtykklmmnnsappkrt")) | {"צ": "ts", "ץ": "ts", "ש": "sh"}
#: First and last characters of the Indian scripts, by their Unicode names.
INDIAN = {"DEVANAGARI": 0x0900, "BENGALI": 0x0980, "GURMUKHI": 0x0A00, "GUJARATI": 0x0A80, "ORIYA": 0x0B00, "TAMIL": 0x0B80, "TELUGU": 0x0C00, "KANNADA": 0x0C80, "MALAYALAM": 0x0D00}
_VOWELS = {"A": "a", "AA": "a", "I": "i", "II": "i", "U": "u", "UU": "u", "E": "e", "EE": "e", "AI": "ai", "O": "o", "OO": "o", "AU": "au", "VOCALIC R": "ri", "VOCALIC RR": "ri", "VOCALIC L": "li"}
_SIGNS = {"VIRAMA": "", "NUKTA": "", "ANUSVARA": "n", "CANDRABINDU": "n", "VISARGA": "h", "BINDI": "n", "TIPPI": "n", "ADDAK": ""}


def _sound(name: str) -> tuple[str, str] | None:
    """(kind, Latin letters) of an Indian character by what its name says of it."""
    sign, vowel = name.removeprefix("SIGN "), name.removeprefix("VOWEL SIGN ").removeprefix("LETTER ")
    if sign in _SIGNS:
        return ("virama" if sign == "VIRAMA" else "nukta" if sign == "NUKTA" else "mark"), _SIGNS[sign]
    vowel = vowel.removeprefix("SHORT ").removeprefix("CANDRA ")
    if vowel in _VOWELS:
        return ("sign" if name.startswith("VOWEL SIGN") else "vowel"), _VOWELS[vowel]
    if name.startswith("LETTER ") and vowel.endswith("A") and vowel.isalpha():
        letters = vowel[:-1].lower()
        while len(letters) > 1 and letters[0] == letters[1]:  # letters made further back are written twice or three times
            letters = letters[1:]
        return "consonant", {"c": "ch", "ch": "chh", "v": "v"}.get(letters, letters)
    return None


def _indian(script: str, start: int) -> tuple[dict[str, str], str, str, str]:
    """Letters of a script, its consonants, what takes a consonant's own vowel away, and its nukta, as parts of a pattern."""
    table, consonants, taking, nukta = {}, "", "", ""
    for ch in map(chr, range(start, start + 0x80)):
        name = unicodedata.name(ch, "")
        found = _sound(name.removeprefix(f"{script} ")) if name.startswith(f"{script} ") else None
        if found:
            kind, table[ch] = found
            consonants += ch if kind == "consonant" else ""
            taking += ch if kind in ("sign", "virama") else ""
            nukta += f"{ch}?+" if kind == "nukta" else ""
    return table, consonants, taking, nukta


def _digits(first: int, last: int) -> dict[str, str]:
    return {chr(i): str(unicodedata.digit(chr(i))) for i in range(first, last) if unicodedata.category(chr(i)) == "Nd"}


def _replaced(c: Column, table: dict[str, str]) -> Column:
    letters = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.array_join(F.transform(F.split(c, ""), lambda ch: F.coalesce(F.element_at(letters, ch), ch)), "")


def _range(first: int, last: int) -> str:
    return rf"[\x{{{first:x}}}-\x{{{last:x}}}]"


def romanized(c: Column) -> Column:
    """Lower-case text with the letters of the scripts above as Latin ones; the rest, and null, as it is."""
    steps: list[tuple[str, Callable[[Column], Column]]] = []
    for table, first, last in ((CYRILLIC, 0x400, 0x4FF), (GREEK, 0x370, 0x3FF), (HEBREW, 0x590, 0x5FF), (ARABIC | _digits(0x600, 0x700), 0x600, 0x6FF)):
        # letters with accents are their letters, vowel points are nothing
        accents = {chr(i): table[base] for i in range(first, last + 1) if (base := unicodedata.normalize("NFD", chr(i)).lower()[0]) in table and chr(i) not in table}
        points = {chr(i): "" for i in range(first, last + 1) if unicodedata.category(chr(i)) == "Mn"}
        steps.append((_range(first, last), lambda x, t=table | accents | points: _replaced(x, t)))
    for script, start in INDIAN.items():
        table, consonants, taking, nukta = _indian(script, start)
        # the inherent vowel: after a consonant that neither a sign nor the end of the word follows
        own = rf"([{consonants}]{nukta})(?={_range(start, start + 0x7F)})(?![{taking}])"
        steps.append((_range(start, start + 0x7F), lambda x, p=own, t=table | _digits(start, start + 0x80): _replaced(F.regexp_replace(x, p, "$1a"), t)))
    other = "[" + "".join(pattern[1:-1] for pattern, _ in steps) + "]"

    def every(text: Column) -> Column:
        for pattern, step in steps:
            text = bind(text, lambda x: F.when(x.rlike(pattern), step(x)).otherwise(x))
        return text

    return bind(c, lambda text: F.when(text.rlike(other), every(text)).otherwise(text))
