"""Hangul syllables and jamo."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vector import each

#: Letters of a syllable's three places, in the order of the Unicode block.
ONSETS = list("ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ")
VOWELS = list("ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ")
CODAS = ["", *"ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"]
FIRST, LAST = 0xAC00, 0xD7A3


def is_syllable(c: str) -> bool:
    return len(c) == 1 and FIRST <= ord(c) <= LAST


def parts(c: str) -> tuple[int, int, int]:
    """Places of a syllable's onset, vowel and coda."""
    n = ord(c) - FIRST
    return n // 588, n % 588 // 28, n % 28


def syllable(onset: int, vowel: int, coda: int = 0) -> str:
    return chr(FIRST + onset * 588 + vowel * 28 + coda)


def jamo(x: str | Column) -> Column:
    """Compatibility jamo of a text, other characters as they are: column arithmetic only."""
    x = F.col(x) if isinstance(x, str) else x
    pick = lambda table, i: F.element_at(F.array(*map(F.lit, table)), i.cast("int") + 1)

    def split(c: Column) -> Column:
        n = F.ascii(c) - FIRST
        return F.when((n >= 0) & (n <= LAST - FIRST), F.concat(pick(ONSETS, F.floor(n / 588)), pick(VOWELS, F.floor(n % 588 / 28)), pick(CODAS, n % 28))).otherwise(c)

    return F.array_join(F.transform(F.split(F.coalesce(x, F.lit("")), ""), split), "")


def skeleton(x: str | Column) -> Column:
    """Jamo without codas: onset and vowel of each syllable (K6)."""
    x = F.col(x) if isinstance(x, str) else x
    open_ = lambda c: F.when(F.ascii(c).between(FIRST, LAST), F.concat(F.element_at(F.array(*map(F.lit, ONSETS)), F.floor((F.ascii(c) - FIRST) / 588).cast("int") + 1), F.element_at(F.array(*map(F.lit, VOWELS)), F.floor((F.ascii(c) - FIRST) % 588 / 28).cast("int") + 1))).otherwise(c)
    return F.array_join(F.transform(F.split(F.coalesce(x, F.lit("")), ""), open_), "")


def compose_text(text: str) -> str:
    """Syllables from compatibility jamo, greedily: a consonant before a vowel is its onset."""
    out: list[str] = []
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c in ONSETS and i + 1 < n and text[i + 1] in VOWELS:
            o, v, t, i = ONSETS.index(c), VOWELS.index(text[i + 1]), 0, i + 2
            if i < n and text[i] in CODAS and not (i + 1 < n and text[i + 1] in VOWELS):
                t, i = CODAS.index(text[i]), i + 1
            out.append(syllable(o, v, t))
        else:
            out.append(c)
            i += 1
    return "".join(out)


compose = each(compose_text, "string")


def normalised(form: str):
    """A column function for a Unicode normal form."""
    return each(lambda t: unicodedata.normalize(form, t), "string")


def letters_of(text: str, space: bool = False, ascii_: bool = False, punctuation: bool = False) -> list[str]:
    """Jamo of a text and, as asked for, spaces, ASCII letters and digits, and punctuation."""
    out: list[str] = []
    for c in unicodedata.normalize("NFC", text):
        if is_syllable(c):
            o, v, t = parts(c)
            out += [ONSETS[o], VOWELS[v], *([CODAS[t]] if t else [])]
        elif c in ONSETS or c in VOWELS or c in CODAS[1:] or (space and c.isspace()) or (ascii_ and c.isascii() and c.isalnum()) or (punctuation and unicodedata.category(c)[0] == "P"):
            out.append(c)
    return out


def jamo_letters(**options: bool):
    return each(lambda t: letters_of(t, **options), "array<string>")


def chunks_of(text: str) -> list[tuple[str, list[str]]]:
    """Each syllable with the punctuation after it, and its jamo."""
    out: list[tuple[str, list[str]]] = []
    for c in unicodedata.normalize("NFC", text):
        if is_syllable(c):
            out.append((c, letters_of(c)))
        elif out and unicodedata.category(c)[0] == "P":
            out[-1] = (out[-1][0] + c, out[-1][1])
    return out


syllable_chunks = each(lambda t: [{"label": a, "jamos": b} for a, b in chunks_of(t)], "array<struct<label:string,jamos:array<string>>>")
