"""Surface forms of Korean: how a text sounds, with the rules that applied."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .hangul import CODAS, ONSETS, VOWELS, is_syllable, parts, syllable
from .vector import each

#: Codas by their sound at the end of a syllable, and what a complex coda leaves and passes on.
SOUND = {"ㄱ": "ㄱㄲㅋㄳㄺ", "ㄷ": "ㄷㅅㅆㅈㅊㅌㅎ", "ㅂ": "ㅂㅍㅄㄿ", "ㄴ": "ㄴㄵㄶ", "ㅁ": "ㅁㄻ", "ㅇ": "ㅇ", "ㄹ": "ㄹㄼㄽㄾㅀ"}
SPLIT = {"ㄳ": "ㄱㅅ", "ㄵ": "ㄴㅈ", "ㄶ": "ㄴㅎ", "ㄺ": "ㄹㄱ", "ㄻ": "ㄹㅁ", "ㄼ": "ㄹㅂ", "ㄽ": "ㄹㅅ", "ㄾ": "ㄹㅌ", "ㄿ": "ㄹㅍ", "ㅀ": "ㄹㅎ", "ㅄ": "ㅂㅅ"}
TENSE = {"ㄱ": "ㄲ", "ㄷ": "ㄸ", "ㅂ": "ㅃ", "ㅅ": "ㅆ", "ㅈ": "ㅉ"}
ASPIRATED = {"ㄱ": "ㅋ", "ㄷ": "ㅌ", "ㅂ": "ㅍ", "ㅈ": "ㅊ"}
NASAL = {"ㄱ": "ㅇ", "ㄷ": "ㄴ", "ㅂ": "ㅁ"}
BEFORE_N = "ㅣㅑㅕㅛㅠ"
#: Rounded diphthongs without their glide, by the mode.
W_SECOND = {"ㅘ": "ㅏ", "ㅙ": "ㅐ", "ㅚ": "ㅣ", "ㅝ": "ㅓ", "ㅞ": "ㅔ", "ㅟ": "ㅣ"}
W_PERCEPTUAL = W_SECOND | {"ㅚ": "ㅔ"}

_SOUND_OF = {c: k for k, v in SOUND.items() for c in v} | {"": ""}
#: Stops by the place that their last unit sounds at.
_STOP = {c: k for k, v in {"ㄱ": "ㄱㄲㅋ", "ㄷ": "ㄷㅅㅆㅈㅊㅌ", "ㅂ": "ㅂㅍ"}.items() for c in v}


@dataclass(frozen=True)
class Options:
    """Rules to apply, one switch each (J2). Other characters than syllables always break adjacency."""

    n_insertion: bool = True
    liaison: bool = True
    palatalise: bool = True
    nasalise: bool = True
    liquidise: bool = True
    h_loss: bool = True
    aspirate: bool = True
    tensify: bool = True
    final_sounds: bool = False
    #: Vowels without their w: "off", "second" or "perceptual", and own replacements as pairs.
    collapse_w: str = "off"
    collapse_wa: bool = False
    collapse_own: tuple[tuple[str, str], ...] = ()
    #: Reading of 의: "auto" (i within a word), "i", "e" or "keep"; at the end of a group it is always e.
    eui: str = "auto"


class _Syllable:
    __slots__ = ("coda", "onset", "vowel")

    def __init__(self, c: str):
        o, v, t = parts(c)
        self.onset, self.vowel, self.coda = ONSETS[o], VOWELS[v], CODAS[t]

    def __str__(self) -> str:
        return syllable(ONSETS.index(self.onset), VOWELS.index(self.vowel), CODAS.index(self.coda))

    @property
    def last(self) -> str:
        """The last unit of the coda."""
        return SPLIT.get(self.coda, self.coda)[-1:]

    @property
    def rest(self) -> str:
        """What a coda of two units keeps when its last one goes."""
        return SPLIT[self.coda][0] if self.coda in SPLIT else ""


def _alone(s: _Syllable, o: Options, within: bool, final: bool) -> list[str]:
    """Changes of one syllable: collapsed w, readings of 의."""
    to = dict(o.collapse_own).get(s.vowel) or {"second": W_SECOND, "perceptual": W_PERCEPTUAL}.get(o.collapse_w, {}).get(s.vowel)
    if not to and o.collapse_wa and o.collapse_w == "off" and s.vowel == "ㅘ":
        to = "ㅏ"
    tags = []
    if to and to != s.vowel:
        s.vowel = to
        tags.append("collapse_w")
    if s.onset == "ㅇ" and s.vowel == "ㅢ":
        read = "ㅔ" if (final and not s.coda) or o.eui == "e" else "ㅣ" if o.eui == "i" or (o.eui == "auto" and within) else ""
        if read:
            s.vowel = read
            tags.append("eui")
    return tags


def _pair(a: _Syllable, b: _Syllable, o: Options, particle: bool) -> list[str]:
    """Changes of two neighbouring syllables, in the order of the rules; later rules and pairs see earlier changes.

    ``particle``: the second one is a bare 이 at the end of its group.
    """
    tags: list[str] = []
    linked = False
    open_ = b.onset == "ㅇ" and b.vowel in BEFORE_N and not (b.coda and b.vowel == "ㅣ")
    if o.n_insertion and open_ and a.coda and a.coda not in SPLIT and a.coda != "ㅎ" and not particle and not (a.coda in "ㄷㅌ" and b.vowel == "ㅣ"):
        b.onset = "ㄹ" if a.coda == "ㄹ" else "ㄴ"
        tags.append("n_insertion")
    if o.liaison and b.onset == "ㅇ" and a.last not in ("", "ㅇ", "ㅎ"):
        a.coda, b.onset, linked = a.rest, a.last, True
        tags.append("liaison")
    if o.palatalise and linked and b.vowel == "ㅣ" and b.onset in "ㄷㅌ":
        b.onset = "ㅈ" if b.onset == "ㄷ" else "ㅊ"
        tags.append("palatalise")
    if o.palatalise and a.last in ("ㄷ", "ㅌ") and b.onset == "ㅎ" and b.vowel == "ㅣ":
        a.coda, b.onset = a.rest, "ㅊ"
        tags.append("palatalise")
    if o.nasalise and b.onset == "ㄹ" and (a.last in ("ㅁ", "ㅇ") or _STOP.get(a.last) in ("ㄱ", "ㅂ")):
        b.onset = "ㄴ"
        tags.append("nasalise")
    if o.nasalise and b.onset in "ㄴㅁ" and a.last in _STOP:
        a.coda = NASAL[_STOP[a.last]]
        tags.append("nasalise")
    if o.liquidise and (a.last, b.onset) in (("ㄴ", "ㄹ"), ("ㄹ", "ㄴ")):
        a.coda, b.onset = "ㄹ" if a.last == "ㄴ" else a.coda, "ㄹ"
        tags.append("liquidise")
    if o.h_loss and a.last == "ㅎ" and b.onset == "ㅇ":
        if a.rest:
            b.onset, linked = a.rest, True
        a.coda = ""
        tags.append("h_loss")
    if o.aspirate and a.last == "ㅎ" and b.onset in ASPIRATED:
        a.coda, b.onset = a.rest, ASPIRATED[b.onset]
        tags.append("aspirate")
    elif o.aspirate and b.onset == "ㅎ" and b.vowel == "ㅣ" and a.last in _STOP:
        a.coda, b.onset = a.rest, ASPIRATED[_STOP[a.last]]
        tags.append("aspirate")
    if o.tensify and b.onset in TENSE:
        hard = a.last in _STOP
        soft = (a.last in ("ㄴ", "ㅁ") and b.onset in "ㄱㄷㅈ") or (a.last == "ㄹ" and b.onset in "ㄱㄷㅅㅈ" and not linked)
        if hard and a.coda in SPLIT:
            a.coda = _SOUND_OF[a.coda] if a.coda != "ㄺ" or b.onset != "ㄱ" else "ㄹ"
        if hard or soft:
            b.onset = TENSE[b.onset]
            tags.append("tensify")
    return tags


def surface(text: str, options: Options = Options()) -> tuple[str, list[tuple[str, int]]]:
    """The text as it sounds, and (rule, place of the first syllable) of each change. Other characters break adjacency."""
    out: list[str | _Syllable] = [_Syllable(c) if is_syllable(c) else c for c in text]
    tags: list[tuple[str, int]] = []
    spoken = [isinstance(s, _Syllable) for s in out] + [False]
    for i, s in enumerate(out):
        if spoken[i]:
            tags += [(t, i) for t in _alone(s, options, i > 0 and spoken[i - 1], not spoken[i + 1])]
    for i in range(len(out) - 1):
        if spoken[i] and spoken[i + 1]:
            a, b = out[i], out[i + 1]
            tags += [(t, i) for t in _pair(a, b, options, str(b) == "이" and not spoken[i + 2])]
    if options.final_sounds:
        for i, s in enumerate(out):
            if spoken[i] and s.coda and not spoken[i + 1]:
                s.coda = _SOUND_OF[s.coda]
    return "".join(map(str, out)), tags


def surface_form(options: Options = Options()):
    """A column function: struct of the surface form and its tags."""

    def on(x: str | Column) -> Column:
        def run(values: pd.Series) -> pd.DataFrame:
            done = [surface(t or "", options) for t in values]
            return pd.DataFrame({"clean": [c for c, _ in done], "tags": [[t for t, _ in tags] for _, tags in done]})

        return F.pandas_udf(run, "clean string, tags array<string>")(x)

    return on


def changes(text: str) -> list[dict]:
    """Each change with the two syllables before it and after all rules."""
    clean, tags = surface(text)
    return [{"type": t, "place": i, "before": text[i : i + 2], "after": clean[i : i + 2]} for t, i in tags]


#: Column function of ``changes``.
explained = each(changes, "array<struct<type:string,place:int,before:string,after:string>>")


#: Stops and nasals of an IPA sequence by place, their tense and aspirated forms.
IPA_NASAL = {"k̚": "ŋ", "t̚": "n", "p̚": "m"}
IPA_TENSE = {"k": "k͈", "t": "t͈", "p": "p͈", "s": "s͈", "tɕ": "t͈ɕ"}
IPA_ASPIRATED = {"k": "kʰ", "t": "tʰ", "p": "pʰ", "tɕ": "tɕʰ"}
IPA_OPEN = {"k̚": "k", "t̚": "t", "p̚": "p"}


def surface_ipa(phones: list[str]) -> list[str]:
    """The rules between neighbouring consonants on an IPA sequence: aspiration, nasals, liquids, tense stops."""
    out = list(phones)
    for i in range(len(out) - 1):
        a, b = out[i], out[i + 1]
        if a in IPA_OPEN and b == "h":
            out[i], out[i + 1] = "", IPA_ASPIRATED[IPA_OPEN[a]]
        elif a == "h" and b in IPA_ASPIRATED:
            out[i], out[i + 1] = "", IPA_ASPIRATED[b]
        elif b in ("ɾ", "l") and a in ("m", "ŋ", "k̚", "p̚"):
            out[i], out[i + 1] = IPA_NASAL.get(a, a), "n"
        elif a in IPA_NASAL and b in ("n", "m"):
            out[i] = IPA_NASAL[a]
        elif (a, b) in (("n", "ɾ"), ("n", "l"), ("l", "n")):
            out[i], out[i + 1] = "l", "l"
        elif a in IPA_OPEN and b in IPA_TENSE:
            out[i + 1] = IPA_TENSE[b]
    return [p for p in out if p]


#: Column function of ``surface_ipa``.
ipa_surface = each(surface_ipa, "array<string>")
#: Rules that hold within a word, without insertion across its parts.
IN_WORD = Options(n_insertion=False, final_sounds=True)
