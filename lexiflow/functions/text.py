"""Text columns: normalising, tokens, ids, tags, blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HANGUL = "[가-힣]"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: str | Column) -> Column:
    """White space of any kind off both ends, null as empty."""
    return F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?U)^\s+|\s+$", "")


def norm(x: str | Column) -> Column:
    """Trimmed, lower case, null as empty (H1)."""
    return F.lower(strip(x))


def collapse(x: str | Column) -> Column:
    """Runs of white space as one space (H2)."""
    return strip(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?U)\s+", " "))


def collapse_lines(x: str | Column) -> Column:
    """White space collapsed within lines; lines stay, several empty ones become one (H3)."""
    x = F.regexp_replace(F.coalesce(_c(x), F.lit("")), "\r\n?", "\n")
    x = F.regexp_replace(x, r"[ \t\x0B\f]+", " ")
    x = F.regexp_replace(x, r" ?\n ?", "\n")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def apply_fixes(x: str | Column, fixes: list[tuple[str, str]], question: str) -> Column:
    """Regex fixes in order, then a full stop unless the text ends in punctuation or has a question clue (H4)."""
    x = collapse(x)
    for pattern, to in fixes:
        x = F.regexp_replace(x, pattern, to)
    return F.when((x == "") | x.rlike(r"[.!?。？！]$") | x.rlike(question), x).otherwise(F.concat(x, F.lit(".")))


def join_dialogue(turns: str | Column, sep: str = "\n", limit: int | None = None) -> Column:
    """``speaker: text`` lines of turns with a text, without a speaker the text alone (H5)."""
    said = F.filter(turns, lambda t: strip(t["text"]) != "")
    said = said if limit is None else F.slice(said, 1, limit)
    return F.array_join(F.transform(said, lambda t: F.when(strip(t["speaker"]) == "", strip(t["text"])).otherwise(F.concat(strip(t["speaker"]), F.lit(": "), strip(t["text"])))), sep)


def mapped(x: str | Column, table: dict[str, str], default: str | None = None) -> Column:
    """Value of a key in a small table of constants."""
    out = None
    for k, v in table.items():
        out = F.when(norm(x) == k, v) if out is None else out.when(norm(x) == k, v)
    return out.otherwise(F.lit(default))


def first_rule(x: str | Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """Value of the first rule whose pattern matches (H7)."""
    out = None
    for pattern, value in rules:
        out = F.when(_c(x).rlike(pattern), value) if out is None else out.when(_c(x).rlike(pattern), value)
    return out.otherwise(F.lit(default))


def script_ratio(x: str | Column, script: str = HANGUL) -> Column:
    """Characters of a script over those that are no separators (H8)."""
    x = F.coalesce(_c(x), F.lit(""))
    return F.length(F.regexp_replace(x, script.replace("[", "[^", 1), "")) / F.greatest(F.lit(1), F.length(F.regexp_replace(x, r"[\p{Z}\s]", "")))


def tokens(x: str | Column, pattern: str = HANGUL + "+") -> Column:
    """Runs that match a pattern (H9)."""
    return F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(pattern), F.lit(0))


def hangul_words(x: str | Column) -> Column:
    """Words with all but Hangul taken out."""
    return F.filter(F.split(collapse(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"[^가-힣\s]", " ")), " "), lambda w: w != "")


def syllables(x: str | Column) -> Column:
    """Number of Hangul syllables."""
    return F.length(F.regexp_replace(F.coalesce(_c(x), F.lit("")), "[^가-힣]", ""))


def symbol_ids(x: str | Column, symbols: list[str]) -> Column:
    """Ids of known characters, others left out."""
    table = F.map_from_arrays(F.array(*map(F.lit, symbols)), F.array(*(F.lit(i) for i in range(len(symbols)))))
    return F.filter(F.transform(F.filter(F.split(_c(x), ""), lambda c: c != ""), lambda c: F.element_at(table, c)), lambda i: i.isNotNull())


def from_symbol_ids(ids: str | Column, symbols: list[str]) -> Column:
    """Text of ids."""
    return F.array_join(F.transform(ids, lambda i: F.element_at(F.array(*map(F.lit, symbols)), i + 1)), "")


def trim_punctuation(x: str | Column) -> Column:
    """Punctuation and white space off both ends."""
    return F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?U)^[\p{P}\p{S}\s]+|[\p{P}\p{S}\s]+$", "")


def slug(x: str | Column, limit: int = 80) -> Column:
    """A name safe for files: letters, digits, dots and dashes, others as one underscore."""
    return F.substring(F.regexp_replace(F.regexp_replace(strip(x), r"[^\p{L}\p{N}._-]+", "_"), "^_+|_+$", ""), 1, limit)


def stable_id(*columns: str, length: int = 40) -> Column:
    """SHA-1 of the columns as JSON with sorted keys."""
    return F.substring(F.sha1(F.to_json(F.struct(*sorted(columns)))), 1, length)


def item_id(path: str | Column, text: str | Column) -> Column:
    """First 16 digits of the SHA-1 of the normalised path and the text."""
    return F.substring(F.sha1(F.concat(normal_path(path), F.lit("|"), strip(text))), 1, 16)


def normal_path(path: str | Column) -> Column:
    """Slashes one way, lower case, trimmed."""
    return norm(F.regexp_replace(F.coalesce(_c(path), F.lit("")), r"\\", "/"))


def mime(path: str | Column) -> Column:
    """Kind of an audio file by its extension."""
    end = F.lower(F.regexp_extract(_c(path), r"\.([A-Za-z0-9]+)$", 1))
    return mapped(end, {"wav": "audio/wav", "mp3": "audio/mpeg", "ogg": "audio/ogg", "m4a": "audio/mp4", "webm": "audio/webm"}, "application/octet-stream")


def speaker_id(speaker: str | Column) -> Column:
    """1 for the first voice (A, male, 남), 2 for the second (B, female, 여), else 1."""
    return F.when(_c(speaker).rlike(r"(?i)^\s*(b|f|female|woman|여)"), 2).otherwise(1)


def json_block(x: str | Column) -> Column:
    """From the first to the last brace, without commas before a closing one."""
    return F.regexp_replace(F.regexp_extract(_c(x), r"(?s)\{.*\}", 0), r",\s*([}\]])", "$1")


def tagged_block(x: str | Column, tag: str) -> Column:
    """Text between [TAG] and [/TAG]."""
    return strip(F.regexp_extract(_c(x), rf"(?is)\[{tag}\](.*?)\[/{tag}\]", 1))


def correction_parts(x: str | Column, mark: str = r"(?:설명|Explanation)\s*[:：]") -> Column:
    """Correction before a mark and explanation after it."""
    return F.struct(strip(F.regexp_extract(_c(x), rf"(?s)^(.*?)(?:{mark}|$)", 1)).alias("correction"), strip(F.regexp_extract(_c(x), rf"(?s){mark}(.*)$", 1)).alias("explanation"))


def sentences(x: str | Column) -> Column:
    """Sentences with their end marks."""
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(r"[^.!?…。？！]+[.!?…。？！]*"), F.lit(0)), strip), lambda s: s != "")


def valid_explanation(x: str | Column, banned: list[str]) -> Column:
    """Not empty and without any banned part."""
    x = norm(x)
    out = x != ""
    for b in banned:
        out = out & ~x.contains(b.lower())
    return out


def same_answer(answer: str | Column, given: str | Column) -> Column:
    """Equal but for case and spaces; null without an answer."""
    return F.when(strip(answer) == "", F.lit(None)).otherwise(F.upper(strip(answer)) == F.upper(strip(given)))


def bare(x: str | Column) -> Column:
    """Separators and punctuation taken out (H43, after compatibility folding)."""
    return F.regexp_replace(_c(x), r"[\p{Z}\p{P}]", "")


def meaningful(x: str | Column, least: int = 2) -> Column:
    """Why a text means nothing: empty, too short, punctuation only, no Hangul; null if it does."""
    t = strip(x)
    return F.when(t == "", "empty").when(F.length(t) < least, "too_short").when(bare(t) == "", "punctuation").when(~t.rlike(HANGUL), "no_hangul")
