"""Canonical exam records from several raw shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm, strip

LETTERS = ["A", "B", "C", "D"]


def first_filled(*columns: str | Column) -> Column:
    """The first column that is neither null nor blank (B2)."""
    cs = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.coalesce(*(F.when(strip(c) != "", strip(c)) for c in cs), F.lit(""))


def passage(text: Column, lines: Column) -> Column:
    """A passage given as text or as lines."""
    return F.when(strip(text) != "", strip(text)).otherwise(F.coalesce(F.array_join(F.filter(F.transform(lines, strip), lambda x: x != ""), "\n"), F.lit("")))


def dialogue(lines: Column) -> Column:
    """``speaker: text`` lines as turns; a line without a speaker has an empty one."""
    named = r"^\s*([^:：\s][^:：]{0,15}?)\s*[:：]\s*(.+)$"
    return F.transform(F.filter(lines, lambda x: strip(x) != ""), lambda x: F.struct(F.regexp_extract(x, named, 1).alias("speaker"), F.when(x.rlike(named), strip(F.regexp_extract(x, named, 2))).otherwise(strip(x)).alias("text")))


def choices(options: Column) -> Column:
    """A map of options with keys A, B, .. : letters as they are, digits in their numeric order."""
    entries = F.array_sort(F.transform(F.map_entries(options), lambda e: F.struct(F.coalesce(e["key"].try_cast("int"), F.ascii(F.upper(e["key"])) - 64).alias("n"), e["value"].alias("v"))))
    return F.map_from_entries(F.transform(entries, lambda e, i: F.struct(F.element_at(F.array(*(F.lit(chr(65 + k)) for k in range(26))), i + 1).alias("key"), strip(e["v"]).alias("value"))))


def answer_letter(answer: Column, n: int = 4) -> Column:
    """A letter from a letter or a number, numbers from 1; null if it is neither."""
    a = F.upper(strip(answer.cast("string")))
    number = a.try_cast("int")
    return F.when(a.isin([chr(65 + i) for i in range(n)]), a).when(number.between(1, n), F.element_at(F.array(*(F.lit(chr(65 + i)) for i in range(n))), number))


def answer_index(answer: Column) -> Column:
    """0-based place of an answer: a letter, else a number from 1, else 0."""
    a = F.upper(strip(answer.cast("string")))
    return F.when(a.rlike("^[A-Z]$"), F.ascii(a) - 65).when(a.try_cast("int") >= 1, a.try_cast("int") - 1).otherwise(0)


def canonical(columns: dict[str, Column]) -> Column:
    """A nested record of the canonical version from its parts."""
    c = columns
    return F.struct(
        F.lit("1.2").alias("version"), c["id"].alias("id"), c["pack_id"].alias("pack_id"), c["question_no"].cast("int").alias("question_no"), c["section"].alias("section"), c["level"].alias("level"),
        F.struct(F.when(c["passage"] == "", "none").otherwise("text").alias("mode"), c["passage"].alias("text_ko")).alias("passage"),
        F.struct(c["question"].alias("prompt_ko"), F.transform(F.map_entries(c["options"]), lambda e: F.struct(e["key"].alias("label"), e["value"].alias("text_ko"))).alias("choices"), c["answer"].alias("answer")).alias("question"),
    )


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, null for a clean row."""
    out = None
    for name, failed in rules:
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return out if out is not None else F.lit(None).cast("string")


def all_reasons(rules: list[tuple[str, Column]]) -> Column:
    """Names of all rules that hold."""
    return F.array_compact(F.array(*(F.when(failed, name) for name, failed in rules)))


def question_rules(min_turns: int = 1, letters: int = 4, places: list[str] | None = None) -> list[tuple[str, Column]]:
    """Rules for exam items (question, dialogue, options, answer, score): first broken one is the reason."""
    said = F.filter("dialogue", lambda t: strip(t["text"]) != "")
    rules = [
        ("no_question", strip("question") == ""),
        ("few_turns", F.coalesce(F.size(said), F.lit(0)) < min_turns),
        ("bad_options", F.coalesce(F.size("options"), F.lit(0)) != letters),
        ("empty_option", F.exists(F.map_values("options"), lambda x: strip(x) == "")),
        ("same_options", F.size(F.array_distinct(F.map_values("options"))) < F.size("options")),
        ("bad_answer", answer_letter(F.col("answer"), letters).isNull()),
        ("bad_score", ~F.coalesce(F.col("score").between(1, 5), F.lit(False))),
    ]
    return rules + ([("bad_place", ~F.col("answer_text").isin(places))] if places else [])


def segment_ok(no_speech: Column, logprob: Column, compression: Column) -> Column:
    """Recognised segments worth keeping."""
    return (no_speech <= 0.6) & (logprob >= -1.0) & (compression <= 2.4)


def clip_decision(total_ms: Column, speech_ratio: Column, lead_ms: Column, tail_ms: Column, gap_ms: Column, least: int = 400, ratio: float = 0.3, edge: int = 500, gap: int = 1200) -> Column:
    """drop, trim or keep with the reason."""
    why = F.when(total_ms < least, "short").when(speech_ratio < ratio, "silence").when(gap_ms > gap, "gap")
    return F.struct(F.when(why.isNotNull(), "drop").when((lead_ms > edge) | (tail_ms > edge), "trim").otherwise("keep").alias("action"), F.coalesce(why, F.lit("")).alias("reason"))


def speech_labels(label: Column, silent: list[str]) -> Column:
    """Labels that are speech."""
    return ~norm(label).isin([x.lower() for x in silent])


def route(text: Column, keywords: list[str]) -> Column:
    """math for many digits, essay for long texts, vocabulary for keywords, else general."""
    digits = F.length(F.regexp_replace(text, "[^0-9]", "")) / F.greatest(F.lit(1), F.length(text))
    return F.when(digits > 0.3, "math").when(F.length(text) > 400, "essay").when(text.rlike("|".join(keywords)), "vocabulary").otherwise("general")


def path_parts(path: Column) -> Column:
    """level, section, question and option of a path such as ``topik1/listen/27-28/...``."""
    p = F.regexp_replace(path, r"\\", "/")
    return F.struct(
        F.regexp_extract(p, r"topik(\d)", 1).try_cast("int").alias("level"), F.regexp_extract(p, r"topik\d/([a-z]+)/", 1).alias("section"),
        F.regexp_extract(p, r"/(\d+)(?:-\d+)?/", 1).try_cast("int").alias("first_question"), F.regexp_extract(p, r"_([A-D])\.[a-z0-9]+$", 1).alias("option"),
    )


def shuffled(options: Column, row_id: Column, seed: str) -> Column:
    """Options in a fixed random order with new letters: (old, new, text)."""
    keyed = F.array_sort(F.transform(F.map_entries(options), lambda e: F.struct(F.md5(F.concat(F.lit(f"{seed}|"), row_id.cast("string"), F.lit("|"), e["key"])).alias("h"), e["key"].alias("old"), e["value"].alias("text"))))
    return F.transform(keyed, lambda e, i: F.struct(e["old"].alias("old"), F.element_at(F.array(*(F.lit(chr(65 + k)) for k in range(26))), i + 1).alias("new"), e["text"].alias("text")))


def relabelled(answer: Column, order: Column) -> Column:
    """The new letter of an answer."""
    return F.get(F.transform(F.filter(order, lambda e: e["old"] == answer), lambda e: e["new"]), F.lit(0))


def remapped_scores(scores: Column, order: Column) -> Column:
    """A map of scores by old letters, by new ones."""
    return F.map_from_entries(F.transform(order, lambda e: F.struct(e["new"].alias("key"), F.element_at(scores, e["old"]).alias("value"))))


def view(record: Column, with_passage: bool) -> Column:
    """Pack and from-passage views of a canonical record."""
    parts = [record["id"].alias("id"), record["question"]["prompt_ko"].alias("prompt"), record["question"]["choices"].alias("choices"), record["question"]["answer"].alias("answer")]
    return F.struct(*parts, *([record["passage"]["text_ko"].alias("passage")] if with_passage else [record["pack_id"].alias("pack_id")]))


def with_defaults(topic: Column, turns: Column, speakers: list[str]) -> tuple[Column, Column]:
    """Topic ``misc`` and speakers in turn where they are missing."""
    names = F.array(*map(F.lit, speakers))
    return F.when(strip(topic) == "", "misc").otherwise(strip(topic)), F.transform(turns, lambda t, i: F.struct(F.when(strip(t["speaker"]) == "", F.element_at(names, (i % len(speakers)) + 1)).otherwise(strip(t["speaker"])).alias("speaker"), t["text"].alias("text")))


def last_turns(turns: Column, n: int = 5) -> Column:
    """The last ``n`` elements."""
    return F.when(F.size(turns) > n, F.slice(turns, -n, n)).otherwise(turns)


def redacted(fields: Column, secret: str = r"(?i)key|token|secret|password|phone") -> Column:
    """A map with the values of secret keys masked."""
    return F.transform_values(fields, lambda k, v: F.when(k.rlike(secret), "***").otherwise(v))


def repaired_score(score: Column, question_no: Column, by_number: dict[tuple[int, int], int], default: int = 3) -> Column:
    """A score out of range replaced by that of the question's number range."""
    out = F.when(score.between(1, 5), score)
    for (lo, hi), value in by_number.items():
        out = out.when(question_no.between(lo, hi), value)
    return out.otherwise(default)
