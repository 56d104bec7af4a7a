"""Small text steps that depend on their own result: overlap merges, highlights, balanced JSON, tags."""

from __future__ import annotations

import difflib
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vector import each, each_pair


def _sounds(text: str) -> str:
    """What counts when texts are compared: compatibility decomposition without separators and punctuation."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c)[0] not in "ZP")


def merge_overlap(before: str, after: str, least: int = 4) -> str:
    """``after`` joined to ``before`` where the end of one is the beginning of the other, by ``least`` decomposed letters.

    ``after`` loses characters as they are written until those lost hold the overlap; without one, a space parts the two.
    """
    if not before or not after:
        return before or after
    x, y = _sounds(before), _sounds(after)
    common = next((n for n in range(min(len(x), len(y)), least - 1, -1) if x.endswith(y[:n])), 0)
    if not common:
        return before + ("" if before.endswith(" ") or after.startswith(" ") else " ") + after
    cut = held = 0
    while cut < len(after) and held < common:
        held += len(_sounds(after[cut]))
        cut += 1
    return before + after[cut:]


merged = each_pair(merge_overlap, "string")


def highlight(a: str, b: str) -> str:
    """``b`` with the parts that differ from ``a`` in brackets."""
    parts = []
    for kind, _, _, lo, hi in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if hi > lo:
            parts.append(b[lo:hi] if kind == "equal" else f"[{b[lo:hi]}]")
    return "".join(parts)


highlighted = each_pair(highlight, "string")


def balanced_json(text: str) -> str | None:
    """The first object with balanced braces, strings respected; None without one."""
    start = text.find("{")
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)) if start >= 0 else ():
        c = text[i]
        if quoted:
            escaped, quoted = c == "\\" and not escaped, not (c == '"' and not escaped)
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : i + 1]
    return None


json_object = each(balanced_json, "string")


def tag_chunks(text: str) -> list[dict[str, str]]:
    """Text and parenthesised effects in their order."""
    out = []
    for part in re.split(r"(\([^()]*\))", text):
        if part.strip():
            effect = part.startswith("(") and part.endswith(")")
            out.append({"kind": "sfx" if effect else "text", "value": part.strip("() \t\n") if effect else part.strip()})
    return out


chunks = each(tag_chunks, "array<struct<kind:string,value:string>>")


def dbfs(samples: Column) -> Column:
    """Level of samples in -1..1 against full scale."""
    square = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x) / F.greatest(F.lit(1), F.size(samples))
    return 20 * F.log10(F.sqrt(square + 1e-12) + 1e-12)


def count_cosine(a: Column, b: Column) -> Column:
    """Cosine of the count vectors of two token arrays."""
    keys = F.array_union(a, b)
    n = lambda tokens, k: F.size(F.filter(tokens, lambda x: x == k)).cast("double")
    dot = F.aggregate(F.transform(keys, lambda k: n(a, k) * n(b, k)), F.lit(0.0), lambda s, x: s + x)
    size = lambda t: F.sqrt(F.aggregate(F.transform(F.array_distinct(t), lambda k: n(t, k) * n(t, k)), F.lit(0.0), lambda s, x: s + x))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), dot / (size(a) * size(b))).otherwise(0.0)


def samples_of_ms(ms: Column, rate: int) -> Column:
    """Samples of a time in milliseconds, rounded half to even."""
    return F.bround(ms * rate / 1000).cast("long")
