"""Secret scans with multipart credential linking.

A task finds the parts of credentials in whole texts: access identifiers, secrets and endpoints. Certain ones (assigned
values, access identifiers, long hexadecimal runs) are reported as they are. Others are weak: an account name, a mixed
run of letters and digits, an address. Parts of one paragraph meet in an interval join over cells of positions, and a
weak part is reported, with the nearest part that completes it, only if one of another role stands within reach and one
of the two is a secret. A cell holds no more parts than its characters have room for, so no key grows with the corpus.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import materialise, text_bytes, texts

#: Kinds of parts in the order in which they are listed; the first three are certain.
KINDS = ("assign", "access", "hex", "endpoint", "id", "key")
CERTAIN = 3
#: What each kind is: identifier, secret or endpoint.
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "endpoint": "endpoint", "id": "identifier", "key": "secret"}
#: Most characters between two parts that are linked, and characters of a cell of the join.
REACH, CELL = 200, 256

_ASSIGNED = r"""["']?\x20*[:=]\x20*["']?"""
PATTERNS = {
    "assign": rf"(password|passwd|secret|token|api_?key){_ASSIGNED}([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
    "endpoint": r"\b(https?|ftp|sftp|ssh|postgres|postgresql|mysql|mongodb|redis|amqp)://[!#-&(-;=?-~]{4,}",
    "id": rf"\b(user|user_?name|login|account_?id|client_?id|access_?key_?id){_ASSIGNED}([A-Za-z0-9@._+-]+)",
    "key": r"[A-Za-z0-9+/_-]{20,}",
}
#: Least characters of the value (the second group) of a kind that has one.
LEAST = {"assign": 8, "id": 4}
BREAK = r"\n[\x20\t\r]*\n"

_FIND = {k: re.compile(p.encode(), re.IGNORECASE if k in ("assign", "id", "endpoint") else 0) for k, p in PATTERNS.items()}
_BREAK = re.compile(BREAK.encode())
_HEX = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256))
_RUN = bytes(120 if chr(c).isascii() and (chr(c).isalnum() or c in b"+/_-") else 32 for c in range(256))


def _possible(data: bytes) -> dict[str, bool]:
    """Kinds that can be in a text, by plain searches: most texts hold none."""
    low, equals = data.lower(), b"=" in data or b":" in data
    return {
        "assign": equals and any(x in low for x in (b"passw", b"secret", b"token", b"api")),
        "access": b"AKIA" in data,
        "hex": b"x" * 32 in data.translate(_HEX),
        "endpoint": b"://" in data,
        "id": equals and any(x in low for x in (b"user", b"login", b"account", b"client", b"access")),
        "key": b"x" * 20 in data.translate(_RUN),
    }


def _apart(found: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap none of ``taken``."""
    taken = sorted(taken)
    starts, ends, most = [a for a, _ in taken], [], 0
    for _, b in taken:
        most = max(most, b)
        ends.append(most)
    return [(a, b) for a, b in found if not (at := bisect_left(starts, b)) or ends[at - 1] <= a]


def parts_of(data: bytes) -> list[tuple[str, int, int, int]]:
    """Parts (kind, start, end, paragraph) of a text; offsets are code points, ends exclusive.

    Matches of a kind are leftmost and don't overlap; too short ones are dropped after matching. A weak part that overlaps
    a certain one, or a weak one of a kind listed before its own, is none.
    """
    found: dict[str, list[tuple[int, int]]] = {}
    for kind, can in _possible(data).items():
        spans = [m.span() for m in _FIND[kind].finditer(data) if kind not in LEAST or m.end(2) - m.start(2) >= LEAST[kind]] if can else []
        if kind == "key":
            mixed = lambda x: any(48 <= c <= 57 for c in x) and any(65 <= c <= 90 for c in x) and any(97 <= c <= 122 for c in x)
            spans = [(a, b) for a, b in spans if mixed(data[a:b])]
        found[kind] = spans
    certain = [x for k in KINDS[:CERTAIN] for x in found[k]]
    for kind in KINDS[CERTAIN:]:
        found[kind] = _apart(found[kind], certain)
        certain = certain + found[kind]
    if not certain:
        return []
    breaks = [m.end() for m in _BREAK.finditer(data)]
    places = sorted({x for span in certain for x in span})
    if data.isascii():
        point = {x: x for x in places}
    else:
        point, at, n = {}, 0, 0
        for x in places:
            n += len(data[at:x].decode("utf-8", "replace"))
            point[x], at = n, x
    return [(k, point[a], point[b], bisect_right(breaks, a)) for k in KINDS for a, b in found[k]]


_PART = StructType([StructField("start", LongType()), StructField("kind", StringType()), StructField("end", LongType()), StructField("scope", LongType())])
_ARROW = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("scope", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, weak = [], []
        for data in texts(batch):
            parts = parts_of(data)
            for out, sure in ((base, True), (weak, False)):
                out.append([{"start": a, "kind": k, "end": b, "scope": s} for k, a, b, s in parts if (KINDS.index(k) < CERTAIN) == sure])
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(base, pa.list_(_ARROW)), pa.array(weak, pa.list_(_ARROW))], ["doc_id", "base", "weak"])


def _number(kind: str) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), F.col(kind))


def _role(kind: str) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair)), F.col(kind))


def linked(parts: DataFrame, reach: int = REACH, cell: int = CELL) -> DataFrame:
    """Weak parts (row, scope, start, kind, end) that another part completes, with the nearest one as ``partner`` (kind, start, end).

    ``parts`` has ``row``, ``scope``, ``start``, ``kind`` and ``end``. Parts meet in the cells that a weak one
    covers and the other one reaches; of equally near ones the first counts.
    """
    every = parts.withColumn("role", _role("kind"))
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / cell), F.floor(b / cell))).alias("cell")
    weak = every.where(~F.col("kind").isin(*KINDS[:CERTAIN])).select("row", "scope", "start", "kind", "end", "role", cells(F.col("start"), F.col("end")))
    other = every.select("row", "scope", F.col("start").alias("a"), F.col("kind").alias("what"), F.col("end").alias("b"), F.col("role").alias("as"), cells(F.greatest(F.lit(0), F.col("start") - reach), F.col("end") + reach))
    gap = F.greatest(F.col("a") - F.col("end"), F.col("start") - F.col("b"))
    met = weak.join(other, ["row", "scope", "cell"]).where(gap.between(0, reach) & (F.col("role") != F.col("as")) & (F.array_contains(F.array("role", "as"), "secret")))
    nearest = F.min(F.struct(gap.alias("gap"), F.col("a"), _number("what").alias("n"), F.col("what"), F.col("b"))).alias("m")
    one = met.groupBy("row", "scope", "start", "kind", "end").agg(nearest)
    return one.select("row", "scope", "start", "kind", "end", F.struct(F.col("m.what").alias("kind"), F.col("m.a").alias("start"), F.col("m.b").alias("end")).alias("partner"))


def secret_scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """A row for each document (doc_id, text): ``base`` spans and ``linked`` spans, each an array (start, kind, end, partner) in order.

    Null and empty texts have none; every row is scanned by itself, so rows of one doc_id stay apart; further columns are
    ignored. Partners are null for base spans. Texts are read once and never shuffled: what is written and joined are
    parts. A document's parts are one row.
    """
    found = materialise(docs.select("doc_id", text_bytes().alias("text")).mapInArrow(_scan, StructType([docs.schema["doc_id"], StructField("base", ArrayType(_PART)), StructField("weak", ArrayType(_PART))])).withColumn("row", F.monotonically_increasing_id()))
    some = found.where(F.size("weak") > 0)
    parts = some.select("row", F.inline(F.concat("base", "weak")))
    spans = linked(parts, reach).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", _number("kind").alias("n"), "kind", "end", "partner"))).alias("l"))
    partner = "struct<kind:string,start:bigint,end:bigint>"
    base = F.transform(F.array_sort(F.transform("base", lambda x: F.struct(x["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("n"), x["kind"].alias("kind"), x["end"].alias("end")))), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.lit(None).cast(partner).alias("partner")))
    more = F.transform("l", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["partner"].alias("partner")))
    none = F.array().cast(f"array<struct<start:bigint,kind:string,end:bigint,partner:{partner}>>")
    with_links = some.join(spans, "row", "left").select("doc_id", base.alias("base"), F.coalesce(more, none).alias("linked"))
    return found.where(F.size("weak") == 0).select("doc_id", base.alias("base"), none.alias("linked")).unionByName(with_links)


def listed(*arrays: str) -> Column:
    """Spans of array columns as ``kind:start:end``, by start, then kind as listed, comma-joined."""
    spans = F.concat(*(F.transform(a, lambda x: F.struct(x["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("n"), x["end"].alias("end"), x["kind"].alias("kind"))) for a in arrays))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
