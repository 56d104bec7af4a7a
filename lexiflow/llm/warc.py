"""WARC records from pages, and a fixity audit of replicas by Merkle trees.

Records are laid out in archive files by ranges of page_id, with offsets by size. Leaves are record digests; the nodes of
each level hash the ordered digests and offset ranges of ``FAN`` children, and the roots of two replicas are compared
first. Only children of nodes that differ are looked at on the next level, so an intact replica costs its roots, and a
damaged record the siblings on its path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialise

#: Page ids in one archive file; a file has at most so many places for records.
PER_FILE = 4096
#: Children of a node; PER_FILE is a power of it.
FAN = 16


def page_records(pages: DataFrame) -> DataFrame:
    """``(page_id, digest, record)`` of each row: a WARC/1.1 ``resource`` block of UTF-8 bytes and its SHA-256. No shuffle."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    url = F.coalesce("url", F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.col("page_id").cast("string"), F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Block-Digest: sha256:"), F.sha2(body, 256), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    record = F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))
    made = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), record.alias("record"))
    return made.select("page_id", F.sha2("record", 256).alias("digest"), "record")


def warc_manifest(pages: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """``(file_id, place, page_id, offset, length, digest)`` of each page (page_id, url, html); bytes of records stay where they are read.

    Files hold the ids of a range of ``per_file``; within a file records stand in the order of ids. Null urls and pages
    count as empty; rows without a page_id are left out; equal rows are one record, and of other rows of one page_id that
    with the least digest is the record. An empty table gives no rows.
    """
    made = page_records(pages).select("page_id", "digest", F.octet_length("record").cast("long").alias("length"))
    one = made.groupBy("page_id").agg(F.min(F.struct("digest", "length")).alias("r")).select("page_id", "r.digest", "r.length")
    before = W.partitionBy("file_id").orderBy("page_id").rowsBetween(W.unboundedPreceding, -1)
    file_id = F.floor(F.col("page_id") / per_file).cast("long")
    placed = one.withColumn("file_id", file_id).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return placed.select("file_id", (F.col("page_id") - F.col("file_id") * per_file).alias("place"), "page_id", "offset", "length", "digest")


def with_held(manifest: DataFrame, held: DataFrame) -> DataFrame:
    """The manifest of what a replica holds: rows of ``held`` (page_id, digest, record) with their places and the digest of their bytes."""
    taken = held.select("page_id", "digest", F.sha2("record", 256).alias("_taken")).distinct()
    return manifest.join(taken, ["page_id", "digest"]).withColumn("digest", F.col("_taken")).drop("_taken")


def warc_records(pages: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """The manifest with the bytes of each record (``record``)."""
    return warc_manifest(pages, per_file).join(page_records(pages).dropDuplicates(["page_id", "digest"]), ["page_id", "digest"])


def _leaf(digest: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.col("place").cast("string"), F.col("offset").cast("string"), F.col("length").cast("string"), digest), 256)


def merkle_levels(records: DataFrame, per_file: int = PER_FILE, fan: int = FAN) -> list[DataFrame]:
    """Nodes (file_id, node, hash) of each level, leaves first and one root for each file last.

    A leaf covers a record's place, offset, length and digest; a node the numbers and hashes of its at most ``fan`` children in order.
    """
    level = records.select("file_id", F.col("place").alias("node"), _leaf(F.col("digest")).alias("hash"))
    out, width = [level], per_file
    while width > 1:
        up = F.floor(F.col("node") / fan).cast("long")
        part = F.concat_ws(":", F.col("node").cast("string"), "hash")
        level = level.withColumn("up", up).groupBy("file_id", "up").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("node", part.alias("part")))).getField("part"), "|"), 256).alias("hash")).select("file_id", F.col("up").alias("node"), "hash")
        level = materialise(level)  # a fraction of 1 / fan of the one below, which is computed once
        out.append(level)
        width = -(-width // fan)
    return out


def differing_leaves(left: DataFrame, right: DataFrame, per_file: int = PER_FILE, fan: int = FAN) -> DataFrame:
    """``(file_id, node)`` of leaves that differ or stand on one side only, found from the roots down."""
    ours, theirs = merkle_levels(left, per_file, fan), merkle_levels(right, per_file, fan)
    bad = None
    for mine, other in zip(reversed(ours), reversed(theirs), strict=True):
        if bad is not None:  # children of differing nodes only
            under = bad.select("file_id", F.col("node").alias("up"))
            mine, other = (x.withColumn("up", F.floor(F.col("node") / fan).cast("long")).join(under, ["file_id", "up"], "left_semi") for x in (mine, other))
        both = mine.select("file_id", "node", F.col("hash").alias("a")).join(other.select("file_id", "node", F.col("hash").alias("b")), ["file_id", "node"], "full")
        before, bad = bad, materialise(both.where("not (a <=> b)").select("file_id", "node"))
        discard(*([before] if before is not None else []))
    discard(*ours[1:], *theirs[1:])
    return bad


def fixity_audit(records: DataFrame, replica: DataFrame, per_file: int = PER_FILE, fan: int = FAN) -> DataFrame:
    """``(page_id, file_id, offset, length, digest, status)`` of every record of either side.

    Both have the columns of a manifest; where ``replica`` has ``record``, digests are taken anew from these bytes. Status
    is ``ok``, ``corrupt`` (both sides have the place, with other bytes, offset or length), ``missing`` (not in the replica) or
    ``extra`` (only there; its own offset, length and digest are given). Empty tables give every record of the other
    side as missing or extra.
    """
    ours = materialise(records.select("file_id", "place", "page_id", "offset", "length", "digest"))
    theirs = materialise(replica.select("file_id", "place", "page_id", "offset", "length", (F.sha2("record", 256) if "record" in replica.columns else F.col("digest")).alias("digest")))
    bad = differing_leaves(ours, theirs, per_file, fan).select("file_id", F.col("node").alias("place"), F.lit(True).alias("bad"))
    key = ["file_id", "place"]
    other = theirs.select(*key, *(F.col(c).alias(f"r_{c}") for c in ("page_id", "offset", "length", "digest")))
    rows = ours.join(bad, key, "left").where("bad is null").select(*ours.columns, F.lit("ok").alias("status"))
    found = bad.select(*key).join(ours, key, "left").join(other, key, "left")
    status = F.when(F.col("r_page_id").isNull(), "missing").when(F.col("page_id").isNull(), "extra").otherwise("corrupt")
    found = found.select(*key, *(F.coalesce(c, f"r_{c}").alias(c) for c in ("page_id", "offset", "length", "digest")), status.alias("status"))
    return rows.select(found.columns).union(found).select("page_id", "file_id", "offset", "length", "digest", "status")
