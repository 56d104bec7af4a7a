"""Stores that several writers share: derived values put once (A5, A6, A28), rows updated where they lie."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import discard, shared_table


class Store:
    """Rows of a schema with a unique ``key``, in folders that a log of numbered files makes visible.

    A writer looks up which keys are new, writes them to a folder of its own, and then takes the next number of the log by
    renaming a file, which fails if the number is taken. It then looks again, without the keys that have come meanwhile,
    and takes the number after. So a key is stored once, whoever writes at the same time, and a lost run leaves nothing
    visible. The log names each writer's batches: a batch that is replayed is passed over.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "key"):
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key
        self.jvm = spark._jvm
        hadoop = self.jvm.org.apache.hadoop.fs
        self.path = hadoop.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.files = self.path(self.root).getFileSystem(conf)
        self.context = hadoop.FileContext.getFileContext(self.path(self.root).toUri(), conf)
        self.files.mkdirs(self.path(f"{self.root}/log"))

    def log(self) -> list[dict]:
        """Entries of the log in order."""
        names = sorted(x.getPath().toString() for x in self.files.listStatus(self.path(f"{self.root}/log")) if x.getPath().getName().isdigit())
        return [json.loads(r["value"]) for r in self.spark.read.text(names).collect()] if names else []

    def rows(self, since: int = 0) -> DataFrame:
        """Stored rows, of the log's entries from a number on."""
        folders = [f"{self.root}/data/{e['folder']}" for e in self.log() if e["number"] >= since]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _take(self, entry: dict) -> bool:
        held = f"{self.root}/log/.{uuid.uuid4().hex}"
        out = self.files.create(self.path(held), False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        try:
            self.context.rename(self.path(held), self.path(f"{self.root}/log/{entry['number']:020d}"), self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as error:
            self.files.delete(self.path(held), False)
            if "FileAlreadyExistsException" not in str(error.java_exception):
                raise
            return False
        return True

    def put(self, rows: DataFrame, writer: str, batch: int, build=None) -> int:
        """Stores the rows whose key isn't there, one of each key, and says how many; ``build`` makes the stored columns of new rows only."""
        seen, fresh = 0, rows.dropDuplicates([self.key])
        while True:
            log = self.log()
            if any(e["writer"] == writer and e["batch"] == batch for e in log):
                return 0
            number = 1 + max((e["number"] for e in log), default=-1)
            fresh = fresh.join(self.rows(seen).select(self.key), self.key, "left_anti")
            fresh, seen, build = (build(fresh) if build else fresh), number, None  # what has been built isn't built again
            folder = uuid.uuid4().hex
            fresh.select(*(f.split()[0] for f in self.schema.split(", "))).write.parquet(f"{self.root}/data/{folder}")
            fresh = self.spark.read.schema(self.schema).parquet(f"{self.root}/data/{folder}")
            if self._take({"number": number, "folder": folder, "writer": writer, "batch": batch}):
                return fresh.count()

    def sink(self, writer: str, build=None):
        """``foreachBatch`` function of a stream that puts its rows; batches keep their numbers over restarts."""
        return lambda rows, batch: self.put(rows, writer, batch, build)


def write_buckets(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    """Rows in as many folders as ``buckets``, by the hash of their key."""
    rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).repartition("_bucket").write.partitionBy("_bucket").parquet(path)


def read_buckets(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, _bucket long").parquet(path)


def update_buckets(spark: SparkSession, path: str, schema: str, updates: DataFrame, key: str, buckets: int) -> int:
    """Non-null fields of ``updates`` put into the rows of their key (A8); rewrites the buckets that hold such keys only, and says how many.

    Updates without a row change nothing. Of several updates of one key the one with the largest fields counts.
    """
    fields = [c for c in updates.columns if c != key]
    new = updates.groupBy(key).agg(F.max(F.struct(*fields)).alias("_new")).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    hit = [r["_bucket"] for r in new.select("_bucket").distinct().collect()]  # at most as many as there are buckets
    old = read_buckets(spark, path, schema).where(F.col("_bucket").isin(hit))
    done = old.join(new, [key, "_bucket"], "left").withColumns({c: F.coalesce(f"_new.{c}", c) for c in fields}).select(*old.columns)
    held = shared_table(done)
    held.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
    discard(held)
    return len(hit)
