"""Prepared artifacts: content-addressed parts of JSON lines, a manifest written last as the commit, verified reading.

Records are cut into parts by count and bytes within each document in an ordered fold; parts are written by Spark in one
job, partitioned by artifact, and the manifest is one row for each part with its digest. Immutable: writing the same
digest again changes nothing, another digest under the same name is a conflict.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import ids
from quillmill.operators.folding import ordered_fold
from quillmill.runtime import hadoop_fs, written

SCHEMA_VERSION = "quillmill-prepared-v1"
MAX_RECORDS = 10_000
MAX_BYTES = 32 << 20
BUCKETS, FOLDERS = 4096, 256
PARTS = "document_id string, document_version long, kind string, part int, record_count long, byte_count long, sha256 string, body string"


def canonical_records(df: DataFrame, kind: str, order: str) -> DataFrame:
    """document_id, document_version, kind, pos, record: each row as canonical JSON."""
    rest = [c for c in df.columns if c not in ("document_id", "document_version")]
    js = F.to_json(F.struct("document_id", "document_version", *rest), {"ignoreNullFields": "false"})
    return df.select("document_id", "document_version", F.lit(kind).alias("kind"), F.col(order).cast("long").alias("pos"), ids.canonical_json_of(js).alias("record"))


def parts(records: DataFrame, max_records: int = MAX_RECORDS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """PARTS: lines in order; a part ends before the record that would pass the count or the bytes. Holds one part."""

    def fold(key: tuple, rows: Iterator) -> Iterator[tuple]:
        held: list[str] = []
        size = k = 0

        def part() -> tuple:
            body = "".join(held)
            return (*key, k, len(held), size, hashlib.sha256(body.encode()).hexdigest(), body)

        for r in rows:
            line = r.record + "\n"
            n = len(line.encode())
            if held and (len(held) >= max_records or size + n > max_bytes):
                yield part()
                held, size, k = [], 0, k + 1
            held.append(line)
            size += n
        if held:
            yield part()

    return ordered_fold(records, ["document_id", "document_version", "kind"], ["pos", "record"], fold, PARTS, emit=1)


def artifact_id(manifest: DataFrame) -> DataFrame:
    """document_id, document_version, artifact_id: over the digests of the parts in order; parts of a document are few."""
    one = F.sort_array(F.collect_list(F.struct("kind", "part", "sha256")))
    g = manifest.groupBy("document_id", "document_version").agg(one.alias("p"))
    joined = F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["kind"], x["part"].cast("string"), x["sha256"])), "\n")
    return g.select("document_id", "document_version", F.sha2(F.concat_ws("\n", F.lit(SCHEMA_VERSION), "document_id", F.col("document_version").cast("string"), joined), 256).alias("artifact_id"))


def manifest_digest(manifest: DataFrame) -> str:
    """Over all entries, in a tree: of each of BUCKETS buckets first, then over the digests of the buckets."""
    entry = F.concat_ws(":", "artifact_id", "kind", F.col("part").cast("string"), "sha256")
    leaf = manifest.select(F.pmod(F.xxhash64("artifact_id"), F.lit(BUCKETS)).alias("b"), entry.alias("e"))
    leaf = leaf.groupBy("b").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("e")), "\n"), 256).alias("d"))
    top = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda x: F.concat_ws(":", x["b"].cast("string"), x["d"])), "\n")
    return leaf.agg(F.sha2(top, 256)).first()[0]


def publish(p: DataFrame, root: str) -> str:
    """Writes the parts in FOLDERS folders, then the manifest; the target is named by the digest of the manifest, so equal
    artifacts are put once and others never overwrite them. What a publication that died has left is written anew. Returns
    the path."""
    spark = p.sparkSession
    p = written(p, "parts")
    manifest = written(p.drop("body").join(artifact_id(p), ["document_id", "document_version"]), "manifest")
    target = f"{root.rstrip('/')}/{manifest_digest(manifest)}"
    fs, done = hadoop_fs(spark, f"{target}/manifest/_SUCCESS")
    if put_decision(fs.exists(done), True) == "WRITE":
        p.withColumn("folder", F.pmod(F.xxhash64("document_id"), F.lit(FOLDERS))).write.mode("overwrite").partitionBy("folder").parquet(f"{target}/parts")
        manifest.write.mode("overwrite").parquet(f"{target}/manifest")
    return target


def verify(spark: SparkSession, target: str) -> bool:
    """Whether the manifest is the one its path names."""
    return manifest_digest(spark.read.parquet(f"{target}/manifest")) == target.rstrip("/").rpartition("/")[2]


def load(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame]:
    """(records, errors): lines of the parts whose digest, bytes and count are those of the manifest; other parts with
    an error code."""
    man = spark.read.parquet(f"{target}/manifest").withColumnsRenamed({c: f"m_{c}" for c in ("record_count", "byte_count", "sha256")}).drop("artifact_id")
    got = spark.read.parquet(f"{target}/parts")
    keys = ["document_id", "document_version", "kind", "part"]
    x = man.join(got.select(*keys, "body"), keys, "left")
    code = (
        F.when(F.col("body").isNull(), "PART_MISSING")
        .when(F.octet_length("body") != F.col("m_byte_count"), "PART_BYTES_MISMATCH")
        .when(F.sha2("body", 256) != F.col("m_sha256"), "PART_HASH_MISMATCH")
        .when(~F.endswith("body", F.lit("\n")), "PART_TRUNCATED")
        .when(F.regexp_count("body", F.lit("\n")) != F.col("m_record_count"), "PART_COUNT_MISMATCH")
    )
    x = x.withColumn("error_code", code)
    lines = x.where("error_code is null").select(*keys, F.posexplode(F.split(F.expr("left(body, length(body) - 1)"), "\n")).alias("pos", "record"))
    return lines, x.where("error_code is not null").select(*keys, "error_code")


def put_decision(exists: bool, same: bool) -> str:
    """What putting an immutable object comes to: written where nothing is, unchanged where the same is, else a conflict."""
    return "WRITE" if not exists else "UNCHANGED" if same else "CONFLICT"


def totals(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("document_id", "document_version").agg(
        F.sum(F.when(F.col("kind") == "elements", F.col("record_count")).otherwise(0)).alias("element_records"),
        F.sum(F.when(F.col("kind") == "fragments", F.col("record_count")).otherwise(0)).alias("fragment_records"),
        F.sum("byte_count").alias("bytes"),
        F.count("*").alias("parts"),
    )

