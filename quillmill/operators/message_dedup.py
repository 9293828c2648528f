"""Messages delivered more than once: a keyed store that keeps one copy of each.

History is a table of winners in partitions by the month received. An identifier index maps the 128-bit hash of
an identity to the partitions that may hold it. merge() looks the incoming identities up there, reads only the
affected partitions, recomputes single winners together with the incoming rows, writes the new partitions beside
the old ones and switches to them by creating one manifest file, which is the atomic step. Until then readers see
the old version; a job that dies before leaves only unreferenced files.

Defined results: a null or blank request id never takes part (such rows pass through untouched and are never
dropped); ids that aren't UUIDs compare as trimmed lower-case strings; a null received_at counts as the latest; on
a tie the smallest delivery_id wins; a delivery stored twice with the same delivery_id counts once; an empty table
gives an empty store. Columns beyond the identity ones are carried along under their own names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.runtime import blank_to_null, hadoop_fs

IDENTITY = ("producer_request_id", "document_id", "document_version")
FOLDER = "quillmill_month"  # names the folders of partitions


def canonical_uuid(col: Column) -> Column:
    """A UUID however written (braces, urn:uuid:, no hyphens, capitals, blanks) in its canonical form."""
    low = F.lower(blank_to_null(col))
    hexed = F.regexp_replace(F.regexp_replace(low, r"^(urn:)?uuid:", ""), r"[{}\-\s]", "")
    dashed = F.regexp_replace(hexed, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(hexed.rlike("^[0-9a-f]{32}$"), dashed).otherwise(low)


def with_identity(df: DataFrame) -> DataFrame:
    """Adds _key (binary, 128 bits; null without a request id), _part (month received) and _rank (smaller wins)."""
    rid, doc = canonical_uuid(F.col("producer_request_id")), canonical_uuid(F.col("document_id"))
    text = F.concat_ws("\x1f", rid, F.coalesce(doc, F.lit("\x1e")), F.coalesce(F.col("document_version").cast("string"), F.lit("\x1e")))
    return df.withColumns(
        {
            "_key": F.when(rid.isNotNull(), F.unhex(F.md5(text))),
            "_part": F.coalesce(F.date_format("received_at", "yyyyMM"), F.lit("999999")),
            "_rank": F.struct(F.col("received_at").isNull().alias("n"), F.col("received_at").alias("t"), F.col("delivery_id").alias("i")),
        }
    )


def winners(df: DataFrame, payload: list[str]) -> DataFrame:
    """One row for each _key: partial aggregation before the shuffle, so a hot key moves one row a task."""
    value = F.struct("_part", "_rank", *payload)
    return df.groupBy("_key").agg(F.min_by(value, "_rank").alias("_w")).select("_key", "_w.*")


@dataclass
class Manifest:
    version: int = 0
    parts: dict[str, str] = field(default_factory=dict)  # partition -> folder of its rows
    index: list[str] = field(default_factory=list)  # folders of index entries


class MessageStore:
    """spark, a folder that all executors share, and the columns to keep beside the identity."""

    def __init__(self, spark: SparkSession, path: str, payload: list[str]):
        self.spark, self.path, self.payload = spark, path.rstrip("/"), list(dict.fromkeys(payload))

    def manifest(self) -> Manifest:
        """The newest version that is whole: one that is being written doesn't count yet."""
        fs, root = hadoop_fs(self.spark, self.path)
        if not fs.exists(root):
            return Manifest()
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        versions = sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))
        for v in reversed(versions):
            stream = fs.open(hadoop_fs(self.spark, f"{self.path}/manifest-{v}.json")[1])
            try:
                return Manifest(**json.loads(bytes(stream.readAllBytes())))
            except ValueError:
                continue
            finally:
                stream.close()
        return Manifest()

    def _commit(self, m: Manifest) -> None:
        """Creates the version's file, which fails where it exists: two writers can't both win. (On a file system whose exclusive
        creation isn't atomic, such as a local disk, writers must take turns.)"""
        fs, final = hadoop_fs(self.spark, f"{self.path}/manifest-{m.version}.json")
        try:
            out = fs.create(final, False)
        except Py4JJavaError as e:
            raise RuntimeError(f"version {m.version} was committed by another writer") from e
        out.write(bytearray(json.dumps(m.__dict__).encode()))
        out.close()

    def rows(self, parts: list[str] | None = None) -> DataFrame | None:
        m = self.manifest()
        use = [m.parts[p] for p in (m.parts if parts is None else parts) if p in m.parts]
        return self.spark.read.option("recursiveFileLookup", "true").parquet(*sorted(use)) if use else None

    def affected(self, incoming: DataFrame, m: Manifest) -> list[str]:
        """Partitions that the incoming rows fall in, and those the index knows for their identities.

        The number of partitions is the number of months, so the answer is small."""
        here = incoming.select("_part").distinct()
        if m.index:
            index = self.spark.read.parquet(*m.index)
            here = here.union(index.join(incoming.select("_key").distinct(), "_key", "left_semi").select("_part").distinct())
        return sorted(r[0] for r in here.distinct().collect())

    def merge(self, incoming: DataFrame) -> Manifest:
        """incoming: raw messages. Rows without a request id don't enter the store."""
        m = self.manifest()
        new = with_identity(incoming).where("_key is not null").select("_key", "_part", "_rank", *self.payload)
        parts = self.affected(new, m) if m.parts else None
        old = self.rows(parts) if parts else None
        both = new if old is None else old.select(*new.columns).unionByName(new)
        gen = f"{self.path}/gen-{uuid.uuid4().hex}"
        # Tasks of the aggregation write their share of each month: no month is gathered in one task.
        won = winners(both, self.payload)
        won.withColumn(FOLDER, F.col("_part")).write.partitionBy(FOLDER).parquet(f"{gen}/rows")
        entries = self.spark.read.schema(won.schema).option("recursiveFileLookup", "true").parquet(f"{gen}/rows").select("_key", "_part")
        entries.write.parquet(f"{gen}/index")
        fs, p = hadoop_fs(self.spark, f"{gen}/rows")
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        made = {n.partition("=")[2]: f"{gen}/rows/{n}" for n in names if n.startswith(f"{FOLDER}=")}
        keep = {k: v for k, v in m.parts.items() if parts is None or k not in parts}
        done = Manifest(m.version + 1, keep | made, [*m.index, f"{gen}/index"] if made else m.index)
        self._commit(done)
        return done


def dropped_rows(messages: DataFrame, store: MessageStore) -> DataFrame:
    """delivery_ids that lost to another copy of the same message."""
    all_ids = messages.where(blank_to_null(F.col("producer_request_id")).isNotNull() & F.col("delivery_id").isNotNull()).select("delivery_id").distinct()
    kept = store.rows()
    return all_ids if kept is None else all_ids.join(kept.select(F.col("_rank.i").alias("delivery_id")), "delivery_id", "left_anti")


def load_in_two(messages: DataFrame, path: str, payload: list[str]) -> MessageStore:
    """History up to the last month, then that month as the incoming messages, through the index."""
    store = MessageStore(messages.sparkSession, path, payload)
    last = messages.agg(F.date_trunc("month", F.max("received_at"))).first()[0]
    store.merge(messages if last is None else messages.where(F.col("received_at") < F.lit(last)))
    if last is not None:
        store.merge(messages.where((F.col("received_at") >= F.lit(last)) | F.col("received_at").isNull()))
    return store
