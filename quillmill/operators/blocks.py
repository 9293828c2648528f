"""Blocks for delivery: mapping from fragments, tree checks, batches, sizes, hashes.

A document's blocks are ordered by (order_index, block_id). Counting batches is a window; batches with a byte cap and the
closing hash are ordered folds that stream, so a huge document needs no more memory than a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillmill.functions import ids
from quillmill.functions.text import strip
from quillmill.operators.folding import ordered_fold

MAX_BLOCKS = 128
#: Fragment types as block types, and block types as wire numbers.
BLOCK_TYPE = {"SECTION": "SECTION", "PARAGRAPH": "PARAGRAPH", "LIST": "LIST", "TABLE": "TABLE", "CODE": "CODE", "OCR": "PARAGRAPH", "OTHER": "PARAGRAPH"}
WIRE_TYPE = {"DOCUMENT": 1, "SECTION": 2, "PARAGRAPH": 3, "LIST": 4, "LIST_ITEM": 5, "TABLE": 6, "TABLE_ROW": 7, "CODE": 8}
DOC = ["document_id", "document_version"]


def lookup(table: dict, c: Column, default=None) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(m, c)
    return found if default is None else F.coalesce(found, F.lit(default))


def from_fragments(fr: DataFrame) -> DataFrame:
    """One block for each fragment under a synthetic root; native, no shuffle but the one of the roots' distinct."""
    ok = fr.where("error_code is null")
    root = F.concat_ws(":", F.lit("document"), F.col("document_id"), F.col("document_version").cast("string"))
    path = F.array_join("hierarchy", " / ")
    only_row = F.when(F.col("table_row_from") == F.col("table_row_to"), F.col("table_row_from"))
    meta = F.map_from_arrays(
        F.array(*[F.lit(f"fragment.{k}") for k in ("type", "splitReason", "language", "forced")]),
        F.array("fragment_type", "split_reason", "primary_language", F.col("forced").cast("string")),
    )
    body = ok.select(
        *DOC,
        F.col("fragment_id").alias("block_id"),
        root.alias("parent_block_id"),
        lookup(BLOCK_TYPE, F.col("fragment_type"), "PARAGRAPH").alias("block_type"),
        F.when(F.col("context_prefix") == "", F.col("normalized_text")).otherwise(F.concat("context_prefix", F.lit("\n\n"), "normalized_text")).alias("text"),
        (F.col("sequence") + 1).alias("order_index"),
        F.struct(F.col("page_from").alias("page_start"), F.col("page_to").alias("page_end"), path.alias("section_path"), F.try_element_at("hierarchy", F.lit(-1)).alias("heading"), only_row.alias("row_index")).alias("source_location"),
        meta.alias("metadata"),
    )
    roots = ok.select(*DOC).distinct().select(*DOC, root.alias("block_id"), F.lit(None).cast("string").alias("parent_block_id"), F.lit("DOCUMENT").alias("block_type"), F.lit("").alias("text"), F.lit(0).alias("order_index"))
    for f in body.schema.fields[7:]:
        roots = roots.withColumn(f.name, F.lit(None).cast(f.dataType))
    return roots.unionByName(body)


def tree_errors(blocks: DataFrame) -> DataFrame:
    """document_id, document_version, error_code, n: rule violations of each document's tree but for cycles, which the
    hierarchy operator finds. Grouped counts and one self join on the document and block."""
    b = blocks.select(*DOC, strip(F.coalesce("block_id", F.lit(""))).alias("id"), strip(F.coalesce("parent_block_id", F.lit(""))).alias("parent"), "block_type", "order_index")

    def per(code: str, cond: str) -> DataFrame:
        return b.where(cond).groupBy(*DOC).count().select(*DOC, F.lit(code).alias("error_code"), F.col("count").alias("n"))

    def repeated(code: str, col: str) -> DataFrame:
        x = b.where(f"{col} is not null").groupBy(*DOC, col).count().where("count > 1")
        return x.groupBy(*DOC).count().select(*DOC, F.lit(code).alias("error_code"), F.col("count").alias("n"))

    roots = b.groupBy(*DOC).agg(F.count_if(F.col("block_type") == "DOCUMENT").alias("n")).where("n <> 1").select(*DOC, F.lit("ROOT_COUNT").alias("error_code"), "n")
    known = b.select(*DOC, F.col("id").alias("parent")).distinct()
    orphans = b.where("parent <> '' and parent <> id").join(known, [*DOC, "parent"], "left_anti")
    orphans = orphans.groupBy(*DOC).count().select(*DOC, F.lit("PARENT_MISSING").alias("error_code"), F.col("count").alias("n"))
    return (
        per("BLOCK_ID_BLANK", "id = ''")
        .unionByName(per("ORDER_INDEX_NEGATIVE", "order_index < 0 or order_index is null"))
        .unionByName(per("SELF_PARENT", "parent = id and id <> ''"))
        .unionByName(repeated("BLOCK_ID_DUPLICATE", "id"))
        .unionByName(repeated("ORDER_INDEX_DUPLICATE", "order_index"))
        .unionByName(roots)
        .unionByName(orphans)
    )


def wire_size(block_id: Column, parent: Column, text: Column, metadata: Column) -> Column:
    """UTF-8 bytes of ids, text, and metadata keys and values."""
    e = F.lit("")
    own = sum((F.octet_length(F.coalesce(c, e)) for c in (parent, text)), F.octet_length(F.coalesce(block_id, e)))
    entries = F.coalesce(F.map_entries(metadata), F.array().cast("array<struct<key:string,value:string>>"))
    return (own + F.aggregate(entries, F.lit(0), lambda a, x: a + F.octet_length(x["key"]) + F.coalesce(F.octet_length(x["value"]), F.lit(0)))).cast("long")


def batches(blocks: DataFrame, most: int = MAX_BLOCKS) -> DataFrame:
    """Adds batch_index, position and last_batch by count alone. One sort by document, which spills."""
    w = W.partitionBy(*DOC).orderBy("order_index", "block_id")
    n = F.row_number().over(w) - 1
    x = blocks.withColumn("_n", n).withColumn("batch_index", F.floor(F.col("_n") / most).cast("int")).withColumn("position", (F.col("_n") % most).cast("int"))
    total = blocks.groupBy(*DOC).agg(F.count("*").alias("_total"))
    return x.join(total, DOC).withColumn("last_batch", F.col("batch_index") == F.floor((F.col("_total") - 1) / most)).drop("_n", "_total")


def batches_by_size(blocks: DataFrame, max_bytes: int, most: int = MAX_BLOCKS) -> DataFrame:
    """document_id, document_version, block_id, batch_index, position, bytes, error_code: a batch ends before a block that
    would pass the count or the bytes; a block that is too large alone is an error."""
    x = blocks.select(*DOC, "order_index", "block_id", wire_size(F.col("block_id"), F.col("parent_block_id"), F.col("text"), F.col("metadata")).alias("bytes"))

    def fold(key: tuple, rows: Iterator) -> Iterator[tuple]:
        batch = n = size = 0
        for r in rows:
            if r.bytes > max_bytes:
                yield (*key, r.block_id, None, None, r.bytes, "BLOCK_EXCEEDS_BATCH_BYTES")
                continue
            if n and (n >= most or size + r.bytes > max_bytes):
                batch, n, size = batch + 1, 0, 0
            yield (*key, r.block_id, batch, n, r.bytes, None)
            n, size = n + 1, size + r.bytes

    return ordered_fold(x, DOC, ["order_index", "block_id"], fold, "document_id string, document_version long, block_id string, batch_index int, position int, bytes long, error_code string")


def content_hashes(blocks: DataFrame) -> DataFrame:
    """document_id, document_version, blocks, content_sha256 over the rendered blocks in order, hashed as they stream."""
    head = F.col("source_location.heading")
    x = blocks.select(*DOC, "order_index", "block_id", ids.rendered_block(F.col("text"), head).alias("rendered"))

    def fold(key: tuple, rows: Iterator) -> Iterator[tuple]:
        h, n = hashlib.sha256(), 0
        for r in rows:
            h.update(r.rendered.encode("utf-8", "surrogatepass"))
            n += 1
        yield (*key, n, h.hexdigest())

    return ordered_fold(x, DOC, ["order_index", "block_id"], fold, "document_id string, document_version long, blocks long, content_sha256 string")


def batch_hashes(batched: DataFrame) -> DataFrame:
    """One row for each batch with its canonical content hash; a group has at most MAX_BLOCKS rows."""
    loc = F.struct(*[F.col(f"source_location.{k}").alias(k) for k in ("page_start", "page_end", "char_start", "char_end", "section_path", "heading")])
    loc = F.when(F.col("source_location").isNotNull(), loc)
    one = F.struct("position", "block_id", "parent_block_id", lookup(WIRE_TYPE, F.col("block_type"), 0).alias("block_type"), "text", "order_index", "metadata", loc.alias("source_location"))
    g = batched.groupBy(*DOC, "batch_index").agg(F.array_sort(F.collect_list(one), lambda a, b: a["position"] - b["position"]).alias("blocks"))

    @F.pandas_udf(StringType())
    def hashed(s: pd.Series) -> pd.Series:
        def clean(b: dict) -> dict:
            m = b.get("metadata")
            return {**b, "metadata": dict(m) if m is not None else {}}

        return s.map(lambda bs: ids.batch_hash([clean(b) for b in bs]))

    return g.select(*DOC, "batch_index", F.size("blocks").alias("n_blocks"), hashed("blocks").alias("batch_sha256"))
