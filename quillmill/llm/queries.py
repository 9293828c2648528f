"""Queries of the training-data operators on text. Sizes are parameters of the operators, at their production values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import chunking, langid, leakage, lookalike, packing, scan_noise, sentences, truncation
from quillmill.llm.sql import SQL  # noqa: F401
from quillmill.runtime import read_table, written

PLAIN = ("PARAGRAPH", "LIST_ITEM", "CAPTION")
WITHOUT_LANGUAGE = ("CODE_BLOCK", "TABLE")


def _elements(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return read_table(spark, sf, "normalized_element").select("source_element_id", *columns)


def _language_segments(spark: SparkSession, sf: str) -> DataFrame:
    x = _elements(spark, sf, "element_type", "normalized_text", "language_hint").where(~F.col("element_type").isin(*WITHOUT_LANGUAGE))
    model = langid.train(x, "source_element_id", "normalized_text", "language_hint")
    return langid.segments(x, "source_element_id", "normalized_text", "language_hint", model)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    x = _language_segments(spark, sf).where("lang <> 'und'").groupBy("id").agg(F.collect_set("lang").alias("langs"), F.max("hint").alias("named"))  # at most 16
    x = x.where((F.size("langs") > 1) | F.col("named").isNull() | ~F.array_contains("langs", F.coalesce("named", F.lit(""))))
    return x.select(F.col("id").alias("source_element_id"), F.explode("langs").alias("lang"))


def p1_segments(spark: SparkSession, sf: str) -> DataFrame:
    return _language_segments(spark, sf).distinct().select(F.col("id").alias("source_element_id"), "segment", "start", "end", "lang", F.round("confidence", 4).alias("confidence"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    x = _elements(spark, sf, "original_text")
    table = lookalike.learn(x, "original_text")
    return lookalike.pairs_of(written(lookalike.looks(x, "source_element_id", "original_text", table), "looks"))


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    """p2_found as membership in classes, with the number of links of each element."""
    x = _elements(spark, sf, "original_text")
    table = lookalike.learn(x, "original_text")
    c = lookalike.classes_of(written(lookalike.looks(x, "source_element_id", "original_text", table), "looks"))
    return c.withColumnRenamed("id", "source_element_id")


def p2_normalized(spark: SparkSession, sf: str) -> DataFrame:
    x = _elements(spark, sf, "original_text", "normalized_text")
    table = lookalike.learn(x, "original_text", "normalized_text")
    return lookalike.normalised(x, "source_element_id", ["original_text", "normalized_text"], table).distinct()


def _plain(spark: SparkSession, sf: str) -> DataFrame:
    x = _elements(spark, sf, "element_type", "element_role", "normalized_text")
    return x.where(F.col("element_type").isin(*PLAIN) & F.col("element_role").isNull())


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    x = sentences.boundary_rows(_plain(spark, sf), "source_element_id", "normalized_text").distinct()
    return x.select(F.col("id").alias("source_element_id"), "boundary")


def p4_sentences(spark: SparkSession, sf: str) -> DataFrame:
    x = _elements(spark, sf, "normalized_text")
    x = sentences.sentence_rows(x, "source_element_id", "normalized_text").distinct()
    return x.withColumnRenamed("id", "source_element_id")


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    a = chunking.split_oversized(read_table(spark, sf, "logical_block"), "block_id", "text")
    b = chunking.split_oversized(read_table(spark, sf, "normalized_element"), "source_element_id", "normalized_text")
    return a.select(F.lit("logical_block").alias("item_table"), "*").unionByName(b.select(F.lit("normalized_element").alias("item_table"), "*"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf).where("piece = 1").select("item_table", "item_id").distinct()


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf)


def _scans(spark: SparkSession, sf: str) -> DataFrame:
    return _elements(spark, sf, "document_id", "document_version", "element_type", "element_role", "geometry", "original_text")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return scan_noise.noise(_scans(spark, sf)).withColumnRenamed("id", "source_element_id")


def p7_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return scan_noise.paragraphs(_scans(spark, sf)).withColumnRenamed("id", "source_element_id")


def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    x = read_table(spark, sf, "documents").select("doc_id", "text")
    counted = packing.count_tokens(x, "doc_id", "text")
    return packing.pack(counted, x.count()).withColumnRenamed("item_id", "doc_id")


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers are, by shard."""
    c = p8_packed(spark, sf).groupBy("shard", "container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    return c.groupBy("shard").agg(
        F.count("*").alias("containers"), F.sum("n").alias("pieces"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"),
        F.round(F.sum("t") / (F.count("*") * packing.CAPACITY), 6).alias("fill"),
    )


def _leaks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return docs, leakage.leaks(docs, read_table(spark, sf, "eval_item"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf)[1].select("doc_id", "item_id").distinct()


def p9_spans(spark: SparkSession, sf: str) -> DataFrame:
    docs, hits = _leaks(spark, sf)
    return leakage.removal_spans(docs, written(hits, "hits"))


def _cuts(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.judged(read_table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id", "source", "text")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.cut_inside(_cuts(spark, sf)).select(F.col("id").alias("doc_id")).distinct()


def p10_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.rates(_cuts(spark, sf))


def p10_limits(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.limits(read_table(spark, sf, "documents").select("source", "text"), "source", "text")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_segments, p2_found, p2_classes, p2_normalized, p4_found, p4_sentences, p5_found, p5_pieces, p7_found, p7_paragraphs, p8_packed, p8_fill, p9_found, p9_spans, p10_found, p10_rates, p10_limits)
}
