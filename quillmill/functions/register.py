"""The functions under names that SQL can call."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quillmill.functions import ids, segment, text


def register(spark: SparkSession) -> list[str]:
    udfs = {"split_sentences": segment.split_sentences, "count_words": segment.count_words, "nfc": text._nfc, "casefold": text._casefold, "canonical_json": ids.canonical_json_of}
    for name, f in udfs.items():
        spark.udf.register(name, f)
    for ddl in (
        r"CREATE OR REPLACE TEMPORARY FUNCTION grapheme_clusters(t STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(t, '\\X', 0)",
        r"CREATE OR REPLACE TEMPORARY FUNCTION match_key(t STRING) RETURNS STRING RETURN trim(regexp_replace(regexp_replace(lower(t), '[^\\p{L}\\p{N}\\p{M}_\\s]', ' '), '\\s+', ' '))",
    ):
        spark.sql(ddl)
    return [*udfs, "grapheme_clusters", "match_key"]



