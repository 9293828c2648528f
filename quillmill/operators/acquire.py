"""Acquisition: from files to validated documents and a channel of typed errors.

Checks are expressions on the content, the cheap ones first; only packages, RTF and possible tables leave the JVM, and
of text only its first 64 Ki characters. The first failing check gives the error code; nothing raises.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions import ids
from quillmill.sources import formats

MAX_BYTES = 100 << 20
#: Media types, and the file extensions that go with each format.
MIME = {
    "PDF": "application/pdf", "PNG": "image/png", "JPEG": "image/jpeg", "TIFF": "image/tiff", "RTF": "application/rtf", "HTML": "text/html", "CSV": "text/csv",
    "MARKDOWN": "text/markdown", "TXT": "text/plain", **{f: m for f, m, _ in formats.PACKAGES},
}
EXTENSIONS = {
    "PDF": [".pdf"], "PNG": [".png"], "JPEG": [".jpg", ".jpeg"], "TIFF": [".tif", ".tiff"], "DOCX": [".docx"], "XLSX": [".xlsx"], "PPTX": [".pptx"], "CSV": [".csv", ".tsv"],
    "HTML": [".html", ".htm"], "RTF": [".rtf"], "ODT": [".odt"], "EPUB": [".epub"],
}
URI = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/]*)/(.*)$"


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, size_bytes, last_modified, content: a scan of any store that Spark can read."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return x.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("last_modified"), "content")


def object_uri(c: Column, scheme: str = "seaweed") -> Column:
    """struct<bucket, object_key, error_code>: scheme, bucket and key must be there, '..' may not be a segment."""
    s, b, k = (F.regexp_extract(c, URI, i) for i in (1, 2, 3))
    bad = (
        F.when(F.lower(s) != scheme, "STORAGE_URI_SCHEME")
        .when((b == "") | (k == ""), "STORAGE_URI_INCOMPLETE")
        .when(F.array_contains(F.split(k, "/"), ".."), "STORAGE_URI_TRAVERSAL")
    )
    return F.struct(F.when(bad.isNull(), b).alias("bucket"), F.when(bad.isNull(), k).alias("object_key"), bad.alias("error_code"))


def encoded_path(bucket: Column, key: Column) -> Column:
    """Each segment percent-encoded."""
    enc = F.transform(F.split(F.concat_ws("/", bucket, key), "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")))
    return F.concat(F.lit("/"), F.array_join(enc, "/"))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"(\.[^./\\]+)$", 1))


def looks_html(text: Column, ext: Column) -> Column:
    low = F.lower(F.ltrim(F.substring(text, 1, 65536)))
    strong = F.startswith(low, F.lit("<!doctype html")) | F.substring(low, 1, 4096).rlike(r"<html[\s>]")
    return strong | (ext.isin(".html", ".htm") & F.substring(low, 1, 16384).rlike(r"<(article|section|main|h[1-6]|p|table)[\s>]"))


@F.pandas_udf(T.StructType([T.StructField("fmt", T.StringType()), T.StructField("error", T.StringType()), T.StructField("warnings", T.ArrayType(T.StringType()))]))
def _deep(kind: pd.Series, content: pd.Series, ext: pd.Series) -> pd.DataFrame:
    rows = []
    for k, c, e in zip(kind, content, ext):
        fmt = error = None
        warnings: list[str] = []
        try:
            if k == "ZIP":
                fmt = formats.identify_package(bytes(c))[0]
            elif k == "RTF":
                formats.check_rtf(bytes(c))
                fmt = "RTF"
            elif k == "IMAGE":
                fmt = formats.image_size(bytes(c))[0]
            elif k == "TEXT":
                found = formats.sniff_csv(bytes(c).decode("utf-8", "ignore")[:65536], e)
                if found:
                    fmt = "CSV"
                    warnings = [f"CSV_DELIMITER:{found[0]!r}"] + ([f"CSV_QUOTE:{found[1]!r}"] if found[1] else [])
        except formats.FormatError as x:
            error = x.code
        rows.append((fmt, error, warnings))
    return pd.DataFrame(rows, columns=["fmt", "error", "warnings"])


def acquired(df: DataFrame, content: str = "content", name: str = "file_name", declared: str | None = None, expected: str | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Adds size_bytes, sha256, detected_format, content_type, warnings and error_code to every row."""
    c = F.col(content)
    hexed = F.hex(F.substring(c, 1, 64))
    text = c.cast("string")
    ext = extension(F.col(name))
    size = F.octet_length(c)
    kind = (
        F.when(F.startswith(hexed, F.lit("4D5A")) | F.startswith(hexed, F.lit("7F454C46")), "EXEC")
        .when(F.startswith(hexed, F.lit("255044462D")), "PDF")
        .when(F.startswith(hexed, F.lit("89504E470D0A1A0A")) | F.startswith(hexed, F.lit("FFD8FF")) | hexed.rlike("^(49492A00|4D4D002A)"), "IMAGE")
        .when(F.startswith(hexed, F.lit("504B0304")), "ZIP")
        .when(hexed.rlike(r"^(20|09|0A|0B|0C|0D)*7B5C727466"), "RTF")
        .otherwise("TEXT")
    )
    x = df.withColumns({"_kind": kind, "_ext": ext, "size_bytes": size.cast("long"), "sha256": F.sha2(c, 256)})
    nul = F.contains(F.hex(F.substring(c, 1, 1 << 20)), F.lit("00")) & (F.position(F.lit("\x00"), F.substring(text, 1, 1 << 20)) > 0)
    text_error = F.when(nul, "UNSUPPORTED_FORMAT").when(~F.is_valid_utf8(text), "TEXT_ENCODING_UNSUPPORTED")
    want = F.lit(None).cast("string") if expected is None else ids.normalise_sha256(F.col(expected))
    early = F.when(c.isNull() | (size == 0), "EMPTY_SOURCE").when(size > max_bytes, "SOURCE_TOO_LARGE")
    if declared is not None:
        early = early.when(F.col(declared) != size, "SOURCE_SIZE_MISMATCH")
    early = early.when(want != F.col("sha256"), "SOURCE_HASH_MISMATCH").when(F.col("_kind") == "EXEC", "UNSUPPORTED_EXECUTABLE")
    early = early.when((F.col("_kind") == "PDF") & ~F.contains(F.hex(F.expr(f"right({content}, 2048)")), F.lit("2525454F46")), "MALFORMED_PDF")
    early = early.when(F.col("_kind") == "TEXT", text_error)
    x = x.withColumn("_early", early).withColumn("_html", (F.col("_kind") == "TEXT") & F.col("_early").isNull() & looks_html(text, F.col("_ext")))
    need = F.col("_early").isNull() & (F.col("_kind").isin("ZIP", "RTF", "IMAGE") | ((F.col("_kind") == "TEXT") & ~F.col("_html")))
    x = x.withColumn("_deep", _deep(F.when(need, F.col("_kind")), F.when(need, F.when(F.col("_kind") == "TEXT", F.substring(c, 1, 262144)).otherwise(c)), F.col("_ext")))
    fmt = (
        F.when(F.col("_kind") == "PDF", "PDF")
        .when(F.col("_html"), "HTML")
        .when(F.col("_deep.fmt").isNotNull(), F.col("_deep.fmt"))
        .when(F.col("_kind") == "TEXT", F.when(F.col("_ext").isin(".md", ".markdown"), "MARKDOWN").otherwise("TXT"))
    )
    x = x.withColumn("error_code", F.coalesce("_early", "_deep.error")).withColumn("detected_format", F.when(F.col("error_code").isNull(), fmt))
    right = F.create_map(*[v for k, e in EXTENSIONS.items() for v in (F.lit(k), F.array(*map(F.lit, e)))])[F.col("detected_format")]
    odd = right.isNotNull() & (F.col("_ext") != "") & ~F.array_contains(right, F.col("_ext"))
    warn = F.array_compact(F.concat(F.coalesce("_deep.warnings", F.array().cast("array<string>")), F.array(F.when(odd, "FILE_TYPE_MISMATCH"))))
    mime = F.create_map(*[F.lit(v) for kv in MIME.items() for v in kv])[F.col("detected_format")]
    return x.withColumn("warnings", warn).withColumn("content_type", mime).drop("_kind", "_ext", "_early", "_html", "_deep")
