"""Documents to elements: text natively, other formats by their readers, one row for each element."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import ids
from quillmill.functions import text as T
from quillmill.sources import formats

ELEMENTS = (
    "document_id string, document_version long, source_sha256 string, detected_format string, order_index int, element_type string, locator string, text string, heading_level int, "
    "section_path array<string>, element_role string, grid array<array<string>>, metadata map<string,string>, error_code string"
)


def text_elements(df: DataFrame, text: str = "text") -> DataFrame:
    """Paragraphs between blank lines, without leaving the JVM. df: document_id, document_version, source_sha256, text."""
    parts = F.split(F.concat(F.lit("\n"), T.unify_newlines(F.col(text)), F.lit("\n")), r"\n(?:[^\S\n]*\n)+")
    clean = F.filter(F.transform(parts, T.strip), lambda p: p != "")
    x = df.select("document_id", "document_version", "source_sha256", F.posexplode(clean).alias("order_index", "text"))
    x = x.withColumn("locator", F.concat(F.lit("paragraph:"), F.col("order_index").cast("string")))
    return x.select(
        "document_id", "document_version", "order_index", F.lit("PARAGRAPH").alias("element_type"), "locator", "text",
        ids.element_id(F.col("document_id"), F.col("document_version"), F.col("source_sha256"), F.lit("TXT"), F.col("locator"), F.lit("PARAGRAPH")).alias("element_id"),
    )


def elements(docs: DataFrame, limits: formats.Limits = formats.Limits()) -> DataFrame:
    """docs: document_id, document_version, sha256, detected_format, content. A document that fails gives one row with
    its error code and no elements."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [f.split(" ")[0] for f in ELEMENTS.split(", ")]
        for b in batches:
            for r in b.itertuples(index=False):
                base = (r.document_id, r.document_version, r.sha256, r.detected_format)
                rows, error = [], None
                try:
                    for n, e in enumerate(formats.read(r.detected_format, bytes(r.content), limits)):
                        rows.append((*base, n, e.kind, e.locator, e.text, e.level, list(e.path), e.role, e.grid, e.meta, None))
                except formats.FormatError as x:
                    error = x.code
                except (ValueError, KeyError, OSError) as x:
                    error = f"PARSER_FAILED:{type(x).__name__}"
                if error:
                    rows = [(*base, -1, None, None, None, None, None, None, None, None, error)]
                out = pd.DataFrame(rows, columns=cols)
                yield out.assign(heading_level=out["heading_level"].astype("Int32"))

    x = docs.select("document_id", "document_version", "sha256", "detected_format", "content").mapInPandas(run, ELEMENTS)
    eid = ids.element_id(*[F.col(c) for c in ("document_id", "document_version", "source_sha256", "detected_format", "locator", "element_type")])
    return x.withColumn("element_id", F.when(F.col("error_code").isNull(), eid))


def quality(n_candidates: Column, chars: Column) -> Column:
    return F.when(n_candidates > 0, "OCR_REQUIRED").when(chars == 0, "LOW_SIGNAL").otherwise("GOOD")


def settled_quality(status: Column, chars: Column, modes: Column, warnings: Column) -> Column:
    """With native text and no scanned or weak page recognition isn't required; partial structure shows."""
    weak = F.exists(modes, lambda m: m.isin("SCANNED_IMAGE", "LOW_SIGNAL"))
    s = F.when((status == "OCR_REQUIRED") & (chars > 0) & ~weak, "GOOD").otherwise(status)
    return F.when((s == "GOOD") & F.exists(warnings, lambda w: F.endswith(w, F.lit("_PARTIAL"))), "PARTIAL").otherwise(s)
