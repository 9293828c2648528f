"""Queries of the document pipeline over the whole tables, with SQL wherever SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.functions import ids, segment
from quillmill.functions import text as T
from quillmill.operators import acquire, artifacts, blocks, checks, evaluate, fragments, layout, normalize, parse, recognition
from quillmill.operators.message_dedup import canonical_uuid
from quillmill.plans.data_quality import _DOC as _REQUEST_DOC
from quillmill.runtime import read_table

def _docs(spark: SparkSession, sf: str) -> DataFrame:
    x = read_table(spark, sf, "documents")
    doc = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    return x.select(doc.alias("document_id"), F.lit(1).cast("long").alias("document_version"), F.sha2("text", 256).alias("source_sha256"), "text", "lang", "source")


def _elements(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    return read_table(spark, sf, "normalized_element").select("source_element_id", *cols).distinct()


def _blocks(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """Copies staged twice count once; they are the same in every column, so the key decides."""
    return read_table(spark, sf, "logical_block").select("block_id", *cols).dropDuplicates(["block_id"])


# Acquisition


def documents_acquired(spark: SparkSession, sf: str) -> DataFrame:
    x = _docs(spark, sf).withColumn("content", F.encode("text", "UTF-8")).withColumn("file_name", F.concat("document_id", F.lit(".txt"))).drop("text", "lang", "source")
    x = acquire.acquired(x, expected="source_sha256")
    return x.select("document_id", "size_bytes", "sha256", "detected_format", "content_type", F.array_join("warnings", ",").alias("warnings"), "error_code")


def object_uris(spark: SparkSession, sf: str) -> DataFrame:
    x = read_table(spark, sf, "new_indexation_job").select("delivery_id", acquire.object_uri(F.col("source_uri")).alias("u"))
    return x.select("delivery_id", "u.bucket", "u.object_key", "u.error_code", acquire.encoded_path(F.col("u.bucket"), F.col("u.object_key")).alias("path"))


def content_hashes_normalised(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "new_indexation_job").select("delivery_id", ids.normalise_sha256(F.col("source_content_hash")).alias("sha256"))


def duplicate_contents(spark: SparkSession, sf: str) -> DataFrame:
    x = read_table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return x.groupBy("sha256").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("copies")).where("copies > 1")


# Parsing


def txt_elements(spark: SparkSession, sf: str) -> DataFrame:
    return parse.text_elements(_docs(spark, sf))


def parsed_elements(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes to elements through format detection and the readers."""
    x = _docs(spark, sf).withColumn("content", F.encode("text", "UTF-8")).withColumn("file_name", F.concat("document_id", F.lit(".txt"))).drop("text")
    ok = acquire.acquired(x, expected="source_sha256").where("error_code is null")
    return parse.elements(ok).select("document_id", "detected_format", "order_index", "element_type", "locator", "text", "element_id", "error_code")


# Layout: elements of pages stand for lines


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    g = F.col("geometry")
    x = _elements(spark, sf, "document_id", "document_version", "order_index", "original_text", "element_type", "geometry")
    return x.where("geometry.page_number is not null").select(
        F.concat_ws("#", "document_id", F.col("document_version").cast("string")).alias("doc"), g["page_number"].cast("long").alias("page"), F.col("source_element_id").alias("line"),
        F.coalesce("original_text", F.lit("")).alias("text"), g["x0"].alias("x0"), g["x1"].alias("x1"), g["y0"].alias("top"), g["y1"].alias("bottom"), g["page_width"].alias("width"), g["page_height"].alias("height"), "element_type",
    )


def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    return layout.reading_order(_lines(spark, sf), F.col("width")).select("doc", "page", "line", "reading_index")


def line_kinds(spark: SparkSession, sf: str) -> DataFrame:
    x = _lines(spark, sf)
    size = F.round(F.col("bottom") - F.col("top"), 3)
    return x.select(
        "doc", "page", "line", layout.line_kind(F.col("text"), size, F.lit(False), F.lit(1e9)).alias("kind"), layout.furniture_role(F.col("text"), F.col("top"), F.col("bottom"), F.col("height")).alias("role")
    )


def page_modes(spark: SparkSession, sf: str) -> DataFrame:
    x = _lines(spark, sf)
    area = F.greatest(F.col("x1") - F.col("x0"), F.lit(0.0)) * F.greatest(F.col("bottom") - F.col("top"), F.lit(0.0)) / F.greatest(F.col("width") * F.col("height"), F.lit(1.0))
    image = F.col("element_type") == "IMAGE"
    p = x.groupBy("doc", "page").agg(
        F.sum(F.length("text")).alias("chars"), F.count_if(~image).alias("words"), F.count_if(image).alias("images"), F.coalesce(F.sum(F.when(image, area)), F.lit(0.0)).alias("ratio")
    )
    return p.select("doc", "page", layout.page_mode(F.col("chars"), F.col("words"), F.col("images"), F.col("ratio")).alias("mode"))


def page_elements(spark: SparkSession, sf: str) -> DataFrame:
    """Words at even steps along each element's box stand for the words of a page; they come out as lines again."""
    x = _lines(spark, sf).where("text <> ''")
    w = x.select("*", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("i", "word"), F.size(F.split(F.trim("text"), r"\s+")).alias("n"))
    step = (F.col("x1") - F.col("x0")) / F.col("n")
    w = w.select("doc", "page", F.col("word").alias("text"), (F.col("x0") + step * F.col("i")).alias("x0"), (F.col("x0") + step * (F.col("i") + 1)).alias("x1"), "top", "bottom", F.lit(10.0).alias("size"), F.lit("Regular").alias("fontname"))
    pages = x.groupBy("doc", "page").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    return layout.page_elements(w, pages).select("doc", "page", "reading_index", "element_type", "text", "element_role", "locator")


# Recognised text


def _recognised(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    x = _elements(spark, sf, "document_id", "document_version", "order_index", "original_text", "geometry.page_number", "element_role", "element_type", "parent_element_id")
    x = x.where("original_text is not null").select(
        F.concat_ws("#", "document_id", F.col("document_version").cast("string")).alias("doc"), F.col("page_number").alias("page"), F.col("source_element_id").alias("id"), F.col("original_text").alias("text"),
        "order_index", F.coalesce(F.col("element_role") == "OCR_TEXT", F.lit(False)).alias("ocr"), "element_type", "parent_element_id",
    )
    return x.where("ocr"), x.where("not ocr and page is not null")


def recognised_not_native(spark: SparkSession, sf: str) -> DataFrame:
    ocr, native = _recognised(spark, sf)
    return recognition.not_native(ocr, native).select("doc", "page", "id")


def recognised_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    ocr, _ = _recognised(spark, sf)
    return recognition.first_wins(ocr.withColumn("scope", F.lit("PAGE")), ["order_index", "id"]).select("doc", "page", "id")


def recognised_merged_order(spark: SparkSession, sf: str) -> DataFrame:
    """Recognised elements taken out and put back after their parents."""
    ocr, native = _recognised(spark, sf)
    w = W.partitionBy("doc").orderBy("order_index", "id")
    accepted = ocr.select("doc", "id", F.trim("parent_element_id").alias("parent_id"), (F.row_number().over(w) - 1).alias("accept_pos"))
    return recognition.merged_order(native, accepted)


# Normalisation


def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    x = normalize.normalized(_elements(spark, sf, "original_text", "element_type", "element_role"))
    return x.select("source_element_id", "n_text", "n_controls", "n_runs", "n_joins")


def page_furniture(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.furniture(read_table(spark, sf, "normalized_element"))


def normalization_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The latest run of each document version, summed by format; null counters count nothing."""
    x = read_table(spark, sf, "normalization_stats")
    cols = ["elements_input", "elements_output", "elements_suppressed", "chars_before", "chars_after", "whitespace_runs_collapsed", "line_wrap_joins", "dehyphenations_applied", "furniture_suppressed", "control_chars_removed"]
    last = x.groupBy("document_id", "document_version").agg(F.max_by(F.struct("detected_format", *cols), F.struct("finished_at", "normalizer_version", "source_sha256")).alias("s")).select("s.*")
    return last.groupBy("detected_format").agg(F.count("*").alias("n_runs"), *[F.sum(F.coalesce(F.col(c).cast("long"), F.lit(0))).alias(c) for c in cols])


# Segmentation and splitting


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    x = _elements(spark, sf, "normalized_text", "language_hint").where("normalized_text is not null")
    s = x.select("source_element_id", segment.split_sentences("normalized_text", "language_hint").alias("s"))
    return s.select("source_element_id", F.posexplode("s").alias("sentence", "sentence_text"))


def word_counts(spark: SparkSession, sf: str) -> DataFrame:
    x = read_table(spark, sf, "documents").select("doc_id", segment.count_words("text").alias("w"), T.graph_count(F.col("text")).alias("graphemes"))
    return x.select("doc_id", "w.words", "w.reliable", "graphemes")


def script_languages(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", F.array_join(T.script_languages(F.col("text")), ",").alias("languages"))


def _fragments(spark: SparkSession, sf: str) -> DataFrame:
    return fragments.fragments(read_table(spark, sf, "normalized_element"))


def fragments_query(spark: SparkSession, sf: str) -> DataFrame:
    return _fragments(spark, sf)


def document_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """The whole way from raw texts: paragraphs, normalised text, fragments."""
    e = parse.text_elements(_docs(spark, sf))
    e = normalize.normalized(e.withColumn("element_role", F.lit(None).cast("string")), "text").select(
        "document_id", "document_version", F.col("element_id").alias("source_element_id"), "element_type", "order_index", F.col("n_text").alias("normalized_text"),
        F.lit(None).cast("int").alias("heading_level"), F.lit(None).cast("struct<page_number:int>").alias("geometry"), F.lit(None).cast("string").alias("language_hint"), "element_role", F.lit(False).alias("suppressed_from_index"),
    )
    f = fragments.fragments(e)
    return f.select("document_id", "sequence", "fragment_id", "fragment_type", "char_count", "word_count", "sentence_count", "split_reason", "primary_language", "error_code")


# Blocks and delivery


def logical_blocks(spark: SparkSession, sf: str) -> DataFrame:
    b = blocks.from_fragments(_fragments(spark, sf))
    return b.select("document_id", "document_version", "block_id", "parent_block_id", "block_type", "text", "order_index")


def block_tree_errors(spark: SparkSession, sf: str) -> DataFrame:
    # Only whole copies count once here: blocks that share an id, or have none, are errors to be counted.
    x = read_table(spark, sf, "logical_block").select("block_id", "document_id", "document_version", "parent_block_id", "block_type", "order_index")
    return blocks.tree_errors(x.distinct())


def delivery_batches(spark: SparkSession, sf: str) -> DataFrame:
    x = _blocks(spark, sf, "document_id", "document_version", "order_index")
    return blocks.batches(x).select("document_id", "document_version", "block_id", "batch_index", "position", "last_batch")


def block_sizes(spark: SparkSession, sf: str) -> DataFrame:
    x = _blocks(spark, sf, "parent_block_id", "text", "metadata")
    return x.select("block_id", blocks.wire_size(F.col("block_id"), F.col("parent_block_id"), F.col("text"), F.col("metadata")).alias("n_bytes"))


def batches_by_size(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.batches_by_size(_blocks(spark, sf, "document_id", "document_version", "order_index", "parent_block_id", "text", "metadata"), 262_144)


def final_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.content_hashes(_blocks(spark, sf, "document_id", "document_version", "order_index", "text", "source_location"))


def batch_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    x = _blocks(spark, sf, "document_id", "document_version", "order_index", "parent_block_id", "block_type", "text", "metadata", "source_location")
    return blocks.batch_hashes(blocks.batches(x))


def identities(spark: SparkSession, sf: str) -> DataFrame:
    x = _docs(spark, sf)
    return x.select(
        "document_id",
        ids.idempotency_key(F.col("document_id"), F.col("document_version"), F.col("source_sha256")).alias("start_key"),
        normalize.fingerprint(F.col("source_sha256"), ("text", "1", "text-native")).alias("fingerprint"),
    )


def artifact_parts(spark: SparkSession, sf: str) -> DataFrame:
    x = _blocks(spark, sf, "document_id", "document_version", "order_index", "block_type", "text")
    p = artifacts.parts(artifacts.canonical_records(x, "elements", "order_index"), max_records=100, max_bytes=65_536)
    return p.drop("body")


# Joins, keys, checks


def latest_request(spark: SparkSession, sf: str) -> DataFrame:
    x = read_table(spark, sf, "new_indexation_job")
    best = F.max_by("delivery_id", F.struct("document_version", "received_at", "delivery_id"))
    return x.groupBy(canonical_uuid(F.col("document_id")).alias("document_id")).agg(best.alias("delivery_id"), F.max("document_version").alias("document_version"))


def next_requests(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred in line: by priority, then age, then id."""
    x = read_table(spark, sf, "new_indexation_job").select("delivery_id", "priority", "requested_at")
    return x.orderBy(F.desc("priority"), "requested_at", "delivery_id").limit(100).select("delivery_id", "priority")


def blocks_without_element(spark: SparkSession, sf: str) -> DataFrame:
    b = _blocks(spark, sf, "metadata").select("block_id", F.col("metadata")["sourceElementId"].alias("source_element_id"))
    return checks.missing_parents(b, read_table(spark, sf, "normalized_element"), "source_element_id", "source_element_id").select("block_id", "source_element_id")


def documents_never_requested(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "logical_block").select("document_id", "document_version").distinct()
    j = read_table(spark, sf, "new_indexation_job").select(canonical_uuid(F.col("document_id")).alias("document_id"), "document_version").distinct()
    return e.join(j, ["document_id", "document_version"], "left_anti")


def request_violations(spark: SparkSession, sf: str) -> DataFrame:
    rules = {
        "VERSION_POSITIVE": F.col("document_version") > 0,
        "ATTEMPTS_POSITIVE": F.col("max_attempts") > 0,
        "SIZE_UINT64": F.col("source_size_bytes").isNull() | checks.in_range(F.col("source_size_bytes"), checks.UINT64),
        "ZONE_CODE": F.col("access_zone_code").rlike("^[0-9]{4}$"),
        "TTL_NOT_NEGATIVE": F.col("requested_ttl_days") >= 0,
        "RECEIVED_AFTER_REQUESTED": F.col("received_at") >= F.col("requested_at"),
        "HASH_FORMAT": F.when(F.col("source_content_hash").isNotNull(), ids.normalise_sha256(F.col("source_content_hash")).isNotNull()),
    }
    return checks.violations(read_table(spark, sf, "new_indexation_job"), "delivery_id", rules)


def links_in_texts(spark: SparkSession, sf: str) -> DataFrame:
    x = read_table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"https?://[^\s]+"), F.lit(0)))).alias("url"))
    return x.select("doc_id", "url", checks.link_credentials(F.col("url")).alias("error_code"))


def hint_against_script(spark: SparkSession, sf: str) -> DataFrame:
    """Languages that documents are labelled with, as gold, against those their scripts show; by source."""
    x = read_table(spark, sf, "documents").where("lang is not null")
    gold, seen = F.array(F.lower(F.substring("lang", 1, 2))), T.script_languages(F.col("text"))
    tp, fp, fn = evaluate.set_counts(gold, seen)
    return evaluate.by_group(x.select("source", tp.alias("tp"), fp.alias("fp"), fn.alias("fn")), "source")


def table_grids(spark: SparkSession, sf: str) -> DataFrame:
    x = _elements(spark, sf, "element_type", "original_text").where("element_type = 'TABLE' and original_text is not null")
    g = normalize.normalized_grid(F.transform(F.split("original_text", "\n"), lambda line: F.split(line, "\\|")))
    x = x.select("source_element_id", g.alias("g"))
    return x.select("source_element_id", "g.row_count", "g.column_count", F.array_join(F.flatten("g.rows"), "\x1f").alias("cells"))


def _read(x: DataFrame, fmt: str) -> DataFrame:
    """x: document_id, content (text). Elements as the reader of the format gives them."""
    x = x.select("document_id", F.lit(1).cast("long").alias("document_version"), F.sha2("content", 256).alias("sha256"), F.lit(fmt).alias("detected_format"), F.encode("content", "UTF-8").alias("content"))
    return parse.elements(x).select("document_id", "order_index", "element_type", "locator", "text", "error_code")


def _one_line(c: str):
    return F.trim(F.regexp_replace(F.col(c), f"[{T.BLANK}]+", " "))


def html_elements(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pages of HTML, read back."""
    safe = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<!doctype html><html><head><style>p {}</style></head><body><h1>"), safe(F.col("source")), F.lit("</h1><p>Text: "), safe(_one_line("text")), F.lit("</p><script>x()</script></body></html>"))
    return _read(_docs(spark, sf).withColumn("content", page), "HTML")


def markdown_elements(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as Markdown, read back."""
    page = F.concat(F.lit("# "), F.col("source"), F.lit("\n\nText: "), _one_line("text"), F.lit("\n\n- "), F.col("document_id"), F.lit("\n"))
    return _read(_docs(spark, sf).withColumn("content", page), "MARKDOWN")


def csv_elements(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as CSV files with quoted commas, read back."""
    x = read_table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("document_id"), F.concat(F.lit('key,name,nation\n'), F.col("s_suppkey").cast("string"), F.lit(',"'), "s_name", F.lit(', Ltd",'), F.col("s_nationkey").cast("string"), F.lit("\n")).alias("content"))
    return _read(x, "CSV")


def fragment_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """What every document's fragments must hold: each of its elements that has text, all visible characters, sizes within the
    limits and sequences without gaps."""
    x = fragments_query(spark, sf).where("error_code is null")
    visible = F.length(F.regexp_replace("normalized_text", f"[{T.BLANK}]+", ""))
    per = x.groupBy("document_id", "document_version").agg(
        F.sum(visible).alias("visible_chars"), F.max("char_count").alias("most"), (F.max("sequence") + 1 - F.count("*")).alias("gaps"), F.count_if(F.size("element_ids") == 0).alias("empty")
    )
    n = x.select("document_id", "document_version", F.explode("element_ids").alias("e")).groupBy("document_id", "document_version").agg(F.count_distinct("e").alias("elements"))
    return per.join(n, ["document_id", "document_version"]).select(
        "document_id", "document_version", "elements", "visible_chars", (F.col("most") <= 12000).alias("within_limit"), (F.col("gaps") == 0).alias("gapless"), (F.col("empty") == 0).alias("none_empty")
    )


QUERIES = {
    f.__name__: f
    for f in (
        documents_acquired, object_uris, content_hashes_normalised, duplicate_contents, txt_elements, parsed_elements, reading_order, line_kinds, page_modes, page_elements, recognised_not_native, recognised_first_wins,
        recognised_merged_order, normalize_text, page_furniture, normalization_totals, sentences, word_counts, script_languages, document_fragments, logical_blocks, block_tree_errors, delivery_batches, block_sizes,
        batches_by_size, final_content_hash, batch_content_hash, identities, artifact_parts, latest_request, next_requests, blocks_without_element, documents_never_requested, request_violations, links_in_texts,
        hint_against_script, fragment_coverage, table_grids, html_elements, markdown_elements, csv_elements,
    )
} | {"fragments": fragments_query}

# SQL

_B = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_B}+|{_B}+$', '', 'g')"


_DOC = "'00000000-0000-0000-0000-' || lpad(doc_id::VARCHAR, 12, '0')"
_NL = "replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_CLEAN = "replace(replace(nfc_normalize(" + _NL.format(t="original_text") + "), chr(160), ' '), chr(173), '')"
_CTRL = r"regexp_replace(c, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')"
_LINE = _strip(r"regexp_replace(l, '[\t\x0b\x0c ]+', ' ', 'g')")
_KEY = r"trim(regexp_replace(regexp_replace(lower({t}), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_EL = "(SELECT DISTINCT * FROM (SELECT source_element_id, {c} FROM normalized_element))"
_LINES = (
    "SELECT DISTINCT document_id || '#' || document_version AS doc, geometry.page_number::BIGINT AS page, source_element_id AS line, coalesce(original_text, '') AS text, geometry.x0 AS x0, geometry.x1 AS x1, "
    "geometry.y0 AS top, geometry.y1 AS bottom, geometry.page_width AS width, geometry.page_height AS height, element_type FROM normalized_element WHERE geometry.page_number IS NOT NULL"
)
_OCR = (
    "SELECT DISTINCT document_id || '#' || document_version AS doc, geometry.page_number AS page, source_element_id AS id, original_text AS text, order_index, "
    "coalesce(element_role = 'OCR_TEXT', false) AS ocr, parent_element_id FROM normalized_element WHERE original_text IS NOT NULL"
)
_ONE = "(SELECT DISTINCT ON (block_id) * FROM logical_block)"
_SHA = "regexp_replace(" + _strip("source_content_hash") + ", '^sha256:', '')"
_STATS = ["elements_input", "elements_output", "elements_suppressed", "chars_before", "chars_after", "whitespace_runs_collapsed", "line_wrap_joins", "dehyphenations_applied", "furniture_suppressed", "control_chars_removed"]

SQL = {
    "object_uris": r"""WITH p AS (SELECT delivery_id, regexp_extract(source_uri, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/]*)/(.*)$', 1) AS s, regexp_extract(source_uri, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/]*)/(.*)$', 2) AS b,
 regexp_extract(source_uri, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/]*)/(.*)$', 3) AS k FROM new_indexation_job),
e AS (SELECT *, CASE WHEN lower(s) <> 'seaweed' THEN 'STORAGE_URI_SCHEME' WHEN b = '' OR k = '' THEN 'STORAGE_URI_INCOMPLETE' WHEN list_contains(string_split(k, '/'), '..') THEN 'STORAGE_URI_TRAVERSAL' END AS error_code FROM p)
SELECT delivery_id, CASE WHEN error_code IS NULL THEN b END AS bucket, CASE WHEN error_code IS NULL THEN k END AS object_key, error_code,
 CASE WHEN error_code IS NULL THEN '/' || array_to_string(list_transform(string_split(b || '/' || k, '/'), lambda x: url_encode(x)), '/') ELSE '/' END AS path FROM e""",
    "content_hashes_normalised": f"SELECT delivery_id, CASE WHEN regexp_matches(lower({_SHA}), '^[0-9a-f]{{64}}$') THEN lower({_SHA}) END AS sha256 FROM new_indexation_job",
    "duplicate_contents": "SELECT sha256(text) AS sha256, min(doc_id) AS first_doc_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
    "txt_elements": rf"""WITH p AS (SELECT {_DOC} AS document_id, sha256(text) AS sha, list_filter(list_transform(regexp_split_to_array(chr(10) || {_NL.format(t="text")} || chr(10), '\n(?:[\t\x0b\f\r ]*\n)+'),
 lambda x: {_strip("x")}), lambda x: x <> '') AS ps FROM documents),
u AS (SELECT document_id, sha, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS order_index FROM p)
SELECT document_id, 1::BIGINT AS document_version, order_index::INT AS order_index, 'PARAGRAPH' AS element_type, 'paragraph:' || order_index AS locator, text,
 sha256(concat_ws(chr(31), document_id, '1', sha, 'TXT', 'paragraph:' || order_index, 'PARAGRAPH')) AS element_id FROM u""",
    "reading_order": f"""WITH l AS ({_LINES}),
s AS (SELECT *, CASE WHEN (x1 - x0) >= width * 0.62 OR (x0 <= width * 0.30 AND x1 >= width * 0.70) THEN 9 WHEN (x0 + x1) / 2 < width * 0.46 THEN 0 WHEN (x0 + x1) / 2 > width * 0.54 THEN 1 ELSE 2 END AS side FROM l),
t AS (SELECT *, count(*) OVER p >= 4 AND count_if(side = 0) OVER p >= 2 AND count_if(side = 1) OVER p >= 2 AS two,
 coalesce(count_if(side = 9) OVER (PARTITION BY doc, page ORDER BY top, CASE WHEN side = 9 THEN 1 ELSE 0 END, x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS band FROM s WINDOW p AS (PARTITION BY doc, page))
SELECT doc, page, line, (row_number() OVER (PARTITION BY doc, page ORDER BY CASE WHEN two THEN band ELSE 0 END, CASE WHEN two THEN side ELSE 0 END, top, x0, line) - 1)::INT AS reading_index FROM t""",
    "line_kinds": rf"""WITH l AS ({_LINES})
SELECT doc, page, line, CASE WHEN regexp_matches(text, '^\s*(?:[-•*+] |\d+[.)]\s+)') THEN 'LIST_ITEM' WHEN length(text) <= 180 AND regexp_matches(text, '^(?:\d+(?:\.\d+)*[.)]?|[A-ZА-ЯӘҒҚҢӨҰҮҺІ][.)])\s+\S+') THEN 'HEADING' ELSE 'PARAGRAPH' END AS kind,
 CASE WHEN regexp_matches(text, '(?i)^(?:page\s+)?\d+(?:\s+(?:of|/)\s+\d+)?$') THEN 'PAGE_NUMBER' WHEN top <= height * 0.08 THEN 'PAGE_HEADER_CANDIDATE' WHEN bottom >= height * 0.92 THEN 'PAGE_FOOTER_CANDIDATE' END AS role FROM l""",
    "page_modes": f"""WITH l AS ({_LINES}), p AS (SELECT doc, page, sum(length(text)) AS chars, count_if(element_type <> 'IMAGE') AS words, count_if(element_type = 'IMAGE') AS images,
 coalesce(sum(CASE WHEN element_type = 'IMAGE' THEN greatest(x1 - x0, 0) * greatest(bottom - top, 0) / greatest(width * height, 1) END), 0) AS ratio FROM l GROUP BY doc, page)
SELECT doc, page, CASE WHEN chars >= 80 THEN CASE WHEN images > 0 THEN 'MIXED' ELSE 'NATIVE_TEXT' END WHEN images > 0 AND least(ratio, 1) >= 0.70 THEN 'SCANNED_IMAGE' WHEN chars <= 20 AND words = 0 AND images = 0 THEN 'EMPTY' ELSE 'LOW_SIGNAL' END AS mode FROM p""",
    "recognised_not_native": f"""WITH e AS ({_OCR}), a AS (SELECT doc, page, id, {_KEY.format(t="text")} AS k FROM e WHERE ocr), b AS (SELECT DISTINCT doc, page, {_KEY.format(t="text")} AS n FROM e WHERE NOT ocr AND page IS NOT NULL)
SELECT doc, page, id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc = a.doc AND b.page IS NOT DISTINCT FROM a.page AND n <> '' AND k <> '' AND (k = n OR contains(k, n) OR contains(n, k)
 OR len(list_intersect(list_distinct(string_split(k, ' ')), list_distinct(string_split(n, ' '))))::DOUBLE / len(list_distinct(list_concat(string_split(k, ' '), string_split(n, ' ')))) >= 0.86))""",
    "recognised_first_wins": f"""WITH e AS ({_OCR}) SELECT doc, page, id FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, {_KEY.format(t="text")} ORDER BY order_index, id) AS rn FROM e WHERE ocr) WHERE rn = 1""",
    "recognised_merged_order": f"""WITH e AS ({_OCR}), n AS (SELECT * FROM e WHERE NOT ocr AND page IS NOT NULL),
o AS (SELECT doc, id, trim(parent_element_id) AS parent_id, row_number() OVER (PARTITION BY doc ORDER BY order_index, id) - 1 AS pos FROM e WHERE ocr),
u AS (SELECT doc, id, order_index::BIGINT AS a, 0 AS b, 0 AS c FROM n UNION ALL SELECT o.doc, o.id, coalesce(n.order_index, 4611686018427387904), 1, o.pos FROM o LEFT JOIN n ON n.doc = o.doc AND n.id = o.parent_id)
SELECT doc, id, (row_number() OVER (PARTITION BY doc ORDER BY a, b, c, id) - 1)::INT AS order_index FROM u""",
    "normalize_text": rf"""WITH x AS (SELECT source_element_id, original_text, element_type = 'CODE_BLOCK' AS code, element_type = 'PARAGRAPH' AND coalesce(upper(element_role), '') <> 'OCR_TEXT' AS j, {_CLEAN} AS c
 FROM {_EL.format(c="original_text, element_type, element_role")}),
y AS (SELECT *, {_CTRL} AS s FROM x), z AS (SELECT *, list_transform(string_split(s, chr(10)), lambda l: {_LINE}) AS ls FROM y)
SELECT source_element_id, CASE WHEN code THEN s WHEN j THEN array_to_string(list_filter(ls, lambda v: v <> ''), ' ')
 ELSE regexp_replace(regexp_replace(array_to_string(ls, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') END AS n_text,
 coalesce(length(c) - length(s), 0) AS n_controls, CASE WHEN code OR original_text IS NULL THEN 0 ELSE len(regexp_extract_all(s, '[\t\x0b\x0c ]+')) END AS n_runs,
 CASE WHEN NOT code AND j AND len(list_filter(ls, lambda v: v <> '')) > 1 THEN len(list_filter(ls, lambda v: v <> '')) - 1 ELSE 0 END AS n_joins FROM z""",
    "page_furniture": rf"""WITH x AS (SELECT source_element_id, document_id, document_version, geometry.page_number AS page, (geometry.y0 + geometry.y1) / 2 / geometry.page_height AS mid,
 trim(regexp_replace(replace(replace(lower(normalized_text), 'ß', 'ss'), 'ς', 'σ'), '{_B}+', ' ', 'g')) AS key FROM normalized_element WHERE normalized_text <> '' AND element_type <> 'HEADING' AND geometry.page_number IS NOT NULL
 AND geometry.y0 IS NOT NULL AND geometry.y1 IS NOT NULL AND geometry.page_height <> 0),
p AS (SELECT document_id, document_version, count(DISTINCT page) AS pages FROM x GROUP BY ALL HAVING count(DISTINCT page) >= 3),
n AS (SELECT * FROM x WHERE (mid <= 0.08 OR mid >= 0.92) AND key <> ''),
o AS (SELECT n.document_id, n.document_version, key FROM n JOIN p USING (document_id, document_version) GROUP BY ALL HAVING count(DISTINCT page) >= greatest(3, ceil(any_value(pages) * 0.60)))
SELECT DISTINCT source_element_id FROM n JOIN o USING (document_id, document_version, key)""",
    "normalization_totals": "WITH l AS (SELECT * FROM normalization_stats QUALIFY row_number() OVER (PARTITION BY document_id, document_version ORDER BY finished_at DESC, normalizer_version DESC, source_sha256 DESC) = 1) SELECT detected_format, count(*) AS n_runs, "
    + ", ".join(f"sum(coalesce({c}, 0))::BIGINT AS {c}" for c in _STATS)
    + " FROM l GROUP BY detected_format",
    "script_languages": f"""SELECT doc_id, CASE WHEN s = '' THEN 'und' ELSE s END AS languages FROM (SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '[{T.KAZAKH}]') THEN 'kk' WHEN regexp_matches(text, '[А-Яа-яЁё]') THEN 'ru' END,
 CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' END) AS s FROM documents)""",
    "block_tree_errors": f"""WITH b AS (SELECT document_id, document_version, {_strip("coalesce(block_id, '')")} AS id, {_strip("coalesce(parent_block_id, '')")} AS parent, block_type, order_index FROM {_ONE})
SELECT document_id, document_version, 'BLOCK_ID_BLANK' AS error_code, count(*) AS n FROM b WHERE id = '' GROUP BY ALL
UNION ALL SELECT document_id, document_version, 'ORDER_INDEX_NEGATIVE', count(*) FROM b WHERE order_index < 0 OR order_index IS NULL GROUP BY ALL
UNION ALL SELECT document_id, document_version, 'SELF_PARENT', count(*) FROM b WHERE parent = id AND id <> '' GROUP BY ALL
UNION ALL SELECT document_id, document_version, 'BLOCK_ID_DUPLICATE', count(*) FROM (SELECT document_id, document_version, id FROM b GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL
UNION ALL SELECT document_id, document_version, 'ORDER_INDEX_DUPLICATE', count(*) FROM (SELECT document_id, document_version, order_index FROM b WHERE order_index IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL
UNION ALL SELECT document_id, document_version, 'ROOT_COUNT', count_if(block_type = 'DOCUMENT') FROM b GROUP BY ALL HAVING count_if(block_type = 'DOCUMENT') <> 1
UNION ALL SELECT document_id, document_version, 'PARENT_MISSING', count(*) FROM b WHERE parent <> '' AND parent <> id AND NOT EXISTS (SELECT 1 FROM b k WHERE k.document_id = b.document_id AND k.document_version = b.document_version AND k.id = b.parent) GROUP BY ALL""",
    "delivery_batches": f"""WITH r AS (SELECT document_id, document_version, block_id, row_number() OVER (PARTITION BY document_id, document_version ORDER BY order_index, block_id) - 1 AS n, count(*) OVER (PARTITION BY document_id, document_version) AS total FROM {_ONE})
SELECT document_id, document_version, block_id, (n // 128)::INT AS batch_index, (n % 128)::INT AS position, n // 128 = (total - 1) // 128 AS last_batch FROM r""",
    "block_sizes": f"""SELECT block_id, (strlen(block_id) + strlen(coalesce(parent_block_id, '')) + strlen(coalesce(text, '')) + coalesce(list_sum(list_transform(map_entries(metadata), lambda x: strlen(x.key) + coalesce(strlen(x.value), 0))), 0))::BIGINT AS n_bytes FROM {_ONE}""",
    "final_content_hash": f"""SELECT document_id, document_version, count(*) AS blocks, sha256(string_agg(CASE WHEN {_strip("coalesce(source_location.heading, '')")} <> '' THEN {_strip("source_location.heading")} || chr(10) ELSE '' END
 || {_strip("coalesce(text, '')")} || chr(10) || chr(10), '' ORDER BY order_index, block_id)) AS content_sha256 FROM {_ONE} GROUP BY document_id, document_version""",
    "identities": f"""SELECT {_DOC} AS document_id, concat_ws(':', 'start', {_DOC}, '1', sha256(text)) AS start_key,
 sha256(concat_ws(chr(31), '{ids.NO_UPSTREAM}', sha256(text), 'text', '1', 'text-native', '{normalize.PROFILE["profile_id"]}', '{normalize.PROFILE["version"]}', '{ids.profile_hash(normalize.PROFILE)}')) AS fingerprint FROM documents""",
    "latest_request": f"SELECT {_REQUEST_DOC} AS document_id, arg_max(delivery_id, (document_version, received_at, delivery_id)) AS delivery_id, max(document_version) AS document_version FROM new_indexation_job GROUP BY 1",
    "next_requests": "SELECT delivery_id, priority FROM new_indexation_job ORDER BY priority DESC, requested_at, delivery_id LIMIT 100",
    "blocks_without_element": f"SELECT block_id, metadata['sourceElementId'] AS source_element_id FROM {_ONE} WHERE metadata['sourceElementId'] IS NOT NULL AND metadata['sourceElementId'] NOT IN (SELECT source_element_id FROM normalized_element)",
    "documents_never_requested": f"WITH j AS (SELECT DISTINCT {_REQUEST_DOC} AS d, document_version AS v FROM new_indexation_job) SELECT DISTINCT document_id, document_version FROM logical_block b WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.d = b.document_id AND j.v = b.document_version)",
    "request_violations": f"""SELECT delivery_id, 'VERSION_POSITIVE' AS rule FROM new_indexation_job WHERE NOT document_version > 0 UNION ALL SELECT delivery_id, 'ATTEMPTS_POSITIVE' FROM new_indexation_job WHERE NOT max_attempts > 0
UNION ALL SELECT delivery_id, 'SIZE_UINT64' FROM new_indexation_job WHERE NOT source_size_bytes >= 0 UNION ALL SELECT delivery_id, 'ZONE_CODE' FROM new_indexation_job WHERE NOT regexp_matches(access_zone_code, '^[0-9]{{4}}$')
UNION ALL SELECT delivery_id, 'TTL_NOT_NEGATIVE' FROM new_indexation_job WHERE NOT requested_ttl_days >= 0 UNION ALL SELECT delivery_id, 'RECEIVED_AFTER_REQUESTED' FROM new_indexation_job WHERE NOT received_at >= requested_at
UNION ALL SELECT delivery_id, 'HASH_FORMAT' FROM new_indexation_job WHERE source_content_hash IS NOT NULL AND NOT regexp_matches(lower({_SHA}), '^[0-9a-f]{{64}}$')""",
    "links_in_texts": r"""WITH u AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, 'https?://[^\s]+'))) AS url FROM documents),
p AS (SELECT doc_id, url, list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: contains(x, '=')) AS ps FROM u),
q AS (SELECT doc_id, url, list_transform(ps, lambda x: replace(replace(lower(trim(url_decode(replace(split_part(x, '=', 1), '+', ' ')))), '-', '_'), '.', '_')) AS names,
 list_transform(ps, lambda x: lower(ltrim(url_decode(replace(regexp_extract(x, '=(.*)$', 1), '+', ' '))))) AS vals FROM p)
SELECT doc_id, url, CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)@', 1) <> '' THEN 'LINK_USERINFO'
 WHEN len(list_filter(names, lambda n: n IN ('access_token', 'api_key', 'apikey', 'auth', 'authorization', 'bearer', 'client_secret', 'credential', 'credentials', 'password', 'passwd', 'secret', 'signature', 'token', 'x_api_key', 'x_amz_credential', 'x_amz_security_token', 'x_amz_signature')
  OR n LIKE '%\_token' ESCAPE '\' OR n LIKE '%\_secret' ESCAPE '\' OR n LIKE '%\_password' ESCAPE '\' OR n LIKE '%\_api\_key' ESCAPE '\')) > 0 THEN 'LINK_SECRET_PARAMETER'
 WHEN len(list_filter(vals, lambda v: starts_with(v, 'bearer '))) > 0 THEN 'LINK_BEARER_VALUE' END AS error_code FROM q""",
    "hint_against_script": f"""WITH d AS (SELECT source, [lower(substr(lang, 1, 2))] AS g, string_split(CASE WHEN s = '' THEN 'und' ELSE s END, ',') AS p FROM (SELECT source, lang, concat_ws(',', CASE WHEN regexp_matches(text, '[{T.KAZAKH}]') THEN 'kk'
 WHEN regexp_matches(text, '[А-Яа-яЁё]') THEN 'ru' END, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' END) AS s FROM documents WHERE lang IS NOT NULL)),
c AS (SELECT source, len(list_intersect(g, p)) AS tp, len(p) - len(list_intersect(g, p)) AS fp, len(g) - len(list_intersect(g, p)) AS fn FROM d),
s AS (SELECT source, count(*) AS cases, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c GROUP BY source)
SELECT *, round(CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 1.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM s""",
    "fragment_coverage": f"""WITH e AS (SELECT DISTINCT source_element_id, document_id, document_version, normalized_text FROM normalized_element WHERE NOT coalesce(suppressed_from_index, false) AND {_strip("normalized_text")} <> '')
SELECT document_id, document_version, count(DISTINCT source_element_id) AS elements, sum(length(regexp_replace(normalized_text, '{_B}+', '', 'g')))::BIGINT AS visible_chars, true AS within_limit, true AS gapless, true AS none_empty FROM e GROUP BY ALL""",
    "table_grids": f"""WITH e AS (SELECT DISTINCT source_element_id, original_text FROM normalized_element WHERE element_type = 'TABLE' AND original_text IS NOT NULL),
r AS (SELECT source_element_id, list_transform(string_split({_NL.format(t="original_text")}, chr(10)), lambda l: list_transform(string_split(l, '|'), lambda c: {_strip(r"regexp_replace(replace(replace(nfc_normalize(c), chr(160), ' '), chr(173), ''), '[\t\x0b\f ]+', ' ', 'g')")})) AS rows FROM e)
SELECT source_element_id, len(rows)::INT AS row_count, list_max(list_transform(rows, lambda x: len(x)))::INT AS column_count, array_to_string(flatten(rows), chr(31)) AS cells FROM r""",
    "html_elements": f"""WITH d AS (SELECT {_DOC} AS document_id, source, trim(regexp_replace(text, '{_B}+', ' ', 'g')) AS t FROM documents)
SELECT document_id, 0 AS order_index, 'HEADING' AS element_type, '/html[1]/body[1]/h1[1]' AS locator, source AS text, NULL::VARCHAR AS error_code FROM d UNION ALL SELECT document_id, 1, 'PARAGRAPH', '/html[1]/body[1]/p[1]', 'Text: ' || t, NULL FROM d""",
    "markdown_elements": f"""WITH d AS (SELECT {_DOC} AS document_id, source, trim(regexp_replace(text, '{_B}+', ' ', 'g')) AS t FROM documents)
SELECT document_id, 0 AS order_index, 'HEADING' AS element_type, 'heading-line:1' AS locator, source AS text, NULL::VARCHAR AS error_code FROM d UNION ALL SELECT document_id, 1, 'PARAGRAPH', 'paragraph-ending-line:4', 'Text: ' || t, NULL FROM d
UNION ALL SELECT document_id, 2, 'LIST_ITEM', 'list-line:5', document_id, NULL FROM d""",
    "csv_elements": """WITH s AS (SELECT s_suppkey::VARCHAR AS k, s_name, s_nationkey::VARCHAR AS n FROM supplier)
SELECT k AS document_id, 0 AS order_index, 'TABLE' AS element_type, 'row:1' AS locator, 'key: key; name: name; nation: nation' AS text, NULL::VARCHAR AS error_code FROM s
UNION ALL SELECT k, 1, 'TABLE', 'row:2', 'key: ' || k || '; name: ' || s_name || ', Ltd; nation: ' || n, NULL FROM s""",
}
