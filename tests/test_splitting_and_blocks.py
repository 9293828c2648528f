import hashlib

import pytest
from pyspark.sql import functions as F

from quillmill.operators import artifacts, blocks, checks, evaluate, fragments, layout, recognition
from quillmill.operators.folding import ordered_fold
from quillmill.runtime import fresh_dir

ELEMENT = "document_id string, document_version long, source_element_id string, element_type string, order_index int, normalized_text string, heading_level int, geometry struct<page_number:int>, language_hint string, element_role string, suppressed_from_index boolean"
P = fragments.Profile(min_chars=20, target_chars=40, soft_max_chars=60, hard_max_chars=80)


def split(spark, rows, profile=P):
    x = spark.createDataFrame([("d", 1, f"e{i}", k, i, t, lv, None, hint, role, False) for i, (k, t, lv, hint, role) in enumerate(rows)], ELEMENT)
    return fragments.fragments(x.unionByName(x), profile).orderBy("sequence").collect()


def test_sections_end_fragments(spark):
    r = split(spark, [("HEADING", "One", 1, "en", None), ("PARAGRAPH", "a" * 30, None, "en", None), ("HEADING", "Two", 1, "en", None), ("PARAGRAPH", "b" * 30, None, "en", None)])
    assert [(x.normalized_text.split("\n")[0], x.split_reason) for x in r] == [("One", "SECTION_BOUNDARY"), ("Two", "DOCUMENT_END")]
    assert [x.sequence for x in r] == [0, 1] and len({x.fragment_id for x in r}) == 2 and r[0].fragment_type == "SECTION"


def test_small_groups_merge_forward_and_exceptions_stay(spark):
    r = split(spark, [("PARAGRAPH", "a" * 78, None, None, None), ("PARAGRAPH", "small", None, None, None), ("CODE_BLOCK", "x = 1", None, None, None)])
    assert [(x.fragment_type, x.split_reason) for x in r] == [("PARAGRAPH", "FORCED_SPLIT"), ("OTHER", "DOCUMENT_END")]
    r = split(spark, [("PARAGRAPH", "a" * 50, None, None, None), ("PARAGRAPH", "b" * 50, None, None, None), ("PARAGRAPH", "c" * 5, None, None, None)])
    assert [x.char_count for x in r] == [50, 56]


def test_long_texts_stay_under_the_hard_limit(spark):
    text = "word " * 100 + "x" * 300
    r = split(spark, [("PARAGRAPH", text, None, None, None), ("HEADING", " ", 1, None, None), ("PARAGRAPH", None, None, None, None)])
    assert max(x.char_count for x in r) <= 80 and all(x.forced for x in r)
    assert "".join("".join(x.normalized_text.split()) for x in r) == "".join(text.split())


def test_list_intro_and_headings_are_context(spark):
    r = split(spark, [("HEADING", "Top", 1, None, None), ("PARAGRAPH", "p" * 70 + ":", None, None, None), ("LIST_ITEM", "one " * 15, None, None, None)])
    assert r[-1].context_prefix.split("\n")[0] == "Top" and r[-1].context_prefix.endswith(":")
    assert r[-1].primary_language == "en"


def test_profile_is_checked():
    with pytest.raises(ValueError, match="SPLITTER_PROFILE_INVALID"):
        fragments.Profile(min_chars=0)


def test_table_rows_with_header_again(spark):
    grid = [["h1", "h2"], *[[f"row{i}", "v" * 20] for i in range(5)]]
    x = spark.createDataFrame([("d", 1, "e0", "TABLE", 0, None, None, None, None, None, False, grid)], ELEMENT + ", grid array<array<string>>")
    r = fragments.fragments(x, P, grid="grid").orderBy("sequence").collect()
    assert [a.context_prefix for a in r] == ["", "TABLE HEADER\nh1\th2"] and [(a.table_row_from, a.table_row_to) for a in r] == [(0, 2), (3, 5)]
    assert {a.fragment_type for a in r} == {"TABLE"}


def test_fold_streams_in_order(spark):
    x = spark.createDataFrame([("a", 2), ("b", 1), ("a", 1), ("a", 3)], "k string, n int")
    got = ordered_fold(x, ["k"], ["n"], lambda key, rows: iter([(key[0], ",".join(str(r.n) for r in rows))]), "k string, s string")
    assert {tuple(r) for r in got.collect()} == {("a", "1,2,3"), ("b", "1")}


BLOCK = "document_id string, document_version long, block_id string, parent_block_id string, block_type string, text string, order_index int, metadata map<string,string>, source_location struct<page_start:int,page_end:int,char_start:int,char_end:int,section_path:string,heading:string>"


def block_table(spark, n=300):
    rows = [("d", 1, f"b{i:03}", None if not i else "b000", "DOCUMENT" if not i else "PARAGRAPH", f" text é{i} ", i, {"k": "v"}, (None, None, None, None, "p", " H " if i == 1 else "")) for i in range(n)]
    return spark.createDataFrame(rows, BLOCK)


def test_batches(spark):
    x = blocks.batches(block_table(spark))
    got = {r.batch_index: (r.n, r.last) for r in x.groupBy("batch_index").agg(F.count("*").alias("n"), F.max("last_batch").alias("last")).collect()}
    assert got == {0: (128, False), 1: (128, False), 2: (44, True)}
    sized = blocks.batches_by_size(block_table(spark, 10), 60).collect()
    assert max(r.batch_index for r in sized) > 1 and all(r.error_code is None for r in sized)
    assert {r.error_code for r in blocks.batches_by_size(block_table(spark, 3), 5).collect()} == {"BLOCK_EXCEEDS_BATCH_BYTES"}
    assert blocks.batch_hashes(x).count() == 3


def test_content_hash(spark):
    want = "".join(("H\n" if i == 1 else "") + f"text é{i}\n\n" for i in range(5))
    r = blocks.content_hashes(block_table(spark, 5)).first()
    assert (r.blocks, r.content_sha256) == (5, hashlib.sha256(want.encode()).hexdigest())


def test_tree_errors(spark):
    rows = [("d", 1, "a", None, "DOCUMENT", 0), ("d", 1, "b", "b", "LIST", 1), ("d", 1, "c", "zz", "LIST", 1), ("d", 1, " ", "a", "LIST", -1), ("e", 1, "a", "", "LIST", 0)]
    x = spark.createDataFrame(rows, "document_id string, document_version long, block_id string, parent_block_id string, block_type string, order_index int")
    assert {(r.document_id, r.error_code) for r in blocks.tree_errors(x).collect()} == {
        ("d", "SELF_PARENT"), ("d", "PARENT_MISSING"), ("d", "BLOCK_ID_BLANK"), ("d", "ORDER_INDEX_NEGATIVE"), ("d", "ORDER_INDEX_DUPLICATE"), ("e", "ROOT_COUNT"),
    }


def test_blocks_of_fragments(spark):
    x = spark.createDataFrame([("d", 1, "e0", "PARAGRAPH", 0, "Hello there.", None, None, "en", None, False)], ELEMENT)
    got = {r.block_type: r.text for r in blocks.from_fragments(fragments.fragments(x)).collect()}
    assert got == {"DOCUMENT": "", "PARAGRAPH": "Hello there."}


def test_artifacts_round_trip(spark):
    b = block_table(spark, 25).select("document_id", "document_version", "order_index", "text")
    p = artifacts.parts(artifacts.canonical_records(b, "elements", "order_index"), max_records=10)
    root = fresh_dir(spark, "art")
    target = artifacts.publish(p, root)
    assert artifacts.publish(p, root) == target
    records, errors = artifacts.load(spark, target)
    assert records.count() == 25 and errors.count() == 0
    assert artifacts.totals(spark.read.parquet(f"{target}/manifest")).first().parts == 3
    spark.read.parquet(f"{target}/parts").withColumn("body", F.concat("body", F.lit("x"))).write.parquet(f"{root}/bad/parts")
    spark.read.parquet(f"{target}/manifest").write.parquet(f"{root}/bad/manifest")
    records, errors = artifacts.load(spark, f"{root}/bad")
    assert records.count() == 0 and {r.error_code for r in errors.collect()} == {"PART_BYTES_MISMATCH"}


def test_lines_of_words(spark):
    w = [("d", 1, "b", 20.0, 25.0, 10.5, 20.0, 9.0, "Bold"), ("d", 1, "a", 1.0, 5.0, 12.0, 20.0, 11.0, "x"), ("d", 1, "c", 1.0, 9.0, 40.0, 50.0, 10.0, None)]
    x = layout.lines(spark.createDataFrame(w, "doc string, page long, text string, x0 double, x1 double, top double, bottom double, size double, fontname string")).orderBy("line").collect()
    assert [(r.text, r.bold, r.font_size) for r in x] == [("a b", True, 10.0), ("c", False, 10.0)]


def test_two_columns(spark):
    rows = [("full", 0, 100, 0), ("l1", 0, 40, 10), ("r1", 60, 100, 10), ("l2", 0, 40, 20), ("r2", 60, 100, 20), ("foot", 0, 100, 30)]
    x = spark.createDataFrame([("d", 1, i, t, float(a), float(b), float(top)) for i, (t, a, b, top) in enumerate(rows)], "doc string, page long, line int, text string, x0 double, x1 double, top double")
    got = layout.reading_order(x, F.lit(100.0)).orderBy("reading_index").collect()
    assert [r.text for r in got] == ["full", "l1", "l2", "r1", "r2", "foot"]


def test_recognised_text(spark):
    obs = spark.createDataFrame([("d", 1, "o1", "Same Text!", 0, "PAGE"), ("d", 1, "o2", "other words here", 1, "PAGE"), ("d", 1, "o3", "Other, words here", 2, "PAGE"), ("d", 1, "o4", "other words here", 3, "EMBEDDED_IMAGE"), ("d", None, "o5", "x", 4, "PAGE")], "doc string, page int, id string, text string, pos int, scope string")
    native = spark.createDataFrame([("d", 1, "same text"), ("d", None, "x"), ("e", 1, "other words here")], "doc string, page int, text string")
    left = recognition.not_native(obs, native)
    assert {r.id for r in left.collect()} == {"o2", "o3", "o4"}
    assert {r.id for r in recognition.first_wins(left, ["pos"]).collect()} == {"o2", "o4"}
    e = spark.createDataFrame([("d", "p", 0), ("d", "q", 1)], "doc string, id string, order_index int")
    a = spark.createDataFrame([("d", "r2", "p", 1), ("d", "r1", "p", 0), ("d", "lost", "zz", 2)], "doc string, id string, parent_id string, accept_pos int")
    assert [r.id for r in recognition.merged_order(e, a).orderBy("order_index").collect()] == ["p", "r1", "r2", "q", "lost"]
    seen = []
    c = spark.createDataFrame([("d", "c1", b"i"), ("d", "c2", b"i"), ("d", "c3", b"j")], "doc string, candidate_id string, image binary")
    got = recognition.recognise(c, lambda b: [(b.decode(), 0.9)]).collect()
    assert {(r.candidate_id, r.text) for r in got} == {("c1", "i"), ("c2", "i"), ("c3", "j")} and seen == []


def test_evaluation(spark):
    x = spark.createDataFrame([("en", [1, 2], [1, 3]), ("en", [1], [1]), ("ru", [], [])], "g string, gold array<int>, pred array<int>")
    tp, fp, fn = evaluate.set_counts(F.col("gold"), F.col("pred"))
    g = evaluate.by_group(x.select("g", tp.alias("tp"), fp.alias("fp"), fn.alias("fn")), "g")
    assert {r.g: (r.precision, r.recall, r.f1) for r in g.collect()} == {"en": (0.666667, 0.666667, 0.666667), "ru": (1.0, 1.0, 1.0)}
    assert [r.g for r in evaluate.gates(g, "g", 0.9).collect()] == ["en"]


def test_links(spark):
    urls = {"https://u:p@h/x": "LINK_USERINFO", "https://h/?a=1&token=x": "LINK_SECRET_PARAMETER", "https://h/?my_secret=1": "LINK_SECRET_PARAMETER", "https://h/?a=Bearer%20x": "LINK_BEARER_VALUE", "https://h/a?b=c": None}
    x = spark.createDataFrame([(u,) for u in urls], "u string").select("u", checks.link_credentials(F.col("u")).alias("e"))
    assert {r.u: r.e for r in x.collect()} == urls


def test_tree_errors_of_blocks_that_share_an_id(spark, tmp_path):
    from quillmill.plans import pipeline

    rows = [("r", "d", 1, None, "DOCUMENT", 0), ("a", "d", 1, "r", "PARAGRAPH", 1), ("a", "d", 1, "r", "PARAGRAPH", 2), ("a", "d", 1, "r", "PARAGRAPH", 2), (None, "d", 1, "r", "PARAGRAPH", 3), (None, "d", 1, "r", "PARAGRAPH", 4)]
    spark.createDataFrame(rows, "block_id string, document_id string, document_version long, parent_block_id string, block_type string, order_index int").write.parquet(f"{tmp_path}/logical_block.parquet")
    got = {(r.error_code, r.n) for r in pipeline.block_tree_errors(spark, str(tmp_path)).collect()}
    assert {x for x in got if x[0].startswith("BLOCK_ID")} >= {("BLOCK_ID_BLANK", 2)} and any(x[0] == "BLOCK_ID_DUPLICATE" for x in got)
