import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quillmill.operators import acquire, parse
from quillmill.sources import formats as f


def pack(files, **kw):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in files.items():
            z.writestr(k, v)
    return b.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = pack({
    "[Content_Types].xml": "<x/>",
    "word/document.xml": f"""<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body </w:t><w:t>text</w:t></w:r></w:p>
<w:p><w:pPr><w:pStyle w:val="ListBullet"/></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>""",
    "word/styles.xml": f'<w:styles {W}><w:style w:styleId="Heading1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="ListBullet"><w:name w:val="List Bullet"/></w:style></w:styles>',
})
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
XLSX = pack({
    "[Content_Types].xml": "<x/>",
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></R>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>name</t></si><si><t>size</t></si><si><t>x</t></si></sst>",
    "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>',
    "xl/worksheets/sheet2.xml": f"<worksheet {S}><sheetData/></worksheet>",
})
P = 'xmlns:p="p" xmlns:a="a"'
PPTX = pack({
    "[Content_Types].xml": "<x/>", "ppt/presentation.xml": "<x/>",
    "ppt/slides/slide1.xml": f"""<p:sld {P}><p:sp><p:nvSpPr><p:cNvPr id="3"/></p:nvSpPr><p:spPr><a:off x="1" y="5"/></p:spPr><p:txBody><a:p><a:r><a:t>text</a:t></a:r></a:p></p:txBody></p:sp>
<p:sp><p:nvSpPr><p:cNvPr id="2"/><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>Head</a:t></a:r></a:p></p:txBody></p:sp></p:sld>""",
    "ppt/notesSlides/notesSlide1.xml": f"<p:notes {P}><a:p><a:r><a:t>note</a:t></a:r></a:p></p:notes>",
})
ODT = pack({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": '<d xmlns:t="t"><t:h>Head</t:h><t:p>one</t:p><t:p> </t:p><t:list><t:item><t:p>x</t:p></t:item></t:list></d>'})
EPUB = pack({
    "mimetype": "application/epub+zip", "META-INF/container.xml": '<c><rootfile full-path="o/p.opf"/></c>',
    "o/p.opf": '<package><manifest><item id="a" href="a.xhtml"/><item id="n" href="n.xhtml" properties="nav"/></manifest><spine><itemref idref="n"/><itemref idref="a"/></spine></package>',
    "o/a.xhtml": "<html><head><title>t</title></head><body><h1>One</h1><p>two</p></body></html>", "o/n.xhtml": "<html><body><p>nav</p></body></html>",
})
PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 3, 2) + b"\x08\x02\0\0\0"


def got(fmt, content):
    return [(e.kind, e.text) for e in f.read(fmt, content)]


def test_readers():
    assert got("TXT", b"a\nb\n \n\nc") == [("PARAGRAPH", "a\nb"), ("PARAGRAPH", "c")]
    assert got("DOCX", DOCX) == [("HEADING", "Title"), ("PARAGRAPH", "Body text"), ("LIST_ITEM", "item"), ("TABLE", None)]
    assert got("XLSX", XLSX) == [("TABLE", "name; size"), ("TABLE", "name: x; size: 2"), ("OTHER", None)]
    assert got("PPTX", PPTX) == [("HEADING", "Head"), ("PARAGRAPH", "text"), ("PARAGRAPH", "note")]
    assert got("ODT", ODT) == [("HEADING", "Head"), ("PARAGRAPH", "one"), ("LIST", "x")]
    assert got("EPUB", EPUB) == [("HEADING", "One"), ("PARAGRAPH", "two")]
    rtf = b"{\\rtf1{\\fonttbl{\\f0 Arial;}}Caf\\'e9 \\u1078?\\par second\\par}"
    assert got("RTF", rtf) == [("PARAGRAPH", "Café ж"), ("PARAGRAPH", "second")]
    assert got("CSV", b"a;b\n1;2\n3;\n") == [("TABLE", "a: a; b: b"), ("TABLE", "a: 1; b: 2"), ("TABLE", "a: 3; b: ")]
    assert got("PNG", PNG) == [("IMAGE", None)]


def test_markdown():
    md = b"# A\ntext\nmore\n\n## B\n- one\n2) two\n```\ncode\n\n```\ntail\n```\nopen"
    es = list(f.read("MARKDOWN", md))
    assert [(e.kind, e.text) for e in es] == [
        ("HEADING", "A"), ("PARAGRAPH", "text\nmore"), ("HEADING", "B"), ("LIST_ITEM", "one"), ("LIST_ITEM", "two"), ("CODE_BLOCK", "code\n"), ("PARAGRAPH", "tail"), ("CODE_BLOCK", "open"),
    ]
    assert es[2].path == ("A", "B") and es[0].locator == "heading-line:1" and es[-1].locator == "code-eof"


def test_html_repairs_and_paths():
    html = "<title>T</title><p>one <b>two<p>three<ul><li>a<li>b <ul><li>c</ul></ul><script>x</script><img src=i.png><pre>k</pre>"
    es = list(f.read_html(html, f.Limits()))
    assert [(e.kind, e.text) for e in es] == [
        ("HEADING", "T"), ("PARAGRAPH", "one two"), ("PARAGRAPH", "three"), ("LIST_ITEM", "a"), ("LIST_ITEM", "b c"), ("LIST_ITEM", "c"), ("IMAGE", None), ("CODE_BLOCK", "k"),
    ]
    assert es[2].locator == "/html[1]/body[1]/p[2]" and es[0].locator == "/html[1]/head[1]/title[1]"


@pytest.mark.parametrize(
    ("fmt", "content", "code"),
    [("ZZZ", b"", "PARSER_UNSUPPORTED_FORMAT"), ("PNG", b"\x89PNG\r\n\x1a\n", "MALFORMED_IMAGE"), ("CSV", b"", "PARSER_CSV_DIALECT")],
)
def test_typed_failures(fmt, content, code):
    with pytest.raises(f.FormatError) as e:
        list(f.read(fmt, content))
    assert e.value.code == code


@pytest.mark.parametrize(
    ("content", "code"),
    [
        (pack({"../x": "1"}), "CONTAINER_PATH_TRAVERSAL"), (pack({"a.zip": "1"}), "CONTAINER_NESTING_LIMIT"), (pack({"a": "0" * 1_000_000}), "CONTAINER_RESOURCE_LIMIT"),
        (pack({"a": "1"}), "UNSUPPORTED_ZIP_CONTAINER"), (b"PK\x03\x04junk", "MALFORMED_CONTAINER"),
    ],
)
def test_unsafe_packages(content, code):
    with pytest.raises(f.FormatError) as e:
        f.identify_package(content)
    assert e.value.code == code


def test_acquired(spark):
    rows = [
        ("d.docx", DOCX), ("s.xlsx", XLSX), ("p.pptx", PPTX), ("o.odt", ODT), ("e.epub", EPUB), ("i.png", PNG), ("w.txt", rb"{\rtf1 x}"), ("b.rtf", rb"{\rtf1 {x}"), ("a.exe", b"MZ..."), ("x.pdf", b"%PDF-1.4 %%EOF"),
        ("y.pdf", b"%PDF-1.4"), ("t.txt", b"plain"), ("m.md", b"# A"), ("h", b"<!DOCTYPE html><p>x"), ("c.csv", b"a,b\n1,2\n"), ("n.txt", b"a\0b"), ("u.txt", b"\xff\xfe\xfa"), ("z", b""), ("q", None),
    ]
    x = acquire.acquired(spark.createDataFrame(rows, "file_name string, content binary"))
    assert {r.file_name: r.detected_format or r.error_code for r in x.collect()} == {
        "d.docx": "DOCX", "s.xlsx": "XLSX", "p.pptx": "PPTX", "o.odt": "ODT", "e.epub": "EPUB", "i.png": "PNG", "w.txt": "RTF", "b.rtf": "MALFORMED_RTF", "a.exe": "UNSUPPORTED_EXECUTABLE", "x.pdf": "PDF",
        "y.pdf": "MALFORMED_PDF", "t.txt": "TXT", "m.md": "MARKDOWN", "h": "HTML", "c.csv": "CSV", "n.txt": "UNSUPPORTED_FORMAT", "u.txt": "TEXT_ENCODING_UNSUPPORTED", "z": "EMPTY_SOURCE", "q": "EMPTY_SOURCE",
    }
    assert [r.warnings for r in x.where("file_name = 'w.txt'").collect()] == [["FILE_TYPE_MISMATCH"]]


def test_text_is_parsed_alike_by_expressions_and_reader(spark):
    texts = ["a\r\nb\n\n c \n\t\n\n\nd", "", " \n ", "one"]
    x = spark.createDataFrame([(str(i), 1, "s", t, t.encode()) for i, t in enumerate(texts)], "document_id string, document_version long, source_sha256 string, text string, content binary")
    a = {(r.document_id, r.order_index, r.text, r.element_id) for r in parse.text_elements(x).collect()}
    y = parse.elements(x.withColumnRenamed("source_sha256", "sha256").withColumn("detected_format", F.lit("TXT")))
    assert a == {(r.document_id, r.order_index, r.text, r.element_id) for r in y.collect()} and len(a) == 4


def test_errors_have_a_row(spark):
    x = spark.createDataFrame([("a", 1, "s", "PNG", b"no")], "document_id string, document_version long, sha256 string, detected_format string, content binary")
    assert [r.error_code for r in parse.elements(x).collect()] == ["MALFORMED_IMAGE"]


def test_object_uris(spark):
    x = spark.createDataFrame([("seaweed://b/a c/d",), ("s3://b/k",), ("seaweed:///k",), ("seaweed://b/a/../c",), (None,)], "u string").select(acquire.object_uri(F.col("u")).alias("u")).select("u.*")
    assert [tuple(r) for r in x.collect()] == [("b", "a c/d", None), (None, None, "STORAGE_URI_SCHEME"), (None, None, "STORAGE_URI_INCOMPLETE"), (None, None, "STORAGE_URI_TRAVERSAL"), (None, None, None)]
