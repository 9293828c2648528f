"""Readers of document formats: bytes to elements, with the standard library only.

Each reader is a generator of Element; limits raise FormatError with the code that goes to the error channel. Readers
hold one document at a time.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from xml.etree import ElementTree as ET


class FormatError(ValueError):
    @property
    def code(self) -> str:
        return str(self.args[0])


@dataclass
class Element:
    kind: str
    locator: str
    text: str | None = None
    level: int | None = None
    path: tuple[str, ...] = ()
    role: str | None = None
    grid: list[list[str]] | None = None
    meta: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Limits:
    elements: int = 100_000
    chars: int = 20_000_000
    rows: int = 100_000
    columns: int = 1_000
    cells: int = 1_000_000
    cell_chars: int = 32_767
    sheets: int = 256
    slides: int = 2_000
    shapes: int = 50_000
    dom_nodes: int = 500_000
    entries: int = 10_000
    entry_bytes: int = 256 << 20
    total_bytes: int = 1 << 30
    ratio: float = 200.0
    rtf_depth: int = 256
    pixels: int = 100_000_000


#: Packages by the members that they must have, and their media types.
PACKAGES = (
    ("DOCX", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ("[Content_Types].xml", "word/document.xml")),
    ("XLSX", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ("[Content_Types].xml", "xl/workbook.xml")),
    ("PPTX", "application/vnd.openxmlformats-officedocument.presentationml.presentation", ("[Content_Types].xml", "ppt/presentation.xml")),
    ("EPUB", "application/epub+zip", ("META-INF/container.xml", "mimetype")),
    ("ODT", "application/vnd.oasis.opendocument.text", ("content.xml", "mimetype")),
)
NESTED = (".zip", ".docx", ".xlsx", ".pptx", ".odt", ".epub")


def identify_package(content: bytes, lim: Limits = Limits()) -> tuple[str, str]:
    """Format and media type of a ZIP package that is safe to open."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        infos = z.infolist()
    except (zipfile.BadZipFile, OSError, ValueError) as e:
        raise FormatError("MALFORMED_CONTAINER") from e
    if len(infos) > lim.entries:
        raise FormatError("CONTAINER_RESOURCE_LIMIT")
    seen: set[str] = set()
    total = 0
    for i in infos:
        name = i.filename.replace("\\", "/")
        total += i.file_size
        for bad, code in (
            (name.startswith("/") or ".." in name.split("/"), "CONTAINER_PATH_TRAVERSAL"),
            (name in seen, "CONTAINER_DUPLICATE_ENTRY"),
            (bool(i.flag_bits & 1), "CONTAINER_ENCRYPTED"),
            (i.file_size > lim.entry_bytes or total > lim.total_bytes or i.file_size > lim.ratio * max(1, i.compress_size), "CONTAINER_RESOURCE_LIMIT"),
            (name.lower().endswith(NESTED), "CONTAINER_NESTING_LIMIT"),
        ):
            if bad:
                raise FormatError(code)
        seen.add(name)
    for fmt, mime, need in PACKAGES:
        if not seen.issuperset(need):
            continue
        if "mimetype" in need and z.read("mimetype")[:128].decode("ascii", "ignore").strip() != mime:
            continue
        return fmt, mime
    raise FormatError("UNSUPPORTED_ZIP_CONTAINER")


def check_rtf(content: bytes, lim: Limits = Limits()) -> None:
    """Signature, no NUL, balanced groups; escaped braces don't count."""
    if not content[:16].lstrip().startswith(b"{\\rtf") or b"\0" in content:
        raise FormatError("MALFORMED_RTF")
    depth = 0
    for m in re.finditer(rb"\\.|[{}]", content, re.S):
        if m[0] == b"{":
            depth += 1
            if depth > lim.rtf_depth:
                raise FormatError("RTF_RESOURCE_LIMIT")
        elif m[0] == b"}":
            depth -= 1
            if depth < 0:
                break
    if depth:
        raise FormatError("MALFORMED_RTF")


def sniff_csv(sample: str, ext: str = "") -> tuple[str, str | None] | None:
    """Delimiter and quote of a delimited table, if the first rows are regular; fewer than three need the extension."""
    if not sample.strip():
        return None
    try:
        dialect = csv.Sniffer().sniff(sample[:65536], delimiters=",;\t")
        rows = []
        for r in csv.reader(io.StringIO(sample[:65536]), dialect):
            if any(c.strip() for c in r):
                rows.append(len(r))
            if len(rows) == 12:
                break
    except csv.Error:
        return None
    if len(rows) < (2 if ext in (".csv", ".tsv") else 3) or min(rows) < 2 or max(rows) - min(rows) > 1:
        return None
    return dialect.delimiter, dialect.quotechar


def image_size(content: bytes) -> tuple[str, int, int, int]:
    """Format, width, height and pages of a PNG, JPEG or TIFF, from its headers."""
    try:
        if content.startswith(b"\x89PNG\r\n\x1a\n"):
            return "PNG", *struct.unpack(">II", content[16:24]), 1
        if content.startswith(b"\xff\xd8\xff"):
            at = 2
            while at + 9 < len(content):
                if content[at] != 0xFF:
                    raise FormatError("MALFORMED_IMAGE")
                mark, size = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", content[at + 5 : at + 9])
                    return "JPEG", w, h, 1
                at += 2 + size
        if content[:4] in (b"II*\0", b"MM\0*"):
            e = "<" if content[:2] == b"II" else ">"
            at, pages, w, h = struct.unpack(e + "I", content[4:8])[0], 0, 0, 0
            while at and pages < 10_000:
                n = struct.unpack(e + "H", content[at : at + 2])[0]
                for k in range(n):
                    tag, kind = struct.unpack(e + "HH", content[at + 2 + 12 * k : at + 6 + 12 * k])
                    value = struct.unpack(e + ("H" if kind == 3 else "I"), content[at + 10 + 12 * k : at + (12 if kind == 3 else 14) + 12 * k])[0]
                    w, h = (value if tag == 256 and not pages else w), (value if tag == 257 and not pages else h)
                pages += 1
                at = struct.unpack(e + "I", content[at + 2 + 12 * n : at + 6 + 12 * n])[0]
            return "TIFF", w, h, pages
    except (struct.error, IndexError) as x:
        raise FormatError("MALFORMED_IMAGE") from x
    raise FormatError("MALFORMED_IMAGE")


def read_image(content: bytes, lim: Limits) -> Iterator[Element]:
    fmt, w, h, pages = image_size(content)
    if not w or not h or w * h > lim.pixels:
        raise FormatError("IMAGE_PIXEL_LIMIT")
    for p in range(1, pages + 1):
        yield Element("IMAGE", f"frame:{p}", role="SCANNED_IMAGE", meta={"page": str(p), "width": str(w), "height": str(h), "format": fmt})


def read_text(content: bytes, lim: Limits) -> Iterator[Element]:
    k = 0
    for part in re.split(r"\n(?:[^\S\n]*\n)+", "\n" + content.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n") + "\n"):
        if t := part.strip():
            yield Element("PARAGRAPH", f"paragraph:{k}", t)
            k += 1


_HEAD = re.compile(r"(#{1,6})\s+(.+)")
_ITEM = re.compile(r"\s*([-*+] |\d+[.)]\s+)(.+)")


def read_markdown(content: bytes, lim: Limits) -> Iterator[Element]:
    """Fenced code, ATX headings with their section path, list items, paragraphs; locators have 1-based line numbers."""
    path: list[str] = []
    code: list[str] | None = None
    held: list[str] = []

    def paragraph(n: int) -> Iterator[Element]:
        if held:
            yield Element("PARAGRAPH", f"paragraph-ending-line:{n}", "\n".join(held).strip(), path=tuple(path))
            held.clear()

    n = 0
    for n, line in enumerate(io.StringIO(content.decode("utf-8"), newline=None), 1):
        line = line.rstrip("\n")
        if line.strip().startswith("```"):
            if code is None:
                yield from paragraph(n)
                code = []
            else:
                yield Element("CODE_BLOCK", f"code-ending-line:{n}", "\n".join(code), path=tuple(path))
                code = None
        elif code is not None:
            code.append(line)
        elif m := _HEAD.fullmatch(line):
            yield from paragraph(n)
            del path[len(m[1]) - 1 :]
            path.append(m[2].strip())
            yield Element("HEADING", f"heading-line:{n}", path[-1], level=len(m[1]), path=tuple(path))
        elif m := _ITEM.fullmatch(line):
            yield from paragraph(n)
            yield Element("LIST_ITEM", f"list-line:{n}", m[2].strip(), path=tuple(path), meta={"marker": m[1].strip()})
        elif line.strip():
            held.append(line)
        else:
            yield from paragraph(n)
    yield from paragraph(n + 1)
    if code:
        yield Element("CODE_BLOCK", "code-eof", "\n".join(code), path=tuple(path))


def _pairs(head: list[str], row: list[str]) -> str:
    return "; ".join(f"{head[i] if i < len(head) and head[i] else f'column_{i + 1}'}: {v}" for i, v in enumerate(row))


def read_csv(content: bytes, lim: Limits) -> Iterator[Element]:
    text = content.decode("utf-8")
    try:
        dialect = csv.Sniffer().sniff(text[:65536], delimiters=",;\t")
    except csv.Error as e:
        raise FormatError("PARSER_CSV_DIALECT") from e
    head: list[str] = []
    for n, row in enumerate(csv.reader(io.StringIO(text, newline=""), dialect), 1):
        for bad, code in ((n > lim.rows, "PARSER_ROW_LIMIT"), (len(row) > lim.columns, "PARSER_COLUMN_LIMIT"), (any(len(c) > lim.cell_chars for c in row), "PARSER_CELL_TEXT_LIMIT")):
            if bad:
                raise FormatError(code)
        head = head or row
        yield Element("TABLE", f"row:{n}", _pairs(head, row), role="TABLE_ROW", meta={"delimiter": dialect.delimiter, "rowIndex": str(n)})


#: Tags that give elements, those without content, those whose content is dropped, and what an opening
#: tag closes first.
HTML_KIND = {"title": "HEADING", **{f"h{i}": "HEADING" for i in range(1, 7)}, "p": "PARAGRAPH", "li": "LIST_ITEM", "table": "TABLE", "pre": "CODE_BLOCK", "code": "CODE_BLOCK", "img": "IMAGE"}
VOID = set("area base br col embed hr img input link meta source track wbr".split())
DROPPED = {"script", "style", "noscript", "template"}
ENDS_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}}
IN_HEAD = set("title meta link base style script noscript template".split())


class _Node:
    __slots__ = ("attrs", "kids", "name", "up")

    def __init__(self, name: str, attrs: dict, up: _Node | None):
        self.name, self.attrs, self.up, self.kids = name, attrs, up, []


class _Tree(HTMLParser):
    """A tree with the repairs that browsers and common parsers make: html, head and body always exist, paragraphs and
    items end where another begins, unmatched end tags are ignored."""

    def __init__(self, limit: int):
        super().__init__(convert_charrefs=True)
        self.limit, self.count = limit, 0
        self.root = _Node("html", {}, None)
        self.head: _Node | None = None
        self.body: _Node | None = None
        self.at = self.root

    def _add(self, name: str, attrs: dict) -> _Node:
        self.count += 1
        if self.count > self.limit:
            raise FormatError("PARSER_DOM_LIMIT")
        n = _Node(name, attrs, self.at)
        self.at.kids.append(n)
        return n

    def _place(self, name: str) -> None:
        if self.at is self.root or self.at is self.head:
            inside = name in IN_HEAD and self.body is None
            self.at = self.root
            slot = "head" if inside else "body"
            if getattr(self, slot) is None:
                setattr(self, slot, self._add(slot, {}))
            self.at = getattr(self, slot)

    def handle_starttag(self, name: str, attrs) -> None:
        a = {k: v for k, v in attrs}
        if name == "html":
            self.root.attrs |= a
            return
        if name in ("head", "body"):
            self.at = self.root
            if getattr(self, name) is None:
                setattr(self, name, self._add(name, a))
            self.at = getattr(self, name)
            return
        self._place(name)
        if name in ENDS_P:
            self._close("p", stop={"table", "td", "th", "li", "body"})
        for t in IMPLIED.get(name, ()):
            self._close(t, stop={"table", "ul", "ol", "dl", "select", "body"})
        node = self._add(name, a)
        if name not in VOID:
            self.at = node

    def handle_startendtag(self, name: str, attrs) -> None:
        self.handle_starttag(name, attrs)
        if name not in VOID and self.at.name == name:
            self.at = self.at.up

    def _close(self, name: str, stop: set[str]) -> None:
        n = self.at
        while n is not None and n.name != name:
            if n.name in stop:
                return
            n = n.up
        if n is not None and n.up is not None:
            self.at = n.up

    def handle_endtag(self, name: str) -> None:
        if name in ("html", "body"):
            return
        self._close(name, stop={"table"} if name not in ("table", "body") and name not in ENDS_P else set())
        if name == "head":
            self.at = self.root

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._place("#text")
        self.at.kids.append(data)


def _words(n: _Node) -> Iterator[str]:
    for k in n.kids:
        if isinstance(k, str):
            if t := k.strip():
                yield t
        elif k.name not in DROPPED:
            yield from _words(k)


def read_html(content: bytes | str, lim: Limits) -> Iterator[Element]:
    """Elements in document order; a nested element repeats the text of the one around it. Paths count same-named
    siblings from 1; the counts are made once for each parent."""
    tree = _Tree(lim.dom_nodes)
    tree.feed(content if isinstance(content, str) else content.decode("utf-8"))
    tree.close()

    def walk(n: _Node, path: str) -> Iterator[Element]:
        if (kind := HTML_KIND.get(n.name)) == "IMAGE":
            yield Element(kind, path, role="HTML_IMAGE_REFERENCE", meta={k: n.attrs.get(k) or "" for k in ("src", "alt")})
        elif kind and (text := " ".join(_words(n))):
            level = (int(n.name[1]) if n.name[0] == "h" else 1) if kind == "HEADING" else None
            yield Element(kind, path, text, level=level, meta={"elementId": n.attrs["id"]} if n.attrs.get("id") else {})
        seen: dict[str, int] = {}
        for k in n.kids:
            if isinstance(k, _Node) and k.name not in DROPPED:
                seen[k.name] = seen.get(k.name, 0) + 1
                yield from walk(k, f"{path}/{k.name}[{seen[k.name]}]")

    yield from walk(tree.root, "/html[1]")


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element:
    try:
        return ET.fromstring(z.read(name))
    except (KeyError, ET.ParseError) as e:
        raise FormatError("MALFORMED_CONTAINER") from e


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _all(e: ET.Element, name: str) -> Iterator[ET.Element]:
    return (x for x in e.iter() if _local(x) == name)


def _office_text(p: ET.Element) -> str:
    out = []
    for x in p.iter():
        n = _local(x)
        out.append(x.text or "" if n == "t" else "\t" if n == "tab" else "\n" if n in ("br", "cr") else "")
    return "".join(out)


def read_docx(content: bytes, lim: Limits) -> Iterator[Element]:
    """Body order: headings by style, list items, tables as grids without text, images at their paragraph."""
    z = zipfile.ZipFile(io.BytesIO(content))
    styles: dict[str, str] = {}
    if "word/styles.xml" in z.namelist():
        for s in _all(_xml(z, "word/styles.xml"), "style"):
            name = next((_attr(n, "val") for n in s if _local(n) == "name"), None)
            styles[_attr(s, "styleId") or ""] = (name or "").lower()
    body = next(_all(_xml(z, "word/document.xml"), "body"), None)
    path: list[str] = []
    p_no = t_no = i_no = 0
    for x in [] if body is None else body:
        if _local(x) == "p":
            sid = next((_attr(s, "val") or "" for s in _all(x, "pStyle")), "")
            style = styles.get(sid, sid.lower())
            text = _office_text(x).strip()
            if text:
                m = re.match(r"heading\s*(\d)", style)
                if m:
                    del path[int(m[1]) - 1 :]
                    path.append(text)
                    yield Element("HEADING", f"paragraph:{p_no}", text, level=int(m[1]), path=tuple(path))
                else:
                    yield Element("LIST_ITEM" if "list" in style or any(True for _ in _all(x, "numPr")) else "PARAGRAPH", f"paragraph:{p_no}", text, path=tuple(path))
            for _ in _all(x, "blip"):
                yield Element("IMAGE", f"paragraph:{p_no}:image:{i_no}", path=tuple(path), role=EMBEDDED)
                i_no += 1
            p_no += 1
        elif _local(x) == "tbl":
            grid = [["\n".join(_office_text(p) for p in _all(c, "p")).strip() for c in r if _local(c) == "tc"] for r in _all(x, "tr")]
            yield Element("TABLE", f"table:{t_no}", None, path=tuple(path), grid=grid)
            t_no += 1


EMBEDDED = "EMBEDDED_IMAGE"


def read_xlsx(content: bytes, lim: Limits) -> Iterator[Element]:
    """A row for each row with cells: 'header: value; ...' by position among the cells that are filled."""
    z = zipfile.ZipFile(io.BytesIO(content))
    names = set(z.namelist())
    shared = [_office_text(s) for s in _xml(z, "xl/sharedStrings.xml") if _local(s) == "si"] if "xl/sharedStrings.xml" in names else []
    targets = {_attr(r, "Id"): _attr(r, "Target") or "" for r in _xml(z, "xl/_rels/workbook.xml.rels")}
    sheets = list(_all(_xml(z, "xl/workbook.xml"), "sheet"))
    if len(sheets) > lim.sheets:
        raise FormatError("PARSER_SHEET_LIMIT")
    cells = 0
    for k, s in enumerate(sheets):
        t = targets.get(next((v for a, v in s.attrib.items() if a.endswith("}id")), ""), "")
        part = t.lstrip("/") if t.startswith("/") else posixpath.normpath(f"xl/{t}")
        head: list[str] | None = None
        for row in _all(_xml(z, part), "row"):
            n = int(_attr(row, "r") or 0)
            if n > lim.rows:
                raise FormatError("PARSER_ROW_LIMIT")
            values: list[str] = []
            formulas = 0
            for c in row:
                f = next((x.text for x in c if _local(x) == "f"), None)
                v = next((x.text for x in c if _local(x) == "v"), None)
                if _attr(c, "t") == "s" and v is not None:
                    v = shared[int(v)] if int(v) < len(shared) else ""
                elif _attr(c, "t") == "inlineStr":
                    v = _office_text(c)
                if v is None and f is None:
                    continue
                cells += 1
                formulas += f is not None
                if cells > lim.cells:
                    raise FormatError("PARSER_CELL_LIMIT")
                if len(v or "") > lim.cell_chars:
                    raise FormatError("PARSER_CELL_TEXT_LIMIT")
                values.append(v or "")
            if len(values) > lim.columns:
                raise FormatError("PARSER_COLUMN_LIMIT")
            if not values:
                continue
            text = _pairs(head, values) if head is not None and n > 1 else "; ".join(values)
            head = values if head is None else head
            yield Element("TABLE", f"sheet:{k}:row:{n}", text, role="TABLE_ROW", meta={"sheetName": _attr(s, "name") or "", "rowIndex": str(n), "formulas": str(formulas)})
        if head is None:
            yield Element("OTHER", f"sheet:{k}:empty", role="EMPTY_SHEET", meta={"sheetName": _attr(s, "name") or ""})


def _number(name: str) -> int:
    return int(re.search(r"(\d+)\.xml$", name)[1])


def read_pptx(content: bytes, lim: Limits) -> Iterator[Element]:
    """Slides in order: the title first, then shapes by position; tables, pictures, texts; notes last."""
    z = zipfile.ZipFile(io.BytesIO(content))
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_number)
    if len(slides) > lim.slides:
        raise FormatError("PARSER_SLIDE_LIMIT")
    count = 0
    for k, name in enumerate(slides, 1):
        shapes = []
        for s in _xml(z, name).iter():
            if _local(s) not in ("sp", "pic", "graphicFrame"):
                continue
            count += 1
            if count > lim.shapes:
                raise FormatError("PARSER_SHAPE_LIMIT")
            title = any((_attr(p, "type") or "") in ("title", "ctrTitle") for p in _all(s, "ph"))
            off = next(_all(s, "off"), None)
            y, x = (int(_attr(off, "y") or 0), int(_attr(off, "x") or 0)) if off is not None else (0, 0)
            sid = int(next((_attr(c, "id") or 0 for c in _all(s, "cNvPr")), 0))
            shapes.append(((0 if title else 1, y, x, sid), title, s))
        for (_, _, _, sid), title, s in sorted(shapes, key=lambda t: t[0]):
            at = f"slide:{k}:shape:{sid}"
            if (table := next(_all(s, "tbl"), None)) is not None:
                grid = [["\n".join(_office_text(p) for p in _all(c, "p")) for c in r if _local(c) == "tc"] for r in _all(table, "tr")]
                yield Element("TABLE", at, "\n".join(" | ".join(r) for r in grid), grid=grid, meta={"page": str(k)})
            elif _local(s) == "pic":
                yield Element("IMAGE", at, role="SLIDE_IMAGE", meta={"page": str(k)})
            elif text := "\n".join(_office_text(p) for p in _all(s, "p")).strip():
                yield Element("HEADING" if title else "PARAGRAPH", at, text, role="SLIDE_TITLE" if title else "SLIDE_TEXT", meta={"page": str(k)})
        notes = f"ppt/notesSlides/notesSlide{_number(name)}.xml"
        if notes in z.namelist():
            text = "\n".join(t for p in _all(_xml(z, notes), "p") if (t := _office_text(p).strip()))
            if text:
                yield Element("PARAGRAPH", f"slide:{k}:notes", text, role="SPEAKER_NOTES", meta={"page": str(k)})


def read_odt(content: bytes, lim: Limits) -> Iterator[Element]:
    """Depth first: the first heading, paragraph, list or table with text gives an element and isn't entered."""
    z = zipfile.ZipFile(io.BytesIO(content))
    kinds = {"h": "HEADING", "p": "PARAGRAPH", "list": "LIST", "table": "TABLE"}
    n = 0
    todo = [_xml(z, "content.xml")]
    while todo:
        x = todo.pop()
        kind = kinds.get(_local(x))
        text = " ".join(t for s in x.itertext() if (t := s.strip())) if kind else ""
        if text:
            yield Element(kind, f"node:{n}", text)
            n += 1
        else:
            todo += reversed(list(x))


def read_epub(content: bytes, lim: Limits) -> Iterator[Element]:
    """Documents of the spine in order, navigation left out."""
    z = zipfile.ZipFile(io.BytesIO(content))
    opf = next((_attr(r, "full-path") or "" for r in _all(_xml(z, "META-INF/container.xml"), "rootfile")), "")
    package = _xml(z, opf)
    items = {_attr(i, "id"): i for i in _all(package, "item")}
    for k, ref in enumerate(_all(package, "itemref")):
        item = items.get(_attr(ref, "idref"))
        if item is None or "nav" in (_attr(item, "properties") or "").split():
            continue
        part = posixpath.normpath(posixpath.join(posixpath.dirname(opf), _attr(item, "href") or ""))
        j = 0
        for e in read_html(z.read(part), lim):
            if e.locator.startswith("/html[1]/head"):
                continue
            yield Element(e.kind, f"spine:{k}:node:{j}", e.text, e.level, role=e.role, meta=e.meta)
            j += 1


#: Destinations of RTF that hold no text, and control words that stand for characters.
RTF_SKIP = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "headerl", "headerr", "footerl", "footerr", "object", "themedata", "datastore", "listtable", "listoverridetable", "generator", "xmlnstbl", "latentstyles"}
RTF_CHAR = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "tab": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "cell": "|", "row": "\n"}
_RTF = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\(\*)|\\([^a-z])|([{}])|([^\\{}\r\n]+)|[\r\n]+")


def rtf_text(raw: str) -> str:
    out: list[str] = []
    stack: list[tuple[bool, int]] = []
    skip, uc, owed = False, 1, 0
    for m in _RTF.finditer(raw):
        word, arg, hexed, star, mark, brace, plain = m.groups()
        if brace == "{":
            stack.append((skip, uc))
        elif brace == "}":
            skip, uc = stack.pop() if stack else (False, 1)
        elif star or word in RTF_SKIP:
            skip = True
        elif word == "uc":
            uc = int(arg or 1)
        elif word == "u" and arg:
            owed = uc
            if not skip:
                out.append(chr(int(arg) % 65536))
        elif owed and (hexed or plain):
            out += [] if skip or not plain else [plain[owed:]]
            owed = max(0, owed - (1 if hexed else len(plain)))
        elif not skip:
            if hexed:
                out.append(bytes([int(hexed, 16)]).decode("cp1252", "replace"))
            elif mark:
                out.append({"~": " ", "_": "-", "-": ""}.get(mark, mark))
            else:
                out.append(RTF_CHAR.get(word, "") if word else plain or "")
    return "".join(out)


def read_rtf(content: bytes, lim: Limits) -> Iterator[Element]:
    k = 0
    for t in rtf_text(content.decode("latin-1")).splitlines():
        if t := t.strip():
            yield Element("PARAGRAPH", f"paragraph:{k}", t)
            k += 1


READERS = {
    "TXT": read_text, "MARKDOWN": read_markdown, "CSV": read_csv, "HTML": read_html, "DOCX": read_docx, "XLSX": read_xlsx, "PPTX": read_pptx, "ODT": read_odt,
    "EPUB": read_epub, "RTF": read_rtf, "PNG": read_image, "JPEG": read_image, "TIFF": read_image,
}
PARTIAL = {"RTF": "RTF_STRUCTURE_PARTIAL"}


def read(fmt: str, content: bytes, lim: Limits = Limits()) -> Iterator[Element]:
    """Elements of a document of a format; PDF needs a word extractor and goes through the layout operators."""
    reader = READERS.get((fmt or "").upper())
    if reader is None:
        raise FormatError("PARSER_UNSUPPORTED_FORMAT")
    chars = 0
    for n, e in enumerate(reader(content, lim), 1):
        chars += len(e.text or "")
        if n > lim.elements:
            raise FormatError("PARSER_ELEMENT_LIMIT")
        if chars > lim.chars:
            raise FormatError("PARSER_TEXT_LIMIT")
        yield e
