"""Logical splitting: elements in order become units, units are packed into fragments, small fragments merged.

Packing is a fold whose state is one buffer, so a document streams through it (see folding): memory holds the buffer
and the fragments not yet settled, never the document. Sizes are kept incrementally.

Suppressed and empty elements are left out; an empty document has no fragments; a grapheme longer than the hard limit
gives an error row instead of a fragment.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions import ids, segment
from quillmill.functions.text import KAZAKH
from quillmill.operators.folding import ordered_fold


@dataclass(frozen=True)
class Profile:
    """The default limits and names, whose canonical JSON is part of fragment ids."""

    profile_id: str = "logical-multilingual-v1"
    version: str = "1"
    min_chars: int = 800
    target_chars: int = 5000
    soft_max_chars: int = 8000
    hard_max_chars: int = 12000
    target_words: int = 700
    soft_max_words: int = 1200
    hard_max_words: int = 1800
    target_sentences: int = 25
    hard_max_sentences: int = 80
    repeat_heading_context: bool = True
    repeat_parent_headings: bool = True
    repeat_list_intro: bool = True
    repeat_table_header: bool = True
    sentence_boundary_backend: str = "unicode"

    def __post_init__(self) -> None:
        if not 0 < self.min_chars <= self.target_chars <= self.soft_max_chars <= self.hard_max_chars:
            raise ValueError("SPLITTER_PROFILE_INVALID:chars")
        if not 0 < self.target_words <= self.soft_max_words <= self.hard_max_words or not 0 < self.target_sentences <= self.hard_max_sentences:
            raise ValueError("SPLITTER_PROFILE_INVALID:guards")

    def digest(self) -> str:
        return ids.profile_hash(dataclasses.asdict(self))


#: Roles whose small fragments stay on their own.
KEEP_SMALL = {"FAQ", "WARNING", "LEGAL_DEFINITION", "DEFINITION", "NOTICE", "ALERT"}
OWN_BLOCK = {"TABLE", "CODE_BLOCK"}


@dataclass
class Unit:
    text: str
    element: str
    kind: str
    path: tuple[str, ...]
    page: int | None
    hint: str | None
    role: str | None
    sentences: int = 0
    words: int = 0
    reliable: bool = True
    part: int = 0
    context: str = ""
    forced: bool = False
    rows: tuple[int, int] | None = None


@dataclass
class Size:
    chars: int = 0
    words: int = 0
    sentences: int = 0
    reliable: bool = True

    def plus(self, u: Unit) -> Size:
        gap = 1 if self.chars or self.words or self.sentences else 0
        return Size(self.chars + len(u.text) + gap, self.words + u.words, self.sentences + u.sentences, self.reliable and u.reliable)

    def both(self, o: Size) -> Size:
        return Size(self.chars + 1 + o.chars, self.words + o.words, self.sentences + o.sentences, self.reliable and o.reliable)


@dataclass
class Group:
    units: list[Unit] = field(default_factory=list)
    size: Size = field(default_factory=Size)
    reason: str = ""
    forced: bool = False

    def add(self, u: Unit) -> None:
        self.units.append(u)
        self.size = self.size.plus(u)

    @property
    def keeps(self) -> bool:
        return any((u.role or "").upper() in KEEP_SMALL or u.kind in OWN_BLOCK for u in self.units)


class Splitter:
    def __init__(self, p: Profile):
        self.p = p

    def over(self, s: Size) -> bool:
        p = self.p
        return s.chars > p.hard_max_chars or s.reliable and s.words > p.hard_max_words or s.sentences > p.hard_max_sentences

    # Units

    def units(self, rows: Iterable) -> Iterator[Unit]:
        """rows: elements in order with their parts. Adds what depends on the order: headings above, list intros,
        repeated table headers."""
        path: list[str] = []
        intro: str | None = None
        for r in rows:
            if r.error:
                raise ValueError(r.error)
            lead = r.lead or ""
            if r.kind == "HEADING" and lead:
                del path[max(1, int(r.level) if r.level == r.level and r.level else 1) - 1 :]
                path.append(lead)
            if r.parts is None or not len(r.parts):
                intro = None if r.kind == "TABLE" else intro
                continue
            if r.kind == "PARAGRAPH" and lead:
                intro = lead
            elif r.kind not in ("LIST", "LIST_ITEM"):
                intro = None
            listed = self.p.repeat_list_intro and intro and r.kind in ("LIST", "LIST_ITEM")
            page = None if r.page is None or r.page != r.page else int(r.page)
            for k, u in enumerate(r.parts):
                context = intro if listed else ""
                if u["row_from"] is not None and k and self.p.repeat_table_header:
                    context = f"TABLE HEADER\n{lead}"
                yield Unit(
                    text=u["text"], element=r.element, kind=r.kind, path=tuple(path), page=page, hint=r.hint, role=r.role, sentences=u["sentences"], words=u["words"], reliable=u["reliable"],
                    part=k, context=context, forced=u["forced"], rows=None if u["row_from"] is None else (u["row_from"], u["row_to"]),
                )

    def parts(self, kind: str, text: str | None, hint: str | None, grid) -> tuple[str | None, list[tuple]]:
        """What an element alone decides: its lead (heading, list intro or table header) and its parts."""
        if kind == "TABLE" and grid is not None and len(grid):
            rows = ["\t".join("" if c is None else str(c) for c in row) for row in grid]
            return rows[0], self.table_parts(rows)
        t = (text or "").strip()
        if not t:
            return None, []
        return t if kind == "HEADING" or kind == "PARAGRAPH" and t.endswith(":") else None, self.text_parts(t, hint)

    def text_parts(self, text: str, hint: str | None) -> list[tuple]:
        """Sentences packed up to the hard limits; longer ones are cut between words."""
        p, chunks = self.p, []
        now: list[str] = []
        chars = n_words = 0
        sure = True

        def emit() -> None:
            nonlocal now, chars, n_words, sure
            if now:
                chunks.append((" ".join(now).strip(), len(now), False))
            now, chars, n_words, sure = [], 0, 0, True

        for s in segment.sentences(text, hint, p.sentence_boundary_backend) or [text]:
            w, ok = segment.words(s)
            if len(s) > p.hard_max_chars or ok and w > p.hard_max_words:
                emit()
                chunks += [(c, 1, True) for c in self.forced(s)]
                continue
            length = chars + len(s) + (1 if now else 0)
            if now and (length > p.hard_max_chars or sure and ok and n_words + w > p.hard_max_words or len(now) + 1 > p.hard_max_sentences):
                emit()
                length = len(s)
            now.append(s)
            chars, n_words, sure = length, n_words + w, sure and ok
        emit()
        return [(c, n, *segment.words(c), forced or len(chunks) > 1, None, None) for c, n, forced in chunks]

    def table_parts(self, rows: list[str]) -> list[tuple]:
        """Rows packed up to the hard limits; a row that is too long is cut between words."""
        p = self.p
        out: list[tuple] = []
        held: list[str] = []
        first = chars = n_words = 0
        sure = True

        def add(text: str, a: int, z: int, forced: bool) -> None:
            out.append((text, 0, *segment.words(text), forced or bool(out), a, z))

        for i, r in enumerate(rows):
            w, ok = segment.words(r)
            huge = len(r) > p.hard_max_chars or ok and w > p.hard_max_words
            full = held and (chars + 1 + len(r) > p.hard_max_chars or sure and ok and n_words + w > p.hard_max_words)
            if held and (huge or full):
                add("\n".join(held), first, i - 1, False)
                held = []
            if huge:
                for c in self.forced(r):
                    add(c, i, i, True)
                continue
            if not held:
                first, chars, n_words, sure = i, len(r), w, ok
            else:
                chars, n_words, sure = chars + 1 + len(r), n_words + w, sure and ok
            held.append(r)
        if held:
            add("\n".join(held), first, len(rows) - 1, False)
        return out

    def forced(self, text: str) -> list[str]:
        p, out, now = self.p, [], []
        chars = n_words = 0
        sure = True
        for w in text.split() or [text]:
            if len(w) > p.hard_max_chars:
                if now:
                    out.append(" ".join(now))
                now, chars, n_words, sure = [], 0, 0, True
                out += self.by_grapheme(w)
                continue
            n, ok = segment.words(w)
            if now and (chars + 1 + len(w) > p.hard_max_chars or sure and ok and n_words + n > p.hard_max_words):
                out.append(" ".join(now))
                now, chars, n_words, sure = [], 0, 0, True
            chars += len(w) + (1 if now else 0)
            now.append(w)
            n_words, sure = n_words + n, sure and ok
        return out + ([" ".join(now)] if now else [])

    def by_grapheme(self, text: str) -> list[str]:
        out, at = [], 0
        end = 0
        for m in regex.finditer(r"\X", text):
            if m.end() - m.start() > self.p.hard_max_chars:
                raise ValueError("SPLITTER_GRAPHEME_EXCEEDS_HARD_CHAR_GUARD")
            if m.end() - at > self.p.hard_max_chars:
                out.append(text[at:end])
                at = end
            end = m.end()
        return [*out, text[at:]]

    # Packing

    def packed(self, units: Iterable[Unit]) -> Iterator[Group]:
        p, g = self.p, Group()

        def close(reason: str, forced: bool = False) -> Group:
            nonlocal g
            done, g = g, Group()
            done.reason, done.forced = reason, forced
            return done

        for u in units:
            if u.kind == "HEADING" and g.units and (g.size.chars >= p.min_chars or g.keeps):
                yield close("SECTION_BOUNDARY")
            if g.units:
                last, trial = g.units[-1], g.size.plus(u)
                safe = not (last.kind == "PARAGRAPH" and last.text.endswith(":") and u.kind in ("LIST", "LIST_ITEM"))
                safe = safe and (last.element != u.element or last.kind in ("PARAGRAPH", "LIST_ITEM", "TABLE", "CODE_BLOCK"))
                full = g.size.chars >= p.target_chars or g.size.reliable and g.size.words >= p.target_words or g.size.sentences >= p.target_sentences
                if self.over(trial):
                    yield close("HARD_MAX", True)
                elif (trial.chars > p.soft_max_chars or trial.reliable and trial.words > p.soft_max_words) and safe:
                    yield close("SOFT_MAX_SAFE_BOUNDARY")
                elif full and (u.kind == "HEADING" or last.path != u.path):
                    yield close("STRUCTURAL_BOUNDARY")
            g.add(u)
        if g.units:
            yield close("DOCUMENT_END")

    def merged(self, groups: Iterable[Group]) -> Iterator[Group]:
        """Small groups join the next one, else the one before. Looks one group ahead and keeps one back."""
        todo = iter(groups)
        back: Group | None = None
        now = next(todo, None)
        while now is not None:
            ahead = next(todo, None)
            small = now.size.chars < self.p.min_chars and not now.keeps
            if small and ahead is not None and self.fits(now, ahead):
                if back is not None:
                    yield back
                back, now = self.join(now, ahead), next(todo, None)
                continue
            if small and back is not None and self.fits(back, now):
                back = self.join(back, now)
            else:
                if back is not None:
                    yield back
                back = now
            now = ahead
        if back is not None:
            yield back

    def fits(self, a: Group, b: Group) -> bool:
        if a.keeps or b.keeps:
            return False
        return a.units[-1].path[:-1] == b.units[0].path[:-1] and not self.over(a.size.both(b.size))

    @staticmethod
    def join(a: Group, b: Group) -> Group:
        return Group([*a.units, *b.units], a.size.both(b.size), "SMALL_FRAGMENT_MERGE", a.forced or b.forced)

    # Fragments

    def fragment(self, key: tuple, seq: int, g: Group, fingerprint: str, normalizer: tuple[str, str]) -> tuple:
        p, us = self.p, g.units
        text = "\n".join(u.text for u in us).strip()
        elements = list(dict.fromkeys(u.element for u in us))
        pages = [u.page for u in us if u.page is not None]
        rows = [u.rows for u in us if u.rows is not None]
        path = us[-1].path
        above = (path[:-1] if us[0].kind == "HEADING" else path) if p.repeat_heading_context else ()
        above = above if p.repeat_parent_headings else above[-1:]
        prefix = "\n".join(dict.fromkeys(x for x in [*above, *(u.context for u in us if u.context and u.context not in text)] if x))
        kind = self.kind({u.kind for u in us})
        content = hashlib.sha256(text.encode()).hexdigest()
        part = max(u.part for u in us)
        low, high = (min(a for a, _ in rows), max(b for _, b in rows)) if rows else (None, None)
        name = [
            str(key[0]), str(key[1]), ",".join(elements), content, fingerprint, *normalizer, p.version, p.profile_id, p.digest(), p.sentence_boundary_backend, kind, str(part),
            "" if low is None else str(low), "" if high is None else str(high),
        ]
        langs = self.languages(us, text)
        forced = g.forced or any(u.forced for u in us)
        return (
            key[0], key[1], seq, hashlib.sha256("\x1f".join(name).encode()).hexdigest(), kind, text, prefix, list(path), elements, min(pages) if pages else None, max(pages) if pages else None,
            low, high, len(text), sum(u.words for u in us), sum(u.sentences for u in us), all(u.reliable for u in us), "FORCED_SPLIT" if forced else g.reason, forced, part,
            langs[0], langs, list(dict.fromkeys(u.role for u in us if u.role)), content, None,
        )

    @staticmethod
    def kind(kinds: set[str]) -> str:
        for name, of in (("TABLE", {"TABLE"}), ("LIST", {"LIST", "LIST_ITEM"}), ("CODE", {"CODE_BLOCK"})):
            if kinds <= of:
                return name
        return "SECTION" if "HEADING" in kinds else "PARAGRAPH" if kinds <= {"PARAGRAPH"} else "OTHER"

    @staticmethod
    def languages(us: list[Unit], text: str) -> list[str]:
        hints = list(dict.fromkeys(u.hint.lower().split("-", 1)[0] for u in us if u.hint))
        if hints:
            return hints
        found = ["kk"] if any(c in KAZAKH for c in text) else ["ru"] if regex.search("[А-Яа-яЁё]", text) else []
        return found + (["en"] if regex.search("[A-Za-z]", text) else []) or ["und"]


FRAGMENTS = (
    "document_id string, document_version long, sequence int, fragment_id string, fragment_type string, normalized_text string, context_prefix string, hierarchy array<string>, element_ids array<string>, "
    "page_from int, page_to int, table_row_from int, table_row_to int, char_count int, word_count int, sentence_count int, word_count_reliable boolean, split_reason string, forced boolean, "
    "continuation_index int, primary_language string, languages array<string>, roles array<string>, content_sha256 string, error_code string"
)


PARTS = (
    "document_id string, document_version long, element string, kind string, order_index int, level int, page int, hint string, role string, lead string, error string, "
    "parts array<struct<text:string,sentences:int,words:int,reliable:boolean,forced:boolean,row_from:int,row_to:int>>"
)
_PART_FIELDS = ("text", "sentences", "words", "reliable", "forced", "row_from", "row_to")


def element_parts(elements: DataFrame, p: Profile, grid: str | None = None) -> DataFrame:
    """PARTS: segmentation and counting, the costly share, for each element where it lies. No shuffle, so a document with
    a third of all rows is spread over the tasks; the fold after it only adds up sizes."""
    cells = F.lit(None).cast("array<array<string>>") if grid is None else F.col(grid)
    x = elements.where("not coalesce(suppressed_from_index, false)").select(
        "document_id", "document_version", F.col("source_element_id").alias("element"), F.col("element_type").alias("kind"), F.col("order_index").cast("int").alias("order_index"), F.col("heading_level").cast("int").alias("level"),
        F.col("geometry.page_number").cast("int").alias("page"), F.col("language_hint").alias("hint"), F.col("element_role").alias("role"), F.col("normalized_text").alias("text"), cells.alias("grid"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Splitter(p)
        for b in batches:
            leads, errors, parts = [], [], []
            for kind, text, hint, g in zip(b["kind"], b["text"], b["hint"], b["grid"]):
                lead, got, error = None, [], None
                try:
                    lead, got = s.parts(kind, text, hint, g)
                except ValueError as e:
                    error = str(e)
                leads.append(lead)
                errors.append(error)
                parts.append([dict(zip(_PART_FIELDS, u)) for u in got])
            out = b.drop(columns=["text", "grid"]).assign(lead=leads, error=errors, parts=parts)
            yield out.astype({"level": "Int32", "page": "Int32"})[[f.split(" ")[0] for f in PARTS.split(", ")]]

    return x.mapInPandas(run, PARTS)


def fragments(elements: DataFrame, profile: Profile | None = None, fingerprint: str = "", normalizer: tuple[str, str] = ("1", "normalization-multilingual-v1"), grid: str | None = None) -> DataFrame:
    """elements: document_id, document_version, source_element_id, element_type, order_index, normalized_text,
    heading_level, geometry, language_hint, element_role, suppressed_from_index; identical copies count once. grid: a
    column with the cells of tables. A document with an element that can't be split gives an error row."""
    p = profile or Profile()
    x = element_parts(elements, p, grid)

    def fold(key: tuple, rows: Iterator) -> Iterator[tuple]:
        s = Splitter(p)

        def once() -> Iterator:
            last = None
            for r in rows:
                if (r.order_index, r.element) != last:  # copies are neighbours in this order
                    last = (r.order_index, r.element)
                    yield r

        seq = 0
        try:
            for g in s.merged(s.packed(s.units(once()))):
                yield s.fragment(key, seq, g, fingerprint, normalizer)
                seq += 1
        except ValueError as e:
            yield (key[0], key[1], seq, *[None] * 21, str(e))

    return ordered_fold(x, ["document_id", "document_version"], ["order_index", "element"], fold, FRAGMENTS)
