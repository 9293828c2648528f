import pytest

from quillmill.llm import sentences as S

GOLD = [
    "Mr. Brown met Dr. Green at 9 a.m. in room 25.| See sec. 5.1 of v3.4.5.| Send it to a.b@x.example at once!| Next.",
    "Акты и т. д. переданы г-ну Иву в г. Томск.| Срок истёк в 85 г. по вине склада!| Инженер А. В. Ли подписал акт.| Ставка 5,5, т. е. на 9 единиц.| См. п. 9.9 и рис. 9.| Конец.",
    "«Готов ли указатель?» — спросил он.| Он ответил: «Дело закрыто».| Этап.",
    "Er kam am 3. Mai an.| Vgl. Abs. 4 Nr. 7, z. B. Abb. 50.| „Ist das fertig?“ fragte sie.| Und.",
    "M. Roux a signé devant Mme Blanc.| Qui a validé AX-1 ?| « Est-ce prêt ? » demanda la dame.| Voir art. 3 al. 4, p. 48.| Fin.",
    "“색인이 준비되었습니까?” 감사원이 물었다.| 요율이 9.9에서 올랐다.", "“好了吗？”审计员问道。|他写道：“文件已经结案。”|下一句。", "「できましたか。」と監査員が尋ねた。|次。",
    "«هل الفهرس جاهز؟» سأل المدقق.| وقع د. سمير على المحضر.| لجنة.", "“क्या तैयार है?” उसने पूछा।| दर 9.9 से बढ़ी।", "Ποιος ενέκρινε την αίτηση;| Το τμήμα.| Βλ. άρθ. 9, σελ. 9.| Τέλος.",
    "อัตราเพิ่มจาก 9.9 เป็น 9.9 เปอร์เซ็นต์| ใครอนุมัติคำขอ DM-96 ของสาขา| จบ", "The clerk replied: “It is closed.”| “Is it ready?” asked the man.| Yes.", "¿Está listo?, preguntó.| El Sr. Paz firmó ante la Dra. Sol.| Fin.",
    "MR. BROWN MET DR. GREEN AT 9 A.M. IN ROOM 25.| «ГОТОВ ЛИ?» — СПРОСИЛ ОН.| АКТЫ И Т. Д. ПЕРЕДАНЫ.| “IS IT READY?” ASKED THE MAN.| END.", "Одно.|Другое без пробела.|HS-1 код.",
    "He works in sales at col.| The team won.", "The answer is no.| 5 people left.| See no. 5 and annex no. 7 on p. 3.", "It weighs 5 m.| The next one is bigger.", "The gap is 25 mm.| The next is 3.", "It took 24 hr.| The rest waited.",
    "Mme Blanc et M. Roux ont signé.| Le mur fait 5 m.| Il tombe.", "Er kam mit Hr. Meier und wog 5 kg.| Der Rest blieb.", "El Sr. Paz y la Sra. Sol.| Véase pág. 5 y p.ej. Madrid.", "Он весит 5 т.| Она легче.| Инж. Ли подписал.",
    "Voir art. 3709 al. 2928 de l’annexe, p. 285.| Bon.", "Bu av. Demir ve dr. Kaya için.| Bkz. md. 5.",
    "No terminator at all", "One​.| Two.", "A line\n\n|Another block",
]


@pytest.mark.parametrize("gold", GOLD)
def test_boundaries(gold):
    text = gold.replace("|", "")
    want, at = [], 0
    for part in gold.split("|")[:-1]:
        at += len(part)
        want.append(len(text[:at].rstrip()))
    assert S.boundaries(text) == want, [text[a:b] for a, b in S.spans(text)]


@pytest.mark.parametrize("text", ["", " ", "...", ".", "?!", "a" * 200_000, "A. " * 2000, "\n\n\n", "„“”»", "x.​​"])
def test_units_cover_the_text(text):
    sp = S.spans(text)
    assert "".join(text[a:b] for a, b in sp).split() == text.split() or "".join("".join(text[a:b].split()) for a, b in sp) == "".join(text.split())
    assert all(a < b for a, b in sp) and sp == sorted(sp)


@pytest.mark.parametrize(("part", "want"), [("Das ist der", ("de",)), ("The", ("en",)), ("Құжат", ("kk",)), ("Актът", ("ru",)), ("Її", ("uk",)), ("Акт", ("ru", "uk", "kk")), ("Το", ("el",)), ("Xyz", ("en", "de", "fr", "es", "pt", "tr"))])
def test_languages(part, want):
    token = {"К": "т", "А": "т", "Қ": "т", "Ї": "т", "Τ": "κ"}.get(part[0], "x")
    assert S.languages(f"{part} {token}.", 0, len(part) + 1, len(part) + 2) == want


def test_every_terminator_is_known():
    """Of all scripts: a terminator between two letters of a script without case ends a sentence."""
    import regex

    every = [chr(c) for c in range(0x80, 0x20000) if regex.match(r"\p{SB=STerm}", chr(c))]
    assert len(every) > 100 and all(S.boundaries(f"क{c} क") == [2] for c in every if c not in ";")


def test_frames(spark):
    x = spark.createDataFrame([("1", "One two. Three four.", "e"), ("1", "One two. Three four.", "e"), ("2", None, "e"), ("3", " ", "e"), (None, "One two. Three four.", "e")], "k string, text string, boundary string")
    got = {(r.id, r.boundary) for r in S.boundary_rows(x, "k", "text").collect()}
    assert got == {("1", 8), (None, 8)}
    assert [r.sentence_text for r in S.sentence_rows(x.where("k = '1'"), "k", "text").distinct().orderBy("sentence").collect()] == ["One two.", "Three four."]
    assert S.boundary_rows(x.where("false"), "k", "text").count() == 0
