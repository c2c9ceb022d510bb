from __future__ import annotations

import pytest

import os

import pyarrow.parquet as pq

from bytegrove.llm.sentences import Model, features, fit_model, split_sentences, units

DOCS = "/root/testdata/sf0.1/documents.parquet"
needs_documents = pytest.mark.skipif(not os.path.exists(DOCS), reason="no test data here")
_fitted: dict[str, Model] = {}


def texts(n: int, start: int = 0) -> list[str]:
    return [t for t in pq.read_table(DOCS, columns=["text"]).column(0).slice(start, n).to_pylist() if t]


def fitted() -> Model:
    """Fitted on some of the documents, starting from nothing."""
    if "model" not in _fitted:
        _fitted["model"] = Model.fit(texts(3000))
    return _fitted["model"]


def split(text: str, model: Model) -> list[str]:
    return [text[a:b] for a, b in units(text, model)]

CASES = {
    "en": ["Mr. Chairman, the Dept. of Roads rose at 9.30 a.m. with p. 4.", "(Applause.)", "[The bell rang. Order was restored.]", "It costs 5.12 crowns, i.e. little.", "Dr. A. H. Cole said: “It is over. We wait.” and sat down.", "The N.R.A. and he met at 4 p.m. (Applause.) at last.", "He asked \"Who pays? We won't.\"", "We stay, etc.", "So be it!"],
    "de": ["Der 23. Bericht liegt vor, vgl. S. 436.", "Das gilt z. B. auch am 14. Mai.", "(Heiterkeit bei der Opposition)", "Hat Abg. Ralin gefragt: „Es reicht. Wir warten.“?", "Ja."],
    "fr": ["M. D. Falov a répondu : « Non. Jamais. » avant de partir.", "Que fait la chambre ?", "L’art. 5, al. 2, prévoit 15,58 % ; c’est un fait."],
    "es": ["¡Eso no es cierto!", "¿Qué hace Sr. Talow, p. ej. hoy?", "(El Sr. Kelis: ¡Muy bien!)", "Véase la pág. 356."],
    "el": ["Τι κάνει το υπουργείο;", "Ο κ. Πιζας είπε: «Ναι. Όχι.» και έφυγε.", "Συζητούμε· αυτό ισχύει."],
    "hi": ["डॉ. चिचो ने कहा (पृ. 263 देखें)।", "सितोह ने कहा, “बात खत्म। हम नहीं रुकेंगे।” और बैठ गए।", "यह सच नहीं है!", "क्या यह सच है?"],
}


@needs_documents
@pytest.mark.parametrize("lang", CASES)
def test_spaced_scripts(lang):
    text = "  ".join(CASES[lang])
    assert [text[a:b] for a, b in units(text, fitted())] == CASES[lang]


@needs_documents
def test_scripts_without_spaces():
    ja = ["ミハス君は「遅すぎる！誰が払うのか。」と述べて着席しました。", "（拍手）", "（「異議なし」と呼ぶ者あり）", "No.278の資料を（93頁参照）御覧ください。", "そう願っていたのですが……先へ進みます。", "なぜですか？"]
    assert [("".join(ja))[a:b] for a, b in units("".join(ja), fitted())] == ja
    zh = ["沙康议员说：“到此为止。我们不等了。”然后坐下。", "（笑声。）", "国库又忘记了；这是事实。"]
    assert ["".join(zh)[a:b] for a, b in units("".join(zh), fitted())] == zh
    th = ["เมื่อวานนี้ ท่าน ส.ส. กูงี ยังไม่อธิบายเรื่อง (ดูหน้า 75) ค่ะ", "(เสียงปรบมือ)", "เท่านี้ครับ"]
    assert [" ".join(th)[a:b] for a, b in units(" ".join(th), fitted())] == th


@needs_documents
def test_structure():
    text = "534. Second reading: forest\nwardens\n\nProf. RALECK (GA): (Applause.) Once more: it is\nso. We [Hear. Hear!] agree\n \nThe Speaker:\n\nLe fin (a"
    got = [text[a:b] for a, b in units(text, fitted())]
    assert got == ["534. Second reading: forest\nwardens", "Prof. RALECK (GA):", "(Applause.)", "Once more: it is\nso.", "We [Hear. Hear!] agree", "The Speaker:", "Le fin (a"]
    thai = "(เสียงปรบมือ) ที่ประชุมเห็นชอบค่ะ ขอเปิดประชุมครับ"
    assert [thai[a:b] for a, b in units(thai, fitted())] == thai.replace(") ", ")|").replace("ค่ะ ", "ค่ะ|").split("|")
    first = "(Applause.) I call the next speaker on the list\n\nItem 12. On (old) bridges"
    assert [first[a:b] for a, b in units(first, fitted())] == ["(Applause.)", "I call the next speaker on the list", "Item 12. On (old) bridges"]
    glued = "That is a fact.Under Sec. 80 we stay."
    assert [glued[a:b] for a, b in units(glued, fitted())] == ["That is a fact.", "Under Sec. 80 we stay."]
    once = "Once more: we stay. The annex states: “a. B” and no more."
    assert [once[a:b] for a, b in units(once, fitted())] == ["Once more: we stay.", "The annex states: “a. B” and no more."]


@needs_documents
def test_odd_texts():
    for t in ("", " \n\n ", ".", "...", "(", ")", "“", "a", "?!?!", "((((", "“(”)", "\n\n.\n\n!", "a.b.c.", ": x", "：", "​.​ A", "𝔸. 𝔹"):
        spans = list(units(t, fitted()))
        assert all(a < b and not t[a].isspace() and not t[b - 1].isspace() for a, b in spans)
        covered = {i for a, b in spans for i in range(a, b)}
        assert all(i in covered or c.isspace() for i, c in enumerate(t))
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


@needs_documents
def test_long_text_takes_time_in_proportion():
    text = "The House met at 9 a.m. on Monday. (Applause.) " * 20_000
    assert sum(1 for _ in units(text, fitted())) == 40_000
    assert sum(1 for _ in units("(" * 20_000 + "a. B" + "“" * 2000, fitted())) >= 1


def test_on_documents(spark):
    docs = spark.createDataFrame([(1, "One. Two!", 5), (2, None, 5), (3, "", 5), (4, "x", 5), (4, "x", 5), (None, "Y", 5)], "doc_id long, text string, ord int")
    rows = split_sentences(docs).collect()
    assert {(r.doc_id, r.ord, r.start_pos, r.end_pos, r.sentence) for r in rows} == {(1, 0, 0, 4, "One."), (1, 1, 5, 9, "Two!"), (4, 0, 0, 1, "x"), (None, 0, 0, 1, "Y")} and len(rows) == 5
    assert split_sentences(docs.limit(0)).count() == 0
    assert fit_model(docs.limit(0)).weights == {} and fit_model(docs).weights


@needs_documents
def test_the_model_decides():
    """Without fitting every candidate is a boundary; fitted, most words with a period are known for what they are."""
    rough, right, n = Model({}), 0, 0
    for case in CASES.values():
        for sentence in case:
            n += 1
            right += split(sentence, rough) == [sentence]
    assert right < 0.75 * n
    held = texts(400, 6000)
    fewer = sum(len(split(t, fitted())) for t in held)
    assert fewer < 0.75 * sum(len(split(t, rough)) for t in held)
    weights = fitted().weights
    assert weights["w=mr&upper"] + weights["w=mr"] < 0 < weights["sure"]


@needs_documents
def test_held_out_language():
    """Fitted without one language, most of its boundaries still are found by case, length and script."""
    rows = pq.read_table(DOCS, columns=["text", "lang"]).slice(0, 4000).to_pylist()
    spanish = [(r["lang"] or "").strip().lower()[:2] == "es" for r in rows]
    without = Model.fit([r["text"] for r, es in zip(rows, spanish) if r["text"] and not es])
    same = total = 0
    for r, es in zip(rows, spanish):
        if es and r["text"]:
            want, got = set(units(r["text"], fitted())), set(units(r["text"], without))
            same, total = same + len(want & got), total + len(want)
    assert total > 500 and same > 0.95 * total


def test_marks_of_any_script():
    """Marks that are nothing but a sentence's end need no model."""
    for text in ("یہ سچ ہے۔ کیا یہ سچ ہے؟", "ይህ እውነት ነው። አሁን እንሂድ።", "Սա ճիշտ է։ Գնանք։", "ဒါမှန်တယ်။ သွားကြစို့။", "នេះជាការពិត។ ទៅយើង។"):
        assert len(split(text, Model({}))) == 2


@needs_documents
def test_cyrillic_by_shape():
    """A language without any document: capitals after longer words end sentences."""
    assert split("Палата собралась утром. Вопрос закрыт! Что дальше? Мы ждём.", fitted()) == ["Палата собралась утром.", "Вопрос закрыт!", "Что дальше?", "Мы ждём."]


@needs_documents
def test_headings_and_labels_of_any_length_and_place():
    text = "We agree.\n\nWe agree again.\n\nSo we do.\n\nOnce more.\n\n4. Ferry licences and all that was ever said about them in this house, in its committees and in the press, by whoever had a view on it\n\nThat is all."
    assert len(split(text, fitted())) == 6


@needs_documents
def test_held_out_accuracy():
    """Fitted on some documents, the model finds the paragraph ends of others when these are joined by a blank."""
    right = total = 0
    for t in texts(800, 5000):
        ps = [" ".join(p.split()) for p in t.split("\n\n")]
        ps = [p for p in ps if p and p[-1] in ".!?。！？।" and p[0] not in "([（" and ":" not in p[:60] and "：" not in p[:60]]
        for a, b in zip(ps, ps[1:]):
            joined = f"{a} {b}"
            total += 1
            right += any(e == len(a) for _, e in units(joined, fitted()))
    assert total > 200 and right / total > 0.99


def test_no_feature_says_more_than_the_context():
    assert len(set(features(fit_context("Mr", "upper")))) == len(features(fit_context("Mr", "upper")))


def fit_context(word: str, follows: str):
    from bytegrove.llm.sentences import Context

    return Context("period", word, "", follows, "", 0, False)
