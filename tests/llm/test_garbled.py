import pytest

from vellumflow.llm import garbled as G

SOUND = ["It’s naïve to expect “that” – café, €5…", "La pièce n° 7 à l’été, où «ça» va", "Ø 12 mm Rohr – ¾ Zoll; √2 ≤ 45° ± 2°", "├── scans\n│   └── page1", "Ÿ, Â and Ô are listed in annex D.", "The converter turned “é” into “Ã©” in the export.", "Эта накладная была отправлена утром, но наш склад её ещё не подтвердил.", "SÃO JOÃO, AVIÃO", "先月、倉庫から報告書が届きました", "felix＠post.test", "Über die Größe", "W mieście każda umowa", "m³ and 21 °C", ""]


@pytest.mark.parametrize("text", SOUND)
def test_sound_texts_stay(text):
    assert G.restore(text)[0] is False


ORIGINALS = ["It’s naïve: the café paid £5 – twice…", "Für die Prüfung gelten die üblichen Bedingungen", "La société a été vérifiée", "Niestety brakuje strony, więc faktura będzie odesłana", "Эта накладная была отправлена до конца недели"]


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251"])
@pytest.mark.parametrize("text", ORIGINALS)
def test_utf8_read_with_a_code_page_comes_back(text, codec):
    raw = text.encode()
    garbled = "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in raw)
    affected, restored, _, whole = G.restore("Before, sound text. " + garbled + " after")
    assert affected and whole and restored == "Before, sound text. " + text + " after"


def test_twice_utf16_and_lost():
    once = "naïve – résumé".encode().decode("cp1252")
    assert G.restore(once.encode().decode("cp1252"))[1] == "naïve – résumé"
    assert G.restore("x “a”. " + "The façade of it".encode("utf-16-le").decode("latin-1"))[1] == "x “a”. The façade of it"
    affected, _, _, whole = G.restore("The caf� is shut")
    assert affected and not whole


@pytest.mark.parametrize(("text", "wrong", "right"), [("Wir möchten Sie höflich an die Kündigung erinnern", "mac_roman", "cp1252"), ("Каждая смета должна быть подписана", "koi8-r", "cp1251"), ("Как видно из отчёта, жалоба была", "latin-1", "cp1251"), ("Prosimy o zapłatę kwoty w ciągu dni", "cp1252", "cp1250")])
def test_one_code_page_read_as_another(text, wrong, right):
    affected, restored, _, _ = G.restore(text.encode(right).decode(wrong))
    assert affected and restored == text


def test_spans_are_maximal_and_leave_the_rest():
    text = "Ã©Ã¨ and é, Ã"
    assert [(s, e, d) for s, e, d in G.multibyte_spans(text, "cp1252")] == [(0, 4, "éè")]


def test_table(spark):
    df = spark.createDataFrame([(1, "cafÃ©", "x"), (2, None, "x"), (3, "", "x"), (4, "plain", "x"), (5, "cafÃ©", "x"), (6, "x " * 200_000 + "cafÃ©", "x")], "extraction_id long, text string, steps string")
    assert {r["extraction_id"]: r["restored_text"][-4:] for r in G.garbled(df).collect()} == {1: "café", 5: "café", 6: "café"}
    assert G.garbled(df.limit(0)).count() == 0


def test_passages_garbled_in_different_ways():
    russian, french = "Эта накладная была отправлена утром", "l’été à la société"
    affected, restored, steps, whole = G.restore("Note: " + french.encode().decode("cp850") + ". " + russian.encode("cp1251").decode("cp1252"))
    assert affected and whole and len(steps) == 2 and restored == f"Note: {french}. {russian}"
    many = "".join(f"Line {i}, sound. " + "The façade of it".encode("utf-16-le").decode("latin-1") + " and so on without a fault here.\n" for i in range(9))
    assert G.restore(many)[1:4:2] == ("".join(f"Line {i}, sound. The façade of it and so on without a fault here.\n" for i in range(9)), True)


def test_a_passage_that_stays_garbled_is_not_restorable():
    affected, _, _, whole = G.restore("caf├® is shut, " + "x╔y╔z w╔w╔w q╔q╔q")
    assert affected and not whole


def test_entities_are_decoded_in_spans_only():
    affected, restored, _, whole = G.restore("The caf&Atilde;&copy; paid &Acirc;&pound;7 &amp; the buyer&acirc;&euro;&trade;s bill; &eacute;, x &#195;&#169;")
    assert affected and whole and restored == "The café paid £7 &amp; the buyer’s bill; &eacute;, x é"
    for sound in ("caf&eacute; &copy; 2024 &amp;", "“&Atilde;&copy;” was in the export", "&Atilde;", "a&nbsp;b &unknownname;"):
        assert not G.restore(sound)[0]


def test_quotation_marks_that_became_letters():
    text = "it says “scanned copy” and “annex”."
    assert G.restore(text.encode("cp1252").decode("mac_roman"))[:2] == (True, text)
    assert not G.restore("où ì, î; il dîne")[0]
