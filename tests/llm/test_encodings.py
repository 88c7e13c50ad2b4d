import pytest

from termforge.llm.encodings import from_bytes, garbled_fields, is_garbled, restore

CORRECT = [
    "The words SÃO and ÂNGULO are normal Portuguese, and the letter Ã is common there.",
    "Os órgãos, o coração da vila – “até amanhã” JÁ NO INÍCIO, INFORMAÇÃO",
    "LAS MÁQUINAS ENSEÑAN EL OTOÑO. ¿Qué hora es? ¡Vamos!",
    "CES THÉÂTRES ACHÈTENT LA LUMIÈRE D’ÉTÉ. Le cœur, l’œuvre, un œuf « ici » 5 m² et 3 m³ à 20 °C",
    "Die größten Öfen überqueren die weiße Straße § 5 © 2010 Ärger",
    "Źródła łączą świeży chleb: Żółte liście, pięć razy, ksiądz",
    "Все ученики меняют прежний порядок. СССР – «слово», объём ещё",
    "古い庭は48番の静かに細い道を変えている。テレビ 2024年",
    "Menu ☰ Home › News » x • y ↑ ✓ € 5 ™ ® …",
    "plain ASCII text",
]
LATIN, POLISH, RUSSIAN, JAPANESE = "Les élèves précèdent la dernière étape – l’été à Málaga", "Źródła łączą świeży chleb pięć razy", "Все ученики меняют прежний порядок", "静かな港は細い道を守っている"


@pytest.mark.parametrize("text", CORRECT)
def test_correct_text_is_left_alone(text):
    assert not is_garbled(text)


@pytest.mark.parametrize(("text", "wrong"), [(t, w) for t in (LATIN, POLISH, RUSSIAN) for w in ("latin-1", "cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850")] + [(JAPANESE, "latin-1"), (JAPANESE, "cp1252")])
def test_utf8_read_wrongly_comes_back(text, wrong):
    seen = from_bytes(text.encode(), wrong)
    assert is_garbled(seen)
    assert restore(seen) == text
    assert restore("größer – " + seen + " ångström") == "größer – " + text + " ångström"


def test_twice_and_lossy():
    twice = from_bytes(from_bytes(LATIN.encode(), "cp1252").encode(), "cp1252")
    assert is_garbled(twice) and restore(twice) == LATIN
    assert is_garbled("tradici�n")


@pytest.mark.parametrize(("text", "true", "wrong"), [(POLISH, "cp1250", "cp1252"), (RUSSIAN, "cp1251", "latin-1"), (RUSSIAN, "koi8-r", "cp1251"), (RUSSIAN, "cp866", "cp1251"), (JAPANESE, "cp932", "latin-1")])
def test_other_pairs(text, true, wrong):
    seen = from_bytes(text.encode(true), wrong)
    assert is_garbled(seen)
    assert restore(seen) == text


@pytest.mark.parametrize("true", ["cp437", "cp850"])
@pytest.mark.parametrize("word", ["café", "schön", "Mädchen", "fête", "français", "música", "canción", "TÜR"])
def test_dos_words_read_as_western(word, true):
    seen = from_bytes(f"the {word} here".encode(true), "cp1252")
    assert is_garbled(seen)


@pytest.mark.parametrize(("true", "wrong"), [("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman")])
def test_western_pairs_come_back(true, wrong):
    text = "café schön français très Noël España canción"
    assert restore(from_bytes(text.encode(true), wrong)) == text


def test_dos_cyrillic_read_as_latin():
    seen = from_bytes(RUSSIAN.encode("cp866"), "latin-1")
    assert is_garbled(seen) and restore(seen) == RUSSIAN


@pytest.mark.parametrize("text", ["“Foo” he said, “bar”and went", "“So” it was; not quote”d right", "he said „gut” and ‚gut’", "hola¡vamos ya!", "sinΘ 5 † note‡ a—b l’été word…word A•b", "GROßE STRAßE", "naïve “quote”, café—bar"])
def test_signs_that_correct_text_has(text):
    assert not is_garbled(text)


def test_rows(spark):
    seen = from_bytes(LATIN.encode(), "cp1252")
    rows = [("a", seen, LATIN, "x"), ("a", seen, LATIN, "x"), ("b", None, "", "x"), ("c", " ", seen * 2000, "x"), (None, seen, None, "x")]
    df = spark.createDataFrame(rows, "record string, field string, text string, restored string")
    got = {(r["record"], r["field"], r["restored"][:9], r["complete"]) for r in garbled_fields(df, "record", ["field", "text"], restoring=True).collect()}
    assert got == {("a", "field", LATIN[:9], True), ("c", "text", LATIN[:9], True), (None, "field", LATIN[:9], True)}
    assert garbled_fields(df.limit(0), "record", ["field"]).count() == 0


def test_text_garbled_many_times():
    text = once = "Les élèves précèdent la dernière étape"
    for _ in range(6):
        once = once.encode().decode("latin-1")
    assert is_garbled(once) and restore(once) == text


@pytest.mark.parametrize("wrong", ["cp1253", "cp1254", "cp1255", "cp1256"])
def test_utf8_read_in_further_encodings(wrong):
    text = "The keeper’s notes – “warm” hives"
    assert is_garbled(from_bytes(text.encode(), wrong)) and not is_garbled(text)
    assert not is_garbled({"cp1253": "Το παλιό σπίτι είναι κοντά στη θάλασσα", "cp1254": "Eski ağaç çok güzel, şu ışık", "cp1255": "הבית הישן ליד הים", "cp1256": "البيت القديم قرب البحر"}[wrong])
