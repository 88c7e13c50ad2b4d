import pytest

from termforge.llm.personal import Names, known_names, luhn, masked, masked_texts, mod23, mod97, personal_spans, spans

NAMES = Names(frozenset({"kestra", "drago", "célie", "autumn"}), frozenset({"umberfield", "o'mallin", "fenn-carrow", "baker", "field"}))


def found(text):
    return [(k, text[s:e]) for k, s, e in spans(text, NAMES)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Reply to lumpa37 [at] dasale [dot] example [dot] org please", [("email", "lumpa37 [at] dasale [dot] example [dot] org")]),
        ("write to mailto:zor@corcene.example.", [("email", "zor@corcene.example")]),
        ("mail (GO_CO85 AT XACURD DOT TEST)", [("email", "GO_CO85 AT XACURD DOT TEST")]),
        ("Contact: Xyr Abc at a.b(at)c-mail.example or call 822.555.0152 now", [("name", "Xyr Abc"), ("email", "a.b(at)c-mail.example"), ("phone", "822.555.0152")]),
        ("Follow @telmine_bot for updates at noon", []),
        ("Tel. +49 (0)30 5550672, fax 07700 900711", [("phone", "+49 (0)30 5550672"), ("phone", "07700 900711")]),
        ("Call me on (952) 555-0105. Ring +33 1 99 00 83 47 or 030/5550292", [("phone", "(952) 555-0105"), ("phone", "+33 1 99 00 83 47"), ("phone", "030/5550292")]),
        ("Order 55-22447 left; the sum 12 345 678; run of 2023-02-04, seed 356247, ratio 3:4:5, pages 30-184", []),
        ("SSN#975 21 4457, personal number 461124-6568, DNI 47457118R", [("id_number", "975 21 4457"), ("id_number", "461124-6568"), ("id_number", "47457118R")]),
        ("Passport number: Y55498372; tax ID 99-5292222; NI number QQ 54 22 32 C", [("id_number", "Y55498372"), ("id_number", "99-5292222"), ("id_number", "QQ 54 22 32 C")]),
        ("Delivery goes to Apt. 8, 1842a Kestrel Street. From 26 bis rue des Tilleuls to C/ Mayor 144, 3º B", [("address", "Apt. 8, 1842a Kestrel Street."), ("address", "26 bis rue des Tilleuls"), ("address", "C/ Mayor 144")]),
        ("Post an Mühlengasse 18, ul. Lipowa 57, Am alten Markt 3-5, im Jahr 2023", [("address", "Mühlengasse 18"), ("address", "ul. Lipowa 57"), ("address", "Am alten Markt 3-5")]),
        ("According to Dr Kestra D. Umberfield, it rained. O'Mallin, Drago came; célie umberfield and K. FIELD did not", [("name", "Kestra D. Umberfield"), ("name", "O'Mallin, Drago"), ("name", "célie umberfield"), ("name", "K. FIELD")]),
        ("My name is Zyx Qwerty and I like the Field Museum in autumn, said a baker", [("name", "Zyx Qwerty")]),
        (None, []),
        ("", []),
        (" \n", []),
    ],
)
def test_spans(text, expected):
    assert (found(text) if text else spans(text, NAMES)) == expected


def test_checksums():
    assert luhn("4539578763621486") and not luhn("4539578763621487")
    assert mod97("GB82 WEST 1234 5698 7654 32") and not mod97("GB82 WEST 1234 5698 7654 33") and not mod97("")
    assert mod23("12345678Z") and not mod23("12345678A")


def test_masked_text_keeps_the_rest():
    assert masked("Hi,\nMs. Kestra Umberfield <k@x.example> said: “né”", NAMES) == "Hi,\nMs. [NAME] <[EMAIL]> said: “né”"
    assert masked(None, NAMES) is None


def test_names_are_learnt_and_rows(spark):
    rows = [(1, "My name is Zyla Korvath and so on.", "x"), (2, "According to Zyla Korvath, yes.", "x"), (3, "then 𝒳 zyla korvath left", "x"), (4, None, "x"), (3, "then 𝒳 zyla korvath left", "x"), (5, "", "x")]
    df = spark.createDataFrame(rows, "record long, text string, kind string")
    parts = spark.createDataFrame([("Baker", "family"), (None, "given"), ("Autumn", None)], "name_part string, part_kind string")
    names = known_names(df, "text", parts, "name_part", "part_kind")
    assert "zyla" in names.given and {"korvath", "baker"} <= names.family
    got = {tuple(r) for r in personal_spans(df, "record", "text", names).collect()}
    assert got == {(1, "name", 12), (2, "name", 14), (3, "name", 8)}
    assert masked_texts(df, "record", "text", names).where("masked is null").count() == 1
    assert personal_spans(df.limit(0), "record", "text", names).count() == 0
    assert known_names(df.limit(0), "text", parts.limit(0), "name_part", "part_kind") == Names()


def test_more_parts_than_go_to_the_tasks(spark, monkeypatch):
    rows = [(1, "My name is Zyla Korvath and so on."), (2, "According to Zyla Korvath, yes. Ask for Mira Tolvane."), (3, "then Mira Tolvane left, zyla korvath"), (4, None), (3, "then Mira Tolvane left, zyla korvath"), (None, "Contact: Mira Tolvane, ok"), (5, "")]
    df = spark.createDataFrame(rows, "record long, text string")
    parts = spark.createDataFrame([("Baker", "family"), ("Autumn", "given")], "name_part string, part_kind string")

    def results():
        names = known_names(df, "text", parts, "name_part", "part_kind")
        return sorted(map(str, personal_spans(df, "record", "text", names).collect())), sorted(map(str, masked_texts(df, "record", "text", names).collect()))

    whole = results()
    assert sum("(3" in x or "=3" in x for x in whole[0]) == 2
    monkeypatch.setattr("termforge.llm.personal.MOST_PARTS", 1)
    assert results() == whole


ADDRESSES = ["Lange Allee 5", "Alter Ring 5", "Hoher Damm 5", "Neues Ufer 5", "Enge Gasse 5", "Lange Strasse 5", "Hohes Tor 5", "In der Aue 5", "Unter den Linden 5", "Camino Real 3", "Ronda Norte 3", "Piazza Dante 3", "Corso Garibaldi 3", "Pza. Mayor 3", "C. Mayor 3", "Viale Roma 3", "Travessa Nova 3"]
ADDRESSES += ["ulica Lipowa 5", "aleja Lipowa 5", "пр. Мира 5", "проспект Мира 5", "пер. Садовый 5", "ул. Садовая 5", "5 bd. Voltaire", "5 av. Foch"]


@pytest.mark.parametrize("text", ADDRESSES)
def test_every_address_passes_its_gate(text):
    assert found(f"so {text}") == [("address", text)]


@pytest.mark.parametrize("text", ["pasaporte AB123456", "passaporte AB123456", "passeport AB123456", "Reisepass AB123456", "NI: QQ123456A", "NINO QQ123456A", "EIN 12-3456789", "VAT 1234567890", "cédula 123456789", "dowód osobisty ABC123456"])
def test_every_label_passes_its_gate(text):
    assert [k for k, _ in found(text)] == ["id_number"]


@pytest.mark.parametrize("text", ["Best\r\nXyr Abc", "Best Xyr Abc", "Best,\nXyr Abc", "Bill to Xyr Abc, now", "Cheers Xyr Abc", "Saludos\nXyr Abc"])
def test_every_name_context_passes_its_gate(text):
    assert found(text) == [("name", "Xyr Abc")]


def test_addresses_in_words_over_lines():
    assert found("abc\nat corcene\ndot example") == [("email", "abc\nat corcene\ndot example")]
    assert found("abc\nAT\ncorcene.example") == [("email", "abc\nAT\ncorcene.example")]


def _kinds(text):
    return [(k, text[s:e]) for k, s, e in spans(text, Names())]


def test_checksums_confirm_and_reject():
    # payment cards and accounts count by their checksum alone, labelled or not
    for number in ("4111 1111 1111 1111", "5500000000000004", "3782 822463 10005"):
        assert _kinds(f"Paid with {number} today") == [("payment_card", number)]
    assert _kinds("Paid with credit card 4111 1111 1111 1112 today") == []
    assert _kinds("Send it to GB82 WEST 1234 5698 7654 32 please") == [("bank_account", "GB82 WEST 1234 5698 7654 32")]
    assert _kinds("Send it to IBAN GB82 WEST 1234 5698 7654 33 please") == []
    # identity cards without a label need the right letter; with one a wrong letter is a typing error
    assert _kinds("the number 12345678Z stands there") == [("id_number", "12345678Z")]
    assert _kinds("the number X1234567L stands there") == [("id_number", "X1234567L")]
    assert _kinds("the number 12345678A stands there") == []
    assert _kinds("my DNI 12345678A") == [("id_number", "12345678A")]
    # words that deny it outweigh a label with a wrong checksum, not one with a right checksum
    assert _kinds("order: DNI 12345678A") == [] and _kinds("order: DNI 12345678Z") == [("id_number", "12345678Z")]
    # taxpayers and persons
    assert _kinds("see 529.982.247-25 there") == [("id_number", "529.982.247-25")] and _kinds("see 529.982.247-26 there") == []
    assert _kinds("see 811218-9876 there") == [("id_number", "811218-9876")] and _kinds("see 811218-9875 there") == []


def test_a_checksum_changes_the_score():
    from termforge.llm.personal import _CONTEXT, _NUMBERS, number_score

    for form, context in zip(_NUMBERS, _CONTEXT):
        if form.check:
            right, wrong = (number_score(type(form)(form.kind, form.labels, form.number, form.shape, lambda _, x=x: x, form.wrong), "1", False, "", context) for x in (True, False))
            assert right > wrong
