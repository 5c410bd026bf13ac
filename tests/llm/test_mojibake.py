import pytest

from codeweft.llm.mojibake import Pairs, learn_pairs, repair, repair_column

RIGHT = [
    "São 4264 entradas. ATENÇÃO: NÃO APAGUE A POSIÇÃO ANTES DA VERSÃO.",
    "SÃO 3 SEÇÕES: À, Â, Ã e Õ também contam.",
    "Für ältere Speicher gilt: Größe „Übersicht“ löschen.",
    "L’arête n’est relue qu’après l’appel — déjà traitée, zéro perdue.",
    "Proszę zwiększyć gałąź do 12, później usunąć krawędź. Żadna źle.",
    "После изменения проверка занимает 2847 мс вместо 167.",
    "変更後、索引の処理は3ミリ秒になりました。",
    "│ ok │ 3185 │\n├────┼────┤\n│ no │ 3336 │",
    "Temperature: 7 °C ± 2 °C, cost ≤ 12 µs × 15 → fine ✓ £ 20, ¥ 300",
    "Înălțime și lățime; ČŠŽ; Ørsted-like Ø names; ß & ẞ",
    "as Latin text gives 'Ã±', which the caller must detect.",
    "once turned “é” into `Ã©`; refused since",
    "escaped as \\u00e9 and %C3%A9, both on purpose",
    "caf&eacute; &amp; more &lt;b&gt;",
]


@pytest.mark.parametrize("text", RIGHT)
def test_right_text_is_left_alone(text):
    assert repair(text) == (text, [])


@pytest.mark.parametrize("text", RIGHT[2:6])
@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850"])
def test_utf8_read_as_single_byte(text, codec):
    try:
        garbled = text.encode().decode(codec)
    except UnicodeDecodeError:
        garbled = "".join(bytes([b]).decode(codec) if bytes([b]).decode(codec, "ignore") else chr(b) for b in text.encode())
    fixed, how = repair(garbled)
    assert how and fixed == text


def test_twice_escaped_and_lost():
    text = "naïve cache vs. the café demo – “done”"
    twice = text.encode().decode("latin-1").encode().decode("latin-1")
    assert repair(twice)[0] == text
    import html

    escaped = text.encode().decode("latin-1").encode("ascii", "xmlcharrefreplace").decode()
    assert repair(escaped)[0] == html.unescape(text)
    assert repair("L�a requ�te")[1] == ["lost"]
    assert repair("変更後、索引の処理です。".encode("euc_jp").decode("latin-1"))[0] == "変更後、索引の処理です。"


def test_only_the_garbled_part_changes():
    fixed, how = repair("Cost: â‰¤ 12 Âµs.\nÀ noite a ligação é refeita.")
    assert how and fixed == "Cost: ≤ 12 µs.\nÀ noite a ligação é refeita."


def test_operator(spark):
    bad = "FÃ¼r Ã¤ltere Speicher"
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, bad, 1), (3, bad, 1), (4, "für", 1), (5, "x " * 100000 + bad, 1)], "doc_id long, text string, moves int")
    out = repair_column(df, "doc_id", "text").collect()
    assert sorted(r.doc_id for r in out) == [3, 3, 5]
    assert repair_column(df.where("false"), "doc_id", "text").count() == 0


def test_lost_bytes_and_exchanged_readings():
    assert repair("the “upper tableâ€ case — sized at 6 Âµs.")[0] == "the “upper table” case — sized at 6 µs."
    text = "После изменения проверка занимает больше времени, чем раньше."
    learnt = Pairs({a + b: 500 for a, b in zip(text, text[1:])}, 1000)
    for wrote, read in (("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866")):
        assert repair(text.encode(wrote).decode(read), learnt)[0] == text
    three = "für ältere Größe"
    for _ in range(3):
        three = three.encode().decode("latin-1")
    assert repair(three)[0] == "für ältere Größe"


def test_long_garbled_line_ends():
    """The search ends by itself, also where nothing can be regained."""
    assert repair("Ð\x9d�‘Æ’ " * 200)[1][-1] == "lost"
    assert repair("".join(chr(0x80 + i % 0x40) for i in range(4000)))[0] is not None


def test_pairs_are_learnt(spark):
    docs = [(i, "für ältere Größe") for i in range(99)] + [(99, "fÃ¼r"), (100, None), (101, "plain")]
    pairs = learn_pairs(spark.createDataFrame(docs, "doc_id long, text string"), "text")
    assert pairs.cost("für Größe") == 0 < pairs.cost("fÃ¼r") < pairs.cost("fÅr Grîøe")
    assert learn_pairs(spark.createDataFrame([], "doc_id long, text string"), "text").cost("fÅr") == 0
