import pytest

from energraph.llm.sentences import sentences

SCHEMA = "doc_id long, text string, key string, body string, parts string, part string"

CASES = [
    "Mr. and Mrs. Lee met Dr. Oh at 7 p.m. on the pier.|It rose 3.5% in Jan. alone.|See fig. 9 and vol. 2, pp. 3-4.",
    "The office closed at 7 p.m.|The bell rang.|J. R. Lee sold it to Oh & Co. in 1940.|The U.S. team won.",
    'He wrote, "We left at dawn. The river was low."|"Where does it end?" asked Lee, and left.|Did she say, "Burn it all!"?|Yes.',
    "The plan (the council called it mad!) was kept.|(The note was added later.)|Oh... well, he paid.|The rest is lost…|eLedger was its name.",
    "Es waren 2.653 Einwohner, v. a. Fischer.|Im 19. Jahrhundert war es z. B. ruhig.|Lee sagte: „Wir warten. Der Fluss steigt.“|Das Archiv enthält Karten usw.|Ende.",
    "« Où va la route ? » demanda Lee.|M. Oh et Mme Li ont signé le bail, etc.|Au t. 6, chap. 9, il parle…|J.-P. Li vint.",
    "«¡Basta ya!», gritó Lee.|¿Quién guarda la llave?|Véase la pág. 3 del vol. 4.|El Sr. Oh firmó.",
    "В 1837 г. Нило приехал.|Он описал озеро в 1840 г.|«Куда ведёт дорога?» — спросил Нини.|См. рис. 9 и табл. 2.|Там карты и т. д.|Конец.",
    "«Ποιος κρατά το κλειδί;» ρώτησε ο Λι.|Πού τελειώνει;|Η λίμνη πάγωσε, π.χ. το 1839.",
    "风山问：“你去哪儿？河水涨了！”|村里有学校。|“走吧。”松白说。|谁拿着钥匙？",
    "「もう遅い。」リロはそう言った。|「行こう！」|湖は凍っていた……|「道は？」とサカは尋ねた。|終わり。",
    '"길은 어디로 이어지는가?" 리도가 물었다.|다리는 23.2m이다.|그는 "기다리자. 강물이 불어난다."라고 썼다.',
    '"चाबी किसके पास है?" लोमी ने पूछा।|डॉ. पारा ने 3.8 मीटर नापा।|कितनी सर्दी थी!',
    "كتب د. نورا عن ص. 69.|«من يحمل المفتاح؟» سأل رامي.|أين الطريق؟",
    "لي نے کہا: ”ہم رکیں گے۔ دریا چڑھ رہا ہے۔“|راستہ کہاں ہے؟",
    "หอสมุดเก็บแผนที่ จดหมาย ฯลฯ|สะพานยาว 9.9 เมตร|น้ำท่วมใน พ.ศ. 2010|ดร.โนเขียน",
]


def cut(spark, texts):
    df = spark.createDataFrame([(i, t, "k", "b", "p", "q") for i, t in enumerate(texts)], SCHEMA)
    out = {i: [] for i in range(len(texts))}
    for r in sentences(df).orderBy("key", "sentence_no").collect():
        assert texts[r.key][r.start_at : r.end_at] == r.sentence == r.sentence.strip()
        out[r.key].append(r.sentence)
    return [out[i] for i in range(len(texts))]


def test_languages(spark):
    joiners = ["" if any(c in case for c in "。……") and "你" not in case[:0] and ord(case[0]) > 0x3000 and "길" not in case and '"' not in case[:1] else " " for case in CASES]
    got = cut(spark, [j.join(c.split("|")) for c, j in zip(CASES, joiners)])
    for case, parts in zip(CASES, got):
        assert parts == case.split("|")


def test_layout(spark):
    wrapped = "The walk from here to the old mill takes 47 minutes in dry weather and\nlonger in the rain. It ends at no.\n72. Then home."
    listing = "## A Heading\n\n1. First item\n2. Second item.\n- third, 3.5 m\n— Fourth?\n\nQ1: Who is it?\nA1: approx. 9.6\nSo it is."
    report = "run no. 15, seed 99\nhops used: 8\nS@9 = 0.8 (web)\n\nText here. More"
    hyphens = "The botanist desc-\nribed a pale or-\nchid.\n\nТам письма и т. д.\n- Название"
    assert cut(spark, [hyphens])[0] == ["The botanist desc-\nribed a pale or-\nchid.", "Там письма и т. д.", "- Название"]
    got = cut(spark, [wrapped, listing, report, None, "", " \n\t ", "\U0001f600 Hi \U0001f600. Then \U0001f4a5!", "x", " odd. Text."])
    assert got[0] == [wrapped.split(". It")[0] + ".", "It ends at no.\n72.", "Then home."]
    assert got[1] == ["## A Heading", "1. First item", "2. Second item.", "- third, 3.5 m", "— Fourth?", "Q1: Who is it?", "A1: approx. 9.6", "So it is."]
    assert got[2] == ["run no. 15, seed 99", "hops used: 8", "S@9 = 0.8 (web)", "Text here.", "More"]
    assert got[3] == got[4] == got[5] == [] and got[6] == ["\U0001f600 Hi \U0001f600.", "Then \U0001f4a5!"] and got[7] == ["x"] and len(got[8]) == 2


@pytest.mark.parametrize("n", [20_000])
def test_long_text(spark, n):
    got = cut(spark, ["This is one sentence. " * n])[0]
    assert len(got) == n and set(got) == {"This is one sentence."}


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "One. Two.", "", "", "", "")] * 2, SCHEMA)
    assert sentences(df).distinct().count() == 2 and sentences(df.limit(0)).count() == 0
