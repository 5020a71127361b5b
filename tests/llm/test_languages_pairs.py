import json
import os

import pytest

from fieldproof.llm import pairs
from fieldproof.llm.answer_languages import language_segments, main_languages, mislabelled
from fieldproof.llm.languages import Identifier, fit

SENTENCES = {
    "zh": ["查询结果显示，这条天气记录的名称是甲，日期为今天，状态是正常。", "以下是图书的查询结果，其中地点为乙，数量是三。以上内容均来自工具返回的记录。"],
    "ja": ["検索結果では、この天気の名称が甲、日付は今日、状態が終了となっています。", "ツールの本記録によると、場所は乙、件数が三です。以上はツールの記録に基づく内容です。"],
    "th": ["ผลการค้นหาสภาพอากาศแสดงว่า ชื่อคือ วันที่ สถานะ ปิดแล้ว ครับ", "รายละเอียดของหนังสือมีดังนี้ สถานที่คือ จำนวน ค่ะ"],
    "bo": ["འཚོལ་བཤེར་གྱི་འབྲས་བུ་ནི་གནམ་གཤིས་འདིའི་ མིང་ནི་ ཡིན། དུས་ཚེས་ལ་ ཟེར།", "གཤམ་ནི་དཔེ་དེབ་སྐོར་གྱི་གནས་ཚུལ་ཡིན། ས་གནས་ལ་ ཟེར།"],
    "mn-Mong": ["ᠬᠠᠶᠢᠯᠲᠠ ᠶᠢᠨ ᠳᠦᠩ ᠳᠦ ᠴᠠᠭ ᠠᠭᠤᠷ ᠤᠨ ᠨᠡᠷᠡ ᠨᠢ᠃", "ᠳᠣᠣᠷᠠᠬᠢ ᠨᠢ ᠨᠣᠮ ᠤᠨ ᠮᠡᠳᠡᠭᠡ ᠪᠣᠯᠤᠨᠠ᠂ ᠭᠠᠵᠠᠷ ᠨᠢ᠃"],
    "ug": ["قورال قايتۇرغان ھاۋارايى ئۇچۇرىغا ئاساسلانغاندا، ئۇنىڭ ئىسمى، ۋاقتى بولسا، ئۇنىڭ ھالىتى ئاكتىپ.", "بۇ كىتاب خاتىرىسىدە كۆرسىتىلىشىچە، ئورنى بولسا، ئۇنىڭ سانى. بۇ خاتىرىدە باشقا تەپسىلات يوق."],
    "kk-Arab": ["بۇل اۋا رايى جازباسىنداعى ماعلۇمات: ونىڭ اتاۋى، ونىڭ كۇنى، جاعدايى بولسا راستالعان.", "تومەندە كىتاپ ناتيجەسى كورسەتىلگەن: ورنى بولسا، ونىڭ سانى. بۇل اقپاراتتىڭ بارلىعى قۇرال ناتيجەسىنەن الىندى."],
    "id": ["Menurut data cuaca dari alat ini, nama adalah satu, dengan tanggal hari ini, lokasi adalah dua.", "Catatan buku menunjukkan bahwa dengan nilai tiga, jumlah adalah empat. Tidak ada rincian lain pada catatan ini."],
    "en": ["According to the weather record returned by the tool, the name is one, its date reads today, the place is two.", "Here is the book result: its value reads three, the count is four. Codes are written exactly as they were supplied."],
}


@pytest.fixture(scope="module")
def profiles():
    return fit([(t, lang) for lang, texts in SENTENCES.items() for t in texts * 3] + [(SENTENCES["ug"][0], "kk-Arab"), (SENTENCES["en"][0], "id")])


def test_each_language(profiles):
    named = Identifier(profiles)
    for lang, texts in SENTENCES.items():
        for text in texts:
            assert list(named.languages(text)) == [lang], (lang, text)
    for a in SENTENCES:
        for b in SENTENCES:
            if a != b:
                assert set(named.languages(f"{SENTENCES[a][0]} {SENTENCES[b][1]}")) == {a, b}, (a, b)
    assert named.languages(None) == {} == named.languages("12 ABC-9 …")
    assert list(named.languages("名称是Sinonê Rose，状态是pending，编号是lib${env}。")) == ["zh"]
    assert list(named.languages("Ассоrding tо thе rесоrd".replace("А", "A"))) == ["en"]
    assert list(named.languages(SENTENCES["th"][0] * 2000)) == ["th"]


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_accuracy(spark):
    from fieldproof.llm.languages import fit_on_documents

    folder = "/root/testdata/sf0.01"
    profiles = fit_on_documents(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/language_names.parquet"), 400)
    named, right, n = Identifier(profiles), 0, 0
    # one of the two labels of a task may be wrong; where both agree, they are right
    for row in spark.read.parquet(f"{folder}/tasks.parquet").filter("user_query IS NOT NULL AND user_language = expected_answer_language").select("user_query", "user_language").collect():
        n += 1
        right += next(iter(named.languages(row["user_query"])), None) == row["user_language"]
    assert right >= 0.99 * n


def test_labels(spark, make, profiles):
    names = spark.createDataFrame([("zh", "zh"), ("zh-CN", "zh"), ("Thai", "th")], "label string, code string")
    labels = {"t1": "zh-CN", "t2": "Thai", "t3": None, "t4": "klingon", "t5": "zh"}
    tasks = make.tasks([{"id": k, "expected_answer_language": v} for k, v in labels.items()])
    zh, th = SENTENCES["zh"][0], SENTENCES["th"][0]
    rows = [("t1", zh), ("t2", zh), ("t3", zh), ("t4", th), ("t5", f"{zh}\n{th}"), ("gone", zh), ("t2", "…"), ("t2", "{{x}}" + zh), (None, zh), ("t2", None)]
    predictions = make.predictions([{"id": i, "answer": a} for i, a in rows])
    assert {tuple(r) for r in mislabelled(predictions, tasks, names, profiles).collect()} == {(1, "zh"), (2, "zh"), (3, "th"), (4, "zh"), (4, "th")}
    assert mislabelled(predictions.limit(0), tasks, names, profiles).count() == 0
    main = {r["pred_id"]: r for r in main_languages(predictions, profiles).collect()}
    assert main[3]["lang"] == "th" and main[4]["n_langs"] == 2 and 0 <= main[4]["confidence"] <= 1
    segments = language_segments(predictions.filter("pred_id = 4"), profiles).orderBy("seg").collect()
    assert {s["lang"] for s in segments} == {"zh", "th"} and all(s["start"] < s["end"] for s in segments)


REFUSALS = ["I'm sorry, but I can't help with that request.", "抱歉，我无法回答这个问题。", "ขออภัย ฉันไม่สามารถตอบคำถามนี้ได้"]


def test_defects(spark, make, profiles):
    spec = lambda p, v: (p, "entity", v, None, True, False, None)
    ask = lambda i: f"请告诉我Rose{i}的图书信息。"
    domains = ["book", "food", "weather", "holiday"]
    tasks = make.tasks([{"id": f"t{i}", "domain": domains[i % 4], "user_query": ask(i), "field_specs": [spec("name", f"Rose{i}"), spec("date", "2021-10-14"), spec("n", f"{24000 + i}"), spec("c", f"E{691253 + i}")]} for i in range(20)])

    def full(i):
        return f"以下是图书的查询结果，其中名称为Rose{i}，日期为2021年10月14日，数量为24,{i:03}，编号是E{691253 + i}，状态是正常。"

    want, rows = {}, []

    def add(i, text, defect=None):
        if defect:
            want[len(rows)] = defect
        rows.append({"id": f"t{i}" if i is not None else None, "answer": text})

    for i in range(20):
        add(i, full(i))
        add(i, full(i)[:-1])  # without its last full stop
        add(i, f"以下是图书的查询结果，其中名称为Rose{i}，数量为24,{i:03}")  # leaves out fields
        add(i, f"以下是图书的查询结果，其中名称为Rose{i}，数量为24,{i:03}。")
        add(i, f"抱歉让您久等了，{full(i)}")
        add(i, f"您问的是：“{ask(i)}”{full(i)}")
        add(i, ask(i), "copy")
        add(i, f"Q: {ask(i)[:-1]}？ {ask(i)}", "copy")
        add(i, REFUSALS[i % 3] if i % 2 else REFUSALS[i % 3].upper(), "refusal")
        add(i, full(i)[:38], "truncated")
        add(i, f"以下是图书的查询结果，其中名称为Rose{i}，数量为24,{i:03}"[:-1], "truncated")
        add(i, f"以下是图书的查询结果，其中名称为Rose{i}，数", "truncated")
        add(i, f"According to the book record returned by the tool, its name reads Rose{i}, the count is {24000 + i}.", "other_language")
        add(i, "{{name}}")
    for text in (None, "", "N/A", "…", "​ 　"):
        add(1, text, "empty")
        add(None, text, "empty")
    add(None, REFUSALS[1], "refusal")
    add(None, "以下是图书的查询")
    got = {r["pred_id"]: r["defect"] for r in pairs.defects(make.predictions(rows), tasks, profiles).collect()}
    assert got == want, [(rows[k]["answer"], got.get(k), want.get(k)) for k in sorted(set(got) | set(want)) if got.get(k) != want.get(k)][:10]
    assert pairs.defects(make.predictions(rows).limit(0), tasks, profiles).count() == 0


def test_opening_clusters(spark):
    texts = ["sorry, i cannot answer that now", "sorry, i cannot answer that now!", "the name is n, the date is n, and", "", "ab"]
    got = {r["opening"]: r["cluster"] for r in pairs.opening_clusters(spark.createDataFrame([(t,) for t in texts], "opening string")).collect()}
    assert len(got) == 5 and got[texts[0]] == got[texts[1]] and len(set(got.values())) == 4


@pytest.mark.parametrize("block", [1, 2, 500])
def test_every_pair_of_a_band(spark, monkeypatch, block):
    """Two alike openings share bands only with a smaller one that is like neither."""
    monkeypatch.setattr(pairs, "BLOCK", block, raising=False)
    texts = ["sorry, that is nht for me to say", "sorry, that isinht for me to say", "sorry, jfat is nht for me to say", "sorryg thatfis nht for me to say"]
    got = {r["opening"]: r["cluster"] for r in pairs.opening_clusters(spark.createDataFrame([(t,) for t in texts], "opening string")).collect()}
    assert got[texts[0]] == got[texts[1]] and len(set(got.values())) == 3


ROW = "pred_id bigint, task_id string, domain string, opening string, grounded boolean, declines boolean"


def test_exact_domains_and_tasks(spark):
    first, second = "that is not for me to say, ask again", "that is not for me to say, ask again!"
    three = ["book", "code_repo", "earthquake"]  # the last two have equal hashes modulo 64
    rows = [(i, f"t{i}", three[i % 3], first, False, False) for i in range(6)]
    assert [tuple(r) for r in pairs.refusal_openings(spark.createDataFrame(rows, ROW)).collect()] == [(first, True)]
    # in a cluster that recurs one answer that declines decides nothing, in a small one most answers do
    led = [(100 + i, f"v{i}", "book", first[:12] + f" which is {i}", True, False) for i in range(9)]
    assert pairs.refusal_openings(spark.createDataFrame(rows[:5] + [(9, "t9", "food", first, False, True)] + led, ROW)).count() == 0
    assert [tuple(r) for r in pairs.refusal_openings(spark.createDataFrame([(1, "t", "book", first, False, True)], ROW)).collect()] == [(first, False)]
    # three tasks with two openings each are three tasks
    rows = [(2 * i + k, f"t{i}", three[i], x, False, False) for i in range(3) for k, x in enumerate((first, second))]
    assert pairs.refusal_openings(spark.createDataFrame(rows, ROW)).count() == 0
    # no domain is no third domain
    rows = [(i, f"t{i}", ["book", "food", None][i % 3], first, False, False) for i in range(6)]
    assert pairs.refusal_openings(spark.createDataFrame(rows, ROW)).count() == 0


def test_short_refusals(spark, make, profiles):
    tasks = make.tasks([{"id": "t", "domain": "book", "user_query": "请告诉我Rose的图书信息。"}])
    answers = ["无法回答。", "お答えできません。", "名称是Rose。", "正常。"]
    got = {(r["pred_id"], r["defect"]) for r in pairs.defects(make.predictions([{"id": "t" if i != 1 else None, "answer": a} for i, a in enumerate(answers)]), tasks, profiles).collect()}
    assert got == {(0, "refusal"), (1, "refusal")}


def test_nested_and_long_endings(spark, make, profiles):
    long = "Q7 " * 80 + "Rose"
    result = json.dumps({"name": "Tovi", "date": "2020-05-18", "note": long, "station": {"owner": "Nekene", "at": [{"hour": 18, "serial": "C63-81b8e"}]}})
    tasks = make.tasks([{"id": "t", "domain": "book", "user_query": "请告诉我Tovi的图书信息。", "tool_result": result}])
    begin = "以下是图书的查询结果，其中名称为Tovi，日期为"
    answers = [f"{begin}{long}", f"{begin}Nekene", f"{begin}C63-81b8e", f"{begin}C63-81", f"{begin}Neke", f"{begin}18", *[f"{begin}2020-05-18。"] * 3]
    got = {(r["pred_id"], r["defect"]) for r in pairs.defects(make.predictions([{"id": "t", "answer": a} for a in answers]), tasks, profiles).collect()}
    assert got == {(3, "truncated"), (4, "truncated"), (5, "truncated")}  # 18 may begin the date


def test_profiles_read_whole_texts(spark):
    from fieldproof.llm.languages import fit_on_documents

    documents = spark.createDataFrame([(1, "12 " * 2000 + SENTENCES["th"][0], "th")], "doc_id bigint, text string, lang string")
    names = spark.createDataFrame([("th", "th")], "label string, code string")
    assert "th" in fit_on_documents(documents, names)


def test_unknown_languages(spark, make, profiles):
    from fieldproof.llm import answer_languages

    texts = {
        "빠른 갈색 여우가 게으른 개를 뛰어넘고 어두운 숲으로 달려갔습니다.": "und",
        "Быстрая коричневая лиса прыгает через ленивую собаку и потом бежит в тёмный лес.": "und",
        "तेज भूरी लोमड़ी आलसी कुत्ते के ऊपर कूदती है": "und",
        "12 + 3 = 15": "und", "": "und", None: "und",
        SENTENCES["th"][0]: "th", SENTENCES["ja"][0]: "ja", SENTENCES["zh"][0]: "zh",
    }
    rows = answer_languages.main_languages(make.predictions([{"id": "t", "answer": a} for a in texts]), profiles).orderBy("pred_id").collect()
    assert [r["lang"] for r in rows] == list(texts.values())
    assert all((r["confidence"] == 0.0) == (r["lang"] == "und") for r in rows)


def test_words_by_script_are_those_of_stretches(profiles):
    from fieldproof.llm.languages import Identifier, canonical_lines

    named = Identifier(profiles)
    for text in [x for many in SENTENCES.values() for x in many] + ["The name is Rose, and 名称为Rose。状態は確認済みです。\nสถานะคือ ชั่วคราว OK", "ALL CAPITALS ARE WORDS HERE, don't they?"]:
        form = canonical_lines(text)
        assert sorted((s.lang, s.confidence, s.letters) for s in named.stretches(form)) == sorted(named.spoken(form)), text
