import json

import pytest

from fieldproof.llm.stuffed import is_stuffed, stuffed_pages

STUFFED = {
    "keywords": "repository | paper | country | repository | paper | paper | country | repository | code | paper",
    "lines": "\n".join(["earthquake", "repository", "date", "repository", "earthquake", "date"] * 4),
    "phrases": " • ".join(f"weather near {n}" for n in ("Dárovama", "Fämime", "Miverofa", "Rebotibe", "Selatipa", "Násamo")),
    "near": "\n".join(f"air quality - {n}" for n in ("Harbor", "Tizageke", "Lafasira", "Nectar", "Willow", "Nolupata")),
    "urls": "\n".join(f"https://inlet-lattice.example/jetty/{i}" for i in range(9)),
    "anchors": "\n".join(f'<a href="https://nectar.invalid/{i}">Bomobe Rama</a>' for i in range(9)),
    "marked": "\n".join(f"[gantry パッケージ](https://quarry.test/{i})" for i in range(9)),
    "labelled": "\n".join(f"species >> https://quarry.test/{i}" for i in range(9)),
    "tags": "#api key #2025 #near me #best #live #Tundra #FlintKiln #Jetty #live #live",
    "brackets": "[review] [Willow] [cheap] [download] [VeneerFathom] [ShoalAlder] [buy] [price] [online]",
    "offers": "\n".join(f"discount place {n} | E75-e888a | 30% off | buy now | book" for n in ("Mama", "Someza", "Fare", "Kisonè")),
    "mixed": "best clinical trial! best clinical trial, clinical trial discount, best clinical trial! discount clinical trial! clinical trial download",
}
SENTENCE = "The evaluator must preserve the country name value after the review of 2018-01-25. "
KEPT = {
    "prose": SENTENCE * 4,
    "references": SENTENCE * 5 + "\n\nFurther reading:\n- https://knoll.test/a\n- https://shoal.example/b\n- https://alder.test/c",
    "fields": "\n".join(f"- {n}: the annotator keeps this value, as the source gives it." for n in ("title", "doi", "as_of", "rate")),
    "release": "Version 4.11.6 (2016-09-09)\n" + "\n".join(f"* Since 2020-10-21, the wrapper for {n} copies a date such as 2020-10-21." for n in "abcd"),
    "explained": "\n".join(f"https://pylon.example/{i} - This answer drops its region and keeps the code while the unit changes." for i in range(6)),
    "thai": "ตามข้อมูลประเทศที่เครื่องมือส่งกลับมา ชื่อคือ Popa จำนวน 134,908 ค่า 383.7 สถานะคือ ชั่วคราว วันที่ 27/3/2562 ครับ",
    "answer": "名称为Máti，数值是201.0，数量为72,660，状态为已确认，编号是QB40，日期是2022年9月29日。",
    "json": json.dumps({"a": [1, 2, {"b": "c"}], "tags": ["x"] * 30}),
    "word": "weather",
    "empty": "",
    "blank": " \n ",
}


@pytest.mark.parametrize("name", STUFFED)
def test_stuffed(name):
    assert is_stuffed(STUFFED[name])
    assert is_stuffed(SENTENCE + "\n" + STUFFED[name] * (3 if name not in ("lines", "urls") else 1)) or len(STUFFED[name]) < len(SENTENCE) * 2
    assert is_stuffed((STUFFED[name] + "\n") * 300)


@pytest.mark.parametrize("name", KEPT)
def test_kept(name):
    assert not is_stuffed(KEPT[name])


PUNCTUATED = {
    "stops": "free weather, weather online! live weather. weather near me! weather online, live weather! free weather. weather 2025, weather near me. weather live! ",
    "unseparated": "review 统计指标 online 统计指标. 统计指标 live, api key 统计指标! 统计指标 online 统计指标 2025. live 统计指标! 统计指标 review. near me 统计指标! ",
    "two": "free weather! book online. weather online! free book. book live! weather live. book online! free weather, weather online. free book. ",
    "lines": "\n".join(f"{a} weather {b}!" for a in ("live", "free", "near") for b in ("online", "station", "2025", "review")),
    "many": " ".join(f"weather {w}{stop}" for w in "abode birch cedar delta ember fjord grove heath inlet jetty knoll lemma".split() for stop in ".!.,!.!.!,"),
}
PROSE = {
    "answers": "ᠳᠣᠣᠷᠠᠬᠢ ᠨᠢ ᠨᠣᠮ ᠤᠨ ᠮᠡᠳᠡᠭᠡ ᠪᠣᠯᠤᠨᠠ᠂ ᠨᠡᠷᠡ ᠨᠢ Leriniza᠂ ᠲᠣᠭᠠ ᠨᠢ 239941᠂ ᠭᠠᠵᠠᠷ ᠨᠢ Kale᠂ ᠺᠣᠳ ᠨᠢ M33-142fa᠂ ᠪᠠᠶᠢᠳᠠᠯ ᠨᠢ ᠬᠠᠭᠠᠭᠰᠠᠨ᠂ ᠤᠲᠭᠠ ᠨᠢ 279.9᠃ ᠪᠤᠰᠤᠳ ᠮᠡᠳᠡᠭᠡ ᠦᠭᠡᠢ᠃",
    "short": "The name is Rose. The date is today. Its place reads Harbor. The count is four. Its value reads three. The status is active.",
    "values": " ".join(f"The name is {n}, the date is 2021-0{i}-14, the code is A{i}-86{i}, the value is 4{i}.8, the count is 18{i}55." for i, n in enumerate(("Rose", "Kale", "Pavi"), 1)),
    "repeated": "The name of the record is kept, and its date is copied by the reviewer. " * 6,
}


@pytest.mark.parametrize("name", PUNCTUATED)
def test_punctuated_keywords(name):
    assert is_stuffed(PUNCTUATED[name])
    assert is_stuffed(SENTENCE + "\n" + PUNCTUATED[name])


@pytest.mark.parametrize("name", PROSE)
def test_prose_of_short_clauses(name):
    assert not is_stuffed(PROSE[name])


def test_pages(spark):
    rows = [*enumerate([*STUFFED.values(), *KEPT.values(), None, STUFFED["tags"]])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, key string")
    assert sorted(r["doc_id"] for r in stuffed_pages(df, "doc_id", "text").collect()) == [*range(len(STUFFED)), len(rows) - 1]
    assert stuffed_pages(df.limit(0), "doc_id", "text").count() == 0


def test_links_and_brackets_of_any_length():
    for n in (10, 190, 450, 5000):
        assert is_stuffed("\n".join(f'<a href="https://nectar.invalid/{"x" * n}{i}">Bomobe {"Rama " * (n // 5)}</a>' for i in range(9)))
        assert is_stuffed(" ".join(f"[{'tag ' * (n // 4)}{i}]" for i in range(9)))
        assert is_stuffed("\n".join(f"[gantry {'x' * n}](https://quarry.test/{i})" for i in range(9)))
    assert not is_stuffed(SENTENCE * 3 + "<a " * 20_000)
