import time

import pytest

from fieldproof.llm.standins import looks_like_standin, own_texts, standin_answers, standin_specs

HELD = [
    "{{station_code}}", "名称是{product_name}，数值", "x [[ FIELD_reports ]] y", "[[FIELD_date᠂", "【FIELD_place】", "[在此填写 release_status]", "${location_name}", "$[iso_code]", "%(docks)s", "%%TITLE%%", "@@taxon_key@@",
    "<%= date %>", "{% trans region %}", "__QUOTE_DATE__", "<NUMBER_OF_PAGES>", "[TODO commit]", "[insert title]", "{0}", "nilai adalah undefined, kode", "[object Object]", "#REF!", "TODO", "xxxxx xxxx xxxxxxxx", "404 Not Found",
    "Please enable JavaScript to view this value", "您访问的页面不存在或已被删除（错误代码 404）。", "LOREM IPSUM DOLOR SIT AMET", "Unfоrtunately: 502 Bаd Gаteway - nginx", "<html><head><title>Just a moment...</title></head></html>", "Placeholder text for date", "ここに本文を入力してください。",
]
FREE = [None, "", " ", "N/A", "-", "null", "Shown to the reader as the date.", "Date of the record, e.g. in [brackets] when uncertain.", "Taken from the date entry (error code 404 means the source had none).", "kode adalah 404, nilai 502", "a record about sample sizes and cookies", "x" * 100_000 + " ok"]


@pytest.mark.parametrize("text", HELD)
def test_held(text):
    assert looks_like_standin(text)


LONG = "record.station.readings.first " * 8
LONG_HELD = [f"{{{{ {LONG}| default }}}}", f"${{{LONG}:-none}}", f"{{% if {LONG}%}}", f"<%= {LONG}%>", f"[[ {LONG}]]", f"[[{LONG}[0] {LONG}]]", f"【FIELD_{LONG}】", f"[insert {LONG}here]", f"[在此填写 {LONG}]", f"[{LONG}goes here]"]


@pytest.mark.parametrize("text", LONG_HELD)
def test_long_placeholders(text):
    assert looks_like_standin(f"The name is {text} and so on.")


@pytest.mark.parametrize("mark", ["{{", "${", "{%", "<%", "[[", "[[a[1]", "【A_", "[insert ", "[insert [1]", "[在此填写", "[", "[goes here"])
def test_open_marks_stay_linear(mark):
    start = time.perf_counter()
    looks_like_standin(mark * 100_000)
    looks_like_standin(mark + "a " * 200_000)
    assert time.perf_counter() - start < 10


@pytest.mark.parametrize("text", FREE)
def test_free(text):
    assert not looks_like_standin(text)


def test_own_names():
    result = '{"title": "Error 404: A Memoir", "sub": ["lib${env}", "plain"]}'
    assert own_texts(result, None, []) == ["lib${env}"] or set(own_texts(result, None, [])) <= {"Error 404: A Memoir", "lib${env}"}
    assert own_texts(result[:-8], None, []) and own_texts(None, "About the lib${env} record", ["lib${env}", "x"]) == ["lib${env}"]
    assert not looks_like_standin("its name is lib${env}.", ["lib${env}"]) and looks_like_standin("lib${env} has {{value}}", ["lib${env}"])


def test_tables(make):
    spec = lambda value, accepted=None, description=None: ("name", "entity", value, accepted, True, False, description)
    tasks = make.tasks([
        {"id": "a", "tool_result": '{"name": "The [[Link]] Papers"}', "field_specs": [spec("The [[Link]] Papers"), spec("x", ["ok", "{{value}}"]), spec("y", None, "TODO"), spec(None), None]},
        {"id": "a", "field_specs": []}, {"id": "b", "field_specs": None}, {"id": None, "field_specs": [spec("#REF!")]},
    ])
    answers = ["name The [[Link]] Papers ok", "name The [[Link]] Papers and [[FIELD_x]]", None, "", "fine", "TODO: write answer"]
    predictions = make.predictions([{"id": "a", "answer": x} for x in answers] + [{"id": "b", "answer": "The [[Link]] Papers"}, {"id": None, "answer": "{{x}}"}])
    assert sorted(r[0] for r in standin_answers(predictions, tasks).collect()) == [1, 5, 6, 7]
    assert sorted(map(tuple, standin_specs(tasks).collect())) == [(0, 1), (0, 2), (3, 0)]
    assert standin_answers(predictions.limit(0), tasks.limit(0)).count() == 0 and standin_specs(tasks.limit(0)).count() == 0


SPEAK_OF = [  # held out: sentences about such pages, not in the tables
    "The author shows in chapter three how to enable JavaScript in old browsers for tests.",
    "A report on 502 bad gateway errors was written by the team last week.",
    "In 2019 the magazine wrote about sites whose visitors had to enable cookies before they could read anything.",
    "The error 403 forbidden means that the user who asked has no right to read what the server keeps there.",
    "Halaman itu menjelaskan cara aktifkan JavaScript pada mesin lama yang masih dipakai di banyak sekolah.",
    "The museum was under construction in 1911, and the forbidden city was closed.",
    "この本の第三章では、古い計算機でJavaScriptを有効にする歴史的な経緯と手順、そして注意点を順に詳しく説明しています。",
]
NOTICES = ["Please enable JavaScript to continue.", "502 Bad Gateway", "502 bad gateway\nnginx/1.18", "名称为Rose。请启用浏览器的脚本功能后再继续访问。", "Silakan aktifkan JavaScript di peramban Anda.", "The count is four. Error: request timed out while contacting the lookup service."]


def test_sentences_that_speak_of_errors():
    assert not [t for t in SPEAK_OF if looks_like_standin(t)]
    assert all(map(looks_like_standin, NOTICES))
    # a notice is found wherever it stands in a long text
    assert looks_like_standin("The weather is fine and the count is four. " * 200 + "Please enable JavaScript to continue. " + "The weather is fine. " * 200)
    assert not looks_like_standin(" ".join(SPEAK_OF * 30))
