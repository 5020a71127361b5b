"""Stand-in text in place of content (problem 2).

A multi-pattern automaton looks for phrases of error pages, filler text and notices that scripts
or cookies are needed, in the nine languages of the data; patterns look for unfilled placeholders.
A text is excluded when, in one of its sentences that holds a strong phrase, the phrases cover a
high share of the letters (the rest being the usual words of such notices, which are phrases too),
or when weaker phrases cover most of the whole text. A sentence that only speaks of such a page
has other words and stays. A placeholder excludes whatever stands around it. What a record calls
itself is taken out of the text first, so a book called like an error page stays.

Defined cases: null, blank and no-value words are no stand-ins (they are empty, not filled wrongly).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from fieldproof.functions.jsontext import UNREADABLE, leaves, read_json
from fieldproof.llm.canon import canonical, fold_form, folded

# Phrases that are never content, in folded form.
STRONG_PHRASES = """
404 not found
page you requested could not be located
page not found on this server
could not be located on this server
403 forbidden
401 unauthorized
500 internal server error
internal server error
502 bad gateway
bad gateway - nginx
503 service unavailable
504 gateway timeout
service temporarily unavailable
service unavailable, please try again
access denied. you do not have permission
you do not have permission to view
upstream request timeout
request timed out while
too many requests - rate limit
rate limit exceeded
your session has expired
sign in again to see
this page is under construction
page is under maintenance
check back soon!
error: could not load
could not load the page
checking your browser before
<title>just a moment
verify you are human
complete the captcha
enable javascript
javascript is disabled
javascript is required
requires javascript
requires scripts to be turned on
need to allow scripts
allow scripts and cookies
enable cookies
cookies are disabled
turn on javascript
lorem ipsum dolor
consectetur adipiscing elit
sample text. replace this
replace this paragraph with your own
insert the final answer here
insert your text here
your text here
text goes here
content goes here
goes here]
placeholder text for
todo: write answer
todo: write
todo: fill
todo: add
tbd: describe
tbd: write
tbd: fill
[object object]
页面不存在或已被删除
错误代码 404
服务器内部错误
系统繁忙,请求超时
请求超时,请刷新
请启用浏览器的脚本
请启用脚本
启用 javascript
此处填写答案
在此填写
请在此输入
お探しのページは見つかりません
ページが見つかりません
スクリプトを有効に
javascriptを有効に
ただいまメンテナンス中
サーバーエラーが発生
ここに本文を入力
ここに回答を入力
ไม่พบหน้าที่คุณต้องการ
ระบบขัดข้องชั่วคราว
เปิดใช้งานจาวาสคริปต์
เปิดใช้งาน javascript
halaman yang anda cari tidak ditemukan
terjadi kesalahan pada server
aktifkan javascript
isi jawaban di sini
tulis jawaban di sini
ཤོག་ངོས་འདི་རྙེད་མ་སོང
ཞབས་ཞུ་ཆས་ལ་ནོར་འཁྲུལ
سىز ئىزدىگەن بەت تېپىلمىدى
تور كۆرگۈچتە javascript
javascript نى قوزغىتىڭ
سىز ىزدەگەن بەت تابىلمادى
ءۇشىن javascript قوسىڭىز
ᠬᠠᠭᠤᠳᠠᠰᠤ ᠣᠯᠳᠠᠭᠰᠠᠨ ᠦᠭᠡᠢ
"""
# Phrases that are stand-ins only where they make up most of the text.
WEAK_PHRASES = """
todo
fixme
lorem ipsum
placeholder
sample text
not found
page not found
under construction
under maintenance
just a moment
javascript
access denied
forbidden
bad gateway
service unavailable
session has expired
#ref!
#value!
#n/a
#name?
#div/0!
undefined
nan
object object
未找到页面
页面不存在
示例文本
维护中
サンプルテキスト
準備中です
工事中
ไม่พบหน้า
ข้อความตัวอย่าง
halaman tidak ditemukan
teks contoh
sedang dalam perbaikan
"""
# The usual words around such phrases, which count only beside a strong one.
CONTEXT_PHRASES = """
please
error
http
to continue
to continue using
using this application
to view this
to see this
this value
the result can be shown
in your browser
your browser
this site
try again
again later
retry after
while contacting
contacting the
lookup service
the page
on this server
<html><head><title>
</title></head><body></body></html>
请
刷新页面
后重试
稍后再试
后再继续访问
ください
ご利用には
もう一度
กรุณา
ลองใหม่ภายหลัง
ในเบราว์เซอร์ของคุณ
silakan
coba lagi
di peramban anda
untuk melanjutkan
"""
# Shapes of unfilled or failed placeholders, in canonical form (case kept), of any length.
# What is between the marks is taken possessively and ends at the next mark, so a search stays linear.
NAME = r"[A-Za-z][\w.\[\]]*"
PLACEHOLDERS = re.compile(
    r"\{\{[^{}\n]*+\}\}"
    r"|\$\{[^{}\n]*+\}"
    r"|\$\[" + NAME + r"\]"
    r"|\{%[^%\n]++%\}"
    r"|<%[^%\n]++%>"
    r"|\[\[[^\[\]\n]*+(?:\[\d+\][^\[\]\n]*+)*+\]\]"
    r"|【[A-Z]+_(?!】)[^【】\n]*+(?:【(?![A-Z]+_)[^【】\n]*+)*+】"
    r"|__[A-Z][A-Z0-9_.\[\]]*__"
    r"|%%" + NAME + r"%%"
    r"|%\(" + NAME + r"\)s"
    r"|<[A-Z][A-Z0-9_]*(?:\[\d+\])?(?:\.[A-Z0-9_]+(?:\[\d+\])?)*>"
    r"|\{" + NAME + r"\}|\{\d*\}"
    r"|\[(?i:insert|isi|todo|tbd|fill in|enter|add|your|put|masukkan|describe|在此填写|请填写|填写|此处填写|ここに)\b[^\[\]\n]*+(?:\[\d+\][^\[\]\n]*+)*+\]"
    r"|\[在此填写[^\[\]\n]*+(?:\[(?!在此填写)[^\[\]\n]*+)*+\]"
    r"|\[[a-z0-9]+(?:_[a-z0-9]+)+\]"
    r"|\[[^\[\]\n]*+(?<=goes here)\]"
    r"|\[object Object\]|#REF!|#VALUE!|#NAME\?|#DIV/0!"
    r"|\[\[[A-Za-z]+_[\w.]+|@@" + NAME + r"@@"
    r"|(?<![A-Za-z])(?:undefined|NaN)(?![A-Za-z])"
)
FILLER = re.compile(r"^\W*x{2,}(?:[\W_]+x{2,})+\W*$|^\W*x{5,}\W*$|\b(?:x{3,}[ .,]+){2,}x{2,}")
# marks of which every placeholder holds one: texts without are not searched
HINTS = ("{", "[", "<", "%", "#", "$", "【", "__", "@@", "undefined", "NaN")
COVERAGE = 0.5  # of the letters of a text, by strong and weak phrases
SENTENCE_COVERAGE = 0.4  # of the letters of a sentence that holds a strong phrase, by all phrases
STRONG, WEAK, CONTEXT = 2, 1, 0
SENTENCE = re.compile(r"[.!?]+(?=\s|$)|[\n\u3002\u061f\u0f0d\u1803]")


@lru_cache(maxsize=1)
def automaton():
    """The phrase automaton; values are (length, kind)."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for phrases, kind in ((CONTEXT_PHRASES, CONTEXT), (WEAK_PHRASES, WEAK), (STRONG_PHRASES, STRONG)):
        for phrase in filter(None, map(folded, phrases.split("\n"))):
            machine.add_word(phrase, (len(phrase), kind))
    machine.make_automaton()
    return machine


def looks_like_standin(text: str | None, own: Iterable[str] = ()) -> bool:
    """Whether a text is or contains stand-in text, once what the record calls itself is taken out."""
    if not text:
        return False
    form = canonical(text)
    return holds_standin(form, fold_form(form), own)


def holds_placeholder(form: str) -> bool:
    """Whether a text in canonical form holds an unfilled or failed placeholder."""
    return any(x in form for x in HINTS) and PLACEHOLDERS.search(form) is not None


def holds_standin(form: str, low: str, own: Iterable[str] = ()) -> bool:
    """looks_like_standin() of a text given in canonical and in folded form."""
    for name in own:
        form = re.sub(re.escape(canonical(name)), " ", form, flags=re.IGNORECASE)
        low = low.replace(folded(name), " ")
    if holds_placeholder(form) or "xx" in low and FILLER.search(low):
        return True
    hits = [(end + 1 - length, end + 1, kind) for end, (length, kind) in automaton().iter(low)]
    # weaker phrases are whole words
    hits = [h for h in hits if h[2] == STRONG or not (low[h[1] : h[1] + 1].isalnum() and low[h[1] - 1].isalnum() or low[h[0]].isalnum() and h[0] and low[h[0] - 1].isalnum()) or low[h[0]] > "\u0e00"]
    if not any(kind > CONTEXT for _, _, kind in hits):
        return False
    if covers([h for h in hits if h[2] > CONTEXT], low, 0, len(low), COVERAGE):
        return True
    begin = 0
    for end in [*(m.end() for m in SENTENCE.finditer(low)), len(low)] if any(kind == STRONG for _, _, kind in hits) else ():
        inside = [h for h in hits if h[0] < end and h[1] > begin]
        if any(kind == STRONG for _, _, kind in inside) and covers(inside, low, begin, end, SENTENCE_COVERAGE):
            return True
        begin = end
    return False


def covers(hits: list[tuple[int, int, int]], text: str, begin: int, end: int, share: float) -> bool:
    """Whether hits cover a share of the letters and digits between two places of a text."""
    letters = sum(map(str.isalnum, text[begin:end]))
    covered, upto = 0, begin
    for a, b, _ in sorted(hits):
        covered += sum(map(str.isalnum, text[max(a, upto) : min(b, end)]))
        upto = max(upto, b)
    return covered > 0 and covered >= share * letters


LITERAL = re.compile(r'"((?:[^"\\]|\\.)*)(?:"|$)')


def own_texts(tool_result: str | None, user_query: str | None, values: Iterable[str | None]) -> list[str]:
    """The record's own strings that read like stand-ins: in its result, or named in the query.

    From a result that can't be read, whole string literals are taken. Where the query names
    a specified value, that value is the record's own as well.
    """
    strings: list[str] = []
    value = read_json(tool_result)
    if value is not UNREADABLE:
        strings = [x for _, x in leaves(value) if isinstance(x, str)]
    elif tool_result:
        for literal in LITERAL.findall(tool_result):
            try:
                strings.append(json.loads(f'"{literal}"'))
            except ValueError:
                pass
    query = folded(user_query) if user_query else ""
    strings += [x for x in values if x and len(x) > 2 and folded(x) in query] if query else []
    distinct = list(dict.fromkeys(strings))
    # one look at all strings together tells most records apart from the few that need more
    if not looks_like_part("\n".join(distinct)):
        return []
    return sorted((x for x in distinct if looks_like_part(x)), key=len, reverse=True)


def looks_like_part(text: str) -> bool:
    """Whether any pattern or phrase, weak ones too, is found anywhere."""
    form = canonical(text)
    return holds_placeholder(form) or any(kind > CONTEXT for _, (_, kind) in automaton().iter(fold_form(form)))


def task_own_texts(tasks: DataFrame) -> DataFrame:
    """(task_id, own) of the few tasks that have such strings, one row per id.

    Repeated deliveries of a task are united; the array holds distinct strings of one record.
    """
    picked = tasks.filter(F.col("id").isNotNull()).select(
        F.col("id").alias("task_id"), "tool_result", "user_query", F.transform("field_specs", lambda s: s["value"]).alias("values")
    )

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [own_texts(t, q, v if v is not None else ()) for t, q, v in zip(b["tool_result"], b["user_query"], b["values"])]
            if any(found):
                yield pd.DataFrame({"task_id": [i for i, x in zip(b["task_id"], found) if x], "own": [x for x in found if x]})

    rows = picked.mapInPandas(own, "task_id string, own array<string>")
    return rows.groupBy("task_id").agg(F.array_distinct(F.flatten(F.collect_set("own"))).alias("own"))


@F.pandas_udf(T.BooleanType())
def standin_udf(text: pd.Series) -> pd.Series:
    """Whether each text is or holds stand-in text, without regard to the record's own strings."""
    seen: dict = {}
    return pd.Series([seen[x] if x in seen else seen.setdefault(x, looks_like_standin(x)) for x in text])


@F.pandas_udf(T.BooleanType())
def standin_own_udf(text: pd.Series, own: pd.Series) -> pd.Series:
    """As standin_udf, with each record's own strings taken out first."""
    return pd.Series([looks_like_standin(t, sorted(o, key=len, reverse=True) if o is not None else ()) for t, o in zip(text, own)])


def task_key() -> F.Column:
    """The task of a prediction: `id`, or `sample_id` where `id` is null or empty."""
    return F.coalesce(F.nullif(F.col("id"), F.lit("")), F.col("sample_id"))


def standin_answers(predictions: DataFrame, tasks: DataFrame) -> DataFrame:
    """(pred_id) of the answers that are stand-ins.

    The automaton runs in the scan of the predictions; only its hits are joined, with the few tasks
    that have own strings of such a look, and looked at again.
    """
    hits = predictions.filter(F.col("answer").isNotNull()).select("pred_id", task_key().alias("task_id"), "answer").filter(standin_udf("answer"))
    joined = hits.join(task_own_texts(tasks), "task_id", "left")
    return joined.filter(F.col("own").isNull() | standin_own_udf("answer", "own")).select("pred_id")


def standin_specs(tasks: DataFrame) -> DataFrame:
    """(line_no, pos) of the elements of field_specs with a stand-in value, description or variant."""
    picked = tasks.filter(F.size("field_specs") > 0).select(
        "line_no",
        "tool_result",
        "user_query",
        F.transform("field_specs", lambda s: s["value"]).alias("values"),
        F.transform("field_specs", lambda s: F.filter(F.concat(F.array(s["value"], s["description"]), F.coalesce(s["accepted_values"], F.array().cast("array<string>"))), lambda x: x.isNotNull())).alias("texts"),
    )

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, bool] = {}
        for b in batches:
            lines, places = [], []
            for line, result, query, values, texts in zip(b["line_no"], b["tool_result"], b["user_query"], b["values"], b["texts"]):
                own = None
                for pos, element in enumerate(texts):
                    suspects = []
                    for x in element if element is not None else ():
                        if x not in seen:
                            if len(seen) > 200_000:
                                seen.clear()
                            seen[x] = looks_like_standin(x)
                        if seen[x]:
                            suspects.append(x)
                    if suspects:
                        own = own_texts(result, query, values) if own is None else own
                        if any(looks_like_standin(x, own) for x in suspects) if own else True:
                            lines.append(line)
                            places.append(pos)
            if lines:
                yield pd.DataFrame({"line_no": lines, "pos": places})

    return picked.mapInPandas(look, "line_no bigint, pos bigint")
