"""Documented examples and hand-worked edge rows of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from galley.functions import codes, nodes, predicates as P, text
from galley.operators import articles as A, lines as L, references as R


def run(spark, rows, make, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, t {kind}")
    return [r["o"] for r in df.select("i", make("t").alias("o")).orderBy("i").collect()]


CASES = [
    (text.clean_text, ["Текст\n\tс\n\nпробелами", "Много    пробелов", "   Пробелы в начале и конце   ", "", None],
     ["Текст с пробелами", "Много пробелов", "Пробелы в начале и конце", "", ""]),
    (text.norm_empty, [" — ", "-", "a - b", None, "  "], ["", "", "a - b", "", ""]),
    (text.strip_invisible, ["а­б​в﻿"], ["абв"]),
    (text.norm_space, ["a  b\n"], ["a b"]),
    (codes.normalize_date, ["20.09.2022 г.", "2022/9/1", "12-05-2023", "1/2/2020", "весна"],
     ["2022-09-20", "2022-09-01", "12-05-2023", "2020-02-01", "весна"]),
    (codes.normalize_doi, ["https://doi.org/10.1 / a - b", "DOI: 10.2/x"], ["10.1/a-b", "10.2/x"]),
    (codes.extract_best_doi, ["см. 10.1234/abc.5 2-192. Далее", "10.1234/a 2024 год", "10.1234/a- 192 x", "10.1234/ab", "нет", "10.1234/s- 5 77-8, 9"],
     ["10.1234/abc.52-192", "10.1234/a", "10.1234/a-192", "10.1234/ab", "", "10.1234/s-577-8"]),
    (codes.normalize_issn, ["ISSN 1234-567x", "1234–5678", "123"], ["1234-567X", "1234-5678", ""]),
    (codes.normalize_keywords, ["a, b; c.", " ; x ,, y . .", ""], ["a; b; c", "x; y", ""]),
    (codes.split_keywords, ["Ключевые слова: а, б", "одно."], ["а; б", "одно"]),
    (codes.format_initials, ["И.С.", "A.B."], ["И. С.", "A. B."]),
    (text.normalize_search_title, ["«A» – “b” — ‘c’"], ["«A» - \"b\" - 'c'"]),
    (text.restore_missing_spaces, ["а,б цитата»1 словоСлово mRNA"], ["а, б цитата»[1] слово Слово mRNA"]),
    (text.dehyphenate, ["иссле- дования ар- конф видео- Участие", "abcd- efgh- ij"], ["исследования ар- конф видео- Участие", "abcdefgh- ij"]),
    (text.fix_intra_word_breaks, ["ко митетов Mod ern"], ["комитетов Modern"]),
    (text.detect_script, ["абв abc", "абвг abc", "12", ""], ["en", "ru", "unknown", "unknown"]),
    (text.strip_tags, ["<p>a&nbsp;<b>b</b></p> &lt;c"], ["a b <c"]),
    (text.annotation_to_text, ["a<br/>b</p><i>c</i> &amp;"], ["a\nb\nc &"]),
    (text.sanitize_annotation, ["<p>x <B class='a'>y</B> & <script>z</script><br/>\n\n w</p><br>", "a<c>b</c>"],
     ["x <b>y</b> &amp; z<br><br>w", "ab"]),
    (text.safe_key, ["10.1/a b(c)"], ["10.1_a_b_c_"]),
    (lambda c: codes.with_lang_param(c, "en"), ["http://a/b", "http://a/b?x=1&sl=ru&y=2#f", "http://a/b?x=1"],
     ["http://a/b?sl=en", "http://a/b?x=1&sl=en&y=2#f", "http://a/b?x=1&sl=en"]),
    (P.is_reference_heading, ["Список литературы:", "REFERENCES", "Литературный"], [True, True, False]),
    (P.is_reference_end, ["Информация об авторах", "Text"], [True, False]),
    (P.is_reference_start, ["[1] A", "Иванов А.Б.в 1999", "Smith J. A study 1999", "слова"], [True, True, True, False]),
    (P.is_author_line, ["Иванов И.И., Петров П.П.", "Просто строка текста"], [True, False]),
    (P.is_running_header, ["Вестник МГТУ 2025", "Вестник МГТУ 1999", "2.5.4 x"], [True, False, True]),
    (P.section_of_style, ["Заголовок 1", "Аннотация EN", "Колонтитул", "Список литературы"], ["title", "abstract_en", "body", "references"]),
    (R.estimate_reference_count, ["1. A\n2. B\nИванов 1999 — x"], [2]),
    (R.reference_key, ["x doi: 10.1234/A b", "see http://a.b/C", "Один, два!"], ["doi:10.1234/a", "url:http://a.b/c", "txt:один два"]),
    (A.parse_model_json, ['{"a":1}', 'x {"a":1} y', "none"], ['{"a":1}', '{"a":1}', None]),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_examples(spark, i):
    make, rows, want = CASES[i]
    assert run(spark, rows, make) == want


def test_idempotent(spark):
    rows = ["  a \n\t b  ", " — ", "x;  y, z.", "10.1 / a - b)."]
    for fn in (text.clean_text, text.norm_space, text.norm_empty, codes.normalize_keywords, codes.normalize_doi):
        once = run(spark, rows, fn)
        assert run(spark, once, fn) == once


def test_pages(spark):
    rows = ["4-16", "4–16", "4—16", "4", "4-16, 20-25", "16-4", "4-", "-5", "с. 4", ""]
    got = run(spark, rows, lambda c: F.concat_ws(",", codes.parse_pages(c)["min_page"], codes.parse_pages(c)["max_page"]))
    assert got == ["4,16", "4,16", "4,16", "4,4", "4,16", "4,16", "4,4", "", "", ""]
    df = spark.createDataFrame([(478, 492), (5, 5), (None, 7), (None, None)], "a int, b int")
    assert [r[0] for r in df.select(codes.format_pages("a", "b")).collect()] == ["478-492", "5", "7", ""]


def test_issue_key(spark):
    rows = ["2619-1601_2024_6", "2619-1601_2024_10_6", "0869-544X_2025_6", "bad_2024_1"]
    got = run(spark, rows, lambda c: F.to_json(codes.parse_issue_key(c)))
    assert got == [
        '{"issn":"2619-1601","year":"2024","number":"6"}',
        '{"issn":"2619-1601","year":"2024","volume":"10","number":"6"}',
        '{"issn":"0869-544X","year":"2025","number":"6"}',
        None,
    ]


def test_names_and_urls(spark):
    rows = ["Ivanov, I. I.", "Ivan Ivanov", "Plato", "Anna Maria Bell"]
    got = run(spark, rows, lambda c: F.concat_ws("|", codes.split_person_name(c)["family"], codes.split_person_name(c)["given"]))
    assert got == ["Ivanov|I. I.", "Ivanov|Ivan", "Plato|", "Bell|Anna Maria"]
    rows = ["10.1134/S2949179725040058", "10.1/x-2", "none"]
    got = run(spark, rows, lambda c: codes.doi_url_candidates(F.lit("https://g.example"), c))
    assert got == [["https://g.example/s2949179725040058-1/", "https://g.example/s2949179725040058/"], ["https://g.example/x-2/"], []]


def test_repeated_lines_example(spark):
    rows = ["Заголовок\nТекст статьи\nЗаголовок\nПродолжение\nЗаголовок"]
    assert run(spark, rows, lambda c: L.clean_document_text(c, 2)) == ["Текст статьи\nПродолжение"]
    assert run(spark, ["a1\nkeep\nb2"], lambda c: L.clean_document_text(c, 3, [r"[ab]\d"])) == ["keep"]


def test_chunk_text_whole(spark):
    rows = ["a" * 700 + "." + "b" * 900 + ". " + "c" * 50, "short", "x" * 2500]
    got = run(spark, rows, lambda c: L.chunk_text(c, 1000))
    assert [len(x) for x in got[0]] == [700, 901, 52] or "".join(got[0]).replace(" ", "") == rows[0].replace(" ", "")
    assert got[1] == ["short"] and [len(x) for x in got[2]] == [1000, 1000, 500]


def test_reference_arrays(spark):
    df = spark.createDataFrame([(["http://lead", "A", "https://doi.org/10.1/x", " ", "B", "doi: 10.2/y"],)], "r array<string>")
    assert df.select(R.merge_doi_items("r")).first()[0] == ["http://lead", "A https://doi.org/10.1/x", "B doi: 10.2/y"]
    assert run(spark, ["[1] A [2] B", "1. A\n2. B"], R.split_references) == [["A", "B"], ["A", "B"]]
    assert run(spark, ["1) A\ncont\n2) B", "x\ny"], R.numbered_references) == [["A cont", "B"], ["x", "y"]]


def test_allocate(spark):
    texts = ["Литература:\n1", "References\n1", "Литература\nReferences", "none"]
    got = run(spark, texts, lambda c: F.to_json(R.allocate_references(F.array(F.lit("r")), F.array(F.lit("e")), c)))
    assert got == ['{"RUS":["r","e"],"ENG":[]}', '{"RUS":[],"ENG":["r","e"]}', '{"RUS":["r"],"ENG":["e"]}', '{"RUS":["r","e"],"ENG":[]}']


def test_inline_tokens_and_parts(spark):
    got = run(spark, ["Mail a@b.ru and https://x.y/z end"], R.inline_tokens)[0]
    assert [(t["kind"], t["text"]) for t in got] == [("email", "a@b.ru"), ("url", "https://x.y/z")]
    got = run(spark, ["Title Abstract. Text here Keywords: a, b"], R.split_metadata_line)[0]
    assert got == ["Title", "Abstract. Text here Keywords: a, b"]


def test_paragraphs(spark):
    body = "Первая строка абзаца которая достаточно длинная\nи продолжение её со строчной буквы\n\nREFERENCES\n1. Smith J. A. Title. 1999.\ncontinued here\n2. Other entry"
    got = run(spark, [body], R.paragraphs)[0]
    assert got == [
        "Первая строка абзаца которая достаточно длинная и продолжение её со строчной буквы",
        "REFERENCES",
        "1. Smith J. A. Title. 1999. continued here",
        "2. Other entry",
    ]
    assert run(spark, ["иссле-\nдования продолжаются"], R.paragraphs)[0] == ["иссле дования продолжаются"]
    assert run(spark, ["URL:\nhttp://a.b/c"], R.paragraphs)[0][0].startswith("URL:")


def test_nodes(spark):
    html = "<html><body><h2>Abstract:</h2><p>One</p><p>Two <b>x</b></p><h3>Other</h3><p>Three</p></body></html>"
    df = spark.createDataFrame([(0, html), (1, "<div id=a><br><i>q</div></p>tail")], "i int, t string")
    df = nodes.with_headings(nodes.with_nodes(df, "t")).orderBy("i")
    got = df.select(nodes.section_text(["abstract"]).alias("s"), F.size("nodes").alias("k")).collect()
    assert got[0]["s"] == "One Two x" and got[1]["k"] == 3


def test_entities_are_those_of_the_standard(spark):
    import html
    import random

    rng = random.Random(4)
    bits = ["&", "amp", "amp;", "#", "#x", "41", ";", "lt", "gt;", "notit;", "not", "&#0;", "&#128;", "&#x110000;", "&#xD800;", "&#65279;", "&#xFDD0;", "&#x1F600;", "&#99999999999;", " ", "x",
            "&nbsp;", "&eacute", "&NotEqualTilde;", "&zwnj;", "Ж", "&copy2", "&#x;", "&#;", "&a", "&#13;", "&#x80", "&#1;", "&#0000065;"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(3000)] + bits + ["", "no entity", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.o for r in df.select("i", text.decode_entities("t").alias("o")).collect()}
    wrong = [(t, got[i], html.unescape(t)) for i, t in enumerate(texts) if t is not None and got[i] != html.unescape(t)]
    assert not wrong and got[len(texts) - 1] is None, wrong[:5]


def test_line_predicates_have_no_python(spark):
    from galley.functions import predicates as P

    df = spark.createDataFrame([("x",)], "t string")
    checks = [P.is_reference_heading, P.is_reference_end, P.is_running_header, P.list_kind]
    for check in checks:
        try:
            out = df.select(check("t"))
        except TypeError:
            out = df.select(check("t", "t"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "ArrowEval" not in plan
