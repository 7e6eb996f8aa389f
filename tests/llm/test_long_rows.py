"""Rows that are long in themselves, files that are listed twice, columns with the operators' own names."""

import re
import time

import pytest

from tidewater.llm import dedup, mixing, pii, urlfilter
from tidewater.llm.common import numbered

SPAN = re.compile(r"[a-z0-9]+@a\.de|10\.0\.0\.[0-9]+")


def dense(n):
    return " ".join(f"u{i}@a.de é\U0001f600 10.0.0.{i % 250} mail" for i in range(n))


def test_spans_of_a_dense_text(spark):
    """More matches than are summed up together, with characters beyond the basic plane between them; time grows with the text."""
    seconds = {}
    for n in (10, 4000, 16_000):
        text = dense(n)
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        found = pii.find_personal_data(df).collect()[0].found
        seconds[n] = time.time() - began
        assert [(x.start, x.end) for x in found if x.kind in ("email", "ip")] == [m.span() for m in SPAN.finditer(text)]
        # the word behind each address is context for the one before it, and for the email after it
        assert all(x.score == pytest.approx(1.0) for x in found if x.kind == "email")
    assert seconds[16_000] < 3 * 4 * max(1.0, seconds[4000] - seconds[10]) + seconds[10] + 5


def test_hosts_of_many_labels(spark):
    urls = ["http://" + "a." * 50_000 + "example.net/en/x", "http://" + "." * 50_000 + "/", "http://net/", "http:///", "x://" + "b" * 200_000 + ".org/fr/", "http://a.b.example.com/de/", "http://com/de/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_urls(rows).collect()}
    assert got == {0: ("example.net/en/", "allow"), 1: (None, "allow"), 2: ("net/", "block"), 3: (None, "allow"), 4: ("org/fr/", "allow"), 5: ("example.com/de/", "block"), 6: (None, "allow")}


def test_redact_of_dense_and_sparse_texts(spark):
    """Spans of several kinds that overlap, more than are taken together, long gaps, gaps of nothing, characters beyond the basic plane."""
    texts = [dense(3000), "x" * 1000 + "\U0001f600 u@a.de" + "é" * 5000, "u@a.de", "a@b.c,10.0.0.1,", "é" * 128 + " u@a.de", "nothing", "", "+1 (2) 3456789012 4111 1111 1111 1111", ("4111 1111 1111 1111 " * 5 + "é") * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.found for r in pii.find_personal_data(df).collect()}
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    for i, text in enumerate(texts):
        out, at = "", 0
        for x in spans[i]:
            if x.start >= at:
                out, at = out + text[at : x.start] + f"[{x.kind}]", x.end
        assert got[i] == out + text[at:]


def test_redact_keeps_columns_of_any_name(spark):
    names = ["__m_email", "__g_ip", "__r_card", "__z_phone", "__pieces", "found", "c0", "text"]
    df = spark.createDataFrame([(*["k"] * 7, "to u@a.de, 10.0.0.1"), (*["k"] * 7, None)], ", ".join(f"`{n}` string" for n in names))
    got = pii.redact(df)
    assert got.columns == names and {tuple(r) for r in got.collect()} == {(*["k"] * 7, "to [email], [ip]"), (*["k"] * 7, None)}


def test_a_file_listed_twice(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, f"text {i} " + "word " * i, "en", "src", None) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(path)
    twice = spark.read.parquet(path, path)
    rows = numbered(twice)
    assert rows.count() == 80 and rows.select("__file", "__row").distinct().count() == 80
    assert dedup.keep_distinct(twice).count() == 40
    taken = mixing.mix(twice)
    assert mixing.take_mixed(twice).count() == sum(r.copies for r in taken.select("copies").collect())


def test_a_column_called_as_a_row_s_place_is_an_error(spark):
    with pytest.raises(ValueError, match="__row"):
        numbered(spark.createDataFrame([(1, 2)], "doc_id long, __row long"))
