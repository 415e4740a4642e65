"""Scalar functions, each against values worked out by hand."""

from pyspark.sql import functions as F

from folioquery.functions import dates, names, pages, similarity, text
from folioquery.functions.results import field_is, parse_result, percent, truthy


def values(spark, rows, column, schema="s string"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(column).collect()]


def test_dates(spark):
    assert values(spark, ["1/2/2024", "01/02/24", "13/1/2024", "2/30/2024", "x", None], dates.us_date(F.col("s"))) == ["2024-01-02", "2024-01-02", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    assert values(spark, ["Undated", "on 3/4/85", "2024-02-31", "May 5, 2020", "none"], dates.date_cell(F.col("s"))) == ["UNKNOWN", "2085-03-04", "2024-02-31", "2020-05-05", "UNKNOWN"]
    pairs = [("2016-08-29", "August 29, 2016"), ("8/29/2016", "Aug 29 2016"), ("2016-08-29", "2016-08-30"), ("Spring, 2016", "spring 2016"), (None, "x")]
    assert values(spark, pairs, dates.dates_match(F.col("a"), F.col("b")), "a string, b string") == [True, True, False, True, False]


def test_headers(spark):
    long = "word " * 40
    assert values(spark, ["short", long, "x" * 200], text.truncate_header(F.col("s"))) == ["short", ("word " * 30)[:149].rstrip(), "x" * 150]
    assert values(spark, ["\n  \n head \nbody", "", None], text.first_line(F.col("s"))) == ["head", None, None]
    assert values(spark, ["a\nb\nc", "a", ""], text.body(F.col("s"))) == ["b\nc", "", ""]
    heads = ["# [May 1, 2020, Report - A Person, MD - Place]{.underline}", "# [Unknown, Report - B]{.underline}", "# May 2, 2020 note", "Cover Letter - C Person to D", "none"]
    assert values(spark, heads, text.header_date(F.col("s"))) == ["May 1, 2020", "Unknown", "May 2, 2020", None, None]
    assert values(spark, heads, text.header_provider(F.col("s"))) == ["A Person, MD", "B", None, "C Person to D", None]


def test_labelled_dates_and_phrases(spark):
    rows = ["seen. DOS: 1/2/2024 and more", "lados: 1/2/2024", "Date of exam: May 5, 2020", "no date"]
    assert values(spark, rows, text.labelled_date(F.col("s"))) == ["1/2/2024", None, "May 5, 2020", None]
    assert values(spark, ["one two three. four; five six seven"], text.phrases(F.col("s"))) == [["one two three", "five six seven"]]
    assert values(spark, ["a <tag> b </tag> c", "plain"], text.tagged_or_all(F.col("s"), "tag")) == [" b ", "plain"]
    assert values(spark, ["https://x/runs/77/y", "12", "z"], text.resource_id(F.col("s"), "runs")) == ["77", "12", None]


def test_names(spark):
    assert values(spark, ["LAST, FIRST M, MD", "First  Last, (MD", "PhD", None], names.plain_name(F.col("s"))) == ["first m last", "first last", None, None]
    assert values(spark, ["City Hospital", "A Person", None], names.likely_organisation(F.col("s"))) == [True, False, False]


def test_pages_round_trip(spark):
    rows = ["1, 3-5, 4", "7 - 9", "5-3", "x, 2", "", "99999999999999"]
    assert values(spark, rows, pages.expand_pages(F.col("s"))) == [[1, 3, 4, 5], [7, 8, 9], [], [2], [], []]
    lists = [([1, 2, 3, 5],), ([7],), ([],), ([9, 8, 1],)]
    shown = values(spark, lists, pages.page_ranges(F.col("p")), "p array<int>")
    assert shown == ["1-3, 5", "7", "", "1, 8-9"]
    assert values(spark, shown, pages.expand_pages(F.col("s"))) == [[1, 2, 3, 5], [7], [], [1, 8, 9]]


def test_similarity_of_a_page_with_itself(spark):
    rows = ["1/2/2024 smith, md office visit notes", "1/2/2024 plain words", "plain words", "plain therapy words"]
    prints = similarity.fingerprint(F.col("s"))
    got = values(spark, rows, F.round(similarity.similarity(prints, prints), 2))
    assert got == [1.8, 2.0, 1.5, 1.33]
    assert values(spark, [(0.71,), (0.7,), (0.31,), (0.3,), (1.8,)], similarity.report_confidence(F.col("x")), "x double") == ["STRONG (71%)", "LIKELY (70%)", "WEAK (31%)", "NO MATCH", "STRONG (180%)"]


def test_similarity_is_symmetric(spark):
    rows = [("1/2/2024 a b c report", "1/3/2024 1/2/2024 b c d mri report"), ("x", ""), ("", "")]
    a, b = similarity.fingerprint(F.col("a")), similarity.fingerprint(F.col("b"))
    assert all(x == y for x, y in values(spark, rows, F.array(similarity.similarity(a, b), similarity.similarity(b, a)), "a string, b string"))


def test_results(spark):
    rows = ['{"c": true, "n": 1}', '{"c": false}', '{"c": "false"}', '{"c": null}', "{}", "{broken", "", None]
    r = parse_result(F.col("s"))
    assert values(spark, rows, truthy(r, "c")) == [True, False, True, False, False, False, False, False]
    assert values(spark, rows[:2], field_is(r, "n", "1")) == [True, False]
    assert values(spark, rows[1:2], field_is(r, "n", "")) == [True]
    assert values(spark, rows[5:], field_is(r, "n", "")) == [False, False, False]
    assert values(spark, [(1, 3), (0, 0)], percent(F.col("a"), F.col("b")), "a int, b int") == [33.3, 0.0]


def test_messages_and_sizes(spark):
    df = spark.createDataFrame([([("system", "be"), ("user", "do")],)], "m array<struct<role:string,template:string>>")
    assert df.select(text.messages_text(F.col("m"))).first()[0] == "system: be\n\nuser: do"
    assert values(spark, [(10,), (2048,), (3 * 1024 * 1024,)], text.bytes_text(F.col("n")), "n long") == ["10 B", "2.0 KB", "3.0 MB"]
