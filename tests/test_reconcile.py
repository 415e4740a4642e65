"""Index parsers, page maps, reconciliation, report and investigation on small fixtures."""

import zipfile

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioquery.operators import first_match, index_parsers, overlap_join, page_map
from folioquery.plans import investigate, report
from folioquery.sources import readers, sinks
from folioquery.sources.docx import DocxSource, index_cells

ENTRY = "entry_id string, date string, pages array<int>, header string"


def parse(spark, text, parser):
    return [r.asDict() for r in parser(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("ordinal").collect()]


def test_vendor_index(spark):
    text = "title\n1/2/2024\n12-14,\n16\nHeader one\nsays 3/4/2023 more\n2/2/2024\nexcerpt only\nnot pages\n2/3/24\n\n7Glued Name\nUndated\n501, 9\nlast\n1/5/2024\nno pages"
    got = [(r["date"], r["pages"], r["header"]) for r in parse(spark, text, index_parsers.vendor_index)]
    assert got == [
        ("2024-01-02", [12, 13, 14, 16], "Header one says 3/4/2023 more 2/2/2024 excerpt only not pages"),
        ("2024-02-03", [7], "Glued Name"),
        ("UNKNOWN", [9], "last 1/5/2024 no pages"),
    ]


def test_vendor_index_keeps_five_header_lines_and_fuses_page_lines(spark):
    text = "1/2/2024\n1\n2\n3\na\nb\nc\nd\ne\nf\n1/1\n"
    assert [(r["pages"], r["header"]) for r in parse(spark, text, index_parsers.vendor_index)] == []  # '1 2 3' is no page
    text = "1/2/2024\n1,\n2\na\nb\nc\nd\ne\nf\n1/1\n"
    assert [(r["pages"], r["header"]) for r in parse(spark, text, index_parsers.vendor_index)] == [([1, 2], "a b c d e 1/1")]


def test_own_index(spark):
    text = "\n".join([
        "| September 28, 2023 | P | Head A | 1-3 |", "|  |  | more | 9 |", "+---+---+---+---+",
        "| Sept | P | Head B | |", "| ember | | | 4 |", "| 28, | | | |", "| 2023 | | | 5 |", "+---+",
        "| 2024- | P | Head C | 6 |", "| 03-25 | | | |", "+---+",
        "| 10/06 | P | Head D | 7 |", "| /2025 | | | |", "| 11/ | P | Head E | 8 |", "| 07 | | | |", "| /24 | | | |", "+---+",
        "| Un | P | Head F | 10 |", "+---+", "| unknown | P | Head G | |",
    ])
    got = [(r["date"], r["pages"], r["header"]) for r in parse(spark, text, index_parsers.own_index)]
    assert got == [
        ("2023-09-28", [1, 2, 3, 9], "Head A"), ("2023-09-28", [4, 5], "Head B"), ("2024-03-25", [6], "Head C"),
        ("2025-10-06", [7], "Head D"), ("2024-11-07", [8], "Head E"), ("UNKNOWN", [10], "Head F"),
    ]


def test_sections(spark):
    own = spark.createDataFrame([(1, "§ May 5, 2020, Title one\n§ Category: x\n§ 1/2/2021 Title two\n§ Unknown Date, T3\n§ loose, T4\n§ none\nplain")], "doc_id long, text string")
    got = [(r.normalized_date, r.title) for r in index_parsers.own_sections(own).orderBy("line_number").collect()]
    assert got == [("2020-05-05", "Title one"), ("2021-01-02", "Title two"), ("UNKNOWN", "T3"), ("UNKNOWN", "T4"), ("UNKNOWN", "none")]
    vendor = spark.createDataFrame([(1, "Place, Inc., A Person, MD, Report,\n1/2/2024\nCover letter of X, dated 3/4/2024 to\nTitle here, 5/6/24")], "doc_id long, text string")
    got = [(r.normalized_date, r.line_number) for r in index_parsers.vendor_sections(vendor).orderBy("line_number").collect()]
    assert got == [("2024-01-02", 1), ("2024-03-04", 3), ("2024-05-06", 4)]


def test_page_map(spark):
    rows = [(1, 0, "1", 11), (1, 1, "4", 14), (1, 2, "10-12", 30), (1, 3, "12", 32), (1, 4, "20-", 40), (1, 5, "22,", 43), (1, 6, "5, 6", 99), (1, 7, "x", 1), (1, 8, "1", 11), (1, 9, "7, ", 17), (1, 10, "8", 0)]
    links = spark.createDataFrame(rows, "doc_id long, ordinal int, link_text string, dest_page int")
    got = {r.logical: r.physical for r in page_map.build_page_map(links).collect()}
    assert got == {1: 11, 2: 12, 3: 13, 4: 14, 5: 15, 6: 16, 7: 17, 10: 30, 11: 31, 12: 32, **{p: p + 20 for p in range(13, 21)}, 22: 43}


def entries(spark, rows):
    return spark.createDataFrame(rows, ENTRY)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "UNKNOWN"]), st.lists(st.integers(1, 6), max_size=3)), max_size=6), st.lists(st.tuples(st.sampled_from(["a", "b", "UNKNOWN"]), st.lists(st.integers(1, 6), max_size=3)), max_size=6))
def test_reconciliation_partitions_both_sides(spark, left, right):
    y = entries(spark, [(f"y{i}", d, p, "") for i, (d, p) in enumerate(left)])
    t = entries(spark, [(f"t{i}", d, p, "") for i, (d, p) in enumerate(right)])
    same, yours, theirs = overlap_join.reconcile(y, t)
    pairs = sorted((r.your_id, r.their_id) for r in same.collect())
    expected = sorted((f"y{i}", f"t{j}") for i, (d, p) in enumerate(left) for j, (e, q) in enumerate(right) if d == e and set(p) & set(q))
    assert pairs == expected
    assert {r.entry_id for r in yours.collect()} | {a for a, _ in expected} == {f"y{i}" for i, (_, p) in enumerate(left) if p}
    assert {r.entry_id for r in theirs.collect()} | {b for _, b in expected} == {f"t{i}" for i, (_, p) in enumerate(right) if p}


def test_report(spark):
    mapping = spark.createDataFrame([(s, i, i + 100) for s in ("yours", "theirs") for i in (1, 2, 3, 4)] + [("yours", 5, 105)], "side string, logical int, physical int")
    texts = spark.createDataFrame(
        [("yours", 101, "1/2/2024 alpha beta report"), ("theirs", 101, "1/2/2024 alpha beta report"), ("yours", 102, " "), ("theirs", 102, "z"), ("yours", 103, "gamma"), ("theirs", 103, "delta"), ("yours", 105, "five"), ("yours", 104, "four words here"), ("theirs", 104, "four words here")],
        "side string, physical int, text string",
    )
    y = entries(spark, [("a", "2024-01-01", [1], "A"), ("b", "2024-01-02", [2, 3], "B"), ("c", "2024-01-03", [5], "C"), ("d", "2024-01-04", [9], "D"), ("e", "2024-01-05", [5], "[FILTERED] E")])
    t = entries(spark, [("x", "2023-12-31", [1], "X"), ("w", "2023-12-30", [4], "W")])
    same = spark.createDataFrame([("2024-02-01", [7], [8], "S", "T")], "date string, your_pages array<int>, their_pages array<int>, your_header string, their_header string")
    got = [tuple(r) for r in report.discrepancies(same, y, t, mapping, texts).collect()]
    assert [(r[0], r[5]) for r in got] == [
        ("DATE MISMATCH", "STRONG (175%)"), ("YOURS ONLY", "NO MATCH"), ("THEIRS ONLY", "STRONG (150%)"), ("YOURS ONLY", "NOT IN THEIR TOC"), ("SAME DATE", "EXACT DATE MATCH"), ("YOURS ONLY", "NOT IN YOUR DOCUMENT"),
    ]
    assert got[0][1:5] == ("2024-01-01", "2023-12-31", "1", "1") and got[0][8] == "VERIFY CORRECT DATE - Check header text for actual date"
    assert got[2][8] == "VERIFY MATCH - CHECK YOUR PAGE 4" and got[5][8] == "Page not found in your PDF TOC" and got[3][8] == "MANUAL REVIEW NEEDED"
    assert not any("FILTERED" in (r[6] or "") for r in got)


def test_investigation(spark):
    texts = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "a b c x"), (4, "q"), (5, None)], "physical int, text string")
    one = texts.filter("physical = 1")
    assert [(r.physical, r.verdict) for r in investigate.candidates(one, texts).collect()] == [(1, "SAME DOCUMENT"), (2, "SAME DOCUMENT"), (3, "SAME DOCUMENT")]
    assert [r.physical for r in investigate.duplicates(one, texts).collect()] == [2]


def test_rubrics(spark):
    rows = [(["QME"],), (["X", "Letter"],), (["Panel QME Lab"],), (["x Lab y"],), ([],), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "s array<string>").select(F.array_join(first_match.required_sections(first_match.rubric_name(F.coalesce("s", F.array().cast("array<string>")))), ",")).collect()]
    assert got == ["Subjective,Assessment,Impairment", "", "Subjective,Assessment,Impairment", "", "Subjective,Assessment", "Subjective,Assessment"]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "map.json").write_text('{"1": 11, "x": 3, "2": 12}')
    assert sorted((r.logical, r.physical) for r in readers.page_map(spark, str(tmp_path / "map.json"), "yours").collect()) == [(1, 11), (2, 12)]
    assert readers.page_map(spark, str(tmp_path / "none.json"), "yours").count() == 0
    (tmp_path / "r.json").write_text('{"yours_only": [{"date": "d", "pages": [1], "header": "h"}], "theirs_only": [], "same_dates": []}')
    same, yours, theirs = readers.reconciliation(spark, str(tmp_path / "r.json"))
    assert (same.count(), yours.count(), theirs.count()) == (0, 1, 0)
    (tmp_path / "t.txt").write_bytes(b"ok \xff end")
    assert readers.texts(spark, str(tmp_path / "t.txt")).first().text == "ok � end"
    sinks.write_csv(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().b == "x"
    assert '"a"' in sinks.one_json(spark.createDataFrame([(1,)], "a int"))


def test_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    row = lambda *c: "<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:tc>" for x in c) + "</w:tr>"
    body = "<w:tbl>" + row("Date of Service", "P", "E", "Pages") + row("1/2/2024", "A", "Excerpt", "3-4") + row("", "B", "x", "5") + row("1/3/2024", "C", "y", "") + "</w:tbl>"
    with zipfile.ZipFile(tmp_path / "i.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    spark.dataSource.register(DocxSource)
    cells = spark.read.format("docx").load(str(tmp_path / "*.docx"))
    assert cells.count() == 4
    assert [(r.date, r.pages, r.header) for r in index_cells(cells).collect()] == [("2024-01-02", [3, 4], "Excerpt")]


def test_overlap_by_runs_and_by_pages(spark, monkeypatch):
    import random

    r = random.Random(2)

    def side(n, name):
        out = []
        for i in range(n):
            lo = r.randint(1, 60)
            pages = r.choice([[lo], list(range(lo, lo + 12)), [lo, lo + 5, lo + 6], [lo + 1, lo, lo], list(range(1, 80))])
            out.append((f"{name}{i}", r.choice(["UNKNOWN"] * 6 + ["2024-01-01", "2024-01-02", None]), pages, "h"))
        return [*out, (f"{name}x", "UNKNOWN", [], ""), (f"{name}y", "UNKNOWN", None, ""), (f"{name}z", "UNKNOWN", [3, None, 4], "")]

    yours, theirs = side(60, "y"), side(50, "t")
    y, t = (spark.createDataFrame(rows, ENTRY) for rows in (yours, theirs))
    expected = sorted((d, i, j) for i, d, p, _ in yours for j, e, q, _ in theirs if d is not None and d == e and {*(p or ())} & {*(q or ())} - {None})
    for dates, pages in ((1000, 1000), (5, 1000), (5, 4), (0, 1)):
        monkeypatch.setattr(overlap_join, "DATE_ENTRIES", dates)
        monkeypatch.setattr(overlap_join, "PAGE_ENTRIES", pages)
        assert sorted((x.date, x.your_id, x.their_id) for x in overlap_join.same_dates(y, t).collect()) == expected
    # rows that are shuffled: one a run, not one a page
    none = spark.createDataFrame([], "date string, parts int")
    runs, every = (overlap_join.interval_rows(overlap_join.with_pages(y), large).count() for large in (none, y.select("date").distinct().withColumn("parts", F.lit(1))))
    assert every > sum(len({*p}) for _, d, p, _ in yours if p and d) - 2 and runs < every / 5


def test_runs_of_a_large_date_meet_once_not_once_a_page(spark, monkeypatch):
    monkeypatch.setattr(overlap_join, "DATE_ENTRIES", 1)
    y = spark.createDataFrame([(f"y{k}", "UNKNOWN", [*range(k, k + 20), *range(k + 40, k + 45)], "h") for k in range(30)], ENTRY)
    t = spark.createDataFrame([(f"t{k}", "UNKNOWN", list(range(k, k + 8)), "h") for k in range(40)], ENTRY)
    runs = [(k + a, k + b) for k in range(30) for a, b in ((0, 19), (40, 44))]
    expected = sum(lo <= k + 7 and k <= hi for lo, hi in runs for k in range(40))
    assert overlap_join.run_pairs(y, t).count() == expected
    pairs = {(f"y{i}", f"t{k}") for i in range(30) for k in range(40) if {*range(i, i + 20), *range(i + 40, i + 45)} & {*range(k, k + 8)}}
    got = overlap_join.same_dates(y, t).collect()
    assert len(got) == len(pairs) and {(r.your_id, r.their_id) for r in got} == pairs
    assert all(r.their_pages == list(range(int(r.their_id[1:]), int(r.their_id[1:]) + 8)) for r in got)


def test_page_runs(spark):
    from folioquery.functions.pages import page_runs

    df = spark.createDataFrame([([5, 1, 2, 2, None, 3, 9],), ([],), (None,), ([7],)], "p array<int>")
    got = [r.r and [tuple(x) for x in r.r] for r in df.select(page_runs(F.col("p")).alias("r")).collect()]
    assert got == [[(1, 3), (5, 5), (9, 9)], [], None, [(7, 7)]]
