"""Run inspection, rubric checks, review checks and redundancy on small fixtures."""



from folioquery.operators import index_parsers, letter_checks, review_checks, run_inspection, token_join
from folioquery.plans import index_queries
from folioquery.sources import readers
from folioquery.streaming import feed

LETTER = "index int, date string, provider string, category array<string>, subcategory array<string>, page_count int, pages array<int>, content string"
EXTRACT = "iteration int, result string, prompt string"
GOOD = "# [May 1, 2020, Report - A Person, MD - Place]{.underline}\nSubjective: x. Assessment: y."


def letters(spark, *rows):
    base = {"index": 1, "date": "2020-05-01", "provider": "A Person, MD", "category": ["c"], "subcategory": [], "page_count": 1, "pages": [1], "content": GOOD}
    full = [base | {"index": i + 1} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.values()) for r in full], LETTER)


def issues(scored):
    return {r["index"]: [i.check for i in r.issues] for r in scored.collect()}


def test_rubric_checks(spark):
    rows = [
        {}, {"content": GOOD[2:]}, {"content": GOOD.replace("{.underline}", "")}, {"content": "# x{.underline}\nSubjective Assessment"}, {"date": "2020-05-02"}, {"date": "unknown"},
        {"provider": "Other"}, {"provider": "City Hospital"}, {"provider": "PERSON, A"}, {"provider": "A Person to Someone"}, {"content": " ", "page_count": 2}, {"content": None}, {"content": GOOD.split("\n")[0] + "\nplain"},
        {"page_count": 3}, {"subcategory": ["Cover Letter"], "content": "Cover Letter - A Person, MD to B\nx"}, {"subcategory": ["Letter"], "content": GOOD.split("\n")[0]},
    ]
    got = issues(letter_checks.score(letters(spark, *rows)))
    assert got == {
        1: [], 2: ["header_format"], 3: ["header_format"], 4: ["header_format"], 5: ["date_consistency"], 6: [], 7: ["provider_consistency"], 8: [], 9: [], 10: [], 11: ["empty_content"], 12: [],
        13: ["required_sections"], 14: ["content_length"], 15: ["provider_consistency"], 16: [],
    }


def test_scorecard(spark):
    scored = letter_checks.score(letters(spark, {}, {"date": "2020-05-02"}, {"provider": "Other"}))
    assert tuple(letter_checks.scorecard(scored).first()) == (3, 1, 2, 1, 1)
    assert {r.check: r.failed for r in letter_checks.by_check(scored).collect()}["date_consistency"] == 1
    none = letter_checks.score(letters(spark, {}).limit(0))
    assert tuple(letter_checks.scorecard(none).first()) == (0, 0, 0, 0, 0) and letter_checks.by_check(none).count() == 0


def test_review(spark):
    long = "the lumbar spine shows degenerative changes"
    rows = [
        {"content": "h\n" + long[:40], "pages": [1, 2]}, {"date": "Unknown", "pages": [3]}, {"date": None, "pages": [4], "provider": None}, {"date": "Unknown", "pages": [5]}, {"date": "May 1, 2020", "pages": [6]}, {"pages": [99], "provider": "Nobody Else"},
    ]
    extracts = [
        (0, '{"date": "5/1/2020", "diagnosis": "the lumbar spine shows; other"}', "seen by A. dos: 5/2/2020"), (1, '{"date": "5/3/2020", "findings": "entirely different words stand here"}', "a"), (2, '{"date": "5/4/2020"}', "dos: 5/9/2020"),
        (3, "{broken", "<processed_content>Date of visit: 5/5/2020</processed_content> dos: 1/1/2020"), (4, '{"date": "Unknown"}', "nothing"), (5, '{"date": "2020-05-01", "provider": "X"}', "A dos: May 1, 2020"),
    ]
    df, ex = letters(spark, *rows), spark.createDataFrame(extracts, EXTRACT)
    found = {r["index"]: {(i.check, i.severity, i.message) for i in r.issues} for r in review_checks.review(df, ex).collect()}
    dos = lambda i: {(s, m) for c, s, m in found.get(i, ()) if c == "dos_verification"}
    assert dos(1) == {("error", "Extract Info date '5/3/2020' differs from letter date '2020-05-01' on page 2"), ("warning", "Source text has DOS '5/2/2020' that differs from letter date '2020-05-01' on page 1")}
    assert dos(2) == {("error", "Letter has unknown date but Extract Info found '5/4/2020' on page 3")}
    assert dos(3) == {("error", "Letter has unknown date but source text contains '5/5/2020' on page 4")}
    assert dos(4) == dos(5) == set()
    assert ("content_coverage", "warning", "Content from page 2 not reflected in summary: findings") in found[1]
    assert ("provider_availability", "info", "No provider name available for review") in found[3]
    assert ("provider_availability", "info", "Provider 'Nobody Else' not found in source page text") in found[6]
    total = review_checks.summary(review_checks.review(df, ex), df).first()
    assert total.letters == 6 and total.clean == 6 - total.flagged
    findings = review_checks.review(df, ex)
    assert review_checks.qa_rows(findings).filter("status = 'FAIL'").count() == findings.filter("errors > 0").count() == 3


def test_redundancy(spark):
    same = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    one, two = (" ".join(f"{c}{i}word" for i in range(40)) for c in "xy")
    common = "w " * 400
    rows = [{"pages": [1, 2], "content": "short"}, {"pages": [2, 3], "content": "other"}, {"pages": [4], "content": same}, {"pages": [5], "content": same.upper()}, {"pages": [6], "content": common + one}, {"pages": [7], "content": common + two}, {"pages": [8], "content": common}, {"pages": [], "content": None}]
    df = letters(spark, *rows)
    assert sorted(map(tuple, token_join.redundant_letters(df).collect())) == [(1, 2), (3, 4), (5, 7), (6, 7)]
    got = {(r["index"], r.message) for r in review_checks.redundancy(df).collect()}
    assert (1, "Similar to letter at pages 2-3 (A Person, MD)") in got and len(got) == 8
    only = review_checks.review(df, spark.createDataFrame([], EXTRACT)).filter("index = 1").first()
    assert only.warnings == 1


def test_cosines_against_all_pairs(spark):
    import math
    import random
    from collections import Counter

    r = random.Random(1)
    base = [r.choice("abcdefghij") * 3 + str(r.randint(0, 9)) for _ in range(60)]
    texts = []
    for _ in range(40):
        w = list(base)
        for _ in range(r.randint(0, 25)):
            w[r.randrange(60)] = str(r.randint(100, 999))
        texts.append(" ".join(w))
    counts = [Counter(t.split()) for t in texts]
    cos = lambda x, y: sum(x[w] * y[w] for w in x) / math.sqrt(sum(v * v for v in x.values())) / math.sqrt(sum(v * v for v in y.values()))
    expected = {(i, j) for j in range(40) for i in range(j) if cos(counts[i], counts[j]) > 0.9}
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    assert {(x.a, x.b) for x in token_join.similar_texts(df, "id", "t").collect()} == expected and expected


def test_run_inspection(spark):
    rows = [("r", 0, "SUCCEEDED", "o", '{"date": "2024-01-01", "k": 1}', "p", "Extract info", "", "2"), ("r", 1, "SUCCEEDED", "o", '{"date": "Unknown", "continuation": "false"}', "p", "Extract info", "", "3"), ("r", 2, "FAILED", "o", "{x", "p", "Other", "", None), ("r", 3, "succeeded", "o", "{}", "p", "Other", "", "1")]
    ex = spark.createDataFrame(rows, readers.EXECUTIONS)
    assert tuple(run_inspection.date_stats(ex).first()) == (2, 1, 1, 1, 1, 0, 50.0, 0.0)
    assert [r.page for r in run_inspection.list_pages(ex).collect()] == [0, 1]
    assert [r.iteration for r in run_inspection.where(ex, ["k=1"]).collect()] == [0] and run_inspection.where(ex, ["k"]).count() == 0 and run_inspection.where(ex, []).count() == 4
    assert ex.filter(run_inspection.iterations("1-2")).count() == 2 and ex.filter(run_inspection.iterations("0,3")).count() == 2
    assert [r.result for r in run_inspection.fields(ex, ["k"]).orderBy("iteration").collect()] == ['{"k":"1"}', "{}", "{x", "{}"]
    steps = spark.createDataFrame([("Extract info", 2, 0), ("Other", None, 1), ("extract INFO", 1, 2)], "name string, priority int, ordinal int")
    assert [tuple(r)[:2] for r in run_inspection.step_counts(steps, ex).select("name", "succeeded").collect()] == [("Other", 1), ("extract INFO", 0), ("Extract info", 2)]
    assert run_inspection.resolve_step(steps, "EXTRACT info").first().ordinal in (0, 2) and run_inspection.resolve_step(steps, "Extract info").first().ordinal == 0
    assert run_inspection.extract_step(steps).first().name == "Extract info" and run_inspection.extract_step(steps.limit(0)).first().name == "Extract Info"
    tally = run_inspection.tally(spark.createDataFrame([("a",), (None,), ("false",), ("b",), ("b",)], "v string"), "v")
    assert [tuple(r) for r in tally.collect()] == [("N/A", 2), ("b", 2), ("a", 1)]


def test_legacy_letters(spark):
    prompt = "Encounter Date: 2/2/2024\n Date: 3/3/2024\nDate:\n 1/2/2024\nProvider: A Person\nSub-category: X\nSub-category:X\n- Page: 3\n-page:\t4\n- Page: 3\nsee - Page: 9\nPages in document:\n2"
    rows = [("r", 0, "SUCCEEDED", "a <content> body </content>", None, prompt, "s", "", ""), ("r", 1, "SUCCEEDED", " all\n", None, "Letter Date: x\rDate: y", "s", "", ""), ("r", 2, "FAILED", "", None, prompt, "s", "", ""), ("r", 3, "SUCCEEDED", None, None, None, "s", "", "")]
    ex = spark.createDataFrame(rows, readers.EXECUTIONS)
    got = [tuple(r)[1:] for r in index_parsers.legacy_letters(ex).orderBy("index").collect()]
    assert got == [("1/2/2024", "A Person", ["X"], [3, 4, 3], "a <content> body </content>"), ("x\rDate: y", None, [], [], " all\n"), (None, None, [], [], "")]
    got = [tuple(r)[1:] for r in index_parsers.legacy_scored_letters(ex).orderBy("index").collect()]
    assert got == [("1/2/2024", "A Person", [], ["X"], 2, "body"), (None, None, [], [], 1, " all\n"), (None, None, [], [], 1, "")]


def test_legacy_letters_keep_both_page_numbers(spark):
    sf = "/root/testdata/sf0.001"
    rows = index_queries.legacy_letters(spark, sf).select("index", "page_count", "pages_in_document").collect()
    orders = {r.k for r in spark.read.parquet(f"{sf}/orders.parquet").filter("o_orderstatus <> 'P'").selectExpr("o_orderkey as k").collect()}
    assert {r["index"]: (r.page_count, r.pages_in_document) for r in rows} == {k: (3, k % 7 + 1 if k % 4 else 1) for k in orders}


def test_feed(spark, tmp_path):
    row = '{"run_id":"r","iteration":%d,"status":"%s","step_name":"s","finished":"2024-01-01T00:0%d:00Z"}\n'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("".join(row % (i, s, i) for i, s in enumerate(["SUCCEEDED", "failed", "RUNNING"])))
    q = feed.status_counts(feed.read_executions(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("feed").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.succeeded, r.failed, r.other) for r in spark.table("feed").collect()] == [(1, 1, 1)]


def test_extracts_are_dealt_out_before_they_are_parsed(spark):
    letters = spark.createDataFrame([(1, "2024-01-02", "A B, MD", [1, 2], "head\nbody")], "index long, date string, provider string, pages array<long>, content string")
    extracts = spark.createDataFrame([(0, '{"date":"2024-01-03"}', "x"), (1, '{"date":"2024-01-02"}', "y")], "iteration long, result string, prompt string").coalesce(1)
    facts = review_checks.page_facts(letters, extracts)
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    parsed, dealt, met = (plan.index(x) for x in ("Generate inline", "RepartitionByExpression [index", "Join Inner"))
    assert parsed < dealt < met  # a plan is written from its last step on
    assert [f["found"] for f in facts.first()["facts"]] == ["2024-01-03", "2024-01-02"]


def test_clinical_fields_are_found_however_their_names_are_written(spark):
    long_ = "a statement of many words here"
    rows = [(1, '{"diagnosis": "%s"}' % long_), (2, '{"diagn\\u006fsis": "%s"}' % long_), (3, '{"note": "diagnosis %s"}' % long_), (4, '{"findings": {"a": "%s"}}' % long_), (5, '{"findings": "short", "impression": "%s"}' % long_), (6, "{broken"), (7, None), (8, '{"symptoms": ["%s"], "treatment" : "%s; and so on with it"}' % (long_, long_)), (9, '{"diagnosis": 123456789012345678901234567890}')]
    df = spark.createDataFrame(rows, "k int, result string").selectExpr("*", "try_parse_json(result) as r")
    got = {r.k: [(c.name, c.phrases) for c in r.clinical] for r in review_checks.clinical(df, "r", "result").collect()}
    one = [("diagnosis", [long_])]
    assert got == {1: one, 2: one, 3: [], 4: [], 5: [("impression", [long_])], 6: [], 7: [], 8: [("treatment", [long_, "and so on with it"])], 9: []}
