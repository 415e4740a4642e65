"""Index parsers give the same rows however a document's lines are dealt."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folioquery.operators import index_parsers
from folioquery.operators.line_ranges import ranged

VENDOR = ["1/2/2024", "3/4/24", "Undated", "5", "7-9,", "12, 14", "12 Main St", "Report of Smith", "3,4Smith report", "seen 5/6 twice", "", "  ", "-", "Visit", "600", "2/3/2024 late"]
OWN = ["| January 5, 2024 | x | Report | 3-4 |", "| Febr | x | Split | 7 |", "| uary | | | |", "| 6, | | | 8 |", "| 2024 | | | |", "| 2024- | x | Iso | 9 |", "| 03-04 | | | |", "| 4/5 | x | Half | 10 |", "| /2024 | | | 11, |", "| 6/ | x | Third | 12 |", "| 7 | | | |", "| unknown | x | None | 13 |", "| Un | | | |", "+----+----+", "| | | more text | 14-15 |", "plain"]


def text(seed, words, n):
    r = random.Random(seed)
    return "\n".join(r.choice(words) for _ in range(n))


def vendor_plain(lines):
    """(line, pages, header lines) of each entry with pages, line by line."""
    lines = [x.strip() for x in lines]
    dated = [bool(re.fullmatch(r"\d{1,2}/\d{1,2}/\d{2,4}", x)) for x in lines]
    starts = [x == "Undated" or d and any(re.match(r"[\d\-,\s]+", y) for y in lines[i + 1 : i + 3]) for i, (x, d) in enumerate(zip(lines, dated))]
    out, entry = [], None
    for i, x in enumerate(lines):
        if starts[i]:
            entry = [i, [], [], False, 0]
            out.append(entry)
        elif entry is None or (x == ""):
            continue
        else:
            glued = re.match(r"([\d\-,]+)([A-Z][a-z]+.*)", x)
            slash = not dated[i] and re.search(r"\d+/\d+", x)
            if not slash and not dated[i] and not entry[3] and re.fullmatch(r"[\d\-,\s]+", x):
                entry[1].append(x)
                continue
            if glued and not slash and not dated[i] and not re.fullmatch(r"[\d\-,\s]+", x):
                if not entry[3]:
                    entry[1].append(glued[1])
                x = glued[2]
            if slash or len(entry[2]) < 5:
                entry[2].append(x)
            entry[3] = True
    return [(e[0], e[1], " ".join(e[2])) for e in out]


def pages_of(listed):
    out = set()
    for part in re.sub(r"\s*-\s*", "-", " ".join(listed)).split(","):
        m = re.fullmatch(r"\s*(\d+)(?:-(\d+))?\s*", part)
        if m:
            out |= set(range(int(m[1]), int(m[2] or m[1]) + 1))
    return sorted(p for p in out if p <= 500)


@pytest.fixture(scope="module")
def vendor(spark):
    texts = {i: text(i, VENDOR, n) for i, n in enumerate([0, 1, 2, 3, 15, 60, 60, 200])}
    texts[20] = "1/2/2024\n3\n" + "\n".join(["spoken words"] * 40 + ["4"] * 3)
    texts[21] = "\n" * 30 + "Undated\n" + "\n" * 25 + "5\n" + "\n" * 20 + "late header\n6"
    return texts, spark.createDataFrame([*texts.items(), (30, None)], "doc_id long, text string")


@pytest.mark.parametrize("size", [50_000, 30, 9, 2, 1])
def test_vendor_index(vendor, size):
    texts, df = vendor
    got = {(r.doc_id, r.ordinal): (r.pages, r.header) for r in index_parsers.vendor_index(df, size=size).collect()}
    expected = {(d, i): (pages_of(p), h) for d, t in texts.items() for i, p, h in vendor_plain(t.split("\n"))}
    expected = {k: v for k, v in expected.items() if v[0]}
    assert got.keys() == expected.keys() and len(got) > 15
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in expected.items()}
    assert all(got[k][1] == v[1] for k, v in expected.items() if len(v[1]) <= 150)


def test_own_index_and_sections(spark):
    own = spark.createDataFrame([(i, text(i, OWN, n)) for i, n in enumerate([1, 2, 5, 30, 120, 300])], "doc_id long, text string")
    plain = spark.createDataFrame([(i, text(i, ["Clinic A, Smith, MD, Report,", "1/2/2024", "", "Cover letter to counsel, dated 3/4/2024.", "Report of X, 5/6/2024"], 50)) for i in range(4)], "doc_id long, text string")
    for parse, texts in ((index_parsers.own_index, own), (index_parsers.vendor_sections, plain)):
        whole = sorted(map(repr, parse(texts).collect()))
        assert len(whole) > 10
        for size in (150, 43, 7, 4):
            assert sorted(map(repr, parse(texts, size=size).collect())) == whole, size


def test_a_long_document_is_many_tasks(spark):
    one = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.repeat(F.lit("1/2/2024\n5\nReport\n"), 100_000).alias("text"))
    rows = ranged(index_parsers.lines(one), 10_000, ahead=2)
    sizes = rows.groupBy("range").count().collect()
    assert len(sizes) == 31 and max(r["count"] for r in sizes) == 10_002
    entries = index_parsers.vendor_index(one, size=10_000)
    plan = entries._jdf.queryExecution().executedPlan().toString()
    assert entries.count() == 100_000 and re.search(r"hashpartitioning\([^)]*range#\d+", plan)
