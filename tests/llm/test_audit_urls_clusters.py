"""Filter audit, URL rules and centroid clustering against plain versions, with defined edge cases."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from folioquery.llm.centroid_clustering import centroid_clusters, limit
from folioquery.llm.filter_audit import COUNTS, filter_audit, first_failures
from folioquery.llm.url_filter import filter_urls, rule_list
from tests.llm.brute import SPACED


def audit(docs, labels):
    """{(part, order, step): counts} by walking every order over every document."""
    good, toxic = {i for i, q, _ in labels if i is not None and q == 1}, {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out, total = {}, Counter()
    for i, t, part in docs:
        t, part = t or "", part or ""
        w = SPACED.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                c = out.setdefault((part, "".join(order), step), dict.fromkeys(COUNTS, 0))
                here = fails[f] and not gone
                c["removed"] += here
                c["redundant"] += fails[f] and gone
                c["unique_fails"] += fails[f] and sum(fails.values()) == 1
                c["good_lost"] += here and i in good
                c["toxic_lost"] += here and i in toxic
                total[part, f] += here
                gone = gone or fails[f]
                c["kept"] += not gone
    for (part, order, step), c in out.items():
        c["shapley"] = total[part, order[step - 1]]
    return out


def test_first_failures():
    table = first_failures()
    assert table.shape == (32, 120) and set(table[0]) == {5} and set(table[31]) == {0}


def test_filter_audit(spark):
    r = random.Random(3)
    texts = [None, "", " \t\n", "A B", "x " * 300, " ".join(f"w{i}" for i in range(400)), "UPPER " * 5 + " ".join(f"w{i}" for i in range(300)), "a#b " * 250, "é" * 5000, "a\u00a0b \x1f c"]
    docs = [(i, r.choice(texts), r.choice(["en", "de", None, ""])) for i in range(200)]
    docs += [(None, "", "en"), (None, "A B", None), *[(7, "A B", "en")] * 3, (7, "other", "de"), *[(500 + i, "hot copy", "fr") for i in range(100)], (900, "long " * 100_000, "en")]
    labels = [(i, r.randint(0, 1), r.randint(0, 1)) for i in range(0, 600, 2)] + [(2, 1, None), (None, 1, 1), (4, None, 1)]
    d = spark.createDataFrame([(*row, "x", 1, 2) for row in docs], "doc_id long, text string, lang string, digest string, mask int, good int")
    g = spark.createDataFrame([(*row, "y") for row in labels], "doc_id long, quality int, toxic int, part string")
    got = {(x.part, x.filter_order, x.step): {c: x[c] for c in COUNTS} for x in filter_audit(d.repartition(5), g).collect()}
    assert got == audit(docs, labels)
    assert filter_audit(d.limit(0), g).count() == 0
    bare = filter_audit(d, g.limit(0)).agg({"good_lost": "max", "toxic_lost": "max"}).first()
    assert tuple(bare) == (0, 0)


RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "EXAMPLE.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
    ("allow", "a.b.com", "/d"), ("block", "b.com", "/de"), ("allow", "b.com", "/de"), ("block", "", "/"), ("block", None, "/"), ("block", "only.host", None), ("block", "deep.a.b.c.d.e.f", "/p/q/r/s"),
]
URLS = [
    "https://example.org/es/x", "https://EXAMPLE.ORG/en/12?q#f", "http://www.example.org/en/2", "http://org/", "http://org", "http://notexample.org/es/", "x://a.b.com/de/1", "x://z.a.b.com/de/1", "http://com/DE/", "http://com/de/",
    "http://c.com?u=http://example.org/es/", "http://c.com#/de/", "example.org/es/", "://example.org/es/", "http://", "", None, "http://.org/", "http://org./", "http://u@example.org/es/", "http://example.org:80/es/", "http://only.host", "http://x.only.host/y",
    "http://1.deep.a.b.c.d.e.f/p/q/r/s/t", "http://é.org/é", "http://b.com/de", "a\nb://x.com/d\n/?y", "http://h" + ".x" * 3000 + ".com/de/" + "p/" * 5000,
]


def judged(url, rules):
    m = re.search("://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = []
    for verdict, h, p in rules:
        h, p = (h or "").lower(), p or ""
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), h + p, verdict))
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("bound", [100, 0])
def test_url_rules(spark, bound):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[0])] * 3 + [(3, URLS[1])] * 50 + [(3, None)] * 2
    pages = spark.createDataFrame([(i, u, "<p>", "h", "v", 1) for i, u in rows], "page_id long, url string, html string, host string, verdict string, copies int").repartition(3)
    got = Counter((x.page_id, x.host, x.path, x.rule, x.verdict) for x in filter_urls(pages, rule_list(spark, RULES), broadcast_rules=bound).collect())
    assert got == Counter((i, *judged(u, RULES)) for i, u in rows)
    assert filter_urls(pages.limit(0), rule_list(spark, RULES), broadcast_rules=bound).count() == 0


def test_url_rules_without_a_list(spark):
    pages = spark.createDataFrame([(1, URLS[0]), (2, None)], "page_id long, url string")
    out = filter_urls(pages, rule_list(spark, RULES).limit(0), default="block").collect()
    assert {(x.page_id, x.host, x.path, x.rule, x.verdict) for x in out} == {(1, "example.org", "/es/x", None, "block"), (2, "", "", None, "block")}


def clusters(rows, k, rounds, dims, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, at) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    at = assign()
    own = Counter()
    for d, c in at:
        own[c] += d
    return Counter((i, c, d, own[c], sum(own.values()), tuple(centroids[c])) for (i, _), (d, c) in zip(kept, at))


def found(df, **more):
    out = centroid_clusters(df, **more)
    return Counter((x.vec_id, x.cluster, x.distance, x.cluster_inertia, x.inertia, tuple(x.centroid)) for x in out.collect())


def test_clusters(spark):
    r = np.random.RandomState(4)
    rows = [(int(i), r.randn(8).round(1).tolist()) for i in range(400)] + [(1000 + i, [1.0] * 8) for i in range(300)]
    rows += [(5, [2.0] * 8), (5, [-2.0] * 8), (None, [3.0] * 8), (None, None), (7, None), (8, [1.0] * 7), (9, [1.0, None] * 4), (10, [float("nan")] * 8), (11, [float("-inf")] * 8), (12, []), (13, [-0.001] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2, 3.0) for i, v in rows], "vec_id long, embedding array<float>, cluster int, v int, distance float").repartition(4)
    as_float = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for k, rounds in ((16, 3), (3, 0), (40, 9)):
        assert found(df, k=k, rounds=rounds, dims=8) == clusters(as_float, k, rounds, 8, 64)
    few = df.filter("vec_id in (1, 2, 7, 8)")
    assert found(few, dims=8) == clusters([x for x in as_float if x[0] in (1, 2, 7, 8)], 16, 3, 8, 64)
    assert found(df.limit(0), dims=8) == found(df.filter("vec_id is null"), dims=8) == Counter()
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_clusters_skip_centroids_far_off(spark):
    r = np.random.RandomState(1)
    at = r.randn(16, 64) * 10
    rows = [(i, (at[i % 16] + r.randn(64) * 0.1).tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = centroid_clusters(df, rounds=6).agg({"scanned": "sum"}).first()[0]
    assert out < 0.6 * 800 * 16 * 7


def test_clusters_refuse_what_a_long_cannot_hold(spark):
    df = spark.createDataFrame([(1, [limit(64) / 64.0] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="is not below"):
        centroid_clusters(df).collect()
