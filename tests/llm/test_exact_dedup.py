import hashlib
import random
import re

from lodestar.llm.exact_dedup import digests, exact_duplicates, heavy_hitters

DOCS = "doc_id long, text string, row long, best string, group_size int, h int"


def brute(rows):
    """(doc_id, keep_id, group_size, kept, sha) of (doc_id, text) rows, by the order of the rows for repeated ones."""
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    groups = {}
    for i, x in enumerate(norm):
        groups.setdefault(x, []).append(i)
    out = []
    for i, x in enumerate(norm):
        best = min(groups[x], key=lambda j: (-len(rows[j][1] or ""), rows[j][0] is None, rows[j][0] or 0, j))
        out.append((rows[i][0], rows[best][0], len(groups[x]), i == best, hashlib.sha256(x.encode()).hexdigest()))
    return out


def check(spark, rows, parts=3, **options):
    df = spark.createDataFrame([(d, t, 0, "x", 1, 2) for d, t in rows], DOCS).repartition(parts)
    got = [tuple(r) for r in exact_duplicates(df, **options).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_edges(spark):
    check(spark, [])
    check(spark, [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "a b"), (5, "ab"), (6, "a\xa0b"), (7, "A b"), (8, "é é"), (9, "éé "), (None, "ab  "), (None, None)])
    check(spark, [(1, "same"), (1, "same"), (1, "sa me"), (2, "same"), (None, "x"), (None, "x")])
    check(spark, [(2, "b" * 200_000), (1, "b" * 199_999 + " b"), (3, "b" * 200_000)])


def test_large_and_small_groups(spark):
    rng = random.Random(5)
    texts = ["hot copy"] * 700 + ["  hot copy"] * 300 + [f"warm {i % 40}" for i in range(400)] + [f"cold {i}" for i in range(900)] + [None] * 50
    rows = [(i, t) for i, t in enumerate(rng.sample(texts, len(texts)))]
    check(spark, rows, 5)
    check(spark, rows, 5, support=0.2)
    check(spark, rows, 5, support=1.0)


def test_heavy_hitters_are_found_and_counted(spark):
    rows = [(i, "hot") for i in range(500)] + [(i, f"t {i}") for i in range(500, 1500)]
    heavy = heavy_hitters(digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)), 0.05).collect()
    assert [(r.group_size, r.best.doc_id) for r in heavy] == [(500, 0)]


def test_plan_has_no_python(spark):
    d = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    plan = exact_duplicates(d)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
