import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm import partenum
from lodestar.llm.components import components
from lodestar.llm.partenum import Bands, _folded, signatures, similarity_components, sketch


def brute(docs, k, percent):
    sets = {}
    for i, (d, t) in enumerate(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        n = min(k, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs))


def near_copies(seed, families=12, copies=14, words=80):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    docs = []
    for _ in range(families):
        base = [word() for _ in range(rng.randrange(3, words))]
        for _ in range(copies):
            x = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                at = rng.randrange(len(x))
                x[at : at + 1] = rng.choice([[word()], [], [x[at], word()]])
                x = x or [word()]
            docs.append(" ".join(x))
    docs += [None, "", " \n", "One", "one", "two Words", "TWO words", "a b c", "a b c a b c a b c"]
    rng.shuffle(docs)
    ids = rng.sample(range(10000), len(docs))
    return list(zip(ids, docs, strict=True))


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 90, 256), (5, 80, 4), (3, 60, 3)])
def test_against_brute_force(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(partenum, "BLOCK", block)
    docs = near_copies(k + percent)
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rep int, sign string").repartition(3)
    got = sorted(tuple(r) for r in similarity_components(d, k, percent).collect())
    want = brute(docs, k, percent)
    assert got == want
    assert len({r[2] for r in want}) < len(want) - 20


def test_signatures_and_sketches_keep_every_pair():
    rng = np.random.default_rng(4)
    for percent in (90, 80):
        bands = Bands(percent)
        for n in [1, 2, 5, 9, 10, 11, 18, 20, 40, 100, 300, 2000]:
            for _ in range(20):
                a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
                gone = int(rng.integers(0, n // 5 + 1))
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[gone:]], rng.integers(0, 1 << 63, int(rng.integers(0, n // 5 + 1)), dtype=np.uint64)]))
                if not len(b):
                    continue
                both = len(np.intersect1d(a, b))
                x = _folded([sketch(a), sketch(b)])
                assert np.bitwise_count(x[0] ^ x[1]).sum() <= len(a) + len(b) - 2 * both
                if 100 * both >= percent * (len(a) + len(b) - both):
                    assert len(np.intersect1d(signatures(a, bands), signatures(b, bands))), (n, percent)


def test_few_rows(spark):
    d = spark.createDataFrame([(5, "a b c d"), (3, "a b c d"), (5, "a b c d"), (None, "x y z"), (7, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in similarity_components(d).collect())
    assert got == sorted([("3", 1, "3"), ("5", 1, "3"), ("5", 1, "3"), ("None", 1, "None"), ("7", 0, "7")])
    assert similarity_components(d.limit(0)).count() == 0


def test_ids_that_name_several_texts(spark):
    rows = [(1, "a b c d e f g"), (5, "a b c d e f g"), (5, "q r s t u v w"), (9, "q r s t u v w"), (None, "q r s t u v w"), (7, "1 2 3 4 5 6"), (7, "1 2 3 4 5 6"), (None, "n o i d"), (None, "n o i d"), (4, None), (4, None), (None, " ")]
    d = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, h int").repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in similarity_components(d).collect())
    want = [("1", 3, "1"), ("4", 0, "4"), ("4", 0, "4"), ("5", 3, "1"), ("5", 3, "5"), ("7", 2, "7"), ("7", 2, "7"), ("9", 3, "5"), ("None", 0, "None"), ("None", 1, "None"), ("None", 1, "None"), ("None", 3, "5")]
    assert got == want
    kept = partenum.without_copies(d)
    assert kept.columns == d.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted([("1", rows[0][1]), ("5", rows[2][1]), ("7", rows[5][1]), ("None", "n o i d"), ("4", "None"), ("4", "None"), ("None", " ")])
    assert partenum.without_copies(d.limit(0)).count() == 0


def test_subsets_of_parts_are_enumerated():
    bands, rng = Bands(80), np.random.default_rng(1)
    s = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    parts, sub, spare = bands.parts(bands.of(300))
    assert sub == 3 and parts == 2 * 20 * (int(bands.starts[bands.of(300) + 1]) - 1) // 180 // 2 + 1 + spare
    more = bands.parts(bands.of(300) + 1)
    assert len(signatures(s, bands)) <= sub * (parts + more[0])


def test_components(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7), (None, 3)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_null_and_long_texts():
    s = list(partenum.sets_of(pa.array([None, "", "A b  c d", "x " * 100000]), 3))
    assert [len(x) for x in s] == [0, 0, 2, 1]


def test_sql_gives_the_same(spark):
    import duckdb

    from lodestar.llm.queries import ORACLES, QUERIES

    sf, c = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, sf)
        cursor = c.execute(sql)
        assert sorted(df.columns) == sorted(x[0] for x in cursor.description)
        assert sorted(tuple(r) for r in df.select([x[0] for x in cursor.description]).collect()) == sorted(cursor.fetchall()), name
