import math
import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm.partenum import similarity_components
from lodestar.llm.winnowing import brute_force

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    schema, rows = docs.schema, {0: {r.doc_id: r.text for r in docs.collect()}}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4], 1):
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.schema == schema
        rows[i] = {r.doc_id: r.text for r in docs.collect()}
        assert rows[i].items() <= rows[i - 1].items()
        before.unpersist()
    assert len(rows[1]) > 0.97 * len(rows[0]) and 0.75 * len(rows[1]) < len(rows[2]) < len(rows[1])
    words = re.compile(r"[^\x20\x09-\x0D]+")
    sets = {}
    for d, t in rows[2].items():
        w = words.findall(t.lower())
        sets[d] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    assert set(rows[3]) == {d for d in ids if find(d) == d} and len(rows[3]) < len(rows[2])
    bench = [(r.item_id, r.text) for r in spark.read.parquet(SF + "/benchmark.parquet").collect()]
    assert set(rows[4]) == {d for d, _, hit, *_ in brute_force(list(rows[3].items()), bench) if not hit} and len(rows[4]) < len(rows[3])
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == set(rows[4]) and sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)


def test_run(spark):
    """run() keeps the documents that a brute-force chain keeps; toxic ones are those of the operator, fitted on what is left."""
    from lodestar.llm.common import fold
    from lodestar.llm.langid import learn
    from lodestar.llm.toxicity import detect
    from test_langid import brute_phrases

    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(small + "/documents.parquet")
    samples = learn(docs.where(fold("doc_id", 4) != 2))
    plain = lambda t: re.sub(r"[\W\d_]+", " ", t.lower())
    texts = {k: plain(t) for k, (t, _) in samples.items()}
    kept = []
    for r in docs.collect():
        x = plain(r.text or "")
        if x.strip():
            cost = min(brute_phrases(t.encode(), x.encode()) * math.log2(len(t.encode()) + 2) for t in texts.values())
            if cost / len(x.encode()) <= 6 + 64 / len(r.text.encode()):
                kept.append(r)
    assert 0.95 * docs.count() < len(kept) <= docs.count()
    left = spark.createDataFrame(kept, docs.schema)
    toxic = {r.doc_id for r in detect(left, spark.read.parquet(small + "/labels.parquet")).where("predicted = 1").collect()}
    rows = {r.doc_id: r.text for r in kept if r.doc_id not in toxic}
    words = re.compile(r"[^\x20\x09-\x0D]+")
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    sets = {d: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for d, t in rows.items() if (w := words.findall(lower(t)))}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    single = {d: t for d, t in rows.items() if d not in sets or find(d) == d}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(small + "/benchmark.parquet").collect()]
    want = {d for d, _, hit, *_ in brute_force(list(single.items()), bench) if not hit}
    assert {r.doc_id for r in corpus_pipeline.run(spark, small).collect()} == want and len(want) < len(single) < len(rows) <= len(kept)


def test_foreign_texts_go(spark):
    from lodestar.llm.langid import learn, predict

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rng = random.Random(1)
    odd = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)), "\u03b1\u03b2\u03b3 " * 100, "123 456", "Zażółć gęślą jaźń, kiedy wszyscy już śpią i nikt nie słyszy naszych kroków na schodach domu. " * 3]
    more = spark.createDataFrame([(10**6 + i, t, None, "s", len(t)) for i, t in enumerate(odd)], d.schema)
    got = corpus_pipeline.language_id(spark, d.unionByName(more), "")
    assert got.where("doc_id >= 1000000").count() == 0 and got.count() > 0.95 * d.count()
    assert corpus_pipeline.language_id(spark, d.withColumn("lang", F.lit(None).cast("string")), "").count() == 0
    assert predict(d, learn(d)).where("level > 6").count() <= 2


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the cat and the dog", "en", "s", 19), (3, "the cat and the dog", "en", "s", 19), (None, "the dog and the cat " * 5000, None, "s", 5)]
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.where("doc_id = 1").count() == 0
    assert similarity_components(spark.createDataFrame(rows, schema)).count() == 5
