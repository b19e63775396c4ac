import math
import random
import re
from collections import Counter

import numpy as np

from lodestar.llm import lexical
from lodestar.llm.bisection import Routes, frequent, reorder
from lodestar.llm.lexical import build, search

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return Counter(x.translate(LOWER) for x in WORD.findall(text or ""))


def brute(docs, items, k):
    bags = [(d, terms(t)) for d, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(x for _, b in bags for x in b)
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            m = 50 + (50 * sum(b.values()) * n_docs) // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * b[x]) // (1000 * b[x] + 20 * m)) for x in terms(text) if x in b)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored, key=lambda r: r[:3])[:k])]
    return out


def check(spark, docs, items, k=5, parts=3, block=1_000_000, **options):
    d = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, shard int, q int, score string").repartition(parts)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    got = [tuple(r) for r in search(build(d, **options), b, k=k, block=block).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(brute(docs, items, k), key=key)


def corpus(rng, n, topics=6):
    words = [[f"t{t}w{i}" for i in range(40)] for t in range(topics)]
    common = ["the", "of", "and", "Straße", "漢字", "x9"]
    return [" ".join(rng.choice(words[t]) if rng.random() < 0.6 else rng.choice(common) for _ in range(rng.randrange(1, 40))) for t in (rng.randrange(topics) for _ in range(n))]


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    texts = corpus(rng, 400) + ["hot copy of t1w1 the"] * 150 + [None, "", " - "] + ["LONG " + " ".join(rng.choice(["the", "t2w2", f"u{rng.random()}"]) for _ in range(6000))]
    docs = [(i, t) for i, t in enumerate(rng.sample(texts, len(texts)))] + [(None, "the t1w1"), (3, "t1w1 the"), (3, "t1w1 the")]
    items = [(i, t) for i, t in enumerate(corpus(rng, 12))] + [(20, "hot copy"), (21, "hot"), (22, None), (23, "."), (24, "unknownword"), (25, "the"), (25, "the"), (26, "The THE t1w1 straße")]
    check(spark, docs, items, shard=2000, sample=100, cluster=16)
    check(spark, docs, items, k=50, shard=100_000, sample=50, block=60)


def test_empty(spark):
    check(spark, [], [(1, "a")])
    check(spark, [(1, "a b"), (2, None)], [])
    check(spark, [(1, None), (2, "")], [(1, "a"), (2, None)])
    check(spark, [(1, "a"), (2, "a")], [(None, "a")])  # weights of words that all have may be 0


def test_bisection_brings_topics_together():
    rng = random.Random(1)
    topic = [rng.randrange(4) for _ in range(256)]
    pairs = sorted({(d, t * 50 + rng.randrange(50)) for d, t in enumerate(topic) for _ in range(20)} | {(d, 200 + rng.randrange(5)) for d in range(256)})
    doc, term = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    g = frequent(term, doc, 256, 205)
    order = reorder(g, 8)
    assert sorted(order.tolist()) == list(range(256))
    changes = sum(topic[a] != topic[b] for a, b in zip(order, order[1:], strict=False))
    assert changes < 40 < sum(a != b for a, b in zip(topic, topic[1:], strict=False))
    names = np.unique(term[np.bincount(term)[term] > 1]).astype(np.uint64)
    leaf = Routes(g, names, 2).leaf(term.astype(np.uint64), doc, 256)
    assert sum(Counter(x for x, t in zip(leaf.tolist(), topic, strict=True) if t == k).most_common(1)[0][1] for k in range(4)) > 200


def test_clusters_that_cannot_win_are_not_searched(spark, monkeypatch):
    rng = random.Random(9)
    docs = spark.createDataFrame(list(enumerate(corpus(rng, 2000, 20))), "doc_id long, text string")
    index = build(docs, shard=100_000, sample=500, cluster=16)
    rows = lexical._clusters(index.clusters.toArrow().combine_chunks().to_batches()[0])
    queries = lexical.Queries.of(corpus(rng, 30, 20))
    queries.weight = np.full(len(queries.vocabulary), 1000)
    best = lexical.Best(queries, 5, np.zeros(30, np.int64), np.full(30, -1))
    visits = []
    visit = best.visit
    monkeypatch.setattr(best, "visit", lambda q, *a: (visits.append(q), visit(q, *a)))
    best.search(rows)
    assert len(visits) < 0.7 * 30 * len(rows)
