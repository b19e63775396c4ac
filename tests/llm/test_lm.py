import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm.elias_fano import STEPS, Sequence, Trie
from lodestar.llm import lm
from lodestar.llm.lm import score_corpus


@pytest.mark.parametrize(("n", "top"), [(0, 10), (1, 1), (5, 3), (1000, 1 << 63), (1000, 1000), (5000, 10**6)])
def test_sequence(n, top):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
    s = Sequence(*Sequence.pack(v))
    assert (s.at(np.arange(n)) == v).all()
    q = np.concatenate([v, rng.integers(0, top + 1, 300, dtype=np.uint64), v + np.uint64(1)])
    at = np.searchsorted(v, q)
    assert s.find(q).tolist() == [int(i) if i < n and v[i] == x else -1 for i, x in zip(at, q, strict=True)]


def test_trie_from_a_mapped_file(tmp_path):
    words = np.array([3, 9, 20, 1 << 60], np.uint64)
    names = np.array([5, 6, 7, 8], np.uint64)
    t = Trie.build(words, np.arange(4), np.arange(4, dtype=np.uint16), np.array([0, 2, 2, 5, 6]), names, np.array([0, 3, 0, 1, 2, 3]), np.arange(10, 16, dtype=np.uint16))
    (tmp_path / "t").write_bytes(t[:])
    trie = Trie(np.memmap(tmp_path / "t", np.uint8, "r"))
    got = trie.look_up(np.array([3, 4, 9, 20, 1 << 60], np.uint64), np.array([0, 3, 4, 5, 9, 11]), np.array([5, 6, 7, 8, 99], np.uint64), np.array([0, 1, 3, 0, 0, 0, 1, 2, 3, 3, 4]))
    assert got.tolist() == [10, 65535, 11, 65535, 65535, 12, 13, 14, 65535, 15, 65535]


def corpus(spark, n=120):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        w = ["Start"]
        for _ in range(rng.randrange(40)):
            w.append(vocabulary[(int(w[-1][1:]) * 7 + 1) % 60] if w[-1][0] in "wW" and rng.random() < 0.6 else rng.choice(vocabulary).upper())
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w), 1.0))
    rows += [(500, None, 0.0), (501, "", 0.0), (502, "unknown é words", 1.0), (3, rows[3][1], 1.0), (None, "w1 w2", 0.0), (503, "w1 " * 5000, 0.0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3)


def brute(rows):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + ["</>"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c, pairs = Counter(), Counter()
    for i, t, _ in rows:
        if not held(i):
            w = words(t)
            c.update(w)
            pairs.update(zip(["<>", *w], w, strict=False))
    n, v = sum(c.values()), len(c)
    total, kinds = Counter(), Counter()
    for (a, _), x in pairs.items():
        total[a] += x
        kinds[a] += 1
    p0 = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    p = lambda a, w: (pairs[a, w] + kinds[a] * p0(w)) / (total[a] + kinds[a]) if total[a] else p0(w)
    out = []
    for i, t, _ in rows:
        w = words(t)
        out.append((str(i), held(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(p0(x)) for x in w), sum(math.log10(p(a, x)) for a, x in zip(["<>", *w], w, strict=False))))
    for a in ("w1", "<>", "never"):
        assert abs(sum(p(a, w) for w in c) + p(a, "unseen") - 1) < 1e-9
    return sorted(out)


@pytest.mark.parametrize(("chunk", "shard"), [(1 << 20, 1 << 23), (50, 1 << 23)])
def test_against_brute_force(spark, chunk, shard):
    rows, d = corpus(spark)
    got = sorted((str(r.doc_id), *list(r)[1:]) for r in score_corpus(d, chunk_words=chunk, shard_words=shard).collect())
    for a, b in zip(got, brute(rows), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6
        assert b[6] - 2 * a[2] / STEPS <= a[6] <= b[6] + 1e-6, (a, b)


def test_shards_and_chunks_change_nothing(spark, monkeypatch):
    """Neither the number of shards, nor that of chunks, nor splitting the heavy contexts."""
    rows, d = corpus(spark)
    one = sorted((str(r.doc_id), *list(r)[1:]) for r in score_corpus(d).collect())
    split = []
    monkeypatch.setattr(lm, "_heavy", lambda *x, f=lm._heavy: split.append(f(*x)) or split[-1])
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        for chunk, shard in ((1 << 20, 1000), (200, 300), (60, 60)):
            got = sorted((str(r.doc_id), *list(r)[1:]) for r in score_corpus(d, chunk_words=chunk, shard_words=shard).collect())
            for a, b in zip(got, one, strict=True):
                assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-9 and abs(a[6] - b[6]) < 1e-9
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    contexts = Counter()
    for i, t, _ in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            contexts.update(["<>", *(t or "").lower().split()])
    assert [sorted(x.values()) for x in split] == [sorted(n for n in contexts.values() if n > limit) for limit in (1000, 300, 60)]
    assert len(split[2]) > len(split[0]) > 0


def test_held_out_texts_gain(spark):
    rows, d = corpus(spark, 900)
    r = score_corpus(d.where("doc_id < 500")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1] * 0.9


def test_empty(spark):
    assert score_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0
