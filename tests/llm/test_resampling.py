import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from lodestar.llm import resampling
from lodestar.llm.crc_algebra import run_crcs, shift, word_crcs
from lodestar.llm.resampling import BUCKETS, resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % BUCKETS for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, bench, percent, min_words):
    count = lambda texts: np.bincount([b for t in texts for b in features(t)[1]], minlength=BUCKETS)
    s, t = count([x for _, x in docs]), count(bench)
    gain = [math.floor(1000 * math.log((y + 1) * (int(s.sum()) + BUCKETS) / ((x + 1) * (int(t.sum()) + BUCKETS)))) for x, y in zip(s.tolist(), t.tolist(), strict=True)]
    rows = []
    for d, text in docs:
        w, f = features(text)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in rows]


def test_shift_and_runs_are_zlibs():
    rng = random.Random(2)
    words = [bytes(rng.randrange(256) for _ in range(n)) for n in [1, 2, 3, 5, 8, 63, 64, 65, 66, 127, 128, 129, 4096, 5000, 100_001] + [rng.randrange(1, 20) for _ in range(200)]]
    rng.shuffle(words)
    data, length = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    start = np.cumsum(length) - length
    crc = word_crcs(data, start, length)
    assert crc.tolist() == [zlib.crc32(w) for w in words]
    text = np.sort(np.array([rng.randrange(40) for _ in words]))
    for k, (found, at) in enumerate(run_crcs(crc, length, text, 4), 1):
        want = [(i, zlib.crc32(b" ".join(words[i : i + k]))) for i in range(len(words) - k + 1) if text[i] == text[i + k - 1]]
        assert list(zip(at.tolist(), found.tolist(), strict=True)) == want
    assert shift(np.array([zlib.crc32(b"x")], np.uint32), np.array([0])).tolist() == [zlib.crc32(b"x")]


def check(spark, docs, bench, percent=30, min_words=3, parts=3):
    d = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, rank int, row int, part string").repartition(parts)
    b = spark.createDataFrame([(i, t, 0) for i, t in enumerate(bench)], "item_id long, text string, bucket int")
    got = [tuple(r) for r in resample(d, b, percent=percent, min_words=min_words).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(brute(docs, bench, percent, min_words), key=key)


def test_edges(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice(["a", "B", "word", "éà", "漢字", "x9", "Long" * 30]) + rng.choice([" ", "-", ", ", "\n"]) for _ in range(n))
    docs = [(i, text(rng.randrange(30))) for i in range(60)] + [(100, None), (101, ""), (102, " .,"), (103, "one"), (104, "one two"), (None, text(9)), (105, "x" * 300_000), (106, text(9000))]
    check(spark, docs, [text(20), None, "", text(5)])
    check(spark, docs, [])
    check(spark, [], ["a b c"])
    check(spark, [(7, "a b c d")] * 9 + [(8, "a b c d")] * 9, ["a b"], percent=50)  # repeated rows and ties
    monkeypatch.setattr(resampling, "GROUP", 64)  # in this process only: pieces of one text
    data, offsets = resampling.bytes_of(__import__("pyarrow").array([t for _, t in docs]))
    n = np.zeros((len(docs), BUCKETS), np.int64)
    for found, of, *_ in resampling._pieces(data, offsets):
        np.add.at(n, (of, found), 1)
    for (_, t), row in zip(docs, n, strict=True):
        assert (row == np.bincount(features(t)[1], minlength=BUCKETS)).all()


@pytest.mark.parametrize("percent", [5, 100])
def test_query_against_brute_force(spark, percent):
    sf = "/root/testdata/sf0.001"
    d, b = spark.read.parquet(sf + "/documents.parquet"), spark.read.parquet(sf + "/benchmark.parquet")
    got = sorted(tuple(r) for r in resample(d, b, percent=percent).collect() if r["rank"] is not None)
    want = brute([(r.doc_id, r.text) for r in d.collect()], [r.text for r in b.collect()], percent, 20)
    assert got == sorted(r for r in want if r[4] is not None) and got
