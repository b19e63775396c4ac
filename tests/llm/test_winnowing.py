import random
import re

import numpy as np
import pyarrow as pa

from lodestar.llm import wordhash, winnowing
from lodestar.llm.winnowing import brute_force, contamination, digest


def test_words_and_hashes(monkeypatch):
    monkeypatch.setattr(wordhash, "STRETCH", 7)
    rng = random.Random(5)
    texts = ["", "ab", "cd ef", "x" * 40, " lead", "trail ", "é漢字 A-b", *["".join(rng.choice("aB é\n-1漢") for _ in range(rng.randrange(30))) for _ in range(300)]]
    for kind, rx in ((wordhash.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (wordhash.ALPHANUMERIC, winnowing.WORDS.pattern)):
        data, offsets = wordhash.bytes_of(pa.array(texts))
        w = wordhash.Words(data, offsets, kind)
        low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
        want = [re.findall(rx, low(t)) for t in texts]
        flat = [x for ws in want for x in ws]
        assert w.counts.tolist() == [len(x) for x in want]
        assert [low(data[a:b].tobytes().decode()) for a, b in zip(w.start, w.end, strict=True)] == flat
        seen = {}
        for x, h in zip(flat, w.hash.tolist(), strict=True):
            assert seen.setdefault(x, h) == h
        assert len(set(seen.values())) == len(seen)


def case():
    rng = random.Random(11)
    word = lambda: rng.choice(["the", "of", "and", "Ab", "été", "x1", "q", "zz"])
    bench = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(8)]
    bench += [(90, None), (91, "?? !!"), (92, "same " * 40), (93, bench[3][1]), (7, "one two three four five six seven eight nine ten eleven")]
    docs = []
    for i in range(150):
        w = [f"n{rng.randrange(10**6)}" if rng.random() < 0.5 else word() for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            x = (rng.choice(bench)[1] or "").split()
            w[at:at] = x[rng.randrange(3) :]
        docs.append((i, rng.choice([" ", "\n", ", ", "--"]).join(w)))
    docs += [(200, None), (201, ""), (202, "Same, " * 500), (5, docs[5][1]), (203, "ONE two, three-four five six seven eight nine TEN"), (204, "one two three four five six seven eight nine")]
    return docs, bench


def test_against_brute_force(spark):
    docs, bench = case()
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, item_id string").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = sorted(brute_force(docs, bench))
    assert sum(x[2] > 0 for x in want) > 40 and sum(x[2] == 0 for x in want) > 10
    assert sorted(map(tuple, digest(contamination(d, b)).collect())) == want
    assert sorted(map(tuple, digest(contamination(d, b, block_words=30)).collect())) == want
    assert contamination(d, b.limit(0)).where("n_hit > 0 or size(items) > 0").count() == 0
    assert contamination(d.limit(0), b).count() == 0
    r = contamination(d.where("doc_id = 203"), b).first()
    assert r.spans[0].first == 0 and r.spans[-1].end == 10 and r.item_id == "z"


def test_fingerprints_cover_every_window():
    h = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64)
    whole = set(winnowing.smallest(h).tolist())
    for i in range(0, 490):
        assert winnowing.smallest(h[i : i + 10]).tolist()[0] in whole
