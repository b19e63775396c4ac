import random
import re

from lodestar.llm.quality import estimate, features, rules, score

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {j for i, x in enumerate(tri) if tri.count(x) > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_counts_against_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "\n\n", "a", "a b c a b c", "x\x0bx\x0cy", "é é é é 漢", " lead #*$ trail ", "a\na\n \n a\na"]
    texts += [rng.choice(["", " "]) + "".join(rng.choice(["a", "b", "C!", "|", "é"]) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(rng.randrange(80))) for _ in range(200)]
    d = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(5, texts[5], 0)], "doc_id long, text string, words int").repartition(3)
    got = features(d).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id]), texts[r.doc_id]


def test_em_finds_the_unreliable_rule():
    rng = random.Random(1)
    rows = {}
    for _ in range(5000):
        good = rng.random() < 0.8
        votes = tuple((1 if good else -1) if rng.random() < acc else (-1 if good else 1) for acc in (0.95, 0.9, 0.85, 0.5))
        rows[votes] = rows.get(votes, 0) + 1
    for times in (1, 1000):
        share, table = estimate([(v, n * times) for v, n in rows.items()])
        assert abs(share - 0.8) < 0.05
        for rule, accuracy in zip(table, (0.95, 0.9, 0.85, 0.5), strict=True):
            assert abs(rule[1][0] - accuracy) < 0.05 and abs(rule[-1][1] - accuracy) < 0.05, (times, rule)
    assert estimate([]) == (0.8, [])


def test_verdicts_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    r = score(spark.read.parquet(sf + "/documents.parquet")).join(spark.read.parquet(sf + "/labels.parquet").withColumnRenamed("quality", "label"), "doc_id").collect()
    right = sum((x["quality"] >= 0.5) == bool(x["label"]) for x in r)
    assert right / len(r) > 0.95, right / len(r)
    assert all(not x.kept for x in r if x.base_failed)


def test_query_against_brute_force(spark):
    """The posterior of the query by a plain expectation-maximisation over single documents."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in score(d).collect()}
    docs = list(got.values())
    names = [f"vote_{k}" for k in rules()]
    votes = [tuple(r[k] for k in names) for r in docs]
    before = {1: (0.6, 0.3), -1: (0.01, 0.4), 0: (0.39, 0.3)}
    p = [0.2 if -1 in v else 0.95 for v in votes]
    for _ in range(500):
        share = (sum(p) + 8) / (len(p) + 10)
        like = [[1.0] * len(p), [1.0] * len(p)]
        for k in range(len(names)):
            for c in (0, 1):
                w = p if c == 0 else [1 - x for x in p]
                rate = {v: (sum(x for x, y in zip(w, votes, strict=True) if y[k] == v) + 10 * before[v][c]) / (sum(w) + 10 * sum(b[c] for b in before.values())) for v in before}
                like[c] = [x * rate[y[k]] for x, y in zip(like[c], votes, strict=True)]
        new = [share * a / (share * a + (1 - share) * b) for a, b in zip(*like, strict=True)]
        done, p = max(abs(a - b) for a, b in zip(p, new, strict=True)) < 1e-9, new
        if done:
            break
    for r, q in zip(docs, p, strict=True):
        assert abs(r.quality - q) < 1e-6
        w = r.n_words
        assert r.base_failed == (w < 50 or 100 * r.n_repeat_words > 50 * w) and r.kept == (not r.base_failed and r.quality >= 0.5)


def test_odd_rows(spark):
    rows = [(1, "some words of a text, and more of them. " * 9, 7, "x"), (1, "some words of a text, and more of them. " * 9, 7, "x"), (2, None, 0, None), (None, "### $$$ " * 40, 1, ""), (3, "word " * 200_000, 2, "y")]
    d = spark.createDataFrame(rows, "doc_id long, text string, words int, vote_symbols string").repartition(2)
    got = score(d).collect()
    assert len(got) == 5 and sum(r.doc_id == 1 for r in got) == 2
    assert {r.doc_id: r.n_words for r in got} == {1: 81, 2: 0, None: 80, 3: 200_000}


def test_empty(spark):
    assert score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    r = score(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert [(x.n_words, x.base_failed, x.kept) for x in r] == [(0, True, False)]
