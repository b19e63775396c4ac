import itertools
import random

from pyspark.sql import functions as F

from lodestar.llm.common import fold
from lodestar.llm.toxicity import CharModel, Reader, apart, decode, detect, lattice, learn, likely, restore, score, words_of

WORDS = {w: 10.0 for w in "the of and that idiot moron loser trash with are this is on clown good book".split()}


def test_viterbi_finds_the_cheapest_reading():
    m = CharModel(WORDS)
    for token in ("1d10t", "m0r0n", "l0$er", "iiidiiiot", "i.d.i.o.t", "tr@sh"):
        best = min(
            (sum(x[1] for x in path) + sum(m.cost(("^^^" + w)[i : i + 3], c) for i, c in enumerate(w + "$")), w)
            for path in itertools.product(*lattice(token))
            for w in ["".join(x[0] for x in path)]
        )
        assert decode(token, m) == best[1] and best[1] in WORDS, token


def test_restored_texts_hit():
    r = Reader(CharModel(WORDS), {"idiot": 0.9, "lose-": 0.8})
    for t in ("an 1d10t!", "AN IDIOT###", "i d i o t", "so i d 1 o t it is", "iiiddiot", "i-d-i-o-t", "id!ot,"):
        assert r.features(t) - {"#2"} == {"idiot"}, t
    assert r.features("the losers are l0sers") - {"#2"} == {"lose-"}
    for t in (None, "", "123 456", "4 5 6 7 8", "the book is good", "x" * 100000, "mail@host 10.0.0.1"):
        assert r.features(t) == set()
    assert r.text("An 1d10t is on, t r a s h it.") == "An idiot is on, trash it."
    assert r.text(None) is None


def test_long_tokens_are_read():
    r = Reader(CharModel(WORDS), {"idiot": 0.9, "moron": 0.9, "loser": 0.9})
    for t in ("i" + "d" * 30 + "iot", "this_book-is_good/1d10t/are-on", "on/that/clown-is-\"1d10t\"-with", "this_is_1d10t", "'good'and'that'1d10t'the'book'"):
        assert r.features(t) == {"idiot"}, t
    assert r.features("m0r0n/l0$er" + "/good" * 5000) == {"moron", "loser"}


def test_viterbi_is_complete():
    m = CharModel({w: 1.0 + i % 3 for i, w in enumerate(("isle", "still", "lil", "stilts", "bells", "gable", "lisle", "sails", "glib", "lobes", "silo", "tills"))})
    rng = random.Random(11)
    for _ in range(60):
        token = "".join(rng.choice("1|!6$5+8") for _ in range(6))
        best = min((sum(x[1] for x in path) + sum(m.cost(("^^^" + w)[i : i + 3], c) for i, c in enumerate(w + "$")), w) for path in itertools.product(*lattice(token)) for w in ["".join(x[0] for x in path)])
        assert decode(token, m) == best[1], token


def test_spaced_runs_are_cut_into_words():
    m = CharModel(WORDS | {w: 10.0 for w in ("a", "i", "what", "you", "bad", "fat")})
    r = Reader(m, {w: 0.9 for w in ("idiot", "moron", "fat", "trash")})
    for t, hits in (("what a m o r o n", {"moron"}), ("y o u i d i o t", {"idiot"}), ("so f a t is", {"fat"}), ("y o u f a t m 0 r o n", {"fat", "moron"}), ("i  d  i  o  t", {"idiot"}), ("w h a t a n i d i o t a n d w h a t t r a s h y o u a r e", {"idiot", "trash"})):
        assert r.features(t) - {"#2"} == hits, t
    assert r.features("y o u i d i o t , m o r o n") == r.features("you idiot moron")
    assert r.text("what a m o r o n") == "what a moron" and r.text("1 2 3 4") == "1 2 3 4"

    def cost(words):
        return sum(m.cost(("^^^" + w)[i : i + 3], c) for w in words for i, c in enumerate(w + "$"))

    for run in ("youid1", "badd", "tttheb"):
        best = min((sum(x[1] for x in path) + cost(w), w) for path in itertools.product(*apart(run)) if (w := "".join(x[0] for x in path).split()))
        assert words_of(run, m) == best[1], run


def test_doubled_letters_lines_and_halves():
    """All places where a letter can be doubled or a word be cut, and single letters on lines of their own."""
    words = ("idiot", "moron", "loser", "clown", "trash")
    r = Reader(CharModel(WORDS), {w: 0.9 for w in words} | {"boo-": 0.9})
    for w in words:
        for i in range(len(w)):
            assert r.features(f"the {w[:i]}{w[i]}{w[i:]}, that") == {w}, (w, i)
        for i in range(1, len(w)):
            assert r.features(f"the {w[:i]} {w[i:]}, that") == {w}, (w, i)
            assert r.features(f"the {w[:i]}\n{w[i:]}") == {w}, (w, i)
        assert r.features("the\n" + "\n".join(w) + "\nthat") == {w}
        assert r.text(f"The {w}{w[-1]} is") == f"The {w} is"
    assert r.features("boook")  == {"boo-"} and r.features("bboks") == set()  # a start counts only where the disguise is plain
    both = Reader(CharModel(WORDS | {"into": 1.0, "in": 10.0, "to": 10.0}), {"into": 0.9})
    assert both.features("in to") == set() and both.features("i nto") == {"into"}
    assert r.features("clown. i di") == {"clown"} and r.features("mo") == set() and r.text("Good book, tall") == "Good book, tall"


def corpus(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 6 == 0
        w = [f"w{rng.choice('abcdef')}{rng.choice('aeiou')}{rng.choice('xyz')}" for _ in range(60)]
        if bad:
            w[5] = rng.choice(["idiot", "moron", "qzk" + rng.choice("abcde") + rng.choice("fghij")])
            if fold_of(i) == 2:
                w[5] = rng.choice([w[5], w[5].replace("o", "0").replace("i", "1"), " ".join(w[5])])
        rows.append((i, " ".join(w), "x"))
        labels.append((i, 1, int(bad)))
    rows += [(2000, None, "x"), (2001, "", None), (2002, "idiot " * 20000, "x"), (7, rows[7][1], "x")]
    labels += [(None, 1, 1), (2000, 1, None), (9, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, predicted string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def fold_of(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 4


def test_held_out_and_odd_rows(spark):
    d, labels = corpus(spark)
    got = detect(d, labels).collect()
    assert len(got) == d.count()
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        if r.doc_id < 1500:
            assert r.predicted == (r.doc_id % 6 == 0), r
        else:
            assert r.predicted == (r.doc_id == 2002)
    kept = detect(d, labels, keep=True, suffix="_t")
    assert kept.columns == [*d.columns, "score_t", "predicted_t", "hits_t"]
    assert score(d, learn(d.limit(0), labels)).where("predicted = 1").count() == 0
    assert detect(d.limit(0), labels).count() == 0
    x = restore(d.where("doc_id in (2000, 2001)"), learn(d, labels)).collect()
    assert {(r.doc_id, r.text) for r in x} == {(2000, None), (2001, "")}


def test_labels_of_the_test_tables(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(sf + "/documents.parquet"), spark.read.parquet(sf + "/labels.parquet")
    out = detect(d, labels).join(labels, "doc_id").where(fold("doc_id", 4) == 2)
    r = out.agg(F.sum(F.expr("int(predicted = 1 and toxic = 1)")).alias("tp"), F.sum("predicted").alias("p"), F.sum("toxic").alias("t")).first()
    assert r.tp / r.p > 0.9 and r.tp / r.t > 0.8, r


def test_short_ways_change_nothing():
    """Tokens that need no search, or whose readings can't hit, have the features that the whole way gives."""
    from lodestar.llm import toxicity as of

    draw = random.Random(4)
    words = {"badly": 9.0, "buffoon": 5.0, "boot": 3.0, "fob": 1.0}
    lexicon = {"badly": 1.0, "bad-": 1.0, "buf-": 1.0, "fo": 1.0, "boto": 1.0}
    for model, lex in ((CharModel(words), lexicon), (CharModel(words), None), (None, lexicon), (None, None)):
        reader = Reader(model, lex, frozenset({"boot"}))
        tokens = ["".join(draw.choice("baduflyo@1.!(é²-") for _ in range(draw.randint(1, 7))) for _ in range(4000)]
        tokens += ["".join(c * draw.choice((1, 1, 2, 3)) for c in draw.choice(list(words))) + draw.choice(("", ".", "!)")) for _ in range(1000)]
        for t in tokens:
            plain, read = set(of._LETTERS.findall(t)), of._LETTERS.findall(reader.restored(t))
            whole = set() if of._disguised(of._stripped(t)) else set(read) - plain
            every = {f for w in plain.union(read) for f in ([w] if w in whole else of.starts(w))}
            assert set(reader._hits(t)) == {f for f in every if lex is None or f in lex}, t


def test_all_labelled_rows_are_learned_from(spark):
    n = 24_000
    ids = spark.range(n).withColumnRenamed("id", "doc_id")
    d = ids.selectExpr("doc_id", "concat('xa', doc_id, ' xb', doc_id, ' xc', doc_id, ' both', if(doc_id % 2 = 0, ' vile', '')) AS text")
    labels = ids.selectExpr("doc_id", "int(doc_id % 2 = 0) AS toxic")
    weights, words = learn(d, labels)
    assert words["both"] == n / 2 and words["vile"] == 20 * n / 2
    assert weights["vile"] > 0 and all(w >= 0 for f, w in weights.items() if f)


def test_texts_without_label_are_not_shuffled(spark):
    """The filter keeps every labelled row, null ids and ids of several texts too, few others, and stays within its bound."""
    from lodestar.llm import toxicity as of

    d = spark.range(20_000).selectExpr("id - 100 AS doc_id", "concat('text ', id) AS text").unionAll(spark.createDataFrame([(None, "x"), (0, "again")], "doc_id long, text string"))
    ids = spark.range(0, 20_000, 10).selectExpr("id AS doc_id")
    rows = {(r.doc_id, r.text) for r in d.join(ids, "doc_id").collect()}
    kept = likely(d, ids)
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert rows <= set(got) and len(got) == len(set(got)) < len(rows) + 20_000 / 12 and kept.columns == d.columns
    assert likely(d, ids.limit(0)).count() == 0
    most, of.MOST_BITS = of.MOST_BITS, 1 << 10
    try:
        assert rows <= {(r.doc_id, r.text) for r in likely(d, ids).collect()}
    finally:
        of.MOST_BITS = most
