"""Quality rules under weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0); how often it abstains in good and in bad documents is estimated
like its votes. The counts of all vote patterns of the corpus (at most
3 to the number of rules) go to the driver, where expectation-maximisation estimates for each class how often
each rule votes each way (the rules' accuracies) and the share of good documents. The posterior probability
of a document follows from its votes by a sum of logarithms, as a column.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import SPACE_SQL, written

_BLANKS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _without(text: Column, chars: str) -> Column:
    """The number of characters of text that are in chars."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and counts of each text (null: empty). Windows of three words are compared by 64-bit hashes within
    one text. Repeated rows stay; other columns are not read."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(_BLANKS))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    blanks = _without(text, _BLANKS)
    a = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_SQL)).alias("words"),
        (F.length(text) - blanks).cast("long").alias("word_chars"),
        _without(text, "#*$%&|<>").alias("n_symbols"),
        _without(text, _UPPER).alias("n_upper"),
        _without(text, "!").alias("n_shouts"),
        _without(text, ".?").alias("n_ends"),
        lines.alias("lines"),
    )
    n = F.size("words")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    b = a.select("*", n.cast("long").alias("n_words"), windows.alias("windows"))
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h: bigint, i: int>>")
    c = b.select("*", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed).otherwise(none).alias("placed"))
    twice = F.filter("placed", lambda x, i: (F.get("placed", i - 1)["h"] == x["h"]) | F.coalesce(F.get("placed", i + 1)["h"] == x["h"], F.lit(False)))
    at = F.sort_array(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    cover = F.aggregate(at, start, lambda s, p: F.struct((s["n"] + p + 3 - F.greatest(p, s["end"])).alias("n"), (p + 3).alias("end")))
    return c.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("placed") > 0, cover["n"]).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        "n_upper",
        "n_shouts",
        "n_ends",
    )


def _vote(ratio: Column, bad: Callable[[Column], Column], good: Callable[[Column], Column]) -> Column:
    return F.when(F.col("n_words") == 0, 0).when(bad(ratio), -1).when(good(ratio), 1).otherwise(0)


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def rules() -> dict[str, Column]:
    """Votes from the columns of features(). Faults vote bad or abstain; the last two also vote good. A text
    without words gets abstentions only."""
    never = lambda r: F.lit(False)
    return {
        "symbols": _vote(_share("n_symbols", "word_chars"), lambda r: r > 0.05, never),
        "symbol_words": _vote(_share("n_symbols", "n_words"), lambda r: r > 0.1, never),
        "capitals": _vote(_share("n_upper", "word_chars"), lambda r: r > 0.3, never),
        "repeats": _vote(_share("n_repeat_words", "n_words"), lambda r: r > 0.35, never),
        "shouts": _vote(_share("n_shouts", "n_words"), lambda r: r > 0.25, never),
        "dup_lines": _vote(_share("n_dup_lines", "n_lines"), lambda r: r > 0.6, never),
        "word_length": _vote(_share("word_chars", "n_words"), lambda r: (r > 9) | (r < 2.5), lambda r: (r > 3) & (r < 7.5)),
        "sentences": _vote(_share("n_ends", "n_words"), lambda r: (r < 0.002) | (r > 0.5), lambda r: (r > 0.02) & (r < 0.4)),
    }


#: How often a rule is taken to vote so, in good and in bad documents, before any data: a fault is rare in
#: good documents, and no fault is in all bad ones, since documents are bad in different ways.
BEFORE = {1: (0.6, 0.3), -1: (0.01, 0.4), 0: (0.39, 0.3)}


def estimate(patterns: list[tuple[tuple[int, ...], int]], steps: int = 500, prior: float = 0.8, pseudo: float = 10.0) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Expectation-maximisation over (votes, count): the share of good documents and, for each rule and vote, abstentions
    among them, its probabilities in good and bad documents. BEFORE counts as `pseudo` documents of each class, however
    many there are; the first belief, that a bad vote mostly means a bad document, tells the classes apart."""
    if not patterns:
        return prior, []
    k, total = len(patterns[0][0]), sum(n for _, n in patterns)
    belief = [0.2 if -1 in votes else 0.95 for votes, _ in patterns]
    share, table = prior, []
    for _ in range(steps):
        good = sum(p * n for p, (_, n) in zip(belief, patterns, strict=True))
        share = (good + pseudo * prior) / (total + pseudo)
        table = []
        for r in range(k):
            sums = {v: [pseudo * x for x in BEFORE[v]] for v in (-1, 0, 1)}
            for p, (votes, n) in zip(belief, patterns, strict=True):
                sums[votes[r]][0] += p * n
                sums[votes[r]][1] += (1 - p) * n
            whole = [sum(x[i] for x in sums.values()) for i in (0, 1)]
            table.append({v: (x[0] / whole[0], x[1] / whole[1]) for v, x in sums.items()})
        new = [posterior(votes, share, table) for votes, _ in patterns]
        moved = max(abs(a - b) for a, b in zip(belief, new, strict=True))
        belief = new
        if moved < 1e-9:
            break
    return share, table


def posterior(votes: tuple[int, ...], share: float, table: list[dict[int, tuple[float, float]]]) -> float:
    """The probability that a document with these votes is good."""
    z = math.log(share / (1 - share)) + sum(math.log(t[v][0] / t[v][1]) for t, v in zip(table, votes, strict=True))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Counts, base_failed, votes, quality (the posterior probability) and kept for each row of docs; a null text has no words.
    Repeated rows stay and count as often; other columns are not read, whatever their names; an empty table gives no rows.
    The counts are written once, so texts are read once."""
    f = written(features(docs, id_col, text_col), "quality")
    votes = rules()
    voted = f.select("*", *[v.alias(f"vote_{k}") for k, v in votes.items()])
    names = [f"vote_{k}" for k in votes]
    share, table = estimate([(tuple(r[:-1]), r[-1]) for r in voted.groupBy(*names).count().collect()])
    odds = F.lit(math.log(share / (1 - share)))
    for name, t in zip(names, table, strict=False):
        terms = {v: math.log(a / b) for v, (a, b) in t.items()}
        odds = odds + F.when(F.col(name) == 1, terms[1]).when(F.col(name) == -1, terms[-1]).otherwise(terms[0])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    quality = 1 / (1 + F.exp(-odds))
    return voted.select("*", failed.alias("base_failed"), quality.alias("quality"), (~failed & (quality >= threshold)).alias("kept"))
