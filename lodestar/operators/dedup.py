"""Keys of queries: `hash`, a fast multiset key, and `wl`, exact up to renaming of variables and order.

hash sorts predicate=object of all patterns, ? for a variable object, and ignores the subject. wl is a canonical form:
variables are coloured by where they occur, colours are refined until they are stable, and what stays tied is
told apart by trial; of variables that can be swapped without any change one is tried.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Pattern = tuple[str, str, str]


def hash_key(triples: Column | str) -> Column:
    """Of an array of [s, p, o]."""
    part = lambda t: F.concat(F.get(t, F.lit(1)), F.lit("="), F.when(F.get(t, F.lit(2)).startswith("?"), "?").otherwise(F.get(t, F.lit(2))))
    return F.md5(F.array_join(F.sort_array(F.transform(triples, part)), "|"))


def hash_key_of(triples: list[Pattern]) -> str:
    return hashlib.md5("|".join(sorted(f"{p}={'?' if o.startswith('?') else o}" for _, p, o in triples)).encode()).hexdigest()


def _ranked(keys: dict[str, tuple]) -> dict[str, int]:
    order = {k: i for i, k in enumerate(sorted(set(keys.values())))}
    return {v: order[k] for v, k in keys.items()}


def _refined(triples: list[Pattern], colour: dict[str, int]) -> dict[str, int]:
    for _ in range(len(colour)):
        seen: dict[str, list] = {v: [] for v in colour}
        for t in triples:
            view = tuple((1, colour[x], "") if x in colour else (0, 0, x) for x in t)
            for v in set(t):
                if v in seen:
                    seen[v].append((tuple(x == v for x in t), view))
        new = _ranked({v: (colour[v], tuple(sorted(of))) for v, of in seen.items()})
        if len(set(new.values())) == len(set(colour.values())):
            return new
        colour = new
    return colour


def _renamed(triples: list[Pattern], names: dict[str, str]) -> tuple:
    return tuple(sorted(tuple(names.get(x, x) for x in t) for t in triples))


def _swappable(triples: list[Pattern], a: str, b: str) -> bool:
    return Counter(triples) == Counter(tuple(b if x == a else a if x == b else x for x in t) for t in triples)


def canonical(triples: list[Pattern]) -> tuple:
    """The same for two lists exactly if one is the other with variables renamed and patterns reordered.
    Repeated patterns count. A variable is told from a constant by its ?."""
    triples = [tuple(t) for t in triples]
    found = sorted({x for t in triples for x in t if x.startswith("?")})

    def search(colour: dict[str, int]) -> tuple:
        colour = _refined(triples, colour)
        classes: dict[int, list[str]] = {}
        for v, c in colour.items():
            classes.setdefault(c, []).append(v)
        tied = [c for c in sorted(classes) if len(classes[c]) > 1]
        if not tied:
            return _renamed(triples, {v: f"?{i}" for i, v in enumerate(sorted(colour, key=colour.__getitem__))})
        members = classes[min(tied, key=lambda c: (len(classes[c]), c))]
        tried: list[str] = []
        for v in members:
            if not any(_swappable(triples, v, u) for u in tried):
                tried.append(v)
        return min(search(_ranked({u: (c, u != v) for u, c in colour.items()})) for v in tried)

    return search(dict.fromkeys(found, 0)) if found else _renamed(triples, {})


def brute_canonical(triples: list[Pattern]) -> tuple:
    """The smallest form over all ways to number the variables."""
    found = sorted({x for t in triples for x in t if x.startswith("?")})
    return min(_renamed([tuple(t) for t in triples], {v: f"?{i}" for v, i in zip(found, p, strict=True)}) for p in permutations(range(len(found))))


def wl_key_of(triples: list[Pattern]) -> str:
    return hashlib.md5(repr(canonical(triples)).encode()).hexdigest()


def _wl_keys(triples: pd.Series) -> pd.Series:
    return triples.map(lambda ts: None if ts is None else wl_key_of([tuple(t) for t in ts]))


def wl_key(triples: Column | str) -> Column:
    return F.pandas_udf(_wl_keys, StringType())(triples)


def _brute_keys(triples: pd.Series) -> pd.Series:
    return triples.map(lambda ts: None if ts is None else repr(brute_canonical([tuple(t) for t in ts])))


def brute_key(triples: Column | str) -> Column:
    """The canonical form by trying all numberings of the variables: for few variables, to test the other with."""
    return F.pandas_udf(_brute_keys, StringType())(triples)


def dedup_key(triples: Column | str, method: str = "hash") -> Column:
    if method == "hash":
        return hash_key(triples)
    if method == "wl":
        return wl_key(triples)
    raise ValueError(f"method is hash or wl, not {method!r}")


def first_of_each(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key: the first in the order. Sums go before rows: hot keys are cut down in every task."""
    rest = [c for c in df.columns if c not in (key, *order)]
    best = df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in (*order, *rest)]).select(*df.columns)


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return df.join(seen.select(key).distinct(), key, "left_anti")


