"""Adjacency, degrees, seeds and expansions of a graph of triples (s, p, o)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions.hashing import order_key
from lodestar.operators.ranges import lazily_kept


def star_index(raw: DataFrame) -> DataFrame:
    """s, its triples (with repetitions) in order, and their number."""
    return raw.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("p", "o"))).alias("triples"), F.count("*").alias("n_triples"))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("s").agg(F.count("*").alias("n_out"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("o").agg(F.count("*").alias("n_in"))


def graph_stats(raw: DataFrame) -> DataFrame:
    return raw.agg(F.count("*").alias("n_triples"), F.countDistinct("s").alias("n_subjects"), F.countDistinct("o").alias("n_objects"), F.countDistinct("p").alias("n_predicates"))


def suitable_stars(raw: DataFrame, n: int) -> DataFrame:
    """Subjects with at least n triples, repetitions included, and their distinct predicates."""
    return raw.groupBy("s").agg(F.count("*").alias("star_size"), F.countDistinct("p").alias("unique_predicates")).where(F.col("star_size") >= n)


def predicate_combinations(triples: DataFrame, n: int, seeds: DataFrame | None = None) -> DataFrame:
    """All n-combinations of the distinct predicates of each subject, with their number of subjects and the
    smallest one. Combinations are made of a subject's sorted predicates by position, without a join."""
    if seeds is not None:
        triples = triples.join(seeds.select("s").distinct(), "s", "left_semi")
    of = triples.groupBy("s").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    combos = F.transform(F.col("ps"), lambda x, i: F.struct(F.array(x).alias("c"), i.alias("at")))
    for _ in range(n - 1):
        combos = F.flatten(F.transform(combos, lambda c: F.transform(F.filter(F.transform(F.col("ps"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: y["i"] > c["at"]), lambda y: F.struct(F.concat(c["c"], F.array(y["x"])).alias("c"), y["i"].alias("at")))))
    return of.select("s", F.explode(combos).alias("c")).select("s", F.col("c.c").alias("combo")).groupBy("combo").agg(F.count("*").alias("n_subjects"), F.min("s").alias("first_subject"))


def seed_predicates(triples: DataFrame, seeds: DataFrame) -> DataFrame:
    """s, p of the seeds' triples."""
    return triples.join(seeds.select("s").distinct(), "s", "left_semi").select("s", "p")


def random_top(df: DataFrame, k: int, seed, *cols: str) -> DataFrame:
    """k rows in an order by md5 of the seed and the columns: the same ones each time."""
    return df.orderBy(order_key(seed, *[F.col(c) for c in cols]), *cols).limit(k)


def random_top_distinct(df: DataFrame, k: int, seed, col: str) -> DataFrame:
    """random_top() of the distinct values of a column, without making them all distinct: rows whose md5 is below a bound that
    leaves about 8 k values. If fewer than k different ones are there, all values are taken."""
    key = order_key(seed, F.col(col))
    n = df.agg(F.approx_count_distinct(col)).first()[0]
    share = 8 * max(k, 100) / max(1, n)
    if share < 1:
        few = df.where(key < f"{int(share * (1 << 48)):012x}").select(col).distinct()
        if few.count() >= k:
            return random_top(few, k, seed, col)
    return random_top(df.select(col).distinct(), k, seed, col)


def dense_choice(df: DataFrame, draws: DataFrame, index: str) -> DataFrame:
    """Choice with replacement: rows of df, numbered densely in `index`, for each draw's position u in [0, 1)."""
    n = df.agg(F.count("*").alias("n"))
    return draws.crossJoin(F.broadcast(n)).withColumn(index, F.floor(F.col("u") * F.col("n"))).drop("n").join(df, index)


def simple_paths(edges: DataFrame, k: int, starts: DataFrame | None = None, cap: int | None = None, seed=0, where: Column | None = None) -> DataFrame:
    """Paths of k edges over distinct nodes: nodes, preds. cap: edges of each node that are tried, by md5."""
    e = edges if where is None else edges.where(where)
    if not cap:
        df = path_columns(e, k, starts)
        return df.select(F.array(*[f"n{i}" for i in range(k + 1)]).alias("nodes"), F.array(*[f"p{i}" for i in range(k)]).alias("preds"))
    first = e if starts is None else e.join(starts.select("s").distinct(), "s", "left_semi")
    first, step = capped(first, "s", cap, seed), capped(e, "s", cap, seed)
    df = first.where("s <> o").select(F.array("s", "o").alias("nodes"), F.array("p").alias("preds"), F.col("o").alias("at"))
    for _ in range(k - 1):
        df = df.join(step.select(F.col("s").alias("at"), "p", "o"), "at").where(~F.array_contains("nodes", F.col("o")))
        df = df.select(F.concat("nodes", F.array("o")).alias("nodes"), F.concat("preds", F.array("p")).alias("preds"), F.col("o").alias("at"))
    return df.drop("at")


def path_columns(edges: DataFrame, k: int, starts: DataFrame | None = None, first: DataFrame | None = None) -> DataFrame:
    """All paths of k edges over distinct nodes, as columns n0 to nk and p0 on. first: edges for the first hop, if not all."""
    # The last join sifts the hop before it, so only earlier hops are sifted by layers.
    steps = [*layers(edges, k - 1), edges] if k > 1 else [edges]
    df = steps[0] if first is None else first
    df = df if starts is None else df.join(starts.select("s").distinct(), "s", "left_semi")
    df = df.where("s <> o").select(F.col("s").alias("n0"), F.col("p").alias("p0"), F.col("o").alias("n1"))
    for i, step in enumerate(steps[1:], 1):
        new = [F.col("o") != F.col(f"n{j}") for j in range(i + 1)]
        df = df.join(step.select(F.col("s").alias(f"n{i}"), F.col("p").alias(f"p{i}"), "o"), f"n{i}").where(reduce(lambda a, b: a & b, new)).withColumnRenamed("o", f"n{i + 1}")
    return df


def _itself(node: Column) -> Column:
    return node


def _choice(seed, name: Callable[[Column], Column] = _itself) -> Column:
    """A walk's preference among edges of the node that it is at: the smallest first."""
    return order_key(seed, name(F.col("walk")), name(F.col("at")), F.col("p"), name(F.col("o")))


def random_walks(edges: DataFrame, k: int, walks: DataFrame, seed=0, name: Callable[[Column], Column] = _itself) -> DataFrame:
    """walk, nodes, preds of the walks (walk, s) that get to k edges over distinct nodes. At each hop a walk takes one edge by
    md5 among those to nodes that it hasn't been at and from which a walk of the other hops exists; it never goes back.
    A hop costs the edges of the nodes that walks are at, whatever k is. name: what md5 is given for a node."""
    df = walks.select("walk", F.array("s").alias("nodes"), F.array().cast("array<string>").alias("preds"), F.col("s").alias("at"))
    for layer in layers(edges, k):
        step = layer.select(F.col("s").alias("at"), "p", "o")
        df = df.join(step, "at").where(~F.array_contains("nodes", F.col("o")))
        best = df.groupBy("walk").agg(F.min(F.struct(_choice(seed, name).alias("key"), "p", "o", "nodes", "preds")).alias("b"))
        df = best.select("walk", F.concat("b.nodes", F.array("b.o")).alias("nodes"), F.concat("b.preds", F.array("b.p")).alias("preds"), F.col("b.o").alias("at"))
    return df.drop("at")


def first_paths(edges: DataFrame, k: int, walks: DataFrame, seed=0, name: Callable[[Column], Column] = _itself) -> DataFrame:
    """walk, nodes, preds of all walks (walk, s) from whose start a path of k edges over distinct nodes exists: the first one
    by the same preference at each hop, as a search that goes back finds it. Only walks that run into a dead end are
    searched for all their paths. name: what md5 is given for a node."""
    straight = random_walks(edges, k, walks, seed, name)
    straight = lazily_kept(straight)
    # A walk that was straight needs no search; nor does a start from which no walk of k edges goes.
    left = walks.join(straight.select("walk"), "walk", "left_anti")
    if left.isEmpty():
        return straight
    left = lazily_kept(left.join(layers(edges, k)[0].select("s").distinct(), "s", "left_semi"))
    if left.isEmpty():
        return straight
    df = left.select("walk", F.array("s").alias("nodes"), F.array().cast("array<string>").alias("preds"), F.array().cast("array<string>").alias("keys"), F.col("s").alias("at"))
    for layer in layers(edges, k):
        step = layer.select(F.col("s").alias("at"), "p", "o")
        df = df.join(step, "at").where(~F.array_contains("nodes", F.col("o")))
        df = df.select("walk", F.concat("nodes", F.array("o")).alias("nodes"), F.concat("preds", F.array("p")).alias("preds"), F.concat("keys", F.array(_choice(seed, name))).alias("keys"), F.col("o").alias("at"))
    best = df.groupBy("walk").agg(F.min(F.struct("keys", "nodes", "preds")).alias("b"))
    return straight.unionByName(best.select("walk", "b.nodes", "b.preds"))


def layers(edges: DataFrame, k: int) -> list[DataFrame]:
    """For each hop of a path of k edges, the edges after which a walk of the other hops exists: worked out from the last hop
    back by semi-joins, so that a start without such a walk is never expanded."""
    out = [edges]
    for _ in range(k - 1):
        out.insert(0, edges.join(out[0].select(F.col("s").alias("o")).distinct(), "o", "left_semi").select("s", "p", "o"))
    return out


def lookahead(edges: DataFrame, may: Callable[[Column], Column] | None = None) -> DataFrame:
    """Edges whose object has edges of its own. may: nodes for which it is false are known to have none."""
    some = edges if may is None else edges.where(may(F.col("o")))
    return some.join(edges.select(F.col("s").alias("o")).distinct(), "o", "left_semi").select("s", "p", "o")


def capped(edges: DataFrame, by: str, cap: int, seed, name: Callable[[Column], Column] = _itself) -> DataFrame:
    """At most cap edges of each node, the first by md5: the fan-out of hubs is bounded before any join. name: what md5 is
    given for a node."""
    key = order_key(seed, name(F.col("s")), F.col("p"), name(F.col("o")))
    w = W.partitionBy(by).orderBy(key, "s", "p", "o")
    return edges.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= cap).drop("_k")
