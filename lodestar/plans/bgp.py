"""Basic graph patterns over a set of triples: solutions and exact counts.

Terms: `?name` is a variable, `<iri>` or anything else a constant. Counts are of solution mappings (homomorphisms).
Patterns fall into connected parts, whose counts are multiplied. In a part, patterns that hang on one other pattern
are summed up before they are joined: each is grouped by what it shares and only its sums go on, so that an acyclic
part is never enumerated. What is left, a cyclic core, is joined in an order in which each step shares a variable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.ranges import kept, lazily_kept
from lodestar.plans.batch import count_trees, decomposed
from lodestar.sources.store import Graph, coded

Pattern = tuple[str, str, str]
_COUNT = "decimal(38,0)"


def is_variable(term: str) -> bool:
    return term.startswith("?")


def constant(term: str) -> str:
    return term[1:-1] if term.startswith("<") and term.endswith(">") else term


def variables(pattern: Pattern) -> list[str]:
    return list(dict.fromkeys(t[1:] for t in pattern if is_variable(t)))


def scan(triples: DataFrame, pattern: Pattern) -> DataFrame:
    """Bindings of a pattern's variables. Constants and repeated variables are filters of the scan."""
    df, seen = triples, {}
    for col, term in zip("spo", pattern, strict=True):
        if not is_variable(term):
            df = df.where(F.col(col) == constant(term))
        elif term in seen:
            df = df.where(F.col(col) == F.col(seen[term]))
        else:
            seen[term] = col
    return df.select(*[F.col(c).alias(v[1:]) for v, c in seen.items()])


def connected(patterns: list[Pattern]) -> list[list[Pattern]]:
    parts: list[tuple[set[str], list[Pattern]]] = []
    for p in patterns:
        own, rest = (set(variables(p)), [p]), []
        for part in parts:
            if part[0] & own[0]:
                own = (part[0] | own[0], part[1] + own[1])
            else:
                rest.append(part)
        parts = [*rest, own]
    return [p for _, p in parts]


def count_relations(rows: list[tuple[set[str], DataFrame]], keep: str | None = None) -> DataFrame:
    """y, the sum of products of _n over all joined rows of connected relations (variables, rows with _n). keep: a
    variable that is never summed out, such as the query's number in a batch; there is a row for each of its values."""
    kept = {keep} if keep else set()
    rows = [_shared(r, kept.union(*(v for k, (v, _) in enumerate(rows) if k != i))) if len(rows) > 1 else r for i, r in enumerate(rows)]
    while len(rows) > 1:
        found = next(
            ((i, j, shared) for i, (v, _) in enumerate(rows) for shared in [v & (kept | set().union(*(w for k, (w, _) in enumerate(rows) if k != i)))] for j, (w, _) in enumerate(rows) if j != i and shared and shared <= w),
            None,
        )
        if not found:
            break
        i, j, shared = found
        sums = rows[i][1].groupBy(*sorted(shared)).agg(F.sum("_n").alias("_m"))
        rows[j] = (rows[j][0], _times(rows[j][1].join(sums, sorted(shared))))
        del rows[i]
    names, df = rows[0]
    rest = rows[1:]
    while rest:
        k = max(range(len(rest)), key=lambda i: len(rest[i][0] & names))
        more, right = rest.pop(k)
        df, names = _times(df.join(right.withColumnRenamed("_n", "_m"), sorted(names & more))), names | more
    total = F.coalesce(F.sum(F.col("_n").cast(_COUNT)), F.lit(0)).cast(_COUNT).alias("y")
    return df.groupBy(keep).agg(total) if keep else df.agg(total)


def _shared(relation: tuple[set[str], DataFrame], others: set[str]) -> tuple[set[str], DataFrame]:
    """A relation without the variables that no other one has: rows are summed up before any join."""
    names, df = relation
    if names <= others or not names & others:
        return relation
    return names & others, df.groupBy(*sorted(names & others)).agg(F.sum("_n").alias("_n"))


def _times(df: DataFrame) -> DataFrame:
    return df.withColumn("_n", (F.col("_n").cast(_COUNT) * F.col("_m").cast(_COUNT)).cast(_COUNT)).drop("_m")


def _part_count(triples: DataFrame, patterns: list[Pattern]) -> DataFrame:
    return count_relations([(set(variables(p)), scan(triples, p).withColumn("_n", F.lit(1).cast("bigint"))) for p in patterns])


def count(triples: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """One row, y: the number of solutions. triples must be distinct; no pattern has one solution."""
    parts = [_part_count(triples, p) for p in connected(patterns)]
    if not parts:
        return triples.sparkSession.range(1).select(F.lit(1).cast(_COUNT).alias("y"))

    def times(a: DataFrame, b: DataFrame) -> DataFrame:  # each side is one row
        return a.crossJoin(b.withColumnRenamed("y", "z")).select((F.col("y") * F.col("z")).cast(_COUNT).alias("y"))

    return reduce(times, parts)


def solutions(triples: DataFrame, patterns: list[Pattern], where: Column | None = None, only: set[str] | None = None) -> DataFrame:
    """All solutions, a column for each variable; parts that share nothing are combined with each other. only: the different
    solutions of these variables are wanted; others go as soon as no pattern left needs them, and rows become distinct there."""
    parts = []
    for patterns_of in connected(patterns):
        rest = sorted(patterns_of, key=lambda p: len(variables(p)))

        def rows(p: Pattern, others: list[Pattern]) -> tuple[DataFrame, set[str]]:
            got, names = scan(triples, p), set(variables(p))
            used = names if only is None else names & only.union(*(variables(q) for q in others))
            return (got, names) if used == names or not used else (got.select(*sorted(used)).distinct(), used)

        df, names = rows(rest[0], rest[1:])
        rest = rest[1:]
        while rest:
            k = max(range(len(rest)), key=lambda i: (len(names & set(variables(rest[i]))), -len(variables(rest[i]))))
            p = rest.pop(k)
            right, more = rows(p, [q for q in patterns_of if q is not p])
            df, names = df.join(right, sorted(names & more)), names | more
        parts.append(df)
    df = reduce(lambda a, b: a.crossJoin(b), parts)
    return df if where is None else df.where(where)


def exists(triples: DataFrame, patterns: list[Pattern], where: Column | None = None) -> bool:
    return not solutions(triples, patterns, where).limit(1).isEmpty()


def all_different(names: list[str]) -> Column:
    """The pairwise inequality of variables."""
    pairs = [F.col(a) != F.col(b) for i, a in enumerate(names) for b in names[i + 1 :]]
    return reduce(lambda a, b: a & b, pairs, F.lit(True))


def count_batch(triples: DataFrame | Graph, records: DataFrame, id_col: str = "qid", report: dict | None = None) -> DataFrame:
    """id_col, y (decimal(38,0)): exact counts of many queries, whatever their topologies. Those without cycles are worked out
    together from the branches that they share (batch.py); the others by topology. triples must be distinct."""
    g = triples if isinstance(triples, Graph) else coded(triples.select("s", "p", "o"))
    # Equal queries are one: samples of many starts mostly have no constant of their own.
    text = F.to_json(F.struct("triples"))
    asked = lazily_kept(records.select(id_col, F.when(F.col("triples").isNull(), F.concat(F.lit("null "), F.col(id_col).cast("string"))).otherwise(F.md5(text)).alias("_same"), "triples"))
    different = asked.groupBy("_same").agg(F.first("triples").alias("triples"))
    found = kept(decomposed(different, "_same"))
    out = count_trees(g, found, "_same", report)
    if not found.where("NOT tree").isEmpty():
        others = different.join(found.where("NOT tree").select("_same"), "_same", "left_semi")
        out = out.unionByName(count_cyclic(g.edges.select("s", "p", "o"), others, "_same"))
    return asked.select(id_col, "_same").join(out, "_same").select(id_col, "y")


def count_cyclic(triples: DataFrame, records: DataFrame, id_col: str = "qid") -> DataFrame:
    """id_col, y (decimal(38,0)): exact counts of many queries in one job for each topology. records: an id and `triples`, an
    array of [s, p, o]. Queries that are alike but for their constants are joined together; constants are columns. The number of
    topologies, not of queries, is what reaches the driver."""
    form = lambda t: F.array_join(F.transform(t, lambda x: F.array_join(F.transform(x, lambda y: F.when(y.startswith("?"), y).otherwise("=")), " ")), "|")
    ts = F.col("triples")
    q = records.select(F.col(id_col).alias("_q"), ts.alias("t")).withColumn("form", form(F.col("t")))
    forms = [r.form for r in q.select("form").distinct().collect()]
    parts = []
    for f in forms:
        own = q.where(F.col("form") == f)
        patterns = [tuple(x.split(" ")) for x in f.split("|")]
        rows: list[tuple[set[str], DataFrame]] = []
        for i, p in enumerate(patterns):
            free = [c for c, t in zip("spo", p, strict=True) if t == "="]
            marks = tuple(f"?_{c}" if t == "=" else t for c, t in zip("spo", p, strict=True))
            df = scan(triples, marks).withColumn("_n", F.lit(1).cast("bigint"))
            names = set(variables(p))
            if free:
                fixed = own.select("_q", *[F.regexp_replace(F.get(F.get("t", F.lit(i)), F.lit("spo".index(c))), "^<(.*)>$", "$1").alias(f"_{c}") for c in free])
                df, names = df.join(fixed, [f"_{c}" for c in free]).drop(*[f"_{c}" for c in free]), names | {"_q"}
            rows.append((names, df))
        counts = [count_relations(of, "_q" if any("_q" in v for v, _ in of) else None) for of in _parts(rows)]
        out = own.select("_q")
        for c in counts:  # a part without constants is one number for all
            c = c.withColumnRenamed("y", "z")
            out = (out.join(c, "_q", "left") if "_q" in c.columns else out.crossJoin(F.broadcast(c))).withColumn("y", (F.coalesce("z", F.lit(0)).cast(_COUNT) * (F.col("y") if "y" in out.columns else F.lit(1).cast(_COUNT))).cast(_COUNT)).drop("z")
        parts.append(out)
    if not parts:
        return records.select(F.col(id_col), F.lit(None).cast(_COUNT).alias("y")).limit(0)
    return reduce(DataFrame.unionByName, parts).select(F.col("_q").alias(id_col), "y")


def _parts(rows: list[tuple[set[str], DataFrame]]) -> list[list[tuple[set[str], DataFrame]]]:
    """Relations by shared variables; the query's number alone does not connect."""
    out: list[tuple[set[str], list]] = []
    for v, df in rows:
        own, rest = (set(v) - {"_q"}, [(v, df)]), []
        for part in out:
            if part[0] & own[0]:
                own = (part[0] | own[0], part[1] + own[1])
            else:
                rest.append(part)
        out = [*rest, own]
    return [x for _, x in out]
