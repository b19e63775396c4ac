"""The part of SPARQL that query generators send: SELECT, COUNT and ASK over basic graph patterns.

SELECT [DISTINCT] (* | ?v ... | (COUNT(*) AS ?c) | COUNT(*) AS ?c) [FROM <g>] WHERE { patterns, FILTER, VALUES }
[ORDER BY [ASC(]?v[)] ... | RAND] [LIMIT n], and ASK WHERE { ... }. A filter has comparisons of variables joined by &&.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.hashing import order_key
from lodestar.plans import bgp

_TERM = re.compile(r"""\s*(<[^>]*>|\?\w+|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^<[^>]*>)?|'(?:[^'\\]|\\.)*'|_:\w+|[\w:.+-]*[\w+-]|\.|;|[{}()])""")
_COMPARE = re.compile(r"\(?\s*(\?\w+)\s*(!=|<=|>=|<|>|=)\s*(\?\w+)\s*\)?")
_OPERATORS = {"!=": lambda a, b: a != b, "=": lambda a, b: a == b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


@dataclass
class Query:
    patterns: list[bgp.Pattern]
    form: str = "select"
    variables: list[str] = field(default_factory=list)
    distinct: bool = False
    count_as: str | None = None
    graph: str | None = None
    filters: list[tuple[str, str, str]] = field(default_factory=list)
    values: dict[str, list[str]] = field(default_factory=dict)
    order: list[str] = field(default_factory=list)
    random: bool = False
    limit: int | None = None


def terms(text: str) -> list[str]:
    """Terms of a group of patterns; white space inside a literal or an IRI doesn't part it."""
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TERM.match(text, at)
        if not m:
            raise ValueError(f"can't read {text[at : at + 40]!r}")
        out.append(m[1])
        at = m.end()
        while at < len(text) and text[at].isspace():
            at += 1
    return out


def parse(text: str) -> Query:
    """Raises ValueError for what is beyond this part of the language."""
    m = re.fullmatch(r"(?is)\s*(select|ask)\b(.*?)\bwhere\s*\{(.*)\}(.*)", text.strip())
    if not m:
        raise ValueError("neither SELECT nor ASK with WHERE { }")
    head, body, tail = m[2], m[3], m[4]
    q = Query([], m[1].lower())
    if g := re.search(r"(?i)\bfrom\s+<([^>]*)>", head):
        q.graph = g[1]
        head = head[: g.start()]
    q.distinct = bool(re.match(r"(?i)\s*distinct\b", head))
    if c := re.search(r"(?i)count\s*\(\s*\*\s*\)\s*as\s+\?(\w+)", head):
        q.count_as = c[1]
    else:
        q.variables = re.findall(r"\?(\w+)", head)

    def take(rx: str, use) -> None:
        nonlocal body
        for x in re.finditer(rx, body):
            use(x)
        body = re.sub(rx, " ", body)

    def condition(x) -> None:
        for part in x[1].split("&&"):
            c = _COMPARE.fullmatch(part.strip())
            if not c:
                raise ValueError(f"can't read the filter {part.strip()!r}")
            q.filters.append((c[1][1:], c[2], c[3][1:]))

    take(r"(?i)\bfilter\s*\(((?:[^()]|\([^()]*\))*)\)", condition)
    take(r"(?i)\bvalues\s*\(?\s*\?(\w+)\s*\)?\s*\{([^}]*)\}", lambda x: q.values.update({x[1]: [bgp.constant(t) for t in terms(x[2]) if t not in "()"]}))
    row: list[str] = []
    for t in [*terms(body), "."]:
        if t == ".":
            if row and len(row) != 3:
                raise ValueError(f"a pattern has three terms: {row}")
            if row:
                q.patterns.append((row[0], row[1], row[2]))
            row = []
        elif t in "{};()":
            raise ValueError(f"{t!r} in a group is not supported")
        else:
            row.append(t)
    if o := re.search(r"(?i)order\s+by\s+(.*?)(?:\blimit\b|$)", tail, re.S):
        q.random = "rnd" in o[1].lower() or "rand" in o[1].lower()
        q.order = [] if q.random else re.findall(r"\?(\w+)", o[1])
    if n := re.search(r"(?i)\blimit\s+(\d+)", tail):
        q.limit = int(n[1])
    return q


def _condition(q: Query) -> Column | None:
    parts = [_OPERATORS[op](F.col(a), F.col(b)) for a, op, b in q.filters]
    return reduce(lambda a, b: a & b, parts) if parts else None


def run(triples: DataFrame, query: str | Query, seed: int = 0, is_set: bool = False) -> DataFrame:
    """Rows of a SELECT, or one boolean row of an ASK. A graph filters the column g, where there is one. Random order
    is by md5 of the seed and the row, so it can be repeated; LIMIT without an order takes the first rows in that way. is_set: no triple is repeated, as
    in a graph that is stored, so none is looked for."""
    q = parse(query) if isinstance(query, str) else query
    if q.graph is not None and "g" in triples.columns:
        triples = triples.where(F.col("g") == q.graph)
    triples = triples.select("s", "p", "o")
    triples = triples if is_set else triples.distinct()
    if q.count_as and not q.filters and not q.values:
        return bgp.count(triples, q.patterns).select(F.col("y").cast("bigint").alias(q.count_as))
    only = {*q.variables, *q.values, *(v for a, _, b in q.filters for v in (a, b))} if q.distinct and q.variables and q.form != "ask" and not q.count_as else None
    df = bgp.solutions(triples, q.patterns, _condition(q), only)
    for v, terms_of in q.values.items():
        df = df.join(F.broadcast(triples.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(terms_of)], f"{v} string")), v, "left_semi")
    if q.form == "ask":
        return df.limit(1).agg((F.count("*") > 0).alias("boolean"))
    if q.count_as:
        return df.agg(F.count("*").alias(q.count_as))
    df = df.select(*(q.variables or sorted(df.columns)))
    df = df.distinct() if q.distinct else df
    if q.order:
        df = df.orderBy(*q.order)
    elif q.random or q.limit is not None:
        df = df.orderBy(order_key(seed, *[F.col(c) for c in df.columns]), *df.columns)
    return df if q.limit is None else df.limit(q.limit)
