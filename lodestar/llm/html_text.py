"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page becomes a sequence of tags and of text blocks. Words score by their surroundings (innermost block tag,
in a link or not, inside of page furniture or not) and tags score below zero; one linear scan finds the
contiguous stretch with the largest sum, which is the content region. The weights are log odds from labelled pages:
those that mark their content with <article> or <main>, counted on a bounded sample.

What lies inside of the region and has a weight below zero itself is left out: elements that never hold main text, and
those whose class, id or role has such a weight. A name's weight comes from the labelled pages too; it starts below zero
for names that say what they are (adverts, forms, notices, readers' comments), which labels can't tell, since an
article's element holds them as well. An id of a section, a heading or a paragraph is an anchor and says nothing, but for
readers' comments; a paragraph or heading of several classes is furniture only if all of them are.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import prepare

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|annotation|annotation-xml|canvas|video|audio)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BLOCK = frozenset("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
_ENDS_P = _BLOCK - {"html", "head", "body", "title", "option", "button"}
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that never hold main text, and those that don't outside of an article.
_FURNITURE = frozenset("aside button dialog footer form head menu nav search title".split())
_FURNITURE_OUTSIDE = frozenset(("header",))
#: Words in names of page furniture, and words that names of anything have. A name is one of furniture if all its
#: words are among these and one of them is among the first; `related-work` is not.
_FURNITURE_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies copyright disqus footer gdpr legal login masthead menu modal "
    "nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
_ANY_NAMES = frozenset("area article articles bar block bottom box btn button buttons center container form global holder icon icons inner item items left link links list main outer page pages panel post posts primary reader readers right row secondary section site slot small stories sub thread top unit user users wrap wrapper".split())
_COMMENT_NAMES = frozenset("comment comments disqus replies reply respond".split())
_CONTENT = frozenset(("article", "main"))
#: Elements whose id is an anchor to link to.
_ANCHORED = frozenset("article blockquote dd details dt figcaption figure h1 h2 h3 h4 h5 h6 li p pre section summary".split())


@lru_cache(10_000)
def names_of(value: str) -> tuple[str, ...]:
    return tuple(x for x in value.split() if x)


@lru_cache(10_000)
def is_furniture(name: str) -> bool:
    """An anchor's name, which starts with #, says so only of readers' comments."""
    parts = {x.lower() for x in _NAME_PART.findall(name)}
    return bool(parts & (_COMMENT_NAMES if name[0] == "#" else _FURNITURE_NAMES)) and parts <= _FURNITURE_NAMES | _ANY_NAMES


def own_names(element: str, attributes: str) -> set[str]:
    """The names in the class, id and role of an element."""
    own: set[str] = set()
    for m in _NAMED.finditer(attributes):
        names = names_of(m[2] or m[3] or m[4] or "")
        if m[1].lower() == "id" and element in _ANCHORED:
            own.update("#" + n for n in names)
        elif element not in _RUNNING or all(map(is_furniture, names)):
            own.update(names)
        else:
            own.update(n for n in names if not is_furniture(n))
    return own


@dataclass
class Block:
    tag: str
    names: frozenset[str]
    furniture: bool
    in_content: bool
    chunks: list[str] = field(default_factory=list)
    plain: int = 0
    linked: int = 0

    @property
    def text(self) -> str:
        return " ".join(html_lib.unescape("".join(self.chunks)).split())


def parse(page: str) -> list:
    """Tokens: a Block, or a tag as its name, with / before it where it ends an element, the names of what it stands in or
    begins or ends, and whether that is furniture. The tags of a formula are none: it is text."""
    tokens: list = []
    stack: list[tuple[str, frozenset[str], bool]] = []  # name, names of it and of what holds it, furniture
    links = 0
    formula = False
    block: Block | None = None

    def add(text: str) -> None:
        nonlocal block
        n = len(text.split())
        if block is None:
            if not n:
                return
            content = any(x[0] in _CONTENT for x in stack)
            block = Block(stack[-1][0] if stack else "body", stack[-1][1] if stack else frozenset(), any(x[2] for x in stack), content)
            tokens.append(block)
        block.chunks.append(text)
        if links:
            block.linked += n
        else:
            block.plain += n

    def close(upto: int) -> None:
        nonlocal block
        block = None
        del stack[upto:]

    def tag(name: str) -> None:
        tokens.append((name, stack[-1][1] if stack else frozenset(), any(x[2] for x in stack)))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        end, name, rest = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not name:
            continue
        name = name.lower()
        if name == "a":
            links = max(0, links - 1) if end else 1
        elif name == "br" and block is not None:
            block.chunks.append(" ")
        elif name == "math" or name in _BLOCK:
            formula = name == "math" and not end
        if end and name in _BLOCK or name not in _BLOCK and not formula:
            tag("/" + name if end else name)
        if name not in _BLOCK:
            continue
        if end:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            block, links = None, 0
            continue
        if name in _ENDS_P and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if name in _SAME and stack and stack[-1][0] in _SAME[name]:
            close(len(stack) - 1)
        block = None
        if name == "body":
            close(next((i for i, x in enumerate(stack) if x[0] == "head"), len(stack)))
        if name == "hr":
            tag(name)
            continue
        inside = any(x[0] in _CONTENT for x in stack)
        names = stack[-1][1] if stack else frozenset()
        if rest and name not in ("html", "body", "main"):
            own = own_names(name, rest)
            if name == "article":  # it says itself what it is, unless it is one of many under an article
                own = {n for n in own if inside and is_furniture(n)}
            elif not inside and any("header" in map(str.lower, _NAME_PART.findall(n)) for n in own):
                own.add("masthead")
            names = names | own
        stack.append((name, names, name in _FURNITURE or (name in _FURNITURE_OUTSIDE and not inside)))
        tag(name)
    if at < len(page):
        add(page[at:])
    return tokens


#: A word's weight before any labelled page: plain, in a link, in a link of running text, in furniture; a name's, if it isn't one of furniture and if
#: it is; a tag's, if it is set in running text, if it is not, if it ends such an element, and in furniture.
WORD, LINKED, QUOTED, FURNITURE, NAME, NAMED, TAG, BOX, BOX_END, HOLE = 1.0, -0.5, 0.25, -0.25, 1.0, -2.5, -0.1, -0.5, -1.5, -0.02
#: How far log odds may move weights, and words as which a name's weight before any page counts.
REACH, PSEUDO = 2.0, 50.0
_RUNNING = frozenset("blockquote dd figcaption h1 h2 h3 h4 h5 h6 p".split())
_BOXES = frozenset("address article aside body center details dialog dir div fieldset footer head header html main menu nav search section table title".split())


def before(kind: tuple) -> float:
    """The weight of a kind without labelled pages: ("tag", token), ("name", name) or (tag, in a link, in furniture)."""
    if kind[0] == "tag":
        return TAG if kind[1].lstrip("/") not in _BOXES else BOX_END if kind[1][0] == "/" else BOX
    if kind[0] == "name":
        return NAMED if is_furniture(kind[1]) else NAME
    return FURNITURE if kind[2] else WORD if not kind[1] else QUOTED if kind[0] in _RUNNING else LINKED


def weigh(counts: Counter) -> dict[tuple, float]:
    """Weights from (kind, inside the marked content or not) -> count. Tags, and words in furniture, stay below zero; plain
    words stay above it."""
    kinds = {k for k, _ in counts}
    totals = {w: {s: sum(counts[k, s] for k in kinds if (k[0] == "tag") == w and k[0] != "name") + 1 for s in (True, False)} for w in (True, False)}
    base = totals[False][True] / (totals[False][True] + totals[False][False])
    out = {}
    for kind in kinds:
        a, b, t = counts[kind, True], counts[kind, False], totals[kind[0] == "tag"]
        if kind[0] == "name":
            p = (a + PSEUDO * base) / (a + b + PSEUDO)
            odds = math.log(p / (1 - p)) - math.log(base / (1 - base))
        else:
            odds = math.log((a + 1) / t[True]) - math.log((b + 1) / t[False])
        shift, start = max(-REACH, min(REACH, odds)), before(kind)
        if kind[0] == "tag":
            out[kind] = min(-0.05, start + 0.5 * shift)
        elif kind[0] == "name":
            out[kind] = start + shift
        else:
            out[kind] = min(-0.05, start + 0.4 * shift) if kind[2] else start + 0.4 * shift
    return out


def observe(page: str, counts: Counter) -> None:
    """Adds a labelled page: one with a marked content element that holds text."""
    tokens = parse(page)
    if not any(isinstance(t, Block) and t.in_content for t in tokens):
        return
    inside = False
    for t in tokens:
        if isinstance(t, Block):
            inside = t.in_content
            counts[(t.tag, False, t.furniture), inside] += t.plain
            counts[(t.tag, True, t.furniture), inside] += t.linked
            for n in t.names:
                counts[("name", n), inside] += t.plain + t.linked
        else:
            counts[("tag", t[0]), inside and t[0][1:] not in _CONTENT] += 1


def extract(page: str | None, weights: dict[tuple, float]) -> str:
    """The main text: the blocks of the best stretch but those of furniture. No text, or none that scores above zero, gives
    an empty string. Of equally good stretches the first is taken."""
    if not page:
        return ""
    of = lambda kind: weights[kind] if kind in weights else before(kind)
    tokens = parse(page)
    best = total = 0.0
    start, span = 0, None
    out: set[int] = set()
    for i, t in enumerate(tokens):
        if isinstance(t, Block):
            bad = t.furniture or any(of(("name", n)) < 0 for n in t.names)
            total += t.plain * of((t.tag, False, bad)) + t.linked * of((t.tag, True, bad))
            if bad:
                out.add(i)
        else:
            total += HOLE if t[2] or any(of(("name", n)) < 0 for n in t[1]) else of(("tag", t[0]))
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, span = total, (start, i)
    if span is None:
        return ""
    return "\n".join(x for i in range(span[0], span[1] + 1) if i not in out and isinstance(tokens[i], Block) and (x := tokens[i].text))


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = 2000) -> dict[tuple, float]:
    """Weights from about `sample` pages that have an <article> or <main>, taken by the hash of their id. Kinds are the
    tags and names in these pages; where no page is labelled the weights before() hold."""
    rows = pages.where(F.col(html_col).rlike("(?i)<(article|main)\\b"))
    share = min(1.0, sample / max(1, rows.count()))
    rows = rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20)).select(html_col)

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for page in b.column(0).to_pylist():
                observe(page, counts)
        rows = [(*k, i, n) for (k, i), n in counts.items()]
        keys = [repr(r[:-2]) for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([r[-2] for r in rows], pa.bool_()), pa.array([r[-1] for r in rows], pa.int64())], ["kind", "inside", "n"])

    import ast

    found = rows.mapInArrow(run, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()
    return weigh(Counter({(ast.literal_eval(r.kind), r.inside): r.n for r in found}))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = 2000) -> DataFrame:
    """page_id, url, text and n_chars for each row. A null or empty page has an empty text. Repeated rows stay;
    other columns are not read; an empty table gives no rows."""
    prepare(pages.sparkSession)
    weights = learn(pages, id_col, html_col, sample)

    def run(batches):
        for b in batches:
            texts = [extract(x, weights) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
