"""HTML extraction by a site style tree.

The pages of a host are merged into one tree of element paths.  A path's node has the *styles*
in which pages present it (the sequence of its child elements) and the *contents* that pages hold
there.  Over the m pages that have the node,

    presentation importance  = entropy of the styles, to the base m;
    content importance       = 1 - mean over pages of log_m(pages with the same content);
    importance               = (1 - GAMMA) * presentation + GAMMA * content.

Menus, adverts and footers repeat, so their nodes score near 0; articles don't and score near 1.  A
host with fewer than ``MIN_PAGES`` pages of a node takes the node's importance from the tree of all
hosts.  The importance is multiplied by the weight of the element's role: elements that the
page itself names as menu, header, footer, sidebar, notice, advert, form or comments weigh ``ROLE_WEIGHT``
and more with the words that they hold, up to 1 at ``RICH`` words: a unique advert of a few words goes, a
unique branch with much text stays, and one that repeats goes as any other does.  A name on a *wrapper*, an
element that holds all that there is to judge, counts nothing.  A branch below ``THRESHOLD`` is removed from each
page.  Where a page has an article or main element, its text is taken from there, and paragraphs
and headings directly in it are not judged: copies of an article are still articles.

The trees are counts: (host, path, content) is counted map-side before the shuffle, so a host with a
third of all pages is no hot task.  Low nodes go to the second pass as a broadcast while there
are ``FEW`` at most, and by a join on each page's own nodes beyond that.

Defined results: a null or empty html has an empty text; a null url is a host of its own; repeated
rows are pages each; if all branches of a page are low, the text of its highest branch outside the
named roles stays, and of its highest branch outside menus and buttons if all text is in named roles; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .htmltree import CONTAINER, CONTENT, Node, digest, parse
from .storage import cut_lineage, read_table, small_batches

GAMMA, THRESHOLD, MIN_PAGES, ROLE_WEIGHT, RICH, FEW = 0.9, 0.4, 4, 0.3, 400, 200_000

# Elements, and words in class, id or role, that name what isn't the article.
ROLE_TAGS = set("nav header footer aside form menu dialog select search button option optgroup".split())
#: Elements that are never a page's text, not even if there is nothing else.
NO_PROSE = set("nav menu dialog select search button option optgroup".split())
ROLE_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar "
    "navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets notice notices cookie "
    "cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login form search comment "
    "comments disqus reply replies respond share sharing social related recommended pagination pager toolbar "
    "copyright legal".split())
#: Of these, the names that a long text of its own may speak against.  Menus, headers, footers, sidebars, notices, adverts,
#: forms and reader comments are removed whatever their length.
SOFT_WORDS = set("widget widgets share sharing social related recommended copyright legal search subscribe subscription".split())


def named_role(node: Node) -> bool:
    if node.tag == "header" and any(n.tag in CONTENT for n in node.above()):
        return False  # the article's own headline
    if node.tag in ROLE_TAGS:
        return True
    return node.tag not in CONTENT and node.tag not in ("html", "body") and any(w in ROLE_WORDS for w in node.names)


def soft_role(node: Node) -> bool:
    """A named element that only ``SOFT_WORDS`` name."""
    return node.tag not in ROLE_TAGS and not any(w in ROLE_WORDS and w not in SOFT_WORDS for w in node.names)


def page_nodes(page: str) -> Iterator[tuple[int, int, int]]:
    """(path, style, content) of each path of judged elements in a page."""
    nodes, blocks = parse(page)
    judged = [n for n in nodes if n.tag in CONTAINER or named_role(n)]
    texts: dict[int, list[str]] = {id(n): [] for n in judged}
    for text, at in blocks:
        for n in at.above():
            if id(n) in texts:
                texts[id(n)].append(text)
    by_path: dict[int, tuple[list[str], list[str]]] = {}
    for n in judged:
        style, content = by_path.setdefault(n.path, ([], []))
        style.append(",".join(n.children))
        content += texts[id(n)]
    for path, (style, content) in by_path.items():
        yield path, digest("|".join(style)), digest("\n".join(content))


def wrappers(roles: set[int], some: list[tuple[str, Node]], blocks: list[tuple[str, Node]]) -> set[int]:
    """Named elements (ids) that hold all of ``some`` blocks and half of the text that stands in no other named element."""
    held = Counter(id(x) for _, n in some for x in n.above() if id(x) in roles and x.tag not in NO_PROSE)
    every = {x for x, c in held.items() if c == len(some)}
    if not every or some is blocks:
        return every
    size, all_size = Counter(), 0
    for t, n in blocks:
        names = {id(x) for x in n.above() if id(x) in roles}
        if names <= every:
            all_size += len(t)
            size.update({x: len(t) for x in names})
    return {x for x in every if 2 * size[x] >= all_size}


def main_text(page: str, importance: Callable[[int], float]) -> str:
    """The blocks of a page that stand in no low branch; ``importance``: of a path, 1 if it isn't low."""
    nodes, blocks = parse(page)
    roles = {id(n) for n in nodes if named_role(n)}

    def in_role(n: Node) -> bool:
        return any(id(x) in named for x in n.above())

    inside = [(t, n) for t, n in blocks if any(x.tag in CONTENT for x in n.above())]
    named = roles - wrappers(roles, inside, blocks)
    if any(not in_role(n) for _, n in inside):
        blocks = inside
    else:
        named = roles - wrappers(roles, blocks, blocks)
    words = Counter()
    for t, n in blocks if named else ():
        size = len(t.split())
        words.update({id(x): size for x in n.above() if id(x) in named})
    scores: dict[int, float] = {}

    def score(n: Node) -> float:
        """The least importance on the way down to an element."""
        way, x = [], n
        while x and id(x) not in scores:
            way.append(x)
            x = x.parent
        least = scores[id(x)] if x else 1.0
        for x in reversed(way):
            if id(x) in named:
                rich = min(1.0, words[id(x)] / RICH) if soft_role(x) else 0.0
                least = min(least, importance(x.path) * (ROLE_WEIGHT + (1 - ROLE_WEIGHT) * rich))
            elif id(x) in roles or x.tag in CONTAINER:
                least = min(least, importance(x.path))
            scores[id(x)] = least
        return least

    kept = [t for t, n in blocks if score(n) >= THRESHOLD]
    if not kept:
        rest = ([(t, n) for t, n in blocks if not in_role(n)]
                or [(t, n) for t, n in blocks if not any(x.tag in NO_PROSE for x in n.above())])
        best = max((score(n) for _, n in rest), default=0)
        kept = [t for t, n in rest if score(n) == best]
    return "\n".join(kept)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, host, html) to (row, host, path, style, content)."""
    for batch in batches:
        at, cols = [], ([], [], [])
        for i, page in enumerate(batch.column(2).to_pylist()):
            for node in page_nodes(page or ""):
                at.append(i)
                for c, v in zip(cols, node):
                    c.append(v)
        take = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), *(pa.array(c, pa.int64()) for c in cols)],
            names=["row", "host", "path", "style", "content"])


def host_of(url):
    """The host of a url column, in lower case; a url without one is its own host."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]+)", 1))
    return F.coalesce(F.when(found != "", found), url, F.lit(""))


def style_tree(nodes: DataFrame) -> DataFrame:
    """host, path, importance of each node of each host's tree, and of the tree of all hosts (host null)."""
    every = (nodes.select(F.explode(F.array(F.col("host"), F.lit(None).cast("string"))).alias("host"), "path",
                          F.array(F.struct(F.lit("s").alias("kind"), F.col("style").alias("value")),
                                  F.struct(F.lit("c").alias("kind"), F.col("content").alias("value"))).alias("v"))
             .select("host", "path", F.inline("v")))
    counts = every.groupBy("host", "path", "kind", "value").agg(F.count(F.lit(1)).alias("c"))
    c = F.col("c").cast("double")

    def over(kind: str):
        return F.sum(F.when(F.col("kind") == kind, c * F.log(c)).otherwise(0.0))

    per = counts.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == "c", c)).alias("m"), over("s").alias("s"), over("c").alias("t"))
    # entropy of shares c / m to the base m: 1 - sum(c log c) / (m log m); the contents' mean is the same sum
    def share(x: str):
        return F.when(F.col("m") > 1, 1 - F.col(x) / (F.col("m") * F.log("m"))).otherwise(1.0)

    return per.select("host", "path", "m", ((1 - GAMMA) * share("s") + GAMMA * share("t")).alias("importance"))


def low_nodes(nodes: DataFrame) -> DataFrame:
    """host, path, importance of the nodes below the threshold; small hosts look at all hosts' tree."""
    tree = cut_lineage(style_tree(nodes), "style-tree")
    own = tree.where(F.col("host").isNotNull())
    every = (tree.where(F.col("host").isNull() & (F.col("m") >= MIN_PAGES))
             .select("path", F.col("importance").alias("of_all")))
    known = own.join(every, "path", "left").select(
        "host", "path", F.when(F.col("m") >= MIN_PAGES, F.col("importance"))
        .otherwise(F.coalesce("of_all", F.lit(1.0))).alias("importance"))
    return known.where(F.col("importance") < THRESHOLD)


def _extract_with(shared):
    """(page_id, url, host, html) to results; ``shared``: (host, path) -> importance."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = shared.value
        for batch in batches:
            texts = [main_text(page or "", lambda path, h=host: low.get((h, path), 1.0))
                     for host, page in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield _result(batch, texts)
    return run


def _extract_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, host, html, paths, importances) to results."""
    for batch in batches:
        texts = []
        for page, low in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            own = {x["path"]: x["importance"] for x in low or ()}
            texts.append(main_text(page or "", lambda path, own=own: own.get(path, 1.0)))
        yield _result(batch, texts)


def _result(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
        names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, few: int = FEW) -> DataFrame:
    """page_id, url, text and n_chars of every page; ``few``: low nodes that may be broadcast."""
    spark = pages.sparkSession
    small_batches(spark, rows=1000, mb=8)
    hosted = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    row = F.xxhash64("page_id", "url", "html").alias("row")  # equal rows have equal nodes
    nodes = cut_lineage(hosted.select(row, "host", "html").mapInArrow(
        _nodes, "row long, host string, path long, style long, content long"), "page-nodes")
    low = cut_lineage(low_nodes(nodes), "low-nodes")
    schema = f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long"
    if low.count() <= few:
        table = {(r.host, r.path): r.importance for r in low.collect()}
        return hosted.mapInArrow(_extract_with(spark.sparkContext.broadcast(table)), schema)
    per = (nodes.select("row", "host", "path").join(low, ["host", "path"]).groupBy("row")
           .agg(F.collect_set(F.struct("path", "importance")).alias("low")))
    return (hosted.withColumn("row", row).join(per, "row", "left").select("page_id", "url", "host", "html", "low")
            .mapInArrow(_extract_joined, schema))


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]))
