"""Operator 1: main text of web pages by site style trees.

All pages of a host are merged into one tree whose nodes are style paths (tag and class from the body
down).  A leaf's importance is the entropy of its texts over the host's pages.  That of an inner node is
(1 - FADE ** k) x entropy of its k presentations (the sequences of children it is built of) + FADE ** k x the
importance of its children, weighed by the text they hold; a node that only wraps one child is worth what the child is.
A branch that shows the same few things everywhere (menus, notices, adverts) is near 0 and is cut from each page
with all below it, unless it holds the page's article or most of its text; articles are near 1.  A box of fixed shape
whose texts differ on every page looks like an article, and stays.  A second tree over all hosts stands in where a host has too few pages to tell.  What the
markup itself names as no article (nav, footer, form, class="comments", ...) needs no statistics, unless it is
around the page's article or most of its text.

1. Every page is parsed once and gives its nodes with what they show; pages that show the same count once
   a host.  Spark counts pages and takes entropies, then importances level by level, one small join a level of the tree (as deep as nodes on HOST_PAGES pages are).
   No host's pages meet in one task.
2. Each host gets its own list of paths to cut.  The lists are joined to pages by host and SALTS parts of it, or
   sent to all tasks while they are at most TABLE_ROWS paths; pages are parsed again and lose those branches.

Defined cases: null or empty html gives an empty text; a null or odd url makes its page part of the
host ""; broken markup is read as far as it goes (open comments and scripts end with the page);
repeated rows give equal texts; null ids are kept; an empty table gives no rows; other columns are
ignored.
"""
from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import lru_cache, reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxoflux.llm.runtime import Scratch

#: A node below this importance goes; inside <article> or <main> only one that hardly changes at all.
LEAST = 0.3
LEAST_INSIDE = 0.05
#: Different pages that a host's own node needs; below it the tree over all hosts decides, from ALL_PAGES on.
HOST_PAGES = 8
HOST_PAGES_INSIDE = 20
ALL_PAGES = 50
TABLE_ROWS = 200_000
SALTS = 32
#: What k different presentations leave to the importance of the children: FADE ** k.
FADE = 0.9
#: Nesting that paths tell apart; what is deeper belongs to the node at this depth, so paths stay short on any page.
MAX_DEPTH = 100
#: Host of the tree over all hosts, and the part of a path for the texts right in a node; no host or tag holds "/" or "#".
EVERY, OWN = "/", "/#"

# HTML element names by their role.
RAW = frozenset("script style noscript template textarea svg math iframe select option button object video audio canvas title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NO_ARTICLE = frozenset("head nav footer aside form menu dialog fieldset".split())
WRAPPERS = frozenset("form fieldset".split())  # of these, some are wrapped around whole pages
#: Words of class, id and role that name what is no article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promotions banner banners "
    "nav navbar navigation menu menus breadcrumb breadcrumbs topbar toolbar masthead footer foot colophon copyright "
    "sidebar side aside widget widgets related recommended recommendations comment comments respond replies discussion disqus "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search "
    "share sharing social pagination pager skip form".split()
)
CLOSES_P = BLOCK - {"html", "body"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NAME_PART = re.compile(r"[a-z]+")
INSIDE = re.compile(r"/(?:article|main)(?:[./]|$)")


def named(attributes: str) -> tuple[str, bool, bool]:
    """(first class, whether class, id or role names something that is no article, whether it is hidden)"""
    style, out, hidden = "", False, False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key not in ("class", "id", "role", "hidden", "aria-hidden"):
            continue
        if key == "class" and value.split():
            style = value.split()[0].replace("/", "|")
        if key == "hidden" or key == "aria-hidden" and value == "true":
            hidden = True
        out = out or not NAMES.isdisjoint(NAME_PART.findall(value))
    return style, out, hidden


def parse(page: str):
    """(blocks, shapes): blocks are (path, text, inside an article) of what isn't ruled out by name, in
    page order; shapes are (path, children) of their elements.

    A name rules its element out with all below it, but not where it would take the page's article: not
    over an article or main that has none around it, and, by class, id, role or form, not over most of the page's
    text unless an article around it holds a good part.  What stays is left to the statistics."""
    stack: list[list] = []  # [tag, path, innermost named element, inside, children]
    blocks: list[tuple[str, str, bool, int]] = []
    shapes: list[tuple[str, str, int]] = []
    words: list[str] = []
    above, kinds = [-1], [""]  # of named elements: the named one around it (0: none); hidden, tag or name
    path, out, inside = "", 0, False

    def end_block():
        if words:
            if text := " ".join("".join(words).split()):
                blocks.append((path, text, inside, out))
            words.clear()

    def close(depth):
        nonlocal path, out, inside
        while len(stack) > depth:
            tag, node, ruled, _, children = stack.pop()
            if tag in BLOCK:
                shapes.append((node, ",".join(dict.fromkeys(children)), ruled))
        path, out, inside = (stack[-1][1], stack[-1][2], stack[-1][3]) if stack else ("", 0, False)

    at, n = 0, len(page)
    last = page.rfind(">") + 1  # no tag ends after it
    while at < n:
        m = TAG.search(page, at, last) if at < last else None
        if m is None:
            comment = page.find("<!--", at)
            words.append(entities.unescape(page[at : comment if comment >= 0 else n]))
            break
        if m.start() > at:
            piece = page[at : m.start()]
            words.append(entities.unescape(piece) if "&" in piece else piece)
        at = m.end() if m[2] or m[5] or not m[0].startswith("<!--") or m[0].endswith("-->") else n  # an open comment ends with the page
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in BLOCK:
                depth = len(stack) - 1
                while depth >= 0 and stack[depth][0] != tag:
                    depth -= 1
                end_block()
                if depth >= 0:
                    close(depth)
            continue
        if tag in RAW and not (m[3] or m[6] or "").endswith("/"):
            shut = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = shut.end() if shut else n
            words.append(" ")
            continue
        if tag == "br":
            words.append(" ")
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag not in BLOCK and tag != "head":
            continue
        end_block()
        depth = len(stack)
        if tag in CLOSES_P and stack and stack[-1][0] == "p":
            depth -= 1
        elif tag in SAME and stack and stack[-1][0] in SAME[tag]:
            depth -= 1
        elif tag == "body" and stack and stack[-1][0] == "head":
            depth -= 1
        close(depth)
        if tag == "hr":
            continue
        style, ruled, hidden = named(m[3] or m[6] or "")
        if stack:
            stack[-1][4].append(tag)
        inside = inside or tag in ("article", "main")
        body = tag in ("html", "body", "article", "main")
        if tag in NO_ARTICLE or (hidden or ruled) and not body or (tag == "header" and not inside):
            above.append(out)
            kinds.append("hidden" if hidden or tag == "head" else "tag" if tag in NO_ARTICLE - WRAPPERS or tag == "header" else "name")
            out = len(above) - 1
        if len(stack) < MAX_DEPTH:
            path = f"{path}/{tag}.{style[:100]}" if style else f"{path}/{tag}"
        stack.append([tag, path, out, inside, []])
    end_block()
    close(0)
    if len(above) == 1:
        return [x[:3] for x in blocks], [x[:2] for x in shapes]
    gone = [kind == "hidden" for kind in kinds]
    for k in range(1, len(above)):  # elements come after those around them
        gone[k] |= gone[above[k]]
    own, articles, under = [0] * len(above), [0] * len(above), [0] * len(above)  # characters, hidden ones aside
    for _, text, inside, k in blocks:
        if not gone[k]:
            under[k] += len(text)
            own[k] += inside and len(text)
            articles[k] = own[k]
    for k in range(len(above) - 1, 0, -1):
        under[above[k]] += under[k]
        articles[above[k]] += articles[k]
    around = [0] * len(above)  # characters of articles around a named element that no name rules out
    for k in range(1, len(above)):
        around[k] = around[above[k]] + own[above[k]]
        whole = articles[k] and not around[k] or kinds[k] == "name" and 2 * under[k] > under[0] and 4 * around[k] < under[k]
        gone[k] |= gone[above[k]] or not whole
    return [x[:3] for x in blocks if not gone[x[3]]], [x[:2] for x in shapes if not gone[x[2]]]


def host_of(url: str | None) -> str:
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


@lru_cache(maxsize=1 << 16)
def branches(path: str) -> tuple[str, ...]:
    """The nodes above and at a path, outermost first."""
    parts = path.split("/")
    return tuple("/".join(parts[:k]) for k in range(2, len(parts) + 1))


def style_nodes(batches):
    """Pages -> (host, digest of what the page shows, nodes).  A node (path, or path + OWN for texts right in it)
    comes once with shown null and the part of its parent's text it holds, and once for each thing shown."""
    one = pa.struct([("node", pa.string()), ("shown", pa.int64()), ("part", pa.float64())])
    schema = pa.schema([("host", pa.string()), ("digest", pa.binary()), ("nodes", pa.list_(one))])
    for batch in batches:
        hosts, digests, rows = [], [], []
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            blocks, shapes = parse(page or "")
            if not blocks:
                continue
            size: Counter = Counter()
            for path, text, _ in blocks:
                size[path + OWN] += len(text)
                for node in branches(path):
                    size[node] += len(text)
            total = sum(len(text) for _, text, _ in blocks)
            nodes = [(node, None, n / size.get(node.rpartition("/")[0], total)) for node, n in size.items()]
            nodes += [(path + OWN, shown, None) for path, shown in dict.fromkeys((p, xxhash.xxh3_64_intdigest(t) >> 1) for p, t, _ in blocks)]
            nodes += [(path, shown, None) for path, shown in dict.fromkeys((p, xxhash.xxh3_64_intdigest(c) >> 1) for p, c in shapes) if path in size]
            hosts.append(host_of(url))
            digests.append(xxhash.xxh3_128_digest(repr((blocks, shapes))))
            rows.append([dict(zip(("node", "shown", "part"), x)) for x in nodes])
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.binary()), pa.array(rows, pa.list_(one))], schema=schema)


def within(node) -> Column:
    return node.rlike("/(?:article|main)(?:[./]|$)")


def importances(votes: DataFrame, scratch: Scratch) -> DataFrame:
    """host, node, shown, part -> host, node, pages, importance, from the deepest nodes up."""
    shown = votes.groupBy("host", "node", "shown").agg(F.count("*").alias("n"), F.sum("part").alias("part"))
    known, n = F.col("shown").isNotNull(), F.col("n")
    total = F.sum(F.when(known, n))
    e = F.log(total) - F.sum(F.when(known, n * F.log(n))) / total
    nodes = shown.groupBy("host", "node").agg(
        F.sum(F.when(~known, n)).alias("pages"), F.sum("part").alias("part"), F.when(total > 1, e / F.log(total)).otherwise(1.0).alias("share"), F.count("shown").alias("kinds")
    )
    parent = F.regexp_replace("node", "/[^/]*$", "")
    nodes = scratch.save(nodes.withColumns({"parent": parent, "depth": F.size(F.split("node", "/")), "told": F.col("pages") >= HOST_PAGES}))
    deepest = nodes.where("told").agg(F.max("depth")).first()[0] or 1
    tree, above = [], None
    # a node on too few pages to be cut counts as important to the one above, whatever it holds
    for depth in range(deepest + 1, 1, -1):
        level = nodes.where(F.col("depth") == depth)
        if above is None:
            level = level.withColumn("importance", F.when(F.col("told"), F.col("share")).otherwise(1.0))
        else:
            below = above.groupBy(F.col("host"), F.col("parent").alias("node")).agg((F.sum(F.col("part") * F.col("importance")) / F.sum("part")).alias("inner"), F.count("*").alias("children"))
            level = level.join(below, ["host", "node"], "left")
            fade = F.when(F.col("children") == 1, 1.0).otherwise(F.pow(F.lit(FADE), F.col("kinds")))
            whole = F.when(F.col("inner").isNull(), F.col("share")).otherwise((1 - fade) * F.col("share") + fade * F.col("inner"))
            level = level.withColumn("importance", F.when(F.col("told"), whole).otherwise(1.0))
        above = scratch.save(level.select("host", "node", "parent", "part", "pages", "importance"))
        tree.append(above)
    return reduce(DataFrame.unionByName, tree).select("host", "node", "pages", "importance")


def branches_to_cut(pages: DataFrame, scratch: Scratch, table_rows: int = TABLE_ROWS) -> DataFrame:
    """(host, path) of low importance, by the host's own pages or, where it has too few, by those of all hosts."""
    seen = pages.select("url", "html").mapInArrow(style_nodes, "host string, digest binary, nodes array<struct<node: string, shown: long, part: double>>")
    # copies of a page have one vote a host, and one in all
    own = scratch.save(seen.groupBy("host", "digest").agg(F.first("nodes").alias("nodes")))
    every = own.groupBy("digest").agg(F.first("nodes").alias("nodes"))
    tree = importances(own.select("host", F.inline("nodes")).unionByName(every.select(F.lit(EVERY).alias("host"), F.inline("nodes"))), scratch)
    inside = within(F.col("node"))
    need, least = F.when(inside, HOST_PAGES_INSIDE).otherwise(HOST_PAGES), F.when(inside, LEAST_INSIDE).otherwise(LEAST)
    mine, low = tree.where(F.col("host") != EVERY), F.col("importance") < least
    common = scratch.save(tree.where((F.col("host") == EVERY) & (F.col("pages") >= ALL_PAGES) & low).select("node"))
    if common.limit(table_rows + 1).count() <= table_rows:
        common = F.broadcast(common)
    cut = mine.where((F.col("pages") >= need) & low).unionByName(mine.where(F.col("pages") < need).join(common, "node", "left_semi").select(mine.columns))
    return scratch.save(cut.select("host", F.col("node").alias("path")))


def kept(blocks, gone) -> list[str]:
    """Texts of blocks in no cut branch.  A branch that holds the page's article or most of its text stays,
    and what is in it is judged for itself."""
    if not gone:
        return [t for _, t, _ in blocks]
    size: Counter = Counter()
    holds = set()
    for path, text, inside in blocks:
        for node in branches(path):
            if node in gone:
                size[node] += len(text)
                if inside and not INSIDE.search(node):
                    holds.add(node)
    total = sum(len(t) for _, t, _ in blocks)
    cut = {node for node, n in size.items() if 2 * n <= total and node not in holds}
    return [t for p, t, _ in blocks if p + OWN not in gone and cut.isdisjoint(branches(p))]


def main_texts(cuts):
    """Pages (page_id, url, html[, own]) -> (page_id, url, text).  cuts: {host: paths}; pages joined with
    their host's paths have them in ``own``."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches):
        table = cuts.value
        for batch in batches:
            urls = batch.column(1).to_pylist()
            own = batch.column(3).to_pylist() if batch.num_columns > 3 else [table.get(host_of(url), ()) for url in urls]
            texts = ["\n".join(kept(parse(page or "")[0], set(gone or ()))) for page, gone in zip(batch.column(2).to_pylist(), own)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], schema=schema)

    return run


def hosts_of(batches):
    for batch in batches:
        hosts = pa.array([host_of(url) for url in batch.column(1).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, hosts], names=[*batch.schema.names, "host"])


def extract(pages: DataFrame, scratch: Scratch, table_rows: int = TABLE_ROWS) -> DataFrame:
    """One row a page: page_id, url, text."""
    sc = pages.sparkSession.sparkContext
    rows = pages.select("page_id", "url", "html")
    cut = branches_to_cut(pages, scratch, table_rows)
    table: dict[str, set[str]] = {}
    if cut.limit(table_rows + 1).count() <= table_rows:
        for host, path in cut.collect():
            table.setdefault(host, set()).add(path)
    else:  # pages of one host are dealt over SALTS tasks
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        per_host = cut.groupBy("host").agg(F.collect_set("path").alias("own")).select("host", "own", salts)
        rows = rows.mapInArrow(hosts_of, "page_id long, url string, html string, host string").withColumn("salt", F.pmod(F.xxhash64("html", "page_id"), F.lit(SALTS)).cast("int"))
        rows = rows.join(per_host, ["host", "salt"], "left").select("page_id", "url", "html", "own")
    return rows.mapInArrow(main_texts(sc.broadcast(table)), "page_id long, url string, text string")
