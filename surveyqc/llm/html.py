"""Main text of web pages by a site style tree.

The pages of a host are merged into one style tree: an element is known by its path of tags and classes. An element's composite
importance joins its presentation importance (entropy of the child sequences that its pages show) and its content importance
(one minus the mean entropy, over the host's pages with it, of the texts seen there): what all pages of a host repeat carries
little information. Copies of one main text are one page of the tree, as they say nothing about the site.

Markup is a prior to the composite importance c of a branch that m pages have: navigation, adverts, forms and what lies outside
a page's article or main element keep a quarter of c; a name that only holds such a word leaves 0.6 of it; the flow of an article or
main element counts as PRIOR_PAGES more pages of full importance, so that what all pages repeat goes from three pages on. An
article or main element is the page's unless it lies in comments or teasers or is named a comment; if it holds but a small part of
the page's text, nothing goes for lying outside it. Branches below the threshold go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyqc.llm.common import slices, small_or_shuffled, written

#: Branches under this importance go.
THRESHOLD = 0.3
#: Weight of a further style, as in the published method.
GAMMA = 0.9
#: Share of its importance that a branch keeps which markup names as no content, or whose names only hold such a word; pages of full importance that an article's flow has besides.
NO_CONTENT_SHARE, DOUBT_SHARE, PRIOR_PAGES = 0.25, 0.6, 0.9
#: Share of a page's text that its articles must hold for what lies outside to go.
ARTICLE_SHARE = 0.25

# HTML's element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg object".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
FLOW = frozenset("blockquote dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup li ol p pre table tbody td tfoot th thead tr ul caption header".split())
NO_CONTENT = frozenset("aside button dialog footer form head header input label menu nav option search select".split())
MAIN = frozenset("article main".split())
#: Words in class, id or role that name what isn't content.
NO_CONTENT_WORDS = frozenset("ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer form login masthead menu modal nav navbar navigation navigationbar newsletter notice notices pager pagination popup promo promotion promoted recommended related replies share sharing sidebar signup social sponsor sponsored subscribe contentinfo".split())
#: Words that also name parts of articles: even as a whole name they are only doubtful.
DOUBTFUL_WORDS = frozenset("alert complementary header search toolbar widget".split())
#: Words that name others' texts; an article or main element in them, or whose own name begins with one of the first kind, isn't the page's.
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply".split())
TEASER_WORDS = frozenset("promoted recommended related sponsored teaser teasers".split())
#: What markup says: no content; the flow of an article; nothing; that its names hold a doubtful word; no content by its names alone, so that a main or article in it is content; others' texts.
DROP, KEEP, ASK, DOUBT, NAMED, OTHERS = range(6)
#: Kinds that don't count as the page's text.
NO_TEXT = (DROP, NAMED, OTHERS)
#: Elements that their names say nothing about.
WHOLE = frozenset("html body main article".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <(?P<raw>script|style|textarea|title|noscript|template|iframe|svg|object)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)
      | <(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
      | </?[a-zA-Z][^>]*+>
      | <[!?/][^>]*+(?:>|\Z)""",
    re.S | re.I | re.X,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORDS = re.compile(r"[a-z]+")
#: node: hash of the path; style: hash of the child sequence; main: hash of what markup doesn't call no content.
PARSED = "page_id long, url string, host string, main long, blocks array<struct<node:long,kind:int,text:string>>, styles array<struct<node:long,style:long>>"


def _names(tag: str, attrs: str) -> tuple[str, int]:
    """The element's part of a path that its attributes give, and NAMED if a name is a word for what isn't content, DOUBT if one only holds it, OTHERS if one names comments or teasers."""
    if not attrs or "=" not in attrs:
        return "", ASK
    found = [(k.lower(), v.strip("\"'")) for k, v in _NAMES.findall(attrs)]
    words = {w for _, v in found for w in _WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", v).lower())}
    whole = {w for _, v in found for w in v.lower().split()}
    bad = ASK if words.isdisjoint(NO_CONTENT_WORDS | DOUBTFUL_WORDS) else DOUBT if whole.isdisjoint(NO_CONTENT_WORDS) else NAMED
    others = {m[0] for x in whole if (m := _WORDS.match(x))} & COMMENT_WORDS if tag in MAIN else whole & (COMMENT_WORDS | TEASER_WORDS)
    if others:
        bad = OTHERS
    return "".join(f".{v}" for k, v in found if k == "class"), bad


def walk(html: str) -> tuple[list[tuple[str, int, str]], list[tuple[str, str]]]:
    """All blocks of text (path, kind, text) in page order, and (path, child sequence) of the block elements.

    Tags that are never closed end where HTML ends them: a block element ends an open p, an end tag closes what is open
    within its element, one that matches nothing is skipped.
    """
    stack: list[list] = [["", "", KEEP, []]]  # name, path, kind, children; kind: ASK until markup decides
    stack[0][2] = ASK
    blocks: list[tuple[str, int, str]] = []
    styles: list[tuple[str, str]] = []
    text: list[str] = []

    def flush() -> None:
        if text:
            if found := " ".join("".join(text).split()):
                at = next(e for e in reversed(stack) if e[0] in BLOCK or not e[0])
                blocks.append((at[1], stack[-1][2], found))
            text.clear()

    def pop() -> None:
        name, path, _, children = stack.pop()
        if name in BLOCK:
            styles.append((path, " ".join(children)))

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            text.append(unescape(html[at : m.start()]))
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            text.append(" ")
        elif m["end"]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if depth and (tag in BLOCK or not any(e[0] in BLOCK for e in stack[depth + 1 :])):
                if tag in BLOCK:
                    flush()
                while len(stack) > depth:
                    pop()
        else:
            block = tag in BLOCK
            if block:
                flush()
                closes = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}.get(tag, set()) | {"p"}
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in closes:
                        while len(stack) > i:
                            pop()
                        break
                    if stack[i][0] in BLOCK and stack[i][0] not in closes:
                        break
            if tag in VOID:
                continue
            _, path, kind, children = stack[-1]
            named, bad = _names(tag, m["attrs"])
            if block:
                children.append(tag + named)
            if kind == DROP or (tag in NO_CONTENT and not (tag == "header" and kind == KEEP)):
                kind = DROP
            elif kind == OTHERS or (bad == OTHERS and tag not in ("html", "body", "main")):
                kind = OTHERS
            elif tag in MAIN:
                kind = KEEP
            elif tag not in WHOLE and tag in FLOW and bad == NAMED and kind in (KEEP, DOUBT):
                kind = DOUBT  # a paragraph, heading or list of an article is its own, whatever its name
            elif tag not in WHOLE and (bad == NAMED or (bad == DOUBT and kind != NAMED)):
                kind = bad
            elif kind == KEEP and block and (named or tag not in FLOW):
                kind = ASK
            stack.append([tag, f"{path}/{tag}{named}" if block else path, kind, []])
    if at < len(html):
        text.append(unescape(html[at:]))
    flush()
    while len(stack) > 1:
        pop()
    inside = lambda p: "/article" in p or "/main" in p
    own, every = (sum(len(t) for p, k, t in blocks if k not in NO_TEXT and (all_ or inside(p))) for all_ in (False, True))
    if own and own >= ARTICLE_SHARE * every:
        blocks = [(p, k if inside(p) else DROP, t) for p, k, t in blocks]
    elif own:
        blocks = [(p, ASK if k == KEEP else k, t) for p, k, t in blocks]
    return blocks, [s for s in styles if s[1]]


def parse(html: str) -> tuple[list[tuple[str, int, str]], list[tuple[str, str]]]:
    """As `walk`, without the blocks that markup calls no content."""
    blocks, styles = walk(html)
    return [b for b in blocks if b[1] not in NO_TEXT], styles


def parsed(pages: DataFrame) -> DataFrame:
    """PARSED of each row of pages(page_id, url, html); every page is read once."""
    from xxhash import xxh64_intdigest

    def number(x: str) -> int:
        h = xxh64_intdigest(x)
        return h - (1 << 64) if h >> 63 else h

    blocks_type, styles_type = pa.list_(pa.struct([("node", pa.int64()), ("kind", pa.int32()), ("text", pa.string())])), pa.list_(pa.struct([("node", pa.int64()), ("style", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                rows, known = [walk(h) for h in batch.column("html").to_pylist()], {}
                node = lambda path: known[path] if path in known else known.setdefault(path, number(path))  # noqa: B023, E731
                main = [number("\n".join(t for _, k, t in b if k not in NO_TEXT)) for b, _ in rows]
                blocks = [[{"node": node(p), "kind": k, "text": t} for p, k, t in b] for b, _ in rows]
                styles = [[{"node": node(p), "style": node(s)} for p, s in st] for _, st in rows]
                yield pa.RecordBatch.from_arrays([*map(batch.column, ("page_id", "url", "host")), pa.array(main), pa.array(blocks, blocks_type), pa.array(styles, styles_type)], ["page_id", "url", "host", "main", "blocks", "styles"])

    host = F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    return pages.select("page_id", "url", F.lower(host).alias("host"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, PARSED)


def style_tree(rows: DataFrame) -> DataFrame:
    """host, node, m (pages with it), composite (importance, 0..1) of all elements with text of rows(host, main, blocks, styles, row_id).

    A text or style counts once for a page; rows of one host with equal `main` are one page. Counts are made before the shuffle.
    A text that n of m pages have has the entropy log n / log m; on a single page all is important.
    """
    one = small_or_shuffled(written(rows.groupBy("host", "main").agg(F.min("row_id").alias("row_id")).select("row_id"), "tree-pages"))
    entry = lambda node, kind, value: F.struct(node.alias("node"), F.lit(kind).alias("kind"), value.alias("value"))
    seen = F.concat(
        F.transform("blocks", lambda b: entry(b["node"], 0, F.lit(0).cast("long"))),
        F.transform("blocks", lambda b: entry(b["node"], 1, F.xxhash64(b["text"]))),
        F.transform("styles", lambda s: entry(s["node"], 2, s["style"])),
    )
    entries = rows.join(one, "row_id", "left_semi").select("host", F.explode(F.array_distinct(seen)).alias("e")).select("host", "e.*")
    counted = entries.groupBy("host", "node", "kind", "value").agg(F.count("*").alias("n"))
    of = lambda kind, x: F.coalesce(F.sum(F.when(F.col("kind") == kind, x)), F.lit(0))
    sums = counted.groupBy("host", "node").agg(
        of(0, F.col("n")).alias("m"), of(1, F.lit(1)).alias("texts"), of(1, F.log("n")).alias("same"),
        of(2, F.lit(1)).alias("looks"), of(2, F.col("n")).alias("shown"), of(2, F.col("n") * F.log("n")).alias("spread"),
    ).where("m > 0")
    content = 1 - F.col("same") / (F.col("texts") * F.log("m"))
    look = F.when(F.col("shown") > 0, F.least(F.lit(1.0), (F.log("shown") - F.col("spread") / F.col("shown")) / F.log("m"))).otherwise(0.0)
    fade = F.pow(F.lit(GAMMA), F.greatest("looks", F.lit(1)))
    composite = F.when(F.col("m") == 1, 1.0).otherwise((1 - fade) * look + fade * content)
    return sums.select("host", "node", "m", composite.alias("composite"))


def importance(kind: Column, composite: Column, m: Column) -> Column:
    """What a branch's markup and its place in the tree come to, for composite importances 0..1 and m pages; a branch at the threshold stays."""
    flow = (m * composite + PRIOR_PAGES) / (m + PRIOR_PAGES)
    return F.when(kind == KEEP, flow).when(kind == ASK, composite).when(kind == DOUBT, DOUBT_SHARE * composite).otherwise(NO_CONTENT_SHARE * composite)


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row of pages(page_id, url, html).

    A null or empty html gives an empty text; a null url is a host of its own; repeated rows are each returned; an empty
    table gives none. Pages are parsed once and written; of them only (row, element) pairs are joined with the tree, and only where
    its importance can decide; rows with a branch to remove are then told which.
    """
    rows = written(parsed(pages).withColumn("row_id", F.monotonically_increasing_id()), "parsed-pages")
    most = dict.fromkeys(NO_TEXT, NO_CONTENT_SHARE)  # of the importance that a kind can have; 1 for others
    sure = [k for k, x in most.items() if x < threshold]
    weak = style_tree(rows).where(F.least(*[importance(F.lit(k), F.col("composite"), F.col("m")) for k in range(6) if k not in sure]) < threshold)
    asked = rows.select("row_id", "host", F.explode(F.array_distinct(F.transform(F.filter("blocks", lambda b: ~b["kind"].isin(*sure)), lambda b: b["node"]))).alias("node"))
    hits = asked.join(small_or_shuffled(written(weak, "weak-branches")), ["host", "node"])
    low = written(hits.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct("composite", "m")))).alias("weak")), "weak-rows")
    found = rows.join(small_or_shuffled(low), "row_id", "left").withColumn("weak", F.coalesce("weak", F.create_map().cast("map<long,struct<composite:double,m:long>>")))

    def stays(b: Column) -> Column:
        told = F.try_element_at("weak", b["node"])
        return ~b["kind"].isin(*sure) & (told.isNull() | (importance(b["kind"], told["composite"], told["m"]) >= threshold))

    text = F.array_join(F.transform(F.filter("blocks", stays), lambda b: b["text"]), "\n")
    return found.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
