"""HTML extraction with site template removal.

A page is parsed once, into blocks of text and a digest for each block element, made from its children's. The
digests of elements that hold text, inside and outside the article, are counted by host over distinct pages; an
element that recurs on many pages of its host is template, and its blocks go. What tags, roles and class names mark as
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments goes besides. Only parsing is
Python; counting, meeting a host's templates and cutting are DataFrame functions over the parsed pages.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, read, slices, written
from .registry import query

#: Pages of a host, with different contents, on which an element recurs to be template.
RECURS = 5
#: And the share of the host's distinct pages that these must be.
SHARE = 0.25
#: A page whose article is template but for a smaller share of its characters than this keeps it whole.
OWN = 0.1
#: Keys that a host's pages are dealt over when they meet its templates.
SALTS = 32

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template svg select".split())
#: Of these, those that run to the end of the page if they aren't closed; of others then only the tag goes.
TO_END = frozenset("script style textarea title".split())
DROPPED = frozenset("nav footer aside form button dialog menu head header label fieldset".split())
CONTAINERS = frozenset("div section nav aside header footer form ul ol dl table blockquote details figure center menu fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = CONTAINERS | HEADINGS | frozenset("p li dt dd tr td th pre article main body html address caption thead tbody tfoot hr summary hgroup figcaption".split())
#: Block elements that have no digest: what holds the page or its article.
SCOPES = frozenset("article main body html".split())
#: Words in a class or an id that mark what isn't the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "footer copyright sidebar aside widget cookie cookies consent gdpr notice alert warning popup modal overlay newsletter subscribe "
    "subscription signup login register search comment comments commentlist reply replies respond disqus discussion share sharing social related "
    "recommended recommendations toolbar pagination pager skip hidden".split()
)
#: Those that can't be a part's subject either: all that counts inside an article, in classes alone.
INNER_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo nav navbar navigation breadcrumb breadcrumbs sidebar widget "
    "cookie cookies consent gdpr popup modal newsletter subscribe signup comment comments commentlist disqus sharing pagination pager toolbar".split()
)
#: The same as MARKS for elements outside an article; inside, such an element holds the article's own head.
OUTER_MARKS = frozenset("header masthead topbar banner".split())
#: Words before a mark that make it say something else, as in has-sidebar.
NEGATIONS = frozenset("has with no without".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar toolbar form".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']|[\"'])*?)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
NOT_WORD = re.compile(r"[^a-z0-9]+")
ENDS = {name: re.compile(rf"</{name}\s*(?:>|\Z)", re.I) for name in RAW}


def marked(attributes: str, inside: bool = False) -> bool:
    """Whether an element's class, id, role or state says that it isn't part of the article; inside: whether it is in one."""
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "class" or name == "id" and not inside:
            before = ""
            for word in NOT_WORD.split(value.lower()):
                if (word in INNER_MARKS if inside else word in MARKS or word in OUTER_MARKS) and before not in NEGATIONS:
                    return True
                before = word
        elif name == "role":
            if value.strip("\"'").lower() in ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden" and "true" in value.lower():
            return True
    return False


def parse(html: str) -> tuple[list[tuple[str, int, int]], list[int], list[int]]:
    """_parse, and where marks leave nothing of a page, what it gives without regard to them."""
    found = _parse(html, True)
    return found if found[0] else _parse(html, False)


def _parse(html: str, by_marks: bool) -> tuple[list[tuple[str, int, int]], list[int], list[int]]:
    """Blocks (text, element, in an article or main: 1, else 0), block elements' digests, and their parents.

    Element -1 is the page. Blocks of dropped elements aren't there; their elements have no text and no digest
    of use. Blocks outside the article are there: see best. Never fails: unknown, unclosed and cut off markup is skipped like a browser would.
    """
    from xxhash import xxh64_intdigest

    blocks: list[tuple[str, int, int]] = []
    digests: list[int] = []
    parents: list[int] = []
    # an open element: name, container, dropped, region, parts of its digest
    stack: list[tuple[str, int, bool, int, list]] = [("", -1, False, 0, [])]
    text: list[str] = []

    def flush():
        if text:
            line = " ".join(unescape("".join(text)).split())
            text.clear()
            if line:
                name, container, dropped, region, parts = stack[-1]
                parts.append(line)
                if not dropped:
                    blocks.append((line, container, region))

    def close():
        flush()
        name, container, dropped, _, parts = stack.pop()
        digest = xxh64_intdigest("\0".join((name, *parts)))
        stack[-1][4].append(f"{digest:x}")
        if name in BLOCKS and name not in SCOPES and not dropped and container >= 0:
            digests[container] = digest

    at, size, unclosed = 0, len(html), set()
    while at < size:
        found = TOKEN.search(html, at)
        if not found:
            text.append(html[at:])
            break
        if found.start() > at:
            text.append(html[at : found.start()])
        at = found.end()
        name = found.group(2)
        if name is None:
            continue
        name = name.lower()
        if found.group(1):
            if name not in BLOCKS and not stack[-1][2]:
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    while len(stack) > depth:
                        close()
                    break
                if stack[depth][0] in SCOPES:
                    break
            continue
        if name in RAW:
            end = ENDS[name].search(html, at) if name not in unclosed else None
            if end:
                at = end.end()
            elif name in TO_END:
                at = size
            else:
                unclosed.add(name)
            text.append(" ")
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        attributes = found.group(3)
        if name in BLOCKS:
            flush()
            if name == "li" or name in ("dt", "dd", "tr", "td", "th"):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == name:
                        while len(stack) > depth:
                            close()
                        break
                    if stack[depth][0] in CONTAINERS or stack[depth][0] in SCOPES:
                        break
            elif stack[-1][0] == "p" or name in HEADINGS and stack[-1][0] in HEADINGS:
                close()
        _, container, dropped, region, parts = stack[-1]
        drops = dropped or name in DROPPED and not (name == "header" and region) or name not in SCOPES and by_marks and bool(attributes) and marked(attributes, bool(region))
        if name not in BLOCKS and not drops:
            parts.append(name)
            continue
        if drops and not dropped:
            flush()
        if name in SCOPES and not dropped and name != "html" and name != "body":
            drops = by_marks and bool(attributes) and bool(region) and marked(attributes, True)
            region = 1
        if name in BLOCKS and name not in SCOPES and not drops:
            parents.append(container)
            digests.append(0)
            container = len(digests) - 1
        stack.append((name, container, drops, region, []))
    while len(stack) > 1:
        close()
    flush()
    return blocks, digests, parents


def best(blocks: list) -> list:
    """The blocks in main or an article; all, if there are none."""
    return [b for b in blocks if b[2]] or blocks


def with_text(blocks: list, parents: list[int]) -> set[int]:
    """The elements that hold a block at any depth."""
    out: set[int] = set()
    for _, container, _ in blocks:
        while container >= 0 and container not in out:
            out.add(container)
            container = parents[container]
    return out


def spans(digests: list[int], parents: list[int], wanted: set[int]) -> list[dict]:
    """The wanted elements as spans: digest (signed), first, last. Elements are numbered in page order, so one holds all from itself to its last."""
    last = list(range(len(parents)))
    for c in range(len(parents) - 1, -1, -1):
        if parents[c] >= 0:
            last[parents[c]] = max(last[parents[c]], last[c])
    return [{"digest": digests[c] - (1 << 63), "first": c, "last": last[c]} for c in sorted(wanted)]


def extract(html: str, template: frozenset[int] = frozenset()) -> str:
    """The blocks of the page's article joined by line feeds, without those in elements whose digest (signed) is template: one page by itself."""
    blocks, digests, parents = parse(html)
    found = best(blocks)
    cuts = [e for e in spans(digests, parents, with_text(blocks, parents)) if e["digest"] in template]
    own = [line for line, c, _ in found if not any(e["first"] <= c <= e["last"] for e in cuts)]
    if sum(map(len, own)) < OWN * sum(len(line) for line, _, _ in found):
        own = [line for line, _, _ in found]
    return "\n".join(own)


def host(url: Column) -> Column:
    """The host of a url in lower case; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, html -> page_id, url, host, content (a hash of the article), elements (those with text: digest, first, last), blocks (line, element)."""
    from xxhash import xxh64_intdigest

    keyed = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host(F.col("url")).alias("host"))
    span = pa.struct([("digest", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
    types = [pa.int64(), pa.list_(span), pa.list_(pa.struct([("line", pa.string()), ("element", pa.int32())]))]
    names = ["page_id", "url", "host", "content", "elements", "blocks"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                rows = []
                for html in part.column(2).to_pylist():
                    blocks, digests, parents = parse(html or "")
                    found = best(blocks)
                    content = xxh64_intdigest("\n".join(line for line, _, _ in found)) - (1 << 63)
                    rows.append((content, spans(digests, parents, with_text(blocks, parents)), [{"line": line, "element": c} for line, c, _ in found]))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.record_batch([part.column(0), part.column(1), part.column(3), *columns], names=names)

    fields = keyed.select("page_id", "url", "host").schema
    for name, kind in (("content", "long"), ("elements", "array<struct<digest:long,first:int,last:int>>"), ("blocks", "array<struct<line:string,element:int>>")):
        fields = fields.add(name, T._parse_datatype_string(kind))
    return keyed.mapInArrow(lean(run), fields)


def templates(pages: DataFrame, recurs: int = RECURS, share: float = SHARE) -> DataFrame:
    """Parsed pages -> host, template: digests that recur on `recurs` and a `share` of the distinct pages of their host.

    Elements anywhere on the page that hold text are counted, single paragraphs too. Pages with equal articles
    count once, whatever stands around them. Counts are aggregated in part before they are shuffled, so a host
    with most of the pages is no burden to one task; a host has at most 1 / share times a page's elements.
    """
    # null stands for the page itself
    seen = pages.select("host", "content", F.explode(F.concat(F.array(F.lit(None).cast("long")), F.array_distinct("elements.digest"))).alias("digest")).distinct()
    counts = written(seen.groupBy("host", "digest").agg(F.count("*").alias("n")).filter(F.col("n") >= recurs), "html-counts")
    sizes = counts.filter("digest IS NULL").select("host", F.col("n").alias("pages"))
    common = counts.filter("digest IS NOT NULL").join(sizes, "host").filter(F.col("n") >= share * F.col("pages"))
    return common.groupBy("host").agg(F.collect_set("digest").alias("template"))


def extracted(pages: DataFrame, recurs: int = RECURS) -> DataFrame:
    """page_id, url, html -> page_id, url, text; other columns, whatever their names, are left out.

    Null html is empty, as is the text of a page without any; whole pages are parsed however long, and malformed or cut
    off markup is read as a browser would. Repeated rows are kept and count as one page for templates. A null or odd
    url has the empty host. A page of which template would leave less than a share OWN stays whole.
    """
    whole = written(parsed(pages), "html-parsed")
    # written, so that Spark sees its size and moves no page to meet it if it is small; if it isn't, a host's pages
    # are dealt over SALTS keys, each with a copy of its templates
    found = written(templates(whole, recurs), "html-templates")
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = whole.withColumn("salt", F.pmod(F.xxhash64("url", "content"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    chars = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    every = F.transform("blocks", lambda b: b["line"])
    cuts = F.filter("elements", lambda e: F.array_contains("template", e["digest"]))
    rows = rows.withColumn("cuts", F.when(F.col("template").isNotNull(), cuts))
    own = F.transform(F.filter("blocks", lambda b: ~F.exists("cuts", lambda e: b["element"].between(e["first"], e["last"]))), lambda b: b["line"])
    kept = F.when(F.coalesce(F.size("cuts"), F.lit(0)) <= 0, every).when(chars(own) < OWN * chars(every), every).otherwise(own)
    return rows.select("page_id", "url", F.array_join(kept, "\n").alias("text"))


@query("op8_html_extract")
def op8_html_extract(spark, sf_dir):
    """The main text of every page."""
    return extracted(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
