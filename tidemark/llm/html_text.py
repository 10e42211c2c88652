"""Main text of web pages: flat text blocks, told apart by a decision tree over their and their neighbours' features."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from tidemark.llm.common import query, table

# Content that is no text of the page: to the end of the page if it is not closed, or only if it is closed.
RAW = "script|style|title|textarea|xmp"
CLOSED = frozenset("noscript template iframe svg object canvas select audio video".split())
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*(?:(?<=/)>|>.*?(?:</\1\s*>|\Z))|"
    r"<[a-zA-Z/!?](?:\"[^\"<]*\"|'[^'<]*'|[^>\"'])*>|<[a-zA-Z/!?][^>]*>|[^<]+|<", re.S | re.I)
ENDS = re.compile(rf"</({'|'.join(sorted(CLOSED))})\s*>", re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mrow msqrt msub msup mtext nobr q rp rt "
             "ruby s samp small span strike strong sub sup time tt u var wbr".split())
# Containers of anything but the article: as elements, as whole words of class, id or role, and as parts of such words.
ASIDE_TAGS = set("nav header footer aside button fieldset menu dialog address".split())
ASIDE_NAMES = set("ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion banner "
                  "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent gdpr "
                  "notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
                  "recommended recommendations widget widgets comment comments disqus reply replies copyright legal disclaimer "
                  "pagination pager toolbar search form complementary contentinfo".split())
# First parts of words that tell about a container without one, or with one inside.
ABOUT = set("no non not without has have with hide hidden is".split())
ARTICLE_TAGS = {"article", "main"}
ARTICLE_NAMES = set("article story".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Elements whose names tell about the whole page, or stand in the text: only their class or role counts, and only as a whole word.
PAGE = {"html", "body"}
TEXT = HEADINGS | ARTICLE_TAGS | set("p li dt dd blockquote pre td th tr figcaption caption".split())


class Open(NamedTuple):
    tag: str
    article: bool  # within the article
    asides: int  # containers of other things on the way down, counted from the article if within it
    named: int  # forms, and containers of which a part of a name speaks of other things
    heading: bool


def names_of(tag: str, source: str) -> tuple[set[str], set[str]]:
    """Whole words of an element's class, id and role that name something, and parts of such words."""
    whole, parts = set(), set()
    if tag not in PAGE:
        for m in NAMES.finditer(source):
            if tag in TEXT and m[1].lower() == "id":
                continue
            for word in (m[2] or m[3] or m[4] or "").split():
                pieces = [p.lower() for p in PART.findall(word)]
                whole.add("".join(pieces))
                if tag not in TEXT and pieces and pieces[0] not in ABOUT:
                    parts.update(pieces)
    return whole, parts


def opened(tag: str, source: str, above: Open) -> Open:
    whole, parts = names_of(tag, source)
    heading = above.heading or tag in HEADINGS
    strong = bool(whole & ASIDE_NAMES) or tag in ASIDE_TAGS
    weak = not strong and (bool(parts & ASIDE_NAMES) or tag == "form")
    if (tag in ARTICLE_TAGS or whole & ARTICLE_NAMES) and not whole & ASIDE_NAMES and not above.article and not above.asides:
        return Open(tag, True, 0, 0, heading)
    if tag == "header" and above.article:  # of the article, not of the page
        strong = bool(whole & ASIDE_NAMES - {"header"})
    return Open(tag, above.article, above.asides + strong, above.named + weak, heading)


FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "article", "asides", "named", "heading", "sentence"]


def blocks(html: str) -> list[tuple[str, list[float]]]:
    """Text blocks in page order, white space made one blank, with FEATURES (links: share of words within <a>)."""
    found: list[tuple[str, int, Open]] = []
    text: list[str] = []
    linked = depth = 0
    stack = [Open("", False, 0, 0, False)]
    last_end = {m[1].lower(): m.start() for m in ENDS.finditer(html)}

    def flush() -> None:
        nonlocal linked
        words = "".join(text).split()
        if words:
            found.append((" ".join(words), min(linked, len(words)), stack[-1]))
        text.clear()
        linked = 0

    at, size = 0, len(html)
    while at < size:
        m = TOKEN.match(html, at)
        at = m.end()
        token = m.group()
        if m.group(1):
            continue
        if token[0] != "<" or token == "<":
            piece = unescape(token)
            text.append(piece)
            if depth:
                linked += len(piece.split())
            continue
        tag = TAG.match(token)
        if tag is None:  # comment, declaration
            continue
        closing, name = bool(tag.group(1)), tag.group(2).lower()
        if name in CLOSED:
            if not closing and not token.endswith("/>") and last_end.get(name, -1) >= at:
                at = next(e.end() for e in ENDS.finditer(html, at) if e[1].lower() == name)
            continue
        if name == "a":
            depth = 0 if closing else 1
        if name == "br" or name in VOID and name in INLINE:
            text.append(" ")
            continue
        if name in INLINE:
            continue
        flush()
        depth = 0 if name != "a" else depth
        if name in VOID:
            continue
        if not closing:
            if stack[-1].tag == "p" and name != "p" or name == "p" and stack[-1].tag == "p":
                stack.pop()  # a paragraph ends where a block begins
            if not token.endswith("/>"):
                stack.append(opened(name, token, stack[-1]))
            continue
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == name:
                del stack[k:]
                break
    flush()
    sizes = [(t.count(" ") + 1, n) for t, n, _ in found]
    shares = [(0, 0.0), *[(w, n / w) for w, n in sizes], (0, 0.0)]
    return [(t, [*map(float, (*shares[k + 1], *shares[k], *shares[k + 2], at.article, at.asides, at.named, at.heading, t[-1] in ".!?…\"'»”)"))])
            for k, (t, _, at) in enumerate(found)]


# The labelled table. Shapes: words, links of the block, of the one before and of the one after; heading; sentence.
# Within the article these are main text, within a container of other things hardly any is.
INSIDE = [
    (9, 0, 8, 0, 60, 0, 1, 0), (3, 0, 0, 0, 45, 0, 1, 1), (12, 0, 6, 1, 4, 0, 1, 0), (1, 0, 12, 0, 1, 0, 0, 1), (1, 0, 1, 0, 5, 1, 0, 1),
    (2, 0, 70, 0, 70, 0, 0, 0), (6, 0, 30, 0, 8, 0, 0, 1), (15, 0, 9, 0, 80, 0, 0, 1), (40, 0, 15, 0, 3, 0, 0, 1), (90, 0.05, 40, 0, 8, 0.5, 0, 1),
    (250, 0, 5, 1, 120, 0, 0, 0), (25, 0.3, 90, 0, 30, 0.2, 0, 1), (8, 0.5, 60, 0, 20, 0, 0, 1), (4, 1, 50, 0, 50, 0, 0, 0), (20, 0.1, 6, 1, 0, 0, 0, 0),
]
# Without an article element around: running text with its short paragraphs and headings is main text,
RUNNING = [
    (60, 0, 8, 0, 45, 0, 0, 1), (35, 0.05, 60, 0, 25, 0, 0, 1), (120, 0.1, 3, 1, 80, 0, 0, 1), (22, 0, 40, 0, 5, 0, 0, 1), (16, 0, 30, 0, 16, 0, 0, 1),
    (45, 0.2, 10, 0, 70, 0, 0, 1), (7, 0, 60, 0, 40, 0, 0, 1), (4, 0, 45, 0, 50, 0, 0, 1), (2, 0, 30, 0, 35, 0, 0, 1), (6, 0, 3, 1, 50, 0, 1, 0),
    (8, 0, 40, 0, 60, 0, 1, 0), (3, 0, 0, 0, 30, 0, 1, 0), (28, 0, 0, 0, 0, 0, 0, 1), (14, 0, 0, 0, 0, 0, 0, 1), (30, 0, 50, 0, 2, 1, 0, 0),
    (10, 0, 50, 0, 45, 0, 0, 0), (3, 0, 0, 0, 0, 0, 0, 1), (5, 0, 0, 0, 4, 0, 0, 1), (6, 0, 2, 1, 18, 0, 1, 0), (5, 0, 6, 0, 20, 0, 1, 0),
    (7, 0, 4, 1, 14, 0, 1, 0), (7, 0, 0, 0, 0, 0, 0, 0), (1, 0, 0, 0, 0, 0, 0, 0),
]
# and link lists, captions of controls and lone labels are not.
AROUND = [
    (2, 1, 0, 0, 2, 1, 0, 0), (5, 1, 3, 1, 6, 1, 0, 0), (14, 0.9, 12, 1, 16, 1, 0, 0), (25, 0.8, 30, 0.8, 20, 0.9, 0, 0), (3, 0, 2, 1, 2, 1, 0, 0),
    (2, 0, 1, 1, 4, 1, 1, 0), (4, 0.5, 3, 1, 50, 0, 0, 0), (1, 0, 2, 0, 1, 0, 0, 0), (3, 0, 2, 0, 4, 0, 0, 0), (6, 0.7, 40, 0, 6, 0.7, 0, 0),
    (9, 1, 60, 0, 8, 1, 0, 0), (5, 0, 8, 1, 0, 0, 0, 0), (3, 1, 4, 1, 5, 1, 0, 1), (7, 0.9, 40, 0, 3, 1, 0, 1), (4, 0, 2, 1, 3, 1, 0, 1),
]
# Within an article, and after another list of links, links alone are not.
LISTED = [s for s in AROUND if s[1] >= 0.8 and s[3] >= 0.8 and s[5] >= 0.8] + [
    (1, 1, 3, 1, 0, 0, 0, 0), (4, 1, 2, 1, 0, 0, 0, 0), (2, 1, 5, 1, 40, 0, 0, 0), (1, 1, 9, 0, 3, 1, 0, 0), (2, 1, 30, 0, 4, 1, 0, 0), (3, 1, 60, 0, 2, 1, 0, 0)]
# Running text: sentences of some length with few links. It is main text also where only a part of a name, or a form, speaks against it,
TEXTS = [s for s in INSIDE + RUNNING if s[0] >= 10 and s[1] <= 0.3 and s[7]] + [(12, 0, 6, 0, 14, 0, 0, 1), (18, 0, 30, 0, 22, 0, 0, 1), (11, 0, 20, 0, 25, 0, 0, 1)]
# and so are headings before it;
TITLES = [(9, 0, 8, 0, 60, 0, 1, 0), (3, 0, 12, 0, 45, 0, 1, 0), (6, 0, 30, 0, 50, 0, 1, 0), (8, 0, 40, 0, 60, 0, 1, 0), (2, 0, 4, 0, 20, 0, 1, 0), (5, 0, 2, 1, 18, 0, 1, 0)]
# but short blocks are captions of controls there.
SHORT = [(4, 0, 30, 0, 2, 0, 0, 0), (1, 0, 4, 0, 9, 0, 0, 0), (5, 0, 12, 0, 1, 0, 0, 0), (3, 0, 25, 0, 40, 0, 0, 1), (7, 0, 3, 0, 2, 0, 0, 0), (3, 0, 0, 0, 1, 0, 0, 1),
         (6, 0, 50, 0, 8, 1, 0, 1), (2, 0, 9, 0, 4, 0, 0, 0), (4, 0, 3, 0, 6, 0, 0, 1), (1, 0, 10, 0, 3, 0, 0, 0), (3, 0, 1, 0, 60, 0, 0, 1), (2, 0, 18, 0, 50, 0, 0, 1)]
# Without any container short blocks are main text between paragraphs, and not among short ones.
BETWEEN = [(2, 0, 20, 0, 19, 0, 0, 1), (3, 0, 16, 0, 24, 0, 0, 1), (1, 0, 18, 0, 40, 0, 0, 1), (5, 0, 22, 0, 15, 0, 0, 1), (4, 0, 35, 0, 18, 0, 0, 0)]
LONE = [(1, 0, 4, 0, 9, 0, 0, 0), (5, 0, 12, 0, 1, 0, 0, 0), (7, 0, 3, 0, 2, 0, 0, 0), (2, 0, 2, 0, 3, 0, 0, 0)]


def rows(shapes: list[tuple], article: int, asides: int, named: int, main: int) -> list[tuple]:
    return [(*s[:6], article, asides, named, *s[6:], main) for s in shapes]


LABELLED = [
    *rows(INSIDE + RUNNING + SHORT + [s for s in AROUND if s[1] < 0.6], 1, 0, 0, 1), *rows(LISTED, 1, 0, 0, 0),
    *rows(RUNNING + BETWEEN, 0, 0, 0, 1), *rows(AROUND + LISTED + LONE, 0, 0, 0, 0),
    *[r for article in (0, 1) for asides in (1, 2) for named in (0, 1) for r in rows(INSIDE + RUNNING + AROUND, article, asides, named, 0)],
    *[r for article in (0, 1) for named in (1, 2) for r in rows(TEXTS + TITLES, article, 0, named, 1) + rows(AROUND + SHORT, article, 0, named, 0)],
]

Tree = float | tuple[int, float, "Tree", "Tree"]


def trained_tree(spark: SparkSession, labelled: list[tuple] = LABELLED) -> Tree:
    """A decision tree fitted by Spark ML, as (feature, threshold, at most, above) down to the class."""
    rows = spark.createDataFrame([tuple(map(float, r)) for r in labelled], [*FEATURES, "label"])
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.coalesce(1))
    model = DecisionTreeClassifier(maxDepth=9, maxBins=64, seed=7).fit(rows)
    lines = iter(model.toDebugString.splitlines()[1:])

    def node() -> Tree:
        line = next(lines).strip()
        if line.startswith("Predict"):
            return float(line.split()[1])
        feature, threshold = re.search(r"feature (\d+) <= ([\d.E-]+)", line).groups()
        left = node()
        next(lines)  # Else
        return int(feature), float(threshold), left, node()

    return node()


def is_main(tree: Tree, features: list[float]) -> bool:
    while not isinstance(tree, float):
        feature, threshold, below, above = tree
        tree = below if features[feature] <= threshold else above
    return tree == 1.0


def extractor(tree: Tree):
    @F.arrow_udf(StringType())
    def extract_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(["\n\n".join(t for t, f in blocks(html or "") if is_main(tree, f)) for html in batch.to_pylist()], pa.string())

    return extract_batches


def extract_text(pages: DataFrame, html: str = "html", into: str = "text", tree: Tree | None = None) -> DataFrame:
    """`pages` with a column `into`: the blocks of the main text, joined by an empty line; the empty string if there is none.

    Blocks are cut at block elements, <br> is white space; character references are decoded; scripts, styles and
    other raw content are left out (of pictures and the like only what is closed). Names of containers are features: whole words weigh
    as much as elements, parts of words little; an article counts under any wrapper but a container of other things, and
    names of the page itself, and ids of headings and paragraphs, tell nothing. The tree keeps or drops whole blocks. Null and empty pages have no text; markup
    that is broken or not closed is read as far as it goes; whole pages are read whatever their length. Rows are
    independent: repeated rows get equal texts, columns may have any name but `into`, an empty table gives no rows.
    """
    return pages.withColumn(into, extractor(trained_tree(pages.sparkSession) if tree is None else tree)(F.col(html)))


# The pages of the given tables have their text in <article>, as <h1> and <p> with <b> and <br>.
SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '<br>', ' ', 'g') AS article FROM pages),
b AS (SELECT page_id, url, [x FOR x IN [
  trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'),
    chr(160), ' '), '\s+', ' ', 'g')) FOR x IN string_split_regex(article, '</?(p|h1)>')] IF x <> ''] AS bs FROM a)
SELECT page_id, url, coalesce(array_to_string(bs, chr(10) || chr(10)), '') AS text, CAST(length(coalesce(array_to_string(bs, chr(10) || chr(10)), '')) AS BIGINT) AS n_chars FROM b
"""


@query("op7_html_text", SQL)
def op7(spark, sf_dir):
    pages = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
