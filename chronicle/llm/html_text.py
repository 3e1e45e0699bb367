"""Main text of HTML pages from flat text blocks and a small decision tree.

A page becomes a flat list of text blocks.  Each has the word counts and link densities
of itself, of the block before and of the block after, and of its group: the blocks that
stand in the same element, where a single block's own element does not count.  Two hints
come from the markup: whether an element around says that it is furniture (``nav``,
``footer`` ...) or an article, and whether a class, id or role around does.  A decision
tree, trained on the labelled blocks below, keeps or drops the block; a hint alone
decides nothing, as some labelled blocks contradict it.  The tree becomes a column
expression, so pages are parsed in Python and classified and joined without moving
between executors.

A null page counts as empty, and a page without kept blocks gives the empty text.
Elements that are open where browsers close them (``p``, ``li``, ``td`` ...) are closed,
cut references are read as browsers read them, and what is ``hidden`` is no text (what is
hidden from screen readers alone is).  Parsing looks at the innermost elements only, so it is linear in a page's
nesting.  An
inline element whose class says that it is an advert is a block of its own, and the
text around it one block.  Repeated pages give equal rows; a very long page is one row
and costs memory of some times its size.  Columns besides page_id, url and html are not
looked at.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronicle.llm.shared import small_batches

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "group_words", "group_links", "tag", "name")

#: What a split by a hint counts, next to one by words and links.
HINT_WEIGHT = 0.6

#: Labelled blocks, as pages: {*9} stands for nine words of main text, {9} for nine other words.  Each
#: page counts at all SCALES: with so many times its words of main text, and of other text.
SCALES = ((1, 1), (0.25, 1), (4, 1), (0.5, 0.5), (1, 2))
LABELLED = (
    # an article with its heading, short and long paragraphs, and the usual furniture
    "<nav><ul><li><a>{1}</a><li><a>{2}</a><li><a>{1}</a><li><a>{1}</a></ul></nav><div class=ad>{9}</div><article><h1>{*8}</h1><p>{*60}</p><p>{*3}</p><p>{*85}</p><p>{*1}</p></article><footer>{14}</footer>",
    "<nav><ul><li><a>{1}</a><li><a>{1}</a></ul></nav><div class=ad>{6}</div><article><h1>{*14}</h1><p>{*16}</p><p>{*220}</p></article><footer>{9}</footer>",
    "<nav><a>{2}</a> <a>{1}</a></nav><div>{12}</div><article><h1>{*1}</h1><p>{*1}</p></article><footer>{13}</footer>",
    "<nav><a>{2}</a> <a>{1}</a></nav><div class=ad>{12}</div><article><h1>{*2}</h1><p>{*9}</p></article><footer>{20}</footer>",
    "<div class=ad>{10}</div><article>{*18}<br>{*40}</article><footer>{11}</footer>",
    "<nav><a>{1}</a> <a>{3}</a></nav><div class=ad>{14}</div><article><h1>{*10}</h1><p>{*12}</p><p>{*34}</p></article><footer>{17}</footer>",
    "<nav><a>{1}</a> <a>{3}</a></nav><div class=ad>{8}</div><article><h1>{*4}</h1><p>{*60}</p></article><footer>{10}</footer>",
    "<nav><a>{1}</a> <a>{1}</a></nav><div class=ad>{20}</div><article><h1>{*13}</h1><p>{*1}</p><p>{*70}</p><p>{*2}</p><p>{*30}</p></article><footer>{25}</footer>",
    "<nav><a>{1}</a></nav><article><h1>{*3}</h1><p>{*70}</p><p>{*65}</p></article><footer>{6} <a>{2}</a></footer>",
    # links, asides and comments inside an article
    "<article><p>{*40}</p><ul><li class=ad>{2}<li>{*3}<li>{*2}</ul><p>{*50}</p><p><a>{*12}</a></p><div class=comments><p>{8}</p><p>{12}</p></div></article><footer><p>{60}</p><p>{70}</p></footer>",
    "<article><p>{*80}</p><p>{*20}</p><section id=comments><p>{50}</p><p>{70}</p><p>{90}</p><p>{11}</p></section></article><aside><p>{90}</p><p>{80}</p></aside>",
    "<main><p>{*45}</p><span class=advert>{7}</span><p>{*30}</p><div class=newsletter>{18}</div></main><nav><p>{30}</p><p>{110}</p><p>{40}</p></nav>",
    "<article><header><h1><a>{*6}</a></h1></header><p>{*30}</p><p><a>{*22}</a></p><p>{*12}</p><div class=advert>{25}</div><p>{*40}</p><section class=comments><h2>{1}</h2><p>{20}</p><p>{35}</p></section></article>",
    "<main><h2><a>{*5}</a></h2><p>{*45}</p><h2><a>{*4}</a></h2><p>{*120}</p><ul><li>{*4}<li>{*6}<li>{*2}</ul><p>{*8}</p></main><aside><p>{40}</p><p>{25}</p></aside>",
    "<article><p>{*25}</p><aside>{14}</aside><p>{*70}</p><ul><li><a>{3}</a><li><a>{2}</a><li><a>{3}</a></ul></article><div class=comments><p>{60}</p><p>{70}</p><p>{15}</p></div>",
    "<article><h1>{*5}</h1><p>{*3}</p><table><tr><td>{*1}<td>{*2}<tr><td>{*1}<td>{*1}</table><p>{*33}</p></article><form><p>{12}</p><label>{2}</label></form>",
    # pages that only have words and links
    "<div><a>{1}</a> <a>{1}</a> <a>{2}</a></div><div><h1>{*7}</h1><p>{*50}</p><p>{*45}</p><p>{*12}</p><p>{*70}</p></div><div>{10}</div><div><a>{2}</a> <a>{2}</a></div>",
    "<div><div><a>{3}</a></div><div><a>{2}</a></div></div><p>{*30}</p><p>{*25}</p><p>{*5}</p><p>{*41}</p><ul><li><a>{1}</a><li><a>{1}</a></ul>",
    "<table><tr><td><a>{1}</a><td><a>{1}</a></table><div><p>{*90}</p><p>{*2}</p><p>{*64}</p></div><div><p>{6}</p></div><div>{5} <a>{4}</a></div>",
    "<ul><li><a>{2}</a><li><a>{1}</a></ul><h2>{*4}</h2><p>{*38}</p><p>{*52}</p><p><a>{9}</a> {1}</p><p><a>{25}</a> {6}</p><div>{4}</div>",
    "<p>{*45}</p>",
    "<p>{*30}</p><p>{*25}</p><ul><li><a>{1}</a><li><a>{1}</a></ul>",
    "<ul><li><a>{2}</a><li><a>{1}</a></ul><div><p>{*20}</p><p>{*32}</p></div><div>{9}</div>",
    "<div><a>{1}</a> <a>{2}</a></div><div><h2>{*3}</h2><p>{*24}</p><p>{*36}</p></div><div>{15} <a>{1}</a></div><div><a>{3}</a></div>",
    "<nav><a>{2}</a></nav><article><h1>{*4}</h1><p>{*40}</p><p>{*7}</p></article>",
    "<article><h1><a>{*3}</a></h1><p>{*60}</p><p>{*9}</p><p><a>{*14}</a></p><p>{*70}</p></article>",
    "<article>{*6}<p>{*20}</p></article>",
    "<nav>{1}</nav>",
    "<nav><a>{3}</a></nav><p>{*25}</p><p>{*60}</p>",
    # furniture of many words
    "<div class=cookie-notice><p>{28}</p><p>{12}</p></div><main><p>{*60}</p><p>{*9}</p></main><footer><p>{45}</p><p>{8}</p></footer>",
    "<div class=sidebar><p>{45}</p><p>{22}</p><ul><li><a>{2}</a><li><a>{3}</a></ul></div><div class=post-content><p>{*55}</p><p>{*17}</p><p>{*80}</p></div><div class=related><p><a>{8}</a></p><p><a>{7}</a></p></div>",
    "<div role=banner><p>{18}</p></div><div id=main><p>{*22}</p><p>{*6}</p><p>{*48}</p></div><div id=comments><p>{33}</p><p>{52}</p><p>{4}</p></div>",
    "<header><p>{9}</p><p><a>{2}</a></p></header><section><h2>{*3}</h2><p>{*66}</p><p>{*20}</p></section><div class=newsletter><p>{26}</p></div>",
)
#: As LABELLED: names that mislead.
MISLEADING = (
    "<nav><a>{2}</a></nav><div class=banner><h1>{*9}</h1><p>{*80}</p><p>{*64}</p><p>{*72}</p><p>{*50}</p><p>{*40}</p><p>{*3}</p></div><footer>{12}</footer>",
    "<article class=promo><h1>{*6}</h1><p>{*90}</p><p>{*75}</p><p>{*5}</p><p>{*110}</p></article><div class=content>{9} <a>{6}</a></div>",
    "<div class=content><a>{1}</a> <a>{2}</a></div><div class=main><p><a>{3}</a></p><p><a>{2}</a></p></div><p>{*70}</p><p>{*31}</p><p>{*4}</p>",
)

#: Elements that begin and end a block; all others are part of the text around them.
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_RAW = frozenset("script style noscript template iframe textarea title svg annotation annotation-xml object select option button canvas audio video noembed noframes xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag closes, and the elements that it never looks beyond.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
_FURNITURE = frozenset("nav header footer aside form menu dialog fieldset".split())
_ARTICLE = frozenset("article main".split())
_SAYS_FURNITURE = re.compile(
    r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu|side-?bar|foot(?:er)?|header|masthead|breadcrumbs?|comments?|replies|disqus\w*|cookies?|consent|gdpr"
    r"|notices?|alert|pop-?up|modal|overlay|newsletter|subscribe|sign-?up|login|social|share|sharing|related|recommended|trending|popular|widgets?|toolbar|pagination|pager|copyright|legal|disclaimer)"
    r"(?:[-_](?:box|bar|list|block|container|wrapper|wrap|section|area|banner|notice|widget|unit|slot|form|links?|items?|posts?|text|buttons?|inner|top|bottom|left|right|\d+))*",
    re.IGNORECASE,
)
_SAYS_ARTICLE = re.compile(r"(?:article|post|entry|story|content|main)(?:-?(?:body|content|text))?", re.IGNORECASE)
_ROLES = {"navigation": -1, "banner": -1, "contentinfo": -1, "complementary": -1, "search": -1, "form": -1, "dialog": -1, "alert": -1, "main": 1, "article": 1}
_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.DOTALL)
_MARKS = re.compile(r"""(?:^|(?<=[\s"']))(class|id|role|hidden|style)(?=[\s=/>]|\Z)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_GAP = re.compile(r"\s+")


def _hints(tag: str, attributes: str) -> tuple[int, int, bool]:
    """What an element's tag and its names say, -1 furniture, 1 article, 0 nothing, and whether it is hidden."""
    by_tag, by_name = -1 if tag in _FURNITURE else 1 if tag in _ARTICLE else 0, 0
    if attributes and tag not in ("html", "body"):
        for name, value in _MARKS.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or (name == "style" and _UNSEEN.search(value)):
                return by_tag, -1, True
            if name == "role":
                by_name = _ROLES.get(value, 0) or by_name
            elif name in ("class", "id"):
                if any(_SAYS_FURNITURE.fullmatch(x) for x in value.split()):
                    by_name = -1
                elif not by_name and any(_SAYS_ARTICLE.fullmatch(x) for x in value.split()):
                    by_name = 1
    return by_tag, by_name, False


class _Open:
    """An open element: what it and those around it say, its number if it is a block element, and whether any of them is apart."""

    __slots__ = ("tag", "says", "number", "own", "within", "hidden")

    def __init__(self, tag: str, says: tuple[int, int], number: int, own: bool, within: bool, hidden: bool):
        self.tag, self.says, self.number, self.own, self.within, self.hidden = tag, says, number, own, within, hidden


def blocks(page: str) -> list[tuple[str, int, int, int, int, int, int]]:
    """(text, words, words in links, words of the group, those in links, tag hint, name hint) of each text block of a page."""
    found: list[tuple[str, int, int, int, int, int]] = []  # text, words, linked, element, tag hint, name hint
    parent, inner = [0], [False]  # of each block element: the one around it, and whether others are in it
    stack: list[_Open] = []
    many_open: Counter[str] = Counter()  # of each tag in the stack
    # Text that is being gathered: that of the block, and apart from it that of an inline element with a say.
    text: list[str] = []
    aside: list[str] = []
    linked, aside_linked, anchors, pos = 0, 0, 0, 0

    def put(pieces: list[str], linked: int, top: _Open | None) -> None:
        body = _GAP.sub(" ", "".join(pieces)).strip()
        pieces.clear()
        if body:
            words = body.count(" ") + 1
            says = top.says if top else (0, 0)
            found.append((body, words, min(linked, words), top.number if top else 0, *says))

    def block() -> _Open | None:
        return next((x for x in reversed(stack) if not x.own), None)

    def end_block() -> None:
        nonlocal linked
        put(text, linked, block())
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked, aside_linked
        if stack and stack[-1].hidden:
            return
        piece = html_lib.unescape(piece)
        many = len(piece.split()) if anchors else 0
        if stack and stack[-1].within:
            aside.append(piece)
            aside_linked += many
        else:
            text.append(piece)
            linked += many

    def close(k: int) -> None:
        nonlocal aside_linked
        own = next((x for x in stack[k:] if x.own), None)
        if own is not None and not (k and stack[k - 1].within):
            put(aside, aside_linked, own)
            aside_linked = 0
        many_open.subtract(x.tag for x in stack[k:])
        del stack[k:]

    def close_before(tag: str) -> None:
        """Close what the start of a block element closes: paragraphs, and its own kind up to the element that holds it."""
        closes, limit = _CLOSES.get(tag, (frozenset(), frozenset()))
        top = True  # no block element lies above
        for k in range(len(stack) - 1, -1, -1):
            name = stack[k].tag
            if name in limit or not (top or any(many_open[c] for c in closes)):
                break
            if name in closes:
                close(k)
                if tag not in ("tr", "tbody", "tfoot"):
                    break
                top = True
            elif name == "p" and top:
                close(k)
            elif name in _BLOCK:
                top = False

    def push(tag: str, says: tuple[int, int, bool], is_block: bool) -> None:
        around = stack[-1] if stack else None
        outer, number = (around.says, around.number) if around else ((0, 0), 0)
        by_tag = 0 if tag == "header" and outer[0] > 0 else says[0]  # an article's own heading
        # Furniture inside the article is still furniture; an article inside furniture is not one.
        whole = tuple(-1 if x < 0 or y < 0 else max(x, y) for x, y in zip((by_tag, says[1]), outer, strict=True))
        if is_block:
            inner[number] = True
            parent.append(number)
            inner.append(False)
            number = len(parent) - 1
        own = (around.own if around and not is_block else False) or (not is_block and says[1] < 0 and not says[2])
        stack.append(_Open(tag, whole, number, own, own or (around is not None and around.within), says[2] or (around.hidden if around else False)))
        many_open[tag] += 1

    while m := _TOKEN.search(page, pos):
        if m.start() > pos:
            add(page[pos : m.start()])
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in _BLOCK:
                end_block()
            if tag == "a":
                anchors = max(0, anchors - 1)
            for k in range(len(stack) - 1, -1, -1) if many_open[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag not in _BLOCK and stack[k].tag in _BLOCK:
                    break  # the end of an inline element closes no block
            continue
        if tag in _RAW:
            if tag == "title":
                end_block()
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(page, pos)
            pos = end.end() if end else len(page)
            continue
        if tag in _BLOCK:
            end_block()
            close_before(tag)
            if tag not in _VOID:
                push(tag, _hints(tag, m[3]), True)
        elif tag == "br":
            add(" ")
        elif tag not in _VOID:
            if tag == "a":
                anchors += 1
            hints = _hints(tag, m[3]) if m[3] else (0, 0, False)
            if hints[1] < 0 or (stack and not m[0].endswith("/>") and (stack[-1].within or stack[-1].hidden)):
                push(tag, hints, False)
    if pos < len(page):
        add(page[pos:])
    end_block()
    close(0)
    group = [e if inner[e] else parent[e] for e in (f[3] for f in found)]
    words, links = {}, {}
    for g, (_, n, k, *_rest) in zip(group, found, strict=True):
        words[g], links[g] = words.get(g, 0) + n, links.get(g, 0) + k
    return [(body, n, k, words[g], links[g], by_tag, by_name) for g, (body, n, k, _, by_tag, by_name) in zip(group, found, strict=True)]


def features(found: list[tuple[str, int, int, int, int, int, int]]) -> list[tuple[float, ...]]:
    """The FEATURES of each block of a page."""
    own = [(n, k / n) for _, n, k, *_ in found]
    around = [(0, 0.0), *own, (0, 0.0)]
    return [(*own[i], *around[i], *around[i + 2], f[3], f[4] / f[3], f[5], f[6]) for i, f in enumerate(found)]


def labelled_rows() -> np.ndarray:
    """FEATURES and label of every labelled block."""
    out = []
    for page, scales in [(p, SCALES) for p in LABELLED] + [(p, SCALES[:1]) for p in MISLEADING]:
        for scale in scales:
            shown = re.sub(r"\{(\*?)(\d+)\}", lambda m, s=scale: " ".join(["main" if m[1] else "other"] * max(1, round(int(m[2]) * s[not m[1]]))), page)
            found = blocks(shown)
            out += [(*row, float(f[0].startswith("main"))) for row, f in zip(features(found), found, strict=True)]
    return np.array(out)


def train_tree(rows: np.ndarray | None = None, depth: int = 8, least: int = 1):
    """Nested (feature, threshold, at most, above) with probabilities of main text as leaves."""
    table = labelled_rows() if rows is None else rows

    def grow(part: np.ndarray, left: int):
        share = part[:, -1].mean()
        if left == 0 or share in (0.0, 1.0):
            return float(share)
        best = None
        for k in range(part.shape[1] - 1):
            values = np.unique(part[:, k])
            for cut in (values[1:] + values[:-1]) / 2:
                low = part[:, k] <= cut
                sides = part[low], part[~low]
                if min(map(len, sides)) < least:
                    continue
                impurity = sum(len(s) * s[:, -1].mean() * (1 - s[:, -1].mean()) for s in sides) / len(part)
                if FEATURES[k] in ("tag", "name"):
                    impurity += (1 - HINT_WEIGHT) * (share * (1 - share) - impurity)
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, k, float(cut), sides)
        if best is None or best[0] >= share * (1 - share) - 1e-12:
            return float(share)
        return best[1], best[2], grow(best[3][0], left - 1), grow(best[3][1], left - 1)

    return grow(table, depth)


def tree_column(tree, features: list[Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree >= 0.5)
    k, cut, low, high = tree
    return F.when(features[k] <= cut, tree_column(low, features)).otherwise(tree_column(high, features))


_BLOCKS = pa.list_(pa.struct([("text", pa.string()), *[(c, pa.float64()) for c in FEATURES]]))


def page_blocks(pages: DataFrame) -> DataFrame:
    """page_id, url and the flat blocks of each page with their features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [blocks(page or "") for page in batch.column("html").to_pylist()]
            rows = [[{"text": f[0], **dict(zip(FEATURES, map(float, x), strict=True))} for f, x in zip(found, features(found), strict=True)] for found in parsed]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(rows, _BLOCKS)], names=["page_id", "url", "blocks"])

    fields = ", ".join(f"{c} double" for c in FEATURES)
    return small_batches(pages).select("page_id", "url", "html").mapInArrow(run, f"page_id long, url string, blocks array<struct<text string, {fields}>>")


def extract(pages: DataFrame, tree=None) -> DataFrame:
    """page_id, url and the main text of each page."""
    tree = train_tree() if tree is None else tree
    kept = F.filter("blocks", lambda b: tree_column(tree, [b[c] for c in FEATURES]))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return page_blocks(pages).select("page_id", "url", text.alias("text"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
