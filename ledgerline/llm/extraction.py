"""Main text of web pages by two passes of block rules.

A page is read once into blocks: the text between block-level tags, with its length, its share of stop words, the
share that lies in links and the containers it stands in.

1. By itself a block is good (enough stop words), bad (links, or inside a container that is not
   article text by its tag, role, class or id: menus, headers, footers, sidebars, notices, adverts, forms,
   comments, hidden parts), or undecided (too short to tell, or with few stop words: a table, a list, code).
2. An undecided block inherits the label of the nearest decided neighbour.  Where the two sides differ, the one that
   shares the deeper container wins, then the nearer one.  A page without any good block keeps its undecided ones.

Where the page marks its article (article, main and their roles and classes), only blocks inside count.  If class
and id names leave nothing of a page, it is read again without them.

Text rules: character references are decoded, white space inside a block is one space, blocks are joined in page order
by one newline; scripts, styles, templates and form controls are no text.

Defined cases: a null or empty page, or one without article text, has the empty text; unclosed tags end with their
container, an unclosed comment or tag at the end of a page is markup; repeated rows give repeated rows; an empty
table gives no rows.  Every page is one row and is read in one pass, in time linear in its length.  The new columns
replace columns of the same names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT = 70              # characters below which a block is not decided by its words
DENSE = 0.16            # share of stop words of running text
LINKED = 0.4            # share of link characters of a menu
DEPTH = 256             # containers are told apart down to this depth

# fixed lists: tags of HTML, function words of the four languages, names that page templates use
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title".split())
NO_TEXT = set("noscript template textarea select option button iframe svg math canvas object audio video datalist".split())
BLOCK = set("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead
    title tr ul""".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
BAD_TAGS = set("nav footer aside form dialog menu".split())
BAD_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
BAD_NAMES = set("""ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner sidebar aside rail nav navbar
    navigation menu breadcrumb breadcrumbs masthead topbar footer cookie cookies consent gdpr notice notification alert popup modal
    overlay comment comments commentlist respond reply replies discussion disqus share sharing social related recommended
    recommendations newsletter subscribe subscription signup login form search widget widgets toolbar pagination pager
    disclaimer copyright""".split())
ARTICLE_NAMES = set("articlebody article-body article-content post-content entry-content post-body story-body".split())
MAIN_NAMES = set("content main main-content article post story".split())
COMMENT_HEADING = re.compile(r"""(?ix) \W* \d* \s* (comments?|responses?|replies|leave\s+a\s+(reply|comment)|kommentare?|commentaires?|
    comentarios?|related(\s+(posts|articles|stories))?|share\s+this|you\s+may\s+also\s+like) \s* \W* \d* \W*""")
STOP_WORDS = set("""
    the of and to in a is that it for was on as with be by this are at from or an not have has had but they you he she his her we
    which were been their its will would there what if can all one who when more no out so up said about into than them other
    de la le les des du un une et en que qui dans pour par sur au aux avec est pas ce cette ces il elle ils elles son sa ses se ne
    plus ou mais comme sont nous vous leur lui être fait
    der die das und den dem von zu mit sich auf für ist im nicht ein eine einen einem einer des als auch es an werden aus er hat
    dass sie nach wird bei noch wie über so zum war haben nur oder aber vor zur bis mehr durch man
    el los las del una por con para como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay
    donde quien desde todo nos durante uno ni contra otros ese eso ante ellos y su al lo no es""".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*+>"""
                   r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[^\W\d_]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SELF_CLOSED = re.compile(r"""(^|[\s"'])/$""")
OPEN_END = re.compile(r"<[a-zA-Z/!?]")


class Node:
    """An open element: what holds for the text inside."""
    __slots__ = ("tag", "up", "depth", "box", "bad", "region", "link", "mute", "heading")

    def __init__(self, tag: str, up: "Node | None"):
        self.tag, self.up = tag, up
        inherited = (up.depth, up.box, up.bad, up.region, up.link, up.mute, up.heading) if up else (0, self, False, 0, False, False, False)
        self.depth, self.box, self.bad, self.region, self.link, self.mute, self.heading = inherited


@dataclass
class Block:
    text: str
    linked: int             # characters in links
    box: Node               # the container it stands in
    bad: bool               # by its containers
    region: int             # 2: inside an article, 1: inside the main part, 0: elsewhere
    heading: bool
    label: str = ""


def names_of(value: str) -> tuple[set[str], set[str]]:
    """The names of a class or id attribute, whole and as their words."""
    whole = set(value.lower().split())
    words = set()
    for name in value.split():
        parts = [w.lower() for w in re.split(r"[^A-Za-z]+", CAMEL.sub("-", name)) if w]
        if parts and parts[0] not in ("has", "no", "with", "without", "is"):
            words.update(parts)
    return whole, words


def open_node(tag: str, rest: str, up: Node, by_name: bool) -> Node:
    """A new element below ``up``, judged by its tag and attributes."""
    node = Node(tag, up)
    if tag in BLOCK and tag not in HEADINGS and tag not in ("p", "li"):
        node.depth = up.depth + 1
        if node.depth <= DEPTH:
            node.box = node
    node.link |= tag == "a"
    node.mute |= tag in NO_TEXT
    node.heading |= tag in HEADINGS
    attrs = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(rest)} if rest.strip(" /") else {}
    whole, words = names_of(f"{attrs.get('class', '')} {attrs.get('id', '')}") if by_name else (set(), set())
    role = attrs.get("role", "").lower()
    if tag == "main" or role == "main":
        node.bad, node.region = False, max(node.region, 1)
    elif tag == "article" or role == "article" or attrs.get("itemprop", "").lower() == "articlebody" or whole & ARTICLE_NAMES:
        node.bad &= any_up(up, lambda x: x.bad and x.tag != "form")
        node.region = 2
    elif whole & MAIN_NAMES and tag not in ("html", "body"):
        node.region = max(node.region, 1)
    hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attrs.get("style", ""))
    bad_tag = tag in BAD_TAGS or tag == "header" and node.region == 0 or role in BAD_ROLES
    if bad_tag or hidden or words & BAD_NAMES and tag not in ("html", "body", "main"):
        node.bad = True
    return node


def any_up(node: Node | None, test) -> bool:
    while node and node.up:
        if test(node):
            return True
        node = node.up
    return False


class Reader:
    """Cuts a page into blocks."""

    def __init__(self, by_name: bool = True):
        self.by_name = by_name
        self.blocks: list[Block] = []
        self.stack = [Node("", None)]
        self.open: dict[str, int] = {}
        self.pieces: list[str] = []
        self.linked = 0
        self.at: Node | None = None         # where the block's first text stood

    def text(self, raw: str) -> None:
        top = self.stack[-1]
        if not raw or top.mute:
            return
        piece = unescape(raw) if "&" in raw else raw
        if self.at is None and not piece.isspace():
            self.at = top
        if top.link:
            self.linked += len(piece.strip())
        self.pieces.append(piece)

    def close_block(self) -> None:
        if self.at is not None:
            at, text = self.at, " ".join("".join(self.pieces).split())
            self.blocks.append(Block(text, self.linked, at.box, at.bad, at.region, at.heading))
            if at.heading and len(text) < SHORT and COMMENT_HEADING.fullmatch(text):
                self.blocks[-1].bad = at.box.bad = True         # and what follows in its container
        self.pieces, self.linked, self.at = [], 0, None

    def cut(self, depth: int) -> None:
        for node in self.stack[depth:]:
            self.open[node.tag] -= 1
        del self.stack[depth:]

    def start(self, tag: str, rest: str) -> None:
        if tag == "br":
            self.pieces.append(" ")
        if tag in BLOCK:
            self.close_block()
            if self.open.get("p"):              # a block ends an open paragraph of its container
                i = len(self.stack) - 1
                while self.stack[i].tag not in BLOCK and i:
                    i -= 1
                if self.stack[i].tag == "p":
                    self.cut(i)
        if tag in VOID or tag not in BLOCK and SELF_CLOSED.search(rest):
            return
        up = self.stack[-1]
        node = open_node(tag, rest, up, self.by_name)
        if up.box.bad and not up.bad and tag not in ("main", "article"):
            node.bad = True                     # a comment heading stood before it
        self.stack.append(node)
        self.open[tag] = self.open.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.close_block()
        if not self.open.get(tag):
            return
        i = len(self.stack) - 1
        while self.stack[i].tag != tag:
            if tag not in BLOCK and self.stack[i].tag in BLOCK:
                return                          # an inline end tag doesn't end its container
            i -= 1
        self.cut(i)

    def read(self, page: str) -> list[Block]:
        last = page.rfind(">") + 1              # what opens behind it is an unfinished tag
        pos = 0
        while m := TOKEN.search(page, pos, last):
            self.text(page[pos:m.start()])
            pos = m.end()
            tag = (m["tag"] or "").lower()
            if m["data"] is not None:
                self.text(m["data"])
            elif tag and m["end"]:
                self.end(tag)
            elif tag in RAW:
                self.close_block() if tag == "title" else None
                end = re.compile(f"</{tag}", re.I).search(page, pos)
                pos = end.start() if end else len(page)
            elif tag:
                self.start(tag, m["rest"])
        rest = page[pos:]
        cut = OPEN_END.search(rest)
        self.text(rest[:cut.start()] if cut else rest)
        self.close_block()
        return self.blocks


def first_pass(block: Block) -> str:
    """good, bad or undecided, by the block alone."""
    n = len(block.text)
    linked = block.linked / n
    if block.bad or linked > LINKED or (n < 3 * SHORT and (block.text[0] == "©" or block.text.lower().startswith("copyright"))):
        return "bad"
    if n < SHORT:
        return "bad" if linked > LINKED / 2 else ""
    words = WORD.findall(block.text.lower())
    dense = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if dense >= DENSE:
        return "good"
    return "" if linked <= LINKED / 2 else "bad"


def shared_depth(a: Node, b: Node) -> int:
    """The depth of the deepest container of both."""
    while a is not b:
        if a.depth >= b.depth:
            a = a.up.box if a.up else a
        else:
            b = b.up.box if b.up else b
    return a.depth


def second_pass(blocks: list[Block]) -> None:
    """Undecided blocks take the label of the nearest decided neighbour."""
    first = [first_pass(b) for b in blocks]
    counts = [bool(x) for x in first]
    def nearest(order):
        seen, inside, out = None, None, [None] * len(blocks)
        for i in order:
            out[i] = inside if blocks[i].region else seen
            if counts[i]:
                seen = i
                inside = inside if blocks[i].bad else i     # a foreign container says nothing of an article's blocks
        return out

    before, after = nearest(range(len(blocks))), nearest(range(len(blocks) - 1, -1, -1))
    any_good = "good" in first
    for i, b in enumerate(blocks):
        b.label = first[i]
        if b.label:
            continue
        sides = [j for j in (before[i], after[i]) if j is not None]
        labels = {first[j] for j in sides}
        if not any_good or not labels and b.region:
            b.label = "good"
        elif len(labels) == 1:
            b.label = labels.pop()
        elif labels:
            rank = {first[j]: (shared_depth(b.box, blocks[j].box), -abs(i - j)) for j in sides}
            b.label = "good" if rank["good"] > rank["bad"] or rank["good"] == rank["bad"] and b.region else "bad"
        else:
            b.label = "bad"


def kept_blocks(page: str, by_name: bool = True) -> list[Block]:
    blocks = Reader(by_name).read(page)
    second_pass(blocks)
    good = [b for b in blocks if b.label == "good"]
    # the narrowest region that holds most of the text is the article
    size = lambda level: sum(len(b.text) for b in good if b.region >= level)
    main, article = size(1), size(2)
    level = 2 if article and 2 * article >= main else 1 if main else 0
    return [b for b in good if b.region >= level]


def main_text(page: str | None) -> str:
    """The article text of a page, a line for each block."""
    if not page:
        return ""
    return "\n".join(b.text for b in kept_blocks(page) or kept_blocks(page, by_name=False))


def extract_main_text(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` of every row with ``text`` and ``n_chars`` (code points)."""
    keep = [c for c in keep if c not in ("text", "n_chars")]
    rows = df.select(F.col(f"`{html_col}`").cast("string").alias("html"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    kept = rows.dtypes[1:]

    def run(batches):
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[*(c for c, _ in kept), "text", "n_chars"])

    schema = ", ".join([*(f"{c} {kind}" for c, kind in kept), "text string, n_chars long"])
    return rows.mapInArrow(run, schema).toDF(*keep, "text", "n_chars")
