"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page's markup is cut into tags and texts by one pattern and a cursor that never goes back, so the
time grows with the page's length, whatever it holds; a stack of open elements, with the closing
rules of the HTML standard for elements that end by themselves, gives every text its ancestors. An
unclosed comment or script takes the rest of the page, a tag that nothing ends is text. Texts between two block-level borders form one leaf block. The field gives each block
a label (text of the article or not) from features of its ancestors' tag names, their class and
id words, and of its text, and from its neighbour's label; Viterbi decoding picks the most likely
labels for the whole page. It is trained on the labelled pages of ``html_training`` by gradient
steps on the exact log-likelihood (forward-backward).

Scripts, styles, forms' controls, comments and what is no visible text are no blocks at all.
Character references are decoded, white space inside a block becomes one space, and the blocks
labelled as text are joined by one space, in page order. Nothing is capped: a page may have any
number of blocks of any length. Null and empty pages, and pages without such blocks, give the
empty text. Rows are mapped one to one; ids may be null or repeat; only named columns are read.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.llm.common import arrow_map, table

#: Where markup begins; for a tag, its name and attributes up to the first ``>`` outside a quoted value. No part gives back what it
#: took, so a match costs what it covers. A quote that nothing closes is an ordinary character.
TOKEN = re.compile(
    r"""<(?:(!--|!\[CDATA\[|[!?])|(/?)([a-zA-Z][^\s/>\x00]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)(>?))"""
)
CLOSES = {"!--": "-->", "![CDATA[": "]]>"}
#: One attribute with its value; values are read as a whole, so that nothing inside them is taken for a name.
ATTRIBUTE = re.compile(r"""([^\s/>"'=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+))?""")
#: References of more digits than any character has: leading zeros go, the rest stand for no character.
ZEROS = re.compile(r"(&#[xX]?)0+(?=[0-9a-fA-F])")
TOO_LONG = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[a-z]+")

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg annotation annotation-xml select option button object canvas audio video".split())
#: Elements whose content the standard reads without markup, up to their end tag.
UNPARSED = frozenset("script style textarea title iframe noembed noframes xmp noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An element that opens one of these ends an open paragraph.
ENDS_P = BLOCK - frozenset("body head html legend li dd dt td th tr tbody thead tfoot frameset".split()) | {"p", "pre"}
#: A new one ends the open one of the same family, unless the given container lies between.
SIBLINGS = {"li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}


# Words of class, id and role attributes that hint at what an element is for.
HINTS = {
    "furniture": frozenset("nav navigation navbar menu menubar breadcrumb breadcrumbs header masthead banner footer sidebar aside toolbar topbar pagination pager skip".split()),
    "advert": frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner popup".split()),
    "notice": frozenset("cookie cookies consent gdpr notice alert modal newsletter subscribe subscription signup login paywall disclaimer".split()),
    "social": frozenset("comment comments disqus reply replies respond share sharing social follow author byline related recommended trending popular tags widget rating".split()),
    "article": frozenset("article content post entry story text main body prose".split()),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS = tuple(".!?…:;\"”»)。！？")
TAGS = ("article", "main", "nav", "header", "footer", "aside", "form", "section", "div", "p", "li", "td", "th", "table", "blockquote", "pre", "figure", "figcaption", "dd", "dt", "ul", "ol", "address", "label", "fieldset", "menu", "dialog", "details", "small", "a")
FEATURES = (
    "bias", *(f"in_{t}" for t in TAGS), *(f"leaf_{t}" for t in TAGS), "leaf_heading", "leaf_body", *HINTS, "hidden", "links", "all_linked", "short", "words_3", "words_10", "words_25", "words_60",
    "ends", "copyright", "article_clean", "outside", "first", "last",
)
PLACE = {name: k for k, name in enumerate(FEATURES)}
BAD_TAGS = frozenset(("nav", "header", "footer", "aside", "form", "menu", "dialog"))
ARTICLE_TAGS = frozenset(("article", "main"))
#: Names whose elements the features ask for.
TRACKED = frozenset(TAGS) | BAD_TAGS | ARTICLE_TAGS
HINT_OF = {word: tuple(h for h, words in HINTS.items() if word in words) for word in frozenset().union(*HINTS.values())}
UNPARSED_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in UNPARSED}


class Node:
    """An open element: what its own and its ancestors' names and attributes say, in sets of bounded size that nodes share."""

    __slots__ = ("name", "inside", "leaf", "hints", "hidden", "raw", "open")

    def __init__(self, name: str, above: Node | None, hints: frozenset[str], hidden: bool):
        self.name, self.open = name, True
        inside, of = (above.inside, above.hints) if above else (frozenset(), frozenset())
        self.inside = inside | {name} if name in TRACKED and name not in inside else inside
        self.hints = of if hints <= of else of | hints
        self.leaf = name if name in BLOCK else above.leaf if above else "body"
        self.hidden = hidden or bool(above) and above.hidden
        self.raw = name in RAW or bool(above) and above.raw


NOWHERE = Node("", None, frozenset(), False)


@dataclass
class Block:
    """Text of a leaf block, the innermost element around its start, and how many of its characters are links."""

    text: str
    node: Node
    linked: int


def attributes(raw: str) -> tuple[frozenset[str], bool]:
    """Words of an element's class, id and role, and whether it is hidden."""
    words, hidden = set(), False
    seen = set()
    for name, value in ATTRIBUTE.findall(raw):
        value, name = value.strip("\"'").lower(), name.lower()
        if name in seen:  # the first of a name counts
            continue
        seen.add(name)
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
        elif name in ("class", "id", "role"):
            words.update(WORD.findall(value))
    return frozenset(words), hidden


def decoded(text: str) -> str:
    """Character references decoded, however many digits they have."""
    if "&#" in text:
        text = TOO_LONG.sub("\ufffd", ZEROS.sub(r"\1", text))
    return html.unescape(text)


class Parser:
    """Cuts a page into leaf blocks with one cursor that never goes back.

    The stack of open elements has, for each name, the places at which it is open, so closing rules
    look nothing through. An element that is closed under open ones stays on the stack, marked.
    """

    def __init__(self, page: str):
        self.page = page
        self.blocks: list[Block] = []
        self.stack: list[Node] = []
        self.places: dict[str, list[int]] = {}
        self.block_places: list[int] = []
        self.parts: list[str] = []
        self.linked = 0
        self.owner: Node | None = None

    def close(self) -> None:
        """End the leaf block."""
        if self.parts:
            text = SPACE.sub(" ", decoded("".join(self.parts))).strip()
            if text:
                self.blocks.append(Block(text, self.owner or NOWHERE, min(self.linked, len(text))))
            self.parts.clear()
        self.linked, self.owner = 0, None

    def add(self, text: str) -> None:
        top = self.stack[-1] if self.stack else NOWHERE
        if not text or top.raw:
            return
        words = text.strip()
        if self.owner is None and words:
            self.owner = top
        self.parts.append(text)
        if self.places.get("a"):
            self.linked += len(words)

    def push(self, name: str, raw: str) -> None:
        words, hidden = attributes(raw) if raw else (frozenset(), False)
        hints = frozenset(hint for word in words for hint in HINT_OF.get(word, ()))
        self.places.setdefault(name, []).append(len(self.stack))
        if name in BLOCK:
            self.block_places.append(len(self.stack))
        self.stack.append(Node(name, self.stack[-1] if self.stack else None, hints, hidden))

    def pop_to(self, place: int) -> None:
        if self.block_places and self.block_places[-1] >= place:
            self.close()
        while len(self.stack) > place:
            node = self.stack.pop()
            if node.open:
                self.places[node.name].pop()
                if node.name in BLOCK:
                    self.block_places.pop()

    def last(self, names: tuple[str, ...]) -> int:
        """The innermost place at which one of the names is open, or -1."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def end_open(self, names: tuple[str, ...], walls: tuple[str, ...]) -> None:
        if (place := self.last(names)) > self.last(walls):
            self.pop_to(place)

    def end_tag(self, name: str) -> None:
        place = self.last((name,))
        if place < 0:
            return
        # An inline end tag does not reach over an open block, but for links and marked-up text left open.
        if name in BLOCK or name in RAW or not self.block_places or self.block_places[-1] < place:
            self.pop_to(place)
        else:
            self.stack[place].open = False
            self.places[name].pop()

    def start_tag(self, name: str, raw: str) -> bool:
        """Whether an element was opened."""
        if name in BLOCK:
            self.close()
        if name == "br":
            self.add(" ")
        if name in ENDS_P:
            self.end_open(("p",), ("table", "button", "td", "th", "object"))
        if name in SIBLINGS:
            self.end_open(*SIBLINGS[name])
        if name in VOID or raw.endswith("/") and name not in BLOCK:
            return False
        self.push(name, raw)
        return True

    def parse(self) -> list[Block]:
        page, at, last_end, quoted = self.page, 0, self.page.rfind(">"), True
        while at <= last_end and (token := TOKEN.search(page, at)) is not None:
            start, end = token.span()
            opener, slash, name, raw, closed = token.groups()
            if opener is None and (not closed or not quoted):
                # No tag ends outside quotes from here on: quotes count for nothing in the rest of the page.
                quoted, end = False, page.find(">", start) + 1
                if not end:
                    break
                raw = page[token.start(4) : end - 1]
            self.add(page[at:start])
            at = end
            if opener is not None:
                mark = CLOSES.get(opener, ">")
                stop = page.find(mark, at)
                at = stop + len(mark) if stop >= 0 else len(page)
                continue
            name = name.lower()
            if slash:
                self.end_tag(name)
            elif self.start_tag(name, raw) and name in UNPARSED:
                ended = UNPARSED_END[name].search(page, at)
                at = ended.start() if ended else len(page)
        self.add(page[at:])
        self.close()
        return self.blocks


def leaf_blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order, in time that grows with its length."""
    return Parser(page).parse()


def word_count(text: str) -> int:
    """Words by spaces, or by their bytes in scripts that set none: two characters of three bytes count as one."""
    spaced = text.count(" ") + 1
    return spaced if text.isascii() else max(spaced, (len(text.encode()) - len(text)) // 4)


def block_features(blocks: list[Block], has_article: bool | None = None) -> np.ndarray:
    """Feature rows of a page's blocks, or of a stretch of them if ``has_article`` says what holds for the page."""
    out = np.zeros((len(blocks), len(FEATURES)))
    if has_article is None:
        has_article = any(b.node.inside & ARTICLE_TAGS for b in blocks)
        if len(blocks):
            out[0, PLACE["first"]] = out[-1, PLACE["last"]] = 1
    shared: dict[tuple, list[int]] = {}
    for row, b in zip(out, blocks, strict=True):
        node = b.node
        key = (node.inside, node.leaf, node.hints)
        if key not in shared:
            on = [PLACE["bias"], *(PLACE[f"in_{t}"] for t in node.inside if f"in_{t}" in PLACE)]
            if f"leaf_{node.leaf}" in PLACE:
                on.append(PLACE[f"leaf_{node.leaf}"])
            on += [PLACE["leaf_heading"]] * (node.leaf in HEADINGS) + [PLACE["leaf_body"]] * (node.leaf == "body")
            on += [PLACE[h] for h in node.hints]
            inside = bool(node.inside & ARTICLE_TAGS)
            clean = not BAD_TAGS & node.inside and not node.hints - {"article"}
            on += [PLACE["article_clean"]] * (inside and clean) + [PLACE["outside"]] * (has_article and not inside)
            shared[key] = on
        row[shared[key]] = 1
        n = word_count(b.text)
        row[PLACE["hidden"]] = node.hidden
        row[PLACE["links"]] = b.linked / len(b.text)
        row[PLACE["all_linked"]] = b.linked >= len(b.text) - 2
        row[PLACE["short"]] = len(b.text) < 20 and n < 8
        for least in (3, 10, 25, 60):
            row[PLACE[f"words_{least}"]] = n >= least
        row[PLACE["ends"]] = b.text.endswith(ENDS)
        row[PLACE["copyright"]] = "©" in b.text
    return out


def block_scores(blocks: list[Block], weight: np.ndarray, step: int = 4096) -> np.ndarray:
    """Scores of both labels for each block, from feature rows of a stretch of blocks at a time."""
    if len(blocks) <= step:
        return block_features(blocks) @ weight
    has_article = any(b.node.inside & ARTICLE_TAGS for b in blocks)
    out = np.concatenate([block_features(blocks[k : k + step], has_article) @ weight for k in range(0, len(blocks), step)])
    out[0] += weight[PLACE["first"]]
    out[-1] += weight[PLACE["last"]]
    return out


@dataclass
class Field:
    """Weights of the two labels' features and of the four label pairs."""

    weight: np.ndarray
    pair: np.ndarray

    def decode(self, rows: np.ndarray) -> np.ndarray:
        """The most likely labels of a page's blocks, from their features."""
        return self.decode_scores(rows @ self.weight)

    def decode_scores(self, scores: np.ndarray) -> np.ndarray:
        """The same from each block's scores of both labels."""
        if not len(scores):
            return np.zeros(0, np.int64)
        score = scores.tolist()
        (p00, p01), (p10, p11) = self.pair.tolist()
        a, b, back = score[0][0], score[0][1], []
        for s0, s1 in score[1:]:
            stay, turn = a + p00, b + p10
            rise, keep = a + p01, b + p11
            back.append((turn > stay, keep > rise))
            a, b = (turn if turn > stay else stay) + s0, (keep if keep > rise else rise) + s1
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return np.array(out[::-1])


def likelihood(field: Field, rows: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of a page's labels, and its gradient by the weights and the pairs."""
    score, n = rows @ field.weight, len(rows)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    forward[0] = score[0]
    for k in range(1, n):
        forward[k] = score[k] + np.logaddexp.reduce(forward[k - 1][:, None] + field.pair, axis=0)
    for k in range(n - 2, -1, -1):
        backward[k] = np.logaddexp.reduce(field.pair + (score[k + 1] + backward[k + 1])[None, :], axis=1)
    total = np.logaddexp.reduce(forward[-1])
    chance = np.exp(forward + backward - total)
    truth = np.eye(2)[labels]
    pairs = np.zeros((2, 2))
    for k, (a, b) in enumerate(pairwise(labels)):
        pairs[a, b] += 1
        pairs -= np.exp(forward[k][:, None] + field.pair + (score[k + 1] + backward[k + 1])[None, :] - total)
    own = score[np.arange(n), labels].sum() + sum(field.pair[a, b] for a, b in pairwise(labels))
    return own - total, rows.T @ (truth - chance), pairs


def train(pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 60, rate: float = 0.3, smooth: float = 0.02) -> Field:
    """Adaptive gradient steps, page by page in a fixed order, with a quadratic penalty."""
    field = Field(np.zeros((len(FEATURES), 2)), np.zeros((2, 2)))
    squares = [np.full_like(field.weight, 1e-8), np.full_like(field.pair, 1e-8)]
    rng = np.random.default_rng(3)
    for _ in range(rounds):
        for k in rng.permutation(len(pages)):
            rows, labels = pages[k]
            if not len(rows):
                continue
            _, by_weight, by_pair = likelihood(field, rows, labels)
            for value, slope, square in ((field.weight, by_weight - smooth * field.weight, squares[0]), (field.pair, by_pair - smooth * field.pair, squares[1])):
                square += slope**2
                value += rate * slope / np.sqrt(square)
    return field


@lru_cache(maxsize=1)
def trained() -> Field:
    """The field, trained on the labelled pages of this package."""
    from cellgrid.llm.html_training import labelled_pages

    pages = []
    for page, wanted in labelled_pages():
        blocks = leaf_blocks(page)
        pages.append((block_features(blocks), np.array([wanted(b.text) for b in blocks], np.int64)))
    return train(pages)


def main_text(page: str, field: Field) -> str:
    blocks = leaf_blocks(page)
    labels = field.decode_scores(block_scores(blocks, field.weight))
    return " ".join(b.text for b, on in zip(blocks, labels, strict=True) if on and not b.node.hidden)


def extract(df: DataFrame, field: Field | None = None, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The columns of ``keep`` and ``text``, the main text of each page."""
    model = trained() if field is None else field
    names = list(keep)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(page.as_py() or "", model) for page in batch.column(len(names))]
        return pa.record_batch([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*names, "text"])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names)
    return arrow_map(df.select(*names, F.col(html_col).alias("html")), kernel, f"{kinds}, text string")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
