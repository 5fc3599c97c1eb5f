"""Op 2. Main text of web pages by tree scoring.

Blocks of text pass points for their length and commas to their ancestors, the less the farther; a candidate's points shrink with
the share of its text that lies in links. The best container and those of its siblings that also read like text are kept.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import map_rows

#: A comment, or a tag with its attributes; quoted values may hold ">". Possessive, so broken quotes cost no second reading.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt "
                   "u var wbr br img ruby rb rt rp bdo".split())
DROPPED = frozenset("script style textarea title head nav footer aside form noscript iframe template select button input option svg canvas object "
                    "embed audio video dialog menu xmp noembed noframes math fieldset".split())
#: An open element of the set ends when one of the tags starts, unless a scope lies between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu "
                   "nav ol p pre section table ul".split())
NEVER = re.compile(r"\b(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookies?|consent|notice\w*|popup|modal|overlay|newsletter|subscri\w*|sidebar\w*|side-bar|"
                   r"comments?|commentlist|respond|replies|reply|disqus|reader-?comments?|menu\w*|nav|navbar\w*|navigation|breadcrumbs?|pagination|pager|footer\w*|"
                   r"masthead|share\w*|sharing|social\w*|related|recommend\w*|toolbar|widget\w*|login|signup|search\w*)\b")
LIKELY = re.compile(r"\b(?:article\w*|content\w*|main|body|entry\w*|post\w*|story\w*|text)\b")
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar form".split())
BASE = {"article": 30.0, "main": 20.0, "section": 3.0, "div": 5.0, "blockquote": 3.0, "pre": 3.0, "td": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0}
DEEPEST = 512  # as in browsers, elements below that are siblings
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "drop", "weight", "points", "length", "linked", "depth")

    def __init__(self, tag: str, parent: Node | None, attributes: str):
        self.tag, self.parent, self.children, self.points, self.length, self.linked = tag, parent, [], None, 0, 0
        self.depth = parent.depth + 1 if parent else 0
        self.drop, self.weight = tag in DROPPED or tag == "header" and not (parent and parent.inside("article")), 0.0
        if attributes and not attributes.isspace():
            given = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
            named = unescape(f"{given.get('class', '')} {given.get('id', '')}").lower().replace("_", "-")
            likely = bool(LIKELY.search(named))
            never = bool(NEVER.search(named)) and tag not in ("body", "html", "article", "main")
            self.weight = 25.0 * likely - 25.0 * never
            self.drop = self.drop or never and not (likely and not re.search(r"\b(?:comments?|ads?)\b", named)) or \
                given.get("role", "").lower() in ROLES or "hidden" in given or given.get("aria-hidden") == "true" or \
                bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", "")))

    def inside(self, tag: str) -> bool:
        at = self
        while at is not None and at.tag != tag:
            at = at.parent
        return at is not None


def parse(html: str) -> Node:
    """The tree of a page; a child is a node or a text. Broken pages give the tree that browsers would come close to."""
    root = Node("html", None, "")
    at, here, lower = root, 0, None

    def text(piece: str) -> None:
        if piece:
            at.children.append(unescape(piece) if "&" in piece else piece)

    while (found := TAG.search(html, here)) is not None:
        text(html[here:found.start()])
        here = found.end()
        close, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            up = at
            while up is not root and up.tag != tag and not (tag in INLINE and up.tag not in INLINE):
                up = up.parent
            if up is not root and up.tag == tag:
                while at is not up:
                    at = at.parent
                at = at.parent
            continue
        if tag in ("html", "body"):
            continue
        if tag in ENDS_P:
            up = at
            while up is not root and up.tag != "p" and (up.tag in INLINE or up.tag in ("li",)) and up.tag != "li":
                up = up.parent
            if up.tag == "p":
                at = up.parent
        if tag in ENDS:
            ended, scope = ENDS[tag]
            up = at
            while up is not root and up.tag not in scope:
                if up.tag in ended:
                    at = up.parent
                    break
                up = up.parent
        node = Node(tag, at, attributes)
        at.children.append(node)
        if tag in RAW:
            lower = html.lower() if lower is None else lower
            end = lower.find(f"</{tag}", here)
            here = len(html) if end < 0 else end
            at = node
        elif tag not in VOID and not attributes.endswith("/") and node.depth < DEEPEST:
            at = node
    tail = html[here:]
    text(tail if not re.match(r"<[a-zA-Z/!]", tail[tail.rfind("<"):] if "<" in tail else "") else tail[:tail.rfind("<")])
    return root


def blocks(node: Node) -> list[tuple[Node, str, int]]:
    """(container, text, letters in links) of each run of text between block borders, in page order, without dropped parts."""
    out: list[tuple[Node, str, int]] = []
    run: list[str] = []
    links = 0

    def end(owner: Node) -> None:
        nonlocal links
        joined = SPACE.sub(" ", "".join(run)).strip()
        if joined:
            out.append((owner, joined, min(links, len(joined))))
        run.clear()
        links = 0

    stack: list[tuple[Node, Node, int, bool]] = [(node, node, 0, False)]  # node, its block, next child, in a link
    while stack:
        here, block, k, linked = stack.pop()
        if k == len(here.children):
            if here is block:
                end(block)
            continue
        stack.append((here, block, k + 1, linked))
        child = here.children[k]
        if isinstance(child, str):
            run.append(child)
            links += len(child) if linked else 0
        elif child.drop:
            if child.tag not in INLINE:
                end(block)
        elif child.tag == "br":
            run.append(" ")
        elif child.tag in INLINE:
            stack.append((child, block, 0, linked or child.tag == "a"))
        else:
            end(block)
            stack.append((child, child, 0, linked))
    return out


def extract(html: str) -> str:
    """The main text of one page: its blocks joined by one space; empty if there is none."""
    if not html:
        return ""
    found = blocks(parse(html))
    scored: dict[int, Node] = {}
    for owner, text, linked in found:
        up = owner
        while up is not None:
            up.length += len(text)
            up.linked += linked
            up = up.parent
    for owner, text, linked in found:
        points = (1 + text.count(",") + min(len(text) / 100, 3.0)) * (1 - linked / len(text))
        if owner.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "th"):
            points *= 0.5
        holder = owner if owner.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "tr", "pre") else owner.parent
        level = 0
        while holder is not None:
            if holder.points is None:
                holder.points = BASE.get(holder.tag, 0.0) + holder.weight
                scored[id(holder)] = holder
            holder.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            # a wrapper that holds no more text than its child is no further from the block
            level += holder.parent is not None and holder.parent.length > holder.length
            holder = holder.parent
    if not scored:
        return ""

    def final(n: Node) -> float:
        value = (n.points or 0.0) * (1 - n.linked / n.length if n.length else 0.0)
        return value if n.parent is not None else value * 0.5  # the whole page only where nothing in it stands out

    best = max(scored.values(), key=final)
    kept = {id(best)}
    if best.parent is not None:
        least = max(10.0, 0.2 * final(best))
        for n in best.parent.children:
            if isinstance(n, Node) and n is not best and not n.drop and n.length:
                density = n.linked / n.length
                if (n.points is not None and n.tag not in ("header",) and final(n) >= least) or n.tag == "p" and \
                        (n.length > 80 and density < 0.25 or n.length <= 80 and density == 0) or n.tag in ("h1", "h2") and density == 0:
                    kept.add(id(n))
    out = []
    for owner, text, _ in found:
        up = owner
        while up is not None and id(up) not in kept:
            up = up.parent
        if up is not None:
            out.append(text)
    return " ".join(out)


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row; a null or empty page, or one without text, has an empty text.

    Each page is read whole in the task that scanned it; nothing is shuffled. Repeated rows get a row each, other columns are ignored.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                     F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        texts = [extract(h) for h in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id").to_pylist(), "url": batch.column("url").to_pylist(), "text": texts,
                "n_chars": [len(t) for t in texts]}

    return map_rows(rows, "page_id bigint, url string, text string, n_chars bigint", run)
