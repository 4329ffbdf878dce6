"""Main text of web pages by tree scoring.

A tolerant tokeniser builds a tree; boilerplate subtrees (navigation, forms, scripts, adverts, comments ...)
are cut. Each paragraph then passes points for its length and commas to its ancestors (all to the parent, half
to the grandparent, less beyond), every container's sum is discounted by the share of its text inside links,
and the best container is kept. Its siblings, and all else inside the same article or main element, are kept but for lists of
links; beyond those, only headings, paragraphs and blocks with a fifth of the best score.

Pages are independent, so this is one narrow map. The work is linear in the page.
"""

from __future__ import annotations

import html as _html
import re

from pyspark.sql import DataFrame

from bytequarry.llm._common import map_rows

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)|(?P<text>[^<]+|<)", re.S)
_ATTR = re.compile(r"(class|id|role|aria-hidden|hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_RAW = {"script", "style", "noscript", "textarea", "title", "iframe", "xmp", "noembed", "noframes", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Never part of the main text.
_CUT = {"nav", "footer", "aside", "form", "script", "style", "noscript", "textarea", "title", "iframe", "template", "button", "select", "option", "input", "svg", "math", "canvas", "object", "embed", "audio", "video", "dialog", "menu", "head", "fieldset", "label", "datalist", "xmp", "noembed", "noframes"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_PARAGRAPH = {"p", "pre", "blockquote", "td", "dd", "li"}
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: A start tag that closes an open one of the named kinds, up to one of the walls.
_CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of class, id and role that mark boilerplate, and those that save an element from the mark.
_BAD = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adbox|adslot|banners?|sponsor(?:ed|s)?|promo(?:tion|s)?|sidebars?|side|rail|menus?|nav(?:bar|igation)?|breadcrumbs?|footers?|foot|masthead|topbar|toolbar|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|newsletters?|subscribe|subscription|signup|login|comments?|commentlist|disqus|respond|replies|reviews?|shar(?:e|ing)|social|related|recommend(?:ed|ations?)?|trending|popular|widgets?|pagination|pager|tags?|tagcloud|search(?:form|box)?|skip|print|hidden|complementary|contentinfo|dialog|toc|legal|disclaimers?|outbrain|taboola)(?=$|[\s_\-\d])", re.I)
_GOOD = re.compile(r"(?:^|[\s_-])(?:articles?|content|main|body|posts?|entry|story|text|hentry)(?=$|[\s_\-\d])", re.I)
#: Words of the first kind that an element with one of the second kind may have for its layout; all others cut it in any company.
_WEAK = re.compile(r"side|rail|foot|print|tags?|toc|legal|skip|popular|trending|pager|pagination|reviews?", re.I)
#: Marks that say that something is there or not, as of a page that has a sidebar.
_LAYOUT = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without|is|not)[-_]\S+", re.I)
#: How an unmarked line of rights begins.
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved)", re.I)
_MAIN = re.compile(r"(?:^|[\s_-])(?:main|articleBody)(?=$|[\s_-])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Node:
    __slots__ = ("kids", "marks", "parent", "score", "tag")

    def __init__(self, tag, parent, marks=""):
        self.tag, self.parent, self.marks, self.kids, self.score = tag, parent, marks, [], 0.0


def _split_camel(s: str) -> str:
    return re.sub(r"([a-z])([A-Z])", r"\1-\2", s)


def _parse(page: str) -> _Node:
    root = top = _Node("#root", None)
    depth, pos, n = 0, 0, len(page)
    scan = _TOKEN.match
    while pos < n:
        m = scan(page, pos)
        pos = m.end()
        text = m["text"]
        if text is not None:
            if top.kids and isinstance(top.kids[-1], str):
                top.kids[-1] += text
            else:
                top.kids.append(text)
            continue
        if m["cdata"] is not None:
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag, ends, attrs = tag.lower(), m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
        if ends:
            at, k = top, depth
            wall = {"table"} if tag not in ("table", "html", "body") else ()
            while at.parent is not None and at.tag != tag and at.tag not in wall:
                at, k = at.parent, k - 1
            if at.parent is not None and at.tag == tag:
                top, depth = at.parent, k - 1
            elif tag in ("p", "br"):
                top.kids.append(_Node("br", top))
            continue
        if tag in _CLOSES_P:
            at, k = top, depth
            while at.parent is not None and (at.tag in _INLINE or at.tag == "p"):
                if at.tag == "p":
                    top, depth = at.parent, k - 1
                    break
                at, k = at.parent, k - 1
        if same := _SAME.get(tag):
            at, k = top, depth
            while at.parent is not None and at.tag not in same[1]:
                at, k = at.parent, k - 1
                if at.tag in same[0] or (k == depth - 1 and top.tag in same[0]):
                    pass
            # close every open cell or item of the same list
            node, d, close = top, depth, None
            while node is not at and node.parent is not None:
                if node.tag in same[0]:
                    close = (node.parent, d - 1)
                node, d = node.parent, d - 1
            if close:
                top, depth = close
        marks = ""
        if attrs and ("=" in attrs or "hidden" in attrs):
            bits = []
            for a in _ATTR.finditer(attrs):
                name, value = a[1].lower(), (a[2] or "").strip("\"'")
                if name in ("class", "id", "role"):
                    bits.append(_split_camel(value))
                elif name == "hidden" and not attrs[a.start() - 1 : a.start()].isalnum() and attrs[a.start() - 1 : a.start()] != "-":
                    bits.append("hidden")
                elif name == "aria-hidden" and value.lower() == "true":
                    bits.append("hidden")
                elif name == "style" and _HIDDEN.search(value):
                    bits.append("hidden")
            marks = " ".join(bits)
        node = _Node(tag, top, marks)
        top.kids.append(node)
        if tag in _VOID or attrs.endswith("/") and tag in ("svg", "path", "use"):
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(page, pos)
            pos = max(end.end(), pos)
            continue
        if depth < 400:  # deeper markup is read as children of the 400th level, so no recursion runs away
            top, depth = node, depth + 1
    return root


def _kept(node: _Node, inside: bool) -> bool:
    """Is the element not boilerplate? inside: it stands in an article or main element."""
    tag, marks = node.tag, node.marks
    if tag in _CUT or tag == "header" and not inside:
        return False
    if tag in ("html", "body", "article", "main"):
        return not re.search(r"(?:^|[\s_-])(?:comments?|hidden)(?=$|[\s_-])", marks) if tag == "article" else True
    if not marks:
        return True
    bad = [m[0].strip(" \t\r\n\f_-") for m in _BAD.finditer(_LAYOUT.sub(" ", marks))]
    return not bad or bool(_GOOD.search(marks)) and all(_WEAK.fullmatch(x) for x in bad)


def _text(node: _Node, out: list[str]) -> None:
    """Append the text of a pruned subtree; block edges as a newline."""
    stack: list = [(node, 0)]
    while stack:
        at, k = stack.pop()
        if isinstance(at, str):
            out.append(at)
            continue
        block = at.tag not in _INLINE
        if k == 0 and block:
            out.append("\n")
        if k < len(at.kids):
            stack.append((at, k + 1))
            stack.append((at.kids[k], 0))
        elif block:
            out.append("\n")


def _plain(node: _Node) -> str:
    parts: list[str] = []
    _text(node, parts)
    return " ".join("".join(parts).split())


def _prune(root: _Node) -> None:
    """Cut boilerplate and decode character references."""
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        kids = []
        for k in node.kids:
            if isinstance(k, str):
                kids.append(_html.unescape(k) if "&" in k else k)
            elif _kept(k, inside):
                kids.append(k)
                stack.append((k, inside))
        node.kids = kids


def _measure(root: _Node) -> list[tuple[_Node, int, int]]:
    """(node, characters, characters in links) from the leaves up."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [k for k in node.kids if not isinstance(k, str)]
    size: dict[int, tuple[int, int]] = {}
    out = []
    for node in reversed(order):
        chars = links = 0
        for k in node.kids:
            if isinstance(k, str):
                chars += len(k.strip())
            else:
                c, x = size[id(k)]
                chars, links = chars + c, links + x
        if node.tag == "a":
            links = chars
        size[id(node)] = (chars, links)
        out.append((node, chars, links))
    return out


def _best(root: _Node) -> tuple[_Node | None, float, dict[int, tuple[int, int]]]:
    """The container with the best score, that score, and (characters, characters in links) by node."""
    sizes = _measure(root)
    by_id = {id(n): (c, x) for n, c, x in sizes}
    touched: dict[int, _Node] = {}
    for node, chars, links in sizes:
        own = node.tag in _PARAGRAPH or node.tag in ("div", "section", "article", "main", "body", "#root") and any(isinstance(k, str) and len(k.strip()) > 20 or not isinstance(k, str) and k.tag in _INLINE and by_id[id(k)][0] > 20 for k in node.kids)
        if not own or not chars:
            continue
        if node.tag not in _PARAGRAPH:  # loose text counts for the element that holds it
            text, at, level = " ".join(k if isinstance(k, str) else _plain(k) for k in node.kids if isinstance(k, str) or k.tag in _INLINE), node, 0
        else:
            text, at, level = _plain(node), node.parent, 0
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        points *= 1 - links / max(chars, 1)
        while at is not None and level < 5:
            at.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            touched[id(at)] = at
            at, level = at.parent, level + 1
    best, most = None, -1.0
    for node, chars, _ in sizes:
        if _is_main(node):
            if chars and id(node) not in touched:
                touched[id(node)] = node
            node.score += 25
        elif id(node) in touched and node.marks and _GOOD.search(node.marks):
            node.score += 10
    for node in touched.values():
        chars, links = by_id[id(node)]
        node.score *= 1 - links / max(chars, 1)
        if node.score > most and node.tag not in ("html", "#root", "tr", "tbody", "ul", "ol", "dl", *_PARAGRAPH) or best is None:
            best, most = node, node.score
    while best is not None and best.parent is not None and (best.tag in _PARAGRAPH or best.tag in ("tr", "tbody", "ul", "ol", "dl")):
        best = best.parent
    return best, most, by_id


def _is_main(node: _Node) -> bool:
    return node.tag in ("article", "main") or bool(_MAIN.search(node.marks))


def extract(page: str | None) -> str:
    """The main text of a page; empty for null or empty pages and for pages without any."""
    if not page:
        return ""
    root = _parse(page)
    _prune(root)
    best, most, by_id = _best(root)
    if best is None:
        return _plain(root)
    path, top = [best], None
    while path[-1].parent is not None and path[-1].tag != "body":
        path.append(path[-1].parent)
    for node in path:
        if _is_main(node):
            top = node
            if node.tag == "article":
                break
    # inside the article, or beside the best container where no article is marked, all goes on but lists of links
    inside = set(map(id, path[: path.index(top) + 1])) if top is not None else {id(x) for x in path[:2]}
    limit = max(10.0, most * 0.2)
    on_path = set(map(id, path))
    out: list[str] = []

    def loose(run: list, within: bool) -> None:
        """Text and inline elements between blocks."""
        text = " ".join("".join(k if isinstance(k, str) else _plain_inline(k) for k in run).split())
        links = sum(by_id[id(k)][1] for k in run if not isinstance(k, str))
        if text and links < 0.5 * len(text) and (within and not _RIGHTS.match(text) or len(text) > 80):
            out.append(text)

    def walk(node: _Node) -> None:
        if node is best:
            out.append(_plain(node))
            return
        within, run = id(node) in inside, []
        for k in node.kids:
            if isinstance(k, str) or k.tag in _INLINE and id(k) not in on_path:
                run.append(k)
                continue
            loose(run, within)
            run = []
            if id(k) in on_path:
                walk(k)
                continue
            chars, links = by_id[id(k)]
            share = links / max(chars, 1)
            if not chars or share >= 0.5:
                continue
            text = _plain(k)
            if within:
                keep = not _RIGHTS.match(text)
            else:
                keep = k.score >= limit or k.tag in _HEADING and share < 0.25 or k.tag == "p" and share < 0.25 and (chars > 80 or not links and bool(re.search(r"[.!?](?:\s|$)", text)))
            if keep:
                out.append(text)
        loose(run, within)

    walk(path[-1])
    return " ".join(x for x in out if x)


def _plain_inline(node: _Node) -> str:
    parts: list[str] = []
    _text(node, parts)
    return "".join(parts)


def extract_main_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per page: id, the carried columns, text, n_chars (code points).

    A null or empty page, and a page with nothing but boilerplate, has an empty text. Broken markup is read
    as browsers do as far as that decides what is text; whole pages are read, however long. Of containers with
    equal scores the first from the leaves up is the best. Repeated rows give repeated results, an empty table none; other columns are ignored, whatever their names.
    """
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (id_col, *carry)]

    def run(ids, *rest):
        texts = [extract(h) for h in rest[-1]]
        return {id_col: ids, **dict(zip(carry, rest[:-1], strict=True)), "text": texts, "n_chars": [len(t) for t in texts]}

    return map_rows(df, run, [id_col, *carry, html_col], ", ".join([*kinds, "text string", "n_chars long"]), rows=500)
