"""Main-text extraction: content marginals of a tree-structured graphical model over the DOM."""

from __future__ import annotations

import html as entities
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

#: A tag's name, and one part of what follows it: a gap, or an attribute. Quotes open a value only after "=", as in browsers; one that
#: is never closed opens none. Possessive: a part is read once, whatever its length.
_NAME = r"<(/?)([a-zA-Z][^\s/>]*+)"
_PART = r"[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++))?+"
_TAG = re.compile(rf"{_NAME}((?:{_PART})*+)>")
_CUT = re.compile(rf"{_NAME}([^>]*+)>")
_NAME, _PART = re.compile(_NAME), re.compile(_PART)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template iframe object svg math canvas audio video head title textarea select option datalist map".split())
RAW = frozenset("script style textarea title noscript iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class names and ids that mark page furniture: as a whole name, before a hyphen and after one; after a hyphen only; with a
#: part of the site before them.
_FURNITURE = (
    "nav navbar navigation menu menubar sidebar side-bar footer foot masthead topbar top-bar ad ads adv advert adverts advertisement sponsor sponsored sponsors "
    "promo promos banner banners cookie cookies consent gdpr popup modal overlay comment comments disqus respond replies related recommended recommendations "
    "share sharing social subscribe newsletter signup login breadcrumb breadcrumbs widget widgets pagination pager toolbar searchbox"
).replace(" ", "|")
_FURNITURE_END = "notice|notices|alert|alerts|reply|tags|byline|meta|copyright|legal|search|form|links"
_SITE = "site|page|main|global|top|app|blog"
NEGATIVE = re.compile(
    rf"(?i)(?:^|\s)(?:(?:[\w]+[-_])*(?:{_FURNITURE})(?:[-_][\w-]*)?|(?:[\w]+[-_])*(?:{_FURNITURE_END})|(?:(?:{_SITE})[-_])?(?:header|head)(?:[-_](?:inner|wrap\w*|bar|top))?)(?=\s|$)"
)
POSITIVE = re.compile(
    r"(?i)(?:^|[-_\s])(?:article\w*|content|main\w*|post|post-?body|story\w*|entry\w*|body\w*|text|prose|page-?content|article-?text)(?:$|[-_\s])"
)
COPYRIGHT = re.compile(r"(?i)^\s*(?:\u00a9|\(c\)|copyright\b)|all rights reserved")
ROLE_NEGATIVE = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar form".split())
GROUPS = {
    "p": "p", "h1": "h1", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "li": "li", "ul": "list", "ol": "list", "dl": "list", "dt": "li", "dd": "li",
    "div": "div", "section": "section", "article": "article", "main": "main", "nav": "nav", "aside": "aside", "footer": "footer", "header": "header", "form": "form",
    "fieldset": "form", "button": "form", "label": "form", "table": "table", "tbody": "table", "tr": "table", "td": "cell", "th": "cell", "blockquote": "quote",
    "pre": "quote", "figure": "figure", "figcaption": "figure", "body": "body", "html": "body", "address": "address", "dialog": "form", "menu": "nav",
}
FEATURES = [
    "bias", *sorted(set(GROUPS.values())), "other", "negative", "positive", "role_negative", "hidden", "own_text", "words10", "words40", "links_most", "links_some",
    "sentence", "below_most", "below_links", "below_prose", "heart", "round_heart", "copyright", "lead",
]
_AT = {f: i for i, f in enumerate(FEATURES)}
#: Pair weights by the child's kind (plain, marked as page furniture, marked as content): both content, both not.
KINDS = 3
SIZE = len(FEATURES) + 2 * KINDS
BREAK = -1


def _tag(source: str, at: int, dead: set[int]) -> re.Match | None:
    """The tag at ``at``: up to the first ">" outside quoted values, or the first of all if every later one is quoted.

    ``dead`` gathers where parts start from which no ">" outside quotes follows, so that a page's tail is searched once.
    """
    if not dead and (m := _TAG.match(source, at)):
        return m
    if (name := _NAME.match(source, at)) is None:
        return None
    pos, seen = name.end(), [name.end()]
    while pos not in dead and (part := _PART.match(source, pos)):
        pos = part.end()
        seen.append(pos)
    if pos not in dead and source.startswith(">", pos):
        return _TAG.match(source, at)
    dead.update(seen)
    return _CUT.match(source, at)


class Page:
    """The block tree of a page: parents (in page order, root first), features, pieces of text by block, labels if given."""

    __slots__ = ("features", "kinds", "labels", "parents", "pieces")

    def __init__(self, source: str, labelled: bool = False):
        self.parents, self.kinds, self.labels, self.pieces = [-1], [0], [0], []
        tags, marks = ["html"], [("", "", False)]
        stack = [("html", 0)]  # open elements with their block
        links = 0
        text_len, link_len = [0], [0]
        words, sentence, owned = [0], [False], [False]
        pos, end, find = 0, len(source), source.find
        dead: set[int] = set()

        def text(raw: str) -> None:
            if not raw:
                return
            t = entities.unescape(raw) if "&" in raw else raw
            node = stack[-1][1]
            self.pieces.append((node, t))
            n = len(t.split())
            if n:
                words[node] += n
                size = len(t.strip())
                text_len[node] += size
                if links:
                    link_len[node] += size
                owned[node] = owned[node] or COPYRIGHT.search(t) is not None
                if not sentence[node] and (". " in t or t.rstrip().endswith((".", "!", "?")) or ", " in t):
                    sentence[node] = True

        while pos < end:
            at = find("<", pos)
            if at < 0:
                text(source[pos:])
                break
            if at > pos:
                text(source[pos:at])
            nxt = source[at + 1 : at + 2]
            if nxt in "!?":
                if source.startswith("<!--", at):
                    stop = find("-->", at + 4)
                    pos = end if stop < 0 else stop + 3
                else:
                    stop = find(">", at + 1)
                    pos = end if stop < 0 else stop + 1
                continue
            m = _tag(source, at, dead)
            if m is None:
                if nxt == "/":
                    stop = find(">", at + 1)
                    pos = end if stop < 0 else stop + 1
                elif nxt.isalpha():
                    break  # an unfinished tag at the end
                else:
                    text("<")
                    pos = at + 1
                continue
            pos = m.end()
            close, name, attrs = m[1], m[2].lower(), m[3]
            if close:
                if name in ("br", "p") and all(x[0] != name for x in stack):
                    self.pieces.append((BREAK, ""))
                    continue
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        for gone, _ in stack[i:]:
                            links -= gone == "a"
                        if any(x not in INLINE for x, _ in stack[i:]):
                            self.pieces.append((BREAK, ""))
                        del stack[i:]
                        break
                    if name in INLINE and stack[i][0] not in INLINE and stack[i][0] != "p":
                        break  # an inline end tag does not close blocks
                continue
            if name in RAW or name in DROPPED:
                # Browsers pass over the slash of raw elements: what follows is theirs up to their end tag.
                if name in RAW or not attrs.endswith("/"):
                    stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, pos)
                    if stop is None and name not in RAW:
                        continue
                    if stop is None:
                        break
                    cut = find(">", stop.end())
                    pos = end if cut < 0 else cut + 1
                self.pieces.append((BREAK, "")) if name not in ("script", "style", "template", "noscript") else None
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    self.pieces.append((BREAK, ""))
                continue
            if name in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        for gone, _ in stack[i:]:
                            links -= gone == "a"
                        del stack[i:]
                        break
                    if stack[i][0] not in INLINE:
                        break
            elif name in SIBLINGS:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in SIBLINGS[name]:
                        for gone, _ in stack[i:]:
                            links -= gone == "a"
                        del stack[i:]
                        if name != "tr" or not any(x[0] in ("td", "th", "tr") for x in stack[-2:]):
                            break
                    elif stack[i][0] in ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "div", "section", "article"):
                        break
            mark, role, hidden, label = "", "", False, None
            if attrs.strip(" /"):
                for a in _ATTR.finditer(attrs):
                    key = a[1].lower()
                    value = a[2] or a[3] or a[4] or ""
                    if key in ("class", "id"):
                        mark += " " + value
                    elif key == "role":
                        role = value.lower()
                    elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
                        hidden = True
                    elif key == "data-y" and labelled:
                        label = int(value)
            negative = bool(mark) and NEGATIVE.search(mark) is not None
            parent = stack[-1][1]
            if name in INLINE and name != "label" and not negative and not hidden:
                links += name == "a"
                stack.append((name, parent))
                continue
            if name not in INLINE:
                self.pieces.append((BREAK, ""))
            if name in ("html", "body"):
                if len(stack) == 1:
                    stack[0] = (name, 0)
                continue
            node = len(self.parents)
            self.parents.append(parent)
            tags.append(name)
            marks.append((mark, role, hidden))
            self.labels.append(self.labels[parent] if label is None else label)
            for column, empty in ((text_len, 0), (link_len, 0), (words, 0), (sentence, False), (owned, False)):
                column.append(empty)
            links += name == "a"
            stack.append((name, node))
        self._describe(tags, marks, text_len, link_len, words, sentence, owned)

    def _heart(self, prose: list[int]) -> list[int]:
        """Per node 1 inside the lowest block that holds three fifths of the page's prose, 2 around it, 0 elsewhere."""
        n, at = len(prose), 0
        for i in range(1, n):
            if self.parents[i] == at and prose[i] * 5 >= prose[0] * 3 > 0:
                at = i
        out = [0] * n
        for i in range(at, n):
            out[i] = 1 if i == at or out[self.parents[i]] == 1 and self.parents[i] >= at else 0
        while at > 0:
            at = self.parents[at]
            out[at] = 2
        return out

    def _describe(self, tags, marks, text_len, link_len, words, sentence, owned) -> None:
        n = len(tags)
        below, below_link, prose = text_len[:], link_len[:], [w if s and w >= 10 else 0 for w, s in zip(words, sentence, strict=True)]
        below_words = words[:]
        for i in range(n - 1, 0, -1):
            p = self.parents[i]
            below[p] += below[i]
            below_link[p] += below_link[i]
            prose[p] += prose[i]
            below_words[p] += below_words[i]
        total, at, heart = max(below[0], 1), _AT, self._heart(prose)
        self.kinds, self.features = [0] * n, []
        inside = [False] * n  # below an article, or below furniture
        for i, (tag, (mark, role, hidden)) in enumerate(zip(tags, marks, strict=True)):
            group = GROUPS.get(tag, "other") if i else "body"
            f = [0, at[group]]
            negative = bool(mark) and NEGATIVE.search(mark) is not None
            positive = bool(mark) and not negative and POSITIVE.search(mark) is not None
            if negative:
                f.append(at["negative"])
            if positive or role in ("main", "article"):
                f.append(at["positive"])
            if role in ROLE_NEGATIVE:
                f.append(at["role_negative"])
            if hidden:
                f.append(at["hidden"])
            if words[i]:
                f.append(at["own_text"])
                if words[i] >= 10:
                    f.append(at["words10"])
                if words[i] >= 40:
                    f.append(at["words40"])
                if sentence[i]:
                    f.append(at["sentence"])
                if link_len[i] * 2 > text_len[i]:
                    f.append(at["links_most"])
                elif link_len[i]:
                    f.append(at["links_some"])
            if below[i] * 3 >= total:
                f.append(at["below_most"])
            if below[i] and below_link[i] * 2 > below[i]:
                f.append(at["below_links"])
            if prose[i] * 2 > below_words[i]:
                f.append(at["below_prose"])
            if heart[i]:
                f.append(at["heart" if heart[i] == 1 else "round_heart"])
            if owned[i]:
                f.append(at["copyright"])
            p = self.parents[i]
            inside[i] = i > 0 and (inside[p] or self.kinds[p] == 1 or tags[p] in ("article", "main"))
            if group in ("article", "main") and not inside[i]:
                f.append(at["lead"])
            self.features.append(f)
            if negative or hidden or role in ROLE_NEGATIVE or group in ("nav", "aside", "footer", "form"):
                self.kinds[i] = 1
            elif positive or group in ("article", "main"):
                self.kinds[i] = 2


def marginals(page: Page, w: list[float]) -> tuple[list[float], list[tuple[float, float]]]:
    """Per node P(content), and per node with its parent P(both content), P(both not): sum-product messages up, then down.

    Scores are log-odds form: a node's unary score counts for content; a pair's weight counts if both agree.
    """
    parents, kinds, n = page.parents, page.kinds, len(page.parents)
    base = len(FEATURES)
    exp, log1p = math.exp, math.log1p
    # up[i]: log-odds of content from the node and all below; message[i]: what it adds to its parent's log-odds.
    up = [sum([w[k] for k in f]) for f in page.features]
    message = [0.0] * n
    soft = lambda a, b: a + log1p(exp(b - a)) if a >= b else b + log1p(exp(a - b))
    for i in range(n - 1, 0, -1):
        both, none = w[base + 2 * kinds[i]], w[base + 2 * kinds[i] + 1]
        # parent content: child content (up + both) or not (0); parent not: child content (up) or not (none)
        m = soft(up[i] + both, 0.0) - soft(up[i], none)
        message[i] = m
        up[parents[i]] += m
    full = up[:]  # log-odds with everything, filled from the root down
    pair = [(0.0, 0.0)] * n
    for i in range(1, n):
        both, none = w[base + 2 * kinds[i]], w[base + 2 * kinds[i] + 1]
        rest = full[parents[i]] - message[i]
        full[i] = up[i] + soft(rest + both, 0.0) - soft(rest, none)
        a, b, c, d = rest + up[i] + both, rest, up[i], none
        top = max(a, b, c, d)
        ea, eb, ec, ed = exp(a - top), exp(b - top), exp(c - top), exp(d - top)
        z = ea + eb + ec + ed
        pair[i] = (ea / z, ed / z)
    prob = [1.0 / (1.0 + exp(-x)) if x > -700 else 0.0 for x in full]
    return prob, pair


def train(pages: list[str] | None = None, rounds: int = 120, rate: float = 0.25, l2: float = 3e-4) -> list[float]:
    """Weights from labelled pages (``data-y`` marks, inherited): gradient ascent on the exact conditional likelihood."""
    parsed = [Page(p, labelled=True) for p in pages or labelled_pages()]
    w, g2 = np.zeros(SIZE), np.zeros(SIZE)
    base, total = len(FEATURES), sum(len(p.parents) for p in parsed)
    for _ in range(rounds):
        grad = -l2 * total * w
        for p in parsed:
            prob, pair = marginals(p, w.tolist())
            for i, f in enumerate(p.features):
                y = p.labels[i]
                for k in f:
                    grad[k] += y - prob[i]
                if i:
                    up_y = p.labels[p.parents[i]]
                    grad[base + 2 * p.kinds[i]] += y * up_y - pair[i][0]
                    grad[base + 2 * p.kinds[i] + 1] += (1 - y) * (1 - up_y) - pair[i][1]
        grad /= total
        g2 = 0.9 * g2 + 0.1 * grad * grad
        w += rate * grad / (np.sqrt(g2) + 1e-3)
    return [round(x, 6) for x in w.tolist()]


def main_text(source: str | None, w: list[float]) -> str:
    """The text of blocks that are content with probability of at least 1/2, in page order."""
    if not source:
        return ""
    page = Page(source)
    keep = [x >= 0.5 for x in marginals(page, w)[0]]
    return " ".join("".join([t if node >= 0 and keep[node] else " " for node, t in page.pieces]).split())


def labelled_pages(n: int = 240, seed: int = 5) -> list[str]:
    """``n`` labelled training pages made up from a seed, of many layouts; ``data-y`` is 1 on content, 0 inside it on what is not."""
    r = random.Random(seed)
    syllables = "an on er the re ou en ti st ha nd le que de ver un".split()
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 3)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: words(6, 16).capitalize() + r.choice([".", ".", ", " + words(2, 5) + ".", "!"])
    prose = lambda: " ".join(sentence() for _ in range(r.randint(1, 5)))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    pick = r.choice

    def links(tag="ul"):
        return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 8))) + "</ul>" if tag == "ul" else " | ".join(link() for _ in range(r.randint(2, 6)))

    def tagged(options, inner, y=""):
        tag, attr = pick(options)
        return f"<{tag}{' ' + attr if attr else ''}{y}>{inner}</{tag}>"

    def inline(t):
        return t if r.random() < 0.6 else t.replace(" ", f" <{(k := pick(['b', 'em', 'i', 'span']))}>{word()}</{k}> ", 1) + (f" {link()}" if r.random() < 0.5 else "")

    def furniture(inside=False):
        off = ' data-y="0"' if inside else ""
        kind = r.randrange(9)
        if kind == 0:
            return tagged([("div", 'class="ad"'), ("div", 'class="advert"'), ("aside", 'class="promo"'), ("div", 'id="ad-1"'), ("div", 'class="sponsored"')], pick([prose(), sentence(), link()]), off)
        if kind == 1:
            return tagged([("aside", ""), ("div", 'class="related"'), ("aside", 'class="sidebar"'), ("section", 'class="related-posts"')], f"<h3>{words(1, 3)}</h3>{links()}", off)
        if kind == 2:
            return tagged([("form", ""), ("form", 'class="newsletter"'), ("div", 'class="subscribe"')], f"<label>{words(1, 3)}</label><input><p>{sentence()}</p><button>{word()}</button>", off)
        if kind == 3:
            return tagged([("div", 'class="share"'), ("ul", 'class="social"'), ("div", 'class="sharing-buttons"')], links("flat"), off)
        if kind == 4:
            return tagged([("div", 'class="cookie-notice"'), ("div", 'id="consent"'), ("div", 'class="notice"'), ("div", 'role="alert"')], f"<p>{prose()}</p><button>{word()}</button>", off)
        if kind == 5:
            return tagged([("div", 'class="sidebar"'), ("aside", ""), ("div", 'id="sidebar"'), ("div", 'role="complementary"')], f"<h2>{words(1, 2)}</h2><p>{prose()}</p>{links()}", off)
        if kind == 6:
            return tagged([("div", 'class="widget"'), ("div", 'class="banner"'), ("section", 'class="promo"')], f"<p>{prose()}</p>", off)
        if kind == 7:
            return tagged([("nav", ""), ("ul", 'class="menu"'), ("div", 'class="breadcrumbs"'), ("div", "")], links(pick(["ul", "flat"])), off)
        return tagged([("p", 'class="byline"'), ("div", 'class="tags"'), ("p", 'class="meta"')], words(2, 5), off)

    def comments(inside):
        one = lambda: tagged([("div", 'class="comment"'), ("article", 'class="comment"'), ("li", ""), ("li", 'class="comment"'), ("article", "")], f"<h4>{word()}</h4><p>{prose()}</p>")
        body = f"<h3>{words(1, 2)}</h3>" + "".join(one() for _ in range(r.randint(1, 5)))
        return tagged([("section", 'id="comments"'), ("div", 'class="comments"'), ("ol", 'class="comment-list"'), ("div", 'id="comments"'), ("section", 'class="reader-comments"')], body, ' data-y="0"' if inside else "")

    def content_block():
        kind = r.randrange(14)
        if kind < 8:
            return f"<p>{inline(prose())}" + pick(["</p>", "</p>", ""])
        if kind == 8:
            return f"<h2>{words(2, 6)}</h2><p>{inline(prose())}</p>"
        if kind == 9:
            return "<ul>" + "".join(f"<li>{pick([sentence(), words(2, 6)])}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind == 10:
            return f"<blockquote><p>{prose()}</p></blockquote>"
        if kind == 11:
            return f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>"
        if kind == 12:
            return "<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr>" for _ in range(3)) + "</table>"
        return f"<div>{inline(prose())}</div>"

    out = []
    for i in range(n):
        blocks = [content_block() for _ in range(r.randint(1, 9))]
        if r.random() < 0.3:  # a page with hardly any text
            blocks = [f"<p>{pick([sentence(), words(1, 5), words(3, 8) + '.'])}" + pick(["</p>", ""]) for _ in range(r.randint(1, 2))]
        for _ in range(r.choice([0, 0, 1, 2])):
            blocks.insert(r.randint(0, len(blocks)), furniture(inside=True))
        if r.random() < 0.25:
            blocks.append(comments(True))
        title = f"<h1>{words(2, 8)}</h1>"
        title = pick([title, title, title, "", f"<header>{title}</header>", f'<header class="{pick(["post", "entry", "article"])}-header">{title}</header>'])
        inner = title + "".join(blocks)
        body = tagged([("article", ""), ("article", ""), ("main", ""), ("div", 'class="content"'), ("div", 'id="main"'), ("div", 'class="post"'), ("div", 'class="entry-content"'), ("section", 'class="story"'), ("div", ""), ("div", 'class="article-body"')], inner, ' data-y="1"')
        if r.random() < 0.3:
            body = tagged([("main", ""), ("div", 'id="content"'), ("div", 'class="wrapper"'), ("section", "")], body, ' data-y="1"')
        before = [tagged([("nav", ""), ("nav", 'class="menu"'), ("ul", 'class="nav"'), ("div", 'id="menu"'), ("div", "")], links())]
        if r.random() < 0.5:
            before.insert(0, tagged([("header", ""), ("div", 'class="header"'), ("div", 'id="masthead"'), ("div", 'role="banner"'), ("header", 'class="site-header"'), ("div", "")], f"<h1>{words(1, 3)}</h1>" + pick(["", f"<p>{sentence()}</p>", links("flat")])))
        before += [furniture() for _ in range(r.choice([0, 1, 1, 2]))]
        after = [furniture() for _ in range(r.choice([0, 0, 1, 2]))]
        if r.random() < 0.35:
            after.insert(0, comments(False))
        owner = pick(["&copy; ", "\u00a9 2024 ", "Copyright 2023 ", "(c) "]) + words(1, 3)
        if r.random() < 0.25:  # nothing but the sign, the links or the place tells
            after.append(tagged([("div", ""), ("p", "")], pick([owner, owner + ". All rights reserved.", f"{owner} {links('flat')}", links("flat")])))
        else:
            marked = [("footer", ""), ("div", 'id="footer"'), ("div", 'class="footer"'), ("div", 'role="contentinfo"')]
            after.append(tagged(marked, pick([f"<p>{sentence()}</p>", words(2, 6), links("flat") + sentence(), f"<p>{prose()}</p>", f"{owner} {sentence()}"])))
        page = "".join([*before, body, *after])
        if r.random() < 0.3:
            page = f"<div{pick(['', ' id=page', ' class=container'])} data-y=\"1\">" + "".join(x.replace(">", ' data-y="0">', 1) for x in before) + body + "".join(x.replace(">", ' data-y="0">', 1) for x in after) + "</div>"
        out.append(f"<!DOCTYPE html><html><head><title>{words(1, 4)}</title><style>p{{}}</style></head><body>{page}</body></html>")
    return out


def extract(pages: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """``pages`` (html, ...) with text and n_chars (code points) added; rows and other columns kept.

    The whole page is parsed to its block elements; a node is content or not, with a score from its tag, names, text and links
    and one for agreeing with its parent; messages up and down the tree give each node's marginal. Text of content blocks is joined in page
    order, white space collapsed, character references decoded.

    Null, empty and text-free pages: empty text, 0. Broken markup is read as browsers do in the main cases (unclosed
    and stray tags, raw text). Repeated rows repeat results; input columns named text or n_chars are replaced. An
    empty table gives no rows.
    """
    w = weights or train()
    small_batches(pages.sparkSession)

    @F.arrow_udf("string")
    def text(source: pa.Array) -> pa.Array:
        return pa.array([main_text(x, w) for x in source.to_pylist()], pa.string())

    return pages.withColumn("text", text("html")).withColumn("n_chars", F.char_length("text").cast("long"))


def op7_html(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
