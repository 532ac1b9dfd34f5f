r"""Main text of web pages by the maximum-scoring run of tokens.

A page is a sequence of tags and words.  A word scores its chance to be content, a tag scores below zero, and one scan
finds the contiguous run with the highest sum.  The weights come from labelled pages: for every tag name and
every word of a class, id or role, the share of the words below it that are content.  An element is judged by all its
names together.  A word takes the lowest share among its ancestors; a tag costs more the lower its own is.  Words of
the run that stand below an ancestor of a low share (a sidebar inside the article, a form, an advert) are left out,
and the rest is put together block by block.

Names say nothing where they do not name the element: on html, body and headings (the kind of page, the target of a
link), after a word such as ``no`` or ``with`` (no-sidebar, content-with-sidebar), and before a word for the
whole page (comments-page).
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose content is read as characters up to their end tag, or without one to the end of the page.
RAW = ("script", "style", "textarea")
#: Elements whose content is markup but no text.  One without an end tag ends with its parent.
NO_TEXT = frozenset("noscript template svg iframe select option button math object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSED_BY_BLOCK = frozenset(["p"])
#: Start tags that end a drawing or formula, unless below one of HTML_INSIDE.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HTML_INSIDE = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
#: Start tags that end any of NO_TEXT of whose name the page has no further end tag.
BLOCKS = BREAKOUT - INLINE - VOID | frozenset("article aside footer form header main nav section".split())
#: Names of NO_TEXT that never stand inside themselves.
UNNESTED = frozenset("button iframe noscript option select".split())
#: Lists and tables, which hold their own items.
NESTS = frozenset("dl menu object ol table template ul".split())
#: Start tags that end an open element of these names, the parent of an element without end tag.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"},
        **{part: {"td", "th", "tr", "tbody", "thead", "tfoot"} for part in ("tbody", "thead", "tfoot")}}
#: An item of a list ends at the next one unless one of these lies between.
ITEM_SCOPE = NESTS | frozenset("article aside blockquote body caption details fieldset figure footer form header main nav section td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose names tell of the page or of their text.
UNNAMED = HEADINGS | {"html", "body"}
#: What follows one of these in a name is no name of the element itself.
RELATIONS = frozenset("no not non without with has have hide hides show shows".split())
#: A name that ends with one of these is that of a kind of page.
PAGE_WORDS = frozenset("page layout template view screen site".split())
#: A name that ends with one of these and holds a content word is that of a box around content and other text.
WRAP_WORDS = frozenset("wrap wrapper container outer".split())
#: A share below this marks an element as no part of the content.
LOW_SHARE = 0.2
TAG_COST, LOW_TAG_COST = 0.05, 0.3

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")(?![\w-])[^>]*+>.*?(?:</\1\s*+>|\Z)|</?[A-Za-z](?:\"[^\"<]*+\"|'[^'<]*+'|[^'\"<>])*+>|</?[A-Za-z!?][^<>]*+>", re.S | re.I)
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_HINT = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WHITE = re.compile(r"[ \t\n\r\f\v]+")


def _words(name: str) -> list[str]:
    """Words of one class or id that name the element."""
    words = [w for w in re.split(r"[^a-z0-9]+", name) if w and not w.isdigit()]
    words = words[: next((i for i, w in enumerate(words) if w in RELATIONS), None)]
    return words[-1:] if words and words[-1] in PAGE_WORDS else words


def _features(tag: str, name: str, in_heading: bool = False) -> list[str]:
    """``<name>`` of other than inline elements, the roles, and all names in one: words joined by -, names by a space.

    The role main is a name beside the others, so that it may outweigh them.  An id inside a heading is its link target.
    """
    names, roles = [], []
    for m in _HINT.finditer(tag) if name not in UNNAMED else ():
        kind, values = m[1].lower(), (m[2] or m[3] or m[4] or "").lower().split()
        if kind == "role":
            names += ["role=main"] * ("main" in values)
            roles += [w for v in values for w in _words(v) if v != "main"]
        elif kind == "class" or not in_heading:
            names += filter(None, ("-".join(_words(v)) for v in values))
    return ([] if name in INLINE else [f"<{name}>"]) + roles + ([" ".join(names)] if names else [])


class Context:
    """Features of an open element; those of the elements around it follow by ``parent``."""

    __slots__ = ("parent", "features", "low")

    def __init__(self, parent: Context | None, features: tuple[str, ...]):
        self.parent, self.features, self.low = parent, features, None

    def __iter__(self) -> Iterator[str]:
        at: Context | None = self
        while at is not None:
            yield from at.features
            at = at.parent


class _Stack:
    """Open elements.  For every element the place of the innermost one of each of GROUPS, itself included, is at hand."""

    GROUPS = (CLOSED_BY_BLOCK, frozenset(["table", "div", "li", "blockquote"]), frozenset(["article", "body"]), frozenset(["table"]), ITEM_SCOPE)

    def __init__(self):
        self.names: list[str] = []
        self.contexts: list[Context] = []
        self.inner: list[tuple[int, ...]] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.root = Context(None, ())

    def __len__(self) -> int:
        return len(self.names)

    @property
    def context(self) -> Context:
        return self.contexts[-1] if self.contexts else self.root

    def push(self, name: str, context: Context) -> None:
        at, before = len(self.names), self.inner[-1] if self.inner else (-1,) * len(self.GROUPS)
        self.names.append(name)
        self.contexts.append(context)
        self.inner.append(tuple(at if name in g else b for g, b in zip(self.GROUPS, before)))
        self.places[name].append(at)

    def cut(self, at: int) -> None:
        """Closes everything from ``at`` on."""
        while len(self.names) > at:
            self.places[self.names.pop()].pop()
            self.contexts.pop()
            self.inner.pop()

    def last(self, name: str) -> int:
        return self.places[name][-1] if self.places.get(name) else -1

    def innermost(self, group: int) -> int:
        return self.inner[-1][group] if self.inner else -1

    def holds(self, names: frozenset[str], above: int) -> bool:
        """Is one of ``names`` open from ``above`` on?"""
        return any(self.last(n) >= above for n in names)


def tokens(page: str) -> Iterator[tuple[str, str, Context, int]]:
    """(kind, name or text, features of the open elements, depth of a fresh element) of a page, in order.

    Kind is ``text``, ``open``, ``close`` or ``void``.  An end tag closes up to its start tag; one without a start
    tag closes nothing.  A paragraph ends where a block begins, and items of lists and tables end where the next one of
    the same list or table begins (ENDS).  An element of NO_TEXT is one ``void``, and nothing inside it is shown;
    without an end tag it ends with its parent or before, see ``_ends``.  The work per tag does not grow with the depth.
    """
    stack = _Stack()
    at = 0
    heading = hidden = 0  # depth of the open heading, of the open element without text
    last_end: dict[str, int] = {}
    for m in _TOKEN.finditer(page):
        if len(stack) < hidden:
            hidden = 0
        if m.start() > at and not hidden:
            yield "text", page[at: m.start()], stack.context, len(stack)
        at = m.end()
        found = _NAME.match(m[0])
        if not found or m[1]:
            if m[1] and not hidden:
                yield "void", m[1].lower(), stack.context, len(stack)
            continue
        name = found[1].lower()
        if m[0][1] == "/":
            i = stack.last(name)
            if i >= 0 and i >= stack.innermost(2):
                if not hidden or i + 1 < hidden:
                    yield "close", name, stack.contexts[i], i
                stack.cut(i)
            elif i < 0 and stack.innermost(2) < 0 and not hidden:
                yield "void", name, stack.context, len(stack)
            continue
        if hidden and _ends(name, stack, hidden, unclosed):
            stack.cut(hidden - 1)
            hidden = 0
        if hidden or name in NO_TEXT:
            if not hidden:
                yield "void", name, stack.context, len(stack)
            if name not in VOID and not m[0].endswith("/>"):
                stack.push(name, stack.context)
                if not hidden:
                    hidden = len(stack)
                    if name not in last_end:
                        last_end[name] = max((e.start() for e in re.finditer(rf"</{name}(?![\w-])", page, re.I)), default=-1)
                    unclosed = last_end[name] < at
            continue
        if name in ENDS:
            scope = stack.innermost(4 if name in ("li", "dt", "dd") else 3)
            open_items = [i for i in map(stack.last, ENDS[name]) if i > scope]
            if open_items:
                stack.cut(min(open_items))
        if name not in INLINE and stack.innermost(0) > stack.innermost(1):
            stack.cut(stack.innermost(0))
        if len(stack) < heading:
            heading = 0
        inner = Context(stack.context, tuple(_features(m[0], name, heading > 0)))
        if name in VOID or m[0].endswith("/>"):
            yield "void", name, inner, len(stack)
            continue
        stack.push(name, inner)
        if name in HEADINGS and not heading:
            heading = len(stack)
        yield "open", name, inner, len(stack)
    if at < len(page) and (not hidden or len(stack) < hidden):
        yield "text", page[at:], stack.context, len(stack)


def _ends(name: str, stack: _Stack, hidden: int, unclosed: bool) -> bool:
    """Does a start tag end the open element without text, which is the ``hidden``-th of the stack?"""
    own = stack.names[hidden - 1]
    if unclosed and name in BLOCKS or name == own and name in UNNESTED:
        return True
    if own in ("svg", "math") and name in BREAKOUT and not stack.holds(HTML_INSIDE, hidden):
        return True
    return hidden > 1 and stack.names[hidden - 2] in ENDS.get(name, ()) and own not in NESTS and not stack.holds(NESTS, hidden)


def fit_weights(pages: list[tuple[str, str]]) -> dict[str, float]:
    """Share of content words below each feature, from (page, its content words, space-joined) pairs.

    A word of a page is content if it is one of the content words; labelled pages are made so that no other text
    uses them.  Half a word of content and half a word of other text are added to each count.
    """
    seen, good = defaultdict(float), defaultdict(float)
    for page, content in pages:
        wanted = set(content.split())
        for kind, value, context, _ in tokens(page):
            if kind != "text":
                continue
            text = html.unescape(value).split()
            hits = sum(word in wanted for word in text)
            for f in {w for f in context for w in re.split("[ -]", f)}:
                seen[f] += len(text)
                good[f] += hits
    return {f: (good[f] + 0.5) / (seen[f] + 1) for f in seen}


def _judged(feature: str, weights: dict[str, float]) -> float:
    """Share of an element by one of its features.  A name of content words alone outweighs all others; a name that
    holds another low word is as low as that."""
    low = 1.0
    for name in feature.split(" "):
        words = name.split("-")
        shares = [weights[w] for w in words if w in weights]
        content = any(s >= LOW_SHARE for s in shares)
        if content and len(shares) == len(words) and min(shares) >= LOW_SHARE:
            return 1.0
        if shares and not (content and words[-1] in WRAP_WORDS):
            low = min(low, *shares)
    return low


def main_text(page: str, weights: dict[str, float]) -> str:
    """The text of the best run; empty where no run scores above zero."""
    judged: dict[str, float] = {}

    def share(context: Context) -> float:
        if context.low is None:  # the parent's is known: it came first
            for f in context.features:
                if f not in judged:
                    judged[f] = _judged(f, weights)
            low = min((judged[f] for f in context.features), default=1.0)
            context.low = min(low if low < LOW_SHARE else 1.0, 1.0 if context.parent is None else share(context.parent))
        return context.low

    items = list(tokens(page))
    best, best_span, total, start = 0.0, (0, 0), 0.0, 0
    for i, (kind, value, context, _) in enumerate(items):
        s = share(context)
        total += len(value.split()) * s if kind == "text" else -(TAG_COST if s == 1.0 else LOW_TAG_COST)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_span = total, (start, i + 1)
    blocks: list[list[str]] = [[]]
    for kind, value, context, _ in items[slice(*best_span)]:
        if kind == "text":
            if share(context) == 1.0:
                blocks[-1].append(value)
        elif value not in INLINE:
            blocks.append([])
    lines = (_WHITE.sub(" ", html.unescape("".join(b))).strip(" ") for b in blocks if b)
    return "\n".join(line for line in lines if line)


def labelled_pages(n: int = 240, seed: int = 5) -> list[tuple[str, str]]:
    """Labelled pages made by rule: an article among menus, headers, footers, sidebars, notices, adverts, forms and
    comments, in the names that pages commonly give them.  Two thirds of the pages also name these on their body, on
    boxes around everything or around the article, and on headings."""
    rng, around = np.random.default_rng(seed), np.random.default_rng([seed, 1])
    pick = lambda options: options[rng.integers(len(options))]
    word = lambda: "".join(chr(97 + rng.integers(26)) for _ in range(rng.integers(7, 11)))
    # fixed names
    outside = [
        ("nav", ""), ("header", ""), ("footer", ""), ("aside", ""), ("form", ""), ("dialog", ""), ("menu", ""),
        *((t, c) for t in ("div", "section", "ul") for c in (
            "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "widget", "footer", "ad", "ads", "advert", "adverts", "advertisement", "banner",
            "sponsor", "sponsored", "promo", "notice", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "newsletter", "subscribe", "signup", "login", "search", "share",
            "sharing", "social", "related", "recommended", "comment", "comments", "replies", "disqus", "copyright", "masthead", "topbar", "toolbar", "pagination", "tags", "skip", "alert", "toc")),
    ]
    low = sorted({c for _, c in outside if c})
    inside = [("article", ""), ("main", ""), ("div", "content"), ("div", "article"), ("div", "post"), ("section", "entry"), ("div", "story"), ("div", "text")]

    def wrapped(body: str, article: str) -> tuple[str, str, str]:
        """Attributes of body, what opens and what closes a box around everything, after the article got its own."""
        name = lambda: low[around.integers(len(low))]
        form = lambda forms: forms[around.integers(len(forms))].format(name(), name())
        state = ["has-{}", "no-{}", "with-{}", "without-{}", "hide-{} show-{}", "{}-page", "{}-layout", "page", "page no-{}", "layout-with-{}"]
        where = ["class", "id"][around.integers(2)]
        article = re.sub("<(h[12])>", lambda m: f'<{m[1]} id="{name()}">', article)
        inner = form(["content-with-{}", "article-with-{}", "post-no-{}", "content has-{}", 'content" role="main', *state])
        return f' class="{form([*state, "{}", "{} {}", "{}-open"])}"', f'<div {where}="{form(state)}">', body.replace("~", f'<div class="{inner}">{article}</div>') + "</div>"

    def words(k: int) -> list[str]:
        return [word() for _ in range(k)]

    def fill(k: int) -> tuple[str, list[str]]:
        w = words(k)
        kind = pick(["p", "p", "p", "p", "ul", "quote", "table", "h2", "div", "pre", "dl", "figure"])
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{x}</li>" for x in w) + "</ul>", w
        if kind == "table":
            return "<table><tbody>" + "".join(f"<tr><td>{x}</td></tr>" for x in w) + "</tbody></table>", w
        if kind == "dl":
            return "<dl>" + "".join(f"<dt>{x}</dt>" if i % 2 else f"<dd>{x}</dd>" for i, x in enumerate(w)) + "</dl>", w
        shell = {"quote": "blockquote><p", "figure": "figure><figcaption"}.get(kind, kind)
        return f"<{shell}>" + " ".join(w) + "".join(f"</{t}>" for t in reversed(shell.split("><"))), w

    def boiler() -> str:
        tag, name = pick(outside)
        w = words(rng.integers(2, 25))
        inner = pick(["li", "p", "div"])
        text = " ".join(w) if rng.random() < 0.6 else "".join(f'<{inner}><a href="/{x}">{x}</a></{inner}>' for x in w)
        where = pick(["class", "id"])
        return f'<{tag} {where}="{name}">{text}</{tag}>' if name else f"<{tag}>{text}</{tag}>"

    out = []
    for _ in range(n):
        tag, name = pick(inside)
        parts = [fill(rng.integers(3, 30)) for _ in range(rng.integers(1, 8))]
        title = words(rng.integers(2, 8))
        body = f"<h1>{' '.join(title)}</h1>" + "".join(p + (boiler() if rng.random() < 0.15 else "") for p, _ in parts)
        article = f'<{tag} class="{name}">{body}</{tag}>' if name else f"<{tag}>{body}</{tag}>"
        attributes, box, rest = "", "<div>", f"{''.join(boiler() for _ in range(rng.integers(1, 4)))}~{''.join(boiler() for _ in range(rng.integers(1, 4)))}"
        if around.integers(3):
            attributes, box, rest = wrapped(rest, article)
        else:
            rest = rest.replace("~", article) + "</div>"
        page = f"<!DOCTYPE html><html><head><title>{' '.join(title)}</title></head><body{attributes}>{box}{rest}</body></html>"
        # the title words of the head come first and are no content, so they are set apart
        out.append((page.replace(f"<title>{' '.join(title)}", f"<title>{' '.join('~' + t for t in title)}"), " ".join([*title, *(x for _, w in parts for x in w)])))
    return out


def extract(pages: DataFrame, weights: dict[str, float], text: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``.

    Null or empty html gives an empty text, and so does a page without content.  Whole pages are read whatever
    their length; repeated rows give repeated rows; null page_id and url are carried through; other columns are not
    read; an empty table gives an empty result.
    """
    picked = pages.select("page_id", "url", text)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [main_text(p.as_py() or "", weights) for p in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return picked.mapInArrow(batches, f"page_id {picked.schema['page_id'].dataType.simpleString()}, url {picked.schema['url'].dataType.simpleString()}, text string, n_chars long")
