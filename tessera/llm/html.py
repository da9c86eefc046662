"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into flat blocks at block-level tags. Each block is described by its word count and link density and those
of the two blocks before and after it, and by what its containers say: the innermost one that marks an article or a
page's furniture, by tag or by a word of its class or id. A decision tree, trained on the driver on a small labelled table of
blocks, keeps the article's blocks. The table's pages are made by rule, with a fixed seed, in many layouts: their marks
are right, absent, or misleading (an article in a container named like furniture, furniture in one named like an
article), so that the tree has to weigh the neighbours' words and links against them.

Markup is read by state, in one pass over the page. Scripts, styles and text areas run to their end tag, or to the end of the
page; a comment that never ends does too. Other hidden elements (head, title, select, svg, ...) end with their end tag,
with their container, or where page content starts that cannot stand in them, and count as nothing if they never end.
An end tag without a start is passed over; an unclosed element closes with its container. A link's words count as linked
in whatever blocks they stand.

A null or empty page has the empty text. Each row is judged alone, whatever repeats; a block on the edge of a split (a
tie) goes with the values at or above it. Very long pages take time linear in their length. An empty table gives no rows.
A kept column named ``text`` or ``n_chars`` comes back with ``_kept`` added. No shuffle.
"""

from __future__ import annotations

import html as entities
import random
import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from tessera.llm.common import per_text

#: A comment, a declaration, or a tag: its end sign, name and attributes, in which quotes hold after an equals sign.
MARKUP = re.compile(r"""<!--|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)>""")
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
ALONE = re.compile(r"""(?:^|[\s"'])/$""")
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MAIN_TAGS, FURNITURE_TAGS = {"article", "main"}, {"nav", "header", "footer", "aside", "form", "menu", "button", "dialog", "fieldset"}
MAIN_WORDS = set("article main content post entry story body text".split())
FURNITURE_WORDS = set(
    "ad ads advert advertisement adverts sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs masthead topbar footer sidebar widget comment comments reply replies "
    "disqus cookie cookies consent popup modal overlay gdpr sharing newsletter signup pagination pager toolbar"
    .split()
)
#: Names of furniture that articles have too: beside a name of an article they say nothing.
DOUBTFUL_WORDS = set("header side respond notice alert share social follow related recommended subscribe login search form disclaimer legal copyright skip promotion".split())
LAYOUT = {"html", "body"}
RAW = {"script", "style", "textarea", "xmp", "iframe", "noembed", "noframes"}
HIDDEN = {"head", "title", "noscript", "template", "svg", "math", "object", "canvas", "select", "datalist", "audio", "video", "dialog"}
#: What may stand in a head; anything else ends it. Page content that ends drawings, formulas and choices that were left open.
IN_HEAD = {"title", "meta", "link", "base", "basefont", "bgsound", "script", "style", "noscript", "template"}
FLOW = {"p", "div", "article", "main", "section", "nav", "header", "footer", "aside", "ul", "ol", "dl", "table", "form", "body", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}
ENDED_BY_FLOW = {"title", "svg", "math", "select", "datalist"}
#: Open elements of the same kind that a start tag ends, up to the nearest of the containers.
ENDS = {"p": ({"p"}, ()), "li": ({"li", "p"}, ("ul", "ol", "menu")), "dt": ({"dt", "dd", "p"}, ("dl",)), "dd": ({"dt", "dd", "p"}, ("dl",)), "tr": ({"tr", "td", "th", "p"}, ("table",)), "td": ({"td", "th", "p"}, ("tr", "table")), "th": ({"td", "th", "p"}, ("tr", "table")), "option": ({"option"}, ("select", "datalist"))}


class _Page:
    """The state of one page's reading: open elements, and the block that is being gathered."""

    def __init__(self, page: str):
        self.page, self.out = page, []
        #: (tag, mark of a container, whether its content is hidden)
        self.stack: list[tuple[str, int, bool]] = []
        self.open: dict[str, int] = {}
        self.text: list[str] = []
        self.linked = self.hidden = 0
        #: the marks of the open elements, and how many there are of each
        self.marks: list[int] = []
        self.has = {1: 0, -1: 0}
        self.block_tag = ""
        self.ends: dict[str, int] = {}

    def push(self, name: str, mark: int = 0, hidden: bool = False) -> None:
        self.stack.append((name, mark, hidden))
        self.open[name] = self.open.get(name, 0) + 1
        self.hidden += hidden
        if mark:
            self.marks.append(mark)
            self.has[mark] += 1

    def cut(self, at: int) -> None:
        """Closes the open elements from the ``at``-th on."""
        while len(self.stack) > at:
            name, mark, hidden = self.stack.pop()
            self.open[name] -= 1
            self.hidden -= hidden
            if mark:
                mark = self.marks.pop()
                self.has[mark] -= 1

    def find(self, names: set[str], stop: tuple[str, ...] = ()) -> int:
        """The place of the innermost open element of ``names`` this side of ``stop``, or -1."""
        if not any(self.open.get(n) for n in names):
            return -1
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in names:
                return i
            if self.stack[i][0] in stop:
                return -1
        return -1

    def add(self, s: str) -> None:
        if s and not self.hidden:
            self.text.append(s)
            if self.open.get("a"):
                self.linked += len(s.strip())

    def close(self) -> None:
        """Ends the block."""
        if self.text:
            words = entities.unescape("".join(self.text)).split()
            if words:
                joined = " ".join(words)
                self.out.append({"text": joined, "words": len(words), "density": min(1.0, self.linked / max(1, len(joined))), "inner": self.marks[-1] if self.marks else 0, "main": float(self.has[1] > 0), "furniture": float(self.has[-1] > 0), "heading": float(self.block_tag in HEADINGS), "item": float(self.block_tag in ("li", "dt", "dd", "td", "th", "option"))})
            self.text = []
        self.linked = 0

    def ends_after(self, name: str, at: int) -> bool:
        """Whether an end tag of ``name`` comes after ``at``."""
        if name not in self.ends:
            self.ends[name] = max((m.start() for m in re.finditer(rf"</{re.escape(name)}[\s/>]", self.page, re.I)), default=-1)
        return self.ends[name] >= at

    def skip(self, name: str, at: int) -> int:
        """Where the raw text of an element ends that starts at ``at``."""
        found = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I).search(self.page, at) if self.ends_after(name, at) else None
        return found.end() if found else len(self.page)

    def start(self, name: str, attributes: str, at: int) -> int:
        """Takes a start tag that ends at ``at``; returns where reading goes on."""
        if self.hidden:
            if name not in IN_HEAD and self.open.get("head"):
                self.close()
                self.cut(self.find({"head"}))
            if name in FLOW and (i := self.find(ENDED_BY_FLOW)) >= 0:
                self.close()
                self.cut(i)
        alone = bool(ALONE.search(attributes))
        if name in RAW:
            if name not in ("script", "style"):
                self.close()
            # a self-closed one has raw text all the same, except in drawings and where nothing ends it
            return at if alone and (self.hidden or not self.ends_after(name, at)) else self.skip(name, at)
        if name in HIDDEN:
            self.close()
            if not alone and (name in ("head", "title", "svg", "math") or self.ends_after(name, at)):
                self.push(name, 0, True)
        elif name in INLINE:
            if name == "br":
                self.add(" ")
            elif name == "a":
                if (i := self.find({"a"})) >= 0:
                    self.unlink(i)
                if not alone:
                    self.push("a")
            elif name not in VOID and (mark := _mark(name, attributes)) < 0:
                self.close()
                self.push(name, mark)
                self.block_tag = name
            elif name not in VOID and self.open.get(name):
                # within a marked one of the same name, so that its end is not taken for the other's
                self.push(name)
        else:
            self.close()
            if name in ENDS:
                while (i := self.find(*ENDS[name])) >= 0:
                    self.cut(i)
            elif name in FLOW and (i := self.find({"p"}, ("table", "li", "td", "th", "article", "section", "div"))) >= 0:
                self.cut(i)
            if name not in VOID and not alone:
                self.push(name, _mark(name, attributes))
            self.block_tag = name
        return at

    def unlink(self, i: int) -> None:
        """Takes one open link away and leaves what is open within it."""
        name, _, hidden = self.stack.pop(i)
        self.open[name] -= 1
        self.hidden -= hidden

    def end(self, name: str) -> None:
        if name in INLINE and not self.open.get(name):
            return
        i = self.find({name})
        if name == "a":
            if i >= 0:
                self.unlink(i)
            return
        if name not in INLINE or self.stack[i][1] or self.stack[i][2]:
            self.close()
        if i >= 0:
            self.cut(i)
        if name not in INLINE:
            self.block_tag = next((t for t, _, _ in reversed(self.stack) if t not in INLINE), "")


def blocks(page: str | None) -> list[dict]:
    """The flat text blocks of a page, with their features' parts."""
    page = page or ""
    state = _Page(page)
    at, last = 0, page.rfind(">") + 1
    while at < last:
        m = MARKUP.search(page, at, last)
        if m is None:
            break
        state.add(page[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            if m.group() == "<!--":
                stop = page.find("-->", at)
                at = stop + 3 if stop >= 0 else len(page)
                last = max(last, at) if stop < 0 else last
            continue
        if m.group(1):
            state.end(name.lower())
        else:
            at = state.start(name.lower(), m.group(3), at)
    rest = page[at:]
    # a tag that the page's end cuts off is no text
    if broken := re.search(r"<(?:[a-zA-Z/!?])", rest):
        rest = rest[: broken.start()]
    state.add(rest)
    state.close()
    return state.out


def _mark(name: str, attributes: str | None) -> int:
    """1 for a container of an article, -1 for one of furniture, 0 for neither or both."""
    if name in LAYOUT:
        return 0
    words: set[str] = set()
    for a in ATTRIBUTE.findall(attributes or ""):
        words.update(re.split("[^a-z]+", "".join(a).lower()))
    if name in FURNITURE_TAGS or words & FURNITURE_WORDS:
        return -1
    main = name in MAIN_TAGS or bool(words & MAIN_WORDS)
    return main - bool(words & DOUBTFUL_WORDS)


#: The features, in order.
FEATURES = ("words", "density", "words before", "density before", "words after", "density after", "words two before", "density two before", "words two after", "density two after", "inner", "main", "furniture", "heading", "item", "copyright")


def describe(found: list[dict]) -> np.ndarray:
    """A row of features for each block: word count and link density, its own and its neighbours', then its containers' marks."""
    none = {"words": 0, "density": 0.0}
    padded = [none, none, *found, none, none]
    rows = []
    for i, b in enumerate(found, 2):
        near = [padded[i], padded[i - 1], padded[i + 1], padded[i - 2], padded[i + 2]]
        rows.append([*(x for n in near for x in (n["words"], n["density"])), b["inner"], b["main"], b["furniture"], b["heading"], b["item"], float(b["text"].startswith(("\u00a9", "(c)", "Copyright")))])
    return np.array(rows, float).reshape(len(rows), len(FEATURES))


# ---- the decision tree ---------------------------------------------------------------------------------------------

DEPTH, LEAF, PAGES, SEED = 14, 3, 900, 17


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH):
    """A tree by Gini impurity: (feature, cut, below, from the cut on) or a leaf's majority; ties keep the block."""
    p = y.mean()
    if depth == 0 or p in (0, 1) or len(y) < 2 * LEAF:
        return bool(p >= 0.5)
    best = (p * (1 - p) * len(y) - 1e-9, None, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, c = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        left, right = c[:-1] / n, (c[-1] - c[:-1]) / (len(y) - n)
        cost = left * (1 - left) * n + right * (1 - right) * (len(y) - n)
        cost[(v[1:] == v[:-1]) | (n < LEAF) | (len(y) - n < LEAF)] = np.inf
        i = int(cost.argmin())
        if cost[i] < best[0]:
            best = (cost[i], f, (v[i] + v[i + 1]) / 2)
    if best[1] is None:
        return bool(p >= 0.5)
    low = x[:, best[1]] < best[2]
    return best[1], best[2], grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def keeps(tree, row) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree


def labelled_page(rng: random.Random, names: str = "usual") -> str:
    """A page made by rule; the words of its article begin with ``k``, all others with ``x``.

    ``names`` says how containers are named: "usual" mixes right, missing and misleading names; "unknown" uses names that
    say nothing, and no telling tags.
    """

    def words(kind: str, low: int, high: int) -> str:
        return " ".join(kind + "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(low, high)))

    def link(kind: str, low: int = 1, high: int = 3) -> str:
        return f'<a href="/x">{words(kind, low, high)}</a>'

    def para(kind: str, low: int = 1, high: int = 150) -> str:
        s = words(kind, low, high)
        return f"{s} {link(kind)} {words(kind, 1, 9)}" if rng.random() < 0.15 else s

    mute = names == "unknown" or rng.random() < 0.3

    def box(inner: str, tag: str, name: str) -> str:
        """A container of furniture: named as such, by nothing, or (now and then) like an article."""
        r = rng.random()
        if mute:
            return f'<div class="{rng.choice("q7 zz-1 css-k3 w b2 lay".split())}">{inner}</div>'
        if r < 0.08 and name != "x":
            return f'<div class="{name}-{rng.choice("text content body".split())}">{inner}</div>'
        return f"<{tag}>{inner}</{tag}>" if tag != "div" else f'<div class="{name}">{inner}</div>'

    items = "".join(f"<li>{link('x')}</li>" for _ in range(rng.randint(3, 8)))
    before = [box(f"<ul>{items}</ul>", "nav", "nav"), box(f"<p>{words('x', 1, 8)}</p>{link('x')}", "header", "masthead"), box(link("x", 2, 9), "div", "ad"), box(f'{words("x", 5, 12)} <button>{words("x", 1, 2)}</button> {link("x")}', "div", "cookie-notice"), box("".join(f"<div>{link('x')}</div>" for _ in range(4)), "div", "menu"), f"<ul>{items}</ul>", f"<form><label>{words('x', 1, 3)}</label></form>", f"<a href='/'><div>{words('x', 1, 4)}</div></a>"]
    if not mute:
        before += [f'<div class="ad">{para("x", 3, 20)}</div>', f'<div id="cookie-consent">{para("x", 5, 120)}</div>']
    inside = [f"<aside><p>{para('x', 3, 120)}</p></aside>", f'<div class="share">{link("x")} {link("x")}</div>', f'<div class="advert">{para("x", 2, 25)}</div>']
    after = [f"<footer>&copy; {words('x', 1, 4)} &middot; {words('x', 2, 14)}</footer>", box(f"<ul>{items}</ul>", "div", "related"), f"<p>&copy; {words('x', 2, 6)}</p>", f"<div>{' | '.join(link('x') for _ in range(5))}</div>", box(f"{items}<p>{link('x')}</p>", "div", "sidebar")]
    reply = rng.choice(["p", "li", "div"])
    if not mute:
        after += [f'<section class="comments"><h3>{words("x", 1, 3)}</h3>{"".join(f"<{reply}>{para("x", 3, 150)}</{reply}>" for _ in range(rng.randint(1, 4)))}</section>', f'<div class="sidebar"><p>{para("x", 3, 120)}</p>{items}</div>']
    body = [f"<h1>{words('k', 2, 12)}</h1>"] if rng.random() < 0.7 else []
    for _ in range(rng.randint(1, 9)):
        r = rng.random()
        body.append(rng.choice(inside) if r < 0.08 and not mute else f"<h2>{words('k', 1, 8)}</h2><p>{para('k', 8, 60)}</p>" if r < 0.16 else f"<ul>{''.join(f'<li>{para("k", 2, 14)}</li>' for _ in range(3))}</ul>" if r < 0.22 else f"<blockquote>{para('k', 3, 40)}</blockquote>" if r < 0.26 else f"<p>{para('k', 1 if rng.random() < 0.2 else 8)}</p>")
        if not mute and rng.random() < 0.06:
            body.append(f"<p>{words('k', 1, 3)} {link('k', 2, 9)}</p>")
    if not mute and rng.random() < 0.25:
        # verse, dialogue, tables of data: many short blocks in a row, or an article of a word or two
        verse = [f"<{part}>{words('k', 1, 3)}</{part}>" for part in [rng.choice(["p", "div", "td", "li"])] * rng.randint(1, 12)]
        at = rng.randint(0, len(body))
        body = verse if rng.random() < 0.2 else [*body[:at], *verse, *body[at:]]
    elif not "".join(body).count("<p>"):
        body.append(f"<p>{para('k', 8)}</p>")
    named = [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"), ('<div id="main">', "</div>"), ("<div>", "</div>")]
    misled = [('<div class="legal-text">', "</div>"), ('<article class="category-legal post">', "</article>"), ('<div class="social-story">', "</div>"), ('<div id="search-body">', "</div>"), ('<section class="legal entry">', "</section>")]
    opening, closing = ("<div class='q1'>", "</div>") if mute else rng.choice(misled if rng.random() < 0.15 else named)
    # some pages have nothing beside their article
    bare = rng.random() < 0.2
    pick = lambda rows, k: "" if bare and rng.random() < 0.7 else "".join(rng.sample(rows, rng.randint(1, k)))
    return f"<html><head><title>{words('x', 1, 5)}</title></head><body>{pick(before, 4)}{opening}{''.join(body)}{closing}{pick(after, 4)}</body></html>"


@cache
def tree(pages: int = PAGES, seed: int = SEED):
    """The decision tree, fitted on the blocks of ``pages`` labelled pages."""
    rng, x, y = random.Random(seed), [], []
    for _ in range(pages):
        found = blocks(labelled_page(rng))
        x.append(describe(found))
        y += [float(b["text"].lstrip("©· ").startswith("k")) for b in found]
    return grow(np.concatenate(x), np.array(y))


def extract(page: str | None, fitted) -> str:
    """The main text: the kept blocks in page order, a blank line between two."""
    found = blocks(page)
    return "\n\n".join(b["text"] for b, row in zip(found, describe(found), strict=True) if keeps(fitted, row))


def extract_table(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``, then text and n_chars of every page."""
    fitted = tree()

    def run(cols: list[list]) -> list[list]:
        texts = [extract(h, fitted) for h in cols[-1]]
        return [*cols[:-1], texts, [len(t) for t in texts]]

    return per_text(pages, keep, html, run, "text string, n_chars bigint")
