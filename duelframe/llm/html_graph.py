"""Main text of web pages by a tree-structured graphical model.

Every block element of a page and every run of text in it is a node; a node hangs on its
parent element. An element is boilerplate, content or a mix of both, a run is boilerplate
or content. Node potentials come from tags, class and id words, link share, length and end
mark; edge potentials from parent and child labels. Sum-product messages go once up and
once down the tree, which gives exact marginals; runs that are more likely content than
not are the main text. All potentials are counted on labelled pages (`labelled_pages`).

Scripts, styles, the head, comments and form controls hold no text. Broken markup is read
with the usual implied ends; a quote outside a value is a letter of its tag. Null or empty html gives an empty text. Depth and length of a
page are not limited; nothing here recurses.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from duelframe.llm.common import add_columns

BOILER, CONTENT, MIXED = 0, 1, 2
#: Where markup starts: a comment, a declaration, a tag, or an end tag without a name.
MARKUP = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*)|/)")
#: In a tag: its end, or a value. Quotes stand around a value only right after an equals sign.
IN_TAG = re.compile(r">|=\s*(?:([\"'])|[^\s\"'>][^\s>]*)")
ATTRIBUTE = re.compile(r"([\w-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HINT = re.compile(r"[a-z]+")
#: Elements whose content is not read as text, up to their end tag.
SILENT = frozenset("script style title textarea noscript template iframe svg select button".split())
#: Of these, those whose content is raw: only their own end tag ends them.
RAW = frozenset("script style title textarea iframe noscript".split())
#: Of these, those that stand in themselves.
NESTED = frozenset("svg template".split())
#: Elements that may stand in a head; any other one ends it, as text does.
IN_HEAD = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr"
    " ul caption".split()
)
#: An element that starts ends these open ones, as far up as the given border.
ENDS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
}
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
#: Words in class, id and role that tell an element's part.
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising aside author banner bar breadcrumb breadcrumbs byline comment comments"
    " complementary contentinfo cookie cookies consent copyright disclaimer discussion disqus donate follow footer form"
    " header hidden links login masthead menu meta modal nav navbar navigation newsletter notice notices notification"
    " pager pagination popup promo promotion promoted recommended related replies reply respond responses search share"
    " sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toc toolbar top widget alert".split()
)
CONTENT_WORDS = frozenset("article articlebody body content entry main maincontent post story text prose".split())


@dataclass
class Tree:
    """Nodes in page order: 0 is the page. Elements have (tag, hint), runs a text."""

    parent: list[int] = field(default_factory=lambda: [-1])
    feature: list = field(default_factory=lambda: [("page", "none")])
    runs: list[tuple[int, list[str], int]] = field(default_factory=list)  # node, strings, characters in links


def hint(attributes: str) -> str:
    """What class, id, role and visibility say: none, boiler, content or both."""
    words: set[str] = set()
    for name, *values in ATTRIBUTE.findall(attributes):
        name = name.lower()
        value = "".join(values).lower()
        if name in ("class", "id", "role", "itemprop"):
            words.update(HINT.findall(value))
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            words.add("hidden")
    boiler, content = bool(words & BOILER_WORDS), bool(words & CONTENT_WORDS)
    return "both" if boiler and content else "boiler" if boiler else "content" if content else "none"


class Scanner:
    """Markup of a page from front to back, each letter looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page = page
        self.gone: set[str] = set()  # marks that do not come any more

    def find(self, mark: str, at: int) -> int:
        """The place of the next `mark`, or -1."""
        place = -1 if mark in self.gone else self.page.find(mark, at)
        if place < 0:
            self.gone.add(mark)
        return place

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, stop, is an end tag, tag or '', attributes) of the next markup. A quote
        that is never closed is a letter of its tag; what is open at the end of the page
        goes up to there."""
        found = MARKUP.search(self.page, at)
        if not found:
            return None
        start, inside = found.span()
        if not found[3]:
            mark = "-->" if found[1] else ">"
            # A comment may be as short as <!-->.
            place = self.find(mark, start + 2 if found[1] else inside)
            return start, len(self.page) if place < 0 else place + len(mark), False, "", ""
        here = inside
        while stop := IN_TAG.search(self.page, here):
            here = stop.end()
            if stop[0] == ">":
                return start, here, bool(found[2]), found[3].lower(), self.page[inside : stop.start()]
            if stop[1]:
                here = max(here, self.find(stop[1], here) + 1)
        return start, len(self.page), bool(found[2]), found[3].lower(), self.page[inside:]


def parse(page: str, hints: dict[str, str]) -> Tree:
    """The block tree of a page. `hints` keeps what attribute strings have said before."""
    tree = Tree()
    stack = [(0, "page")]
    opened: Counter[str] = Counter()  # tags on the stack
    strings: list[str] | None = None
    linked = links = 0
    silent, silent_depth = "", 0
    head = False
    at = 0

    def close() -> None:
        nonlocal strings, linked
        if strings is not None and any(not s.isspace() for s in strings):
            tree.parent.append(stack[-1][0])
            tree.feature.append(None)
            tree.runs.append((len(tree.parent) - 1, strings, linked))
        strings, linked = None, 0

    def leave() -> str:
        tag = stack.pop()[1]
        opened[tag] -= 1
        return tag

    def text(piece: str) -> None:
        nonlocal strings, linked, head
        head = head and (bool(silent) or not piece or piece.isspace())
        if piece and not silent and not head:
            piece = html.unescape(piece) if "&" in piece else piece
            strings = strings or []
            strings.append(piece)
            linked += len(piece) if links else 0

    scanner = Scanner(page)
    while token := scanner.next(at):
        start, stop, end, tag, attributes = token
        text(page[at:start])
        at = stop
        if not tag:
            continue
        if silent:
            if tag == silent:
                silent_depth += -1 if end else silent in NESTED and not attributes.endswith("/")
                silent = silent if silent_depth else ""
            continue
        if head:
            head = tag not in ("head", "body", "html", "br") if end else tag in IN_HEAD
        if tag == "head" and not end:
            head = True
        elif (tag in SILENT or (head and tag == "noframes")) and not end:
            if tag in RAW or tag == "noframes":
                close_tag = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close_tag.end() if close_tag else len(page)
            elif not attributes.endswith("/"):
                silent, silent_depth = tag, 1
        elif tag == "a":
            links = 0 if end else 1
        elif tag == "br":
            text(" ")
        elif tag in BLOCKS:
            close()
            links = 0
            if end:
                if opened[tag]:
                    while leave() != tag:
                        pass
            else:
                if stack[-1][1] == "p" or (tag in HEADINGS and stack[-1][1] in HEADINGS):
                    leave()
                closes, border = ENDS.get(tag, ((), ()))
                for i in range(len(stack) - 1, 0, -1) if closes else ():
                    if stack[i][1] in border:
                        break
                    if stack[i][1] in closes:
                        while len(stack) > i:
                            leave()
                        break
                said = hints.get(attributes) if len(attributes) < 200 else None
                if said is None:
                    said = hint(attributes) if attributes.strip() else "none"
                    if len(hints) < 10_000 and len(attributes) < 200:
                        hints[attributes] = said
                tree.parent.append(stack[-1][0])
                tree.feature.append((tag, said))
                stack.append((len(tree.parent) - 1, tag))
                opened[tag] += 1
    text(page[at:])
    close()
    return tree


def run_features(owner: str, text: str, linked: int) -> tuple[str, ...]:
    words = text.count(" ") + 1
    size = next((str(n) for n in (2, 6, 15, 40) if words <= n), "more")
    share = linked / max(1, len(text))
    place = "h" if owner in HEADINGS else owner if owner in ("p", "li", "td", "th", "div", "blockquote", "pre") else "other"
    mark = "end" if text[-1] in ".!?…:;\"'»”" else "open"
    return f"size {size}", f"link {'none' if share == 0 else 'some' if share < 0.5 else 'most'}", f"place {place}", f"mark {mark}"


class Model:
    """Potentials from counts over labelled trees, with add-half smoothing."""

    def __init__(self):
        self.elements = defaultdict(Counter)  # (kind, value) -> label counts
        self.texts = defaultdict(Counter)
        self.edges = Counter()
        self.labels, self.run_labels = Counter(), Counter()

    def learn(self, tree: Tree, content_runs: set[int]) -> None:
        """Count one page; `content_runs` are the places in `tree.runs` that are content."""
        below: list[set[int]] = [set() for _ in tree.parent]
        label: dict[int, int] = {}
        for i, (node, _, _) in enumerate(tree.runs):
            label[node] = CONTENT if i in content_runs else BOILER
            below[node].add(label[node])
        for node in range(len(tree.parent) - 1, 0, -1):
            below[tree.parent[node]] |= below[node]
        for node, kinds in enumerate(below):
            if node not in label and kinds:
                label[node] = MIXED if len(kinds) == 2 else next(iter(kinds))
        for node, own in label.items():
            up = tree.parent[node]
            run = tree.feature[node] is None
            if node:
                self.edges[run, label[up], own] += 1
            if not run:
                self.labels[own] += 1
                for value in enumerate(tree.feature[node]):
                    self.elements[value][own] += 1
        for node, strings, linked in tree.runs:
            self.run_labels[label[node]] += 1
            owner = tree.feature[tree.parent[node]][0]
            for value in run_features(owner, " ".join("".join(strings).split()), linked):
                self.texts[value][label[node]] += 1

    def freeze(self) -> Model:
        self.pair = [[(self.edges[False, t, s] + 0.5) / (sum(self.edges[False, t, x] for x in range(3)) + 1.5) for s in range(3)] for t in range(3)]
        self.pair_run = [[(self.edges[True, t, s] + 0.5) / (sum(self.edges[True, t, x] for x in range(2)) + 1) for s in range(2)] for t in range(3)]
        self.known: dict = {}
        return self

    def potential(self, feature: tuple[str, ...], run: bool) -> list[float]:
        """Product of P(value | label), scaled; a value never seen says nothing."""
        if feature not in self.known:
            counts, totals, n = (self.texts, self.run_labels, 2) if run else (self.elements, self.labels, 3)
            out = [0.0] * n
            for value in feature if run else enumerate(feature):
                if value in counts:
                    for s in range(n):
                        out[s] += math.log((counts[value][s] + 0.5) / (totals[s] + 4))
            top = max(out)
            self.known[feature] = [math.exp(v - top) for v in out]
        return self.known[feature]

    def marginals(self, tree: Tree, texts: list[str]) -> list[float]:
        """P(content) of each run."""
        up: list[list[float]] = [self.potential(f, False) if f else [] for f in tree.feature]
        up = [list(v) for v in up]
        for (node, _, linked), text in zip(tree.runs, texts, strict=True):
            up[node] = list(self.potential(run_features(tree.feature[tree.parent[node]][0], text, linked), True))
        n = len(up)
        message: list = [None] * n
        parent, feature, pair, pair_run = tree.parent, tree.feature, self.pair, self.pair_run
        for node in range(n - 1, 0, -1):
            own = up[node]
            if feature[node] is None:
                a, b = own
                m = [p[0] * a + p[1] * b for p in pair_run]
            else:
                a, b, c = own
                m = [p[0] * a + p[1] * b + p[2] * c for p in pair]
            message[node] = m
            at = up[parent[node]]
            x, y, z = at[0] * m[0], at[1] * m[1], at[2] * m[2]
            s = x + y + z
            at[0], at[1], at[2] = x / s + 1e-150, y / s + 1e-150, z / s + 1e-150
        down: list = [None] * n
        down[0] = [1.0, 1.0, 1.0]
        out = [0.0] * n
        for node in range(1, n):
            above, own, m = parent[node], up[node], message[node]
            d, u = down[above], up[above]
            rest = [d[t] * u[t] / m[t] for t in range(3)]
            s = sum(rest)
            rest = [r / s for r in rest]
            if feature[node] is None:
                boiler = own[0] * sum(r * p[0] for r, p in zip(rest, pair_run, strict=True))
                content = own[1] * sum(r * p[1] for r, p in zip(rest, pair_run, strict=True))
                out[node] = content / (boiler + content)
            else:
                down[node] = [sum(r * p[k] for r, p in zip(rest, pair, strict=True)) for k in range(3)]
        return [out[node] for node, _, _ in tree.runs]

    def extract(self, page: str | None, hints: dict[str, str]) -> str:
        if not page:
            return ""
        tree = parse(page, hints)
        if not tree.runs:
            return ""
        texts = [" ".join("".join(strings).split()) for _, strings, _ in tree.runs]
        return "\n\n".join(t for t, p in zip(texts, self.marginals(tree, texts), strict=True) if p > 0.5)


def labelled_pages(n: int = 400, seed: int = 9) -> list[tuple[str, list[bool]]]:
    """Pages built from parts that are known to be content or not: (html, is each text run
    content). They vary in tags, class words, lengths and order of the parts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulnrstmd") for _ in range(rng.randint(1, 9)))
    words = lambda low, high: " ".join(word() for _ in range(rng.randint(low, high)))
    pages = []
    for _ in range(n):
        marks: list[bool] = []

        def run(text: str, content: bool, marks=marks) -> str:
            marks.append(content)
            return text

        def prose(content: bool, run=run) -> str:
            return run(words(1, 90).capitalize() + rng.choice([".", ".", ".", ".", "!", "?", ""]), content)

        def links(run=run) -> str:
            return "<ul>" + "".join(f'<li><a href="/{word()}">{run(words(1, 3), False)}</a></li>' for _ in range(rng.randint(2, 8))) + "</ul>"

        def boiler(run=run) -> str:
            kind = rng.choice("nav header footer aside ad notice form comments related plain".split())
            if kind == "nav":
                return rng.choice(["<nav>%s</nav>", '<div class="menu">%s</div>', '<div id="nav-main">%s</div>']) % links()
            if kind == "header":
                return rng.choice(["<header><div>%s</div></header>", '<div class="site-header">%s</div>']) % run(words(1, 6), False)
            if kind == "footer":
                return rng.choice(["<footer>%s</footer>", '<div id="footer"><p>%s</p></div>']) % ("&copy; " + run(words(2, 20), False))
            if kind == "aside":
                return rng.choice(["<aside>%s</aside>", '<div class="sidebar">%s</div>']) % (links() if rng.random() < 0.5 else f"<h3>{run(words(1, 4), False)}</h3><p>{prose(False)}</p>")
            if kind in ("ad", "notice"):
                name = rng.choice({"ad": ["ad", "advert", "sponsored", "promo"], "notice": ["cookie-notice", "notice", "alert", "banner"]}[kind])
                return f'<div class="{name}">' + rng.choice(["%s", "<p>%s</p>"]) % prose(False) + "</div>"
            if kind == "form":
                return f'<form action="/s"><label>{run(words(1, 5), False)}</label><input name="q"></form>'
            if kind == "comments":
                return rng.choice(['<div id="comments">%s</div>', '<section class="comments">%s</section>']) % "".join(f'<div class="comment"><p>{prose(False)}</p></div>' for _ in range(rng.randint(1, 4)))
            if kind == "related":
                return f'<div class="related"><h3>{run(words(1, 4), False)}</h3>{links()}</div>'
            return f'<div><a href="/{word()}">{run(words(1, 4), False)}</a></div>'

        def article(run=run) -> str:
            parts = [f"<h1>{run(words(2, 12), True)}</h1>"]
            for _ in range(rng.randint(2, 14)):
                pick = rng.random()
                if pick < 0.78:
                    parts.append(f"<p>{prose(True)}</p>")
                elif pick < 0.84:
                    parts.append(f"<h2>{run(words(1, 7), True)}</h2>")
                elif pick < 0.9:
                    parts.append("<ul>" + "".join(f"<li>{prose(True)}</li>" for _ in range(rng.randint(2, 4))) + "</ul>")
                elif pick < 0.96:
                    shape = rng.choice(["<blockquote>%s</blockquote>", "<blockquote><p>%s</p></blockquote>", "<pre>%s</pre>", "<div>%s</div>", "<div><p>%s</p></div>", "%s<p></p>", "<section><p>%s</p></section>", "<figure><figcaption>%s</figcaption></figure>", "<dl><dt>%s</dt></dl>", "<table><tr><td>%s</td></tr></table>"])
                    parts.append(shape % prose(True))
                else:
                    parts.append(boiler())
            wrap = rng.choice(["<article>%s</article>", "<main>%s</main>", '<div class="content">%s</div>', '<main><article>%s</article></main>', '<article class="post">%s</article>', '<div class="entry-content">%s</div>', '<section class="article-body">%s</section>', "<div>%s</div>"])
            return wrap % "".join(parts)

        before = "".join(boiler() for _ in range(rng.randint(0, 3)))
        middle = article()
        after = "".join(boiler() for _ in range(rng.randint(0, 4)))
        body = rng.choice(["%s", '<div id="page">%s</div>', '<div class="wrapper"><div>%s</div></div>']) % (before + middle + after)
        pages.append((f"<html><head><title>{words(1, 5)}</title></head><body>{body}</body></html>", marks))
    return pages


def train(pages: list[tuple[str, list[bool]]]) -> Model:
    model = Model()
    for page, marks in pages:
        tree = parse(page, {})
        if len(tree.runs) != len(marks):
            raise ValueError("a label for each run of text is needed")
        model.learn(tree, {i for i, m in enumerate(marks) if m})
    return model.freeze()


def extract_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """`pages` with `text` and `n_chars`, from column `html`. Columns of these names are
    replaced, `html` is kept."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train(labelled_pages()))

    def work():
        fitted, hints = shared.value, {}

        def compute(columns: list[pa.Array]) -> list[pa.Array]:
            texts = [fitted.extract(page, hints) for page in columns[0].to_pylist()]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return compute

    return add_columns(pages, [F.col("html").cast("string")], [StructField("text", StringType()), StructField("n_chars", LongType())], work)
