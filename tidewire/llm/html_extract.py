"""Main text of web pages: boosted trees over DOM nodes, decoded top down.

A page becomes a tree of elements and text runs. Each node gets features of its
tag, its attribute tokens, what lies above it, its depth and siblings, and the
density of its subtree. Gradient-boosted trees (trained here, by Spark, on a
bounded sample of pages) give each node log-odds of holding article text. The
decoder keeps a node only below kept ones: the gain of keeping a node is its
log-odds plus the gains of its children where positive, so an ancestor and a
descendant never contradict each other, and a wrong vote on one node is
outweighed by its subtree.

Labels for training come from pages that mark their article themselves
(``article`` or ``main``): text in it counts, except below elements that are
boilerplate by tag, by name where the page bears the name out (``_weigh``), or
as a row of signed posts; text outside doesn't, whatever its names. So that the
trees don't lean on marks and names alone, a sample page is also shown without
its mark, with its article written another way (``reshaped``), with the blocks
from outside moved into the article, where they still don't count, and so
without any names: then only what the text and its links tell is left. Attribute
tokens of a node and of what lies above it go into the features, as counts of
listed words and as ``BUCKETS`` hashed indicators of all others, so names that
pages use outside their articles are learned from the pages. The sample is the
``SAMPLE_PAGES`` marked pages with the least hash; every page is extracted.

Null and empty html give an empty text. Pages cut off anywhere are read as far
as they go. Without a marked page nothing can be learned; then what the label
rule excludes is left out and all else kept. Repeated rows are extracted one by
one; an empty table gives no row. Columns named like a result are replaced.
Very long pages are read whole.

What neither names nor links nor signatures tell apart from an article's own
text stays: an unsigned comment in a block with a name unknown to lists and
sample, say. A row of two or more signed posts after the article's prose goes,
even if the article is a diary of such posts with prose before it.
"""

from __future__ import annotations

import html as entities
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, extended, quoted

SAMPLE_PAGES = 200
#: Hashed indicators of attribute tokens, one bit of an integer each.
BUCKETS = 64
TREES, DEPTH = 20, 4
#: What a node counts in a page shown without names, against one in a page shown as it is.
HIDDEN_WEIGHT = 0.3

#: Fixed values of HTML: elements without content, with raw text, and those that close an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that end an open one of the second set, up to an element of the third.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])), "body": (frozenset(["head"]), frozenset()),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p blockquote pre li dd td figcaption".split())
MARKS = frozenset(["article", "main"])
#: Elements and attribute words of menus, headers, footers, sidebars, notices, adverts, forms and comments.
BOILER_TAGS = frozenset("aside button dialog footer form head header iframe input label menu nav noscript script search select style svg template textarea title".split())
BOILER_WORDS = frozenset(
    "ad ads adslot advert advertisement adverts banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disclaimer disqus "
    "drawer footer gdpr header login masthead menu modal nav navbar navigation newsletter pager pagination popup promo promoted promotion "
    "share sharing sidebar signup skip sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
#: Words that articles have in the names of their own blocks, too. Two in one name count; one counts where the block isn't prose.
WEAK_WORDS = frozenset(
    "discussion discussions feedback form legal notice rail related remarks replies reply respond response responses search social tags teaser teasers thread threads".split()
)
#: Words that name who wrote a post.
AUTHOR_WORDS = frozenset("author avatar commenter member nickname poster user username vcard".split())
#: Characters of a text run that reads as prose, and of a block's prose.
RUN, PROSE = 40, 100
CONTENT_WORDS = frozenset("article articlebody body content entry main maincontent post story text".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|</?[a-zA-Z][^>]*\Z",
    re.S,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role|itemprop|data-component)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
SPLIT = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

NAMES = (
    "mark", "boiler_tag", "boiler_words", "content_words", "below_mark", "below_boiler_tag", "below_boiler_words", "below_content_words", "page_has_mark",
    "depth", "children", "siblings", "place", "boiler_siblings", "text", "own_text", "share", "link_share", "density", "stops", "heading", "paragraph", "is_text",
    *(f"token_{k}" for k in range(BUCKETS)),
)


def hashed(words) -> int:
    """The buckets of attribute tokens as bits; listed words have features of their own."""
    bits = 0
    for w in words:
        if w not in BOILER_WORDS and w not in CONTENT_WORDS:
            bits |= 1 << zlib.crc32(w.encode()) % BUCKETS
    return bits


class Page:
    """Tree of a page: parents, tags ("#" for text runs), attribute word counts and texts.

    Inline elements of no meaning of their own are no nodes: their text goes
    into the run around them, so a run is a block's text between its blocks.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.text = [-1], ["#root"], [""]
        self.boiler, self.content, self.linked, self.tokens = [0], [0], [0], [0]
        #: Names of weak words alone, and of authors.
        self.weak, self.signed = [0], [0]
        #: Whether the node was moved into the article, or lies below one that was.
        self.moved: np.ndarray | None = None
        #: Open elements: tag, node (the one around it for inline elements), whether in a link.
        stack, at, n = [("#root", 0, False)], 0, len(source)

        def add(tag, text="", boiler=0, content=0, tokens=0, weak=0, signed=0):
            self.parent.append(stack[-1][1])
            self.tag.append(tag)
            self.text.append(text)
            self.boiler.append(boiler)
            self.content.append(content)
            self.linked.append(0)
            self.tokens.append(tokens)
            self.weak.append(weak)
            self.signed.append(signed)
            return len(self.tag) - 1

        def write(text):
            node = len(self.tag) - 1
            if self.tag[node] == "#" and self.parent[node] == stack[-1][1]:
                self.text[node] += text
            else:
                node = add("#", text)
            if stack[-1][2]:
                self.linked[node] += len(text.strip())

        while at < n:
            found = TOKEN.search(source, at)
            end = found.start() if found else n
            if end > at:
                write(entities.unescape(source[at:end]))
            if not found:
                break
            at = found.end()
            closing, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not name:
                continue
            name = name.lower()
            if name == "br":
                write(" ")
                continue
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                continue
            if name in BLOCKS:
                self._end(stack, frozenset("p"), frozenset(["table", "td", "th", "button", "article", "section", "div", "li", "body"]))
            if name in ENDS:
                self._end(stack, *ENDS[name])
            named = [SPLIT.findall(name.lower()) for m in ATTRIBUTE.finditer(attributes) for name in CAMEL.sub("-", m[1]).split()] if "=" in attributes else ()
            words = [w for name in named for w in name]
            weak = [sum(w in WEAK_WORDS for w in name) for name in named]
            boiler = sum(w in BOILER_WORDS for w in words) + sum(k > 1 for k in weak)
            weak, signed = sum(k == 1 for k in weak), int(any(w in AUTHOR_WORDS for w in words))
            linked = stack[-1][2] or name == "a"
            if name not in BLOCKS and name not in BOILER_TAGS and not boiler and not weak:
                self.signed[stack[-1][1]] += signed
                if name not in VOID:
                    stack.append((name, stack[-1][1], linked))
                continue
            node = add(name, "", boiler, sum(w in CONTENT_WORDS for w in words), hashed(words), weak, signed)
            if name in VOID:
                continue
            if name in RAW:
                close = re.compile(rf"</{name}[^>]*>", re.I).search(source, at)
                at = close.end() if close else n
                continue
            if not attributes.endswith("/") or name in BLOCKS:
                stack.append((name, node, linked))
        self._weigh()

    def _weigh(self):
        """What the page itself says of its blocks goes into ``boiler``.

        A weak name counts where less than PROSE characters, or less than half of
        the block's text, are prose: runs with a full stop and few links. Posts
        count whatever their names: two or more alike below one element, each with
        the name of an author, after PROSE characters of prose elsewhere. So does
        what holds them, if it holds no prose but theirs.
        """
        if not any(self.weak) and sum(self.signed) < 2:
            return
        n = len(self.tag)
        prose, text, signed, before = [0] * n, [len(t.strip()) for t in self.text], list(self.signed), [0] * (n + 1)
        for i in range(n):
            if text[i] >= RUN and 2 * self.linked[i] < text[i] and any(c in self.text[i] for c in ".!?\u3002"):
                prose[i] = text[i]
            before[i + 1] = before[i] + prose[i]
        for i in range(n - 1, 0, -1):
            for values in (prose, text, signed):
                values[self.parent[i]] += values[i]
        alike: dict[tuple, list[int]] = {}
        for i in range(1, n):
            if self.tag[i] != "#" and signed[i]:
                alike.setdefault((self.parent[i], self.tag[i], self.tokens[i], self.content[i]), []).append(i)
            if self.weak[i] and (prose[i] < PROSE or 2 * prose[i] < text[i]):
                self.boiler[i] += self.weak[i]
        for (up, *_), posts in alike.items():
            if len(posts) > 1 and before[posts[0]] >= PROSE and not any(self.tag[i] in MARKS for i in posts):
                for i in posts:
                    self.boiler[i] += 1
                if up and self.tag[up] not in (*MARKS, "body", "html") and prose[up] == sum(prose[i] for i in posts):
                    self.boiler[up] += 1

    def _end(self, stack, which, upto):
        for k in range(len(stack) - 1, 0, -1):
            tag = stack[k][0]
            if tag in which:
                # A cell or item also ends what is open inside it.
                del stack[k:]
                return
            if tag in upto:
                return

    def labels(self) -> np.ndarray | None:
        """1 for article text and what holds it; None if the page doesn't mark its article."""
        marked = [i for i, t in enumerate(self.tag) if t in MARKS]
        if not marked:
            return None
        inside, out = np.zeros(len(self.tag), dtype=bool), self.excluded()
        for i, t in enumerate(self.tag):
            inside[i] = t in MARKS or (self.parent[i] >= 0 and inside[self.parent[i]])
        label = np.array([t == "#" for t in self.tag]) & inside & ~out
        label &= np.array([bool(t.strip()) for t in self.text])
        if self.moved is not None:
            label &= ~self.moved
        for i in range(len(label) - 1, 0, -1):
            if label[i]:
                label[self.parent[i]] = True
        return label

    def excluded(self) -> np.ndarray:
        """Nodes that the label rule takes for boilerplate, or lie below one."""
        out = np.zeros(len(self.tag), dtype=bool)
        for i, t in enumerate(self.tag):
            out[i] = (t in BOILER_TAGS or self.boiler[i] > 0) or (self.parent[i] >= 0 and out[self.parent[i]])
        return out

    def grafted(self) -> Page | None:
        """The page with the blocks around its article that have names, or tags of boilerplate, moved into it."""
        marked = [i for i, t in enumerate(self.tag) if t in MARKS]
        if not marked:
            return None
        # What holds an article stays where it is.
        fixed = np.array([t in MARKS or t in ("body", "html", "#root") for t in self.tag])
        for i in range(len(fixed) - 1, 0, -1):
            fixed[self.parent[i]] |= fixed[i]
        inside, moved, below = np.zeros(len(fixed), dtype=bool), [], np.zeros(len(fixed), dtype=bool)
        for i in range(1, len(fixed)):
            up = self.parent[i]
            inside[i], below[i] = inside[up] or self.tag[i] in MARKS, below[up]
            named = self.tag[i] in BOILER_TAGS or self.boiler[i] > 0 or self.tokens[i] != 0
            listed = self.tag[i] in BOILER_TAGS or self.boiler[i] > 0
            if not below[i] and not fixed[i] and (listed if inside[i] else named) and self.tag[i] not in ("head", "script", "style"):
                moved.append(i)
                below[i] = True
        if not moved:
            return None
        roots = set(moved)
        # Nodes keep their order, parents before children: the article comes first.
        order = [*np.flatnonzero(~below).tolist(), *np.flatnonzero(below).tolist()]
        place = {old: new for new, old in enumerate(order)}
        page = object.__new__(Page)
        page.parent = [-1 if self.parent[i] < 0 else place[marked[0] if i in roots else self.parent[i]] for i in order]
        page.tag, page.text = [self.tag[i] for i in order], [self.text[i] for i in order]
        page.boiler, page.content, page.linked, page.tokens = ([values[i] for i in order] for values in (self.boiler, self.content, self.linked, self.tokens))
        page.moved = below[order]
        return page

    def reshaped(self) -> Page | None:
        """The page with its article written another way: paragraphs are other elements, some of them lie deeper, below names that say nothing."""
        marked = [i for i, t in enumerate(self.tag) if t in MARKS]
        if not marked:
            return None
        top, n, dice = marked[0], len(self.tag), zlib.crc32("".join(self.text).encode("utf-8", "replace"))
        inside = np.zeros(n, dtype=bool)
        for i in range(n):
            inside[i] = self.tag[i] in MARKS or (self.parent[i] >= 0 and inside[self.parent[i]])
        children = [i for i in range(top + 1, n) if self.parent[i] == top]
        if not children:
            return None
        tag, levels = ("p", "div", "section", "li", "td", "blockquote")[dice % 6], 1 + dice // 6 % 3
        first = children[dice // 18 % len(children)] if dice // 7 % 2 else children[0]
        after = [i for i in children if i > first]
        last = after[dice // 29 % len(after)] if after and dice // 11 % 2 else n
        page = object.__new__(Page)
        # Children from first to last go below new elements, which stand where the first of them stood.
        new = lambda i: i + levels if i >= first else i
        parents = [-1 if k < 0 else first + levels - 1 if k == top and first <= i < last else new(k) for i, k in enumerate(self.parent)]
        tags = [tag if t == "p" and inside[i] else t for i, t in enumerate(self.tag)]
        put = lambda values, more: [*values[:first], *more, *values[first:]]
        page.parent = put(parents, [top, *range(first, first + levels - 1)])
        page.tag = put(tags, [("div", "section", "td")[(dice // 5 + k) % 3] for k in range(levels)])
        page.text = put(self.text, [""] * levels)
        page.tokens = put(self.tokens, [1 << (dice // 13 + 17 * k) % BUCKETS for k in range(levels)])
        page.boiler, page.content, page.linked = (put(values, [0] * levels) for values in (self.boiler, self.content, self.linked))
        page.moved = None
        return page

    def told(self, named: bool) -> np.ndarray:
        """Nodes to learn from: those with text; of blocks moved into the article, where names don't show, lists of links alone."""
        links, text = np.array(self.linked, dtype=float), np.array([len(t.strip()) for t in self.text], dtype=float)
        for i in range(len(text) - 1, 0, -1):
            links[self.parent[i]] += links[i]
            text[self.parent[i]] += text[i]
        return (text > 0) if named else (text > 0) & (~self.moved | (2 * links > text))

    def features(self, marks: bool = True, named: bool = True) -> np.ndarray:
        """One row of NAMES for each node; without ``marks``, article and main look like plain elements, without ``named`` all do."""
        n = len(self.tag)
        parent = np.array(self.parent)
        mark = np.array([marks and t in MARKS for t in self.tag], dtype=float)
        boiler_tag = np.array([t in BOILER_TAGS for t in self.tag], dtype=float)
        boiler, content = np.array(self.boiler, dtype=float), np.array(self.content, dtype=float)
        if not named:
            boiler_tag, boiler, content = boiler_tag * 0, boiler * 0, content * 0
        is_text = np.array([t == "#" for t in self.tag], dtype=float)
        own = np.array([len(t.strip()) for t in self.text], dtype=float)
        stops = np.array([t.count(".") + t.count(",") for t in self.text], dtype=float)
        above = np.zeros((n, 4))
        source = np.column_stack([mark, boiler_tag, boiler, content])
        depth, order, count = np.zeros(n), np.zeros(n), np.zeros(n)
        direct = np.zeros(n)
        tokens = list(self.tokens) if named else [0] * n
        for i in range(1, n):
            p = self.parent[i]
            tokens[i] |= tokens[p]
            above[i] = above[p] + source[p]
            depth[i] = depth[p] + 1
            order[i] = count[p]
            count[p] += 1
            if is_text[i]:
                direct[p] += own[i]
        text, links, tags, dots = own.copy(), np.array(self.linked, dtype=float), 1 - is_text, stops.copy()
        for i in range(n - 1, 0, -1):
            p = parent[i]
            text[p] += text[i]
            links[p] += links[i]
            tags[p] += tags[i]
            dots[p] += dots[i]
        up = np.maximum(parent, 0)
        bad = np.bincount(up, weights=((boiler_tag + boiler) > 0).astype(float), minlength=n)
        siblings = count[up]
        heading = np.array([t in HEADINGS for t in self.tag], dtype=float)
        paragraph = np.array([t in PARAGRAPHS for t in self.tag], dtype=float)
        heading, paragraph = np.maximum(heading, is_text * heading[up]), np.maximum(paragraph, is_text * paragraph[up])
        return np.column_stack([
            mark, boiler_tag, boiler, content, above[:, 0] > 0, above[:, 1] > 0, above[:, 2], above[:, 3], np.full(n, mark.any()),
            depth, count, siblings, order / np.maximum(siblings, 1), bad[up] / np.maximum(siblings, 1), np.log1p(text), np.log1p(np.where(is_text > 0, own, direct)),
            text / max(text[0], 1), links / np.maximum(text, 1), np.log1p(text / (tags + 1)), dots / np.maximum(text, 1), heading, paragraph, is_text,
            np.array(tokens, dtype=np.uint64)[:, None] >> np.arange(BUCKETS, dtype=np.uint64) & np.uint64(1),
        ])

    def kept(self, odds: np.ndarray) -> list[bool]:
        """The nodes of greatest summed odds that hold no node without the one above it."""
        gain = odds.copy()
        for i in range(len(gain) - 1, 0, -1):
            if gain[i] > 0:
                gain[self.parent[i]] += gain[i]
        kept = [True] + [False] * (len(gain) - 1)
        for i in range(1, len(gain)):
            kept[i] = kept[self.parent[i]] and bool(gain[i] > 0)
        return kept

    def decode(self, odds: np.ndarray) -> str:
        """Text of the kept nodes; blocks part words, inline elements don't."""
        kept, out, last = self.kept(odds), [], 0
        for i in range(1, len(kept)):
            tag = self.tag[i]
            if tag in BLOCKS:
                out.append(" ")
            elif tag == "#" and kept[i]:
                # Coming back out of a block parts words too.
                if self._block(last) != self._block(i):
                    out.append(" ")
                out.append(self.text[i])
                last = i
        return " ".join("".join(out).split())

    def _block(self, i: int) -> int:
        while i > 0 and self.tag[i] not in BLOCKS:
            i = self.parent[i]
        return i


class Trees:
    """Fitted trees as plain lists: log-odds of feature rows."""

    def __init__(self, model):
        self.trees = []
        for weight, tree in zip(model.treeWeights, model.trees):
            nodes: list[tuple[int, float, int, int, float]] = []

            def walk(node, nodes=nodes, weight=weight):
                k = len(nodes)
                nodes.append((-1, 0.0, k, k, weight * node.prediction()))
                if hasattr(node, "leftChild") and "InternalNode" in node.getClass().getName():
                    left = walk(node.leftChild())
                    right = walk(node.rightChild())
                    nodes[k] = (node.split().featureIndex(), node.split().threshold(), left, right, 0.0)
                return k

            walk(tree._call_java("rootNode"))
            self.trees.append(tuple(np.array(c) for c in zip(*nodes)))

    def odds(self, rows: np.ndarray) -> np.ndarray:
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(rows), dtype=np.int64)
            for _ in range(DEPTH):
                go = rows[every, np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(feature[at] < 0, at, np.where(go, left[at], right[at]))
            total += value[at]
        return 2 * total  # the trees fit half of the log-odds


def _examples(batches):
    for batch in batches:
        labels, weights, rows = [], [], []
        for source in batch.column("html").to_pylist():
            page = Page(source)
            shown = [(page, True, True), (page, False, True)]
            other = page.reshaped()
            if other:
                shown += [(other, True, True), (other, False, True)]
            for moved in (page.grafted(), other and other.grafted()):
                if moved:
                    shown += [(moved, True, True), (moved, True, False)]
            for view, marks, named in shown:
                label = view.labels()
                told = view.told(named)
                labels.append(label[told].astype(float))
                weights.append(np.full(told.sum(), 1.0 if named else HIDDEN_WEIGHT))
                rows.append(view.features(marks, named)[told])
        if labels:
            flat = np.concatenate(rows)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), flat.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(labels)), pa.array(np.concatenate(weights)), lists], ["label", "weight", "row"])


def train(pages: DataFrame, html_col: str = "html") -> Trees | None:
    """Boosted trees from the sample; None if no page marks its article."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    marked = pages.select(F.col(html_col).alias("html")).filter(F.lower("html").rlike("<(article|main)[\\s>]"))
    sample = marked.orderBy(F.xxhash64("html"), "html").limit(SAMPLE_PAGES)
    examples = sample.mapInArrow(_examples, "label double, weight double, row array<double>").select("label", "weight", array_to_vector("row").alias("features")).repartition(8, "features").persist()
    try:
        if examples.select("label").distinct().count() < 2:
            return None
        return Trees(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1, weightCol="weight").fit(examples))
    finally:
        examples.unpersist()


def extract(pages: DataFrame, html_col: str = "html", model: Trees | None = None, sample: DataFrame | None = None) -> DataFrame:
    """All columns of ``pages`` but the html (and text, n_chars), with text and n_chars."""
    model = model or train(pages if sample is None else sample, html_col)
    own = [n for n in pages.columns if n not in (html_col, "text", "n_chars")]

    def run(batches):
        for whole in batches:
            sources = [h or "" for h in whole.column(html_col).to_pylist()]
            for at, past in chunks(sources):
                batch = whole.slice(at, past - at)
                found = [Page(h) for h in sources[at:past]]
                if model:
                    rows = [p.features() for p in found]
                    odds = np.split(model.odds(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
                else:
                    odds = [np.where(p.excluded(), -1.0, 1.0) for p in found]
                texts = [p.decode(o) for p, o in zip(found, odds)]
                columns = [batch.column(n) for n in own] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*own, "text", "n_chars"])

    return pages.select(*quoted([*own, html_col])).mapInArrow(run, extended(pages, own, "text string, n_chars long"))
