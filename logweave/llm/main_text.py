"""Main text of HTML pages by composite text density.

A page becomes a small tree held in parallel lists.  The density of an element
is its characters per tag, scaled by a logarithm that falls to zero as its
characters and tags are all linked, and whose base grows with the linked
characters.  The density sum of an element adds the densities of its children,
text of its own being one of them.  The subtree with the largest sum is the core
of the article; the smallest density on its way up to the body is the threshold.

Going up from the core, siblings that reach the threshold join the article if
their own sum is a fair part of the core's, or if they are its headline; an
`article` or `main` element around the core joins as a whole.  Inside, elements
whose density is below the threshold and whose text is mostly linked go.

Page furniture that says what it is (`nav`, `footer`, `aside`, a class or id such
as ``sidebar``) is not cut out by name: its characters count as linked ones, and
the densities decide.  Only what no browser shows as text is left out at once:
scripts, styles, the head, form controls, hidden elements.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .cluster import releasing, small_batches
from .textnum import chunks

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")

# Fixed values of HTML: how elements nest and break.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - {"body", "caption", "html", "legend", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody", "thead"), "thead": ("tr", "td", "th")}
HOLDS = frozenset("ul ol dl select table body html article section main div".split())

# Elements that no page shows as running text.
UNSEEN = frozenset("head title script style noscript template button select datalist input textarea label legend iframe object embed applet canvas svg math audio video map noembed noframes xmp".split())
# Elements, roles and names of page furniture, whose characters count as linked.
FURNITURE_TAGS = frozenset("nav footer aside menu dialog".split())
FURNITURE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
FURNITURE_NAMES = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies footer masthead menu nav navbar navigation newsletter notice popup promo sidebar sponsor sponsored".split())
FURNITURE_STEMS = ("advert", "breadcrumb", "cookie", "navbar", "newsletter", "sidebar")
HEADLINES = frozenset(("h1", "h2"))
MAIN = frozenset(("article", "main"))
FAIR_PART = 0.15  # of the core's density sum, for a sibling to be of the same article


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw else {}


def _is_hidden(a: dict[str, str]) -> bool:
    return "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "").lower()) is not None


def _named(a: dict[str, str]) -> bool:
    """Whether a class or id names furniture by its first or last word (``site-footer``, ``cookie_bar``, ``topNav``)."""
    for name in f"{a.get('class', '')} {a.get('id', '')}".split():
        parts = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower().replace("_", "-").split("-")
        if parts[0] in FURNITURE_NAMES or parts[-1] in FURNITURE_NAMES or parts[0].startswith(FURNITURE_STEMS):
            return True
    return False


class _Tree:
    """Elements in document order; items are texts and element borders, in order, for reading blocks back."""

    def __init__(self, page: str):
        self.tag, self.parent, self.unseen, self.last = ["#"], [-1], [False], [0]
        self.furniture = [""]  # why an element may be furniture: tag, name, form or nothing
        self.items: list[tuple[int, str | None, bool]] = []  # element, text or None for a border, whether it breaks a block
        stack, at = [0], 0
        opened = {}  # open elements by tag

        def close(depth: int) -> None:
            while len(stack) > depth:
                e = stack.pop()
                self.last[e] = len(self.tag) - 1
                opened[self.tag[e]] -= 1
                if self.tag[e] in BLOCK:
                    self.items.append((stack[-1], None, True))

        def depth_of(tags, stops=frozenset()) -> int:
            for d in range(len(stack) - 1, 0, -1):
                t = self.tag[stack[d]]
                if t in tags:
                    return d
                if t in stops:
                    return 0
            return 0

        size = len(page)
        while at < size:
            m = _MARKUP.search(page, at)
            text = page[at : m.start() if m else size]
            if text:
                self.items.append((stack[-1], entities.unescape(text) if "&" in text else text, False))
            if not m:
                break
            at = m.end()
            end, name, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if end:
                if opened.get(name) and (d := depth_of((name,))):
                    close(d)
                continue
            if name in ENDS_P and opened.get("p") and (d := depth_of(("p",), HOLDS - {"div"} | {"td", "th"})):
                close(d)
            if name in ENDS_SAME and (d := depth_of(ENDS_SAME[name], HOLDS)):
                while d > 1 and self.tag[stack[d - 1]] in ENDS_SAME[name]:
                    d -= 1
                close(d)
            if name in VOID:
                self.items.append((stack[-1], None if name == "hr" else " " if name == "br" else "", name == "hr"))
                continue
            e = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            a = _attributes(raw) if raw and not raw.isspace() else {}
            self.unseen.append(self.unseen[stack[-1]] or name in UNSEEN or bool(a) and name not in ("html", "body") and _is_hidden(a))
            self.furniture.append(self._kind(name, a, stack))
            self.last.append(e)
            if name in BLOCK:
                self.items.append((e, None, True))
            if name in RAW:
                stop = re.compile(rf"</{re.escape(name)}\s*(?=[>/]|\Z)[^>]*+(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else size
                continue
            if raw.endswith("/") and name in ("svg", "math", "path", "use"):
                continue
            stack.append(e)
            opened[name] = opened.get(name, 0) + 1
        close(1)
        self.last[0] = len(self.tag) - 1

    def _kind(self, name: str, a: dict[str, str], stack: list[int]) -> str:
        if name in ("html", "body", *MAIN):
            return ""
        if name in FURNITURE_TAGS or a.get("role", "").lower() in FURNITURE_ROLES:
            return "tag"
        if name == "header":  # of the page; an article's own holds its headline
            return "" if any(self.tag[x] in MAIN or self.tag[x] == "section" for x in stack) else "tag"
        if name == "form":
            return "form"
        return "name" if a and _named(a) else ""

    def measure(self) -> None:
        """Characters, linked characters, tags and linked tags of each element, and which are furniture.

        A form that holds most of the page's text is its frame, and so is an
        element of a telling name around an `h1`, `article` or `main`.
        """
        n = len(self.tag)
        own = [0] * n
        for e, text, _ in self.items:
            if text and not self.unseen[e]:
                own[e] += len(" ".join(text.split()))
        whole, frames = list(own), [False] * n
        for e in range(n - 1, 0, -1):
            whole[self.parent[e]] += whole[e]
            if frames[e] or self.tag[e] == "h1" or self.tag[e] in MAIN:
                frames[self.parent[e]] = True
        self.aside = [False] * n
        for e in range(1, n):
            kind = self.furniture[e]
            self.aside[e] = self.aside[self.parent[e]] or kind == "tag" or kind == "name" and not frames[e] or kind == "form" and 2 * whole[e] < whole[0]
        linked = [False] * n
        for e in range(1, n):
            linked[e] = linked[self.parent[e]] or self.tag[e] == "a" or self.aside[e]
        self.own = [0 if x else k for x, k in zip(linked, own, strict=True)]
        self.chars, self.links, self.tags, self.link_tags = list(own), [k if x else 0 for x, k in zip(linked, own, strict=True)], [0] * n, [0] * n
        for e in range(n - 1, 0, -1):
            if not self.unseen[e]:
                p = self.parent[e]
                self.chars[p] += self.chars[e]
                self.links[p] += self.links[e]
                self.tags[p] += self.tags[e] + 1
                self.link_tags[p] += self.link_tags[e] + (self.tag[e] == "a" or self.aside[e])

    def densities(self) -> tuple[list[float], list[float]]:
        """Composite density and density sum of each element."""
        n = len(self.tag)
        share = self.links[0] / max(1, self.chars[0])
        density, total = [0.0] * n, [0.0] * n
        for e in range(n - 1, -1, -1):
            if self.chars[e]:
                density[e] = composite(self.chars[e], self.links[e], self.tags[e], self.link_tags[e], share)
            if self.own[e]:
                total[e] += composite(self.own[e], 0, 0, 0, share)
            if e and not self.unseen[e]:
                total[self.parent[e]] += density[e]
        return density, total

    def article(self) -> list[bool]:
        """Whether each element's own text is of the article."""
        n = len(self.tag)
        self.measure()
        density, total = self.densities()
        clear = [e for e in range(n) if not self.unseen[e] and density[e] > 0]
        if not clear:
            return [False] * n
        core = max(clear, key=lambda e: (total[e], -e))
        path = [core]
        while path[-1] > 0 and self.tag[path[-1]] != "body":
            path.append(self.parent[path[-1]])
        threshold = min(density[e] for e in path)
        border = max((k for k, e in enumerate(path) if self.tag[e] in MAIN), default=0)
        chosen, on_path = {path[border]}, set(path)
        above = set(path[border + 1 :])
        for e in range(1, n):
            if self.parent[e] in above and e not in on_path and not self.unseen[e] and not self.aside[e]:
                headline = self.tag[e] in HEADLINES and e < core
                if headline or density[e] >= threshold and total[e] >= FAIR_PART * total[core]:
                    chosen.add(e)
        inside = [False] * n
        for e in range(n):
            thin = density[e] < threshold and 2 * self.links[e] > self.chars[e] and (self.aside[e] or self.link_tags[e] > 1) and self.tag[e] != "a"
            inside[e] = not self.unseen[e] and (e in chosen or e > 0 and inside[self.parent[e]] and not thin)
        return inside


def composite(chars: int, links: int, tags: int, link_tags: int, share: float) -> float:
    """Composite text density, counts smoothed by one; `share` is the share of linked characters of the whole page.

    Zero where all characters and tags are linked.
    """
    base = math.log(chars * links / (chars - links + 1) + share * chars + math.e)
    ratio = (chars + 1) / (links + 1) * (tags + 1) / (link_tags + 1)
    return chars / max(1, tags) * math.log(ratio) / math.log(base + 1)


def main_text(page: str | None) -> str:
    """Article text of one page: blocks in page order joined by newlines; empty if the page has none."""
    if not page:
        return ""
    tree = _Tree(page)
    inside = tree.article()
    blocks, run = [], []
    for e, text, breaks in tree.items:
        if breaks:
            blocks.append(run)
            run = []
        elif text and inside[e]:
            run.append(text)
    blocks.append(run)
    lines = (" ".join("".join(b).split()) for b in blocks if b)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Add the main text and its number of code points (`n_chars`) of each row's whole html.

    Null, empty or text-free pages get an empty text.  Columns named `text` or
    `n_chars` are replaced, others pass through, whatever their names; repeated
    rows are extracted alike, and an empty table gives an empty result.  A page
    of any length is read whole, in time proportional to its length; pages are
    taken a few megabytes at a time.
    """
    keep = [f for f in pages.schema if f.name not in (text, "n_chars")]
    names = pages.columns
    schema = T.StructType([*keep, T.StructField(text, T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            for piece in chunks(batch, html):
                texts = [main_text(x) for x in piece.column(names.index(html)).to_pylist()]
                columns = [piece.column(names.index(f.name)) for f in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], schema.fieldNames())

    small_batches(pages.sparkSession)
    return pages.mapInArrow(releasing(run), schema)
