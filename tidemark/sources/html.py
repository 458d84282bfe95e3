"""Web pages to transcript elements, with the standard library's parser in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Elements of a page that carry text, and classes of blocks that don't.
BLOCKS = frozenset({"div", "p", "ul", "ol"})
SKIPPED = frozenset({"title", "address-box", "-top-arrow", "related-topics", "upper-connetion", "lower-connection", "see-also-boxes", "notes", "footnotes"})
#: Signs of elements that a task holds before it gives them on.
HELD = 1 << 20
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_MARKED = frozenset({"b", "strong", "em"})
#: Fixed values of HTML: elements that end by themselves where another starts, up to the elements that hold them.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
_IMPLIED = {"li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"}))}
_HOLDERS = frozenset("table td th caption button template main body".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def texts(self, out: list[str]) -> list[str]:
        stack = [iter(self.children)]
        while stack:
            for c in stack[-1]:
                if isinstance(c, str):
                    out.append(c)
                else:
                    stack.append(iter(c.children))
                    break
            else:
                stack.pop()
        return out

    def text(self, sep: str = "") -> str:
        parts = self.texts([])
        return sep.join(p.strip() for p in parts if p.strip()) if sep else "".join(parts)

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.open: dict[str, int] = {}

    def _leave(self, node):
        """Ends node and what is open in it."""
        while self.at is not node:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent
        self.open[node.tag] -= 1
        self.at = node.parent

    def _end(self, tags, holders):
        """Ends the innermost open element of these tags that no holder hides."""
        if not any(self.open.get(t) for t in tags):
            return
        n = self.at
        while n.parent is not None and n.tag not in holders:
            if n.tag in tags:
                self._leave(n)
                return
            n = n.parent

    def handle_starttag(self, tag, attrs):
        if tag in _IMPLIED:
            self._end(*_IMPLIED[tag])
        if tag in _ENDS_P:
            self._end({"p"}, _HOLDERS)
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.open[tag] = self.open.get(tag, 0) + 1
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        if not self.open.get(tag):
            return
        n = self.at
        while n.tag != tag:
            n = n.parent
        self._leave(n)

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    for n in tree.root.walk():
        n.parent = None  # else trees stay until rings are looked for
    return tree.root


def marked_text(node) -> str:
    """Text with bold and emphasised parts in brackets; parts of one sign or none are left out."""
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            if len(n) > 1:
                out.append(n)
        elif n.tag in _MARKED:
            whole = n.text()
            if len(whole) > 1:
                out.append(f"[{whole}]")
        elif _longer_than_one(n):
            stack.extend(reversed(n.children))
    return "".join(out)


def _longer_than_one(node) -> bool:
    n, stack = 0, [node]
    while stack and n < 2:
        x = stack.pop()
        if isinstance(x, str):
            n += len(x)
        else:
            stack.extend(x.children)
    return n > 1


def page_elements(html: str, root: str = "main", nested: bool = True) -> list[tuple[str, str]]:
    """(spaced text, marked text) of the blocks and headings two levels below the root, skipped classes left out; or of
    those right below it, if not ``nested``."""
    main = next((n for n in parse(html).walk() if n.tag == root), None)
    out = []
    for child in main.children if main else ():
        if not nested:
            if isinstance(child, Node) and (child.tag in BLOCKS or "h" in child.tag):
                out.append((child.text("  "), marked_text(child)))
            continue
        if not isinstance(child, Node) or child.tag not in BLOCKS or SKIPPED & set((child.attrs.get("class") or "").split()):
            continue
        for g in child.children:
            if isinstance(g, Node) and (g.tag in BLOCKS or "h" in g.tag):
                out.append((g.text("  "), marked_text(g)))
    return out


def index_links(html: str) -> list[tuple[str, str]]:
    """(isodate, href) of a year's index, last entry first: a dt[isodate] outside dl, the next dd, its div.title, a[href]."""
    out, tree = [], parse(html)
    later: dict[int, Node | None] = {}  # of each dt the next dd beside it
    for n in tree.walk():
        dd = None
        for c in reversed(n.children):
            if isinstance(c, Node):
                dd = c if c.tag == "dd" else dd
                if c.tag == "dt":
                    later[id(c)] = dd
    stack = [(tree, False)]
    while stack:
        n, inside = stack.pop()  # inside a dl
        if n.tag == "dt" and n.attrs.get("isodate") and not inside:
            dd = later[id(n)]
            title = next((c for c in dd.walk() if c.tag == "div" and "title" in (c.attrs.get("class") or "").split()), None) if dd else None
            a = next((c for c in title.walk() if c.tag == "a"), None) if title else None
            if a is not None and a.attrs.get("href"):
                out.append((n.attrs["isodate"], a.attrs["href"]))
        stack.extend((c, inside or n.tag == "dl") for c in reversed(n.children) if isinstance(c, Node))
    return out[::-1]


def fetch(url: str, open_url=None, timeout: float = 30.0) -> bytes | None:
    """A page's bytes; None on any failure of the connection or a status of error."""
    import urllib.error
    import urllib.request

    try:
        with (open_url or urllib.request.urlopen)(url, timeout=timeout) as reply:
            return reply.read()
    except (urllib.error.URLError, TimeoutError, ConnectionError):
        return None


def fetched(urls: DataFrame, open_url=None, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, url, html: pages read by the executors, one after the other in each task; failures are left out."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(k, u, b.decode("utf-8", "replace")) for k, u in zip(pdf["key"], pdf["url"], strict=True) if (b := fetch(u, open_url)) is not None]
            yield pd.DataFrame(rows, columns=["key", "url", "html"])

    return urls.select(F.col(key).alias("key"), F.col(url).alias("url")).mapInPandas(run, "key long, url string, html string").withColumnRenamed("key", key)


def elements(pages: DataFrame, root: str = "main", key: str = "page_id", html: str = "html", nested: bool = True) -> DataFrame:
    """key, pos, text, marked: the elements of each page."""

    def run(batches):
        import pyarrow as pa

        names = ["key", "pos", "text", "marked"]
        types = (pa.int64(), pa.int32(), pa.string(), pa.string())

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            rows, size = [], 0
            for k, h in zip(batch.column(0), batch.column(1), strict=True):  # a page at a time
                k = k.as_py()
                for i, (a, b) in enumerate(page_elements(h.as_py(), root, nested)):
                    rows.append((k, i, a, b))
                    size += len(a) + len(b) + 100
                if size > HELD:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)

    return pages.select(F.col(key).cast("long").alias("key"), F.col(html).alias("html")).mapInArrow(run, "key long, pos int, text string, marked string").withColumnRenamed("key", key)


def article_index(pages: DataFrame, base: str = "", html: str = "html") -> DataFrame:
    """date, url: links of year indexes; where a date comes twice in a page the entry read last wins."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(i, d, u) for h in pdf["html"] for i, (d, u) in enumerate(index_links(h))]
            yield pd.DataFrame(rows, columns=["n", "date", "href"])

    found = pages.select(F.col(html).alias("html")).mapInPandas(run, "n int, date string, href string")
    w = Window.partitionBy("date").orderBy(F.col("n").desc(), "href")
    return found.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("date", F.concat(F.lit(base), "href").alias("url"))


def split_position(els: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """key, sep: position of the last introductory element, -1 for none. The head of a transcript overrides an
    invitation to questions (beyond the third element), which overrides a first question."""
    return els.groupBy(key).agg(_split(text).alias("sep"))


def _split(text: str):
    """The position as an aggregate."""
    from ..functions.text import FIRST_QUESTION, INVITATION, TRANSCRIPT_HEAD

    first = lambda pattern, more=F.lit(True): F.min(F.when(F.col(text).rlike(pattern) & more, F.col("pos")))
    p3 = first(TRANSCRIPT_HEAD)
    head = F.when(p3 > 0, p3 - 1)  # at the very start it counts as not found
    return F.coalesce(head, first(INVITATION, F.col("pos") > 2), first(FIRST_QUESTION) - 1, F.lit(-1)).cast("int")


def transcripts(pages: DataFrame, root: str = "main", key: str = "page_id", nested: bool = True) -> DataFrame:
    """key, intro, qa: tab-joined elements before and after the split, quotes normalised."""
    from ..functions.text import normalise_quotes, qa_text

    els = elements(pages, root, key, nested=nested)
    # a page's elements are one cell, as its transcript is; pages are parsed once
    g = els.groupBy(key).agg(_split("text").alias("sep"), F.array_sort(F.collect_list(F.struct("pos", "text", "marked"))).alias("rows"))
    whole = lambda x: (F.col("sep") < 0) | (x["pos"] <= F.col("sep"))
    part = lambda test, c: F.transform(F.filter("rows", test), lambda x: x[c])
    g = g.select(key, part(whole, "text").alias("i"), part(lambda x: ~whole(x), "marked").alias("q"))
    return g.select(key, normalise_quotes(F.array_join("i", "\t"), "''").alias("intro"), normalise_quotes(qa_text("q"), "'").alias("qa"))
