"""Main text of web pages, by differencing each page against the page of its host with the nearest URL.

* A page is read into blocks (lines of text between block elements) in one pass. Lines in elements that name themselves as something
  else than the article (`nav`, `form`, `class="sidebar"`, ...) are known not to be the article; lines in `article`, `main` or
  `role="main"` are declared to be.
* The distinct paths of a host are put in order; the neighbours of a path, the one with the longer common beginning first, are the
  pages that most likely share its template. The lines of page and neighbour are aligned by longest common subsequence, and
  lines that both have are deleted, unless the page declares them as its article. A neighbour that shares `COPY` or more of the
  characters is a copy and tells nothing about the template; then the other neighbour is taken, and if that is one too, nothing goes.
* On a page that declares an article its lines stay (a passage that two articles quote is no template) and all others go, shared or not:
  differencing cannot reach a line of the template that varies from page to page, such as a random menu entry.

Only hashes of lines that no page declares as article travel to the neighbours. One page stands for all of a path (the smallest key), so a
path or host with a third of all pages puts one row into each join, and its pages are joined in salted pieces. Pages are read twice,
once for the hashes and once for the text, which is so moved once and never written in between.

Null and empty pages give an empty text. A page without a URL has no neighbours: it keeps its lines but for the named elements. Repeated
rows and null or repeated ids are rows of their own. Other columns of the input are not read.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonecast.llm.common import map_rows, schema
from zonecast.operators.ordering import with_position
from zonecast.operators.skew import hot_keys, lookup_join
from zonecast.session import materialize

#: Share of a page's characters from which a neighbour that has them too counts as a copy.
COPY = 0.5

# Elements and attribute words of HTML.
SILENT = {"script", "style", "noscript", "template", "svg", "math", "head", "iframe", "object", "canvas", "audio", "video", "textarea", "select"}
ASIDE = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar"}
WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs pagination pager sidebar aside widget widgets footer masthead cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus reply replies "
    "respond toolbar skip".split()
)
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Opening one of the values ends an open element of the key.
CLOSES = {
    "p": BLOCKS - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
}

_SPACE = re.compile(r"\s+")
_NAMES = re.compile(r"[a-z0-9]+")
#: A tag that the end of the page cuts off.
_CUT_TAG = re.compile(r"<[/!?a-zA-Z][^<>]*\Z")


def is_article(tag: str, attributes: dict[str, str]) -> bool:
    return tag in ("article", "main") or attributes.get("role", "").lower() == "main"


def is_elsewhere(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element names itself as no part of the article; `inside`: it stands in a declared article."""
    if tag in ASIDE or (tag == "header" and not inside) or attributes.get("role", "").lower() in ROLES:
        return True
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if tag in ("html", "body") or is_article(tag, attributes):
        return False
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()
    # `c-cookie` and `cookie_bar` speak of a cookie, `adventure` does not of an ad
    return not WORDS.isdisjoint(_NAMES.findall(named))


class _Reader(HTMLParser):
    """Collects (text, declared, elsewhere) of each block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, bool, bool]] = []
        # open elements: name, silent, elsewhere, declared as article; each as of all that are open around it
        self._open: list[tuple[str, bool, bool, bool]] = []
        self._text: list[str] = []

    def _now(self) -> tuple[str, bool, bool, bool]:
        return self._open[-1] if self._open else ("", False, False, False)

    def _break(self) -> None:
        if self._text:
            text = _SPACE.sub(" ", "".join(self._text)).strip()
            self._text = []
            if text:
                _, _, elsewhere, declared = self._now()
                self.lines.append((text, declared, elsewhere))

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._break()
            self._end_implied(tag)
        elif tag == "br":
            self._text.append(" ")
        if tag in VOID:
            return
        _, silent, elsewhere, declared = self._now()
        attributes = {k: v or "" for k, v in attrs}
        new = is_elsewhere(tag, attributes, declared)
        if new and not elsewhere:
            self._break()
        article = is_article(tag, attributes)
        self._open.append((tag, silent or tag in SILENT, elsewhere or new, declared or article))

    def _end_implied(self, tag: str) -> None:
        """Close the paragraph, list item or cell that `tag` ends, with what is open inside it."""
        for at in range(len(self._open) - 1, max(len(self._open) - 32, -1), -1):
            name = self._open[at][0]
            if tag in CLOSES.get(name, ()):
                del self._open[at:]
                return
            if name in BLOCKS:
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        if tag in BLOCKS:
            self._break()
        for at in range(len(self._open) - 1, -1, -1):
            if self._open[at][0] == tag:
                if self._open[at][2] and not (at and self._open[at - 1][2]):
                    self._break()
                del self._open[at:]
                return
            # an end inside a block does not end what is open around it
            if self._open[at][0] in BLOCKS and tag not in BLOCKS:
                return

    def handle_data(self, data):
        if not self._now()[1]:
            self._text.append(data)

    def close(self):
        super().close()
        self._break()


def lines_of(html: str | None) -> list[tuple[str, bool, bool]]:
    reader = _Reader()
    reader.feed(_CUT_TAG.sub("", html or ""))
    reader.close()
    return reader.lines


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Places in `a` of a longest common subsequence of `a` and `b`.

    Equal ends are taken off and lines that only one side has left out. What remains is solved with whole rows of the table as one
    integer; tables above a size are halved first, so memory stays in proportion to the lines.
    """
    n, m, at = len(a), len(b), 0
    while at < min(n, m) and a[at] == b[at]:
        at += 1
    tail = 0
    while tail < min(n, m) - at and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    found = {*range(at), *range(n - tail, n)}
    both = set(a[at : n - tail]) & set(b[at : m - tail])
    left = [i for i in range(at, n - tail) if a[i] in both]
    right = [x for x in b[at : m - tail] if x in both]
    return found | _subsequence(left, [a[i] for i in left], right)


#: Cells of the table that are kept at once.
_CELLS = 1 << 24


def _row_bits(a: list[int], b: list[int]) -> list[int]:
    """After each line of `a` the row of the table: bit j is 0 where the common length with b[:j + 1] grows."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    return rows


def _subsequence(names: list[int], a: list[int], b: list[int]) -> set[int]:
    if not a or not b:
        return set()
    if len(a) > 1 and len(a) * len(b) > _CELLS:
        half = len(a) // 2
        front, back = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])[::-1]
        cut = max(range(len(b) + 1), key=lambda j: front[j] + back[j])
        return _subsequence(names[:half], a[:half], b[:cut]) | _subsequence(names[half:], a[half:], b[cut:])
    rows, found, j = _row_bits(a, b), set(), len(b)
    for i in range(len(a) - 1, -1, -1):
        here = ~rows[i] & ((1 << j) - 1)
        above = ~rows[i - 1] & ((1 << j) - 1) if i else 0
        if here.bit_count() > above.bit_count():  # line i adds one, at the last place where the row grows
            found.add(names[i])
            j = here.bit_length() - 1
    return found


def _lengths(a: list[int], b: list[int]) -> list[int]:
    """Longest common length of `a` and b[:j], for each j."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    out = [0]
    for bit in bin(row | 1 << len(b))[:2:-1]:
        out.append(out[-1] + (bit == "0"))
    return out


def shared_lines(hashes: list[int], sizes: list[int], neighbours: list[list[int] | None]) -> list[int]:
    """Places of the lines that the first neighbour which is no copy shares."""
    total = sum(sizes)
    for other in neighbours:
        if other:
            found = common_lines(hashes, other)
            if found and sum(sizes[i] for i in found) < COPY * total:
                return sorted(found)
            if not found:
                return []
    return []


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """The path without query, fragment, page suffix and last slash."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(path, r"(?:\.[A-Za-z]{3,5})?/*$", "")


def keyed_pages(pages: DataFrame) -> DataFrame:
    """`_key` (a digest of what is read, so equal rows share it and have one result), page_id, url and html."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parts = [F.coalesce(F.concat(F.length(c), F.lit(":"), c), F.lit("-")) for c in ("url", "html")]
    return rows.withColumn("_key", F.unhex(F.md5(F.concat(*parts))))


def page_lines(pages: DataFrame) -> DataFrame:
    """`_key`, page_id, url, lines and declared: the lines that may stay, null where a line cannot."""

    def make():
        def work(rows):
            found = [lines_of(h) for h in rows["html"]]
            has = [any(declared for _, declared, _ in lines) for lines in found]
            return {k: rows[k] for k in ("_key", "page_id", "url")} | {
                "lines": [
                    [t for t, declared, elsewhere in lines if declared and not elsewhere] if own
                    # a line that stands elsewhere keeps its place, which is how the neighbours' lines are named
                    else [None if elsewhere else t for t, _, elsewhere in lines]
                    for lines, own in zip(found, has)
                ],
                "declared": has,
            }

        return work

    kind = pages.schema["page_id"].dataType.simpleString()
    columns = f"_key binary, page_id {kind}, url string, lines array<string>, declared boolean"
    return map_rows(pages.select("_key", "page_id", "url", "html"), make, schema(columns), 64)


def undeclared_lines(pages: DataFrame) -> DataFrame:
    """`_key`, host, path, and hash and size of the lines that the page does not declare as its article, once for equal rows."""

    def make():
        import xxhash

        def work(rows):
            found = [[t for t, declared, _ in lines_of(h) if not declared] for h in rows["html"]]
            return {k: rows[k] for k in ("_key", "host", "path")} | {
                "hashes": [[xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in lines] for lines in found],
                "sizes": [[len(t) for t in lines] for lines in found],
            }

        return work

    rows = pages.select(
        "_key", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"), "html"
    ).filter("host <> ''")
    read = map_rows(rows, make, schema("_key binary, host string, path string, hashes array<long>, sizes array<int>"), 64)
    return read.groupBy("_key").agg(*[F.first(c).alias(c) for c in ("host", "path", "hashes", "sizes")])


def common_beginning(a: Column, b: Column) -> Column:
    """Length of the longest common beginning of two texts."""
    places = F.sequence(F.lit(1), F.least(F.length(a), F.length(b)))
    differs = lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))
    least = F.least(F.length(a), F.length(b))
    return F.when(least > 0, F.coalesce(F.array_min(F.filter(places, differs)) - 1, least)).otherwise(0)


def neighbours(read: DataFrame) -> DataFrame:
    """For each (host, path) the line hashes of the nearer and the farther neighbour among the host's paths."""
    paths = read.groupBy("host", "path").agg(F.min(F.struct("_key", "hashes"))["hashes"].alias("hashes"))
    placed = materialize(with_position(paths, [F.col("host"), F.col("path")]), "paths")
    sides = [
        placed.select("host", (F.col("position") + step).alias("position"), F.struct("path", "hashes").alias(name))
        for name, step in (("before", 1), ("after", -1))
    ]
    both = placed.select("host", "path", "position").join(sides[0], ["host", "position"], "left").join(sides[1], ["host", "position"], "left")
    near = [F.coalesce(common_beginning(F.col("path"), F.col(f"{s}.path")), F.lit(-1)) for s in ("before", "after")]
    first = near[0] >= near[1]
    pick = lambda a, b: F.when(first, F.col(f"{a}.hashes")).otherwise(F.col(f"{b}.hashes"))
    return both.select("host", "path", pick("before", "after").alias("near"), pick("after", "before").alias("far"))


def shared_with_neighbours(read: DataFrame) -> DataFrame:
    """`_key` and the places, among the undeclared lines, of those that a neighbour shares."""
    pairs = lookup_join(read, neighbours(read), ["host", "path"], "inner", hot=hot_keys(read, ["host", "path"]))

    def make():
        return lambda rows: {
            "_key": rows["_key"],
            "shared": [shared_lines(*r[:2], list(r[2:])) for r in zip(rows["hashes"], rows["sizes"], rows["near"], rows["far"])],
        }

    shared = map_rows(pairs.select("_key", "hashes", "sizes", "near", "far"), make, schema("_key binary, shared array<int>"), 64)
    return shared.filter(F.size("shared") > 0)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_shared (undeclared lines that a neighbour has too) of each row of `pages(page_id, url, html)`."""
    rows = keyed_pages(pages)
    read = materialize(undeclared_lines(rows), "page_lines")
    lines = page_lines(rows)
    # a page that comes very often is dealt out; its key has one row on the other side
    repeated = hot_keys(rows.select("_key"), ["_key"])
    joined = lookup_join(lines, shared_with_neighbours(read), ["_key"], "left", hot=repeated)
    gone = F.coalesce("shared", F.array().cast("array<int>"))
    kept = F.filter("lines", lambda line, i: line.isNotNull() & (F.col("declared") | ~F.array_contains(gone, i)))
    return joined.select("page_id", "url", F.array_join(kept, "\n").alias("text"), F.size(gone).cast("long").alias("n_shared")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared"
    )
