"""Elements of captured HTML pages and sitemaps, by parsers that work through Arrow batches. One unreadable body never ends a job."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from xml.parsers import expat

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ELEMENT = "pos int, tag string, href string, rel string, hreflang string, property string, text string"
LOC = "root string, loc string, error string"


#: Rows and bytes of bodies that a Python worker parses at once.
ROWS, BYTES = 256, 1 << 22


def few(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``ROWS`` rows and about ``BYTES`` of ``column`` (one body at least): what bodies become takes many times their size."""
    for b in batches:
        start, total = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()):
            if i > start and (i - start == ROWS or total + n > BYTES):
                yield b.slice(start, i - start)
                start, total = i, 0
            total += n
        if b.num_rows:
            yield b.slice(start)


class _Page(HTMLParser):
    """The links, metas and the title of a page in order of their begin; an anchor's text ends with it, or where the next begins."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: dict[str, dict] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in ("a", "link", "meta", "title"):
            return
        told: dict[str, str] = {}
        for name, value in attrs:
            told.setdefault(name, value or "")
        row = {"tag": tag, "href": told.get("content" if tag == "meta" else "href", ""), "rel": told.get("rel", ""), "hreflang": told.get("hreflang", ""), "text": []}
        row["property"] = " ".join(x for x in (told.get("property", ""), told.get("name", "")) if x) if tag == "meta" else ""
        self.rows.append(row)
        if tag in ("a", "title"):
            self.open[tag] = row

    def handle_endtag(self, tag: str) -> None:
        self.open.pop(tag, None)

    def handle_data(self, data: str) -> None:
        for row in self.open.values():
            row["text"].append(data)


    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![...]]>`` of any name is a comment, up to the first ``>``, as browsers take it."""
        end = self.rawdata.find(">", i)
        return -1 if end < 0 else end + 1


def page_elements(html: str | None) -> tuple[list[dict], str | None]:
    """A page's elements, and what ended its reading before its end, if anything did: what was read until then stays."""
    page, error = _Page(), None
    try:
        page.feed(html or "")
        page.close()
    except (AssertionError, ValueError, IndexError, RecursionError) as e:
        error = f"{type(e).__name__}: {e}"
    return page.rows, error


def sitemap_of(body: str | None) -> tuple[str, list[str], str | None]:
    """Root element, locations and error of a sitemap. A body that is no well-formed XML, or has another root, gives an error and no location."""
    root, locs, inside = [], [], []
    parser = expat.ParserCreate("utf-8")

    def begin(name: str, _: dict) -> None:
        local = name.rsplit(":", 1)[-1].lower()
        root.append(local) if not root else None
        if inside:
            inside[-1][1] += 1
        elif local == "loc":
            inside.append([[], 0])

    def end(_: str) -> None:
        if inside and inside[-1][1]:
            inside[-1][1] -= 1
        elif inside and (loc := "".join(inside.pop()[0]).strip()):
            locs.append(loc)

    parser.StartElementHandler, parser.EndElementHandler = begin, end
    parser.CharacterDataHandler = lambda data: inside[-1][0].append(data) if inside and not inside[-1][1] else None
    try:
        parser.Parse((body or "").encode("utf-8", "replace"), True)
    except expat.ExpatError as e:
        return "".join(root), [], "empty sitemap document" if not (body or "").strip() else f"no well-formed XML: {e}"
    return (root[0], locs, None) if root[0] in ("sitemapindex", "urlset") else (root[0], [], f'unsupported sitemap root "{root[0]}"')


def elements(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """The columns ``keep`` of each page with a row for each of its anchors, links, metas and titles, in document order."""
    fields = pages.select(*keep).schema.fields
    new = T._parse_datatype_string(ELEMENT).fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches, len(keep)):
            found = [page_elements(x)[0] for x in b.column(len(keep)).to_pylist()]
            row = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
            if len(row):
                flat = [x | {"pos": n, "text": "".join(x["text"])} for rows in found for n, x in enumerate(rows)]
                cols = [pa.array([x[f.name] for x in flat], pa.int32() if f.name == "pos" else pa.string()) for f in new]
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(row) for i in range(len(keep))), *cols], names=[*keep, *(f.name for f in new)])

    return pages.select(*keep, html).mapInArrow(run, T.StructType(fields + new))


def page_errors(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """The columns ``keep`` of each page that could not be read to its end, with the error and the number of elements read before it."""
    fields = pages.select(*keep).schema.fields
    new = T._parse_datatype_string("error string, elements int").fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches, len(keep)):
            bad = [(i, error, len(rows)) for i, x in enumerate(b.column(len(keep)).to_pylist()) for rows, error in [page_elements(x)] if error is not None]
            if bad:
                at, errors, n = (pa.array(c) for c in zip(*bad, strict=True))
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(len(keep))), errors, n.cast(pa.int32())], names=[*keep, *(f.name for f in new)])

    return pages.select(*keep, html).mapInArrow(run, T.StructType(fields + new))


def sitemap_rows(bodies: DataFrame, keep: list[str], body: str = "body") -> DataFrame:
    """The columns ``keep`` of each body with a row for each location, or one with the error."""
    fields = bodies.select(*keep).schema.fields
    new = T._parse_datatype_string(LOC).fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches, len(keep)):
            rows = []
            for i, x in enumerate(b.column(len(keep)).to_pylist()):
                root, locs, error = sitemap_of(x)
                rows += [(i, root, loc, None) for loc in locs] if error is None else [(i, root, None, error)]
            if rows:
                at, *cols = zip(*rows, strict=True)
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(len(keep))), *(pa.array(c, pa.string()) for c in cols)], names=[*keep, *(f.name for f in new)])

    return bodies.select(*keep, body).mapInArrow(run, T.StructType(fields + new))
