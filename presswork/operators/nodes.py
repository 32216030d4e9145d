"""HTML pages as arrays of nodes.

Spark has no HTML reader, so one Arrow-batched step flattens each page into a
node table: tag, attributes, the interval of its descendants and the interval
of its text.  It decides nothing about articles.  Every extraction rule is a
column expression over that array (see ``selectors`` and ``extract``).
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from ..functions import fixed_values as fixed

# Elements that never have content.
VOID_TAGS = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta",
    "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex",
    "nextid", "spacer",
}
# Their text is code, not prose.
RAW_TAGS = {"script", "style", "template"}


def _tags_and_classes(selector: str) -> tuple[set[str], set[str]]:
    parts = [part.strip() for part in selector.split(",")]
    return {p for p in parts if not p.startswith(".")}, {p[1:] for p in parts if p.startswith(".")}


CHROME, FRAME = _tags_and_classes(fixed.CHROME_SELECTOR), _tags_and_classes(fixed.PAGE_FRAME_SELECTOR)
KEPT_ATTRS = {
    "rel", "role", "itemtype", "itemprop", "property", "name", "content", "href", "src", "data-src",
    "datetime", "class", "type",
}

NODE = T.StructType([
    T.StructField("i", T.IntegerType()),        # position in document order
    T.StructField("end", T.IntegerType()),      # position of the last descendant
    T.StructField("tag", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("start", T.IntegerType()),    # its text is text[start:stop]
    T.StructField("stop", T.IntegerType()),
    T.StructField("s0", T.IntegerType()),       # its only string, chrome removed; -1 if it has not exactly one
    T.StructField("s1", T.IntegerType()),
    T.StructField("b0", T.IntegerType()),       # the same with chrome and page frame removed
    T.StructField("b1", T.IntegerType()),
    T.StructField("chrome", T.IntegerType()),   # nearest chrome element, itself included; -1 if none
    T.StructField("frame", T.IntegerType()),    # nearest page-frame element
])

_ARROW_NODE = pa.struct([
    ("i", pa.int32()), ("end", pa.int32()), ("tag", pa.string()), ("id", pa.string()),
    ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())),
    ("start", pa.int32()), ("stop", pa.int32()), ("s0", pa.int32()), ("s1", pa.int32()),
    ("b0", pa.int32()), ("b1", pa.int32()), ("chrome", pa.int32()), ("frame", pa.int32()),
])


class _Flattener(HTMLParser):
    """Builds the node rows.  An end tag closes everything above its match and
    is ignored without one; nothing else closes an element early."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.stack: list[int] = []
        self.children: list[list] = [[]]        # per open element: child indexes or text spans
        self.pieces: list[str] = []
        self.size = 0
        self.ld_json: list[str] = []
        self.raw: list[str] = []

    def handle_starttag(self, tag, attrs):
        attrs = {k: (v if v is not None else "") for k, v in attrs}
        classes = attrs.get("class", "").split()
        i = len(self.rows)
        above = self.rows[self.stack[-1]] if self.stack else None
        chrome, frame = (above[12], above[13]) if above else (-1, -1)
        if tag in CHROME[0] or not CHROME[1].isdisjoint(classes):
            chrome = i
        if tag in FRAME[0] or not FRAME[1].isdisjoint(classes):
            frame = i
        kept = [(k, v) for k, v in attrs.items() if k in KEPT_ATTRS]
        self.children[-1].append(i)
        self.rows.append([i, i, tag, attrs.get("id", ""), classes, kept, self.size, self.size,
                          -1, -1, -1, -1, chrome, frame])
        self.stack.append(i)
        self.children.append([])
        if tag in RAW_TAGS:
            self.raw = []
        if tag in VOID_TAGS:
            self._close()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in VOID_TAGS or all(self.rows[i][2] != tag for i in self.stack):
            return
        while True:
            name = self.rows[self.stack[-1]][2]
            self._close()
            if name == tag:
                return

    def handle_data(self, data):
        if self.stack and self.rows[self.stack[-1]][2] in RAW_TAGS:
            self.raw.append(data)
            self.children[-1].append(None)
            return
        self._text(data)

    def _text(self, data):
        last = self.children[-1][-1] if self.children[-1] else None
        start, self.size = self.size, self.size + len(data)
        self.pieces.append(data)
        if isinstance(last, tuple):             # adjoining text is one string
            self.children[-1][-1] = (last[0], self.size)
        else:
            self.children[-1].append((start, self.size))

    def handle_comment(self, data):
        self.children[-1].append(None)

    handle_decl = handle_pi = unknown_decl = handle_comment

    def _only_string(self, children, chrome_col_start):
        """Span of the single string left under an element, else (-1, -1)."""
        left = [
            c for c in children
            if not isinstance(c, int)
            or not (self.rows[c][12] == c or (chrome_col_start == 10 and self.rows[c][13] == c))
        ]
        if len(left) != 1 or left[0] is None:
            return -1, -1
        if isinstance(left[0], tuple):
            return left[0]
        row = self.rows[left[0]]
        return row[chrome_col_start], row[chrome_col_start + 1]

    def _close(self):
        row = self.rows[self.stack.pop()]
        children = self.children.pop()
        row[1], row[7] = len(self.rows) - 1, self.size
        row[8:10] = self._only_string(children, 8)
        row[10:12] = self._only_string(children, 10)
        if row[2] == "script" and self.raw and ("type", "application/ld+json") in row[5]:
            self.ld_json.append("".join(self.raw))

    def finish(self):
        self.close()
        while self.stack:
            self._close()
        return [tuple(r) for r in self.rows], "".join(self.pieces), self.ld_json


def flatten_page(html: str):
    """(nodes, text, JSON-LD strings) of one page."""
    parser = _Flattener()
    parser.feed(re.sub("[\ud800-\udfff]", "�", html or ""))
    return parser.finish()


def page_nodes(pages: DataFrame, html: str = "html", rows_per_batch: int = 128) -> DataFrame:
    """Replace ``html`` by ``nodes``, ``text`` and ``ld_json``; other columns pass through."""
    keep = [f for f in pages.schema.fields if f.name != html]
    schema = T.StructType(keep + [
        T.StructField("nodes", T.ArrayType(NODE)),
        T.StructField("text", T.StringType()),
        T.StructField("ld_json", T.ArrayType(T.StringType())),
    ])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # Small output batches: a page's nodes take a few times its size.
            for at in range(0, whole.num_rows, rows_per_batch):
                batch = whole.slice(at, rows_per_batch)
                nodes, texts, lds = [], [], []
                for page in batch.column(batch.schema.get_field_index(html)).to_pylist():
                    n, t, ld = flatten_page(page)
                    nodes.append(n)
                    texts.append(t)
                    lds.append(ld)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index(n)) for n in names]
                    + [pa.array(nodes, pa.list_(_ARROW_NODE)), pa.array(texts, pa.string()),
                       pa.array(lds, pa.list_(pa.string()))],
                    names=names + ["nodes", "text", "ld_json"],
                )

    return pages.select(*names, html).mapInArrow(run, schema)
