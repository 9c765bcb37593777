"""Pages as elements and text candidates, by the standard library's parser in Arrow tasks.

A page is parsed where it is read; its elements come out as rows, in document order, with what later
steps ask of their ancestors. Nothing is gathered across pages.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of elements.
TECHNICAL = frozenset("script style noscript template head meta link base title".split())
PRIVATE = frozenset("input textarea select".split())
PRIMARY = frozenset("p li td th h1 h2 h3 h4 h5 h6 blockquote pre figcaption dt dd caption summary".split())
INTERACTIVE = frozenset("a button label option".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
REGIONS = frozenset("article section main nav aside header footer form table ul ol".split())
# End of the fixed values.

_COLUMNS = "page_id long, node_id int, parent_id int, preorder int, postorder int, depth int, tag string, own_text string, source string, in_code boolean, in_quote boolean, in_nav boolean, region string"


class _Tree(HTMLParser):
    """Elements with their own text, which a nested text owner's isn't part of."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[dict] = []
        self.nodes: list[dict] = []
        self.closed = 0

    def handle_starttag(self, tag, attrs):
        up = self.stack[-1] if self.stack else None
        at = dict(attrs)
        hidden = (up or {}).get("skip", False) or tag in TECHNICAL or tag in PRIVATE or at.get("contenteditable") in ("", "true") or (at.get("role") or "").lower() == "textbox"
        node = {
            "tag": tag, "parent": up["id"] if up else None, "id": len(self.nodes), "depth": len(self.stack), "post": None, "text": [], "skip": hidden, "attrs": at,
            "code": (up or {}).get("code", False) or tag in ("pre", "code"), "quote": (up or {}).get("quote", False) or tag in ("blockquote", "q"),
            "nav": (up or {}).get("nav", False) or tag == "nav", "region": tag if tag in REGIONS else (up or {}).get("region", "local"),
            "primary": (up or {}).get("primary", False) or (up or {}).get("tag") in PRIMARY,
        }
        self.nodes.append(node)
        if tag in VOID:
            self._close(node)
        else:
            self.stack.append(node)

    def handle_endtag(self, tag):
        if any(n["tag"] == tag for n in self.stack):
            while True:
                node = self.stack.pop()
                self._close(node)
                if node["tag"] == tag:
                    break

    def _close(self, node):
        node["post"] = self.closed
        self.closed += 1

    def handle_data(self, data):
        # the nearest text owner takes the text: a primary container, else the element itself
        owner = next((n for n in reversed(self.stack) if n["tag"] in PRIMARY), None) or (self.stack[-1] if self.stack else None)
        if owner and not self.stack[-1]["skip"]:
            owner["text"].append(data)

    def rows(self) -> list[dict]:
        while self.stack:
            self._close(self.stack.pop())
        return self.nodes


def page_rows(page_id: int | None, html: str | None) -> list[tuple]:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    out = []
    for n in tree.rows():
        sources = [("text", " ".join("".join(n["text"]).split()))]
        sources += [(k, n["attrs"].get(k)) for k in ("title", "aria-label", *(["alt"] if n["tag"] in ("img", "area") else []))]
        seen: set[str] = set()
        for source, text in sources:
            if source != "text" and (not text or n["skip"] or text in seen):
                continue
            seen.add(text)
            out.append((page_id, n["id"], n["parent"], n["id"], n["post"], n["depth"], n["tag"], None if n["skip"] else text, source, n["code"], n["quote"], n["nav"], n["region"]))
    return out


def _parse(batches):
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    types = [types[c.split()[1]] for c in _COLUMNS.split(", ")]
    for batch in batches:
        for page_id, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows := page_rows(page_id, html):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def elements(pages: DataFrame) -> DataFrame:
    """One row per element and text source; ``own_text`` is null in technical and private subtrees."""
    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(_parse, _COLUMNS)


def candidates(pages: DataFrame) -> DataFrame:
    """Texts worth analysing: with a letter or digit, in a container that owns them."""
    return elements(pages).where(F.col("own_text").rlike(r"[\p{L}\p{N}]"))
