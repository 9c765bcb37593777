"""Pages as rows of a tree: elements and text nodes with interval labels, and what follows from containment.

The parser only labels: a node has its place in document order and the place of the last node inside it, so one node
contains another if its interval does. Ownership of texts (T03, T04, P01, P02), exclusion and context (T01, T02, T07,
P04), regions (P05) and captions (L02) are windows over a page's nodes, in n log n steps however deep a page is:

* a set of elements covers a node if the furthest end among those that began before it reaches it;
* how many elements of a set cover a node is a running sum over their beginnings and ends;
* the nearest of them is the last element of the set that began before the node at the node's own count, as
  intervals are nested or apart.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Kinds of elements.
TECHNICAL = "script style noscript template head meta link base title".split()
CONTROLS = "input textarea select option optgroup".split()
PRIMARY = "p li blockquote figcaption caption td th dt dd h1 h2 h3 h4 h5 h6".split()
INTERACTIVE = "a button summary label".split()
#: Elements that own text if nothing nearer does, for phrases and for splitting.
FALLBACK = "div section article aside main header footer nav form figure details fieldset body".split()
SPLIT_FALLBACK = "div section article aside main header footer".split()
REGIONS = "article aside main section header footer nav li blockquote td th".split()
#: Nodes and characters of a link that are read for its caption.
CAPTION_NODES, CAPTION_CHARACTERS = 64, 2_048
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# End of the fixed values.

#: An element that begins ends an open one of these kinds: no link in a link, no paragraph in a paragraph.
_ENDS = {"a": {"a"}, "p": {"p"}, "li": {"li"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
#: Elements beyond which such an end is not sought.
_SCOPES = frozenset("ul ol dl table select template button".split())
_NODES = [
    ("page_id", pa.int64()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("last_id", pa.int32()), ("tag", pa.string()), ("text", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())),
]
_DDL = "page_id long, node_id int, parent_id int, last_id int, tag string, text string, attributes map<string,string>"
_PAGE = "page_id"


class _Labels(HTMLParser):
    """Nodes in document order: [parent, last node inside, tag (null: text), text, attributes]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.open: list[int] = []
        #: Of each kind of element, how many are open: end tags without a beginning are passed over at once.
        self.counts: dict[str, int] = {}

    def _add(self, tag, text, attributes) -> int:
        self.nodes.append([self.open[-1] if self.open else None, len(self.nodes), tag, text, attributes])
        return len(self.nodes) - 1

    def _close(self) -> str:
        node = self.nodes[self.open.pop()]
        node[1] = len(self.nodes) - 1
        self.counts[node[2]] -= 1
        return node[2]

    def handle_starttag(self, tag, attrs):
        ended = _ENDS.get(tag, ())
        if any(self.counts.get(t) for t in ended):
            depth = next((k for k in range(len(self.open) - 1, -1, -1) if self.nodes[self.open[k]][2] in ended or self.nodes[self.open[k]][2] in _SCOPES - {tag}), -1)
            if depth >= 0 and self.nodes[self.open[depth]][2] in ended:
                while len(self.open) > depth:
                    self._close()
        node = self._add(tag, None, {k: v or "" for k, v in reversed(attrs)})
        if tag not in VOID:
            self.open.append(node)
            self.counts[tag] = self.counts.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        while self.counts.get(tag) and self._close() != tag:
            pass

    def handle_data(self, data):
        self._add(None, data, {})

    def labelled(self, html: str) -> list[list]:
        self.feed(html)
        self.close()
        while self.open:
            self._close()
        return self.nodes


def page_nodes(html: str | None) -> list[list]:
    return _Labels().labelled(html or "")


def _parse(batches):
    for batch in batches:
        out = []
        for page, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for k, (parent, last, tag, text, attributes) in enumerate(page_nodes(html)):
                out.append((page, k, parent, last, tag, text, list(attributes.items())))
            if len(out) >= 10_000:
                yield _node_batch(out)
                out = []
        if out:
            yield _node_batch(out)


def _node_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _NODES, strict=True)], names=[c for c, _ in _NODES])


def nodes(pages: DataFrame) -> DataFrame:
    """One row per element and text node of each page; pages without an id, which rows could not be told apart by, and empty ones have none."""
    rows = pages.where("page_id IS NOT NULL").groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.min(F.col("html").cast("string")).alias("html"))
    return rows.mapInArrow(_parse, _DDL)


def _is(tags: list[str]) -> F.Column:
    return F.coalesce(F.col("tag").isin(tags), F.lit(False))


def _attribute(name: str) -> F.Column:
    return F.try_element_at("attributes", F.lit(name))


def private() -> F.Column:
    """Form controls and editable text, whose contents are never read."""
    editable = _attribute("contenteditable").isNotNull() & (_attribute("contenteditable") != "false")
    return F.coalesce(_is(CONTROLS) | editable | (F.lower(_attribute("role")) == "textbox"), F.lit(False))


def covered(rows: DataFrame, strictly: bool = False, **sets: F.Column) -> DataFrame:
    """``rows`` with a boolean for each named set: whether an element of it is the node or contains it (strictly: contains it)."""
    before = Window.partitionBy(_PAGE).orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1 if strictly else 0)
    furthest = {name: F.max(F.when(test, F.col("last_id"))).over(before) for name, test in sets.items()}
    return rows.withColumns({name: F.coalesce(end >= F.col("node_id"), F.lit(False)) for name, end in furthest.items()})


def nearest(rows: DataFrame, told: F.Column | None = None, **sets: F.Column) -> DataFrame:
    """``rows`` with a column for each named set: the nearest element of it that is the node or contains it, or null.

    The column holds what ``told`` says of that element, its number unless given.
    """
    told = F.col("node_id") if told is None else told
    inside = {f"{name}__in": test.cast("int") for name, test in sets.items()}
    # beginnings and ends come of one pass over the rows; an end takes nothing along but what is counted
    some = F.coalesce(F.greatest(*(F.col(name) for name in inside), F.lit(0)), F.lit(0)) == 1
    events = rows.withColumns(inside).withColumn("__row", F.explode(F.when(some, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    signed = {name: F.when(F.col("__row"), F.col(name)).otherwise(-F.col(name)) for name in inside}
    light = {c: F.when(F.col("__row"), F.col(c)) for c in rows.columns if c not in (_PAGE, "node_id")}
    events = events.withColumns({"__at": F.when(F.col("__row"), F.col("node_id")).otherwise(F.col("last_id") + 0.5), **signed}).withColumns(light)
    so_far = Window.partitionBy(_PAGE).orderBy("__at").rangeBetween(Window.unboundedPreceding, 0)
    events = events.withColumns({f"{name}__n": F.sum(f"{name}__in").over(so_far) for name in sets}).where("__row")
    for name in sets:
        level = Window.partitionBy(_PAGE, f"{name}__n").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
        found = F.last(F.when(F.col(f"{name}__in") == 1, told), ignorenulls=True).over(level)
        events = events.withColumn(name, F.when(F.col(f"{name}__n") > 0, found))
    return events.drop("__at", "__row", *inside, *(f"{name}__n" for name in sets))


def _labelled(pages: DataFrame) -> DataFrame:
    """Nodes dealt by page, with what texts and fragments need of their attributes."""
    named = {"title": _attribute("title"), "aria_label": _attribute("aria-label"), "alt": F.when(_is(["img", "area"]), _attribute("alt")), "private": private()}
    rows = nodes(pages).select(_PAGE, "node_id", "parent_id", "last_id", "tag", "text", *(made.alias(name) for name, made in named.items()))
    rows = covered(rows, excluded=_is(TECHNICAL) | F.col("private"), code=_is(["pre", "code"]), quote=_is(["blockquote", "q"]), in_list=_is(["li"]), navigation=_is(["nav"]))
    return covered(rows, strictly=True, in_primary=_is(PRIMARY))


def _owning(rows: DataFrame, owner: str, *kept: str) -> DataFrame:
    """Elements that are not excluded, with ``kept`` of their columns and ``own_text``: the text nodes that they own, in document order.

    Texts meet their owner under its number, so rows that are dealt by page stay where they are.
    """
    mine = F.when(F.col("tag").isNotNull(), F.col("node_id")).otherwise(F.col(owner))
    met = rows.where("NOT excluded").withColumn("__key", mine).where("__key IS NOT NULL").groupBy(_PAGE, "__key").agg(
        F.first(F.when(F.col("tag").isNotNull(), F.struct("node_id", "tag", *kept)), ignorenulls=True).alias("e"),
        F.array_sort(F.collect_list(F.when(F.col("tag").isNull(), F.struct(F.col("node_id").alias("at"), "text")))).alias("parts"),
    )
    return met.where("e IS NOT NULL").select(_PAGE, "e.*", F.array_join("parts.text", "").alias("own_text"))


def _eligible(text: str | F.Column) -> F.Column:
    """Not blank, with a letter, digit or pictograph."""
    return F.coalesce(F.regexp_like(F.col(text) if isinstance(text, str) else text, F.lit(r"[\p{L}\p{N}\x{2190}-\x{21FF}\x{2600}-\x{27BF}\x{1F000}-\x{1FAFF}]")), F.lit(False))


def phrase_candidates(pages: DataFrame) -> DataFrame:
    """Elements whose own texts and attributes are searched for phrases, with their context.

    ``kind``: primary; interactive outside primary ones; fallback, outside primary ones and with text of its own. Text
    belongs to the nearest primary element, and where there is none to the nearest interactive or fallback one. A row for
    each distinct ``text`` of an element: ``source`` is text, title, aria-label or alt, in this order.
    """
    rows = nearest(_labelled(pages), primary=_is(PRIMARY), other=_is(INTERACTIVE + FALLBACK)).withColumn("owner", F.coalesce("primary", "other"))
    elements = _owning(rows, "owner", "title", "aria_label", "alt", "in_primary", "code", "quote", "in_list", "navigation")
    kind = F.when(_is(PRIMARY), "primary").when(_is(INTERACTIVE) & ~F.col("in_primary"), "interactive").when(_is(FALLBACK) & ~F.col("in_primary") & _eligible("own_text"), "fallback")
    elements = elements.withColumn("kind", kind)
    sources = F.array(
        F.struct(F.lit(0).alias("nr"), F.lit("text").alias("source"), F.when(F.col("kind").isNotNull(), F.col("own_text")).alias("text")), F.struct(F.lit(1).alias("nr"), F.lit("title").alias("source"), F.col("title").alias("text")),
        F.struct(F.lit(2).alias("nr"), F.lit("aria-label").alias("source"), F.col("aria_label").alias("text")), F.struct(F.lit(3).alias("nr"), F.lit("alt").alias("source"), F.col("alt").alias("text")),
    )
    # a text that an earlier source of the element has is no text of its own
    first = F.filter(sources, lambda s: _eligible(s["text"]))
    out = elements.select(_PAGE, "node_id", "tag", "kind", "code", "quote", "in_list", "navigation", F.explode(first).alias("s"))
    out = out.groupBy(_PAGE, "node_id", "tag", "kind", "code", "quote", "in_list", "navigation", F.col("s.text").alias("text")).agg(F.min(F.struct("s.nr", "s.source")).alias("s"))
    return out.select(_PAGE, "node_id", "tag", "kind", "code", "quote", "in_list", "navigation", F.col("s.source").alias("source"), "text")


def split_candidates(pages: DataFrame) -> DataFrame:
    """Elements whose texts and attributes are fragments of possibly split instructions (P01-P05), in the order in which they end.

    ``boundary`` is primary, interactive (outside primary ones), fallback (outside primary ones, with text of its own directly
    inside) or attribute. ``region`` is the nearest element that divides a page, itself included, else its parent, and
    ``region_type`` its kind or local.
    """
    rows = _labelled(pages)
    # a text counts for the element that it is directly in
    siblings = Window.partitionBy(_PAGE, F.when(F.col("tag").isNull(), F.col("parent_id")).otherwise(F.col("node_id")))
    rows = rows.withColumn("direct", F.coalesce(F.max(F.col("tag").isNull() & F.regexp_like("text", F.lit(r"\S"))).over(siblings), F.lit(False)))
    boundary = F.when(_is(PRIMARY), "primary").when(_is(INTERACTIVE) & ~F.col("in_primary"), "interactive").when(_is(SPLIT_FALLBACK) & ~F.col("in_primary") & F.col("direct"), "fallback")
    rows = nearest(rows.withColumn("boundary", boundary), F.struct("node_id", "tag"), owner=F.col("boundary").isNotNull(), divider=_is(REGIONS))
    rows = rows.withColumns({"owner": F.col("owner.node_id"), "divider_tag": F.col("divider.tag"), "divider": F.col("divider.node_id")})
    elements = _owning(rows, "owner", "parent_id", "last_id", "title", "aria_label", "alt", "boundary", "divider", "divider_tag", "code", "quote", "in_list", "navigation")
    sources = [("text", F.when(F.col("boundary").isNotNull(), F.col("own_text"))), ("title", F.col("title")), ("aria-label", F.col("aria_label")), ("alt", F.col("alt"))]
    found = F.filter(F.array(*(F.struct(F.lit(k).alias("nr"), F.lit(name).alias("source"), text.alias("text")) for k, (name, text) in enumerate(sources))), lambda s: F.regexp_like(s["text"], F.lit(r"\S")))
    order = Window.partitionBy(_PAGE).orderBy("last_id", F.col("node_id").desc(), "nr")
    out = elements.select("*", F.explode(found).alias("s")).select("*", "s.nr", "s.source", F.col("s.text").alias("fragment"))
    region_type = F.when(F.col("divider_tag") == "nav", "navigation").otherwise(F.coalesce("divider_tag", F.lit("local")))
    return out.select(
        _PAGE, "node_id", F.row_number().over(order).alias("ord"), F.coalesce("boundary", F.lit("attribute")).alias("boundary"), "source", F.col("fragment").alias("text"),
        F.coalesce("divider", "parent_id", "node_id").alias("region"), region_type.alias("region_type"), "code", "quote", "in_list", "navigation",
    )


def captions(pages: DataFrame) -> DataFrame:
    """Links with the text that a reader sees (L02): of the first 64 nodes inside, private ones left out, at most 2,048 characters.

    ``truncated`` tells whether there was more. A link that is private itself, or without text, has an empty caption.
    """
    link = _is(["a"]) & _attribute("href").isNotNull()
    # what a caption can need of a node, before nodes are sorted
    rows = nodes(pages).select(
        _PAGE, "node_id", "last_id", F.col("tag").isNull().alias("is_text"), F.expr(f"substring(text, 1, {CAPTION_CHARACTERS})").alias("text"), F.length("text").alias("size"),
        F.when(link, _attribute("href")).alias("href"), private().alias("private"),
    )
    rows = nearest(covered(rows, strictly=True, in_private=F.col("private")), link=F.col("href").isNotNull())
    # a private element counts as a node that is looked at, what is inside it does not; the link itself comes first, as number 0
    own = F.col("node_id") == F.col("link")
    inside = rows.where("link IS NOT NULL AND (node_id = link OR NOT in_private)").withColumn("own", own)
    order = Window.partitionBy(_PAGE, "link").orderBy("node_id")
    inside = inside.withColumns({"nth": F.row_number().over(order) - 1, "chars": F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    left = F.lit(CAPTION_CHARACTERS) - F.col("chars")
    shown = F.when((F.col("nth") <= CAPTION_NODES) & F.col("is_text") & (left > 0), F.struct("nth", F.expr(f"substring(text, 1, CAST({CAPTION_CHARACTERS} - chars AS INT))").alias("shown")))
    links = inside.groupBy(_PAGE, F.col("link").alias("node_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["shown"]), "").alias("caption"), F.max((F.col("nth") > CAPTION_NODES) | (F.col("is_text") & (F.col("size") > left))).alias("truncated"),
        *(F.max(F.when(F.col("own"), F.col(c))).alias(c) for c in ("href", "private", "in_private")),
    )
    return links.where("NOT in_private").select(_PAGE, "node_id", "href", F.when(F.col("private"), "").otherwise(F.col("caption")).alias("caption"), "truncated")


def with_depth(elements: DataFrame) -> DataFrame:
    """``elements`` with ``depth``: how many of them contain each, itself included."""
    events = elements.withColumn("__step", F.explode(F.array(F.lit(1), F.lit(-1))))
    events = events.withColumn("__at", F.when(F.col("__step") == 1, F.col("node_id")).otherwise(F.col("last_id") + 0.5))
    so_far = Window.partitionBy(_PAGE).orderBy("__at").rangeBetween(Window.unboundedPreceding, 0)
    return events.withColumn("depth", F.sum("__step").over(so_far)).where("__step = 1").drop("__at", "__step")


def contents(rows: DataFrame, **sets: F.Column) -> DataFrame:
    """``rows`` with the number of nodes of each named set that each node is or contains: what its end has more than what came before it."""
    so_far = Window.partitionBy(_PAGE).orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"{name}__is": test.cast("int") for name, test in sets.items()}).withColumns({f"{name}__n": F.sum(f"{name}__is").over(so_far) for name in sets})
    ends = rows.select(_PAGE, F.col("node_id").alias("last_id"), *(F.col(f"{name}__n").alias(f"{name}__end") for name in sets))
    # as many rows as nodes: narrow columns pack so well that the file sizes would call for a broadcast
    met = rows.join(ends.hint("merge"), [_PAGE, "last_id"])
    return met.withColumns({name: F.col(f"{name}__end") - F.col(f"{name}__n") + F.col(f"{name}__is") for name in sets}).drop(*(f"{name}__{x}" for name in sets for x in ("is", "n", "end")))


def change_roots(rows: DataFrame, most: int = 200) -> DataFrame:
    """Changed nodes (``changed``) as the roots to be searched again (T16): ``page_id, root_id, rescan``.

    A node's root is the nearest element that owns texts, itself included, among itself and seven levels above, else the node
    itself; roots inside others go. A page with more roots than ``most`` is searched as a whole.
    """
    rows = nearest(rows, owner=_is(PRIMARY + INTERACTIVE + FALLBACK))
    depths = with_depth(rows.where("tag IS NOT NULL").select(_PAGE, "node_id", "owner", "changed", "last_id"))
    owners = depths.select(_PAGE, F.col("node_id").alias("owner"), F.col("depth").alias("owner_depth"))
    changed = depths.where("changed").join(owners, [_PAGE, "owner"], "left")
    root = F.when(F.col("depth") - F.col("owner_depth") < 8, F.col("owner")).otherwise(F.col("node_id"))
    roots = changed.select(_PAGE, root.alias("root_id")).distinct()
    labels = rows.select(_PAGE, F.col("node_id").alias("root_id"), "node_id", "last_id")
    kept = covered(roots.join(labels, [_PAGE, "root_id"]), strictly=True, inside=F.lit(True)).where("NOT inside")
    return kept.select(_PAGE, "root_id", (F.count(F.lit(1)).over(Window.partitionBy(_PAGE)) > most).alias("rescan"))


def retracted(findings: DataFrame, removed: DataFrame) -> DataFrame:
    """``findings`` (``page_id, node_id``) outside all ``removed`` subtrees (``page_id, node_id, last_id``): those inside are gone."""
    mine = findings.withColumns({"last_id": F.col("node_id"), "__gone": F.lit(False)})
    theirs = removed.select(_PAGE, "node_id", "last_id", F.lit(True).alias("__gone"))
    both = mine.unionByName(theirs, allowMissingColumns=True)
    # a removed element begins before what is inside it, and before a finding of its own
    before = Window.partitionBy(_PAGE).orderBy("node_id", F.col("__gone").desc()).rowsBetween(Window.unboundedPreceding, 0)
    inside = F.max(F.when(F.col("__gone"), F.col("last_id"))).over(before) >= F.col("node_id")
    return both.withColumn("__inside", F.coalesce(inside, F.lit(False))).where("NOT __gone AND NOT __inside").select(*findings.columns)
