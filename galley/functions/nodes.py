"""HTML text to a flat list of element nodes.

Spark has no HTML reader. One small Arrow helper on the standard library's tokenizer lists the elements of a page in
document order, and the pieces of its text once. An element is an interval of both: the elements inside it are those from
``ord + 1`` to ``close``, its text the pieces from ``from`` up to ``to``. Every rule over pages is then a Spark expression that
makes the text of the few elements it asks about.
"""

from __future__ import annotations

import gc
import re
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, norm_space, nz

NODE = "ord:int,close:int,parent:int,tag:string,attrs:map<string,string>,from:int,to:int"
PAGE = f"struct<nodes:array<struct<{NODE}>>,texts:array<string>>"
# Elements without an end tag.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# The page as a whole is not a candidate of any rule, so its text is not repeated.
_NO_TEXT = {"html", "body", "head"}
_PROGRAM = {"script", "style", "template"}


class _Lister(HTMLParser):
    """Elements in order; an end tag closes everything opened since its start, a stray one is ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.open, self.texts = [], [], []
        # Names of the open elements, and how many of them hold program text.
        self.names, self.programs = [], 0

    def _add(self, tag, attrs):
        parent = self.open[-1]["ord"] if self.open else -1
        node = {"ord": len(self.nodes), "close": len(self.nodes), "parent": parent, "tag": tag,
                "attrs": {k: (v or "") for k, v in reversed(attrs)}, "from": len(self.texts)}
        self.nodes.append(node)
        return node

    def handle_starttag(self, tag, attrs):
        node = self._add(tag, attrs)
        if tag in _VOID:
            node["to"] = len(self.texts)
        else:
            self.open.append(node)
            self.names.append(tag)
            self.programs += tag in _PROGRAM

    def handle_startendtag(self, tag, attrs):
        self._add(tag, attrs)["to"] = len(self.texts)

    def handle_endtag(self, tag):
        if tag in self.names:
            while self._shut()["tag"] != tag:
                pass

    def handle_data(self, data):
        # Program text is no text of the elements around it either.
        piece = "" if self.programs else " ".join(data.split())
        if piece:
            self.texts.append(piece)

    def _shut(self):
        node = self.open.pop()
        self.programs -= self.names.pop() in _PROGRAM
        node["close"], node["to"] = len(self.nodes) - 1, len(self.texts)
        return node

    def finish(self):
        self.close()
        while self.open:
            self._shut()
        for n in self.nodes:
            if n["tag"] in _NO_TEXT:
                n["to"] = n["from"]
        return self


# A tag as most pages write it, and the text up to the next one; whatever else a page holds is the standard tokenizer's work.
_TAG = re.compile(r'<(/?)([a-z][a-z0-9]*)((?: [a-z][a-z0-9:_-]*="[^"]*")*)>([^<]*)')
_SILENT = re.compile(r"<!(?:(?i:doctype) html|--(?:(?!--).)*--)>([^<]*)", re.S)
_ATTR = re.compile(r' ([a-z][a-z0-9:_-]*)="([^"]*)"')
_PROGRAM_END = {tag: re.compile(rf"</\s*{tag}\s*>", re.I) for tag in HTMLParser.CDATA_CONTENT_ELEMENTS}


def _value(text: str) -> str:
    return unescape(text) if "&" in text else text


def _list_plain(page: str) -> _Lister | None:
    """The elements of a page that holds nothing but usual tags and text; null for any other, to be read as a whole again."""
    lister, tag_at = _Lister(), _TAG.match
    at = page.find("<")
    if at < 0:
        return None
    if at:
        lister.handle_data(_value(page[:at]))
    while at < len(page):
        m = tag_at(page, at)
        if m is None:
            m = _SILENT.match(page, at)
            if m is None:
                return None
            at = m.end()
            if m.group(1):
                lister.handle_data(_value(m.group(1)))
            continue
        end, tag, attrs, text = m.groups()
        at = m.end()
        if end:
            if attrs:
                return None
            lister.handle_endtag(tag)
        else:
            lister.handle_starttag(tag, [(k, _value(v)) for k, v in _ATTR.findall(attrs)] if attrs else [])
            if tag in _PROGRAM_END:
                close = _PROGRAM_END[tag].search(page, m.start(4))
                if close is None:
                    return None
                lister.handle_endtag(tag)
                at = page.find("<", close.end())
                at = len(page) if at < 0 else at
                text = page[close.end():at]
        if text:
            lister.handle_data(_value(text))
    return lister.finish()


def _list_page(page: str) -> _Lister:
    plain = _list_plain(page)
    if plain is not None:
        return plain
    lister = _Lister()
    lister.feed(page)
    return lister.finish()


def _listed(pages: list[_Lister]) -> pa.StructArray:
    """The elements and text pieces of many pages as one Arrow column."""
    nodes = [n for p in pages for n in p.nodes]

    def offsets(sizes) -> pa.Array:
        out = [0]
        for size in sizes:
            out.append(out[-1] + size)
        return pa.array(out, pa.int32())

    numbers = {k: pa.array([n[k] for n in nodes], pa.int32()) for k in ("ord", "close", "parent", "from", "to")}
    attrs = pa.MapArray.from_arrays(
        offsets(len(n["attrs"]) for n in nodes), pa.array([k for n in nodes for k in n["attrs"]], pa.string()),
        pa.array([v for n in nodes for v in n["attrs"].values()], pa.string()),
    )
    fields = {"ord": numbers["ord"], "close": numbers["close"], "parent": numbers["parent"], "tag": pa.array([n["tag"] for n in nodes], pa.string()),
              "attrs": attrs, "from": numbers["from"], "to": numbers["to"]}
    rows = pa.StructArray.from_arrays(list(fields.values()), list(fields))
    lists = pa.ListArray.from_arrays(offsets(len(p.nodes) for p in pages), rows)
    texts = pa.ListArray.from_arrays(offsets(len(p.texts) for p in pages), pa.array([t for p in pages for t in p.texts], pa.string()))
    return pa.StructArray.from_arrays([lists, texts], ["nodes", "texts"])


def _list_pages(html: pa.Array) -> pa.Array:
    # Elements hold no cycles, so looking for some among all of a batch again and again is in vain.
    collects = gc.isenabled()
    gc.disable()
    try:
        return _listed([_list_page(page or "") for page in html.to_pylist()])
    finally:
        if collects:
            gc.enable()


def with_nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``nodes``, the elements of every page, and ``texts``, the pieces of its text."""
    # Not because results vary: it keeps filters on the result above the helper, so a page is read once and not once more
    # for the filter below.
    listed = F.arrow_udf(_list_pages, PAGE).asNondeterministic()(F.col(html).cast("string"))
    return pages.withColumn("__page", listed).withColumns({"nodes": F.col("__page.nodes"), "texts": F.col("__page.texts")}).drop("__page")


def text_of(node: Column) -> Column:
    """Text of an element and all inside it; null for no element."""
    return F.array_join(F.slice(F.col("texts"), node["from"] + 1, node["to"] - node["from"]), " ")


def first_text(items: Column) -> Column:
    """Text of the first element of a list, which is asked for once; null for none."""
    return F.get(F.transform(F.slice(items, 1, 1), text_of), F.lit(0))


def has_text(node: Column) -> Column:
    return node["to"] > node["from"]


def attr(node: Column, name: str) -> Column:
    return nz(F.try_element_at(node["attrs"], F.lit(name)))


def has_class(node: Column, name: str) -> Column:
    # Most elements have none: the list of classes is made where the name is found at all.
    return attr(node, "class").contains(name) & F.array_contains(F.split(attr(node, "class"), " "), name)


def within(nodes: Column, outer: Column) -> Column:
    """Elements inside another one: a slice, since nodes are listed in document order."""
    return F.slice(nodes, outer["ord"] + 2, outer["close"] - outer["ord"])


def children(nodes: Column, outer: Column, test) -> Column:
    return F.filter(within(nodes, outer), test)


def first(items: Column) -> Column:
    return F.get(items, F.lit(0))


# Elements that act as headings.
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6", "strong", "b", "dt"]


def is_heading(n: Column) -> Column:
    return n["tag"].isin(HEADINGS)


def with_headings(pages: DataFrame) -> DataFrame:
    """Adds ``heads``: the headings of a page with their lower-cased text, found in one pass for all rules."""
    heads = F.transform(
        F.filter("nodes", is_heading),
        lambda n: F.struct(n["ord"].alias("ord"), n["parent"].alias("parent"), n["tag"].alias("tag"), F.lower(text_of(n)).alias("t")),
    )
    return pages.withColumn("heads", heads)


def _after(head: Column) -> Column:
    """Siblings behind a heading: a filter over what is left of its parent only."""
    nodes = F.col("nodes")
    end = F.when(head["parent"] < 0, F.size(nodes) - 1).otherwise(F.get(nodes, head["parent"])["close"])
    return F.filter(F.slice(nodes, head["ord"] + 2, end - head["ord"]), lambda n: n["parent"] == head["parent"])


def section_text(headings: list[str], sep: str = " ") -> Column:
    """Text after the first heading that contains a wanted phrase and is followed by any, up to the next heading.

    Siblings count. Another wanted heading is skipped; a foreign heading ends the section once there is text. Needs
    ``nodes``, ``texts`` and ``heads``.
    """
    wanted = [h.lower() for h in headings]

    def hit(t: Column) -> Column:
        # The colons go only where a phrase is found with them; a phrase that ends in one is rare enough to be looked for twice.
        def any_of(c: Column) -> Column:
            out = F.lit(False)
            for w in wanted:
                out = out | c.contains(w)
            return out

        return any_of(t) & let(F.regexp_replace(t, r":+\z", ""), any_of)

    def text_after(head: Column) -> Column:
        siblings = F.filter(_after(head), has_text)
        start = F.struct(F.lit(False).alias("done"), F.array().cast("array<string>").alias("parts"))

        def step(acc: Column, n: Column) -> Column:
            def told(own: Column) -> Column:
                stop = acc["done"] | (is_heading(n) & ~own & (F.size(acc["parts"]) > 0))
                parts = F.when(stop | own, acc["parts"]).otherwise(F.concat(acc["parts"], F.array(text_of(n))))
                return F.struct(stop.alias("done"), parts.alias("parts"))

            return let(is_heading(n) & hit(F.lower(text_of(n))), told)

        return F.aggregate(siblings, start, step, lambda acc: F.array_join(acc["parts"], sep))

    found = F.filter(F.transform(F.filter("heads", lambda h: hit(h["t"])), text_after), lambda t: t != "")
    return nz(first(found))


def heading_block(headings: list[str], items: bool = False) -> Column:
    """Text after the first matching heading, phrase by phrase in order of preference; list items line by line.

    Only real headings ``h1`` to ``h6`` end the block. Needs ``nodes``, ``texts`` and ``heads``.
    """
    real = [f"h{i}" for i in range(1, 7)]
    kinds = HEADINGS if not items else HEADINGS[:-1]

    def for_phrase(phrase: str) -> Column:
        head = first(F.filter("heads", lambda h: h["tag"].isin(kinds) & h["t"].contains(phrase.lower())))

        def body(h: Column) -> Column:
            def among(siblings: Column) -> Column:
                end = F.coalesce(first(F.filter(siblings, lambda n: n["tag"].isin(real)))["ord"], F.lit(1 << 30))
                block = F.filter(siblings, lambda n: (n["ord"] < end) & has_text(n))
                plain = F.array_join(F.transform(block, text_of), "\n" if items else " ")
                if not items:
                    return plain
                nxt = first(siblings)
                listed = F.transform(children(F.col("nodes"), nxt, lambda n: n["tag"] == "li"), text_of)
                return F.when(nxt["tag"].isin("ol", "ul"), F.array_join(listed, "\n")).otherwise(plain)

            return let(_after(h), among)

        # The text is bound: ``nullif`` would make it once to look and once to give.
        return let(let(head, body), lambda t: F.when(t != "", t))

    return F.coalesce(*[for_phrase(p) for p in headings], F.lit(""))


def meta_pairs(nodes: Column) -> Column:
    """``struct(name, value)`` of the meta elements in document order, blank values dropped: told once for all lookups."""

    def pair(n: Column) -> Column:
        names = [F.nullif(attr(n, a), F.lit("")) for a in ("name", "property", "itemprop", "http-equiv")]
        return F.struct(F.lower(norm_space(F.coalesce(*names))).alias("name"), norm_space(attr(n, "content")).alias("value"))

    return F.filter(F.transform(F.filter(nodes, lambda n: n["tag"] == "meta"), pair), lambda p: p["value"] != "")


def meta_values(pairs: Column, *names: str) -> Column:
    """Values of the given names in document order."""
    wanted = [n.lower() for n in names]
    return F.transform(F.filter(pairs, lambda p: p["name"].isin(wanted)), lambda p: p["value"])


def meta_first(pairs: Column, *names: str) -> Column:
    """First value, names in any order of the page."""
    return nz(first(meta_values(pairs, *names)))
