"""A document schema as rules that can be asked of a document one by one."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

_XS = "{http://www.w3.org/2001/XMLSchema}"
# Siblings named in one condition: the XPath engine allows about a hundred operators in an expression.
_AT_ONCE = 40
# Operators that the engine allows in an expression, and what it counts as one (calls, steps, dots and axes too).
_OPERATORS, _COUNTED = 100, re.compile(r"::|[/\[(@=<>|+*.!]|\b(?:and|or|div|mod)\b")


def joint_paths(paths: list[str]) -> list[str]:
    """Few expressions that give the numbers of all conditions that are true, four digits each, in order.

    The engine parses a document anew for every expression, so as many conditions share one as its operators allow.
    """
    out, counts = [], []
    for number, path in enumerate(paths):
        part = f"substring('{number:04d}', 1, 4 * number({path}))"
        n = len(_COUNTED.findall(re.sub(r"'[^']*'|\"[^\"]*\"", "", part)))
        if not out or counts[-1] + n >= _OPERATORS:
            out, counts = [*out, ""], [*counts, 0]
        out[-1], counts[-1] = f"{out[-1]}, {part}", counts[-1] + n
    return [f"concat(''{parts})" if parts.count("substring(") > 1 else parts.removeprefix(", ") for parts in out]


def schema_rules(xsd: str, root: str) -> list[tuple[str, str, str]]:
    """``(element, rule, path)`` of everything below ``root``; the path is true for a document that breaks the rule.

    Rules: ``missing`` and ``repeated`` (how often an element stands in its parent), ``unexpected`` (a child that is not
    declared), ``order``, ``value`` (content that is not of its type or not among the listed values), and
    ``attribute <name>`` (required and missing, or not a listed value).
    """
    schema = ElementTree.fromstring(xsd)
    elements = {e.get("name"): e for e in schema.findall(f"{_XS}element")}
    types = {t.get("name"): t for kind in ("complexType", "simpleType") for t in schema.findall(f"{_XS}{kind}")}
    out: dict[tuple[str, str, str], None] = {}

    def declared(e: ElementTree.Element) -> ElementTree.Element:
        return elements[e.get("ref")] if e.get("ref") else e

    def type_of(e: ElementTree.Element):
        """The element's own or named complex type, its simple type, or the name of a built-in one."""
        for kind in ("complexType", "simpleType"):
            if (own := e.find(f"{_XS}{kind}")) is not None:
                return own
        name = e.get("type", "")
        return types.get(name, name.rpartition(":")[2])

    def values(path: str, kind) -> Iterator[str]:
        """Conditions under which the content of ``path`` is not of a simple type."""
        base = kind
        if not isinstance(kind, str):
            restriction = kind.find(f"{_XS}restriction")
            if restriction is None:
                return
            listed = [v.get("value") for v in restriction.findall(f"{_XS}enumeration")]
            if listed:
                yield " or ".join(f". = '{v}'" for v in listed)
            base = restriction.get("base", "").rpartition(":")[2]
        digits = "translate(normalize-space(.), '0123456789', '') = '' and normalize-space(.) != ''"
        if base in ("unsignedInt", "nonNegativeInteger", "positiveInteger", "unsignedShort", "unsignedLong"):
            yield digits
        elif base in ("int", "integer", "long", "decimal", "double"):
            yield "number(normalize-space(.)) = number(normalize-space(.))"
        elif base == "boolean":
            yield ". = 'true' or . = 'false' or . = '1' or . = '0'"

    def attributes(path: str, name: str, kind: ElementTree.Element) -> None:
        for a in [*kind.findall(f"{_XS}attribute"), *kind.findall(f"{_XS}simpleContent/{_XS}extension/{_XS}attribute")]:
            rule = f"attribute {a.get('name')}"
            if a.get("use") == "required":
                out[name, rule, f"boolean({path}[not(@{a.get('name')})])"] = None
            for fits in values(path, type_of(a)):
                out[name, rule, f"boolean({path}/@{a.get('name')}[not({fits})])"] = None

    def below(path: str, e: ElementTree.Element, seen: tuple[str, ...]) -> None:
        name, kind = e.get("name"), type_of(e)
        if isinstance(kind, str) or kind.tag == f"{_XS}simpleType":
            for fits in values(path, kind):
                out[name, "value", f"boolean({path}[not({fits})])"] = None
            return
        attributes(path, name, kind)
        extension = kind.find(f"{_XS}simpleContent/{_XS}extension")
        if extension is not None:
            for fits in values(path, extension.get("base", "").rpartition(":")[2]):
                out[name, "value", f"boolean({path}[not({fits})])"] = None
            return
        group = next((g for tag in ("sequence", "all", "choice") if (g := kind.find(f"{_XS}{tag}")) is not None), None)
        if group is None:
            return
        once = group.tag != f"{_XS}choice"
        kids = [(k, declared(k)) for k in group.iter(f"{_XS}element") if k in list(group) or not once]
        names = [d.get("name") for _, d in kids]
        known = [" and ".join(f"not(self::{n})" for n in names[a : a + _AT_ONCE]) for a in range(0, len(names), _AT_ONCE)]
        if group.find(f"{_XS}any") is None:
            out[name, "unexpected", f"boolean({path}/*{''.join(f'[{k}]' for k in known)})"] = None
        for i, (k, d) in enumerate(kids):
            kid = d.get("name")
            if once and k.get("minOccurs", "1") != "0":
                out[kid, "missing", f"boolean({path}[not({kid})])"] = None
            if k.get("maxOccurs", "1") == "1" and group.get("maxOccurs", "1") == "1":
                out[kid, "repeated", f"boolean({path}[count({kid}) > 1])"] = None
            if group.tag == f"{_XS}sequence" and group.get("maxOccurs", "1") == "1":
                for a in range(i + 1, len(names), _AT_ONCE):
                    later = " or ".join(f"self::{n}" for n in names[a : a + _AT_ONCE])
                    out[kid, "order", f"boolean({path}/{kid}[preceding-sibling::*[{later}]])"] = None
            if kid not in seen:
                below(f"{path}/{kid}", d, (*seen, kid))

    below(f"/{root}", elements[root], (root,))
    return list(out)
