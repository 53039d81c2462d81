"""Conversion of HTML pages, with a record of what changed.

A page is walked once as tokens with a stack of open elements; only the slots that
convert are rewritten, every other byte stays.  Slots are texts and a few attributes
below elements whose ``lang`` is the wanted one.  Tree repair as browsers do it is no
aim: void elements, raw text elements and the ends that HTML implies are known, the rest
is taken as written.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chain import Converter

SLOTS = "array<struct<node_id:int,slot:string,original:string,converted:string>>"

# The class that exempts a subtree, elements whose content stays, attributes and inputs that convert.
IGNORE_CLASS = "ignore-opencc"
LEFT_ALONE = ("SCRIPT", "STYLE", "TEXTAREA", "CODE", "PRE")
ATTRIBUTES = ("placeholder", "title", "aria-label")
BUTTONS = ("button", "submit", "reset")
META_NAMES = ("description", "keywords")

_VOID = frozenset("AREA BASE BR COL EMBED HR IMG INPUT LINK META PARAM SOURCE TRACK WBR".split())
_RAW = frozenset("SCRIPT STYLE TEXTAREA TITLE".split())
_ENDS_P = frozenset("ADDRESS ARTICLE ASIDE BLOCKQUOTE DETAILS DIV DL FIELDSET FIGURE FOOTER FORM H1 H2 H3 H4 H5 H6 HEADER HR MAIN NAV OL P PRE SECTION TABLE UL".split())
#: An element that another start tag ends, and the elements past which it doesn't.
_IMPLIED = {"LI": (("LI",), ("UL", "OL")), "DT": (("DT", "DD"), ("DL",)), "DD": (("DT", "DD"), ("DL",)), "TR": (("TR",), ("TABLE",)), "TD": (("TD", "TH"), ("TR", "TABLE")), "TH": (("TD", "TH"), ("TR", "TABLE")), "OPTION": (("OPTION",), ("SELECT",))}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

Slot = tuple[int, str]


def _edit(page: str, visit: Callable[[int, str, str | None, bool], str | None], from_lang: str, to_lang: str, relabel: bool) -> str:
    """Rewrites slots: ``visit(node, slot, value, matched)`` gives a new value or None.

    With ``relabel`` the walk follows the lang rules of a conversion; without, every slot
    outside exempt subtrees is offered, as a restoration needs.
    """
    out: list[str] = []
    stack: list[tuple[str, bool, bool]] = [("", False, False)]  # tag, lang matched, left alone
    node = at = 0

    def text(raw: str) -> None:
        nonlocal node
        if not raw:
            return
        node += 1
        _, matched, alone = stack[-1]
        new = None if alone else visit(node, "#text", entities.unescape(raw), matched)
        out.append(raw if new is None else entities.escape(new, quote=False))

    def close(tags: tuple[str, ...], past: tuple[str, ...] = ()) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                del stack[k:]
                return
            if stack[k][0] in past:
                return

    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            out.append(m[0])
            continue
        tag = m[2].upper()
        if m[1]:
            close((tag,))
            out.append(m[0])
            continue
        if tag in _ENDS_P:
            close(("P",), ("TABLE", "TD", "TH", "BUTTON"))
        if tag in _IMPLIED:
            close(*_IMPLIED[tag])
        node += 1
        _, matched, alone = stack[-1]
        attrs = {}
        for a in _ATTR.finditer(m[3]):
            attrs.setdefault(a[1].lower(), (a, entities.unescape(next((g for g in (a[3], a[4], a[5]) if g is not None), ""))))
        value = {k: v for k, (_, v) in attrs.items()}
        alone = alone or IGNORE_CLASS in value.get("class", "").split()
        changes: dict[str, str] = {}

        def offer(name: str, slot: str | None = None, here: int = node, on: bool | None = None) -> None:
            if value.get(name) and (new := visit(here, slot or name, value[name], matched if on is None else on)) is not None:
                changes[name] = new

        if not alone:
            if "lang" in value:
                if relabel:
                    matched = value["lang"].lower() == from_lang.lower()
                    if matched:
                        visit(node, "lang", value["lang"], True)
                        changes["lang"] = to_lang
                elif (new := visit(node, "lang", value["lang"], True)) is not None:
                    changes["lang"] = new
            if tag in LEFT_ALONE:
                alone = True
            else:
                for name in ATTRIBUTES:
                    offer(name)
                if tag == "INPUT" and value.get("type", "").lower() in BUTTONS:
                    offer("value", "#value")
                if tag == "META" and value.get("name") in META_NAMES:
                    offer("content")
                if tag == "IMG":
                    offer("alt")
        raw_attrs = m[3]
        for name, new in sorted(changes.items(), key=lambda c: -attrs[c[0]][0].start()):
            a = attrs[name][0]
            raw_attrs = f'{raw_attrs[: a.start()]}{a[1]}="{entities.escape(new)}"{raw_attrs[a.end() :]}'
        out.append(f"<{m[2]}{raw_attrs}>" if changes else m[0])
        if tag in _VOID:
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            stop = end.start() if end else len(page)
            stack.append((tag, matched, alone))
            text(page[at:stop])
            stack.pop()
            out.append(end[0] if end else "")
            at = end.end() if end else stop
            continue
        stack.append((tag, matched, alone))
    return "".join(out)


def convert_page(page: str, convert: Callable[[str], str], from_lang: str, to_lang: str, slots: list[tuple] = ()) -> tuple[str, list[tuple[int, str, str, str]]]:
    """The converted page and its record; ``slots`` of an earlier conversion give the true originals."""
    known: dict[Slot, tuple[str, str]] = {(s[0], s[1]): (s[2], s[3]) for s in slots}

    def visit(node: int, slot: str, value: str | None, matched: bool) -> str | None:
        if not matched:
            return None
        original = known[node, slot][0] if (node, slot) in known else value
        new = to_lang if slot == "lang" else convert(original)
        known[node, slot] = (original, new)
        return new if new != value else None

    out = _edit(page, visit, from_lang, to_lang, relabel=True)
    return out, [(n, s, a, b) for (n, s), (a, b) in sorted(known.items())]


def restore_page(page: str, slots: list[tuple], from_lang: str) -> str:
    """The page with every recorded slot as it was; a changed ``lang`` becomes ``from_lang``."""
    known = {(s[0], s[1]): s[2] for s in slots}

    def visit(node: int, slot: str, value: str | None, matched: bool) -> str | None:
        if (node, slot) not in known:
            return None
        old = from_lang if slot == "lang" else known[node, slot]
        return old if old != value else None

    return _edit(page, visit, from_lang, from_lang, relabel=False)


def html_convert(df: DataFrame, column: str, converter: Converter, from_lang: str, to_lang: str, slots: str | None = None) -> DataFrame:
    """``df`` with the column converted and ``slots``, what has been recorded of each page so far.

    ``slots`` names the record of an earlier conversion.  A null page stays null.
    """
    sent = SparkSession.active().sparkContext.broadcast(converter)

    @F.pandas_udf(f"html string, slots {SLOTS}")
    def apply(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        convert = sent.value.text
        for pages, records in parts:
            out = []
            for page, own in zip(pages.tolist(), records.tolist()):
                if page is None:
                    out.append((None, None))
                    continue
                record = [] if own is None else [(s["node_id"], s["slot"], s["original"], s["converted"]) for s in own]
                new, found = convert_page(page, convert, from_lang, to_lang, record)
                out.append((new, [dict(zip(("node_id", "slot", "original", "converted"), s)) for s in found]))
            yield pd.DataFrame(out, columns=["html", "slots"])

    record = F.col(slots) if slots else F.lit(None).cast(SLOTS)
    made = df.withColumn("__made", apply(F.col(column), record))
    return made.withColumns({column: F.col("__made.html"), "slots": F.col("__made.slots")}).drop("__made")


def html_restore(df: DataFrame, column: str, from_lang: str, slots: str = "slots") -> DataFrame:
    """``df`` with the column's pages as they were before conversion."""

    @F.pandas_udf("string")
    def apply(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for pages, records in parts:
            yield pd.Series([None if p is None else restore_page(p, [(s["node_id"], s["slot"], s["original"]) for s in (() if r is None else r)], from_lang) for p, r in zip(pages.tolist(), records.tolist())], dtype=object)

    return df.withColumn(column, apply(F.col(column), F.col(slots)))
