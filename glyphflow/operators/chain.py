"""Converters: chains of matchers, cut by segmentation, under layers of protected terms.

A converter is a callable from column to column; ``text`` is the same for one string.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession

from ..functions.chars import PUA_FIRST, PUA_LAST, fold_compat, fold_compat_text, strip_pua_text
from ..functions.matcher import Matcher, Rules, arrow_expression, parse_rules
from pyspark.sql import functions as F


_PUA = re.compile(f"[{chr(PUA_FIRST)}-{chr(PUA_LAST)}]")


class SlotError(ValueError):
    """More different protected values in one text than there are places for them."""


class Converter:
    """A text conversion as a column expression; null stays null."""

    native = True

    def text(self, text: str) -> str:
        raise NotImplementedError

    def expression(self, column: Column) -> Column:
        """The native form."""
        raise NotImplementedError

    def __call__(self, column: Column | str) -> Column:
        column = F.col(column) if isinstance(column, str) else column
        if self.native:
            return self.expression(column)
        return arrow_expression(SparkSession.active(), _Bound(self))(column)


class _Bound:
    """Gives a converter's text function where the broadcast arrives."""

    def __init__(self, converter: Converter):
        self.converter = converter

    def __call__(self) -> Callable[[str], str]:
        return self.converter.text


class Chain(Converter):
    """Folds compatibility ideographs, cuts on the segmentation rules if there are any, and runs each step inside each segment."""

    def __init__(self, steps: list[Matcher], segmentation: Matcher | None = None):
        self.steps, self.segmentation = steps, segmentation if segmentation is not None and len(segmentation) else None
        self.native = all(s.native for s in steps) and (self.segmentation is None or self.segmentation.native)

    def text(self, text: str) -> str:
        text = fold_compat_text(text)
        parts = [text] if self.segmentation is None else self.segmentation.segment_text(text)
        for step in self.steps:
            parts = [step.convert_text(p) for p in parts]
        return "".join(parts)

    def expression(self, column: Column) -> Column:
        def run(part: Column) -> Column:
            for step in self.steps:
                part = step.convert_native(part)
            return part

        folded = fold_compat(column)
        if self.segmentation is None:
            return run(folded)
        return F.array_join(F.transform(self.segmentation.segment_native(folded), run), "")


class Protected(Converter):
    """Protected terms take their value before ``inner`` sees the text, and ``inner`` converts what lies between them.

    Private use characters are taken out of the rules; those of the input stay.
    ``strict_slots`` refuses a text that hits more different values than there are
    private use characters it doesn't itself hold; nothing here needs that limit.
    """

    def __init__(self, rules: Rules, inner: Converter, strict_slots: bool = True):
        cleaned = [(strip_pua_text(k), strip_pua_text(v)) for k, v in parse_rules(rules)]
        self.matcher, self.inner, self.strict_slots = Matcher(cleaned), inner, strict_slots
        self.native = self.matcher.native and inner.native and not strict_slots

    def text(self, text: str) -> str:
        pieces = list(self.matcher.pieces(text))
        if self.strict_slots and len(self.matcher) and len(pieces) > 1:
            taken = () if text.isascii() else set(_PUA.findall(text))
            if len({v for _, v in pieces if v is not None}) > PUA_LAST - PUA_FIRST + 1 - len(taken):
                raise SlotError("too many different protected terms in one text")
        return "".join(self.inner.text(s) if v is None else v for s, v in pieces)

    def expression(self, column: Column) -> Column:
        return self.matcher.replace_native(column, self.inner.expression)


class Function(Converter):
    """Any function from string to string as a converter."""

    native = False

    def __init__(self, f: Callable[[str], str]):
        self.f = f

    def text(self, text: str) -> str:
        return self.f(text)


def chain(*groups: list[Rules], segmentation: list[Rules] | None = None) -> Chain:
    """A converter of one step for each group of dictionaries; in a group the last rule for a key wins."""
    return Chain([Matcher(*g) for g in groups], Matcher(*segmentation) if segmentation else None)


def custom_converter(rules: Rules) -> Chain:
    return chain([rules])


def protected(rules: Rules, inner: Converter | Callable[[str], str], strict_slots: bool = True) -> Protected:
    return Protected(rules, inner if isinstance(inner, Converter) else Function(inner), strict_slots)


def segment(column: Column, rules: Matcher) -> Column:
    """The segments of a text, whose join is the text."""
    if rules.native:
        return rules.segment_native(column)
    return arrow_expression(SparkSession.active(), _Segments(rules), "array<string>")(column)


class _Segments:
    def __init__(self, rules: Matcher):
        self.rules = rules

    def __call__(self) -> Callable[[str], list[str]]:
        return self.rules.segment_text
