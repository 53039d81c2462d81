"""Leftmost-longest matching: the model in plain Python, and its forms as column expressions.

A matcher is a set of rules key -> value.  As a column expression it is ``translate`` if
keys and values are single characters, and an Arrow UDF over the broadcast rules
otherwise.  A tokenising regular expression with a literal map, which stays in the JVM, is
there up to ``NATIVE_RULES`` rules for those who want it; Spark's map lookups are linear
and its tokens rows of an array.  All agree with ``convert_text``.

In Python, keys are found by one compiled pattern: the keys' trie as nested groups if
they begin with at most ``TRIE_STARTS`` different characters, and else the class of their
first characters, where a table of lengths tells which keys to look up.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The native forms' literal map is searched from one end; larger sets don't take them.
NATIVE_RULES = 100
#: Alternatives are tried one by one, so a trie of many first characters would be slow.
TRIE_STARTS, TRIE_LENGTH = 64, 200

Rules = str | Iterable[tuple[str, str]]


def parse_rules(rules: Rules) -> list[tuple[str, str]]:
    """Pairs of a packed string ``"k v|k v"`` (each split at its first space) or of a sequence; rules with an empty side go."""
    if isinstance(rules, str):
        pairs = (e.partition(" ")[::2] for e in rules.split("|"))
    else:
        pairs = ((r[0], r[1]) for r in rules)
    return [(k, v) for k, v in pairs if k and v]


def _trie_pattern(keys: list[str]) -> str:
    """A pattern with one group that takes the longest of the sorted keys at a place."""

    def node(first: int, last: int, depth: int) -> str:
        """Keys first .. last - 1, which share ``depth`` characters."""
        ends = len(keys[first]) == depth
        first += ends
        branches = []
        while first < last:
            to = first
            while to < last and keys[to][depth] == keys[first][depth]:
                to += 1
            shared = len(commonprefix((keys[first], keys[to - 1])))
            branches.append(re.escape(keys[first][depth:shared]) + node(first, to, shared))
            first = to
        if not branches:
            return ""
        if all(len(b) == 1 for b in branches):
            return f"[{''.join(branches)}]" + "?" * ends
        return f"(?:{'|'.join(branches)})" + "?" * ends

    return f"({node(0, len(keys), 0)})"


class Matcher:
    """Rules, of which the last wins among those with the same key."""

    def __init__(self, *groups: Rules):
        self.rules: dict[str, str] = {}
        for g in groups:
            self.rules.update(parse_rules(g))
        lengths: dict[str, set[int]] = {}
        for k in self.rules:
            lengths.setdefault(k[0], set()).add(len(k))
        self._lengths = {c: sorted(n, reverse=True) for c, n in lengths.items()}

    def __len__(self) -> int:
        return len(self.rules)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_trie", "_starts")}

    def longest(self, text: str, start: int) -> tuple[int, str | None]:
        """(end, value) of the longest key at ``start`` in code points, or (0, None)."""
        if start < len(text):
            for n in self._lengths.get(text[start], ()):
                value = self.rules.get(text[start : start + n]) if start + n <= len(text) else None
                if value is not None:
                    return start + n, value
        return 0, None

    @cached_property
    def _trie(self) -> re.Pattern | None:
        """Finds the leftmost longest key; None if a trie would be slow."""
        if not self.rules or len(self._lengths) > TRIE_STARTS or max(map(len, self.rules)) > TRIE_LENGTH:
            return None
        return re.compile(_trie_pattern(sorted(self.rules)))

    @cached_property
    def _starts(self) -> re.Pattern:
        return re.compile("[" + "".join(map(re.escape, self._lengths)) + "]")

    def _matches(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, value) of each match where there is no trie."""
        if not self.rules:
            return
        search, longest = self._starts.search, self.longest
        m = search(text)
        while m:
            start = m.start()
            end, value = longest(text, start)
            if end:
                yield start, end, value
            m = search(text, end or start + 1)

    def pieces(self, text: str) -> Iterator[tuple[str, str | None]]:
        """The text in pieces: (key, value) of each match, (run, None) of each maximal stretch without one."""
        if self._trie is not None:
            for i, piece in enumerate(self._trie_split(text)):
                if piece:
                    yield piece, self.rules[piece] if i % 2 else None
            return
        at = 0
        for start, end, value in self._matches(text):
            if at < start:
                yield text[at:start], None
            yield text[start:end], value
            at = end
        if at < len(text):
            yield text[at:], None

    def _trie_split(self, text: str) -> list[str]:
        """Runs and matches by turns; the pattern's one group is all of it."""
        return self._trie.split(text)

    def convert_text(self, text: str) -> str:
        if self._trie is not None:
            rules = self.rules
            return self._trie.sub(lambda m: rules[m[0]], text)
        out, at = [], 0
        for start, end, value in self._matches(text):
            out += (text[at:start], value)
            at = end
        return "".join((*out, text[at:])) if at else text

    def segment_text(self, text: str) -> list[str]:
        if self._trie is not None:
            return [s for s in self._trie_split(text) if s]
        return [s for s, _ in self.pieces(text)]

    # as expressions

    @property
    def native(self) -> bool:
        """Whether the column form needs no Python."""
        return self._characters

    @property
    def _characters(self) -> bool:
        return all(len(k) == 1 and len(v) == 1 for k, v in self.rules.items())

    def _alternatives(self) -> str:
        return "|".join(re.sub(r"([^\w\s])", r"\\\1", k, flags=re.ASCII) if k.isascii() else re.escape(k) for k in sorted(self.rules, key=len, reverse=True))

    def _map(self) -> Column:
        return F.create_map(*(F.lit(x) for kv in self.rules.items() for x in kv))

    def convert_native(self, column: Column) -> Column:
        if not self.rules:
            return column
        if self._characters:
            return F.translate(column, "".join(self.rules), "".join(self.rules.values()))
        return self.replace_native(column, lambda run: run)

    def segment_native(self, column: Column) -> Column:
        """Matches and maximal runs without one, as an array."""
        if not self.rules:
            return F.when(column == "", F.expr("cast(array() as array<string>)")).otherwise(F.array(column))
        # a run is passed over up to the next character that may begin a key
        keys, starts = self._alternatives(), "".join(f"\\x{{{ord(c):x}}}" for c in self._lengths)
        return F.regexp_extract_all(column, F.lit(f"(?s)(?:{keys})|(?:[^{starts}]++|(?!(?:{keys})).)++"), F.lit(0))

    def replace_native(self, column: Column, between: Callable[[Column], Column]) -> Column:
        """Values for matches, ``between`` of each maximal run without one."""
        if not self.rules:
            return between(column)
        table = self._map()
        return F.array_join(F.transform(self.segment_native(column), lambda t: F.coalesce(F.element_at(table, t), between(t))), "")


def arrow_expression(spark: SparkSession, build: Callable[[], Callable[[str], object]], returns: str = "string") -> Callable[[Column], Column]:
    """A column function from a text function that ``build``, which is broadcast, makes once in each worker."""
    sent = spark.sparkContext.broadcast(build)

    @F.pandas_udf(returns)
    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = sent.value()
        for part in parts:
            yield pd.Series([None if t is None else f(t) for t in part.tolist()], index=part.index, dtype=object)

    return apply


def longest_match(column: Column, start: Column, matcher: Matcher) -> Column:
    """struct<end, value> of the longest key at ``start``; end 0 and a null value where none is."""
    if not matcher.rules:
        return F.struct(F.lit(0).alias("end"), F.lit(None).cast("string").alias("value"))
    rest = F.substring(column, start + 1, F.length(column))
    key = F.regexp_extract(rest, f"(?s)^({matcher._alternatives()})", 1)
    value = F.element_at(matcher._map(), key)
    out = F.struct(F.when(value.isNull() | (start < 0), 0).otherwise(start + F.length(key)).cast("int").alias("end"), F.when(start >= 0, value).alias("value"))
    return F.when(column.isNotNull() & start.isNotNull(), out)
