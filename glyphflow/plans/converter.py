"""Converters between regional standards.

``create_converter`` plans a conversion on the driver: which dictionaries, which
segmentation, which protected layers; the result is a function from column to column.
Dictionaries are read once for each store and direction.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.matcher import Matcher, Rules, parse_rules
from ..operators.chain import Chain, Converter, Protected, chain
from ..operators.dict_etl import DictionaryError, MissingDictionary, generate_regional, prune_identity, reverse_dict
from ..sources import dictionaries
from . import presets

DATA = Path(__file__).resolve().parent.parent / "data"
#: Stands for the sample dictionaries that come with the package; give a folder of whole ones for real use.
SAMPLE_DICTIONARIES = "package:mini"
PROTECTED_TERMS = DATA / "custom" / "protected.txt"


class DictionaryStore:
    """Dictionaries of a folder of text files, or of a Parquet dataset (a path that ends in ``.parquet``), and those derived from them, as ordered pairs on the driver.

    A dictionary is bounded by its file; the largest known has some 50,000 entries.  The
    package's own files are read by the driver, others by Spark, so that their folder may
    be wherever the cluster reads.  What was read is kept until ``refresh``; what failed isn't.
    """

    def __init__(self, spark: SparkSession, folder: str = SAMPLE_DICTIONARIES):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.refresh()

    def refresh(self) -> None:
        """Forget what was read: the files may have changed."""
        self._pairs: dict[str, list[tuple[str, str]]] = {}
        self.converters: dict[tuple, Converter] = {}

    def _files(self, name: str) -> DataFrame:
        """The checked file of a dictionary."""
        if name == presets.CUSTOM or self.folder == SAMPLE_DICTIONARIES:
            path = DATA / ("custom" if name == presets.CUSTOM else "mini") / f"{name}.txt"
            if not path.exists():
                raise MissingDictionary(f"dictionary {name} isn't among the package's files")
            files = dictionaries.local_files(self.spark, [path])
        else:
            files = dictionaries.read_files(self.spark, f"{self.folder}/{name}.txt")
        if not dictionaries.check_content(files).isEmpty():
            raise DictionaryError(f"{name} in {self.folder} is a page or a record, no dictionary")
        return files

    def _rows(self, name: str) -> DataFrame:
        base = presets.REVERSED.get(name)
        if name == presets.GENERATED:
            return self._generated()
        if self.folder.endswith(".parquet") and name != presets.CUSTOM:
            rows = dictionaries.read_dictionary(self.spark, self.folder, name)
            return reverse_dict(dictionaries.read_dictionary(self.spark, self.folder, base)) if base and rows.isEmpty() else rows
        if base:
            return reverse_dict(dictionaries.candidates(self._files(base)))
        return (dictionaries.parse_custom_dict if name == presets.CUSTOM else dictionaries.parse_dict)(self._files(name))

    def pairs(self, name: str) -> list[tuple[str, str]]:
        """Entries in order, without single units that map to themselves; a dictionary that is missing or has no entries is an error."""
        if name not in self._pairs:
            try:
                rows = self._rows(name)
                found = [(r["key"], r["value"]) for r in prune_identity(rows).orderBy("ord").select("key", "value").collect()]
                empty = not found and rows.isEmpty()
            except DictionaryError:
                raise
            except Exception as e:  # whatever a file system raises
                raise MissingDictionary(f"dictionary {name} can't be read from {self.folder}") from e
            if empty:
                raise MissingDictionary(f"dictionary {name} of {self.folder} has no entries")
            self._pairs[name] = found
        return self._pairs[name]

    def known_pairs(self, name: str, bundle: str | None) -> list[tuple[str, str]]:
        """The entries, or with a warning none if the dictionary is missing; in a one-way bundle that is an error."""
        try:
            return self.pairs(name)
        except MissingDictionary as e:
            if bundle:
                raise MissingDictionary(f"Dictionary {name} missing from {bundle} bundle") from e
            warnings.warn(f"{e}; it is left out", stacklevel=4)
            return []

    def _generated(self):
        simple = chain([self.pairs(n) for n in presets.FROM_STANDARD["cn"]])
        phrases = self._rows("HKPhrases").unionByName(self._rows("TWPhrases"))
        return generate_regional(phrases, simple).selectExpr(f"'{presets.GENERATED}' as dict", "key as ord", "key", "value")


_stores: dict[tuple, DictionaryStore] = {}


def store(spark: SparkSession, folder: str = SAMPLE_DICTIONARIES) -> DictionaryStore:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _stores:
        _stores[key] = DictionaryStore(spark, folder)
    return _stores[key]


def reverse_pairs(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The same as ``reverse_dict`` for pairs on the driver."""
    out: dict[str, str] = {}
    for k, v in pairs:
        if v not in out or k == v:
            out[v] = k
    return list(out.items())


def _inner(own: DictionaryStore, source: str, target: str, custom_phrases: bool | None, bundle: str | None = None) -> Converter:
    direction = presets.phrase_direction(source, target, custom_phrases)
    key = (source, target, direction, bundle)
    if key not in own.converters:
        steps = [Matcher(*(own.known_pairs(n, bundle) for n in names)) for names in presets.dictionary_steps(source, target)]
        cut = presets.segmentation_dictionaries(source, target)
        converter: Converter = Chain(steps, Matcher(*(own.known_pairs(n, bundle) for n in cut)) if cut else None)
        if direction:
            phrases = own.pairs(presets.CUSTOM)
            converter = Protected(phrases if direction == "forward" else reverse_pairs(phrases), converter)
        own.converters[key] = converter
    return own.converters[key]


def _auto_protected() -> list[tuple[str, str]]:
    """Rules of the package's file of protected terms, if it has any."""
    try:
        lines = PROTECTED_TERMS.read_text("utf-8").splitlines()
    except OSError:
        return []
    return [(k.strip(), v.strip()) for k, _, v in (x.partition("\t") for x in lines if not x.lstrip().startswith("#")) if k.strip() and v.strip()]


def create_converter(spark: SparkSession, source: str, target: str, protected: Rules | None = None, custom_phrases: bool | None = None, dictionaries_at: str = SAMPLE_DICTIONARIES, bundle: str | None = None, **removed) -> Converter:
    """A converter from one locale to another.

    ``protected`` None loads the package's protected terms, an empty list or string
    none.  ``custom_phrases`` True asks for the custom phrase list in directions that
    know it; None applies it only if an end is twp.  A missing dictionary is left out with
    a warning; for a ``bundle``, named in the message, it is an error.
    """
    if "applyCharFixes" in removed:
        warnings.warn("option applyCharFixes was removed and is ignored", stacklevel=2)
        del removed["applyCharFixes"]
    if removed:
        raise TypeError(f"unknown options: {sorted(removed)}")
    presets.dictionary_steps(source, target)  # for its errors
    inner = _inner(store(spark, dictionaries_at), source, target, custom_phrases, bundle)
    rules = _auto_protected() if protected is None else parse_rules(protected)
    return Protected(rules, inner) if rules else inner


def cn2t(spark: SparkSession, target: str, source: str = "cn", protected: Rules = (), **options) -> Converter:
    """From mainland text only."""
    if source != "cn":
        raise ValueError(f"cn2t bundle only converts from 'cn', got '{source}'")
    if target == "cn":
        raise ValueError("cn2t bundle cannot convert to 'cn'")
    return create_converter(spark, source, target, protected, bundle="cn2t", **options)


def t2cn(spark: SparkSession, source: str, target: str = "cn", protected: Rules = (), **options) -> Converter:
    """To mainland text only."""
    if target != "cn":
        raise ValueError(f"t2cn bundle only converts to 'cn', got '{target}'")
    if source == "cn":
        raise ValueError("t2cn bundle cannot convert from 'cn'")
    return create_converter(spark, source, target, protected, bundle="t2cn", **options)


def full(spark: SparkSession, source: str, target: str, protected: Rules = (), **options) -> Converter:
    """All locales, without the package's protected terms."""
    return create_converter(spark, source, target, protected, **options)


@dataclass(frozen=True)
class LocalePreset:
    """Dictionaries of a caller's own, by locale: to the standard, from it, and for cutting."""

    to_standard: Mapping[str, list[Rules]]
    from_standard: Mapping[str, list[Rules]]
    segmentation: Mapping[tuple[str, str], list[Rules]] = field(default_factory=dict)


def converter_from_preset(preset: LocalePreset, source: str, target: str) -> Converter:
    """A converter of a preset's dictionaries; a locale that it doesn't know has no step."""
    groups = [list(g) for g in (preset.to_standard.get(source), preset.from_standard.get(target)) if g]
    return chain(*groups, segmentation=preset.segmentation.get((source, target)))


def locale_preset(spark: SparkSession, dictionaries_at: str = SAMPLE_DICTIONARIES) -> LocalePreset:
    """The built-in locales as a preset."""
    own = store(spark, dictionaries_at)
    return LocalePreset(*({loc: [own.pairs(n) for n in names] for loc, names in t.items()} for t in (presets.TO_STANDARD, presets.FROM_STANDARD)))
