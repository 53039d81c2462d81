"""Building dictionaries: merging, reversing, packing, generating, and checks against drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import SPACE_CLASS, strip_pua


class DictionaryError(ValueError):
    """A dictionary that can't be used as it is."""


class MissingDictionary(DictionaryError):
    """A dictionary that isn't there."""


def merge_group(entries: DataFrame, order: list[str]) -> DataFrame:
    """(key, value): the dictionaries of one step as one, in which later ones, and later entries of each, win."""
    place = F.array_position(F.array(*(F.lit(n) for n in order)), F.col("dict"))
    return entries.where(F.col("dict").isin(order)).groupBy("key").agg(F.max_by("value", F.struct(place, F.col("ord"))).alias("value"))


def reverse_dict(entries: DataFrame) -> DataFrame:
    """Values become keys.  The first entry of a value counts, but one that maps to itself outranks it."""
    same = F.max(F.when(F.col("key") == F.col("value"), F.col("key")))
    out = entries.groupBy("dict", "value").agg(F.coalesce(same, F.min_by("key", "ord")).alias("k"), F.min("ord").alias("ord"))
    return out.select("dict", "ord", F.col("value").alias("key"), F.col("k").alias("value"))


def sanitize_rules(entries: DataFrame) -> DataFrame:
    """Private use characters out of both sides; rules that lose a side go."""
    return entries.withColumns({"key": strip_pua(F.col("key")), "value": strip_pua(F.col("value"))}).where("key != '' and value != ''")


def _utf16_length(c: Column) -> Column:
    return F.length(F.encode(c, "UTF-16BE")) / 2


def prune_identity(entries: DataFrame) -> DataFrame:
    """Without entries that map one UTF-16 unit to itself; a character of two units stays."""
    return entries.where(~((F.col("key") == F.col("value")) & (_utf16_length(F.col("key")) == 1)))


def unpackable(entries: DataFrame) -> DataFrame:
    """Entries that the packed form can't hold."""
    return entries.where(F.contains("key", F.lit("|")) | F.contains("value", F.lit("|")) | F.col("key").rlike(f"[{SPACE_CLASS}]"))


def pack(entries: DataFrame) -> DataFrame:
    """(dict, packed): one string for each dictionary, in order, identity entries pruned; refuses what it can't hold."""
    bad = unpackable(entries).limit(5).collect()
    if bad:
        raise DictionaryError(f"entries break the packed form: {[(r['key'], r['value']) for r in bad]}")
    rows = prune_identity(entries).groupBy("dict").agg(F.array_sort(F.collect_list(F.struct("ord", "key", "value"))).alias("e"))
    return rows.select("dict", F.array_join(F.transform("e", lambda e: F.concat_ws(" ", e["key"], e["value"])), "|").alias("packed"))


def generate_regional(phrases: DataFrame, simplify) -> DataFrame:
    """Entries that lead from a simplified phrase to a regional one: keys of the given dictionaries through ``simplify``,
    three characters or more, in key order.  Two regional forms of one simplified phrase are an error."""
    made = phrases.select(simplify(F.col("key")).alias("key"), F.col("key").alias("value")).where(F.length("key") >= 3)
    by = made.groupBy("key").agg(F.min("value").alias("value"), F.max("value").alias("other"))
    bad = by.where("value != other").limit(20).collect()
    if bad:
        raise DictionaryError(f"conflicting projections: {[(r['key'], r['value'], r['other']) for r in bad]}")
    return by.select("key", "value")


def check_drift(known: DataFrame, found: DataFrame) -> DataFrame:
    """(change, name): names that came and went between two one-column tables (name)."""
    added = found.select("name").distinct().join(known, "name", "left_anti").select(F.lit("added").alias("change"), "name")
    removed = known.select("name").distinct().join(found, "name", "left_anti").select(F.lit("removed").alias("change"), "name")
    return added.unionByName(removed)


def empty_dictionaries(entries: DataFrame, names: DataFrame) -> DataFrame:
    """Names (name) of dictionaries without any entry."""
    return names.join(entries.select(F.col("dict").alias("name")).distinct(), "name", "left_anti")


def manifest(files: DataFrame) -> DataFrame:
    """(name, sha256) of whole files (dict, content), in order of name."""
    return files.select(F.col("dict").alias("name"), F.concat(F.lit("sha256:"), F.sha2(F.col("content").cast("binary"), 256)).alias("sha256")).orderBy("name")


def _files(node: object) -> list[str]:
    """Dictionary names in a configuration's tree, in order."""
    if isinstance(node, dict):
        own = [node["file"].rsplit(".", 1)[0]] if isinstance(node.get("file"), str) else []
        return own + [x for k in ("dicts", "dict") if k in node for x in _files(node[k])]
    if isinstance(node, list):
        return [x for n in node for x in _files(n)]
    return []


def chain_differences(configs: dict[str, dict], expected: dict[str, tuple[int, list[str]]], unavailable: tuple[str, ...] = ()) -> list[tuple[str, list[str], list[str]]]:
    """(configuration, its dictionaries, ours) where a step's dictionaries, first priority first, aren't ours turned around; a missing configuration or step has none."""
    out = []
    for name, (step, ours) in expected.items():
        steps = configs.get(name, {}).get("conversion_chain", [])
        theirs = [f for f in _files(steps[step] if step < len(steps) else []) if f not in unavailable]
        if theirs != ours[::-1]:
            out.append((name, theirs, ours[::-1]))
    return out


def segmentation_differences(configs: dict[str, dict], expected: dict[str, list[str]], unsegmented: list[str]) -> list[str]:
    """Configurations that cut on other dictionaries than expected, or cut though they shouldn't; a missing one cuts on none."""
    cut = lambda n: _files(configs.get(n, {}).get("segmentation", {}))
    return [n for n, ours in expected.items() if sorted(cut(n)) != sorted(ours)] + [n for n in unsegmented if cut(n)]
