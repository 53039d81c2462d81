"""Comparing dictionaries, scoring conversions, and leaving entries out to see whether they matter."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chars import bare_characters
from .chain import Converter

# The directions in which custom phrases take effect, and the sentences that carry a key or a value.
DIRECTIONS = (("cn", "tw"), ("cn", "twp"), ("cn", "hk"), ("cn", "hkp"), ("t", "twp"), ("hk", "twp"), ("jp", "twp"), ("tw", "cn"), ("twp", "cn"), ("hk", "cn"))
KEY_CARRIER, VALUE_CARRIER = ("他说这个", "很不错"), ("他說這個", "很不錯")


def new_entries(custom: DataFrame, upstream: DataFrame) -> DataFrame:
    """Custom entries (key, value) whose key isn't upstream."""
    return custom.join(upstream.select("key").distinct(), "key", "left_anti").select("key", "value")


def conflicts(custom: DataFrame, upstream: DataFrame) -> DataFrame:
    """(key, value, upstream_value): keys of both with different values."""
    other = upstream.select("key", F.col("value").alias("upstream_value"))
    return custom.join(other, "key").where("value != upstream_value").select("key", "value", "upstream_value")


def diff_summary(custom: DataFrame, upstream: DataFrame) -> DataFrame:
    """(status, n): how many custom entries are new, in conflict, in sync."""
    other = upstream.select("key", F.col("value").alias("upstream_value"))
    status = F.when(F.col("upstream_value").isNull(), "new").when(F.col("value") != F.col("upstream_value"), "conflict").otherwise("in sync")
    return custom.join(other, "key", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def ablation_corpus(entries: DataFrame) -> DataFrame:
    """(text): each key and value, alone and in its carrier sentence, once."""
    wrap = lambda c, s: F.concat(F.lit(s[0]), c, F.lit(s[1]))
    k, v = F.col("key"), F.col("value")
    return entries.select(F.explode(F.array(k, v, wrap(k, KEY_CARRIER), wrap(v, VALUE_CARRIER))).alias("text")).distinct()


def ablate(spark: SparkSession, pairs: list[tuple[str, str]], build: Callable[[str, str, list[tuple[str, str]]], Converter], directions=DIRECTIONS) -> DataFrame:
    """(key, value, first_diff): for each entry the first direction and text whose output changes without it; null if none does.

    ``build(source, target, pairs)`` gives a converter.  The entries are a custom list
    of the caller's: it bounds the converters (one for each entry and direction) and the
    texts (four for each entry), which are planned on the driver and broadcast;
    comparisons are rows, a block of directions for each entry left out.
    """
    entries = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(pairs)], "entry int, key string, value string")
    corpus = [r["text"] for r in ablation_corpus(entries).orderBy("text").collect()]
    jobs = [(e, d) for e in range(len(pairs)) for d in range(len(directions))]
    rows = spark.createDataFrame(jobs, "entry int, direction int").repartition(max(1, min(len(jobs), 64)), "entry", "direction")
    base = [build(s, t, pairs) for s, t in directions]
    sent = spark.sparkContext.broadcast((pairs, corpus, base, [[build(s, t, pairs[:e] + pairs[e + 1 :]) for s, t in directions] for e in range(len(pairs))]))

    def compare(batches):
        import pandas as pd

        _, texts, whole, without = sent.value
        for pdf in batches:
            out = []
            for e, d in zip(pdf["entry"], pdf["direction"]):
                changed = next(((i, x, a, b) for i, x in enumerate(texts) if (a := whole[d].text(x)) != (b := without[e][d].text(x))), None)
                if changed:
                    s, t = directions[d]
                    out.append((e, d, f"{s}->{t} {changed[1]}: {changed[2]} -> {changed[3]}"))
            yield pd.DataFrame(out, columns=["entry", "direction", "diff"])

    found = rows.mapInPandas(compare, "entry int, direction int, diff string").groupBy("entry").agg(F.min_by("diff", "direction").alias("first_diff"))
    return entries.join(found, "entry", "left").select("key", "value", "first_diff")


def relate_upstream(custom: DataFrame, upstream: DataFrame, official: Callable[[Column], Column]) -> DataFrame:
    """(key, value, relation): override of an upstream key, equivalent to what the official chain gives, or addition."""
    keys = upstream.select("key", F.lit(True).alias("known")).distinct()
    relation = F.when(F.col("known"), "override").when(official(F.col("key")) == F.col("value"), "equivalent").otherwise("addition")
    return custom.join(keys, "key", "left").select("key", "value", relation.alias("relation"))


def parity_report(cases: DataFrame, converters: dict[str, Callable[[Column], Column]], known: list[tuple[str, str]] = ()) -> DataFrame:
    """(config, n, mismatches, healed) of cases (id, input, expected map): what differs and isn't known to, and what is known to but no longer differs."""
    spark = cases.sparkSession
    # each configuration's rows meet its own converter only
    cases = cases.select("id", "input", "expected")
    parts = [cases.where(F.map_contains_key("expected", name)).select(F.lit(name).alias("config"), "id", convert(F.col("input")).eqNullSafe(F.element_at("expected", F.lit(name))).alias("same")) for name, convert in converters.items()]
    rows = functools.reduce(DataFrame.unionByName, parts)
    listed = spark.createDataFrame(list(known) or [("", "")], "config string, id string").withColumn("listed", F.lit(True))
    rows = rows.join(listed, ["config", "id"], "left")
    is_known = F.coalesce(F.col("listed"), F.lit(False))
    return rows.groupBy("config").agg(F.count("*").alias("n"), F.count_if(~F.col("same") & ~is_known).alias("mismatches"), F.count_if(F.col("same") & is_known).alias("healed"))


def find_bare_characters(lines: DataFrame, column: str = "line") -> DataFrame:
    """Lines with characters that should only be there escaped."""
    return lines.where(bare_characters(F.col(column)))
