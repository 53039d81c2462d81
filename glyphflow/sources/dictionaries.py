"""Dictionary files and packed dictionaries as DataFrames (dict, ord, key, value)."""

from __future__ import annotations

import warnings
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chars import SPACE, SPACE_CLASS

ENTRY = "dict string, ord bigint, key string, value string"
_NOT_S = f"[^{SPACE_CLASS}]"
#: What ends a line for a pattern's dot: a value can't hold it.
_LINE_ENDS = "[\\n\\r\\u0085\\u2028\\u2029]"


def trimmed(c: Column | str) -> Column:
    """White space of the fixed class cut from both ends."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(SPACE))


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(dict, content): whole dictionary files, named as the file without ending."""
    names = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return spark.read.text(paths, wholetext=True).select(names.alias("dict"), F.col("value").alias("content"))


def local_files(spark: SparkSession, paths: list[Path]) -> DataFrame:
    """The same for files that only the driver sees, such as a package's own."""
    return spark.createDataFrame([(p.stem, p.read_text("utf-8")) for p in paths], "dict string, content string")


def list_files(spark: SparkSession, folder: str) -> list[str] | None:
    """Names of a folder's text dictionaries in order, or None if it can't be listed; no file is read."""
    try:
        rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("path").collect()
    except Exception as e:  # whatever a file system raises
        warnings.warn(f"{folder} can't be listed: {e}", stacklevel=2)
        return None
    return sorted(r["path"].rsplit("/", 1)[-1].removesuffix(".txt") for r in rows)


def golden_cases(files: DataFrame) -> DataFrame:
    """(id, input, expected) of files (content) with golden cases: JSON whose lists and records may end in a comma."""
    # a string is kept as it is, a comma before a closing bracket goes
    strict = F.regexp_replace("content", r'("(?:[^"\\]|\\.)*+")|,(?=\s*[}\]])', "$1")
    cases = F.from_json(strict, "cases array<struct<id:string,input:string,expected:map<string,string>>>")["cases"]
    return files.select(F.explode(cases).alias("c")).select("c.*")


def check_content(files: DataFrame) -> DataFrame:
    """Files whose first character shows that they are a page or a record instead of a dictionary."""
    return files.where(F.substring(trimmed("content"), 1, 1).isin("<", "{", "["))


def _lines(files: DataFrame) -> DataFrame:
    lines = files.select("dict", F.posexplode(F.split("content", r"\r?\n")).alias("ord", "line")).withColumn("line", trimmed("line"))
    return lines.where((F.col("line") != "") & ~F.startswith(F.col("line"), F.lit("#"))).withColumn("ord", F.col("ord").cast("long"))


def _fields(lines: DataFrame) -> DataFrame:
    """key and values (null where a line has neither tab nor white space) and rest, what a second tab leaves of values."""
    tab = F.instr("line", "\t")
    word = F.regexp_extract("line", f"^{_NOT_S}+", 0)
    # lines are trimmed, so that something follows any white space
    rest = F.ltrim(F.substring("line", F.length(word) + 1, F.length("line")), F.lit(SPACE))
    rest = F.when(~rest.rlike(_LINE_ENDS), rest).otherwise("")
    key = F.when(tab > 0, trimmed(F.substring_index("line", "\t", 1))).when(rest != "", word).otherwise("")
    values = F.when(tab > 0, F.expr("substring(line, instr(line, '\t') + 1)")).otherwise(rest)
    return lines.select("dict", "ord", key.alias("key"), values.alias("values"), (tab > 0).alias("tabbed"))


def parse_dict(files: DataFrame) -> DataFrame:
    """Official entries: the first of several candidates is the value; a key may hold spaces if a tab ends it."""
    value = F.regexp_extract(trimmed("values"), f"^({_NOT_S}+)", 1)
    return _fields(_lines(files)).select("dict", "ord", "key", value.alias("value")).where("key != '' and value != ''")


def parse_custom_dict(files: DataFrame) -> DataFrame:
    """Custom entries: the whole value counts, up to a second tab of a line that has tabs."""
    value = trimmed(F.when(F.col("tabbed"), F.substring_index("values", "\t", 1)).otherwise(F.col("values")))
    return _fields(_lines(files)).select("dict", "ord", "key", value.alias("value")).where("key != '' and value != ''")


def parse_dict_map(files: DataFrame) -> DataFrame:
    """Official entries of which the last one of a key stands."""
    return parse_dict(files).groupBy("dict", "key").agg(F.max("ord").alias("ord"), F.max_by("value", "ord").alias("value")).select("dict", "ord", "key", "value")


def candidates(files: DataFrame) -> DataFrame:
    """One row for each of the candidates that single spaces separate, of lines with a tab only; ord keeps their order."""
    rows = _fields(_lines(files)).where("tabbed").select("dict", F.col("ord").alias("line"), "key", F.posexplode(F.split(trimmed(F.substring_index("values", "\t", 1)), " ")).alias("place", "value"))
    return rows.where("key != '' and value != ''").select("dict", (F.col("line") * 1_000_000 + F.col("place")).alias("ord"), "key", "value")


def unpack(packed: DataFrame) -> DataFrame:
    """Entries of packed dictionaries (dict, packed): ``k v|k v``, each split at its first space; an empty side drops one."""
    e = packed.select("dict", F.posexplode(F.split("packed", r"\|")).alias("ord", "e")).where(F.instr("e", " ") > 0)
    return e.select("dict", F.col("ord").cast("long").alias("ord"), F.substring_index("e", " ", 1).alias("key"), F.expr("substring(e, instr(e, ' ') + 1)").alias("value")).where("key != '' and value != ''")


def from_pairs(spark: SparkSession, name: str, pairs: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(name, i, k, v) for i, (k, v) in enumerate(pairs)], ENTRY)


def read_dictionary(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Entries of one dictionary of a Parquet dataset; the other folders aren't read."""
    return spark.read.parquet(path).where(F.col("dict") == name).select("dict", "ord", "key", "value")


def write_dictionaries(entries: DataFrame, path: str) -> None:
    """A Parquet dataset in folders by dictionary, so that a reader of some prunes the rest."""
    entries.repartition("dict").sortWithinPartitions("dict", "ord").write.partitionBy("dict").parquet(path)
