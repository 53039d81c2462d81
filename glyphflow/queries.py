"""Queries over the driver's tables that exercise the conversion engine, and their SQL twins.

The tables hold no Chinese text, so most queries put Chinese characters for Latin ones
first (``HAN``), which both engines do with ``translate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.chars import COMPAT, fold_compat, strip_pua
from .functions.matcher import Matcher, longest_match
from .operators import analysis, dict_etl
from .operators.chain import Function, chain, protected, segment
from .operators.html import html_convert, html_restore
from .plans import converter, presets
from .sources import dictionaries
from .streaming.convert import convert_available

LATIN, HAN = "therinous", "地铁默认土豆空调项"
RULES = [("the", "THE"), ("th", "Þ"), ("er", "3r"), ("ing", "ING+"), ("on the", "UPON"), ("of", "OF")]
SECOND = [("THE", "D-"), ("Þ", "th"), ("ING+", "in'"), ("r an", "RAN")]
ASTRAL = [("𠀀𪚥", "one"), ("𪚥😀", "two"), ("😀", "three"), ("𠀀 ", "four")]
SEGMENTS = ["the", "ing", "tion", "on"]
#: More rules than the native forms take.
MANY = [(f"{a}{b}", f"<{b}{a}>") for a in "abcdefghijklmnopqrst" for b in "aeioun"]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _han(c: Column) -> Column:
    return F.translate(c, LATIN, HAN)


def _phrases(spark: SparkSession) -> list[tuple[str, str]]:
    return converter.store(spark).pairs(presets.CUSTOM)


def convert_custom(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", chain([RULES])(F.col("text")).alias("converted"))


def convert_many_rules(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", chain([MANY])(F.col("text")).alias("converted"))


def convert_characters(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "conversations").select("conv_id", "turn", chain([list(zip(LATIN, HAN))])(F.col("text")).alias("converted"))


def convert_two_steps(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", chain([RULES], [SECOND])(F.col("text")).alias("converted"))


def convert_streamed(spark: SparkSession, d: str) -> DataFrame:
    return convert_available(spark, f"{d}/conversations.parquet", "text", chain([RULES])).select("conv_id", "turn", "text")


def preset_steps(spark: SparkSession, d: str) -> DataFrame:
    """The dictionaries of every direction, by step and place."""
    rows = [(s, t, i, j, n) for s in presets.LOCALES for t in presets.LOCALES for i, names in enumerate(presets.dictionary_steps(s, t)) for j, n in enumerate(names)]
    return spark.createDataFrame(rows, "source string, target string, step long, place long, dict string")


def preset_cuts(spark: SparkSession, d: str) -> DataFrame:
    """What every direction cuts on, and how the custom phrases apply by default, if wanted and if not."""
    ways = [(None, "by_default"), (True, "wanted"), (False, "unwanted")]
    rows = [(s, t, "+".join(presets.segmentation_dictionaries(s, t)), *(presets.phrase_direction(s, t, w) for w, _ in ways)) for s in presets.LOCALES for t in presets.LOCALES]
    return spark.createDataFrame(rows, "source string, target string, dicts string, " + ", ".join(f"{n} string" for _, n in ways))


def segment_text(spark: SparkSession, d: str) -> DataFrame:
    found = segment(F.col("text"), Matcher([(s, s) for s in SEGMENTS]))
    return _table(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("n_segments"), F.array_join(found, "|").alias("segments"))


def convert_segmented(spark: SparkSession, d: str) -> DataFrame:
    made = chain([RULES], segmentation=[[(s, s) for s in SEGMENTS]])
    return _table(spark, d, "documents").select("doc_id", made(F.col("text")).alias("converted"))


def match_longest(spark: SparkSession, d: str) -> DataFrame:
    found = longest_match(F.col("text"), F.lit(3), Matcher(RULES))
    return _table(spark, d, "documents").select("doc_id", found["end"].cast("long").alias("match_end"), found["value"].alias("value"))


def phrases_forward(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: custom phrases locked over a fold-only chain, on text in pseudo-Chinese."""
    made = protected(_phrases(spark), chain())
    return _table(spark, d, "documents").select("doc_id", made(_han(F.col("text"))).alias("converted"))


def phrases_reverse(spark: SparkSession, d: str) -> DataFrame:
    made = protected(converter.reverse_pairs(_phrases(spark)), chain())
    return _table(spark, d, "documents").select("doc_id", made(F.translate("text", "therinous", "捷運預設馬鈴薯冷氣")).alias("converted"))


def protected_layers(spark: SparkSession, d: str) -> DataFrame:
    made = protected([("the", "X1"), ("ing", "X2")], protected([("th", "Y1"), ("on", "Y2")], chain([[("n", "N"), ("t", "T")]])))
    return _table(spark, d, "documents").select("doc_id", made(F.col("text")).alias("converted"))


def convert_regional(spark: SparkSession, d: str) -> DataFrame:
    """Each direction between regional standards, with the sample dictionaries."""
    text = F.translate("text", "therinouasld", "头发理软件数据汉语干才")
    out = _table(spark, d, "conversations").select("conv_id", "turn", text.alias("text"))
    for s, t in analysis.DIRECTIONS:
        out = out.withColumn(f"{s}_{t}", converter.create_converter(spark, s, t, protected=[])(F.col("text")))
    return out


def convert_one_way(spark: SparkSession, d: str) -> DataFrame:
    there, back = converter.cn2t(spark, "twp"), converter.t2cn(spark, "twp")
    text = F.translate("text", "therinous", "出租车地铁默认土豆")
    return _table(spark, d, "conversations").select("conv_id", "turn", there(text).alias("there"), back(there(text)).alias("back"))


def fold_compatibility(spark: SparkSession, d: str) -> DataFrame:
    odd = "".join(map(chr, sorted(COMPAT)[:200:25])) + chr(0x2F800)
    every = F.lit("".join(map(chr, COMPAT)))
    return _table(spark, d, "documents").select("doc_id", fold_compat(F.concat(F.translate("text", "therinous", odd), every)).alias("folded"))


def convert_astral(spark: SparkSession, d: str) -> DataFrame:
    """Keys of characters beyond the basic plane, which other engines count as two units."""
    return _table(spark, d, "documents").select("doc_id", chain([ASTRAL])(F.translate("text", "the", "𠀀𪚥😀")).alias("converted"), longest_match(F.translate("text", "the", "𠀀𪚥😀"), F.lit(1), Matcher(ASTRAL))["end"].cast("long").alias("match_end"))


def dict_sanitize(spark: SparkSession, d: str) -> DataFrame:
    entries = _customer_entries(spark, d).withColumns({"key": F.translate("key", "k1", "\ue000\uf8ff"), "value": F.translate("value", "AB", "\ue123")})
    return dict_etl.sanitize_rules(entries)


def dict_empty(spark: SparkSession, d: str) -> DataFrame:
    entries = _table(spark, d, "customer").where("c_nationkey % 3 = 1").select(F.col("c_nationkey").cast("string").alias("dict"))
    return dict_etl.empty_dictionaries(entries, _table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("name")))


def strip_private_use(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "conversations").select("conv_id", "turn", strip_pua(F.translate("text", "the", "\ue000t\uf8ff")).alias("text"))


def _customer_entries(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "customer").select(F.lit("c").alias("dict"), F.col("c_custkey").cast("long").alias("ord"), F.concat(F.lit("k"), F.col("c_nationkey").cast("string")).alias("key"), F.col("c_mktsegment").alias("value"))
    more = _table(spark, d, "supplier").select(F.lit("s").alias("dict"), F.col("s_suppkey").cast("long").alias("ord"), F.concat(F.lit("k"), (F.col("s_nationkey") + 5).cast("string")).alias("key"), F.concat(F.lit("v"), (F.col("s_suppkey") % 7).cast("string")).alias("value"))
    return e.unionByName(more)


def dict_merge(spark: SparkSession, d: str) -> DataFrame:
    return dict_etl.merge_group(_customer_entries(spark, d), ["c", "s"])


def dict_reverse(spark: SparkSession, d: str) -> DataFrame:
    part = _table(spark, d, "orders").select(F.lit("o").alias("dict"), F.col("o_orderkey").cast("long").alias("ord"), (F.col("o_orderkey") % 50).cast("string").alias("key"), (F.col("o_custkey") % 20).cast("string").alias("value"))
    return dict_etl.reverse_dict(part).select("key", "value")


def _merged(spark: SparkSession, d: str, name: str) -> DataFrame:
    return dict_etl.merge_group(_customer_entries(spark, d), [name])


def dict_new(spark: SparkSession, d: str) -> DataFrame:
    return analysis.new_entries(_merged(spark, d, "s"), _merged(spark, d, "c"))


def dict_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return analysis.conflicts(_merged(spark, d, "s"), _merged(spark, d, "c"))


def dict_summary(spark: SparkSession, d: str) -> DataFrame:
    return analysis.diff_summary(_merged(spark, d, "s"), _merged(spark, d, "c"))


def dict_drift(spark: SparkSession, d: str) -> DataFrame:
    e = _customer_entries(spark, d)
    return dict_etl.check_drift(e.where("dict = 'c'").select(F.col("key").alias("name")), e.where("dict = 's'").select(F.col("key").alias("name")))


def dict_pack(spark: SparkSession, d: str) -> DataFrame:
    n = _table(spark, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dict"), F.col("n_nationkey").cast("long").alias("ord"), F.regexp_replace("n_name", " ", "_").alias("key"), F.concat_ws(" ", "n_name", F.lit("x")).alias("value"))
    return dict_etl.pack(n)


def dict_unpack(spark: SparkSession, d: str) -> DataFrame:
    packed = _table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("dict"), F.concat("n_name", F.lit(" v w|nosep|k |"), "n_name", F.lit("  y")).alias("packed"))
    return dictionaries.unpack(packed)


def dict_parse(spark: SparkSession, d: str) -> DataFrame:
    files = _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("dict"), F.col("text").alias("content"))
    return dictionaries.parse_dict(files)


def dict_parse_custom(spark: SparkSession, d: str) -> DataFrame:
    files = _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("dict"), F.translate("text", ",", "\t").alias("content"))
    return dictionaries.parse_custom_dict(files)


def _tabbed(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("dict"), F.translate("text", ",", "\t").alias("content"))


def dict_candidates(spark: SparkSession, d: str) -> DataFrame:
    return dictionaries.candidates(_tabbed(spark, d))


def dict_map(spark: SparkSession, d: str) -> DataFrame:
    return dictionaries.parse_dict_map(_tabbed(spark, d))


def dict_manifest(spark: SparkSession, d: str) -> DataFrame:
    return dict_etl.manifest(_table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("dict"), F.col("text").alias("content")))


def dict_generate(spark: SparkSession, d: str) -> DataFrame:
    own = converter.store(spark)
    pairs = [*own.pairs("HKPhrases"), *own.pairs("TWPhrases")]
    return dict_etl.generate_regional(dictionaries.from_pairs(spark, "p", pairs), chain([own.pairs(n) for n in presets.FROM_STANDARD["cn"]]))


def parity(spark: SparkSession, d: str) -> DataFrame:
    text = _han(F.col("text"))
    cases = _table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), text.alias("input"), F.create_map(F.lit("a"), F.regexp_replace(text, "地铁", "捷運"), F.lit("b"), text).alias("expected"))
    return analysis.parity_report(cases, {"a": chain([[("地铁", "捷運")]]), "b": chain([[("默认", "預設")]])})


def ablation(spark: SparkSession, d: str) -> DataFrame:
    def build(source: str, target: str, pairs: list[tuple[str, str]]):
        inner = converter.create_converter(spark, source, target, protected=[], custom_phrases=False)
        direction = presets.phrase_direction(source, target, True)
        return protected(pairs if direction == "forward" else converter.reverse_pairs(pairs), inner) if direction else inner

    return analysis.ablate(spark, _phrases(spark), build)


def relate_upstream(spark: SparkSession, d: str) -> DataFrame:
    own = converter.store(spark)
    upstream = [p for n in presets.all_dictionaries() for p in own.pairs(n)]
    official = converter.create_converter(spark, "cn", "twp", protected=[], custom_phrases=False)
    return analysis.relate_upstream(dictionaries.from_pairs(spark, "c", _phrases(spark)), dictionaries.from_pairs(spark, "u", upstream), official)


def bare_characters(spark: SparkSession, d: str) -> DataFrame:
    lines = _table(spark, d, "conversations").select("conv_id", "turn", F.translate("text", "zq", "\ue000\x01").alias("line"))
    return analysis.find_bare_characters(lines).select("conv_id", "turn")


def html_pages(spark: SparkSession, d: str) -> DataFrame:
    made = html_convert(_table(spark, d, "pages"), "html", Function(_shout), "en", "en-x")
    return made.select("page_id", "html", F.size("slots").cast("long").alias("n_slots"))


def html_round_trip(spark: SparkSession, d: str) -> DataFrame:
    made = html_convert(_table(spark, d, "pages"), "html", Function(_shout), "en", "en-x")
    return html_restore(made, "html", "en").select("page_id", "html")


def _shout(text: str) -> str:
    return text.upper() if text.isascii() else text


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_keys(rules: list[tuple[str, str]]) -> str:
    return "|".join(k.replace("+", r"\+") for k in sorted(dict(rules), key=len, reverse=True))


def _sql_convert(text: str, rules: list[tuple[str, str]]) -> str:
    """Leftmost-longest conversion of a SQL text."""
    table = ", ".join(f"{_sql(k)}: {_sql(v)}" for k, v in dict(rules).items())
    return f"array_to_string(list_transform(regexp_extract_all({text}, {_sql(f'(?s)({_sql_keys(rules)}|.)')}, 1), lambda x: coalesce(map {{{table}}}[x], x)), '')"


def _sql_segments(text: str, keys: list[str]) -> str:
    mark = "chr(1)"
    return f"list_filter(string_split(regexp_replace({text}, {_sql('(' + '|'.join(sorted(keys, key=len, reverse=True)) + ')')}, {mark} || '\\1' || {mark}, 'g'), {mark}), lambda x: x <> '')"


def _sql_protect(text: str, rules: list[tuple[str, str]], inner) -> str:
    """Values for matches, ``inner`` of the SQL text between."""
    table = ", ".join(f"{_sql(k)}: {_sql(v)}" for k, v in dict(rules).items())
    return f"array_to_string(list_transform({_sql_segments(text, list(dict(rules)))}, lambda x{len(rules)}: coalesce(map {{{table}}}[x{len(rules)}], {inner(f'x{len(rules)}')})), '')"


_SPACES = r"\t\n\x0b\x0c\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_ENTRIES_SQL = """e AS (
  SELECT 'c' AS dict, CAST(c_custkey AS BIGINT) AS ord, 'k' || c_nationkey AS key, c_mktsegment AS value FROM customer
  UNION ALL SELECT 's', CAST(s_suppkey AS BIGINT), 'k' || (s_nationkey + 5), 'v' || (s_suppkey % 7) FROM supplier),
c AS (SELECT key, arg_max(value, ord) AS value FROM e WHERE dict = 'c' GROUP BY key),
s AS (SELECT key, arg_max(value, ord) AS value FROM e WHERE dict = 's' GROUP BY key)"""


_PRESET_STEPS_SQL = """
WITH t(locale, side, dicts) AS (VALUES
  ('cn', 0, 'STCharacters STPhrases_GeneratedFromRegionalPhrases STPhrases'), ('cn', 1, 'TSCharacters TSPhrases'),
  ('hk', 0, 'HKVariantsRev HKVariantsRevPhrases'), ('hk', 1, 'HKVariants HKVariantsPhrases'),
  ('hkp', 0, 'HKVariantsRev HKVariantsRevPhrases HKPhrasesRev'), ('hkp', 1, 'HKVariants HKVariantsPhrases HKPhrases'),
  ('tw', 0, 'TWVariantsRev TWVariantsRevPhrases'), ('tw', 1, 'TWVariants TWVariantsPhrases'),
  ('twp', 0, 'TWVariantsRev TWVariantsRevPhrases TWPhrasesRev'), ('twp', 1, 'TWVariants TWVariantsPhrases TWPhrases'),
  ('jp', 0, 'JPShinjitaiCharacters JPShinjitaiPhrases'), ('jp', 1, 'JPShinjitaiCharactersRev'), ('t', 0, ''), ('t', 1, '')),
d AS (SELECT locale, side, string_split(dicts, ' ') AS a FROM t),
p AS (SELECT a.locale AS source, b.locale AS target, a.a AS x, b.a AS y FROM d a, d b WHERE a.side = 0 AND b.side = 1),
s AS (SELECT source, target, 0 AS step, x AS a FROM p WHERE x <> [''] UNION ALL SELECT source, target, CASE WHEN source = 't' THEN 0 ELSE 1 END, y FROM p WHERE y <> [''])
SELECT source, target, CAST(step AS BIGINT) AS step, CAST(i - 1 AS BIGINT) AS place, a[i] AS dict FROM (SELECT *, unnest(generate_series(1, len(a))) AS i FROM s)"""
_PRESET_CUTS_SQL = """
WITH l(x) AS (VALUES ('cn'), ('hk'), ('hkp'), ('tw'), ('twp'), ('jp'), ('t')),
p AS (SELECT a.x AS source, b.x AS target, a.x IN ('tw', 'twp') AS from_tw, b.x IN ('tw', 'twp') AS to_tw FROM l a, l b),
w AS (SELECT *, CASE WHEN to_tw AND NOT from_tw THEN 'forward' WHEN from_tw AND target = 'cn' THEN 'reverse' END AS wanted FROM p)
SELECT source, target, CASE WHEN source = 'cn' AND target IN ('tw', 'twp', 'hk', 'hkp') THEN 'STPhrases+STPhrases_GeneratedFromRegionalPhrases' WHEN source IN ('tw', 'twp', 'hk', 'hkp') AND target = 'cn' THEN 'TSPhrases' ELSE '' END AS dicts,
  CASE WHEN 'twp' IN (source, target) THEN wanted END AS by_default, wanted, CAST(NULL AS VARCHAR) AS unwanted FROM w"""


def _phrase_pairs() -> list[tuple[str, str]]:
    lines = (converter.DATA / "custom" / f"{presets.CUSTOM}.txt").read_text("utf-8").splitlines()
    return [tuple(x.split("\t")) for x in lines if "\t" in x and not x.startswith("#")]


def _sample_pairs(name: str) -> list[tuple[str, str]]:
    """A sample dictionary's entries, read plainly: what the SQL twins are made of."""
    if name == presets.GENERATED:
        simple = _sample_step(presets.FROM_STANDARD["cn"])
        return [(Matcher(simple).convert_text(k), k) for n in ("HKPhrases", "TWPhrases") for k, _ in _sample_pairs(n) if len(k) >= 3]
    lines = (converter.DATA / "mini" / f"{presets.REVERSED.get(name, name)}.txt").read_text("utf-8").splitlines()
    fields = [x.split("\t")[:2] for x in lines if "\t" in x and not x.startswith("#")]
    if name in presets.REVERSED:
        pairs = converter.reverse_pairs([(k, v) for k, values in fields for v in values.split(" ") if v])
    else:
        pairs = [(k, values.split()[0]) for k, values in fields]
    return [(k, v) for k, v in pairs if k != v or len(k.encode("utf-16-le")) > 2]


def _sample_step(names: list[str]) -> list[tuple[str, str]]:
    return list({k: v for n in names for k, v in _sample_pairs(n)}.items())


def _sql_direction(source: str, target: str, custom_phrases: bool | None = None):
    """SQL text -> SQL text: a direction between regional standards with the sample dictionaries."""
    steps = [_sample_step(names) for names in presets.dictionary_steps(source, target)]
    cut = [k for k, _ in _sample_step(presets.segmentation_dictionaries(source, target))]
    way = presets.phrase_direction(source, target, custom_phrases)

    def run(text: str) -> str:
        for rules in steps:
            text = _sql_convert(text, rules) if rules else text
        return text

    def segmented(text: str) -> str:
        return f"array_to_string(list_transform({_sql_segments(text, cut)}, lambda seg: {run('seg')}), '')" if cut else run(text)

    if way is None:
        return segmented
    phrases = _phrase_pairs() if way == "forward" else converter.reverse_pairs(_phrase_pairs())
    return lambda text: _sql_protect(text, phrases, segmented)


def _sql_values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else _sql(x) for x in r) + ")" for r in rows) + ")"


def _ablation_sql() -> str:
    """Leaving out each phrase in turn, e (-1: none), in both ways; the rules of each are a pattern and a map."""
    (a, b), (c, d) = analysis.KEY_CARRIER, analysis.VALUE_CARRIER
    parts = []
    for n, (source, target) in enumerate(analysis.DIRECTIONS):
        if way := presets.phrase_direction(source, target, True):
            inner = _sql_direction(source, target, False)
            segments = "list_filter(string_split(regexp_replace(text, pattern, chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda z: z <> '')"
            parts.append(f"SELECT {n} AS d, {_sql(f'{source}->{target} ')} AS name, e, text, array_to_string(list_transform({segments}, lambda y: coalesce(m[y], {inner('y')})), '') AS made FROM t, rules WHERE way = '{way}'")
    quoted = r"regexp_replace(a, '([.+*?()\[\]{}|^$\\])', '\\\1', 'g')"
    return f"""
WITH p AS (SELECT * FROM {_sql_values([(i, k, v) for i, (k, v) in enumerate(_phrase_pairs())])} AS p(i, k, v)),
t AS (SELECT DISTINCT unnest([k, v, {_sql(a)} || k || {_sql(b)}, {_sql(c)} || v || {_sql(d)}]) AS text FROM p),
left_out AS (SELECT i AS e FROM p UNION ALL SELECT -1),
pairs AS (
  SELECT e, 'forward' AS way, k AS a, arg_max(v, i) AS b FROM left_out JOIN p ON i <> e GROUP BY e, k
  UNION ALL SELECT e, 'reverse', v, coalesce(max(CASE WHEN k = v THEN k END), arg_min(k, i)) FROM left_out JOIN p ON i <> e GROUP BY e, v),
rules AS (SELECT e, way, '(?s)(' || string_agg({quoted}, '|' ORDER BY length(a) DESC, a) || ')' AS pattern, map_from_entries(list(ROW(a, b))) AS m FROM pairs GROUP BY e, way),
made AS ({" UNION ALL ".join(parts)}),
changed AS (
  SELECT x.e, x.name || x.text || ': ' || w.made || ' -> ' || x.made AS diff, row_number() OVER (PARTITION BY x.e ORDER BY d, x.text) AS place
  FROM made x JOIN made w USING (d, text) WHERE w.e = -1 AND x.e >= 0 AND x.made <> w.made)
SELECT k AS key, v AS value, diff AS first_diff FROM p LEFT JOIN changed ON e = i AND place = 1
"""


def _html_sql(restored: bool) -> str:
    """Pages in English with their ASCII texts in upper case, or back again, where a changed text is escaped anew."""
    plain = "x"
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'")):
        plain = f"replace({plain}, {_sql(entity)}, {_sql(c)})"
    plain = f"regexp_replace({plain}, '&amp;?', '&', 'g')"
    escaped = lambda u: f"replace(replace(replace({u}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    text = f"CASE WHEN regexp_matches({plain}, '^[\\x00-\\x7F]*$') AND NOT regexp_matches({plain}, '&[a-zA-Z0-9#]+;') AND upper({plain}) <> {plain} THEN {escaped(plain if restored else f'upper({plain})')} ELSE x END"
    tag = "x" if restored else """CASE WHEN starts_with(x, '<html ') THEN replace(x, 'lang="en"', 'lang="en-x"') ELSE x END"""
    tokens = r"""'(?s)<!--.*?-->|<script[ >].*?</script>|<style[ >].*?</style>|<[!?/a-zA-Z][^>]*>|(?:[^<]|<+[^<!?/a-zA-Z])+'"""
    page = f"array_to_string(list_transform(t, lambda x: CASE WHEN regexp_matches(x, '^<[!?/a-zA-Z]') THEN {tag} ELSE {text} END), '')"
    slots = "" if restored else ", CAST(CASE WHEN en THEN 1 + len(list_filter(t, lambda x: NOT regexp_matches(x, '^<[!?/a-zA-Z]'))) ELSE 0 END AS BIGINT) AS n_slots"
    return f"""SELECT page_id, CASE WHEN en THEN {page} ELSE html END AS html{slots} FROM (SELECT page_id, html, regexp_extract_all(html, {tokens}) AS t, regexp_matches(html, '<html lang="en">') AS en FROM pages)"""


def queries() -> dict:
    return {f.__name__: f for f in (convert_streamed, preset_steps, preset_cuts, convert_custom, convert_many_rules, convert_characters, convert_two_steps, segment_text, convert_segmented, match_longest, phrases_forward, phrases_reverse, protected_layers, convert_regional, convert_one_way, fold_compatibility, convert_astral, strip_private_use, dict_sanitize, dict_empty, dict_candidates, dict_map, dict_merge, dict_reverse, dict_new, dict_conflicts, dict_summary, dict_drift, dict_pack, dict_unpack, dict_parse, dict_parse_custom, dict_manifest, dict_generate, parity, ablation, relate_upstream, bare_characters, html_pages, html_round_trip)}


def oracle_sql() -> dict[str, str]:
    phrases = _phrase_pairs()
    han = f"translate(text, {_sql(LATIN)}, {_sql(HAN)})"
    odd = "".join(map(chr, sorted(COMPAT)[:200:25])) + chr(0x2F800)
    trim = lambda c: f"regexp_replace({c}, '^[{_SPACES}]+|[{_SPACES}]+$', '', 'g')"
    lines = f"SELECT CAST(doc_id AS VARCHAR) AS dict, CAST(i - 1 AS BIGINT) AS ord, {trim('a[i]')} AS line FROM (SELECT doc_id, a, unnest(generate_series(1, len(a))) AS i FROM (SELECT doc_id, regexp_split_to_array(%s, '\\r?\\n') AS a FROM documents))"
    pair = f"'^([^{_SPACES}]+)[{_SPACES}]+(.+)$'"
    fields = f"SELECT dict, ord, CASE WHEN strpos(line, chr(9)) > 0 THEN {trim('split_part(line, chr(9), 1)')} ELSE regexp_extract(line, {pair}, 1) END AS key, CASE WHEN strpos(line, chr(9)) > 0 THEN substr(line, strpos(line, chr(9)) + 1) ELSE regexp_extract(line, {pair}, 2) END AS vals, strpos(line, chr(9)) > 0 AS tabbed FROM l WHERE line <> '' AND NOT starts_with(line, '#')"
    value = f"regexp_extract({trim('vals')}, '^([^{_SPACES}]+)', 1)"
    whole = trim("CASE WHEN tabbed THEN split_part(vals, chr(9), 1) ELSE vals END")
    one_way = f"translate(text, 'therinous', {_sql('出租车地铁默认土豆')})"
    there, back = _sql_direction("cn", "twp"), _sql_direction("twp", "cn")
    regional = f"translate(text, 'therinouasld', {_sql('头发理软件数据汉语干才')})"
    simple = _sql_convert("k", _sample_step(presets.FROM_STANDARD["cn"]))
    upstream = sorted({k for n in presets.all_dictionaries() for k, _ in _sample_pairs(n)})
    return {
        "convert_regional": f"SELECT conv_id, turn, text, {', '.join(f'{_sql_direction(s, t)("text")} AS {s}_{t}' for s, t in analysis.DIRECTIONS)} FROM (SELECT conv_id, turn, {regional} AS text FROM conversations)",
        "convert_one_way": f"SELECT conv_id, turn, there, {back('there')} AS back FROM (SELECT conv_id, turn, {there('text')} AS there FROM (SELECT conv_id, turn, {one_way} AS text FROM conversations))",
        "dict_generate": f"SELECT key, min(value) AS value FROM (SELECT {simple} AS key, k AS value FROM {_sql_values([(k,) for n in ('HKPhrases', 'TWPhrases') for k, _ in _sample_pairs(n)])} AS p(k) WHERE length(k) >= 3) GROUP BY key",
        "ablation": _ablation_sql(),
        "relate_upstream": f"SELECT k AS key, v AS value, CASE WHEN k IN ({', '.join(map(_sql, upstream))}) THEN 'override' WHEN {_sql_direction('cn', 'twp', False)('k')} = v THEN 'equivalent' ELSE 'addition' END AS relation FROM {_sql_values(phrases)} AS p(k, v)",
        "html_pages": _html_sql(False),
        "html_round_trip": _html_sql(True),
        "convert_streamed": f"SELECT conv_id, turn, {_sql_convert('text', RULES)} AS text FROM conversations",
        "preset_steps": _PRESET_STEPS_SQL,
        "preset_cuts": _PRESET_CUTS_SQL,
        "convert_custom": f"SELECT doc_id, {_sql_convert('text', RULES)} AS converted FROM documents",
        "convert_many_rules": f"SELECT doc_id, {_sql_convert('text', MANY)} AS converted FROM documents",
        "convert_characters": f"SELECT conv_id, turn, {han} AS converted FROM conversations",
        "convert_two_steps": f"SELECT doc_id, {_sql_convert(_sql_convert('text', RULES), SECOND)} AS converted FROM documents",
        "segment_text": f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n_segments, array_to_string(s, '|') AS segments FROM (SELECT doc_id, {_sql_segments('text', SEGMENTS)} AS s FROM documents)",
        "convert_segmented": f"SELECT doc_id, array_to_string(list_transform({_sql_segments('text', SEGMENTS)}, lambda s: {_sql_convert('s', RULES)}), '') AS converted FROM documents",
        "match_longest": f"SELECT doc_id, CAST(CASE WHEN k = '' THEN 0 ELSE 3 + length(k) END AS BIGINT) AS match_end, map {{{', '.join(f'{_sql(k)}: {_sql(v)}' for k, v in RULES)}}}[k] AS value FROM (SELECT doc_id, regexp_extract(substr(text, 4), {_sql(f'^(?s:({_sql_keys(RULES)}))')}, 1) AS k FROM documents)",
        "phrases_forward": f"SELECT doc_id, {_sql_convert(han, phrases)} AS converted FROM documents",
        "phrases_reverse": f"SELECT doc_id, {_sql_convert(f'translate(text, {_sql(LATIN)}, {_sql("捷運預設馬鈴薯冷氣")})', converter.reverse_pairs(phrases))} AS converted FROM documents",
        "protected_layers": "SELECT doc_id, " + _sql_protect("text", [("the", "X1"), ("ing", "X2")], lambda x: _sql_convert(x, [("th", "Y1"), ("on", "Y2"), ("n", "N"), ("t", "T")])) + " AS converted FROM documents",
        "fold_compatibility": f"SELECT doc_id, nfc_normalize(translate(text, 'therinous', {_sql(odd)}) || {_sql(''.join(map(chr, COMPAT)))}) AS folded FROM documents",
        "convert_astral": f"SELECT doc_id, {_sql_convert('t', ASTRAL)} AS converted, CAST(CASE WHEN k = '' THEN 0 ELSE 1 + length(k) END AS BIGINT) AS match_end FROM (SELECT doc_id, t, regexp_extract(substr(t, 2), {_sql(f'^(?s:({_sql_keys(ASTRAL)}))')}, 1) AS k FROM (SELECT doc_id, translate(text, 'the', '𠀀𪚥😀') AS t FROM documents))",
        "dict_sanitize": f"WITH {_ENTRIES_SQL}, x AS (SELECT dict, ord, replace(replace(key, 'k', ''), '1', '') AS key, replace(replace(value, 'A', ''), 'B', '') AS value FROM e) SELECT * FROM x WHERE key <> '' AND value <> ''",
        "dict_empty": "SELECT CAST(n_nationkey AS VARCHAR) AS name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey % 3 = 1)",
        "dict_candidates": f"WITH l AS ({lines % 'replace(text, chr(44), chr(9))'}), f AS ({fields}), c AS (SELECT dict, ord, key, string_split({whole}, ' ') AS a FROM f WHERE tabbed) SELECT dict, ord * 1000000 + i - 1 AS ord, key, a[i] AS value FROM (SELECT *, unnest(generate_series(1, len(a))) AS i FROM c) WHERE key <> '' AND a[i] <> ''",
        "dict_map": f"WITH l AS ({lines % 'replace(text, chr(44), chr(9))'}), f AS ({fields}), p AS (SELECT dict, ord, key, {value} AS value FROM f WHERE key <> '' AND {value} <> '') SELECT dict, max(ord) AS ord, key, arg_max(value, ord) AS value FROM p GROUP BY dict, key",
        "strip_private_use": "SELECT conv_id, turn, regexp_replace(translate(text, 'the', chr(57344) || 't' || chr(63743)), '[\\x{E000}-\\x{F8FF}]', '', 'g') AS text FROM conversations",
        "dict_merge": f"WITH {_ENTRIES_SQL} SELECT key, arg_max(value, (CASE dict WHEN 'c' THEN 0 ELSE 1 END) * 1000000000 + ord) AS value FROM e GROUP BY key",
        "dict_reverse": "SELECT v AS key, coalesce(max(CASE WHEN k = v THEN k END), arg_min(k, o)) AS value FROM (SELECT o_orderkey AS o, CAST(o_orderkey % 50 AS VARCHAR) AS k, CAST(o_custkey % 20 AS VARCHAR) AS v FROM orders) GROUP BY v",
        "dict_new": f"WITH {_ENTRIES_SQL} SELECT key, value FROM s ANTI JOIN c USING (key)",
        "dict_conflicts": f"WITH {_ENTRIES_SQL} SELECT key, s.value, c.value AS upstream_value FROM s JOIN c USING (key) WHERE s.value <> c.value",
        "dict_summary": f"WITH {_ENTRIES_SQL} SELECT CASE WHEN c.value IS NULL THEN 'new' WHEN s.value <> c.value THEN 'conflict' ELSE 'in sync' END AS status, count(*) AS n FROM s LEFT JOIN c USING (key) GROUP BY 1",
        "dict_drift": f"WITH {_ENTRIES_SQL} SELECT 'added' AS change, key AS name FROM (SELECT key FROM s EXCEPT SELECT key FROM c) UNION ALL SELECT 'removed', key FROM (SELECT key FROM c EXCEPT SELECT key FROM s)",
        "dict_pack": "SELECT 'r' || n_regionkey AS dict, string_agg(replace(n_name, ' ', '_') || ' ' || n_name || ' x', '|' ORDER BY n_nationkey) AS packed FROM nation GROUP BY 1",
        "dict_unpack": "SELECT CAST(n_nationkey AS VARCHAR) AS dict, CAST(i - 1 AS BIGINT) AS ord, split_part(a[i], ' ', 1) AS key, substr(a[i], strpos(a[i], ' ') + 1) AS value FROM (SELECT n_nationkey, a, unnest(generate_series(1, len(a))) AS i FROM (SELECT n_nationkey, string_split(n_name || ' v w|nosep|k |' || n_name || '  y', '|') AS a FROM nation)) WHERE strpos(a[i], ' ') > 0 AND split_part(a[i], ' ', 1) <> '' AND substr(a[i], strpos(a[i], ' ') + 1) <> ''",
        "dict_parse": f"WITH l AS ({lines % 'text'}), f AS ({fields}) SELECT dict, ord, key, {value} AS value FROM f WHERE key <> '' AND {value} <> ''",
        "dict_parse_custom": f"WITH l AS ({lines % 'replace(text, chr(44), chr(9))'}), f AS ({fields}) SELECT dict, ord, key, {whole} AS value FROM f WHERE key <> '' AND {whole} <> ''",
        "dict_manifest": "SELECT CAST(doc_id AS VARCHAR) AS name, 'sha256:' || sha256(text) AS sha256 FROM documents",
        "parity": f"SELECT config, count(*) AS n, count(*) FILTER (WHERE config = 'b' AND strpos(t, '默认') > 0) AS mismatches, CAST(0 AS BIGINT) AS healed FROM (SELECT {han} AS t, unnest(['a', 'b']) AS config FROM conversations) GROUP BY 1",
        "bare_characters": "SELECT conv_id, turn FROM conversations WHERE regexp_matches(translate(text, 'zq', chr(57344) || chr(1)), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{E000}-\\x{F8FF}\\x{F900}-\\x{FAFF}]')",
    }
