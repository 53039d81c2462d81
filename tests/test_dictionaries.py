import pytest
from pyspark.sql import functions as F

from glyphflow.operators import analysis, dict_etl
from glyphflow.operators.chain import chain
from glyphflow.sources import dictionaries as D


def files(spark, **contents):
    return spark.createDataFrame(list(contents.items()), "dict string, content string")


def pairs(df):
    return [(r["key"], r["value"]) for r in df.orderBy("ord").collect()]


def test_parsers(spark):
    f = files(spark, d="# c\r\n干\t幹 乾 干\r\n　x y z　\nnokey\n a b\tv w\tq\n﻿# also\nk\t\n")
    assert pairs(D.parse_dict(f)) == [("干", "幹"), ("x", "y"), ("a b", "v")]
    assert pairs(D.parse_custom_dict(f)) == [("干", "幹 乾 干"), ("x", "y z"), ("a b", "v w")]
    assert pairs(D.candidates(f)) == [("干", "幹"), ("干", "乾"), ("干", "干"), ("a b", "v"), ("a b", "w")]
    assert [r["value"] for r in D.parse_dict_map(files(spark, d="a\tb\na\tc")).collect()] == ["c"]
    assert D.check_content(files(spark, a=" <html>", b="x\ty")).count() == 1


def test_packing(spark):
    e = D.from_pairs(spark, "d", [("a", "a"), ("𠀀", "𠀀"), ("ab", "ab"), ("k", "v w")])
    assert dict_etl.pack(e).first()["packed"] == "𠀀 𠀀|ab ab|k v w"
    back = D.unpack(spark.createDataFrame([("d", "a b|nosep|k |x  y")], "dict string, packed string"))
    assert pairs(back) == [("a", "b"), ("x", " y")]
    for bad in (("a|", "b"), ("a", "|"), ("a b", "c")):
        with pytest.raises(dict_etl.DictionaryError):
            dict_etl.pack(D.from_pairs(spark, "d", [bad]))


def test_reverse_and_merge(spark):
    assert pairs(dict_etl.reverse_dict(D.from_pairs(spark, "d", [("U盘", "隨身碟"), ("优盘", "隨身碟")]))) == [("隨身碟", "U盘")]
    assert pairs(dict_etl.reverse_dict(D.from_pairs(spark, "d", [("优盘", "隨身碟"), ("隨身碟", "隨身碟")]))) == [("隨身碟", "隨身碟")]
    both = D.from_pairs(spark, "a", [("k", "1"), ("k", "2")]).union(D.from_pairs(spark, "b", [("k", "0"), ("j", "3")]))
    assert sorted(map(tuple, dict_etl.merge_group(both, ["b", "a"]).collect())) == [("j", "3"), ("k", "2")]
    assert [tuple(r) for r in dict_etl.sanitize_rules(D.from_pairs(spark, "a", [("", "x"), ("a", "b")])).select("key", "value").collect()] == [("a", "b")]


def test_generated_conflicts_fail(spark):
    fold = chain([[("車", "车"), ("甲", "X"), ("乙", "X")]])
    assert [tuple(r) for r in dict_etl.generate_regional(D.from_pairs(spark, "p", [("出租車", "x"), ("車", "y")]), fold).collect()] == [("出租车", "出租車")]
    with pytest.raises(dict_etl.DictionaryError):
        dict_etl.generate_regional(D.from_pairs(spark, "p", [("甲甲甲", "x"), ("乙乙乙", "y")]), fold)


def test_checks(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert sorted(map(tuple, dict_etl.check_drift(names("a", "b"), names("b", "c")).collect())) == [("added", "c"), ("removed", "a")]
    assert [r[0] for r in dict_etl.empty_dictionaries(D.from_pairs(spark, "a", [("k", "v")]), names("a", "b")).collect()] == ["b"]
    config = {"s": {"conversion_chain": [{"dict": {"dicts": [{"file": "B.ocd2"}, {"dict": {"file": "A.txt"}}]}}], "segmentation": {"dict": {"file": "B.ocd2"}}}, "n": {}}
    assert dict_etl.chain_differences(config, {"s": (0, ["A", "B"])}) == []
    assert dict_etl.chain_differences(config, {"s": (0, ["B", "A"])}) == [("s", ["B", "A"], ["A", "B"])]
    assert dict_etl.segmentation_differences(config, {"s": ["B"]}, ["n"]) == []
    assert dict_etl.segmentation_differences(config, {"s": ["A"]}, ["s"]) == ["s", "s"]
    assert dict_etl.manifest(files(spark, b="x", a="")).first()["name"] == "a"


def test_diff_and_parity(spark):
    ours, theirs = D.from_pairs(spark, "o", [("a", "1"), ("b", "2"), ("c", "3")]), D.from_pairs(spark, "t", [("a", "1"), ("b", "9")])
    assert [tuple(r) for r in analysis.new_entries(ours, theirs).collect()] == [("c", "3")]
    assert [tuple(r) for r in analysis.conflicts(ours, theirs).collect()] == [("b", "2", "9")]
    assert dict(map(tuple, analysis.diff_summary(ours, theirs).collect())) == {"new": 1, "conflict": 1, "in sync": 1}
    cases = spark.createDataFrame([("1", "a", {"x": "b"}), ("2", "a", {"x": "c"}), ("3", "a", {"x": "b"})], "id string, input string, expected map<string,string>")
    assert tuple(analysis.parity_report(cases, {"x": chain([[("a", "b")]])}, [("x", "3")]).first()) == ("x", 3, 1, 1)


def test_ablation(spark):
    build = lambda s, t, p: chain([p])
    rows = {r["key"]: r["first_diff"] for r in analysis.ablate(spark, [("a", "a"), ("b", "c")], build, (("x", "y"),)).collect()}
    assert rows["a"] is None and rows["b"].startswith("x->y")


def test_write_prunes_by_dictionary(spark, tmp_path):
    D.write_dictionaries(D.from_pairs(spark, "a", [("k", "v")]).union(D.from_pairs(spark, "b", [("k", "v")])), str(tmp_path / "d"))
    plan = spark.read.parquet(str(tmp_path / "d")).where(F.col("dict") == "a")
    assert plan.count() == 1 and len(plan.inputFiles()) >= 1


def test_stores(spark, tmp_path):
    import pytest

    from glyphflow.plans import converter

    folder = tmp_path / "dicts"
    folder.mkdir()
    (folder / "TSCharacters.txt").write_text("漢\t汉 x\n語\t语\n同\t同\n", "utf-8")
    (folder / "TSPhrases.txt").write_text("# nothing\n", "utf-8")
    (folder / "HKVariants.txt").write_text(" <html>not found</html>", "utf-8")
    assert D.list_files(spark, str(folder)) == ["HKVariants", "TSCharacters", "TSPhrases"]
    with pytest.warns(UserWarning, match="listed"):
        assert D.list_files(spark, str(folder / "none")) is None
    store = converter.DictionaryStore(spark, str(folder))
    assert store.pairs("TSCharacters") == [("漢", "汉"), ("語", "语")]
    for name, error in (("TSPhrases", dict_etl.MissingDictionary), ("STPhrases", dict_etl.MissingDictionary), ("HKVariants", dict_etl.DictionaryError)):
        with pytest.raises(error):
            store.pairs(name)
    with pytest.warns(UserWarning, match="left out"):
        made = converter.create_converter(spark, "t", "cn", protected=[], dictionaries_at=str(folder))
    assert made.text("漢語") == "汉语"
    with pytest.raises(dict_etl.DictionaryError, match="missing from t2cn bundle"):
        converter.t2cn(spark, "t", dictionaries_at=str(folder))
    (folder / "TSCharacters.txt").write_text("漢\tH\n", "utf-8")
    assert len(store.pairs("TSCharacters")) == 2
    store.refresh()
    assert store.pairs("TSCharacters") == [("漢", "H")]


def test_a_store_of_parquet(spark, tmp_path):
    from glyphflow.plans import converter

    path = str(tmp_path / "all.parquet")
    D.write_dictionaries(D.from_pairs(spark, "TSCharacters", [("漢", "汉")]).union(D.from_pairs(spark, "HKVariants", [("a", "b"), ("c", "b"), ("b", "b")])), path)
    store = converter.DictionaryStore(spark, path)
    assert store.pairs("TSCharacters") == [("漢", "汉")]
    assert store.pairs("HKVariants") == [("a", "b"), ("c", "b")] and store.known_pairs("HKVariantsRev", None) == []
    plan = D.read_dictionary(spark, path, "TSCharacters")
    assert "PartitionFilters: [isnotnull(dict" in plan._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_golden_cases(spark):
    files = spark.createDataFrame([("g", '{"cases": [{"id": "a,]", "input": "x\\"", "expected": {"s2t": "y",},},\n {"id": "b", "input": "", "expected": {}},\n],}')], "dict string, content string")
    assert [(r["id"], r["input"], r["expected"]) for r in D.golden_cases(files).collect()] == [("a,]", 'x"', {"s2t": "y"}), ("b", "", {})]


def test_missing_configurations_are_differences():
    assert dict_etl.chain_differences({}, {"s": (0, ["A"])}) == [("s", [], ["A"])]
    assert dict_etl.segmentation_differences({}, {"s": ["A"]}, ["n"]) == ["s"]


def test_each_configuration_meets_its_own_converter(spark):
    cases = spark.createDataFrame([("1", "a", {"x": "b", "y": "a"}), ("2", "a", {"y": "c"})], "id string, input string, expected map<string,string>")
    got = {r["config"]: (r["n"], r["mismatches"], r["healed"]) for r in analysis.parity_report(cases, {"x": chain([[("a", "b")]]), "y": chain()}, [("y", "1")]).collect()}
    assert got == {"x": (1, 0, 0), "y": (2, 1, 1)}


def test_public_surface():
    import glyphflow

    assert all(hasattr(glyphflow, n) for n in glyphflow.__all__)
