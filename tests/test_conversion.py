import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphflow.functions.chars import COMPAT, fold_compat_text
from glyphflow.functions.matcher import Matcher, longest_match
from glyphflow.operators.chain import Function, SlotError, chain, custom_converter, protected, segment
from glyphflow.plans import converter, presets


def run(spark, convert, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", convert(F.col("t")).alias("t")).collect()
    return [r["t"] for r in sorted(rows, key=lambda r: r["i"])]


@pytest.mark.parametrize(
    "rules, text, want",
    [
        ([("中", "中"), ("中国", "中國"), ("中国人", "中國人")], "中国人民", "中國人民"),
        ("软件 軟體|硬件 硬體", "软件和硬件", "軟體和硬體"),
        ("AB alpha beta|C gamma", "AB", "alpha beta"),
        ("a b|c d", "ac", "bd"),
        ("nosep", "nosep", "nosep"),
        ("k ", "k", "k"),
        ([("a.b", "X"), ("a+", "Y"), ("(", "]")], "a.b a+ axb (", "X Y axb ]"),
    ],
)
def test_convert(spark, rules, text, want):
    made = custom_converter(rules)
    assert made.text(text) == want
    assert run(spark, made, text, None, "") == [want, None, ""]


def test_steps_see_each_others_output(spark):
    made = chain([[("软", "軟"), ("件", "體")]], [[("軟體", "軟件")]])
    assert run(spark, made, "软件") == ["軟件"]


def test_longest_match(spark):
    m = Matcher([("中国", "中國"), ("中国人", "中國人")])
    assert m.longest("中国人民万岁", 0) == (3, "中國人")
    assert m.longest("中国人民万岁", 1) == (0, None)
    row = spark.createDataFrame([("中国人民万岁",)], "t string").select(longest_match(F.col("t"), F.lit(0), m).alias("a"), longest_match(F.col("t"), F.lit(1), m).alias("b")).first()
    assert (row["a"]["end"], row["a"]["value"], row["b"]["end"], row["b"]["value"]) == (3, "中國人", 0, None)


def test_segment(spark):
    m = Matcher([(w, w) for w in ("头发", "发现", "头")])
    assert m.segment_text("头发和发现") == ["头发", "和", "发现"]
    df = spark.createDataFrame([("头发和发现\n𠀀",), ("",)], "t string").select(segment(F.col("t"), m).alias("s")).collect()
    assert [r["s"] for r in df] == [["头发", "和", "发现", "\n𠀀"], []]


def test_protection(spark):
    assert run(spark, protected([("A", "B")], chain([[("B", "X")]])), "A") == ["B"]
    assert run(spark, protected([("A", "B")], chain([[("X", "Y")]])), "AX") == ["BY"]
    assert run(spark, protected([("A", "Z")], protected([("B", "M")], chain([[("X", "Y")]]))), "AB X") == ["ZM Y"]
    assert run(spark, protected([("A", "B")], chain([[("B", "X")]])), "A") == ["B"]
    assert run(spark, protected([("软件", "軟體")], chain()), "软件") == ["軟體"]
    assert run(spark, protected([("a", "1")], Function(str.upper)), "xay") == ["X1Y"]


def test_slots_are_limited_unless_not_wanted():
    rules = [(f"s{i};", f"d{i}") for i in range(6401)]
    text = "".join(k for k, _ in rules)
    assert protected(rules, chain(), strict_slots=False).text(text).startswith("d0d1")
    with pytest.raises(SlotError):
        protected(rules, chain()).text(text)
    assert protected(rules, chain()).text(text[: text.index("s6400;")]).startswith("d0d1")
    with pytest.raises(SlotError):  # a private use character of the text takes a place away
        protected(rules, chain()).text(text[: text.index("s6400;")] + "\ue000")
    same = [(f"s{i};", "v") for i in range(6401)]
    assert protected(same, chain()).text(text) == "v" * 6401


words = st.text(alphabet="ab\n𠀀(", min_size=1, max_size=4)


@settings(max_examples=60, deadline=None)
@given(rules=st.lists(st.tuples(words, words), max_size=6), text=st.text(alphabet="ab\n𠀀(x", max_size=20))
def test_pieces_join_to_the_text(rules, text):
    m = Matcher(rules)
    assert "".join(m.segment_text(text)) == text
    naive, at = [], 0
    while at < len(text):
        key = max((k for k, _ in rules if text.startswith(k, at)), key=len, default=None)
        naive.append(dict(rules)[key] if key else text[at])
        at += len(key) if key else 1
    assert m.convert_text(text) == "".join(naive)


def test_all_forms_agree(spark):
    import random

    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abc") for _ in range(rng.randint(1, n)))
    texts = [word(30) for _ in range(50)]
    for n in (5, 300):
        m = Matcher([(word(6), word(3).upper()) for _ in range(n)])
        want = [m.convert_text(t) for t in texts]
        assert run(spark, m.convert_native, *texts) == want
        assert run(spark, chain([list(m.rules.items())]), *texts) == want


def test_folding():
    assert len(COMPAT) == 1002
    assert fold_compat_text("類豈，。！？ＡＢ１２한글") == "類豈，。！？ＡＢ１２한글"
    for c in range(0x110000):
        if not 0xD800 <= c <= 0xDFFF and not (0xF900 <= c <= 0xFAFF or 0x2F800 <= c <= 0x2FA1F):
            assert c not in COMPAT
    assert all(unicodedata.normalize("NFC", chr(c)) == v for c, v in COMPAT.items())


def test_directions():
    assert presets.phrase_direction("cn", "twp") == "forward"
    assert presets.phrase_direction("cn", "tw") is None
    assert presets.phrase_direction("cn", "tw", True) == "forward"
    assert presets.phrase_direction("cn", "hk", True) is None
    assert presets.phrase_direction("twp", "cn") == "reverse"
    assert presets.phrase_direction("twp", "t") is None
    assert presets.phrase_direction("cn", "twp", False) is None
    assert presets.segmentation_dictionaries("cn", "hkp") == ["STPhrases", presets.GENERATED]
    assert presets.segmentation_dictionaries("tw", "cn") == ["TSPhrases"]
    assert presets.segmentation_dictionaries("t", "tw") == []
    with pytest.raises(ValueError, match="Unknown 'from' locale: x"):
        presets.dictionary_steps("x", "t")
    with pytest.raises(ValueError, match="Unknown 'to' locale: constructor"):
        presets.dictionary_steps("t", "constructor")


def test_converters(spark):
    make = lambda s, t, **o: converter.create_converter(spark, s, t, protected=o.pop("protected", []), **o)
    assert run(spark, make("cn", "twp"), "二维码 土豆 出租车 头发") == ["QR Code 馬鈴薯 計程車 頭髮"]
    assert run(spark, make("twp", "cn"), "隨身碟 高麗菜 計程車") == ["U盘 卷心菜 出租车"]
    assert run(spark, make("twp", "t"), "土豆") == ["土豆"]
    assert run(spark, make("cn", "twp", protected=[("土豆", "洋芋")]), "土豆") == ["洋芋"]
    assert run(spark, make("t", "t"), "豈a") == ["豈a"]
    assert run(spark, converter.cn2t(spark, "tw"), "乾隆头发") == ["乾隆頭髮"]
    assert run(spark, converter.t2cn(spark, "tw"), "頭髮") == ["头发"]
    for wrong in (lambda: converter.cn2t(spark, "cn"), lambda: converter.cn2t(spark, "tw", source="hk"), lambda: converter.t2cn(spark, "cn"), lambda: converter.t2cn(spark, "tw", target="hk")):
        with pytest.raises(ValueError, match="bundle"):
            wrong()
    with pytest.warns(UserWarning, match="applyCharFixes"):
        make("cn", "tw", applyCharFixes=True)
    assert make("cn", "tw") is make("cn", "tw")


def test_preset_ignores_unknown_locales(spark):
    p = converter.LocalePreset({"a": ["x y"]}, {"b": ["y z"]})
    assert run(spark, converter.converter_from_preset(p, "a", "b"), "x") == ["z"]
    assert run(spark, converter.converter_from_preset(p, "?", "?"), "x") == ["x"]


def test_every_direction_runs(spark):
    for s in presets.LOCALES:
        for t in presets.LOCALES:
            made = converter.create_converter(spark, s, t, protected=[])
            assert made.text("") == "" and made.text("abc") == "abc"
