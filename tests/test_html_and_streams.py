import pytest
from pyspark.sql import functions as F

from glyphflow.operators.chain import chain
from glyphflow.operators.html import convert_page, html_convert, html_restore, restore_page
from glyphflow.streaming.convert import convert_stream, write_converted

FAKE = chain([[("简", "繁"), ("体", "體")]])


def go(page, slots=()):
    return convert_page(page, FAKE.text, "zh-CN", "zh-TW", list(slots))


@pytest.mark.parametrize(
    "page, want",
    [
        ('<div lang="zh-CN"><p>简体</p></div><p>简</p>', '<div lang="zh-TW"><p>繁體</p></div><p>简</p>'),
        ('<p lang="ZH-cn">简<b class="x ignore-opencc" lang="zh-CN">简</b><code lang="zh-CN">简</code><pre title="简">简</pre></p>', '<p lang="zh-TW">繁<b class="x ignore-opencc" lang="zh-CN">简</b><code lang="zh-TW">简</code><pre title="简">简</pre></p>'),
        ('<div lang="zh-CN"><p lang="">简</p><p lang=en>简</p>简</div>', '<div lang="zh-TW"><p lang="">简</p><p lang=en>简</p>繁</div>'),
        ('<div lang=zh-CN><input type="Submit" value="简"><input type=text value="简" placeholder="简"></div>', '<div lang="zh-TW"><input type="Submit" value="繁"><input type=text value="简" placeholder="繁"></div>'),
        ('<html lang="zh-CN"><meta name="description" content="简"><meta name="Keywords" content="简"><img alt="体" title=\'简"\'></html>', '<html lang="zh-TW"><meta name="description" content="繁"><meta name="Keywords" content="简"><img alt="體" title="繁&quot;"></html>'),
        ('<div lang="zh-CN">&lt;简&amp;&nbsp;<!-- 简 --><script>"简</p>"</script></div>', '<div lang="zh-TW">&lt;繁&amp;\xa0<!-- 简 --><script>"简</p>"</script></div>'),
        ("<ul lang=zh-CN><li lang=en>简<li>体</ul>体", '<ul lang="zh-TW"><li lang=en>简<li>體</ul>体'),
    ],
)
def test_convert_and_restore(page, want):
    out, slots = go(page)
    assert out == want
    assert go(restore_page(out, slots, "zh-CN"))[0] == want
    assert "繁" not in restore_page(out, slots, "zh-CN")


def test_originals_survive_a_second_conversion():
    page = '<p lang="zh-CN" title="简">简</p>'
    once, slots = go(page)
    relabelled = once.replace("zh-TW", "zh-CN")
    twice, slots = go(relabelled, slots)
    assert twice == once
    assert restore_page(twice, slots, "zh-CN") == page


def test_on_a_table(spark):
    df = spark.createDataFrame([(1, '<p lang="zh-CN">简</p>'), (2, None)], "id int, html string")
    made = html_convert(df, "html", FAKE, "zh-CN", "zh-TW")
    assert [r["html"] for r in made.orderBy("id").collect()] == ['<p lang="zh-TW">繁</p>', None]
    assert [r["html"] for r in html_restore(made, "html", "zh-CN").orderBy("id").collect()] == ['<p lang="zh-CN">简</p>', None]


def test_stream(spark, tmp_path, sf):
    stream = spark.readStream.schema(spark.read.parquet(f"{sf}/conversations.parquet").schema).parquet(f"{sf}/conversations*.parquet")
    made = convert_stream(stream, "text", chain([[("the", "THE")]]))
    write_converted(made, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = spark.read.parquet(f"{sf}/conversations.parquet").withColumn("text", F.regexp_replace("text", "the", "THE"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
