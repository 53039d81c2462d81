"""Odd rows, empty tables and clashing column names, for every operator and pipeline stage."""

import pytest

import corpus_pipeline
from glyphflow.llm import decontaminate, embedding_dedup, html_extract, language_id, ngram_join, pii, sentence_pieces, sharding, substring_dedup, url_filter

#: Names of results and of columns that operators use on their way.
CLASHES = (
    "id", "k1", "k2", "record", "n_words", "n_hit", "items", "spans", "score", "lang_pred", "letters", "pii_base", "pii_spans", "raw", "base", "failed", "wide", "blank", "kept", "n_removed",
    "component_id", "n_shingles", "rep", "family", "main_text", "html_", "host", "keys", "path", "words", "log_odds", "rule", "verdict", "piece_ids", "decoded", "batch", "bucket", "counts", "ids", "shard", "slot", "tie", "bytes", "Score_", "__base", "__text", "__kept",
)
LONG = "die ganze lange Geschichte von " + " ".join(f"Wort{i}" for i in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "the same words in this row twice, really the same ones", "en", None),
        (1, "the same words in this row twice, really the same ones", "en", None),
        (2, None, None, None),
        (None, "un texte français avec une clé: token = \"9f8e7d6c5b4a39281706\" et a@b.co", "fr", "s"),
        (None, "un texte français avec une clé: token = \"9f8e7d6c5b4a39281706\" et a@b.co", "fr", "s"),
        (3, "", "fr", "s"),
        (4, " \t\n", None, None),
        (5, "123 !?", None, "s"),
        (6, LONG, "de", "s"),
        (7, LONG, "de", "s"),
    ]
    return spark.createDataFrame([(*r, 1, *("v",) * len(CLASHES)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "of no document"), (2, None)], "item_id long, text string")


def keeps(df, docs, results=()):
    """Whether a result has the input's columns, but for results, with their values."""
    own = [c for c in docs.columns if c.lower() not in results]
    assert df.columns[: len(own)] == own and set(df.columns[len(own) :]) == set(results)
    extra = [c for c in CLASHES if c in own]
    return {tuple(r[c] for c in extra) for r in df.collect()} <= {("v",) * len(extra)}


def test_operators_keep_columns_of_any_name(spark, odd, bench):
    pieces = sentence_pieces.Pieces.load(sentence_pieces.default_model())
    for docs in (odd, odd.limit(0)):
        n = docs.count()
        found = language_id.predict(docs, language_id.learn(docs))
        assert keeps(found, docs, ("lang_pred", "score")) and found.count() == n
        found = pii.find_pii(docs)
        assert keeps(found, docs, ("pii_base", "pii_spans")) and found.count() == n
        found = sentence_pieces.decode(sentence_pieces.encode(docs, pieces=pieces), pieces=pieces)
        assert keeps(found, docs, ("piece_ids", "decoded")) and all(r["decoded"] == r["text"] for r in found.collect()) and found.count() == n
        for how in ("document", "span"):
            for block in (1_000_000, 1):
                assert keeps(found := decontaminate.decontaminate(docs, bench, how=how, block_windows=block), docs) and found.count() == n
        assert keeps(ngram_join.keep_first(docs, n=5, threshold=(80, 100)), docs)
        assert ngram_join.jaccard_components(docs).count() == n
        assert substring_dedup.dedup_substrings(docs, carry=("id", "kept", "k1")).columns == ["doc_id", "id", "k1", "n_words", "n_removed", "kept"]
        assert keeps(sharding.shuffle_into_shards(docs).select("record.*"), docs)
        pages = docs.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumnRenamed("source", "url")
        assert keeps(found := html_extract.extract(pages), pages, ("main_text",)) and found.count() == n
        results = ("host", "path", "words", "log_odds", "rule", "verdict")
        assert keeps(found := url_filter.judge_urls(pages), pages, results) and found.count() == n


def test_texts_that_are_equal_get_equal_answers(odd):
    for found in (language_id.predict(odd, language_id.learn(odd)).select("text", "lang_pred", "score"), pii.find_pii(odd).select("text", "pii_spans")):
        by = {}
        for text, *rest in found.collect():
            assert by.setdefault(text, rest) == rest
        assert len(by) == 7


def test_vectors_of_any_columns(spark):
    rows = [(None, [1.0, 0.0]), (None, [1.0, 0.0]), (3, None), (4, [])]
    df = spark.createDataFrame([(*r, *("v",) * 6) for r in rows], "vec_id long, embedding array<float>, dim string, q string, k1 string, links string, block string, n_links string")
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [(-1, 1, None), (-1, 1, None), (3, 0, 3), (4, 0, 4)]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, sf, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    for docs in (odd, odd.limit(0)):
        found = stage(spark, docs, sf)
        if name == "pieces":
            assert found.count() == docs.count()
            continue
        assert keeps(found, docs)
        ids = sorted(r["doc_id"] or 0 for r in found.collect())
        if name == "near_duplicates":  # the long ones are linked; ids that several rows share stay together
            assert ids == sorted(r["doc_id"] or 0 for r in docs.where("doc_id is null or doc_id != 7").collect())
        elif name == "language":
            assert ids == sorted(r["doc_id"] or 0 for r in docs.where("text rlike '[a-z]'").collect())
        else:
            assert ids == sorted(r["doc_id"] or 0 for r in docs.collect())


def test_added_spans_and_redaction(spark):
    """The method adds what the base patterns don't find, whole and however long, and redaction is linear."""
    rows = [(i, f'x = 1\ntoken = "{(f"{i * 7919:08x}" * 40)[: 24 + 8 * (i % 20)]}"\nprint(x)') for i in range(40)] + [(100 + i, f"the words of line {i}: and more of them") for i in range(40)]
    rows.append((200, " ".join(f"10.0.{i % 256}.{i % 250}" for i in range(40_000))))
    df = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: (r["text"], r["pii_base"], r["pii_spans"], r["t"]) for r in df.withColumn("t", pii.redact(df["text"], df["pii_spans"])).collect()}
    for i in range(40):
        text, base, spans, redacted = got[i]
        value = text.split('"')[1]
        assert not [s for s in base if s["kind"] == "secret"] and any(s["kind"] == "secret" and value in text[s["start"] : s["end"]] for s in spans)
        assert value[:8] not in redacted and redacted.startswith("x = 1\n") and redacted.endswith("\nprint(x)")
        assert not got[100 + i][2]
    assert got[200][3] == " ".join(["<IP>"] * 40_000)


def test_a_passage_on_most_pages_of_a_host_is_template(spark):
    own = lambda i: " ".join(chr(97 + i) + chr(97 + k % 26) * (1 + k // 26) for k in range(30))
    ad = "<p>Read our paper every day of the week</p>"
    rows = [(i, f"http://a.b/{i}", f"<html><body><article><p>{own(i)}</p>{ad}</article></body></html>") for i in range(12)]
    rows += [(50 + i, f"http://c.d/{i}", f"<html><body><article><p>{own(i)}</p>{ad if i < 3 else ''}</article></body></html>") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["main_text"] for r in html_extract.extract(pages).collect()}
    plain = {r[0]: html_extract.main_text(html_extract.parse(r[2]), "", set()) for r in rows}
    assert all(got[i] == own(i) != plain[i] for i in range(12))
    assert all(got[50 + i] == plain[50 + i] for i in range(12))


def test_rows_of_one_id_and_hash_are_told_apart(spark):
    """Texts of one id whose 32-bit hashes collide don't share their ranges."""
    one, two = " ".join(f"a{i}" for i in range(55)), " ".join(f"b{i}" for i in range(55))
    rows = [(None, one), (None, two), (7, one + " c"), (7, two)]
    got = sorted((r["n_words"], r["n_removed"]) for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(55, 0), (55, 0), (55, 55), (56, 55)]
    assert substring_dedup.level_lengths(20) == [5, 10] and substring_dedup.level_lengths(2) == [1]


def test_markup_with_stray_quotes():
    text = lambda h: html_extract.main_text(html_extract.parse(h), "", set())
    assert text("<p class=\"x\" y'z>hi</p>") == "hi"
    assert text('<p title="a>b</p>') == "b"
    assert text('<a href = "x>y" b=\'c>d\'>link</a>') == "link"
    assert text('<p id="skip-list">one</p><div class="product-notice-board">two</div><label>three</label><div class="site-footer">no</div>') == "one\n\ntwo\n\nthree"
