"""The text operators against plain versions, on documents made to be awkward."""

import hashlib
import random
import re
import time
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glyphflow.llm import common, decontaminate, language_id, ngram_join, pii, sentence_pieces, sharding, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, unit string, batch string, rows string, a int, shard string"


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(400)] + ["the", "of", "and", "A", "B", "漢字", "😀"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = [None, "", " \t\n", "one", "one two", "The the THE", "a" * 30_000, "x " * 3_000]
    for i in range(40):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(5, 200))]
        if i % 4 == 0:
            body[3:3] = passage.split()
        texts.append(rng.choice((" ", "\n", "  ")).join(body))
        if i % 3 == 0:
            near = list(body)
            for _ in range(rng.randint(0, 6)):
                near[rng.randrange(len(near))] = "changed"
            texts += [" ".join(near), texts[-1]]
    ids = list(range(0, 10 * len(texts), 10))
    rng.shuffle(ids)
    return list(zip(ids, texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "x", "x", "x", 1, "x") for i, t in rows], SCHEMA).repartition(3)


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, lower=False):
    t = text or ""
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t) if lower else t)


def plain_dedup(rows, window=20):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), (i, p))
    out = {}
    for i, t in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (i, p):
                gone.update(range(p, p + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("window", [20, 5, 2])
def test_substring_dedup(docs, window):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.dedup_substrings(docs, window=window).collect()}
    assert got == plain_dedup(ROWS, window)


def test_substring_dedup_edges(spark, nothing):
    assert substring_dedup.dedup_substrings(nothing).count() == 0
    long = " ".join(f"v{i}" for i in range(25))
    rows = [(5, long), (5, long), (None, long), (7, "q " + long)]
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in substring_dedup.dedup_substrings(frame(spark, rows), carry=("id", "source")).collect())
    assert got == [(-1, 0), (5, 25), (5, 25), (7, 25)]
    same = substring_dedup.dedup_substrings(frame(spark, [(5, long), (5, long)])).collect()
    assert [r["n_removed"] for r in same] == [0, 0]


def test_substring_dedup_drops_the_shuffles_of_its_levels(spark, docs):
    """A level's shuffle files don't stay beside those of the next ones until the driver collects its garbage."""
    folders = [f.getPath() for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {p for f in folders for p in Path(f).glob("*/shuffle_*.data")}
    setting, before = spark.conf.get(common._CLEANUP, None), files()
    found = substring_dedup.dedup_substrings(docs)
    until = time.monotonic() + 10
    while files() - before and time.monotonic() < until:  # they are deleted in the background
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(common._CLEANUP, None) == setting
    assert found.count() == len(ROWS) and files() - before  # the caller's own query keeps its files


def plain_components(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = words(t, lower=True)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                label[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n, num, den, seed", [(3, 90, 100, 3), (5, 80, 100, 3), (2, 60, 100, 4), (1, 100, 100, 3)])
def test_ngram_join(spark, n, num, den, seed, monkeypatch):
    rows = corpus(seed)
    for limit in ("CHUNK_DOCS", "CHUNK_MARKS") if n == 5 else ():
        monkeypatch.setattr(ngram_join, limit, 3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(frame(spark, rows), n=n, threshold=(num, den)).collect()}
    assert got == plain_components(rows, n, num, den)


def test_ngram_join_edges(spark, nothing):
    assert ngram_join.jaccard_components(nothing).count() == 0
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "e f g"), (9, "E F G"), (10, None), (11, "")]
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["component_id"]) for r in ngram_join.jaccard_components(frame(spark, rows)).collect())
    assert got == [(-1, None), (4, None), (4, None), (9, None), (10, 10), (11, 11)]
    kept = ngram_join.keep_first(frame(spark, [(1, "a b c d"), (2, "a b c d"), (3, "z")]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3] and kept.columns == frame(spark, []).columns


def test_ngram_join_of_a_large_tight_group(spark):
    base = [f"t{i}" for i in range(120)]
    rng = random.Random(1)
    rows = [(i, " ".join(w if rng.random() > 0.004 else f"u{i}" for w in base)) for i in range(300)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(frame(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in plain_components(rows, 3, 90, 100).items()}


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_decontamination(spark, docs, nothing):
    rng = random.Random(9)
    texts = [t for _, t in ROWS if t and len(words(t)) > 40]
    items = [(i, " - ".join(words(t)[2:30])) for i, t in enumerate(rng.sample(texts, 6))] + [(90, "w1é, W2É!"), (91, None), (92, "..."), (93, "one"), (93, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: ITEM_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = [(i, tuple(w[k : k + min(10, len(w))])) for i, t in items for w in [split(t)] for k in range(max(1, len(w) - 9)) if w]
    want = {}
    for i, t in ROWS:
        w, hit, found = split(t), set(), set()
        for item, g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    found.add(str(item))
        want[i] = (len(w), len(hit), sorted(found))
    for block in (1_000_000, 1):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.find_contamination(docs, bench, block_windows=block).collect()}
        assert got == want
    assert decontaminate.find_contamination(nothing, bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    clean = decontaminate.decontaminate(docs, bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(i for i, v in want.items() if not v[1]) and clean.columns == docs.columns
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, how="span").collect()}
    for i, t in ROWS:
        assert (split(cut[i]) == [x for x in split(t)][: want[i][0]]) if not want[i][1] else len(split(cut[i])) == want[i][0] - want[i][1]


def test_sharding(spark, docs, nothing):
    for size in (1 << 25, 2_000):
        rows = sharding.shuffle_into_shards(docs, bucket_bytes=size).select("record.doc_id", "shard", "slot").collect()
        again = sharding.shuffle_into_shards(docs, bucket_bytes=size).select("record.doc_id", "shard", "slot").collect()
        assert sorted(rows) == sorted(again) and sorted(r[0] for r in rows) == sorted(i for i, _ in ROWS)
        for s in {r["shard"] for r in rows}:
            own = sorted(r["slot"] for r in rows if r["shard"] == s)
            assert own == list(range(len(own))) and 0 <= s < 40
    ids = spark.range(2000)
    moved = ids.select(sharding.shard_of(F.col("id"), 40).alias("a"), sharding.shard_of(F.col("id"), 41).alias("b")).where("a != b")
    assert {r["b"] for r in moved.collect()} == {40} and moved.count() > 10
    assert sharding.shuffle_into_shards(nothing).count() == 0
    odd = frame(spark, [(None, "a"), (None, "a"), (1, None)])
    rows = sharding.shuffle_into_shards(odd).select("record.doc_id", "record.text", "shard", "slot").collect()
    assert len({(r["shard"], r["slot"]) for r in rows}) == 3
    assert (odd.select(sharding.crc32_of(F.lit("é漢"))).first()[0]) == zlib.crc32("é漢".encode())


def test_written_shards(spark, docs, tmp_path):
    sharding.write_shards(docs.select("doc_id", "text"), str(tmp_path / "s"), n_shards=4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ROWS)


def test_language_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(900, None, None), (901, "123 !?", "en"), (902, "é" * 5000, None)], "doc_id long, text string, lang string")
    docs = docs.select("doc_id", "text", "lang").union(odd)
    got = {r["doc_id"]: r for r in language_id.predict(docs, language_id.learn(docs)).collect()}
    held = [r for r in got.values() if r["doc_id"] < 900 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 20 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert (got[900]["lang_pred"], got[900]["score"], got[901]["lang_pred"]) == ("und", 0.0, "und")
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.predict(none, language_id.learn(none)).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), None).count() == 0


def test_gradients_are_right():
    import numpy as np

    net = language_id.train([b"abcab", b"xyzzy"], ["p", "q"], hidden=3, updates=1)
    for w in [*net.inputs, *net.recurrent]:
        w[...] = np.random.default_rng(0).standard_normal(w.shape) * 0.3
    x = np.frombuffer(b"abcdxyzb", dtype=np.uint8).reshape(1, 8)
    for d in (0, 1):
        grad = np.random.default_rng(1).standard_normal((8, 1, 3)).astype(np.float32)
        d_in, d_rec = language_id._backward(net, x, net.states(x, d), grad, d)
        for w, g in ((net.inputs[d], d_in), (net.recurrent[d], d_rec)):
            for at in [(ord("a"), 0), (ord("b"), 4), (ord("b"), 8)] if w is net.inputs[d] else [(0, 0), (1, 4), (2, 8)]:
                old, e = w[at], 1e-2
                w[at] = old + e
                up = (net.states(x, d) * grad).sum()
                w[at] = old - e
                down = (net.states(x, d) * grad).sum()
                w[at] = old
                assert abs((up - down) / (2 * e) - g[at]) < 2e-2


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    for k, p in PATTERNS.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if k == "ip" and max(map(int, m[0].split("."))) > 255 or k == "card" and not (13 <= len(d) <= 19 and luhn(d)) or k == "phone" and not 9 <= len(d) <= 15:
                continue
            yield k, m.start(), m.end()


def test_pii(spark, nothing):
    rng = random.Random(5)
    parts = ["1.2.3.4", "999.1.1.1.1", "4111 1111 1111 1111", "4111111111111111", "+1 (234) 555-1234", "a@b.c_x@y.zz", "x@y", "..@a.b", "0000255.1.1.1", " ", "-", ".", "\n", "é", "😀", "12", "+", "(555) 123-4567", "password=hunter2abc99 ", "joe [at] mail [dot] com", "@", "%", "abc"]
    texts = [None, "", "9" * 2000, "1 " * 2000, "1." * 2000, "+1" + "(" * 2000, "a." * 300 + "@b" + ".c" * 2000] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    df = frame(spark, list(enumerate(texts)))
    weights = pii.fit(pii.vote_counts(df))
    for r in pii.find_pii(df, weights=weights).collect():
        base, every = [tuple(x) for x in r["pii_base"]], [tuple(x) for x in r["pii_spans"]]
        assert base == list(base_spans(r["text"]))
        assert set(base) <= set(every)
        assert all(e <= s or b >= f for _, b, e in set(every) - set(base) for _, s, f in base)
    assert pii.find_pii(nothing).count() == 0
    assert pii.find_pii(frame(spark, [(1, "clean text only")])).first()["pii_spans"] == []


def test_redaction(spark):
    df = pii.find_pii(frame(spark, [(1, "é a@b.co and 10.0.0.1!"), (2, None), (3, "none")]))
    got = {r["doc_id"]: r["t"] for r in df.select("doc_id", pii.redact(F.col("text"), F.col("pii_spans")).alias("t")).collect()}
    assert got == {1: "é <EMAIL> and <IP>!", 2: None, 3: "none"}


def test_reliabilities_follow_the_votes():
    row = lambda origin, s, g, c, n: {"origin": origin, "kind": "phone", "shape": s, "gazetteer": g, "context": c, "size": 1, "count": n}
    p = pii.reliabilities([row("base", 1, 1, 1, 300), row("failed", 0, 0, -1, 300), row("wide", 1, 1, 1, 20), row("wide", 0, 0, -1, 20)])
    assert p["phone", "wide", 1, 1, 1] > 0.9 and p["phone", "wide", 0, 0, -1] < 0.1


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.Pieces.load(sentence_pieces.default_model())


def test_pieces(spark, docs, nothing, pieces):
    odd = [(10_000, "  a  b \n\t▁x <s> <0x41> \u0001"), (10_001, " " * 70), (10_002, "q" * 300), (10_003, "Ünïcödé 漢字 😀"), (10_003, "again"), (10_004, "a\0b\0\0c \0"), (10_005, "the" * 700), (10_006, "the" * 700)]
    df = docs.union(frame(spark, odd))
    encoded = sentence_pieces.encode(df, pieces=pieces)
    rows = sentence_pieces.decode(encoded, pieces=pieces).collect()
    assert len(rows) == len(ROWS) + len(odd) and encoded.columns == [*df.columns, "piece_ids"]
    for r in rows:
        assert r["decoded"] == r["text"]
        if r["text"] is None:
            assert r["piece_ids"] is None
        else:
            assert r["piece_ids"] == (pieces.split(" " + r["text"]) if r["text"] else [])  # the best split of the whole text, uncut
    assert sentence_pieces.encode(nothing, pieces=pieces).count() == 0
    named = df.limit(3).selectExpr("doc_id", "text", "1 AS piece_ids", "2 AS Decoded", "3 AS batch", "4 AS counts")
    again = sentence_pieces.decode(sentence_pieces.encode(named, pieces=pieces), pieces=pieces)
    assert again.columns == ["doc_id", "text", "batch", "counts", "piece_ids", "decoded"] and all(r["decoded"] == r["text"] for r in again.collect())


def test_units_of_one_hash_are_told_apart(pieces, monkeypatch):
    import numpy as np
    import pyarrow as pa

    texts = pa.array(["the cat, the hat", None, "", "a cat"])
    want = [t for s in sentence_pieces._slices(pieces, texts) for t in [s.data[a : a + n].tobytes().decode() for a, n in zip(s.start.tolist(), s.size.tolist())]]
    real = sentence_pieces._unit_hashes
    monkeypatch.setattr(sentence_pieces, "_unit_hashes", lambda *a: (real(*a)[0] & np.uint64(1), real(*a)[1]))
    slices = list(sentence_pieces._slices(pieces, texts))
    units, _, _, places = sentence_pieces._distinct(slices)
    assert units.take(pa.array(places[0])).to_pylist() == want and len(units) == len(set(want)) and "".join(want) == " the cat, the hat a cat"


def test_split_is_the_best_split(pieces):
    def best(unit):
        if not unit:
            return 0.0
        return max(s + best(unit[n:]) for n in range(1, min(16, len(unit)) + 1) for s in [pieces.by_text.get(unit[:n], (pieces.unknown if n == 1 else None,))[0]] if s is not None)

    score = {i: s for s, i in pieces.by_text.values()}
    for unit in (" the", " thereon", "ab#x"):
        assert sum(score.get(i, 0.0) for i in pieces.split(unit)) == best(unit)


def test_query_columns(spark, sf):
    got = {r["doc_id"]: r["kept_sha256"] for r in substring_dedup.query(spark, sf).collect()}
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got == {i: hashlib.sha256(kept.encode()).hexdigest() for i, (_, _, kept) in plain_dedup(texts).items()}
