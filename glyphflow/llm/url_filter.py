"""URL filters: host word segmentation and naive Bayes, after explicit rules.

A url's host labels and path parts are split into words: at every character that
isn't a letter, and inside a run of letters by a unigram Viterbi search over known
words, where an unknown word costs more the longer it is.  Multinomial naive Bayes
scores the words for the classes allow and block; unknown words say nothing.  A url is
blocked if its log-odds of block are above ``MARGIN``.

Both models are learnt from the urls themselves, counted over all of them in Spark:

* The unigrams are the letter runs that stand on at least ``MIN_HOSTS`` different hosts,
  counted by host, so that one busy site's name isn't a word; with ``SEED_WORDS`` they are
  at most ``MOST_WORDS``, those on the most hosts.
* The classes are learnt from the urls whose verdict a rule gives, by host again and
  without the words that rules name, and from ``SEED_WORDS``.  Urls without
  rules get their verdict from these words.

Rules come first: (host with path, verdict); a rule fits its host and every subdomain if
the url's path starts with the rule's path, and the longest fitting rule wins.

Defined results: a null url or one without ``://`` has an empty host and path, fits no
rule and is allowed; repeated urls get equal answers and count once for each host; of equally
good splits one with an unknown last word wins, or else a longer one; urls are read whole, in time
in proportion to their length; an empty table gives no rows and a model of the seeds alone; columns of
``pages`` stay, but for ones named like a result, which give way to it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, table, without

#: Words of each class that are known beforehand, by topic; the counts of a corpus are added to them.
SEED_WORDS = {
    "block": (
        "casino", "poker", "roulette", "blackjack", "jackpot", "lottery", "slots", "gambling", "betting", "bets", "bookmaker",
        "pharmacy", "pills", "viagra", "cialis", "steroids", "meds",
        "porn", "porno", "xxx", "sex", "adult", "nude", "escort", "hentai", "camgirls",
        "spam", "phishing", "malware", "keygen", "warez", "crack", "cracked", "torrent", "hacked",
        "ads", "adserver", "adtracker", "popup", "popunder", "clickbait", "backlinks", "payday", "loans", "replica",
    ),
    "allow": (
        "news", "journal", "magazine", "article", "articles", "press", "radio", "weather", "sports",
        "university", "college", "school", "library", "museum", "research", "science", "history", "archive", "encyclopedia", "wiki", "education",
        "health", "hospital", "medicine", "recipes", "kitchen", "garden", "travel", "hotel", "city", "council", "government",
        "music", "film", "theatre", "books", "poetry", "photo", "gallery", "art",
        "blog", "forum", "docs", "manual", "help", "support", "developer", "software", "shop", "store",
    ),
}
#: What a seed word counts as in its class, in hosts.
SEED_HOSTS = 10
#: Log-odds above which a url is blocked: common words differ a little between the classes by chance.
MARGIN = 1.0
MIN_HOSTS = 2
MOST_WORDS = 100_000
#: Shorter words are known only where they stand alone, longer ones not at all.
LEAST_LETTERS, MOST_LETTERS = 3, 24
#: What each letter of an unknown word costs beyond the rarest known one.
_LETTER = 1.3
_LETTERS = r"[^\W\d_]+"

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


class UrlModel:
    """Word probabilities for the segmentation, and log-odds of block for each word; what workers get is this very object.

    hosts: on how many hosts a word stands; block, allow: on how many of those in urls of that
    class; urls: how many hosts have urls of each class.
    """

    def __init__(self, hosts: dict[str, int] | None = None, block: dict[str, int] | None = None, allow: dict[str, int] | None = None, urls: tuple[int, int] = (0, 0), seeds: dict[str, tuple[str, ...]] | None = None):
        seeds = seeds or SEED_WORDS
        words = {w: n for w, n in (hosts or {}).items() if len(w) >= LEAST_LETTERS}
        counts = {"block": dict(block or {}), "allow": dict(allow or {})}
        for c, own in seeds.items():
            for w in own:
                words[w] = words.get(w, 0) + SEED_HOSTS
                counts[c][w] = counts[c].get(w, 0) + SEED_HOSTS
        self.total = sum(words.values())
        self.log_word = {w: math.log(n / self.total) for w, n in words.items()}
        self.longest = max(map(len, self.log_word))
        known = set(counts["block"]) | set(counts["allow"])
        size = {c: sum(x.values()) + len(known) for c, x in counts.items()}
        self.odds = {w: math.log((counts["block"].get(w, 0) + 1) / size["block"]) - math.log((counts["allow"].get(w, 0) + 1) / size["allow"]) for w in known}
        self.prior = math.log((urls[0] + 1) / (urls[1] + 1))

    def segment(self, run: str) -> tuple[str, ...]:
        """The most probable split of a run of letters."""
        unknown = -math.log(self.total)
        best = [(0.0, 0)]
        known_from = [0.0]  # the best score of a split that ends with an unknown word, and where that word starts
        start_of = [0]
        for end in range(1, len(run) + 1):
            # an unknown word either grows by a letter or starts here
            grown, fresh_one = known_from[-1] - _LETTER if end > 1 else -math.inf, best[end - 1][0] + unknown - _LETTER
            score, start = (grown, start_of[-1]) if grown >= fresh_one else (fresh_one, end - 1)
            known_from.append(score)
            start_of.append(start)
            for s in range(max(0, end - self.longest), end):
                p = self.log_word.get(run[s:end])
                if p is not None and best[s][0] + p > score:
                    score, start = best[s][0] + p, s
            best.append((score, start))
        out, at = [], len(run)
        while at:
            start = best[at][1]
            out.append(run[start:at])
            at = start
        return tuple(reversed(out))

    def words(self, host: str, path: str) -> list[str]:
        return [w for run in re.findall(_LETTERS, f"{host} {path}".lower()) for w in self.segment(run)]

    def log_odds(self, words: list[str]) -> float:
        """Above 0 speaks for block; a url of unknown words has no more than that."""
        known = [self.odds[w] for w in words if w in self.odds]
        return self.prior + sum(known) if known else min(self.prior, 0.0)


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", n)


def host_of(url: Column) -> Column:
    return F.translate(_part(url, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return _part(url, 2)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """(rule, verdict) of the longest fitting rule, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own_host, slash, rest = rule.partition("/")
        fits = ((host == own_host) | F.endswith(host, F.lit("." + own_host))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def learn(pages: DataFrame, url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, most_words: int = MOST_WORDS) -> UrlModel:
    """A model of all urls of ``pages``; at most ``most_words`` counts and one total reach the driver."""
    url = F.col(f"`{url_col}`")
    rows = pages.select(host_of(url).alias("host"), path_of(url).alias("path")).where("host != ''")
    rows = rows.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    runs = F.regexp_extract_all(F.lower(F.concat_ws(" ", "host", "path")), F.lit(r"\p{L}+"), F.lit(0))
    named = sorted({w for rule, _ in rules for w in re.findall(_LETTERS, rule.lower())})
    # by host first, so that a busy host counts once and its rows are gathered by no one task
    pairs = rows.select("host", F.col("rule.verdict").alias("verdict"), F.explode(F.array_distinct(F.concat(runs, F.array(F.lit(""))))).alias("word"))
    pairs = pairs.where(F.length("word") <= MOST_LETTERS)
    told = F.when(~F.col("word").isin(named), F.col("verdict"))
    by_host = pairs.groupBy("host", "word").agg(F.max(told == "block").cast("int").alias("block"), F.max(told == "allow").cast("int").alias("allow"))
    counts = by_host.groupBy("word").agg(F.count("*").alias("hosts"), F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    kept = counts.where((F.col("hosts") >= MIN_HOSTS) | (F.col("word") == "")).orderBy(F.col("word") != "", F.desc("hosts"), "word").limit(most_words + 1).collect()
    known = [r for r in kept if r["word"]]
    total = next(((r["block"] or 0, r["allow"] or 0) for r in kept if not r["word"]), (0, 0))  # each url has the empty word
    return UrlModel({r["word"]: r["hosts"] for r in known}, {r["word"]: r["block"] for r in known if r["block"]}, {r["word"]: r["allow"] for r in known if r["allow"]}, total)


def judge_urls(pages: DataFrame, url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, model: UrlModel | None = None) -> DataFrame:
    """``pages`` with host, path, words, log_odds, rule, verdict; without a model one is learnt from these pages."""
    sent = pages.sparkSession.sparkContext.broadcast(model or learn(pages, url_col, rules))

    @F.pandas_udf("words array<string>, log_odds double")
    def scored(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: UrlModel = sent.value
        seen: dict[str, tuple[str, ...]] = {}
        for pdf in parts:
            seen.clear()  # runs that recur in a batch are split once
            words = []
            for host, path in zip(pdf["host"].tolist(), pdf["path"].tolist()):
                found: list[str] = []
                for run in re.findall(_LETTERS, f"{host} {path}".lower()):
                    if run not in seen:
                        seen[run] = own.segment(run)
                    found += seen[run]
                words.append(found)
            yield pd.DataFrame({"words": words, "log_odds": [own.log_odds(w) for w in words]})

    pages = without(pages, ("host", "path", "words", "log_odds", "rule", "verdict"), url_col)
    url = F.col(f"`{url_col}`")
    score, rule, parts = (fresh(pages, x) for x in ("scored", "fits", "parts"))
    split = pages.withColumn(parts, F.struct(host_of(url).alias("host"), path_of(url).alias("path")))
    found = split.withColumn(score, scored(F.col(parts))).withColumn(rule, rule_for(F.col(parts)["host"], F.col(parts)["path"], rules))
    verdict = F.coalesce(F.col(rule)["verdict"], F.when(F.col(score)["log_odds"] > MARGIN, "block").otherwise("allow"))
    results = {"host": F.col(parts)["host"], "path": F.col(parts)["path"], "words": F.col(score)["words"], "log_odds": F.col(score)["log_odds"], "rule": F.col(rule)["rule"], "verdict": verdict}
    return found.select(*(F.col(f"`{c}`") for c in pages.columns if c not in results), *(c.alias(k) for k, c in results.items()))


def query(spark, sf_dir: str) -> DataFrame:
    """The contract of op4: host, path, rule and verdict of every url."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
