"""Personal data by weak supervision, with DataFrame functions only.

Base spans are what fixed patterns find: email addresses, IPv4 addresses, card numbers
that pass Luhn's check, and international phone numbers.  They always stand.

Further spans come from wider candidate patterns (national phone numbers, spelt-out
email addresses, IPv6 addresses, credentials).  Three labelers vote on each candidate,
and on base matches, kept or failed, as well: a strict shape (regex), a list of known
prefixes, endings and key names (gazetteer), and cue words shortly before (context).
The vote patterns are counted over the whole corpus; expectation-maximisation over
these few counts estimates how reliable each labeler is on each kind and how likely a
candidate with given votes is real.  A logistic classifier over votes, kind, length, kinds
of characters and their variety is then fitted to those probabilities, and adds the
candidates it is sure of.  What
reaches the driver is one row for each pattern of votes and features, whatever the corpus.

Places come from splitting a text at the matches of a pattern: lengths of gaps and
matches add up to code point offsets.  Wider patterns see blanks where base spans are, so
nothing they find overlaps one.  Parts of a text are taken from its UTF-32 form, where
each is found at once.  All patterns are written so that a text of any length and content
is scanned in linear time without recursion, and so is a redaction.

Defined results: a null text is empty and has no spans; spans of one kind never overlap;
an added span never overlaps a base span; repeated rows are judged row by row, and each
counts in the estimates; texts are read whole, whatever their length; an empty table
gives no rows; columns of ``docs`` stay, but for ones named ``pii_base`` or ``pii_spans``,
which give way to the results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, table, without

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")

# A run is entered at its first character only (or where the last match ended), and left
# without giving back: the same matches as with plain greedy patterns, in linear time.
_LOCAL = "[A-Za-z0-9._%+-]"
_EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A whole run of digits with single separators; other lengths than 13 to 19 digits fail anyway.
_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

# A credential is a key, '=' or ':' and a value of any length, with white space and quotes (escaped ones, too) as they come.
# Keys are entered at their first character only.  A quoted value that may hold white space wants a telling key: else
# it could swallow a credential inside.  Nor may a value be such a key itself, or what follows a url's scheme.
_NAMED = r"(?i:pass(?:word|wd|phrase)|pwd|secret|token|(?:api|access|private)[_-]?key|auth|credential)"
_KEY = r"(?![0-9])[A-Za-z0-9_-]{3,}+"
_SEPARATOR = r"\\?[\"']?\s*+(?::=|=>|[=:])\s*+"
_NO_KEY = rf"(?!//)(?![A-Za-z0-9_-]*?{_NAMED}[A-Za-z0-9_-]*+\\?[\"']?\s*+[=:])"
_PLAIN = rf"\\?[\"']?{_NO_KEY}[^\s\"'<>,;&]{{8,}}+[\"']?"
_QUOTED = r"\\?\"[^\"\r\n]{8,}+\"|\\?'[^'\r\n]{8,}+'"
_SECRET = rf"(?<![A-Za-z0-9_-])(?:(?=[A-Za-z0-9_-]*?{_NAMED}){_KEY}{_SEPARATOR}(?:{_QUOTED}|(?:(?i:bearer|basic|token)\s++)?{_PLAIN})|{_KEY}{_SEPARATOR}{_PLAIN})"

#: Candidates beyond the base patterns: (kind, pattern).
_WIDE = (
    ("phone", r"(?<![0-9+().-])(?<![0-9+] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])"),
    ("secret", rf"{_SECRET}|(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[A-Z0-9]{{16}}(?![A-Za-z0-9])|gh[a-z]_[A-Za-z0-9]{{36}}(?![A-Za-z0-9]))"),
)
#: What the shape labeler wants of a candidate or base match.
_SHAPES = {
    "email": r"(?i)^[a-z0-9][a-z0-9._%+-]*(?:@| ?[\[(]at[\])] ?)[a-z0-9].*[a-z]{2,}$",
    "ip": rf"^(?:{_OCTET}(?:\.{_OCTET}){{3}}|[0-9A-Fa-f:]{{15,39}})$",
    "card": r"^(?:4[0-9]{12}(?:[0-9]{3})?|(?:5[1-5]|2[2-7])[0-9]{14}|3[47][0-9]{13}|6[0-9]{15,18})$",
    "phone": r"^(?:\+[1-9]|\([2-9]|[2-9])",
    "secret": r"(?s)^(?=.*[0-9])(?=.*[A-Za-z]).{12,}$",
}
_GAZETTEER = {
    "email": r"(?i)(?:\.|dot[\])] ?)(?:com|org|net|edu|gov|io|info|de|fr|es|it|uk|eu|ch|at)$",
    "ip": r"^(?:[1-9]|[0-9A-Fa-f]{1,4}:)",
    "card": r"^(?:4|5[1-5]|34|37|6011|65|35)",
    "phone": r"^(?:\+1|\+3[0-9]|\+4[0-9]|\+[5-9]|\()",
    "secret": rf"^(?:[A-Za-z0-9_-]*{_NAMED}[A-Za-z0-9_-]*{_SEPARATOR}|(?:{_KEY}{_SEPARATOR}\\?[\"']?)?(?:AKIA|ASIA|gh[a-z]_))",
}
_CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|address)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|from|login)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|payment|cc)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|contact)\b",
    "secret": r"(?i)\b(?:password|login|key|credential|secret|token|aws)\b",
}
_CONTEXT_CHARS = 30
ACCEPT = 0.9
VOTERS = ("shape", "gazetteer", "context")
TRAITS = ("size", "chars", "variety")
_PART = 100
_SPAN = "array<struct<kind:string,start:int,end:int,s:string>>"


def _located(text: Column, kind: str, pattern: str, present: Column) -> Column:
    """All matches of a pattern with their code point offsets."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    none = F.expr(f"cast(array() as {_SPAN})")

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), pair["match"].alias("s"))
        return F.when(pair["match"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out")))

    def shift(acc: Column, part: Column) -> Column:
        moved = F.transform(part["out"], lambda x: F.struct(x["kind"].alias("kind"), (x["start"] + acc["at"]).alias("start"), (x["end"] + acc["at"]).alias("end"), x["s"].alias("s")))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    # A fold copies what it has gathered at every step, so matches are folded some at a time and the parts put together.
    def all_parts(p: Column) -> Column:
        part = lambda c: F.aggregate(F.slice(p, c * _PART + 1, F.lit(_PART)), F.struct(F.lit(0).alias("at"), none.alias("out")), step)
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _PART).cast("int")), part)

    # A list of one binds its value to the lambda's variable: it is made once, not at each mention.
    parts = F.transform(F.array(pairs), all_parts)[0]
    gathered = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array(none).alias("out")), shift)["out"]
    return F.when(present, F.flatten(gathered)).otherwise(none)


def _luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return _luhn(F.translate(s, " -", ""))
    if kind == "phone":
        return F.length(F.translate(s, "+ ().-", "")).between(9, 15)
    return F.lit(True)


def _checked(spans: Column, kind: str, want: bool) -> Column:
    return F.filter(spans, lambda x: _valid(kind, x["s"]) == want)


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is made once, not at each mention."""
    return F.transform(F.array(value), use)[0]


def _wide_text(text: Column) -> Column:
    return F.encode(text, "UTF-32")


def _cut(wide: Column, start: Column, n: Column) -> Column:
    """Some code points of a text in UTF-32."""
    return F.decode(F.substring(wide, start * 4 + 1, n * 4), "UTF-32")


def _replaced(text: Column, spans: Column, by) -> Column:
    """The text with each span, or run of overlapping spans, replaced by what ``by`` makes of its (kind, size); a span that starts in another one counts to it."""
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:string,size:int>>)")

    def step(acc: Column, x: Column) -> Column:
        new = F.struct(acc["at"].alias("start"), x["start"].alias("end"), x["kind"].alias("kind"), (x["end"] - x["start"]).alias("size"))
        last = F.element_at(acc["out"], -1)
        longer = F.struct(last["start"].alias("start"), last["end"].alias("end"), last["kind"].alias("kind"), (last["size"] + F.greatest(x["end"] - acc["at"], F.lit(0))).alias("size"))
        out = F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.array(new))).otherwise(F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(longer)))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    # A fold copies what it has gathered at every step, so spans are folded some at a time; a part takes the last run of the one before along.
    def part(sorted_: Column):
        def fold(acc: Column, k: Column) -> Column:
            kept = F.slice(acc["open"], F.lit(1), F.greatest(F.size(acc["open"]) - 1, F.lit(0)))
            begin = F.struct(acc["at"].alias("at"), F.slice(acc["open"], F.greatest(F.size(acc["open"]), F.lit(1)), F.lit(1)).alias("out"))
            more = F.aggregate(F.slice(sorted_, k * _PART + 1, F.lit(_PART)), begin, step)
            return _bound(more, lambda m: F.struct(m["at"].alias("at"), F.concat(acc["done"], F.array(kept)).alias("done"), m["out"].alias("open")))

        return fold

    def runs(sorted_: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array(none).alias("done"), none.alias("open"))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(sorted_) - 1) / _PART).cast("int")), begin, part(sorted_))

    def whole(wide: Column, found: Column) -> Column:
        pieces = F.transform(F.flatten(F.concat(found["done"], F.array(found["open"]))), lambda r: F.concat(_cut(wide, r["start"], r["end"] - r["start"]), by(r["kind"], r["size"])))
        return F.concat(F.array_join(pieces, ""), _cut(wide, found["at"], F.lit(1 << 28)))

    by_start = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    new = _bound(by_start, lambda o: _bound(runs(o), lambda found: _bound(_wide_text(text), lambda wide: whole(wide, found))))
    return F.when(F.size(spans) == 0, text).otherwise(new)


def _matches(docs: DataFrame, text_col: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with base (spans that stand), failed (base matches that don't) and wide (candidates beyond), and the names of these columns.

    Failed matches and candidates come with the text before them.
    """
    name = {k: fresh(docs, k) for k in ("raw", "base", "failed", "wide", "blank")}
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    digit = text.rlike("[0-9]")
    present = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+"))}
    raw = F.struct(*(_located(text, k, p, present[k]).alias(k) for k, p in zip(BASE_KINDS, (_EMAIL, _IP, _CARD, _PHONE))))
    out = docs.withColumn(name["raw"], raw)
    of = lambda k: F.col(name["raw"])[k]
    base = F.concat(*(_checked(of(k), k, True) for k in BASE_KINDS))
    failed = F.concat(*(_checked(of(k), k, False) for k in BASE_KINDS if k != "email"))
    out = out.withColumns({name["base"]: base, name["failed"]: failed}).drop(name["raw"])
    out = out.withColumn(name["blank"], _replaced(text, F.col(name["base"]), lambda kind, size: F.repeat(F.lit("\n"), size)))
    blank = F.col(name["blank"])
    maybe = {"phone": blank.rlike("[0-9]"), "email": blank.rlike(r"[\[(]at[\])]"), "ip": F.contains(blank, F.lit(":")), "secret": blank.rlike("[=:]|AKIA|ASIA|gh[a-z]_")}
    out = out.withColumn(name["wide"], F.concat(*(_located(blank, k, p, maybe[k]) for k, p in _WIDE))).drop(name["blank"])
    return out, name


def _in_context(spans: Column, text: Column) -> Column:
    """The spans with the text before each of them."""
    none = F.expr(f"cast(array() as {_SPAN[:-2]},before:string>>)")

    def seen(wide: Column) -> Column:
        before = lambda x: _cut(wide, F.greatest(x["start"] - _CONTEXT_CHARS, F.lit(0)), F.least(x["start"], F.lit(_CONTEXT_CHARS)))
        return F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"), before(x).alias("before")))

    return F.when(F.size(spans) == 0, none).otherwise(_bound(_wide_text(text), seen))


def _by_kind(kind: Column, rules: dict[str, str], s: Column, clean: bool = False) -> Column:
    out = F.lit(False)
    for k, pattern in rules.items():
        out = F.when(kind == k, (F.translate(s, " -", "") if clean and k == "card" else s).rlike(pattern)).otherwise(out)
    return out


def _votes(span: Column) -> list[Column]:
    """1 for, 0 against; the context labeler abstains with -1 where it sees no cue."""
    kind, s = span["kind"], span["s"]
    vote = lambda c: F.when(c, 1).otherwise(0)
    return [vote(_by_kind(kind, _SHAPES, s, clean=True)), vote(_by_kind(kind, _GAZETTEER, s, clean=True)), F.when(_by_kind(kind, _CUES, span["before"]), 1).otherwise(-1)]


def _traits(span: Column) -> dict[str, Column]:
    """What the classifier sees besides the votes: length, kinds of characters, and their variety over the last 64."""
    n, s = span["end"] - span["start"], span["s"]
    has = [F.when(s.rlike(p), bit).otherwise(0) for bit, p in ((1, "[A-Z]"), (2, "[a-z]"), (4, "[0-9]"), (8, r"[^A-Za-z0-9\s]"))]
    variety = F.size(F.array_distinct(F.split(F.substring(s, -64, 64), "")))
    return {"size": F.when(n < 13, 0).when(n < 24, 1).otherwise(2), "chars": sum(has[1:], has[0]), "variety": F.when(variety < 8, 0).when(variety < 14, 1).otherwise(2)}


def vote_counts(docs: DataFrame, text_col: str = "text") -> list[dict]:
    """How often each pattern of votes and traits occurs, over all candidates of all texts: rows in proportion to these patterns."""
    m, name = _matches(docs.select(F.col(f"`{text_col}`").alias("text")), "text")
    groups = ("base", "failed", "wide")
    tagged = lambda o: F.transform(_in_context(F.col(name[o]), F.coalesce("text", F.lit(""))), lambda x: F.struct(F.lit(o).alias("origin"), x.alias("span")))
    some = m.where(sum((F.size(name[o]) for o in groups[1:]), F.size(name[groups[0]])) > 0)
    every = some.select(F.explode(F.concat(*(tagged(o) for o in groups))).alias("c"))
    span = F.col("c.span")
    rows = every.select(F.col("c.origin").alias("origin"), span["kind"].alias("kind"), *(v.alias(k) for k, v in zip(VOTERS, _votes(span))), *(v.alias(k) for k, v in _traits(span).items()))
    return [r.asDict() for r in rows.groupBy("origin", "kind", *VOTERS, *TRAITS).count().collect()]


def reliabilities(counts: list[dict], rounds: int = 50) -> dict[tuple, float]:
    """Expectation-maximisation: the probability that a candidate is real, by (kind, origin, votes).

    Base spans are known to be real and failed ones not to be; they anchor what the
    labelers' votes mean.  Vote frequencies are smoothed with a prior that trusts each
    labeler somewhat, so that a kind with few candidates stays near that prior.
    """
    voters = VOTERS
    out: dict[tuple, float] = {}
    for kind in KINDS:
        rows = [r for r in counts if r["kind"] == kind]
        share = 0.5
        # for real and unreal candidates, the chance of each vote
        chance = {y: {v: {1: 0.8 if y else 0.3, 0: 0.2 if y else 0.7, -1: 0.5 if y else 0.7} for v in voters} for y in (1, 0)}
        for y in (1, 0):
            chance[y]["context"][1] = 0.5 if y else 0.3
        prior = {y: {v: dict(chance[y][v]) for v in voters} for y in (1, 0)}
        for _ in range(rounds):
            weight = {y: {v: {o: 20 * prior[y][v][o] for o in (1, 0, -1)} for v in voters} for y in (1, 0)}
            real = total = 0.0
            for r in rows:
                p = {"base": 1.0, "failed": 0.0}.get(r["origin"])
                if p is None:
                    like = [math.log(share if y else 1 - share) + sum(math.log(max(chance[y][v][r[v]], 1e-6)) for v in voters) for y in (1, 0)]
                    p = 1 / (1 + math.exp(min(700.0, like[1] - like[0])))
                    real += p * r["count"]
                    total += r["count"]
                out[kind, r["origin"], *(r[v] for v in voters)] = p
                for v in voters:
                    weight[1][v][r[v]] += p * r["count"]
                    weight[0][v][r[v]] += (1 - p) * r["count"]
            share = (real + 1) / (total + 2)
            for y in (1, 0):
                for v in voters:
                    pair = (1, -1) if v == "context" else (1, 0)
                    s = sum(weight[y][v][o] for o in pair)
                    for o in pair:
                        chance[y][v][o] = weight[y][v][o] / s
    return out


def fit(counts: list[dict], rounds: int = 400, rate: float = 0.5) -> dict[str, float]:
    """Weights of a logistic classifier over kind, votes and length, fitted to the estimated probabilities."""
    truth = reliabilities(counts)
    weights: dict[str, float] = {}
    total = sum(r["count"] for r in counts)
    # a kind counts as much as any other, however frequent it is
    per_kind = {k: sum(math.sqrt(r["count"]) for r in counts if r["kind"] == k) for k in KINDS}
    rows = [(_features(r), truth[r["kind"], r["origin"], r["shape"], r["gazetteer"], r["context"]], math.sqrt(r["count"]) / per_kind[r["kind"]]) for r in counts]
    for _ in range(rounds if total else 0):
        grad: dict[str, float] = {}
        for names, y, w in rows:
            p = 1 / (1 + math.exp(-sum(weights.get(n, 0.0) for n in names)))
            for n in names:
                grad[n] = grad.get(n, 0.0) + w * (y - p)
        for n, g in grad.items():
            weights[n] = weights.get(n, 0.0) * 0.999 + rate * g
    return weights


def _features(r: dict) -> list[str]:
    k = r["kind"]
    return [k, *(f"{k} {x} {r.get(x, 0)}" for x in (*VOTERS, *TRAITS))]


def _probability(span: Column, weights: dict[str, float]) -> Column:
    values = [*zip(VOTERS, _votes(span)), *_traits(span).items()]
    names = [span["kind"], *(F.concat_ws(" ", span["kind"], F.lit(n), v.cast("string")) for n, v in values)]
    known = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)) if weights else F.expr("cast(map() as map<string,double>)")
    score = sum((F.coalesce(F.element_at(known, n), F.lit(0.0)) for n in names), F.lit(0.0))
    return 1 / (1 + F.exp(-score))


def find_pii(docs: DataFrame, text_col: str = "text", weights: dict[str, float] | None = None, accept: float = ACCEPT, into: tuple[str, str] = ("pii_base", "pii_spans")) -> DataFrame:
    """``docs`` with the base spans and all spans, arrays of (kind, start, end) by kind and start, in columns named ``into``."""
    if weights is None:
        weights = fit(vote_counts(docs, text_col))
    docs = without(docs, into, text_col)
    m, name = _matches(docs, text_col)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    plain = lambda c: F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    added = F.filter(_in_context(F.col(name["wide"]), text), lambda x: _probability(x, weights) >= accept)
    m = m.withColumns({name["base"]: plain(F.col(name["base"])), name["wide"]: plain(added)})
    ordered = F.concat(*(F.array_sort(_of_kind(F.concat(name["base"], name["wide"]), k)) for k in KINDS))
    return m.select(*(F.col(f"`{c}`") for c in docs.columns if c not in into), F.col(name["base"]).alias(into[0]), ordered.alias(into[1]))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its first one's kind in angle brackets."""
    return _replaced(text, spans, lambda kind, size: F.concat(F.lit("<"), F.upper(kind), F.lit(">")))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    """The contract of op8: counts, digest and list of the spans of every document."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(_of_kind(F.col("pii_base"), k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(_listed(F.col("pii_base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("pii_spans")).alias("spans"))
