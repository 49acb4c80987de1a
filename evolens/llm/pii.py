"""Personal data in texts by weak supervision, with DataFrame and SQL functions only.

Base kinds (e-mail, IP address, card, phone) are found by pattern and checked; what passes is always reported. Further
kinds (spelled-out e-mail, local phone, bank account, person) are candidates only. For every candidate of every kind
three labelers vote yes, no or nothing: the strict pattern, a gazetteer of known words, and cue words before the span.
Expectation-maximisation over the counts of vote patterns (a table of bounded size) estimates how reliable each labeler
is for each kind, without labelled data, and how likely each pattern is personal data. These likelihoods are the soft
labels from which a naive Bayes classifier of span features (length, context before, sign after) is trained over all
candidates; candidates of the further kinds are reported if it says yes.

Offsets are code points, end exclusive. Null texts are empty. Work inside a text is linear in its length for each
kind; patterns are possessive, so that no text makes them backtrack or recurse. Repeated rows are reported each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evolens.session import materialise

#: Base patterns. A match can begin only where a run of its signs begins or the last match ended, which
#: gives the same leftmost matches without a retry inside every run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z0-9-]{2,63}){1,4}+"
LOCAL = r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
PERSON = r"(?<![\p{L}])(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señora?)\.? \p{Lu}\p{L}{1,40}(?: \p{Lu}\p{L}{1,40})?"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
FURTHER = {"email_spelled": SPELLED, "phone_local": LOCAL, "account": ACCOUNT, "person": PERSON}
KINDS = {**BASE, **FURTHER}
#: A text that lacks this string has no match; saves the pattern.
NEEDED = {"email": "@", "phone": "+", "email_spelled": "at"}
#: Words of the gazetteer and cue labelers.
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|de|fr|es|uk|io)$",
    "ip": r"^(?:10|127|172|192)\.",
    "card": r"^(?:4|5[1-5]|34|37|6011)",
    "phone": r"^\+(?:1|33|34|44|49)",
    "email_spelled": r"(?i)(?:com|org|net|edu|gov|info|de|fr|es|uk)$",
    "phone_local": r"555",
    "account": r"^(?:DE|FR|ES|GB|IT|NL|BE|AT|CH)",
    "person": r"^(?:Mrs?|Dr|Prof|Herr|Frau)",
}
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write|address|correo)",
    "ip": r"(?i)(?:\bip\b|address|host|server|adresse)",
    "card": r"(?i)(?:card|visa|credit|karte|carte|tarjeta)",
    "phone": r"(?i)(?:phone|call|tel|fax|mobile|tel[eé]fono)",
    "email_spelled": r"(?i)(?:e-?mail|contact|write|reach)",
    "phone_local": r"(?i)(?:phone|call|tel|fax|mobile)",
    "account": r"(?i)(?:iban|account|konto|compte|cuenta)",
    "person": r"(?i)(?:name|contact|dear|by|from)",
}
CONTEXT = 24
ROUNDS = 50


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _strict(kind: str, value: Column) -> Column:
    """Whether a match is well-formed; the condition of the base kinds."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("bigint"), F.lit(256)) <= 255)
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "phone_local":
        return value.rlike(r"^\([2-9]|^[2-9]")
    if kind == "account":
        return F.length(F.regexp_replace(value, " ", "")).between(15, 34)
    if kind == "person":
        return value.rlike(r"\. ")
    return F.lit(True)


def _checked(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _strict(kind, s["value"]))


def _matches(kind: str, text: Column) -> Column:
    """Array of struct(kind, start, end, value, before, after) of all matches of a kind."""
    pattern = KINDS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.arrays_zip(found.alias("value"), between.alias("gap"))

    def step(so_far: Column, x: Column) -> Column:
        start = so_far["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        low = F.greatest(start - CONTEXT, F.lit(0))
        span = F.struct(
            F.lit(kind).alias("kind"),
            start.alias("start"),
            end.alias("end"),
            x["value"].alias("value"),
            F.substring(text, low + 1, start - low).alias("before"),
            F.substring(text, end + 1, F.lit(1)).alias("after"),
        )
        return F.struct(end.alias("at"), F.concat(so_far["spans"], F.array(span)).alias("spans"))

    empty = F.array().cast(f"array<{_SPAN}>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    matched = F.filter(pairs, lambda x: x["value"].isNotNull())
    spans = F.aggregate(matched, start, step, lambda so_far: so_far["spans"])
    has = text.contains(NEEDED[kind]) & text.rlike(pattern) if kind in NEEDED else text.rlike(pattern)
    return F.when(has, spans).otherwise(empty)


_SPAN = "struct<kind:string,start:int,end:int,value:string,before:string,after:string>"


def _apart_from(base: Column):
    def apart(s: Column) -> Column:
        return ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    return apart


def candidates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, base (checked spans) and further (candidates that touch no base span) of every row."""
    text = F.coalesce("text", F.lit(""))
    base = F.concat(*(_checked(k, _matches(k, text)) for k in BASE))
    found = docs.select(*keep, base.alias("base"), F.concat(*(_matches(k, text) for k in FURTHER)).alias("further"))
    return found.select(*keep, "base", F.filter("further", _apart_from(F.col("base"))).alias("further"))


def _by_kind(of, span: Column) -> Column:
    cases = F.lit(None)
    for kind in KINDS:
        cases = F.when(span["kind"] == kind, of(kind)).otherwise(cases)
    return cases


def _pattern(span: Column) -> Column:
    """The three votes as text, such as `email:101`: 1 yes, 0 no, - nothing. Cues and gazetteers never vote no."""
    strict = _by_kind(lambda k: _strict(k, span["value"]), span)
    known = _by_kind(lambda k: span["value"].rlike(GAZETTEER[k]), span)
    cue = _by_kind(lambda k: span["before"].rlike(CUES[k]), span)
    vote = [F.when(strict, "1").otherwise("0"), F.when(known, "1").otherwise("-"), F.when(cue, "1").otherwise("-")]
    return F.concat(span["kind"], F.lit(":"), *vote)


def _features(span: Column) -> list[Column]:
    size = F.least(F.lit(6), F.floor(F.log2((span["end"] - span["start"]).cast("double")))).cast("string")
    before = F.when(F.trim(span["before"]) == "", "none").when(span["before"].rlike(r"[:=]\s*$"), "mark").when(
        _by_kind(lambda k: span["before"].rlike(CUES[k]), span), "cue"
    ).otherwise("other")
    after = F.when(span["after"] == "", "end").when(span["after"].rlike(r"\s"), "space").when(span["after"].rlike(r"\p{P}"), "sign").otherwise("letter")
    return [F.concat_ws(":", F.lit(n), span["kind"], x) for n, x in (("size", size), ("before", before), ("after", after))]


def reliabilities(counts: dict[str, int]) -> dict[str, float]:
    """Expectation-maximisation for each kind: how likely each vote pattern is personal data.

    Starts from labelers that are right in 4 of 5 votes and, in each step, gives every rate two imagined observations at
    that start, so that kinds with few candidates stay near it.
    """
    likely: dict[str, float] = {}
    for kind in {p.split(":")[0] for p in counts}:
        rows = {p.split(":")[1]: n for p, n in counts.items() if p.split(":")[0] == kind}
        prior, yes, no = 0.5, [0.8] * 3, [0.2] * 3
        for _ in range(ROUNDS):
            post = {}
            for votes in rows:
                a, b = math.log(prior), math.log(1 - prior)
                for v, y, n in zip(votes, yes, no):
                    if v != "-":
                        a += math.log(y if v == "1" else 1 - y)
                        b += math.log(n if v == "1" else 1 - n)
                post[votes] = 1 / (1 + math.exp(b - a))
            true = sum(rows[v] * p for v, p in post.items())
            total = sum(rows.values())
            prior = (true + 1) / (total + 2)
            for k in range(3):
                voted = {v: p for v, p in post.items() if v[k] != "-"}
                t, f = sum(rows[v] * p for v, p in voted.items()), sum(rows[v] * (1 - p) for v, p in voted.items())
                yes[k] = (sum(rows[v] * p for v, p in voted.items() if v[k] == "1") + 1.6) / (t + 2)
                no[k] = (sum(rows[v] * (1 - p) for v, p in voted.items() if v[k] == "1") + 0.4) / (f + 2)
        likely |= {f"{kind}:{v}": p for v, p in post.items()}
    return likely


def _lookup(table: dict[str, float], key: Column, other: float) -> Column:
    if not table:
        return F.lit(other)
    pairs = [F.lit(x) for k in sorted(table) for x in (k, float(table[k]))]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(other))


def train(found: DataFrame) -> tuple[dict[str, float], float]:
    """Log-odds of every feature and the log-odds of all candidates; found: what `candidates` returns."""
    spans = found.select(F.explode(F.concat("base", "further")).alias("span"))
    patterns = spans.groupBy(_pattern(F.col("span")).alias("pattern")).count()
    likely = reliabilities({r["pattern"]: r["count"] for r in patterns.collect()})
    soft = spans.select(_lookup(likely, _pattern(F.col("span")), 0.5).alias("p"), F.array(*_features(F.col("span"))).alias("features"))
    sums = soft.select("p", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    rows = sums.collect()
    yes, no = sum(r["yes"] for r in rows) / 3, sum(r["no"] for r in rows) / 3
    odds = {r["feature"]: math.log((r["yes"] + 0.5) / (yes + 1)) - math.log((r["no"] + 0.5) / (no + 1)) for r in rows}
    return odds, math.log((yes + 1) / (no + 1))


def detect(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, base and spans (base and accepted further ones): arrays of struct with kind, start, end."""
    found = materialise(candidates(docs, keep))
    return _reported(found, train(found), keep)


def _reported(found: DataFrame, model: tuple[dict[str, float], float], keep: tuple[str, ...]) -> DataFrame:
    odds, prior = model

    def accepted(span: Column) -> Column:
        score = F.lit(prior)
        for feature in _features(span):
            score = score + _lookup(odds, feature, 0.0)
        return score > 0

    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    spans = F.concat("base", F.filter("further", accepted))
    return found.select(*keep, plain(F.col("base")).alias("base"), plain(spans).alias("spans"))


def count_of(kind: str, spans: Column) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.concat_ws(",", one)


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; a span that begins inside another is part of it."""
    text = F.coalesce(text, F.lit(""))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(so_far: Column, s: Column) -> Column:
        fresh = s["start"] >= so_far["at"]
        piece = F.concat(F.substring(text, so_far["at"] + 1, s["start"] - so_far["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        out = F.when(fresh, F.concat(so_far["out"], piece)).otherwise(so_far["out"])
        return F.struct(F.greatest(so_far["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    end = F.aggregate(ordered, start, step)
    return F.when(F.size(spans) > 0, F.concat(end["out"], F.substring(text, end["at"] + 1, F.length(text)))).otherwise(text)


def mask(docs: DataFrame, text_length: str | None = None) -> DataFrame:
    """The same rows and columns with every reported span masked; text_length: a column to set to the new length."""
    model = train(materialise(candidates(docs, ())))
    named = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    found = _reported(candidates(named, ("_row", "text")), model, ("_row", "text")).select("_row", masked(F.col("text"), F.col("spans")).alias("_text"))
    shown = F.when(F.col("_row.text").isNull(), F.lit(None)).otherwise(F.col("_text"))
    new = {"text": shown, text_length: F.length(shown).cast(docs.schema[text_length].dataType) if text_length else None}
    return found.select(*(new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in docs.columns))
