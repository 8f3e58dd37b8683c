"""Personal data by weak supervision. DataFrame functions only.

Candidate spans come from patterns. Four base kinds are defined by rules and
always stand: email, ip, card, phone. Further kinds are only proposed: phone
numbers without a country code, numbers of card length that fail a card's
rules, user handles, and assigned secrets. Labelers vote on every candidate
(+1 personal, -1 not, 0 no opinion): a strict pattern, gazetteers (top-level
domains, dialling codes, card issuers, address blocks, key names), the words
before the span, and the characters around it.

Votes are aggregated to counts of vote patterns, of which there are at most
kinds * 3^labelers. Expectation-maximisation on these counts estimates how
reliable each labeler is; the resulting probabilities are the soft labels of a
final span classifier (naive Bayes over the shape of the span and its
surroundings), trained on all candidates. Proposed spans with a probability of
at least THRESHOLD are added unless they overlap a base span.

Patterns are the published ones with possessive quantifiers and look-behinds
that keep a match linear in the text; they find the same spans.

Results in special cases: a null or empty text has no spans; without any
candidate the classifier is not asked; spans of one kind never overlap; repeated
rows get the same spans each; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import prepare, stored

_LOCAL = "A-Za-z0-9._%+-"
# kind, pattern, what a text must contain to be searched
BASE = (
    ("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    # a longest run of digits with single separators, of 14 to 19 digits
    ("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])", r"[0-9][\x20-]?[0-9]"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
)
EXTRA = (
    ("phone_local", r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", r"[0-9]{3}[\x20.-][0-9]{4}"),
    ("card_like", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])", r"[0-9][\x20-]?[0-9]"),
    ("handle", r"(?<![A-Za-z0-9._%+@-])@[A-Za-z_][A-Za-z0-9_]{2,}+(?![A-Za-z0-9_.@-])", r"@"),
    ("secret", r"(?i)\b(?:token|secret|passw(?:or)?d|api[_-]?key)\x20{0,2}[=:]\x20{0,2}\"?[A-Za-z0-9_-]{16,}+", r"[=:]"),
)
KINDS = [k for k, _, _ in BASE + EXTRA]
BASE_KINDS = [k for k, _, _ in BASE]
LABELERS = ("strict", "gazetteer", "context", "edges")
FEATURES = ("kind", "length", "digits", "before", "after", "lead")
THRESHOLD = 0.5
EM_ROUNDS = 12
CONTEXT = 32    # characters before a span that are looked at

# fixed values: words that speak for and against a span after them, per family of kinds
CUES = {
    "email": "e-?mail|mail|contact|write", "handle": "follow|twitter|user|profile|handle",
    "ip": r"\bip\b|host|server|address|login", "card": "card|visa|master|amex|pay|credit|iban",
    "phone": r"tel|phone|call|fax|mobile|\bcell", "secret": "token|secret|passw|key",
}
AGAINST = r"version|\bv$|isbn|issn|order|invoice|section|page|figure|chapter|\bno\.?\s*$|#\s*$|[$€£]\s*$"
DOMAINS = "com|org|net|edu|gov|io|co|de|fr|es|uk|info|eu|ch|at"
DIALLING = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35"
OWN_BLOCKS = r"(?:0|10|127|255)\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\."


def _prefix_sums(lengths: Column) -> Column:
    """Sum of the elements before each one, in blocks of 64 so that the work stays near linear."""
    blocks = F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / 64).cast("int")),
        lambda b: F.aggregate(F.slice(lengths, b * 64 + 1, F.lit(64)), F.lit(0), lambda a, x: a + x)))
    return F.transform(lengths, lambda _, i: F.aggregate(
        F.slice(blocks, F.lit(1), F.floor(i / 64).cast("int")), F.lit(0), lambda a, x: a + x) + F.aggregate(
        F.slice(lengths, F.floor(i / 64).cast("int") * 64 + 1, (i % 64).cast("int")), F.lit(0), lambda a, x: a + x))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    """Whether the digits of text pass the Luhn check."""
    digits = F.reverse(_digits(text))
    values = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.ascii(F.substring(digits, i, F.lit(1))) - 48)
    total = F.aggregate(
        F.transform(values, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v)),
        F.lit(0), lambda a, x: a + x)
    return (F.length(digits) > 0) & (total % 10 == 0)


def _holds(kind: str, found: Column) -> Column:
    """The rule of a base kind that its pattern cannot say."""
    n = F.length(_digits(found))
    if kind == "ip":
        # compared as text, so that any number of digits will do
        return F.forall(F.split(found, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return n.between(14, 19) & _luhn(found)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "card_like":
        return ~(n.between(14, 19) & _luhn(found))
    return F.lit(True)


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, base, extra: arrays of struct(start, end, kind, found, before, after); code points, end exclusive."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    for kind, pattern, needs in BASE + EXTRA:
        has = F.col("text").rlike(needs)
        texts = texts.withColumn(f"found_{kind}", F.when(
            has, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    for kind, pattern, _ in BASE + EXTRA:
        texts = texts.withColumn(f"gaps_{kind}", F.when(
            F.size(f"found_{kind}") > 0, F.split("text", pattern, -1)).otherwise(none))
    for kind, _, _ in BASE + EXTRA:
        found, gaps = F.col(f"found_{kind}"), F.col(f"gaps_{kind}")
        texts = texts.withColumn(f"lengths_{kind}", F.transform(found, lambda m, i: F.length(m) + F.length(F.get(gaps, i))))
        texts = texts.withColumn(f"starts_{kind}", _prefix_sums(F.col(f"lengths_{kind}")))
    spans = {}
    for kind, _, _ in BASE + EXTRA:
        gaps, starts = F.col(f"gaps_{kind}"), F.col(f"starts_{kind}")

        def span(found, i):
            start = F.get(starts, i) + F.length(F.get(gaps, i))
            return F.struct(
                start.alias("start"), (start + F.length(found)).alias("end"), F.lit(KINDS.index(kind)).alias("kind"),
                found.alias("found"), F.substring("text", F.greatest(start - CONTEXT + 1, F.lit(1)),
                                                  F.least(start, F.lit(CONTEXT))).alias("before"),
                F.substring("text", start + F.length(found) + 1, F.lit(1)).alias("after"))

        made = F.transform(f"found_{kind}", span)
        spans[kind] = F.filter(made, lambda s: _holds(kind, s["found"]))
    return texts.select("id", F.concat(*[spans[k] for k, _, _ in BASE]).alias("base"),
                        F.concat(*[spans[k] for k, _, _ in EXTRA]).alias("extra"))


def _votes(s: Column) -> list[Column]:
    """The labelers, in the order of LABELERS."""
    kind, found, before = s["kind"], s["found"], F.lower(s["before"])
    is_ = lambda *names: kind.isin(*[KINDS.index(n) for n in names])
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    digits = _digits(found)
    strict = (
        F.when(is_("email"), vote(found.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[^@]+\.[A-Za-z]{2,}$"), F.lit(True)))
        .when(is_("ip"), vote(~found.rlike(r"(?:^|\.)0[0-9]"), F.lit(True)))
        .when(is_("card", "card_like"), vote(F.length(digits).between(13, 19) & _luhn(found), F.lit(True)))
        .when(is_("phone"), vote(found.rlike(r"^\+[1-9]"), F.lit(True)))
        .when(is_("phone_local"), vote(found.rlike(r"^\(?[2-9]"), F.lit(True)))
        .when(is_("handle"), vote(F.length(found) <= 31, F.lit(True)))
        .otherwise(vote(found.rlike(r"[0-9]") & found.rlike(r"[A-Za-z][^=:]*$"), F.lit(True))))
    gazetteer = (
        F.when(is_("email"), vote(found.rlike(rf"\.(?:{DOMAINS})$"), F.lit(False)))
        .when(is_("ip"), vote(F.lit(False), found.rlike(f"^{OWN_BLOCKS}")))
        .when(is_("card", "card_like"), vote(digits.rlike(f"^(?:{ISSUERS})"), F.lit(True)))
        .when(is_("phone"), vote(found.rlike(rf"^\+(?:{DIALLING})"), F.lit(True)))
        .when(is_("secret"), vote(found.rlike(r"(?i)^(?:token|secret|api)"), F.lit(False)))
        .otherwise(F.lit(0)))
    cue = F.lit(False)
    for family, words in CUES.items():
        members = [k for k in KINDS if k.startswith(family)]
        # a secret carries its own key word
        cue = F.when(is_(*members), (F.concat(before, found) if family == "secret" else before).rlike(words)).otherwise(cue)
    context = vote(cue, before.rlike(AGAINST))
    edges = vote(F.coalesce(F.right(s["before"], F.lit(1)), F.lit("")).rlike(r"^[\s\p{P}]?$") & s["after"].rlike(r"^[\s\p{P}]?$"),
                 F.lit(True))
    return [strict, gazetteer, context, edges]


def _features(s: Column) -> list[Column]:
    """The classifier's features, in the order of FEATURES: small whole numbers."""
    kind, found = s["kind"], s["found"]
    shape = lambda c: (F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike("^[0-9]"), 2)
                       .when(c.rlike(r"^\p{L}"), 3).otherwise(4))
    return [kind, F.least(F.floor(F.log2(F.length(found) + 1)), F.lit(7)).cast("int"),
            F.floor(4 * F.length(_digits(found)) / F.length(found)).cast("int"),
            shape(F.right(s["before"], F.lit(1))), shape(s["after"]), shape(F.left(found, F.lit(1)))]


def judged(found: DataFrame) -> DataFrame:
    """candidates with votes and features in place of the texts around the spans."""
    def small(s):
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"),
                        F.array(*_votes(s)).alias("votes"), F.array(*_features(s)).alias("features"))

    return found.select("id", F.transform("base", small).alias("base"), F.transform("extra", small).alias("extra"))


def estimate_labels(patterns: DataFrame, rounds: int = EM_ROUNDS) -> tuple[Column, dict]:
    """EM over patterns(kind, votes, n): the probability that a candidate is personal, as an expression.

    A labeler's distribution of votes is shared by all kinds, the prior is per
    kind. Every round is one aggregation to one row; what comes back has a
    fixed size. Counts are smoothed by one vote.
    """
    votes = (-1, 0, 1)
    given = {(c, j, v): (0.6 if v == (1 if c else -1) else 0.2) for c in (0, 1) for j in range(len(LABELERS)) for v in votes}
    prior = dict.fromkeys(range(len(KINDS)), 0.5)

    def posterior() -> Column:
        odds = F.lit(0.0)
        for k, p in prior.items():
            odds = F.when(F.col("kind") == k, math.log(p / (1 - p))).otherwise(odds)
        for j in range(len(LABELERS)):
            weight = F.lit(0.0)
            for v in votes:
                weight = F.when(F.get("votes", F.lit(j)) == v, math.log(given[1, j, v] / given[0, j, v])).otherwise(weight)
            odds = odds + weight
        return 1 / (1 + F.exp(-odds))

    for _ in range(rounds):
        p, n = F.col("p"), F.col("n")
        sums = [F.sum(F.when(F.get("votes", F.lit(j)) == v, n * (p if c else 1 - p)).otherwise(0.0)).alias(f"v_{c}_{j}_{v}")
                for c, j, v in given]
        sums += [F.sum(F.when(F.col("kind") == k, x).otherwise(0.0)).alias(f"k_{k}_{name}")
                 for k in prior for name, x in (("yes", n * p), ("all", n * 1.0))]
        row = patterns.withColumn("p", posterior()).agg(*sums).first().asDict()
        seen = {c: [sum((row[f"v_{c}_{j}_{v}"] or 0.0) + 1 for v in votes) for j in range(len(LABELERS))] for c in (0, 1)}
        given = {(c, j, v): ((row[f"v_{c}_{j}_{v}"] or 0.0) + 1) / seen[c][j] for c, j, v in given}
        prior = {k: ((row[f"k_{k}_yes"] or 0.0) + 1) / ((row[f"k_{k}_all"] or 0.0) + 2) for k in prior}
    return posterior(), given


def train_classifier(spans: DataFrame, label: Column) -> dict[tuple[int, int], float]:
    """Log ratios of naive Bayes per (feature, value), and the prior's at (-1, 0), from soft labels."""
    soft = spans.select(label.alias("p"), F.posexplode("features").alias("feature", "value"))
    rows = soft.groupBy("feature", "value").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    out, yes, no = {}, sum(r["yes"] for r in rows if r["feature"] == 0), sum(r["no"] for r in rows if r["feature"] == 0)
    for r in rows:      # features times their values: a fixed number
        out[r["feature"], r["value"]] = math.log((r["yes"] + 0.5) / (yes + 4) / ((r["no"] + 0.5) / (no + 4)))
    out[-1, 0] = math.log((yes + 1) / (no + 1))
    return out


def _probability(ratios: dict[tuple[int, int], float], features: Column) -> Column:
    odds = F.lit(ratios[-1, 0])
    for j in range(len(FEATURES)):
        weight = F.lit(0.0)
        for value in sorted(v for f, v in ratios if f == j):
            weight = F.when(F.get(features, F.lit(j)) == value, ratios[j, value]).otherwise(weight)
        odds = odds + weight
    return 1 / (1 + F.exp(-odds))


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id, base and added, arrays of struct(start, end, kind) by start, then kind."""
    prepare(docs.sparkSession)
    table = stored(judged(candidates(docs, id_col, text_col)), "pii-candidates")
    spans = table.select(F.explode(F.concat("base", "extra")).alias("s")).select("s.kind", "s.votes", "s.features")
    patterns = stored(spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")), "pii-votes")
    label, _ = estimate_labels(patterns)
    ratios = train_classifier(spans, label)
    plain = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    ordered = lambda a: F.array_sort(F.transform(a, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    added = F.filter("extra", lambda s: (_probability(ratios, s["features"]) >= threshold)
                     & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return (table.select("id", ordered("base").alias("base"), ordered(added).alias("added"))
            .select("id", F.transform("base", plain).alias("base"), F.transform("added", plain).alias("added")))


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def masked_counts(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
