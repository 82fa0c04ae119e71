"""Personal data by weak supervision, in DataFrame functions only.

Candidates are spans of wide patterns per kind. Labelers vote on each (-1 against, 0 abstain,
1 for): the exact *format* (parts of an address, number of digits, Luhn), a *gazetteer* (top-level
domains, issuer prefixes, dialling codes, address blocks), the *context* before the span (words
that announce the kind, or others that announce a number of another sort) and the *border* (what
touches the span). Votes are counted by pattern over the whole corpus; expectation-maximisation
on those counts (kinds x 3^4 patterns at most, whatever the corpus) estimates how often each
labeler is right, and a logistic span classifier is fitted to the posteriors. Its probability is
an expression in the plan.

Spans that the base patterns define are always reported. The wide patterns, such as addresses
written with "(at)" or phone numbers without "+", are searched in the text with those spans blanked
out, and the classifier adds a wide span where its probability reaches ``threshold``; wide spans of
different kinds may overlap each other, never a base span.

Positions are code points, end exclusive. Patterns are written with possessive repeats and
anchored at the start of their run, so scanning is linear in very long runs; they find what the
plain patterns find. A text with many spans costs linear time as well: positions are running sums
over blocks, a labeler sees the pieces next to a span (back over one earlier span, ``CONTEXT``
characters at most), and texts are rebuilt from chunks.

Null text counts as empty: no spans. Every row is judged on its own, so repeated rows and ties
repeat their spans; an empty table gives an empty result. Other columns pass through whatever their
names; an input column ``spans`` is replaced by :func:`find` and kept by :func:`mask`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismgrid.llm.common import small_batches, staged

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("format", "gazetteer", "context", "border")

#: Base patterns in linear form. Email: a start is the first character of a run of its class, or
#: where the last match ended. Card: a whole run of digits with single separators, 13 to 19 digits.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wide patterns for what the base patterns do not cover.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[({](?:at|AT)[\])}]\x20?[A-Za-z0-9-]{1,63}+"
    r"(?:\x20?(?:[\[({](?:dot|DOT)[\])}]|\.)\x20?[A-Za-z0-9-]{1,63}+)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.])(?<![0-9][\x20-])[0-9]{4}\.[0-9]{4}\.[0-9]{4}\.[0-9]{4}(?![0-9.])",
    "phone": r"(?<![0-9+()-])(?<![0-9+][\x20.(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![\x20.-]?[0-9])",
}
#: What must occur for a pattern to match; a cheap test before the scan.
HINT = {"email": "@", "ip": ".", "card": "", "phone": "+"}

#: The same for the wide patterns.
WIDE_HINT = {
    "email": r"[\[({](at|AT)[\])}]",
    "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]",
    "card": r"[0-9]{4}\.[0-9]{4}\.",
    "phone": r"[0-9]{3}[.-][0-9]{4}",
}

#: Gazetteers.
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|de|fr|es|uk|us|eu|it|nl|ch|at|be|pl|pt|br|mx|ca|au|jp|cn|in|ru|se|no|dk|fi"
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|3[068]|6(011|5|4[4-9])|35|62|50|5[6-9]|6[0-9])"
#: Words that announce a kind, and words that announce another sort of number.
ANNOUNCE = {
    "email": r"(e-?mail|mail|contact|write|kontakt|correo|courriel|@)",
    "ip": r"(\bip\b|address|server|host|login|adresse|servidor)",
    "card": r"(card|visa|master|amex|credit|payment|karte|carte|tarjeta)",
    "phone": r"(phone|call|tel|mobile|fax|contact|rufen|appel|llam)",
}
OTHER = r"(version|isbn|issn|doi|sha|hash|uuid|serial|order|invoice|build|release|section|chapter)[\s:#.]*$"
CONTEXT = 40
#: Characters of the chunks that a text is rebuilt from.
CHUNK = 1024


def _let(value: Column, body) -> Column:
    """``body(value)``, the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, largest: bool = False, levels: int = 3) -> Column:
    """Sums (or the largest, at least 0) of the ints before each one of a non-empty array, in linear
    time up to 64 ** ``levels`` of them: blocks of 64 on every level."""
    join = (lambda a, b: F.greatest(a, b)) if largest else (lambda a, b: a + b)
    total = lambda xs: F.aggregate(xs, F.lit(0), join)
    if not levels:
        return F.transform(values, lambda _, i: total(F.slice(values, F.lit(1), i)))
    numbers = F.sequence(F.lit(0), ((F.size(values) - 1) / 64).cast("int"))
    within = lambda block, before: F.transform(block, lambda _, i: join(before, total(F.slice(block, F.lit(1), i))))
    return _let(
        F.transform(numbers, lambda b: F.slice(values, b * 64 + 1, F.lit(64))),
        lambda blocks: _let(
            F.transform(blocks, total), lambda sums: F.flatten(F.zip_with(blocks, running(sums, largest, levels - 1), within))
        ),
    )


def rebuilt(text: Column, spans: Column, put) -> Column:
    """The text with each of its non-empty ``array<struct<start, end, ...>>``, ascending, replaced by
    ``put(span, end of those before)``. The text is cut from chunks, not from its start."""

    def cut(chunks, begin, end):
        first = (begin / CHUNK).cast("int")
        some = F.array_join(F.slice(chunks, first + 1, ((end - 1) / CHUNK).cast("int") - first + 1), "")
        return F.when(end > begin, F.substring(some, begin - first * CHUNK + 1, end - begin)).otherwise("")

    def build(chunks, own, ends):
        each = lambda s, at: F.concat(cut(chunks, at, F.greatest(at, s["start"])), put(s, at))
        body = F.array_join(F.zip_with(own, running(ends, largest=True), each), "")
        return F.concat(body, cut(chunks, F.array_max(ends), F.length(text)))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return _let(chunks, lambda c: _let(spans, lambda own: _let(F.transform(own, lambda s: s["end"]), lambda ends: build(c, own, ends))))


def _found(text: Column, pattern: str, kind: str, base: bool) -> Column:
    """Spans of a pattern with what is next to them: the pieces between the matches and the matches
    give the positions as running sums."""
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def span(p, i, before):
        gap, hit = F.get(p["gaps"], i), F.get(p["hits"], i)
        start = before + F.length(gap)
        earlier = [F.coalesce(F.right(F.get(p[c], i - 1), F.lit(CONTEXT)), F.lit("")) for c in ("gaps", "hits")]
        later = [F.coalesce(F.left(F.get(p[c], i + 1), F.lit(1)), F.lit("")) for c in ("gaps", "hits")]
        return F.struct(
            F.lit(kind).alias("kind"),
            F.lit(base).alias("base"),
            start.alias("start"),
            (start + F.length(hit)).alias("end"),
            hit.alias("value"),
            F.right(F.concat(*earlier, F.right(gap, F.lit(CONTEXT))), F.lit(CONTEXT)).alias("before"),
            F.left(F.concat(*later), F.lit(1)).alias("after"),
        )

    def spans(p):
        numbers = F.sequence(F.lit(0), F.size(p["hits"]) - 1)
        lengths = F.transform(numbers, lambda i: F.length(F.get(p["gaps"], i)) + F.length(F.get(p["hits"], i)))
        placed = _let(lengths, lambda n: F.zip_with(numbers, running(n), lambda i, before: span(p, i, before)))
        return F.when(F.size(p["hits"]) > 0, placed)

    return _let(parts, spans)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    at = F.sequence(F.lit(1), F.length(digits))

    def add(total, i):
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(at, F.lit(0), add) % 10 == 0


def _format(kind: Column, value: Column) -> Column:
    """Whether a span of a base pattern keeps the kind's rules (leading zeros count as part of a number)."""
    parts = F.split(value, r"\.")
    ip = F.forall(parts, lambda p: F.regexp_replace(p, "^0+", "").rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    digits = F.length(_digits(value))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", ip)
        .when(kind == "card", F.when(digits.between(13, 19), luhn(_digits(value))).otherwise(F.lit(False)))
        .otherwise(digits.between(9, 15))
    )


def _votes(s: Column) -> Column:
    """``array<int>`` of the labelers' votes on a span."""
    kind, value, digits = s["kind"], F.lower(s["value"]), _digits(s["value"])
    vote = lambda yes, no=F.lit(False): F.when(yes, 1).when(no, -1).otherwise(0)
    fmt = F.when(s["base"], F.when(_format(kind, s["value"]), 1).otherwise(-1)).otherwise(
        F.when(kind == "card", F.when(luhn(digits), 1).otherwise(-1)).otherwise(0)
    )
    private = value.rlike(r"^0*(0|10|127|169\.0*254|192\.0*168|255)\.")
    gazetteer = (
        F.when(kind == "email", vote(value.rlike(rf"[.\x20)\]}}]({DOMAINS})$")))
        .when(kind == "ip", vote(~private, private))
        .when(kind == "card", vote(digits.rlike(ISSUERS), ~digits.rlike(ISSUERS)))
        .otherwise(vote(value.rlike(r"^\+[1-9]|^\(?[2-9][0-9]{2}"), value.rlike(r"^\+0|^\(?[01]")))
    )
    before = F.lower(s["before"])
    announced = F.lit(False)
    for k, words in ANNOUNCE.items():
        announced = F.when(kind == k, before.rlike(words)).otherwise(announced)
    context = vote(announced, before.rlike(OTHER))
    touched = s["before"].rlike(r"[A-Za-z0-9=_/]$") | s["after"].rlike(r"[A-Za-z0-9=_]")
    return F.array(fmt, gazetteer, context, vote(~touched, touched))


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``_row`` (all columns of ``docs``), ``_text`` and ``candidates``: the spans of base and wide
    patterns with their votes."""
    body = F.coalesce(F.col("_text"), F.lit(""))
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_text"))
    judged = lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "base", "start", "end")], _votes(s).alias("votes"))

    def together(names):
        """The kinds' spans with their votes, null if there are none."""
        none = F.lit(False)
        for c in names:
            none = none | F.col(c).isNotNull()
        return F.when(none, F.transform(F.concat(*[F.coalesce(F.col(c), F.array()) for c in names]), judged))

    for kind in KINDS:
        some = F.instr(body, HINT[kind]) > 0 if HINT[kind] else body.rlike("[0-9]")
        found = found.withColumn(f"_base_{kind}", F.when(some, _found(body, BASE[kind], kind, True)))
    found = found.withColumn("_base", together([f"_base_{k}" for k in KINDS]))
    hints = F.lit(False)
    for hint in WIDE_HINT.values():
        hints = hints | body.rlike(hint)
    valid = F.filter("_base", lambda s: F.get(s["votes"], F.lit(0)) > 0)
    places = F.array_sort(F.transform(valid, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    blank = lambda s, at: F.repeat(F.lit("\0"), F.greatest(s["end"] - F.greatest(at, s["start"]), F.lit(0)))
    clear = _let(places, lambda p: F.when(F.size(p) > 0, rebuilt(body, p, blank)).otherwise(body))
    found = found.withColumn("_clear", F.when(hints, F.coalesce(clear, body)))
    for kind in KINDS:
        some = F.col("_clear").rlike(WIDE_HINT[kind])
        found = found.withColumn(f"_wide_{kind}", F.when(some, _found(F.col("_clear"), WIDE[kind], kind, False)))
    found = found.withColumn("_wide", together([f"_wide_{k}" for k in KINDS]))
    none = F.filter(F.transform(F.array(F.lit(0)), lambda _: F.struct(F.lit("").alias("kind"), F.lit(False).alias("base"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.array(F.lit(0)).alias("votes"))), lambda s: s["base"])
    return found.select("_row", "_text", F.concat(F.coalesce("_base", none), F.coalesce("_wide", none)).alias("candidates"))


@dataclass(frozen=True)
class SpanModel:
    """What the corpus taught: per kind a prior and labeler reliabilities, and the classifier."""

    prior: dict[str, float]
    reliability: dict[tuple[str, str], float]
    weights: tuple[float, ...]

    def probability(self, kind: Column, votes: Column) -> Column:
        """The classifier's probability that a span is personal data."""
        z = F.lit(self.weights[-1])
        for k, w in zip(KINDS, self.weights, strict=False):
            z = z + F.when(kind == k, w).otherwise(0.0)
        for i in range(len(LABELERS)):
            z = z + F.get(votes, F.lit(i)) * self.weights[len(KINDS) + i]
        return 1 / (1 + F.exp(-z))


def fit(counts: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> SpanModel:
    """EM over counted vote patterns (one reliability per kind and labeler), then a logistic
    classifier fitted to the posteriors by damped gradient steps. Works on at most
    ``len(KINDS) * 3**len(LABELERS)`` rows."""
    prior = {k: 0.7 for k in KINDS}
    start = (0.9, 0.75, 0.8, 0.7)
    rel = {(k, name): start[i] for k in KINDS for i, name in enumerate(LABELERS)}

    def posterior(kind, votes):
        yes, no = math.log(prior[kind]), math.log(1 - prior[kind])
        for name, v in zip(LABELERS, votes, strict=True):
            if v:
                r = rel[kind, name]
                yes, no = yes + math.log(r if v > 0 else 1 - r), no + math.log(1 - r if v > 0 else r)
        return 1 / (1 + math.exp(min(max(no - yes, -500), 500)))

    for _ in range(rounds):
        post = [posterior(k, v) for k, v, _ in counts]
        for k in KINDS:
            own = [(p, v, n) for p, (kk, v, n) in zip(post, counts, strict=True) if kk == k]
            total = sum(n for _, _, n in own)
            # Beta priors keep rare kinds and silent labelers near their starting point, and no
            # labeler may count as worse than a guess.
            prior[k] = (7 + sum(p * n for p, _, n in own)) / (10 + total)
            for i, name in enumerate(LABELERS):
                right = sum((p if v[i] > 0 else 1 - p) * n for p, v, n in own if v[i])
                cast = sum(n for _, v, n in own if v[i])
                rel[k, name] = min(max((20 * start[i] + right) / (20 + cast), 0.55), 0.995)
    size = len(KINDS) + len(LABELERS) + 1
    w = [0.0] * size
    # Every pattern is a soft-labelled example; kinds weigh alike whatever their frequency.
    seen = {k: sum(n for kk, _, n in counts if kk == k) for k in KINDS}
    rows = [([float(kk == k) for kk in KINDS] + [float(x) for x in v] + [1.0], posterior(k, v), n / seen[k]) for k, v, n in counts]
    # Patterns that did not occur keep the classifier defined where the corpus is silent.
    rows += [
        ([float(kk == k) for kk in KINDS] + [float(x) for x in v] + [1.0], posterior(k, v), 0.02)
        for k in KINDS
        for v in _patterns(len(LABELERS))
    ]
    for _ in range(800):
        grad = [1e-3 * x for x in w]
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(min(sum(a * b for a, b in zip(w, x, strict=True)), 60), -60)))
            for i, xi in enumerate(x):
                grad[i] += n * (p - y) * xi
        w = [a - 0.15 * g for a, g in zip(w, grad, strict=True)]
    return SpanModel(prior, rel, tuple(w))


def _patterns(n: int) -> list[tuple[int, ...]]:
    out: list[tuple[int, ...]] = [()]
    for _ in range(n):
        out = [(*p, v) for p in out for v in (-1, 0, 1)]
    return out


def learn(candidates: DataFrame) -> SpanModel:
    """Fit on all candidates of a corpus; only counts by vote pattern reach the driver."""
    each = candidates.filter(F.size("candidates") > 0).select(F.explode("candidates").alias("c"))
    counts = each.groupBy("c.kind", "c.votes").agg(F.count(F.lit(1)).alias("n")).collect()
    return fit(sorted((r["kind"], tuple(r["votes"]), r["n"]) for r in counts))


def decide(docs: DataFrame, model: SpanModel, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``spans`` for ``candidates``: ``array<struct<kind, start, end, base, probability>>``
    by kind as listed in KINDS, then start. Base spans that keep their kind's rules stay; others need
    the threshold."""
    p = lambda s: model.probability(s["kind"], s["votes"])
    ok = F.filter("candidates", lambda s: F.when(s["base"], F.get(s["votes"], F.lit(0)) > 0).otherwise(p(s) >= threshold))
    order = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    sortable = F.transform(ok, lambda s: F.struct(order(s).alias("order"), *[s[c].alias(c) for c in ("start", "end", "kind", "base")], p(s).alias("probability")))
    named = F.transform(
        F.array_sort(sortable), lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "base", "probability")])
    )
    return docs.withColumn("_spans", F.when(F.size("candidates") > 0, named)).drop("candidates")


NO_SPANS = "cast(array() as array<struct<kind:string,start:int,end:int,base:boolean,probability:double>>)"


def _decided(docs: DataFrame, text: str, threshold: float, keep_text: bool) -> DataFrame:
    """``_row`` (without the text unless kept) and ``_spans`` (null if there are none)."""
    small_batches(docs.sparkSession)
    rows = with_candidates(docs, text)
    if not keep_text:
        rest = [F.col("_row")[c].alias(c) for c in docs.columns if c != text]
        rows = rows.select(F.struct(*rest).alias("_row") if rest else F.struct(F.lit(0).alias("none")).alias("_row"), "candidates")
    else:
        rows = rows.drop("_text")
    seen = staged(rows, "candidates")
    return decide(seen, learn(seen), threshold)


def find(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """All spans of a corpus: ``docs`` without the text, with ``spans``, learned and decided in one scan
    of the texts."""
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in (text, "spans")]
    return _decided(docs, text, threshold, False).select(*kept, F.coalesce("_spans", F.expr(NO_SPANS)).alias("spans"))


def mask(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with every span replaced by ``<KIND>``; overlapping spans become one mask of the
    first. ``n_chars``, where present, becomes the new length. Same columns, null text stays."""
    seen = _decided(docs, text, threshold, True)
    places = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    shown = lambda s, at: F.when(s["start"] >= at, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")
    body = F.col("_row")[text]
    masked = F.when(F.size("_spans") > 0, rebuilt(F.col("_text"), places, shown)).otherwise(F.col("_text"))
    seen = seen.withColumn("_text", body).withColumn("_masked", masked)
    columns = {c: F.col("_row")[c] for c in docs.columns} | {text: F.col("_masked")}
    if "n_chars" in docs.columns:
        length = F.when(body.isNull(), columns["n_chars"]).otherwise(F.length("_masked"))
        columns["n_chars"] = length.cast(docs.schema["n_chars"].dataType)
    return seen.select(*[value.alias(c) for c, value in columns.items()])
