"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose spans; labelers of three kinds (patterns, gazetteers, context) vote on each; expectation-maximisation over
the counts of vote patterns estimates how reliable each labeler is, without labels; a logistic classifier is trained on the
resulting probabilities and decides about spans that the strict patterns alone don't settle. Only counts of vote patterns,
of which there is a fixed number, reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Kinds in their order. The strict patterns. A possessive quantifier never gives back what it took, and a
#: match begins where a run of its characters begins or the last match ended: the same matches, found in linear time.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
STRICT = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms that only propose spans: spelt-out addresses, national phone numbers.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z]{2,12}(?![A-Za-z0-9])",
    "phone": r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
}
#: Gazetteers. Common top-level domains, country calling codes.
DOMAINS = "com org net edu gov mil int info biz io dev app de fr es it nl be ch at uk us eu ca au nz jp cn in br mx ru pl se no fi dk pt ie".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 380 420 971 972".split()
#: Words before a span that speak for its kind, and words that speak against personal data.
CUES = {
    "email": r"mail|contact|write to|correo|courriel|schreib",
    "ip": r"\bip\b|address|host|server|login|adresse|direcci",
    "card": r"card|visa|credit|debit|karte|carte|tarjeta|payment",
    "phone": r"phone|tel|call|fax|mobile|cell|ruf|appel|llam|m[oó]vil",
}
AGAINST = r"version|\bv\b|isbn|issn|order|invoice|serial|section|chapter|example of"
VOTES = ("pattern", "gazetteer", "context", "shape", "border")
#: Characters before and behind a span that context labelers see.
BEFORE, BEHIND = 32, 1
#: Rounds of expectation-maximisation and of the classifier's descent.
ROUNDS, STEPS = 60, 400


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    worth = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + worth(i) - F.when(worth(i) > 9, 9).otherwise(0))
    return total % 10 == 0


def passes(kind: str, match: Column) -> Column:
    """Whether a match of the strict pattern is a span."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)
    n = F.length(_digits(match))
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(match))).otherwise(F.lit(False))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _needs(kind: str, loose: bool, text: Column) -> Column:
    """A cheap test that every match passes."""
    if kind == "email":
        return text.rlike(r"[\[(](?:at|AT)[\])]") if loose else F.contains(text, F.lit("@"))
    return F.contains(text, F.lit("+")) if kind == "phone" and not loose else text.rlike("[0-9]")


def _proposals(kind: str, text: Column, loose: bool) -> Column:
    """Matches with their places (code points) and what stands around them, as an array of structs."""
    pattern = (LOOSE if loose else STRICT)[kind]
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(gaps.alias("gap"), F.concat(matches, F.array(F.lit(""))).alias("match"))
    # what stands behind a match is the next gap; the last part has no match
    tied = F.transform(
        F.array(parts),
        lambda p: F.transform(
            F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))),
            lambda x, i: F.struct(
                x["match"].alias("match"),
                F.lower(F.substring(x["gap"], -BEFORE, BEFORE)).alias("before"),
                F.substring(F.get(p, i + 1)["gap"], 1, BEHIND).alias("behind"),
                F.length(x["gap"]).alias("skip"),
            ),
        ),
    )[0]
    empty = F.array().cast("array<struct<start:int,match:string,before:string,behind:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    step = lambda s, x: F.struct(
        (s["at"] + x["skip"] + F.length(x["match"])).alias("at"),
        F.concat(s["out"], F.array(F.struct((s["at"] + x["skip"]).alias("start"), x["match"], x["before"], x["behind"]))).alias("out"),
    )
    placed = F.aggregate(tied, start, step, lambda s: s["out"])
    strict = F.lit(False) if loose else None
    spans = F.transform(
        placed,
        lambda x: F.struct(
            x["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("kind"),
            (x["start"] + F.length(x["match"])).alias("past"),
            (strict if loose else passes(kind, x["match"])).alias("base"),
            _votes(kind, x, loose).alias("votes"),
        ),
    )
    nothing = F.array().cast("array<struct<start:int,kind:int,past:int,base:boolean,votes:string>>")
    return F.when(_needs(kind, loose, text), spans).otherwise(nothing)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, "+").when(no, "-").otherwise("0")


def _votes(kind: str, x: Column, loose: bool) -> Column:
    """One character per labeler, in the order of ``VOTES``: + for, - against, 0 no opinion."""
    match, before, behind = x["match"], x["before"], x["behind"]
    digits = _digits(match)
    never = F.lit(False)
    pattern = F.lit("0") if loose else _vote(passes(kind, match), F.lit(True))
    context = _vote(before.rlike(CUES[kind]) & ~before.rlike(AGAINST), before.rlike(AGAINST))
    if kind == "email":
        known = F.lower(F.regexp_extract(match, r"([A-Za-z]+)$", 1)).isin(*DOMAINS)
        shape = _vote(F.length(match).between(6, 254), F.lit(True))
    elif kind == "ip":
        first = F.substring_index(match, ".", 1).try_cast("int")
        known = F.coalesce(first.between(1, 223), never)
        shape = _vote(~match.rlike(r"(^|\.)0[0-9]"), F.lit(True))
    elif kind == "card":
        known = digits.rlike("^(4|5[1-5]|2[2-7]|3[47]|6)")
        shape = _vote(match.rlike(r"^([0-9]+|[0-9]{4}([ -][0-9]{4}){2,3}([ -][0-9]{1,4})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$"), F.lit(True))
    elif loose:
        known = digits.rlike("^[2-9][0-9]{2}")
        shape = _vote(F.length(digits) == 10, F.lit(True))
    else:
        known = digits.rlike(f"^({'|'.join(CALLING)})")
        shape = _vote(match.rlike(r"[ ().-]") & ~match.rlike(r"[ .-]{3,}|\($"), match.rlike(r"[ .-]{3,}"))
    border = _vote(~before.rlike(r"[a-z0-9_.+-]$") & ~behind.rlike(r"[A-Za-z0-9_]"), F.lit(True))
    return F.concat(pattern, _vote(known, F.lit(True)), context, shape, border)


def proposals(text: Column) -> Column:
    """All proposed spans of a text: strict matches, and loose ones that no strict span overlaps."""
    strict = F.concat(*[_proposals(k, text, False) for k in KINDS])
    loose = F.concat(*[_proposals(k, text, True) for k in LOOSE])
    return F.transform(
        F.array(F.struct(strict.alias("s"), loose.alias("l"))),
        lambda b: F.concat(
            b["s"], F.filter(b["l"], lambda x: ~F.exists(b["s"], lambda y: y["base"] & (y["start"] < x["past"]) & (x["start"] < y["past"])))
        ),
    )[0]


@dataclass(frozen=True)
class Reliability:
    """What was learnt of one kind: its share of true spans, for each labeler how often it votes what on true and on false ones."""

    prior: float
    on_true: list[dict[str, float]]
    on_false: list[dict[str, float]]


def estimate(counts: dict[str, int], rounds: int = ROUNDS) -> tuple[Reliability, dict[str, float]]:
    """Expectation-maximisation over counts of vote patterns; also the probability of a true span for each pattern.

    It begins from the belief that votes are right more often than not, which tells the two classes apart. What fails a strict
    pattern's own test is false for sure: it shows how the other labelers vote on false spans.
    """
    n = len(VOTES)
    true = [{"+": 0.7, "0": 0.2, "-": 0.1} for _ in range(n)]
    false = [{"+": 0.25, "0": 0.25, "-": 0.5} for _ in range(n)]
    prior, belief = 0.5, {}
    for _ in range(rounds):
        for votes in counts:
            a = math.log(prior) + sum(math.log(true[i][v]) for i, v in enumerate(votes))
            b = math.log(1 - prior) + sum(math.log(false[i][v]) for i, v in enumerate(votes))
            belief[votes] = 0.0 if votes[0] == "-" else 1 / (1 + math.exp(max(-700.0, min(700.0, b - a))))
        total = sum(counts.values())
        mass = sum(c * belief[v] for v, c in counts.items())
        prior = (mass + 1) / (total + 2)
        for i in range(n):
            for v in "+0-":
                share = sum(c * belief[p] for p, c in counts.items() if p[i] == v)
                every = sum(c for p, c in counts.items() if p[i] == v)
                true[i][v] = (share + 2 * {"+": 0.7, "0": 0.2, "-": 0.1}[v]) / (mass + 2)
                false[i][v] = (every - share + 2 * {"+": 0.25, "0": 0.25, "-": 0.5}[v]) / (total - mass + 2)
    return Reliability(prior, true, false), belief


def train(counts: dict[str, int], belief: dict[str, float], steps: int = STEPS) -> list[float]:
    """Weights of a logistic classifier on the votes (for, against, of each labeler; bias first), fitted to the beliefs."""
    patterns = list(counts)
    weights = [0.0] * (1 + 2 * len(VOTES))
    total = sum(counts.values()) or 1
    rows = [([1.0] + [float(v == s) for v in p for s in "+-"], counts[p] / total, belief[p]) for p in patterns]
    for _ in range(steps):
        slope = [0.02 * w for w in weights]
        slope[0] = 0.0
        for x, share, y in rows:
            z = sum(a * b for a, b in zip(weights, x))
            error = share * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y)
            for k, a in enumerate(x):
                slope[k] += error * a
        weights = [w - 1.0 * g for w, g in zip(weights, slope)]
    return weights


@dataclass(frozen=True)
class Labelers:
    """The learnt part: for each kind its labelers' reliabilities and the classifier's weights."""

    reliability: dict[int, Reliability]
    weights: dict[int, list[float]]

    def probability(self, kind: Column, votes: Column) -> Column:
        out = F.lit(0.0)
        for k, w in sorted(self.weights.items()):
            z = F.lit(float(w[0]))
            for i in range(len(VOTES)):
                vote = F.substring(votes, i + 1, 1)
                z = z + F.when(vote == "+", float(w[1 + 2 * i])).when(vote == "-", float(w[2 + 2 * i])).otherwise(0.0)
            out = F.when(kind == k, 1 / (1 + F.exp(-z))).otherwise(out)
        return F.when(F.substring(votes, 1, 1) == "-", 0.0).otherwise(out)


def learn(proposed: DataFrame) -> Labelers:
    """Learns from all proposed spans (column ``proposed``): one count per kind and vote pattern is collected."""
    spans = proposed.select(F.explode("proposed").alias("s"))
    counts: dict[int, dict[str, int]] = {}
    for r in spans.groupBy("s.kind", "s.votes").count().collect():
        counts.setdefault(r["kind"], {})[r["votes"]] = r["count"]
    reliability, weights = {}, {}
    for kind, own in counts.items():
        own = dict(sorted(own.items()))
        reliability[kind], belief = estimate(own)
        weights[kind] = train(own, belief)
    return Labelers(reliability, weights)


def find(docs: DataFrame, carry: list[str] | None = None, least: float = 0.9) -> DataFrame:
    """Personal data in every whole text: ``carry`` (all columns by default) and ``spans``, sorted by place and kind.

    A span is ``struct<start, kind, past, base, probability>``: code points from 0, ``past`` exclusive, ``kind`` the number
    in ``KINDS``. Every match of a strict pattern that passes its test stays (``base``), one that fails is none; proposals of
    the looser forms are added from a probability of ``least`` on. Null and empty texts have none; rows may repeat; an empty table learns
    nothing; a column that is called like an added one gives way to it.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c != "spans"]
    kept = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    proposed = written(docs.select(*kept, proposals(F.coalesce(F.col("text"), F.lit(""))).alias("proposed")), "proposed")
    labelers = learn(proposed)
    scored = F.transform(
        "proposed",
        lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["past"].alias("past"), s["base"].alias("base"), labelers.probability(s["kind"], s["votes"]).alias("probability")),
    )
    spans = F.sort_array(F.filter(scored, lambda s: s["base"] | (s["probability"] >= least)))
    return proposed.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], spans.alias("spans"))


def text_form(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["past"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each stretch that spans cover replaced by its first span's kind in angle brackets; null stays null."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda s, x: F.when(
        x["past"] <= s["at"], s
    ).otherwise(
        F.struct(
            x["past"].alias("at"),
            F.when(x["start"] < s["at"], s["out"])
            .otherwise(F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.get(names, x["kind"]))))
            .alias("out"),
        )
    )
    done = F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
