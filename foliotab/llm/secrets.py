"""Secret scans with column expressions only: fixed patterns, and a randomness test battery over long tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliotab.session import cut_lineage

#: Kind -> (pattern, group that is measured, its least length), in the order of the kinds.
PATTERNS = {
    "assign": (r"(?i:(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: Alphabets by inferred encoding: the smallest that holds the token.
ALPHABETS = {
    "hex": ("^[0-9a-f]+$", "0123456789abcdef"),
    "upperhex": ("^[0-9A-F]+$", "0123456789ABCDEF"),
    "base32": ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base36": ("^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    "base62": ("^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    "base64": ("^.*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}
FALSE_RATE = 0.05
BINS_A_DECADE = 10
SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, also where ``body`` names it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def running(values: Column, block: int = 256) -> Column:
    """Running sums of an array of longs, by sums of blocks, so that long arrays stay cheap."""
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)

    def by_blocks(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda b: add(F.slice(xs, b * block + 1, F.lit(block))))
        ahead = let(blocks, lambda bs: F.transform(bs, lambda _, i: add(F.slice(bs, F.lit(1), i))))
        return let(ahead, lambda hs: F.transform(xs, lambda _, i: hs[F.floor(i / block).cast("int")] + add(F.slice(xs, F.floor(i / block).cast("int") * block + 1, i % block + 1))))

    return let(values, lambda xs: F.when(F.size(xs) > 0, by_blocks(xs)).otherwise(F.array().cast("array<bigint>")))


def matches(text: Column, pattern: str, group: int) -> Column:
    """All leftmost matches that do not overlap: array of (start, end, value), in code points, value the group's text."""
    whole, part = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)  # the text between matches

    def placed(x: Column) -> Column:
        steps = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["whole"])), x["whole"], lambda g, w: (F.length(g) + F.length(w)).cast("long"))
        return let(running(steps), lambda ends: F.transform(ends, lambda e, i: F.struct((e - F.length(x["whole"][i])).alias("start"), e.alias("end"), x["part"][i].alias("value"))))

    return let(F.struct(whole.alias("whole"), part.alias("part"), gaps.alias("gaps")), placed)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns by start, then kind. Patterns are only run where a text can match at all."""
    lower = F.lower(text)
    possible = {
        "assign": reduce(Column.__or__, [F.contains(lower, F.lit(k)) for k in KEYWORDS]),
        "access": F.contains(text, F.lit("AKIA")),
        "hex": text.rlike(PATTERNS["hex"][0]),
    }
    out = []
    for rank, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        found = F.filter(matches(text, pattern, group), _longer(least))
        out.append(F.when(possible[kind], F.transform(found, _span(kind, rank))).otherwise(F.array().cast(SPAN)))
    return F.array_sort(F.concat(*out))


def _longer(least: int):
    return lambda m: F.length(m["value"]) >= least


def _span(kind: str, rank: int):
    return lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"))


def two_sided(z: Column) -> Column:
    """Chance that a normal deviate is as far from 0 as z (absolute error below 2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def battery(token: Column) -> Column:
    """(stratum, bin): encoding and length class, and -log10 of the chance of such a token under randomness, in tenths.

    Three tests over the places of the token's characters in the alphabet of its inferred encoding: chi-squared against
    equal use of all letters (exact mean and variance, which also hold for short tokens), the number of runs in the lower
    and upper half, and correlation of neighbours. Their chances are combined by Fisher's method.
    """
    kind = reduce(lambda rest, k: F.when(token.rlike(ALPHABETS[k][0]), F.lit(k)).otherwise(rest), list(ALPHABETS)[-2::-1], F.lit("base64"))
    alphabet = F.create_map(*[F.lit(x) for k, (_, a) in ALPHABETS.items() for x in (k, a)])
    floor = lambda p: F.greatest(p, F.lit(1e-100))

    def tests(x: Column) -> Column:
        v, n, m = x["v"], x["n"], x["m"]
        squares = total(F.transform(F.array_distinct(v), lambda c: F.pow(F.size(F.filter(v, lambda y: y == c)).cast("double"), F.lit(2.0))))
        chi = (m / n * squares - n - (m - 1)) / F.sqrt(2 * (m - 1) * (n - 1) / n)
        uniform = F.when(chi > 0, two_sided(chi) / 2).otherwise(F.lit(0.5))
        upper = total(F.transform(v, lambda y: F.when(y >= m / 2, 1.0).otherwise(0.0)))
        turns = 1 + total(F.transform(v, lambda y, i: F.when((i > 0) & ((y >= m / 2) != (v[F.greatest(i - 1, F.lit(0))] >= m / 2)), 1.0).otherwise(0.0)))
        expected = 2 * upper * (n - upper) / n + 1
        spread = (expected - 1) * (expected - 2) / (n - 1)
        constant = F.pow(F.lit(0.5), n - 1)
        runs = F.when(spread > 0, two_sided((turns - expected) / F.sqrt(spread))).otherwise(constant)
        mean = total(v) / n
        around = total(F.transform(v, lambda y: (y - mean) * (y - mean)))
        lagged = total(F.transform(v, lambda y, i: F.when(i > 0, (y - mean) * (v[F.greatest(i - 1, F.lit(0))] - mean)).otherwise(0.0)))
        serial = F.when(around > 0, two_sided((lagged / around + 1 / n) * F.sqrt(n))).otherwise(constant)
        nats = -(F.log(floor(uniform)) + F.log(floor(runs)) + F.log(floor(serial)))
        decades = (nats - F.log(1 + nats + nats * nats / 2)) / F.log(F.lit(10.0))
        stratum = F.concat_ws("/", x["kind"], F.floor(F.log2(n)).cast("string"))
        return F.struct(stratum.alias("stratum"), F.greatest(F.floor(decades * BINS_A_DECADE), F.lit(0)).cast("int").alias("bin"))

    def placed(k: Column) -> Column:
        plain = F.translate(token, "-_", "+/")
        places = F.transform(F.split(plain, ""), lambda c: (F.instr(k["letters"], c) - 1).cast("double"))
        return let(F.struct(k["kind"].alias("kind"), places.alias("v"), F.length(token).cast("double").alias("n"), F.length(k["letters"]).cast("double").alias("m")), tests)

    return let(let(kind, lambda k: F.struct(k.alias("kind"), F.element_at(alphabet, k).alias("letters"))), placed)


def secret_spans(docs: DataFrame, false_rate: float = FALSE_RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``base`` and ``added`` (arrays of start, rank, end, kind; code points, end exclusive).

    ``base`` holds the matches of the fixed patterns. ``added`` holds further tokens of 20 characters or more with digits
    and letters (kind ``random``) that do not touch a base span and pass the battery: their randomness is not rejected.
    What is rejected is decided by false-discovery control in each stratum of encoding and length class, over all
    documents: the chances of a stratum are counted in bins, and the step-up rule at ``false_rate`` sets the bin from
    which tokens count as ordinary. Strata keep the many short tokens from setting the bar of the few long ones. At most
    a few hundred strata exist, so their bars go to the driver; nothing else does.

    Null texts count as empty; null ids and repeated rows are kept. Tokens are judged by occurrence, a copy as its origin.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digits_and_letters = lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]")
    tokens = F.when(text.rlike(TOKEN), F.filter(matches(text, TOKEN, 0), digits_and_letters))
    scan = docs.select(F.col(id_col), base_spans(text).alias("base"), tokens.alias("tokens"))
    free = lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    judged = F.transform(F.filter("tokens", free), lambda t: F.struct(t["start"], t["end"], battery(t["value"]).alias("test")))
    scan = cut_lineage(scan.select(id_col, "base", judged.alias("judged")))
    bars = {r["stratum"]: r["bar"] for r in _bars(scan, false_rate).collect()}
    if not bars:
        added = F.array().cast(SPAN)
    else:
        bar = lambda t: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in bars.items() for x in pair]), t["test"]["stratum"]), F.lit(2**31 - 1))
        kept = F.filter("judged", lambda t: t["test"]["bin"] < bar(t))
        added = F.coalesce(F.transform(kept, _span("random", len(PATTERNS))), F.array().cast(SPAN))
    return scan.select(id_col, "base", added.alias("added"))


def _bars(scan: DataFrame, false_rate: float) -> DataFrame:
    """Per stratum the least bin that the step-up rule rejects; strata without one are left out."""
    counted = scan.select(F.explode("judged").alias("x")).groupBy("x.test.stratum", "x.test.bin").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("stratum").orderBy(F.desc("bin"))
    ranked = counted.withColumn("at_least", F.sum("n").over(down)).withColumn("all", F.sum("n").over(Window.partitionBy("stratum")))
    return ranked.where(F.pow(F.lit(10.0), -F.col("bin") / BINS_A_DECADE) <= false_rate * F.col("at_least") / F.col("all")).groupBy("stratum").agg(F.min("bin").alias("bar"))


def written(spans: Column) -> Column:
    """kind:start:end, joined with commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
