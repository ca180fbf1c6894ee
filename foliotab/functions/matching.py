"""Joins on containment and on edit similarity without comparing all pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import top_per_group
from .text import bound


def _grams(col: Column, size: int | Column) -> Column:
    """Distinct character grams; a shorter text is its own single gram."""
    size = F.lit(size) if isinstance(size, int) else size
    chars = F.filter(F.split(col, ""), lambda c: c != "")
    starts = F.sequence(F.lit(1), F.greatest(F.length(col) - size + 1, F.lit(1)))
    return F.array_distinct(bound(chars, lambda cs: F.transform(starts, lambda i: F.array_join(F.slice(cs, i, size), ""))))


def _word_grams(words: Column) -> Column:
    """Distinct hashes of three words in a row; needs at least three words."""
    return F.array_distinct(
        bound(
            words,
            lambda w: F.transform(
                F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
            ),
        )
    )


def _rarest(parts: DataFrame) -> DataFrame:
    """Per needle id the key that fewest needles have."""
    common = parts.groupBy("__g").agg(F.count("*").alias("__f"))
    best = parts.join(common, "__g").groupBy("__nid").agg(F.min(F.struct("__f", "__g")).alias("__a"))
    return best.select("__nid", F.col("__a.__g").alias("__g"))


def contains_join(needles: DataFrame, needle: str, hay: DataFrame, text: str, size: int = 6) -> DataFrame:
    """All (needle row, hay row) pairs with ``text`` containing ``needle``; exact, without comparing all pairs.

    The words of a needle, but for its first and last, occur whole and in a row in any text that contains it. A
    needle of five words or more is filed under one triple of those, the one fewest needles share, and texts look
    up their own triples. Shorter needles are filed under a character gram the same way. The substring test then
    decides. A needle has one key and a text's keys are distinct, so each pair is met once.

    Keys travel with 128-bit digests; texts are fetched for candidate pairs only, and rows join on the digests.
    """
    needles, hay = needles.withColumn("__nid", F.md5(F.col(needle))), hay.withColumn("__tid", F.md5(F.col(text)))
    distinct = needles.filter(F.length(needle) > 0).select("__nid", F.col(needle).alias("__n")).dropDuplicates(["__nid"])
    texts = cut_lineage(hay.select("__tid", F.col(text).alias("__t")).dropDuplicates(["__tid"]))
    words = F.split(F.col("__n"), r"\s+")
    inner = F.slice(words, F.lit(2), F.size(words) - 2)
    long_ = F.size(words) >= 5

    by_words = _rarest(distinct.filter(long_).select("__nid", F.explode(_word_grams(inner)).alias("__g")))
    of_text = F.split(F.col("__t"), r"\s+")
    probes = texts.filter(F.size(of_text) >= 3).select("__tid", F.explode(_word_grams(of_text)).alias("__g"))
    met = probes.join(by_words, "__g").select("__nid", "__tid")

    by_chars = cut_lineage(_rarest(distinct.filter(~long_).select("__nid", F.explode(_grams(F.col("__n"), size)).alias("__g"))))
    if not by_chars.isEmpty():
        sizes = by_chars.agg(F.collect_set(F.length("__g")).alias("__sizes"))  # one row, at most `size` lengths
        probes = (
            texts.join(F.broadcast(sizes))
            .select("__tid", "__t", F.explode("__sizes").alias("__k"))
            .filter(F.length("__t") >= F.col("__k"))
            .select("__tid", F.explode(_grams(F.col("__t"), F.col("__k"))).alias("__g"))
        )
        met = met.union(probes.join(by_chars, "__g").select("__nid", "__tid"))
    pairs = met.join(distinct, "__nid").join(texts, "__tid").filter(F.col("__t").contains(F.col("__n"))).select("__nid", "__tid")
    return needles.join(pairs, "__nid").join(hay, "__tid").drop("__nid", "__tid")


def similar_names(left: DataFrame, a: str, right: DataFrame, b: str, cut: float) -> DataFrame:
    """Pairs of distinct lower-cased names with edit ratio >= cut; exact, without comparing all pairs.

    With n the longer length, a match has at most d = floor((1 - cut) * n) edits, and one edit destroys at most
    two of the longer name's bigrams. So if it has more than 2d distinct bigrams, its 2d + 1 rarest hold one that
    the shorter name shares. Other (short or repetitive) names share at least one character, as d < n; the
    same argument leaves their d + 1 rarest characters to look at.
    """
    ln = left.select(F.lower(F.col(a)).alias("n")).filter("n <> ''").distinct()
    rn = right.select(F.lower(F.col(b)).alias("n")).filter("n <> ''").distinct()

    def cut_up(df: DataFrame) -> DataFrame:
        edits = F.floor((1.0 - cut) * F.length("n") + 1e-9)
        df = df.withColumns({"g1": _grams(F.col("n"), 1), "g2": _grams(F.col("n"), 2), "d": edits})
        return df.withColumn("strong", (F.length("n") >= 2) & (F.size("g2") > 2 * F.col("d")))

    ln, rn = cut_up(ln), cut_up(rn)

    def side(longer: DataFrame, shorter: DataFrame, strict: bool) -> DataFrame:
        both = F.array_distinct(F.concat("g1", "g2"))  # a key's length says which of the two it is
        other = shorter.select(F.col("n").alias("short"), both.alias("grams"), F.explode(both).alias("g"))
        seen = other.groupBy("g").agg(F.count("*").alias("f"))
        mine = longer.select("n", "d", F.when(F.col("strong"), 2).otherwise(1).alias("per"), F.explode(F.when(F.col("strong"), F.col("g2")).otherwise(F.col("g1"))).alias("g"))
        mine = mine.join(seen, "g", "left").fillna({"f": 0}).groupBy("n", "d", "per")
        mine = mine.agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "g"))), lambda x: x["g"]).alias("all"))
        keep = F.least(F.size("all"), F.col("per") * F.col("d") + 1).cast("int")
        mine = mine.select(F.col("n").alias("long"), F.slice("all", F.lit(1), keep).alias("prefix"))
        mine = mine.select("long", "prefix", F.posexplode("prefix").alias("at", "g"))
        a, b = F.length("long"), F.length("short")
        fits = ((a > b) if strict else (a >= b)) & (b >= cut * a - 1e-9)
        # a pair that shares several keys is taken at the first of them only
        first = ~F.arrays_overlap(F.slice("prefix", F.lit(1), F.col("at")), F.col("grams"))
        limit = F.floor((1.0 - cut) * a + 1e-9).cast("int")
        met = mine.join(other, "g").filter(fits).filter(first).select("long", "short", F.call_function("levenshtein", "long", "short", limit).alias("edits"))
        ratio = 1.0 - F.col("edits") / a
        return met.filter("edits >= 0").select("long", "short", ratio.alias("similarity")).filter(F.col("similarity") >= cut)

    one = side(ln, rn, False).toDF("left_name", "right_name", "similarity")
    two = side(rn, ln, True).toDF("right_name", "left_name", "similarity")
    return one.unionByName(two)


#: Similarities at which ``nearest_names`` looks before it goes down to the cut.
LEVELS = (0.9, 0.8, 0.7)


def nearest_names(left: DataFrame, a: str, right: DataFrame, b: str, cut: float, k: int, levels: Sequence[float] = LEVELS) -> DataFrame:
    """(left_name, right_name, similarity, rank): the k names most alike with edit ratio >= cut, ties by name; exact.

    A tight ratio leaves few grams to meet on, a loose one nearly all. So names look for partners at falling ratios: one
    that finds k at a ratio needs no looser search, since all that is not found is less alike. Only names with fewer go on,
    the last of them down to the cut.
    """
    todo, out = left.select(F.lower(F.col(a)).alias("n")).filter("n <> ''").distinct(), []
    right = cut_lineage(right.select(F.lower(F.col(b)).alias("n")).filter("n <> ''").distinct())
    for level in [x for x in levels if x > cut] + [cut]:
        near = similar_names(todo, "n", right, "n", level)
        near = top_per_group(near, ["left_name"], [F.round("similarity", 9).desc(), F.col("right_name")], k)
        if level == cut:
            out.append(near)
            break
        near = cut_lineage(near)
        full = near.filter(F.col("rank") == k).select(F.col("left_name").alias("n"))
        out.append(near.join(full.withColumnRenamed("n", "left_name"), "left_name", "left_semi"))
        todo = cut_lineage(todo.join(full, "n", "left_anti"))
        if todo.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)
