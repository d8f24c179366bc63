"""Leaf codes as integers: subset joins, OR pairs and triples, basis and artificial leaf types.

A code's subsets are found by an equality join: every code lists the submasks of one short block of its bits, and meets the codes
whose block is one of them; the other bits are compared on the spot. Partners of a subset are then looked up by the lowest
bit that is still missing, so no list of codes is crossed with itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markertree.session import sized

BLOCK_BITS = 8
MAX_BITS = 62


def code_value(code: str = "code") -> Column:
    """Integer of a 0/1 string of at most 62 characters."""
    return F.conv(code, 2, 10).cast("bigint")


def _block(v: str, shift: int) -> Column:
    return F.shiftright(F.col(v), shift).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def _missing(c: str, *have: str) -> Column:
    """Bits of ``c`` that none of the others has."""
    out = F.col(c)
    for h in have:
        out = out.bitwiseAND(F.bitwise_not(F.col(h)))
    return out


def _lowest(bits: Column) -> Column:
    """Lowest set bit as a number, 0 for none."""
    return bits.bitwiseAND(-bits)


def best_shift(codes: DataFrame) -> int:
    """The block whose values differ most between codes (fewest expected pairs); one aggregate."""
    shifts = range(0, MAX_BITS, BLOCK_BITS)
    counts = codes.agg(*[F.approx_count_distinct(_block("v", s)).alias(str(s)) for s in shifts]).first()
    return max(shifts, key=lambda s: (counts[str(s)], -s))


def subset_pairs(targets: DataFrame, parts: DataFrame) -> DataFrame:
    """(c, a): values of ``targets`` and of ``parts`` (both distinct, column v) with a a subset of c."""
    shift = best_shift(parts)
    submasks = F.filter(F.sequence(F.lit(0), F.lit((1 << BLOCK_BITS) - 1)), lambda m: m.cast("bigint").bitwiseAND(F.bitwise_not(_block("c", shift))) == 0)
    left = targets.select(F.col("v").alias("c")).select("c", F.explode(submasks.cast("array<bigint>")).alias("_key"))
    right = parts.select(F.col("v").alias("a"), _block("v", shift).cast("bigint").alias("_key"))
    return left.join(right, "_key").filter(_missing("a", "c") == 0).select("c", "a")


def _by_bit(subsets: DataFrame, name: str) -> DataFrame:
    """(c, bit, name): each subset under every bit it has, and under 0 for targets that miss nothing."""
    bits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(MAX_BITS - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)),
                    lambda b: F.col("a").bitwiseAND(b) != 0)
    return subsets.select("c", F.explode(F.concat(F.array(F.lit(0).cast("bigint")), bits)).alias("bit"), F.col("a").alias(name))


def or_pair_values(subsets: DataFrame) -> DataFrame:
    """(c, a, b) with a <= b and a | b = c, from ``subset_pairs``; each pair of values once."""
    first = subsets.withColumn("bit", _lowest(_missing("c", "a")))
    met = first.join(_by_bit(subsets, "b"), ["c", "bit"]).filter(_missing("c", "a", "b") == 0)
    return met.select("c", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def or_triple_values(subsets: DataFrame) -> DataFrame:
    """(c, a, b, d) with a < b < d and a | b | d = c."""
    two = subsets.select("c", "a").join(subsets.select("c", F.col("a").alias("b")), "c").filter("a < b")
    met = two.withColumn("bit", _lowest(_missing("c", "a", "b"))).join(_by_bit(subsets, "d"), ["c", "bit"])
    met = met.filter((_missing("c", "a", "b", "d") == 0) & (F.col("d") != F.col("a")) & (F.col("d") != F.col("b")))
    three = F.array_sort(F.array("a", "b", "d"))
    return met.select("c", three[0].alias("a"), three[1].alias("b"), three[2].alias("d")).distinct()


def or_groups(codes: DataFrame, size: int) -> DataFrame:
    """Leaves (a, b[, d]) whose codes' OR is the code of another leaf c, each set of leaves once, in name order.

    ``codes``: (leaf, code). Pairs and triples are found on distinct values; leaves come back by equality joins.
    """
    leaves = codes.select("leaf", code_value().alias("v"))
    values = sized(leaves.select("v").distinct())
    subsets = sized(subset_pairs(values, values))
    names = ["a", "b", "d"][:size]
    if size == 2:
        met = or_pair_values(subsets)
    else:  # different leaves may share a code, so values may repeat
        same = or_pair_values(subsets)
        twice = same.select("c", "a", F.col("a").alias("b"), F.col("b").alias("d")).union(
            same.select("c", "a", "b", F.col("b").alias("d")))
        met = or_triple_values(subsets).union(twice).distinct()
    out = met
    for n in names:
        out = out.join(leaves.select(F.col("v").alias(n), F.col("leaf").alias(f"_{n}")), n)
    out = out.join(leaves.select(F.col("v").alias("c"), F.col("leaf").alias("_c")), "c")
    members = F.array_sort(F.array(*[f"_{n}" for n in names]))
    apart = F.size(F.array_distinct(F.array(*[f"_{n}" for n in names], "_c"))) == size + 1
    return out.filter(apart).select(*[members[i].alias(n) for i, n in enumerate(names)], F.col("_c").alias("c")).distinct()


def _pair_among(fits: np.ndarray, t) -> bool:
    for part in fits:
        rest = t & ~part
        if ((fits & rest) == rest).any():
            return True
    return False


def greedy_basis(values: np.ndarray) -> np.ndarray:
    """Size of the explaining groups of each code, in the given order: 0 a new basis code, 2 a pair, 3 a triple of basis codes.

    One pass over the codes by falling leaf size. A code that the basis holds already pairs with itself.
    """
    basis, count, seen = np.zeros(max(len(values), 1), np.int64), 0, set()
    out = np.zeros(len(values), np.int64)
    for n, t in enumerate(values.astype(np.int64)):
        if int(t) in seen:
            out[n] = 2
            continue
        fits = basis[:count]
        fits = fits[(fits & ~t) == 0]
        if len(fits) and np.bitwise_or.reduce(fits) == t:
            if _pair_among(fits, t):
                out[n] = 2
                continue
            if any(_pair_among(fits[i + 1:] | part, t) for i, part in enumerate(fits)):
                out[n] = 3
                continue
        basis[count] = t
        count += 1
        seen.add(int(t))
    return out


def leaf_types(codes: DataFrame) -> DataFrame:
    """(leaf, n, code, basis, groups, merge_constant) from (leaf, n, code).

    The greedy choice is a chain over the leaves by falling size (ties by name), so it runs in one task on the leaf-sized table;
    the explaining groups are joins on the basis. ``merge_constant`` is the largest product of the members' shares
    over the leaf's own share, ``groups`` the number of explaining groups.
    """
    shares = codes.join(codes.agg(F.sum("n").alias("_all")), how="cross").select("leaf", "n", "code", (F.col("n") / F.col("_all")).alias("share"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "leaf"], ascending=[False, True])
        return pdf.assign(size=greedy_basis(pdf["v"].to_numpy()))[["leaf", "n", "code", "share", "v", "size"]]

    typed = sized(shares.withColumn("v", code_value()).groupBy((F.col("n") * 0).alias("one")).applyInPandas(
        choose, "leaf string, n bigint, code string, share double, v bigint, size bigint"))
    basis = typed.filter("size = 0").select("v", F.col("share").alias("s"))  # distinct values by construction
    subsets = sized(subset_pairs(typed.filter("size > 0").select("v").distinct(), basis.select("v")))
    share = lambda n: basis.select(F.col("v").alias(n), F.col("s").alias(f"s{n}"))
    pairs = or_pair_values(subsets).join(share("a"), "a").join(share("b"), "b").groupBy(F.col("c").alias("v")).agg(
        F.count("*").alias("g"), F.max(F.col("sa") * F.col("sb")).alias("p")).withColumn("size", F.lit(2).cast("bigint"))
    by_three = subsets.join(typed.filter("size = 3").select(F.col("v").alias("c")).distinct(), "c")
    triples = or_triple_values(by_three).join(share("a"), "a").join(share("b"), "b").join(share("d"), "d").groupBy(F.col("c").alias("v")).agg(
        F.count("*").alias("g"), F.max(F.col("sa") * F.col("sb") * F.col("sd")).alias("p")).withColumn("size", F.lit(3).cast("bigint"))
    return typed.join(pairs.union(triples), ["v", "size"], "left").select(
        "leaf", "n", "code", (F.col("size") == 0).cast("int").alias("basis"), F.coalesce("g", F.lit(0).cast("bigint")).alias("groups"),
        F.coalesce(F.col("p") / F.col("share"), F.lit(0.0)).alias("merge_constant"))
