"""Projections, filters, recodes, ordering helpers and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markertree.session import attach_row, sized


def keep_members(df: DataFrame, members: DataFrame, on: list[str] | str) -> DataFrame:
    """Filter by an id table; a semi-join, never a literal list."""
    keys = [on] if isinstance(on, str) else list(on)
    return df.join(members.select(*keys), keys, "left_semi")


def drop_members(df: DataFrame, members: DataFrame, on: list[str] | str) -> DataFrame:
    keys = [on] if isinstance(on, str) else list(on)
    return df.join(members.select(*keys), keys, "left_anti")


def candidate_features(features: DataFrame, parent_key: list[str], exclude: list[str] = (),
                       include: list[str] | None = None) -> DataFrame:
    """Scan list minus the parent's key and the exclusions (all short parameter lists)."""
    out = features
    if include is not None:
        out = out.filter(F.col("feature").isin(list(include)))
    banned = [*parent_key, *exclude]
    return out.filter(~F.col("feature").isin(banned)) if banned else out


def component_names(df: DataFrame, array: str, prefix: str, ids: list[str], first: int = 0) -> DataFrame:
    """Array to long rows named ``<prefix><i>``."""
    return df.select(*ids, F.posexplode(array).alias("_i", "value")).select(
        *ids, F.concat(F.lit(prefix), (F.col("_i") + first).cast("string")).alias("feature"), "value"
    )


def rekey(column: str, suffix: str, strip: int = 2) -> Column:
    """Strip the last characters of an id and append a suffix."""
    return F.concat(F.expr(f"substring({column}, 1, length({column}) - {strip})"), F.lit(suffix))


def recode_composite(column: str, multi: str = "multi(>2)") -> Column:
    """``[a][a]`` becomes ``[a]``; codes of more than two parts become one class."""
    c = F.col(column)
    same = (F.length(c) == 6) & (F.substring(c, 2, 1) == F.substring(c, 5, 1))
    return F.when(F.length(c) > 7, F.lit(multi)).when(same, F.substring(c, 1, 3)).otherwise(c)


def null_to(column: str, sentinel: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(sentinel))


def gate(conditions: list[Column]) -> Column:
    """1 where every threshold holds, else 0 (unknown counts as 0)."""
    both = conditions[0]
    for c in conditions[1:]:
        both = both & c
    return F.when(both, F.lit(1)).otherwise(F.lit(0))


def hashed_order(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """Reproducible shuffle: order by a hash of the keys; labels stay aligned because rows move whole."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys)


def hashed_sample(df: DataFrame, fraction: float, seed: int, *keys: str) -> DataFrame:
    """Reproducible sampling operator: keep rows whose key hash falls under the fraction."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000))
    return df.filter(bucket < int(fraction * 1_000_000))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """Top-n rows per group. Spark keeps only n rows per group and task before the shuffle
    (the rank filter is pushed below the window), so a hot group is not gathered whole."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def extreme_features(loadings: DataFrame, group: list[str], value: str, n: int) -> DataFrame:
    """n largest and n smallest loadings per group, distinct."""
    cols = [*group, "feature", value]
    high = top_per_group(loadings, group, [F.desc(value), F.asc("feature")], n).select(*cols)
    low = top_per_group(loadings, group, [F.asc(value), F.asc("feature")], n).select(*cols)
    return high.union(low).distinct()


def cumulative_share(counts: DataFrame, n: str = "n", tie: str = "leaf") -> DataFrame:
    """Groups by size with running total and share. Takes a table of group counts (leaf-sized)."""
    w = Window.orderBy(F.desc(n), F.asc(tie)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = counts.agg(F.sum(n).alias("_t"))
    return (
        attach_row(counts, total)
        .withColumn("cum_n", F.sum(n).over(w))
        .withColumn("cum_share", F.col("cum_n") / F.col("_t"))
        .drop("_t")
    )


def elbow(curve: DataFrame, by: list[str], k: str = "k", value: str = "bic") -> DataFrame:
    """Point of each curve farthest from the chord through its first and last point."""
    order = Window.partitionBy(*by).orderBy(k)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v0, v1 = F.first(value).over(whole), F.last(value).over(whole)
    k0, k1 = F.first(k).over(whole), F.last(k).over(whole)
    dist = F.abs((v1 - v0) * (F.col(k) - k0) - (k1 - k0) * (F.col(value) - v0)) / F.sqrt(
        (v1 - v0) * (v1 - v0) + (k1 - k0) * (k1 - k0)
    )
    scored = curve.withColumn("distance", F.coalesce(dist, F.lit(0.0)))
    return scored.groupBy(*by).agg(F.max_by(k, F.struct(F.col("distance"), -F.col(k))).alias("elbow"))


def choose_k(curve: DataFrame, by: list[str], mode: str = "bic") -> DataFrame:
    """Number of components: the smaller of minimum and elbow, or either alone."""
    lowest = curve.groupBy(*by).agg(F.min_by("k", F.struct("bic", "k")).alias("argmin"))
    both = lowest.join(elbow(curve, by), list(by))
    pick = {"bic": F.least("argmin", "elbow"), "bic_min": F.col("argmin"), "bic_elbow": F.col("elbow")}[mode]
    return both.withColumn("k_best", pick)


def shared_features(long: DataFrame, batch: str = "batch") -> DataFrame:
    """Features present in every batch."""
    pairs = long.select(batch, "feature").distinct()
    batches = pairs.agg(F.countDistinct(batch).alias("_b"))
    counts = pairs.groupBy("feature").agg(F.count(F.lit(1)).alias("_n"))
    return attach_row(counts, batches).filter(F.col("_n") == F.col("_b")).select("feature")


def union_shared(long: DataFrame, batch: str = "batch") -> DataFrame:
    """Union of batches restricted to the features they all have."""
    return long.join(sized(shared_features(long, batch)), "feature", "left_semi")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of two id sets, of their intersection and differences, in one aggregate."""
    tagged = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).union(
        b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    per = tagged.groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return per.agg(
        F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"),
        F.sum(F.col("_a") * F.col("_b")).alias("n_both"),
        F.count_if((F.col("_a") == 1) & (F.col("_b") == 0)).alias("n_only_a"),
        F.count_if((F.col("_a") == 0) & (F.col("_b") == 1)).alias("n_only_b"),
    )


def held_out_split(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """Train/test tag by a hash of the row id."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000))
    return df.withColumn("split", F.when(bucket < int(share * 1_000_000), "test").otherwise("train"))


def held_out_tail(df: DataFrame, key: str, share: float) -> DataFrame:
    """First (1-p) rows by a numeric id train, the rest test; the cut is one aggregate."""
    n = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    from markertree.operators.quantiles import exact_quantiles

    keep = max(int(n * (1.0 - share)), 1)
    position = (keep - 1) / max(n - 1, 1)
    cut = exact_quantiles(df, [], key, [position])
    return attach_row(df, cut).withColumn("split", F.when(F.col(key) <= F.col("q0") + 0.5, "train").otherwise("test")).drop("q0")
