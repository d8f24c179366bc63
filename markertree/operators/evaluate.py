"""Clustering agreement, separation audits and benchmark summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markertree.session import attach_row


def contingency(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def _pairs(n):
    return F.col(n) * (F.col(n) - 1) / F.lit(2.0)


def rand_indices(table: DataFrame) -> DataFrame:
    """Rand and adjusted Rand index from a contingency table."""
    cells = table.agg(F.sum(_pairs("n")).alias("_both"), F.sum("n").alias("_n"))
    rows = table.groupBy("truth").agg(F.sum("n").alias("n")).agg(F.sum(_pairs("n")).alias("_t"))
    cols = table.groupBy("pred").agg(F.sum("n").alias("n")).agg(F.sum(_pairs("n")).alias("_p"))
    one = attach_row(attach_row(cells, rows), cols)
    total = F.col("_n") * (F.col("_n") - 1) / F.lit(2.0)
    expected = F.col("_t") * F.col("_p") / total
    return one.select(
        ((total + F.lit(2.0) * F.col("_both") - F.col("_t") - F.col("_p")) / total).alias("rand"),
        ((F.col("_both") - expected) / ((F.col("_t") + F.col("_p")) / F.lit(2.0) - expected)).alias("adjusted_rand"),
    )


def _log_factorial(n):
    """ln n! for a whole-number column: exact sums up to 20, Stirling's series beyond (error < 1e-13)."""
    x = n.cast("double") + F.lit(1.0)
    inv = F.lit(1.0) / x
    series = inv * (F.lit(1.0 / 12) - inv * inv * (F.lit(1.0 / 360) - inv * inv * (F.lit(1.0 / 1260) - inv * inv * F.lit(1.0 / 1680))))
    stirling = (x - 0.5) * F.log(x) - x + F.lit(0.9189385332046727) + series
    small = F.aggregate(F.sequence(F.lit(0), F.greatest(F.least(n, F.lit(20)), F.lit(0)).cast("int")),
                        F.lit(0.0), lambda s, i: s + F.log(F.greatest(i, F.lit(1)).cast("double")))
    return F.when(n <= 20, small).otherwise(stirling)


def adjusted_mutual_info(table: DataFrame) -> DataFrame:
    """Adjusted mutual information (arithmetic normaliser).

    The expected value sums hypergeometric terms over all cell counts that two marginals allow.
    Only the distinct pairs of marginal sizes matter, and each pair's range of counts is spread
    over tasks as rows, so nothing is held in one place.
    """
    n_all = table.agg(F.sum("n").alias("total_n"))
    rows = table.groupBy("truth").agg(F.sum("n").alias("a"))
    cols = table.groupBy("pred").agg(F.sum("n").alias("b"))
    N = F.col("total_n").cast("double")
    joint = attach_row(table.join(rows, "truth").join(cols, "pred"), n_all)
    mi = joint.agg(F.sum(F.col("n") / N * F.log(N * F.col("n") / (F.col("a") * F.col("b")))).alias("mi"))
    entropy = lambda t, c, name: attach_row(t, n_all).agg((-F.sum(F.col(c) / N * F.log(F.col(c) / N))).alias(name))
    # marginal sizes repeat; keep each distinct size once with its multiplicity
    ra = rows.groupBy("a").agg(F.count(F.lit(1)).alias("na"))
    cb = cols.groupBy("b").agg(F.count(F.lit(1)).alias("nb"))
    sizes = cb.agg(F.collect_list(F.struct("b", "nb")).alias("_cols"))
    spread = attach_row(ra, sizes).select("a", "na", F.explode("_cols").alias("_c")).select("a", "na", "_c.b", "_c.nb")
    pairs = attach_row(spread, n_all)
    # counts farther than this from their mean have probability below e^-100 and add nothing in double
    mean = F.col("a") * F.col("b") / N
    sd = F.sqrt(mean * (F.lit(1.0) - F.col("a") / N) * (F.lit(1.0) - F.col("b") / N))
    reach = F.lit(15.0) * sd + F.lit(800.0)
    low = F.greatest(F.lit(1).cast("bigint"), F.col("a") + F.col("b") - F.col("total_n"), F.floor(mean - reach))
    high = F.least(F.col("a"), F.col("b"), F.ceil(mean + reach))
    terms = pairs.filter(low <= high).select("*", F.explode(F.sequence(low, high)).alias("x"))
    a, b, x = F.col("a"), F.col("b"), F.col("x")
    lf = _log_factorial
    log_p = (lf(a) + lf(b) + lf(F.col("total_n") - a) + lf(F.col("total_n") - b) - lf(F.col("total_n"))
             - lf(x) - lf(a - x) - lf(b - x) - lf(F.col("total_n") - a - b + x))
    emi = terms.agg(F.sum(F.col("na") * F.col("nb") * x / N * F.log(N * x / (a * b)) * F.exp(log_p)).alias("emi"))
    one = attach_row(attach_row(attach_row(mi, entropy(rows, "a", "ht")), entropy(cols, "b", "hp")), emi)
    return one.select(
        "mi", "emi",
        ((F.col("mi") - F.col("emi")) / ((F.col("ht") + F.col("hp")) / 2.0 - F.col("emi"))).alias("adjusted_mutual_info"),
    )


def distance_sum(a, b, cells: int = 4_000_000):
    """(sum of the Euclidean distances of all rows of ``a`` to all rows of ``b``, their number), at most ``cells`` numbers at a time.

    Squares come from products of matrices. Where rows are so close that this loses digits (or not finite), their differences are taken.
    """
    import numpy as np

    if not len(a) or not len(b):
        return 0.0, 0
    middle = np.nan_to_num(b.mean(axis=0), nan=0.0, posinf=0.0, neginf=0.0)
    with np.errstate(invalid="ignore", over="ignore"):
        a, b = a - middle, b - middle
        a2, b2 = (a * a).sum(axis=1), (b * b).sum(axis=1)
        total, step, few = 0.0, max(1, cells // len(b)), max(1, cells // a.shape[1])
        for at in range(0, len(a), step):
            part = a[at:at + step]
            both = a2[at:at + step, None] + b2
            square = both - 2.0 * (part @ b.T)
            i, j = np.nonzero(~(square > 1e-6 * both))
            for k in range(0, len(i), few):
                u, v = i[k:k + few], j[k:k + few]
                square[u, v] = ((part[u] - b[v]) ** 2).sum(axis=1)
            total += np.sqrt(square).sum()
    return total, len(a) * len(b)


def group_distances(df: DataFrame, node: str, group: str, id_: str, array: str, chunk: int = 4096, share: float = 1.0,
                    wanted: list[tuple[str, str]] | None = None) -> DataFrame:
    """(node, a, b, pairs, distance, error): mean Euclidean distance between the groups of each node, a <= b by name.

    Within a group all ordered pairs count, a row with itself included, as a full distance matrix does. A node's rows are dealt
    by hash into parts of about ``chunk`` rows, and every two parts meet in one task as matrices; only sums come out. The
    work is the square of a node's rows. ``share`` < 1 takes that part of the meetings, chosen by hash: the mean
    is then an estimate from whole random parts, and ``error`` its standard error (0 when exact, null for a single meeting).
    ``wanted`` names the pairs (a, b) of groups to measure; all by default.
    """
    import numpy as np
    import pandas as pd

    from markertree.session import sized

    if not 0 < share <= 1:
        raise ValueError("share lies in (0, 1]")
    rows = df.select(F.col(node).alias("node"), F.col(group).cast("string").alias("g"), F.col(id_).alias("id"), F.col(array).cast("array<double>").alias("x")).dropna()
    parts = sized(rows.groupBy("node").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts")))
    dealt = rows.join(parts, "node").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    fanned = dealt.select("node", "g", "part", "x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("peer")).select(
        "node", "g", "part", "x", F.least("part", "peer").alias("lo"), F.greatest("part", "peer").alias("hi"))
    if share < 1:
        fanned = fanned.filter(F.pmod(F.xxhash64(F.lit(17), "node", "lo", "hi"), F.lit(1 << 20)) < int(share * (1 << 20)))
    kind = rows.schema["node"].dataType.simpleString()

    def meet(key, pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = key[1], key[2]
        x, part, g = np.vstack(pdf["x"].to_numpy()), pdf["part"].to_numpy(), pdf["g"].to_numpy(dtype=object)
        names, code = np.unique(g.astype(str), return_inverse=True)
        left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        total, count = np.zeros((len(names),) * 2), np.zeros((len(names),) * 2)
        for i, j in np.ndindex(total.shape):
            if (lo == hi and i > j) or (wanted is not None and (names[min(i, j)], names[max(i, j)]) not in wanted):
                continue
            total[i, j], count[i, j] = distance_sum(x[left[code[left] == i]], x[right[code[right] == j]])
        if lo != hi:  # the other order of the two parts
            total, count = total + total.T, count + count.T
        out = [(key[0], a, b, total[i, j], count[i, j]) for i, a in enumerate(names) for j, b in enumerate(names) if i <= j and count[i, j]]
        return pd.DataFrame(out, columns=["node", "a", "b", "total", "pairs"])

    met = fanned.groupBy("node", "lo", "hi").applyInPandas(meet, f"node {kind}, a string, b string, total double, pairs double")
    error = F.lit(0.0) if share == 1 else F.stddev_samp(F.col("total") / F.col("pairs")) / F.sqrt(F.count("*"))
    return met.groupBy("node", "a", "b").agg(
        F.sum("pairs").cast("bigint").alias("pairs"), (F.sum("total") / F.sum("pairs")).alias("distance"), error.alias("error")
    ).withColumnRenamed("node", node)


def side_separation(df: DataFrame, node: str, side: str, array: str, id_: str, **options) -> DataFrame:
    """Mean Euclidean distance within and across the sides L and R of each node; see ``group_distances``."""
    both = group_distances(df.filter(F.col(side).isin("L", "R")), node, side, id_, array, **options)
    pick = lambda a, b, c: F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col(c)))
    size = lambda s: F.round(F.sqrt(pick(s, s, "pairs"))).cast("bigint")
    return both.groupBy(node).agg(
        size("L").alias("n_left"), size("R").alias("n_right"), pick("L", "L", "distance").alias("within_left"),
        pick("R", "R", "distance").alias("within_right"), pick("L", "R", "distance").alias("across"))


def separation_hinge(separation: DataFrame, margin: float = 1.0) -> DataFrame:
    """relu(within - across + margin) per node: how far a split falls short of its margin."""
    within = (F.col("within_left") + F.col("within_right")) / 2.0
    return separation.withColumn("hinge", F.greatest(within - F.col("across") + F.lit(margin), F.lit(0.0)))


def nested_separation(df: DataFrame, node: str, quarter: str, array: str, id_: str, margin: float = 1.0, **options) -> DataFrame:
    """(node, child, inner, outer, shortfall): each child's own split against its outer side's distance to the other child.

    ``quarter`` holds LL, LR, RL or RR (side, then the child's side). For the left child ``inner`` is the mean distance LL-LR and
    ``outer`` that of LL to all of R; for the right child RL-RR and RR to all of L. ``shortfall`` is relu(inner - outer + margin).
    """
    used = [("LL", "LR"), ("LL", "RL"), ("LL", "RR"), ("RL", "RR"), ("LR", "RR")]
    d = group_distances(df.filter(F.col(quarter).isin("LL", "LR", "RL", "RR")), node, quarter, id_, array, wanted=used, **options)
    pick = lambda a, b, c: F.sum(F.when((F.col("a") == a) & (F.col("b") == b), F.col(c)))
    mean = lambda pairs: sum((pick(a, b, "pairs") * pick(a, b, "distance") for a, b in pairs[1:]), pick(*pairs[0], "pairs") * pick(*pairs[0], "distance")) / (
        sum((pick(a, b, "pairs") for a, b in pairs[1:]), pick(*pairs[0], "pairs")))
    sides = d.groupBy(node).agg(
        mean([("LL", "LR")]).alias("il"), mean([("LL", "RL"), ("LL", "RR")]).alias("ol"),
        mean([("RL", "RR")]).alias("ir"), mean([("LL", "RR"), ("LR", "RR")]).alias("orr"))
    each = F.explode(F.array(
        F.struct(F.lit("L").alias("child"), F.col("il").alias("inner"), F.col("ol").alias("outer")),
        F.struct(F.lit("R").alias("child"), F.col("ir").alias("inner"), F.col("orr").alias("outer")))).alias("e")
    return sides.select(node, each).select(node, "e.*").withColumn(
        "shortfall", F.greatest(F.col("inner") - F.col("outer") + F.lit(margin), F.lit(0.0)))


def batch_alignment(df: DataFrame, node: str, side: str, batch: str, array: str) -> DataFrame:
    """Mean Euclidean distance between batch centroids per node side, over all pairs of batches.

    Centroids are one small row for each node, side, batch and dimension, so their pairs are few beside the cells.
    """
    dims = df.select(node, side, batch, F.posexplode(array).alias("dim", "v"))
    centroids = dims.groupBy(node, side, batch, "dim").agg(F.avg("v").alias("c"))
    other = centroids.select(node, side, F.col(batch).alias("_other"), "dim", F.col("c").alias("_c"))
    pairs = centroids.join(other, [node, side, "dim"]).filter(F.col(batch) < F.col("_other")).groupBy(
        node, side, batch, "_other").agg(F.sqrt(F.sum((F.col("c") - F.col("_c")) * (F.col("c") - F.col("_c")))).alias("d"))
    # b batches make b (b - 1) / 2 pairs
    n = F.round((1.0 + F.sqrt(1.0 + 8.0 * F.count(F.lit(1)))) / 2.0).cast("bigint")
    return pairs.groupBy(node, side).agg(n.alias("n_batches"), F.avg("d").alias("centroid_gap"))


def benchmark_averages(records: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """Average minutes and components per dataset and method."""
    kept = records.filter(~F.col("method").isin(list(exclude))) if exclude else records
    return kept.groupBy("db", "method").agg(
        (F.avg("time") / 60.0).alias("minutes"), F.avg("n_component").alias("n_component"))


def label_slice(table: DataFrame, truth: str) -> DataFrame:
    """One truth class of a contingency table with shares; table-sized."""
    w = Window.partitionBy("truth")
    return table.filter(F.col("truth") == truth).withColumn("share", F.col("n") / F.sum("n").over(w))
