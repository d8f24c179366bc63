"""Centroid clustering in whole numbers with SQL expressions only.

A round is one job: zip_with and aggregate give the squared distance of a row to every literal centroid array, array_min of
(distance, number) structs picks the cluster, and one sum per component, combined map-side, moves the centroids. What is
shuffled and collected is one row of sums a cluster, whatever the table or the largest cluster holds; rows are never grouped,
copied or stored between rounds, so a lost executor costs a rescan of its splits.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markertree.session import materialize

LIMIT = 1 << 59
"""Scaled components are held within +-LIMIT, so that 64 squared differences stay below 10^38 (decimal arithmetic)."""
LONG_MAX = (1 << 63) - 1


def quantized(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """(vec_id, x) with x = floor(scale * component), held within +-LIMIT, of the vectors with exactly ``dim`` components,
    none of them null or non-finite. Other rows and columns are left out; null and repeated ids stay."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    # the double test first: floor saturates beyond 2^63
    held = F.transform(x, lambda c: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), c * F.lit(float(scale))))))
    return vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dim) & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), held.alias("x"))


def starts(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors of smallest lowercase-hex sha256 of ``seed:vec_id``, in that order; equal ids by components, null ids
    last. A bounded top-k, not a sort of the table."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["x"]) for r in rows.select("x", digest.alias("_d")).orderBy(F.asc_nulls_last("_d"), "x").limit(k).collect()]


def nearest(centroids: list[list[int]], x: str, kind: str) -> Column:
    """struct(distance, cluster) of the nearest literal centroid to array ``x``, ties to the smaller number. ``kind`` is the
    type distances are summed in. Written as one SQL expression, because thousands of Column calls take seconds a round."""
    part = "bigint" if kind == "bigint" else "decimal(19,0)"
    each = ", ".join(
        f"struct(aggregate(zip_with({x}, array({', '.join(f'{v}L' for v in c)}),"
        f" (a, b) -> (cast(a as {part}) - cast(b as {part})) * (cast(a as {part}) - cast(b as {part}))),"
        f" cast(0 as {kind}), (total, square) -> cast(total + square as {kind})) as distance, {n} as cluster)"
        for n, c in enumerate(centroids))
    return F.expr(f"array_min(array({each}))")


def _moved(rows: DataFrame, centroids: list[list[int]], kind: str, sums: str) -> list[list[int]]:
    """Componentwise floor of the mean of every non-empty cluster; empty clusters keep their centroid."""
    dim = len(centroids[0])
    assigned = rows.select("x", nearest(centroids, "x", kind)["cluster"].alias("cluster"))
    columns = assigned.select("cluster", *[F.col("x")[i].cast(sums).alias(f"x{i}") for i in range(dim)])
    totals = columns.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"x{i}") for i in range(dim)])
    moved = list(centroids)
    for r in totals.collect():  # at most one row a centroid
        moved[r["cluster"]] = [int(r[f"x{i}"]) // r["n"] for i in range(dim)]
    return moved


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row for each row of ``vectors`` whose
    vector has ``dim`` finite components; null vectors, other lengths and null or non-finite components take no part.

    Rows that repeat an id or a vector each count. Fewer vectors than ``k`` give as many centroids as vectors, equal starts
    leave the later one empty, an empty table gives no rows. All sums are exact: in longs where the largest component and the
    row count prove that they fit, in decimals beyond; a distance or inertia above 2^63 - 1 reads as that number.
    """
    rows = quantized(vectors, dim, scale)
    seen = rows.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("x", lambda c: F.abs(c)))).alias("top")).first()
    if not seen["n"]:
        return rows.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in (
            "distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256")).limit(0)
    kind = "bigint" if dim * (2 * seen["top"] + 2) ** 2 <= LONG_MAX else "decimal(38,0)"
    sums = "long" if seen["n"] * (seen["top"] + 1) <= LONG_MAX else "decimal(19,0)"
    centroids = starts(rows, k, seed)
    for _ in range(rounds):
        centroids = _moved(rows, centroids, kind, sums)

    best = nearest(centroids, "x", kind)
    assigned = materialize(rows.select("vec_id", best.alias("_b")).select(
        "vec_id", F.col("_b.cluster").alias("cluster"), F.least(F.col("_b.distance"), F.lit(LONG_MAX)).cast("long").alias("distance")))
    totals = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(19,0)")).alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    own = F.lit([min(totals.get(n, 0), LONG_MAX) for n in range(len(centroids))]).cast("array<long>")
    return assigned.select(
        "vec_id", "cluster", "distance", own[F.col("cluster")].alias("cluster_inertia"),
        F.lit(min(sum(totals.values()), LONG_MAX)).cast("long").alias("inertia"), F.lit(digests)[F.col("cluster")].alias("centroid_sha256"))


def cluster_sql(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2) -> str:
    """The same clustering as one SQL query over ``embeddings``, in rows of (row, component)."""
    steps = [f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = {dim} AND NOT list_bool_or(list_transform(embedding, lambda c: c IS NULL OR NOT isfinite(c)))),
parts AS MATERIALIZED (SELECT r, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM kept),
first AS (
  SELECT x, row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, x) - 1 AS c FROM kept
  QUALIFY c < {k}),
m0 AS MATERIALIZED (SELECT c, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM first)"""]
    for n in range(rounds + 1):
        steps.append(f"""
d{n} AS (SELECT r, c, sum((p.v - m.v) * (p.v - m.v)) AS d FROM parts p JOIN m{n} m USING (i) GROUP BY r, c),
a{n} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{n} GROUP BY r)""")
        if n < rounds:
            steps.append(f"""
u{n} AS (SELECT c, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM parts JOIN a{n} USING (r) GROUP BY c, i),
m{n + 1} AS MATERIALIZED (
  SELECT c, i, CASE WHEN u.n IS NULL THEN m.v ELSE (s - ((s % n) + n) % n) // n END AS v FROM m{n} m LEFT JOIN u{n} u USING (c, i))""")
    return ",".join(steps) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       g.digest AS centroid_sha256
FROM kept JOIN a{rounds} a USING (r)
JOIN (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS digest FROM m{rounds} GROUP BY c) g ON g.c = a.c"""
