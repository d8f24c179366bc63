"""Linear maps: PCA, discriminants, PLS and canonical correlation, all from one Gram pass.

Spark partitions hold (count, mean, centred scatter) per group and merge them pairwise, which is
stable for large offsets. Only d x d matrices reach the driver, where they are factorised; scores are computed
back on the cluster. The width d is bounded by feature selection (``MAX_WIDTH``), never by the data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markertree.session import bounded_rows, lookup

MAX_WIDTH = 4096
BLOCK = 1024
BLOCK_NUMBERS = 65_536   # numbers per partial row: a few matrix rows travel together


@dataclass
class Gram:
    n: int
    mean: np.ndarray
    scatter: np.ndarray

    def cov(self, ddof: int = 1) -> np.ndarray:
        return self.scatter / max(self.n - ddof, 1)

    def raw(self) -> np.ndarray:
        """Uncentred second-moment sum."""
        return self.scatter + self.n * np.outer(self.mean, self.mean)

    def merge(self, o: "Gram") -> "Gram":
        n = self.n + o.n
        gap = o.mean - self.mean
        return Gram(n, self.mean + gap * (o.n / n), self.scatter + o.scatter + np.outer(gap, gap) * (self.n * o.n / n))


def _block_gram(x: np.ndarray) -> Gram:
    mean = x.mean(axis=0)
    diff = x - mean
    return Gram(len(x), mean, diff.T @ diff)


def dense_block(pdf: pd.DataFrame, width: int, array: str | None, idx: str | None, val: str | None) -> np.ndarray:
    if array is not None:
        return np.vstack(pdf[array].to_numpy()).astype(float)
    x = np.zeros((len(pdf), width))
    for i, (at, values) in enumerate(zip(pdf[idx], pdf[val])):
        if at is not None and len(at):
            x[i, np.asarray(at, dtype=int)] = values
    return x


def gram(df: DataFrame, width: int, by: list[str] = (), array: str | None = "x", idx: str | None = None,
         val: str | None = None) -> dict[tuple, Gram]:
    """Gram of an array column (or of sparse index/value columns) per group.

    The number of partial results is bounded by the cluster's size, not by the number of input splits, and
    partial blocks are merged in two steps on large clusters, so no task receives more than a few thousand blocks.
    """
    if width > MAX_WIDTH:
        raise ValueError(f"select at most {MAX_WIDTH} features first")
    by = list(by)
    columns = [array] if array is not None else [idx, val]
    slots = 4 * df.sparkSession.sparkContext.defaultParallelism
    source = df.select(*by, *columns).coalesce(slots)
    schema = T.StructType([source.schema[c] for c in by] + [
        T.StructField("_slot", T.IntegerType()), T.StructField("_i", T.IntegerType()), T.StructField("_n", T.LongType()),
        T.StructField("_mean", T.ArrayType(T.DoubleType())), T.StructField("_row", T.ArrayType(T.DoubleType()))])
    names = schema.fieldNames()

    step = max(1, BLOCK_NUMBERS // width)
    starts = list(range(0, width, step))

    def rows_of(key: tuple, slot: int, g: Gram):
        return [[*key, slot, i, g.n, g.mean, g.scatter[i:i + step].ravel()] for i in starts]

    def partials(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        slot = (context.partitionId() if context else 0) % 64
        held: dict[tuple, Gram] = {}
        for pdf in batches:
            groups = pdf.groupby(by, sort=False, dropna=False) if by else [((), pdf)]
            for key, part in groups:
                key = key if isinstance(key, tuple) else (key,)
                for start in range(0, len(part), BLOCK):
                    g = _block_gram(dense_block(part.iloc[start:start + BLOCK], width, array, idx, val))
                    held[key] = held[key].merge(g) if key in held else g
        for key, g in held.items():
            yield pd.DataFrame(rows_of(key, slot, g), columns=names)

    def merged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i = int(pdf["_i"].iloc[0])
        n, mean, rows = 0, None, None
        for m, mu, r in zip(pdf["_n"], pdf["_mean"], pdf["_row"]):
            mu = np.asarray(mu)
            r = np.asarray(r).reshape(-1, width)
            if mean is None:
                n, mean, rows = int(m), mu, r
                continue
            gap = mu - mean
            rows = rows + r + np.outer(gap[i:i + len(r)], gap) * (n * m / (n + m))
            mean = mean + gap * (m / (n + m))
            n += int(m)
        first = pdf.iloc[0]
        return pd.DataFrame([[*[first[c] for c in by], int(first["_slot"]), i, n, mean, rows.ravel()]], columns=names)

    part = source.mapInPandas(partials, schema)
    if slots > 64:
        part = part.groupBy(*by, "_slot", "_i").applyInPandas(merged, schema)
    whole = part.groupBy(*by, "_i").applyInPandas(merged, schema)
    out: dict[tuple, Gram] = {}
    for r in bounded_rows(whole):
        key = tuple(r[c] for c in by)
        if key not in out:
            out[key] = Gram(r["_n"], np.asarray(r["_mean"]), np.zeros((width, width)))
        rows = np.asarray(r["_row"]).reshape(-1, width)
        out[key].scatter[r["_i"]:r["_i"] + len(rows)] = rows
    for g in out.values():
        g.scatter = (g.scatter + g.scatter.T) / 2
    return out


# ------------------------------------------------------------------ sparse tables to rows

def feature_index(df: DataFrame, limit: int = MAX_WIDTH) -> list[str]:
    """Sorted selected features; a bounded selection, so its order is fixed on the driver."""
    return sorted(r[0] for r in bounded_rows(df.select("feature").distinct(), limit))


def pack_rows(long: DataFrame, cells: DataFrame, features: list[str], cell: list[str] = ("cell_id",)) -> DataFrame:
    """One row per cell with sparse ``idx``/``val`` over the selected features; cells without any keep empty arrays."""
    spark = long.sparkSession
    lookup = spark.createDataFrame([(f, i) for i, f in enumerate(features)], "feature string, idx int")
    picked = long.join(F.broadcast(lookup), "feature").groupBy(*cell).agg(F.collect_list(F.struct("idx", "value")).alias("_e"))
    return cells.join(picked, list(cell), "left").select(
        *cells.columns,
        F.coalesce(F.col("_e.idx"), F.array().cast("array<int>")).alias("idx"),
        F.coalesce(F.col("_e.value"), F.array().cast("array<double>")).alias("val"))


def dense_array(idx: str, val: str, width: int) -> Column:
    """Dense array from sparse columns, JVM-side."""
    pairs = F.map_from_arrays(F.col(idx), F.col(val))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(pairs[i], F.lit(0.0)))


def sparse_dot(idx: str, val: str, weights: list[float]) -> Column:
    """Dot product of a sparse row with a weight vector over the packed features."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    return F.aggregate(F.arrays_zip(F.col(idx).alias("i"), F.col(val).alias("v")), F.lit(0.0),
                       lambda s, e: s + e["v"] * F.element_at(w, e["i"] + 1))


def apply_map(df: DataFrame, matrix: np.ndarray, offset: np.ndarray, array: str | None = "x", idx: str | None = None,
              val: str | None = None, out: str = "scores") -> DataFrame:
    """scores = (x - offset) @ matrix for an array (or sparse) column, in Arrow batches."""
    columns = [array] if array is not None else [idx, val]
    width = matrix.shape[0]
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.DoubleType()))])
    shift = offset @ matrix

    def run(batches):
        for pdf in batches:
            scores = np.empty((len(pdf), matrix.shape[1]))
            for start in range(0, len(pdf), BLOCK):
                block = dense_block(pdf[columns].iloc[start:start + BLOCK], width, array, idx, val)
                scores[start:start + BLOCK] = block @ matrix - shift
            pdf[out] = list(scores)
            yield pdf

    return df.mapInPandas(run, schema)


def fix_signs(columns: np.ndarray) -> np.ndarray:
    """Make the entry of largest size positive in each column."""
    columns = np.array(columns, dtype=float)
    for j in range(columns.shape[1]):
        if columns[np.abs(columns[:, j]).argmax(), j] < 0:
            columns[:, j] *= -1
    return columns


# ------------------------------------------------------------------ PCA, discriminant, PLS

@dataclass
class LinearMap:
    matrix: np.ndarray        # d x k, applied to (x - offset)
    offset: np.ndarray
    values: np.ndarray        # variances, eigenvalues or correlations per column


def pca_from(g: Gram, k: int, scale: bool = False) -> LinearMap:
    cov = g.cov()
    sd = np.sqrt(np.diag(cov)) if scale else np.ones(len(cov))
    sd = np.where(sd > 0, sd, 1.0)
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    order = np.argsort(values)[::-1][:k]
    loadings = fix_signs(vectors[:, order])
    return LinearMap(loadings / sd[:, None], g.mean, values[order])


def pca(df: DataFrame, k: int, width: int, scale: bool = False, **columns) -> LinearMap:
    return pca_from(gram(df, width, **columns)[()], k, scale)


def loadings_table(spark, model: LinearMap, features: list[str] | None = None, prefix: str = "PC") -> DataFrame:
    names = features or [str(i) for i in range(len(model.matrix))]
    rows = [(names[i], f"{prefix}{j}", float(model.matrix[i, j])) for i in range(model.matrix.shape[0]) for j in range(model.matrix.shape[1])]
    return spark.createDataFrame(rows, "feature string, component string, w double")


def discriminant_from(groups: dict[str, Gram], ridge: float = 1e-9) -> LinearMap:
    """Two-class direction: within-class scatter inverse times the mean gap, unit length."""
    (a, left), (b, right) = sorted(groups.items(), key=lambda kv: str(kv[0]))
    within = (left.scatter + right.scatter) / max(left.n + right.n - 2, 1)
    within = within + ridge * max(np.trace(within) / len(within), 1e-12) * np.eye(len(within))
    w = np.linalg.solve(within, right.mean - left.mean)
    w = w / np.linalg.norm(w)
    offset = (left.n * left.mean + right.n * right.mean) / (left.n + right.n)
    gap = float(w @ (right.mean - left.mean))
    return LinearMap(w[:, None], offset, np.array([gap]))


def discriminant(df: DataFrame, label: str, width: int, **columns) -> LinearMap:
    groups = gram(df, width, [label], **columns)
    if len(groups) != 2:
        raise ValueError("exactly two classes")
    return discriminant_from(groups)


def pls_weights(df: DataFrame, features: list[str], y: str, by: list[str] = ()) -> DataFrame:
    """One-component PLS weights: correlations with y, scaled to unit length, per group."""
    aggs = [F.corr(f, y).alias(f"_c{i}") for i, f in enumerate(features)]
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f"_c{i}"), F.lit(0.0)).alias("c")) for i, f in enumerate(features)]))
    per = df.groupBy(*by).agg(*aggs).select(*by, rows.alias("_r")).select(*by, "_r.*")
    return _unit(per, list(by))


def pls_weights_sparse(long: DataFrame, target: DataFrame, by: list[str] = (), cell: list[str] = ("cell_id",)) -> DataFrame:
    """The same on a sparse long table: ``target`` has one row per cell with ``y``; zeros are implied."""
    by = list(by)
    sizes = target.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("my"), F.stddev_pop("y").alias("sy"))
    v = F.col("value")
    sums = long.join(lookup(target), list(dict.fromkeys([*by, *cell]))).groupBy(*by, "feature").agg(
        F.sum(v).alias("s"), F.sum(v * v).alias("ss"), F.sum(v * F.col("y")).alias("sy_x"))
    from markertree.session import attach_row

    joined = sums.join(sizes, by) if by else attach_row(sums, sizes)
    mean = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0)))
    c = (F.col("sy_x") / F.col("n") - mean * F.col("my")) / (sd * F.col("sy"))
    return _unit(joined.select(*by, "feature", F.when((sd > 0) & (F.col("sy") > 0), c).otherwise(F.lit(0.0)).alias("c")), by)


def _unit(per: DataFrame, by: list[str]) -> DataFrame:
    from markertree.session import attach_row

    norms = per.groupBy(*by).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("_norm"))
    joined = per.join(norms, by) if by else attach_row(per, norms)
    return joined.select(*by, "feature", F.when(F.col("_norm") > 0, F.col("c") / F.col("_norm")).otherwise(F.lit(0.0)).alias("w"))


# ------------------------------------------------------------------ canonical correlation

def generalized_eig(left: np.ndarray, right: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest k solutions of left u = v right u for symmetric matrices, by whitening ``right``."""
    values, vectors = np.linalg.eigh(right)
    keep = values > values.max() * 1e-12
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    inner, basis = np.linalg.eigh(whiten.T @ left @ whiten)
    order = np.argsort(inner)[::-1][:min(k, keep.sum())]
    return inner[order], whiten @ basis[:, order]


def unit_variance(h: np.ndarray, cov: np.ndarray) -> np.ndarray:
    var = np.einsum("ij,ik,kj->j", h, cov, h)
    return h / np.sqrt(np.where(var > 0, var, 1.0))


def ridged(cov: np.ndarray, reg: float) -> np.ndarray:
    return cov + reg * np.mean(np.diag(cov)) * np.eye(len(cov))


@dataclass
class ViewMaps:
    maps: list[LinearMap]     # one per view
    values: np.ndarray


def _slices(widths: list[int]) -> list[slice]:
    ends = np.cumsum([0, *widths])
    return [slice(int(a), int(b)) for a, b in zip(ends[:-1], ends[1:])]


def _two_view(c00, c01, c11, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    left = c01 @ np.linalg.solve(c11, c01.T)
    values, u = generalized_eig((left + left.T) / 2, c00, min(k, c11.shape[0]))
    u = fix_signs(unit_variance(u, c00))
    v = unit_variance(np.linalg.solve(c11, c01.T) @ u, c11)
    return values, u, v


def cca_from(g: Gram, widths: list[int], k: int, reg: float = 0.1) -> ViewMaps:
    """Regularised two-view CCA; ``values`` are squared canonical correlations."""
    a, b = _slices(widths)
    cov = g.cov()
    c00, c11 = ridged(cov[a, a], reg), ridged(cov[b, b], reg)
    values, u, v = _two_view(c00, cov[a, b], c11, k)
    return ViewMaps([LinearMap(u, g.mean[a], values), LinearMap(v, g.mean[b], values)], values)


def joint_projection_matrix(values: np.ndarray, beta: float = 0.5) -> np.ndarray:
    """2k x k matrix of the probabilistic joint projection: z = [z0, z1] @ M."""
    k = len(values)
    lam = np.diag(values)
    core = np.linalg.inv(np.eye(k) - np.diag(values ** 2))
    cross = -core @ lam
    mat = np.block([[core, cross], [cross, core]])
    p = np.vstack([np.diag(values ** beta), np.diag(values ** (1 - beta))])
    return mat.T @ p


def gcca_from(g: Gram, widths: list[int], k: int, reg: float = 0.1) -> ViewMaps:
    """Generalised CCA over several views: half the off-diagonal blocks against the ridged diagonal blocks."""
    parts = _slices(widths)
    cov = g.cov()
    return _solve_blocks(cov, parts, [ridged(cov[s, s], reg) for s in parts], g.mean, k)


def _solve_blocks(cov, parts, diagonals, mean, k) -> ViewMaps:
    left, right = 0.5 * np.array(cov), np.zeros_like(cov)
    for s, block in zip(parts, diagonals):
        left[s, s] = 0.0
        right[s, s] = block
    values, vectors = generalized_eig((left + left.T) / 2, right, k)
    vectors = fix_signs(vectors)
    maps = [LinearMap(unit_variance(vectors[s], block), mean[s], values) for s, block in zip(parts, diagonals)]
    return ViewMaps(maps, values)


def bridged_from(pair0: Gram, pair1: Gram, widths: list[int], k: int, reg: float = 0.1) -> ViewMaps:
    """Views 0 and 2 are never seen together; view 1 is seen with both, and pooled."""
    d0, d1, d2 = widths
    first, second = _slices([d0, d1]), _slices([d1, d2])
    c0, c1 = pair0.cov(), pair1.cov()
    shared = Gram(pair0.n, pair0.mean[first[1]], pair0.scatter[first[1], first[1]]).merge(
        Gram(pair1.n, pair1.mean[second[0]], pair1.scatter[second[0], second[0]]))
    parts = _slices(widths)
    cov = np.zeros((sum(widths), sum(widths)))
    cov[parts[0], parts[1]] = c0[first[0], first[1]]
    cov[parts[1], parts[0]] = c0[first[0], first[1]].T
    cov[parts[1], parts[2]] = c1[second[0], second[1]]
    cov[parts[2], parts[1]] = c1[second[0], second[1]].T
    blocks = [ridged(c0[first[0], first[0]], reg), ridged(shared.cov(), reg), ridged(c1[second[1], second[1]], reg)]
    mean = np.concatenate([pair0.mean[first[0]], shared.mean, pair1.mean[second[1]]])
    return _solve_blocks(cov, parts, blocks, mean, k)


def hierarchical_from(g: Gram, widths: list[int], k: int, reg: float = 0.1) -> ViewMaps:
    """CCA of views 0 and 1, then CCA of their stacked variates against view 2 taken twice.

    The second covariances follow from the same Gram, so no second pass is made.
    """
    s0, s1, s2 = _slices(widths)
    first = cca_from(Gram(g.n, np.concatenate([g.mean[s0], g.mean[s1]]),
                          np.block([[g.scatter[s0, s0], g.scatter[s0, s1]], [g.scatter[s1, s0], g.scatter[s1, s1]]])),
                     widths[:2], k, reg)
    u, v = first.maps[0].matrix, first.maps[1].matrix
    n2 = 2 * g.n - 1
    zz = (u.T @ g.scatter[s0, s0] @ u + v.T @ g.scatter[s1, s1] @ v) / n2
    zx = (u.T @ g.scatter[s0, s2] + v.T @ g.scatter[s1, s2]) / n2
    xx = 2 * g.scatter[s2, s2] / n2
    values, a, b = _two_view(ridged(zz, reg), zx, ridged(xx, reg), k)
    return ViewMaps([LinearMap(u @ a, g.mean[s0], values), LinearMap(v @ a, g.mean[s1], values), LinearMap(b, g.mean[s2], values)], values)


def view_correlations(g: Gram, widths: list[int], model: ViewMaps) -> list[tuple[int, int, int, float]]:
    """Correlation of each pair of views' variates per component, from the same Gram."""
    parts = _slices(widths)
    out = []
    for i in range(len(parts)):
        for j in range(i + 1, len(parts)):
            a, b = model.maps[i].matrix, model.maps[j].matrix
            cross = np.einsum("ij,ik,kj->j", a, g.scatter[parts[i], parts[j]], b)
            va = np.einsum("ij,ik,kj->j", a, g.scatter[parts[i], parts[i]], a)
            vb = np.einsum("ij,ik,kj->j", b, g.scatter[parts[j], parts[j]], b)
            out += [(i, j, c, float(cross[c] / np.sqrt(va[c] * vb[c]))) for c in range(len(cross))]
    return out


# ------------------------------------------------------------------ many views with missing rows

@dataclass
class MissingViewModel:
    maps: list[np.ndarray]
    objective: list[float]
    pair_correlations: list[tuple[int, int, float]]
    mean_correlation: float


def view_activity(triplets: DataFrame, view: str = "view", row: str = "row") -> DataFrame:
    """Per view and row: active when the row's sum is not zero, and how many other views are active there."""
    sums = triplets.groupBy(view, row).agg((F.sum("value") != 0).cast("int").alias("active"))
    total = sums.groupBy(row).agg(F.sum("active").alias("_all"))
    return sums.join(total, row).withColumn("n_other", F.col("_all") - F.col("active")).drop("_all")


def align_views(rows: DataFrame, arrays: list[str], widths: list[int], k: int, epochs: int = 20, seed: int = 0,
                mask: bool = True) -> MissingViewModel:
    """Generalised CCA for rows that may lack views (null or all-zero arrays), by alternating least squares.

    Each step of the alternation is linear in the views, so every quantity it needs is a sum of row-wise
    outer products weighted by the row's activity pattern. One Gram per pattern is therefore the only pass over
    the data; all epochs run on the small matrices. The n x k shared scores are never stored: they
    are the view times its map.
    """
    V = len(arrays)
    filled = [F.coalesce(F.col(a), F.array_repeat(F.lit(0.0), w)) for a, w in zip(arrays, widths)]
    active = [F.when(F.aggregate(f, F.lit(0.0), lambda s, v: s + v) != 0, "1").otherwise("0") if mask else F.lit("1") for f in filled]
    table = rows.select(F.concat(*active).alias("_pattern"), F.concat(*filled).alias("_x"))
    grams = {key[0]: g.raw() for key, g in gram(table, sum(widths), ["_pattern"], array="_x").items()}
    parts = _slices(widths)

    def weighted(i: int, j: int, weight) -> np.ndarray:
        total = np.zeros((widths[i], widths[j]))
        for pattern, raw in grams.items():
            others = sum(int(c) for v, c in enumerate(pattern) if v != i) / (V - 1)
            use = others > 0 and pattern[i] == "1"
            w = weight(pattern, others) if use else 0.0
            if w:
                total = total + w * raw[parts[i], parts[j]]
        return total

    normal = [weighted(i, i, lambda p, o: 1.0) for i in range(V)]
    cross = [[weighted(i, j, lambda p, o: 1.0 / o) if i != j else None for j in range(V)] for i in range(V)]
    solve = [np.linalg.pinv(a + 1e-8 * max(np.trace(a) / len(a), 1e-12) * np.eye(len(a))) for a in normal]
    rng = np.random.default_rng(seed)

    def whiten(i: int, m: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(m.T @ normal[i] @ m)
        good = values > max(values.max(), 0) * 1e-12
        root = (vectors[:, good] / np.sqrt(values[good])) @ vectors[:, good].T
        return m @ root

    q = [whiten(i, rng.standard_normal((widths[i], k))) for i in range(V)]
    history: list[float] = []
    for _ in range(epochs):
        for i in range(V):
            q[i] = whiten(i, solve[i] @ sum(cross[i][j] @ q[j] for j in range(V) if j != i))
        # each step is the best one for its view, so this never falls
        history.append(sum(float(np.trace(q[i].T @ cross[i][j] @ q[j])) for i in range(V) for j in range(V) if j != i))
    corrs = []
    for i in range(V):
        for j in range(i + 1, V):
            both = [raw for p, raw in grams.items() if p[i] == "1" and p[j] == "1"]
            if not both:
                corrs.append((i, j, float("-inf")))
                continue
            raw = sum(both)
            top = np.einsum("ij,ik,kj->j", q[i], raw[parts[i], parts[j]], q[j])
            ni = np.einsum("ij,ik,kj->j", q[i], raw[parts[i], parts[i]], q[i])
            nj = np.einsum("ij,ik,kj->j", q[j], raw[parts[j], parts[j]], q[j])
            corrs.append((i, j, float((top / np.sqrt(np.maximum(ni * nj, 1e-300))).sum())))
    valid = [c for _, _, c in corrs if np.isfinite(c)]
    return MissingViewModel(q, history, corrs, sum(valid) / (len(valid) * k) if valid else float("nan"))
