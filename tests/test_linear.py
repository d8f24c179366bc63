"""Gram-based maps against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from markertree.functions.stats import hashed_normal
from markertree.operators import em as EM
from markertree.operators import linear as L
from markertree.operators import metagenes as MG
from markertree.operators.normalize import wide_markers
from markertree.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def data(spark):
    d = 9
    shared = [hashed_normal(50 + j, "id") for j in range(2)]
    cols = [hashed_normal(j, "id") + shared[j % 2] * 1.5 + 1e4 for j in range(d)]
    df = spark.range(0, 1500, 1, 5).select("id", (F.col("id") % 3).alias("g"), F.array(*cols).alias("x")).persist()
    x = np.array([r["x"] for r in df.orderBy("id").collect()])
    return df, x


def test_gram_is_stable_and_grouped(data):
    df, x = data
    assert np.allclose(L.gram(df, 9)[()].cov(), np.cov(x.T), rtol=1e-9, atol=1e-9)
    groups = L.gram(df, 9, ["g"])
    assert sum(g.n for g in groups.values()) == len(x)
    assert np.allclose(groups[(1,)].cov(), np.cov(x[1::3].T), atol=1e-9)


def test_pca_scores_have_the_eigenvalues_as_variances(data):
    df, x = data
    m = L.pca(df, 3, 9)
    z = np.array([r["scores"] for r in L.apply_map(df, m.matrix, m.offset).orderBy("id").collect()])
    assert np.allclose(z.var(axis=0, ddof=1), np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:3])
    assert all(col[np.abs(col).argmax()] > 0 for col in m.matrix.T)


def test_cca_variates(data):
    df, x = data
    g = L.gram(df, 9)[()]
    m = L.cca_from(g, [4, 5], 2, reg=1e-9)
    a, b = (x[:, :4] - x[:, :4].mean(0)) @ m.maps[0].matrix, (x[:, 4:] - x[:, 4:].mean(0)) @ m.maps[1].matrix
    r = [np.corrcoef(a[:, i], b[:, i])[0, 1] for i in range(2)]
    assert np.allclose(np.square(r), m.values, atol=1e-4) and m.values[0] >= m.values[1]
    assert np.allclose(a.var(axis=0, ddof=1), 1.0, atol=1e-3)
    assert [round(v[3], 6) for v in L.view_correlations(g, [4, 5], m)] == [round(v, 6) for v in r]


def test_gcca_with_two_views_agrees_with_cca(data):
    df, _ = data
    g = L.gram(df, 9)[()]
    one, two = L.cca_from(g, [4, 5], 1, 0.1), L.gcca_from(g, [4, 5], 1, 0.1)
    assert np.allclose(np.abs(one.maps[0].matrix), np.abs(two.maps[0].matrix), atol=1e-6)
    assert two.values[0] == pytest.approx(np.sqrt(one.values[0]) / 2, abs=1e-6)


def test_hierarchical_equals_stacked_computation(data):
    df, x = data
    g = L.gram(df, 9)[()]
    m = L.hierarchical_from(g, [3, 3, 3], 1, 0.1)
    c = x - x.mean(axis=0)
    first = L.cca_from(L.Gram(len(x), np.zeros(6), c[:, :6].T @ c[:, :6]), [3, 3], 1, 0.1)
    z = np.vstack([c[:, :3] @ first.maps[0].matrix, c[:, 3:6] @ first.maps[1].matrix])
    stacked = np.hstack([z, np.vstack([c[:, 6:], c[:, 6:]])])
    s = L._block_gram(stacked)
    assert m.values[0] == pytest.approx(L.cca_from(s, [1, 3], 1, 0.1).values[0], abs=1e-9)


def test_missing_views_alternation_improves(data):
    df, _ = data
    rows = df.select(F.transform(F.slice("x", 1, 3), lambda v: v - 1e4).alias("a"),
                     F.when(F.col("id") % 4 != 0, F.transform(F.slice("x", 4, 3), lambda v: v - 1e4)).alias("b"),
                     F.transform(F.slice("x", 7, 3), lambda v: v - 1e4).alias("c"))
    m = L.align_views(rows, ["a", "b", "c"], [3, 3, 3], 2)
    assert m.objective[-1] > m.objective[0] and 0.3 < m.mean_correlation <= 1.0
    full = L.align_views(rows.withColumn("b", F.col("a")), ["a", "b", "c"], [3, 3, 3], 2)
    assert all(b >= a - 1e-9 for a, b in zip(full.objective, full.objective[1:]))
    assert full.pair_correlations[0][2] == pytest.approx(2.0, abs=1e-6)


def test_discriminant_direction(spark):
    df = spark.range(2000).select((F.col("id") % 2).alias("y"), F.array(
        hashed_normal(1, "id") + (F.col("id") % 2) * 2, hashed_normal(2, "id") * 3).alias("x"))
    m = L.discriminant(df, "y", 2)
    assert abs(m.matrix[0, 0]) > 0.95 and m.values[0] > 1.5


def test_sparse_rows_keep_empty_cells(spark):
    long = spark.createDataFrame([("1", "f", 2.0), ("1", "g", 3.0), ("2", "g", 1.0)], "cell_id string, feature string, value double")
    cells = spark.createDataFrame([("1",), ("2",), ("3",)], "cell_id string")
    g = L.gram(L.pack_rows(long, cells, ["f", "g"]), 2, array=None, idx="idx", val="val")[()]
    assert g.n == 3 and np.allclose(g.mean, [2 / 3, 4 / 3])


def test_full_table_em_finds_planted_components(spark):
    df = spark.range(0, 4000, 1, 4).select(
        (F.when(F.col("id") % 4 == 0, -4.0).otherwise(4.0) + hashed_normal(1, "id")).alias("p"),
        (F.when(F.col("id") % 4 == 0, 2.0).otherwise(-2.0) + hashed_normal(2, "id")).alias("q"))
    trace = []
    fits = EM.fit_models(df, ["p", "q"], [1, 2, 3], max_iter=40, trace=trace)
    best = min(fits, key=lambda m: m.bic())
    assert best.k == 2 and np.allclose(np.sort(best.means[:, 0]), [-4, 4], atol=0.15)
    for k in (1, 2, 3):
        ll = [v for kk, v in trace if kk == k]
        assert all(b >= a - 1e-6 for a, b in zip(ll, ll[1:]))


def test_full_table_em_starts_from_all_rows(spark):
    """A third of all rows share one value: it gets a component of its own, whatever its hash."""
    for hot in (-4.0, 3.25, 11.0):
        df = spark.range(0, 6000, 1, 4).select(F.when(F.col("id") % 3 == 0, hot).otherwise(hashed_normal(5, "id") + hot + 6).alias("p"))
        n, means, _ = EM._start_cells(df, ["p"])
        assert n.sum() == 6000 and n[np.abs(means[:, 0] - hot).argmin()] >= 2000
        two = EM.fit_models(df, ["p"], [2], max_iter=40)[0]
        assert np.allclose(np.sort(two.means[:, 0]), [hot, hot + 6], atol=0.15)


def test_dirichlet_mixture_separates_count_profiles(spark):
    kind = F.col("id") % 3 == 0
    count = lambda j, a, b: F.round(F.when(kind, a).otherwise(b) + hashed_normal(j, "id") * 1.5).cast("double")
    df = spark.range(900).select("id", kind.alias("kind"), F.array(*[F.greatest(count(j, a, b), F.lit(0.0)) for j, (a, b) in enumerate([(20., 5.), (5., 20.), (8., 8.)])]).alias("x"))
    model = MG.fit_dirichlet(df, 3, 2, max_iter=40)
    assert all(b >= a - 1e-6 for a, b in zip(model.history, model.history[1:]))
    out = MG.dirichlet_labels(df, model)
    share = out.groupBy("label").agg(F.avg(F.col("kind").cast("double")).alias("s")).collect()
    assert {round(r["s"]) for r in share} == {0, 1} and all(abs(r["s"] - round(r["s"])) < 0.02 for r in share)


def test_wide_markers_take_one_shuffle(spark):
    long = spark.createDataFrame([("a", "1", "p", 1.0), ("a", "1", "q", 2.0), ("a", "2", "q", 3.0), ("b", "1", "p", None), ("b", "1", "z", 4.0)],
                                 "batch string, cell_id string, feature string, value double")
    wide = wide_markers(long, ["p", "q"])
    assert wide._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in wide.collect()} == {("a", "1", 1.0, 2.0), ("a", "2", None, 3.0), ("b", "1", None, None)}


def test_full_table_mixtures_shuffles_lines_once(spark, sf, monkeypatch):
    """Every pass reads stored markers; no pass builds the wide table again."""
    seen = []
    fit = EM.fit_models
    monkeypatch.setattr(EM, "fit_models", lambda df, *a, **k: seen.append(df) or fit(df, *a, **k))
    assert QUERIES["full_table_mixtures"](spark, sf).count() == 8
    assert len(seen) == 2 and all("Exchange" not in df._jdf.queryExecution().executedPlan().toString() for df in seen)
