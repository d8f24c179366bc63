"""Token tables: texts move to their cell once, entries don't move again."""

from pyspark.sql import functions as F

from markertree.operators.normalize import depth_normalize, log_transform
from markertree.operators.qc import features_in_cells
from markertree.sources.tables import document_expression, document_markers, token_counts


def _documents(spark, folder):
    rows = [(1, "s", "a B b, c"), (1, "s", "A a"), (1, "t", "c"), (2, "s", None), (3, None, "x  y"), (4, "s", "12 !")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{folder}/documents.parquet")
    return token_counts(spark, str(folder))


def test_counts_of_repeated_ids_and_nulls(spark, tmp_path):
    found = {tuple(r) for r in _documents(spark, tmp_path).collect()}
    assert found == {("s", "1", "a", 3.0), ("s", "1", "b", 2.0), ("s", "1", "c", 1.0), ("t", "1", "c", 1.0), (None, "3", "x", 1.0), (None, "3", "y", 1.0)}


def test_entries_are_counted_and_summed_by_cell_without_a_shuffle_of_entries(spark, tmp_path):
    tokens = _documents(spark, tmp_path)
    for df in (tokens, depth_normalize(tokens), tokens.groupBy("cell_id").agg(F.sum("value"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")


def test_expression_reads_stored_counts_instead_of_cutting_texts_again(spark, tmp_path):
    rows = [(i, "s" if i % 2 else "t", f"common w{i % 2} w{i % 2}" if i else None) for i in range(25)] + [(1, "t", "common")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = document_expression(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange hash" not in plan
    again = log_transform(depth_normalize(features_in_cells(token_counts(spark, str(tmp_path)), 10)))
    assert sorted(found.select("cell_id", "feature", "value").collect()) == sorted(again.select("cell_id", "feature", "value").collect())
    assert found.filter("feature = 'common'").count() == 25


def test_shares_of_letters(spark, tmp_path):
    rows = [(1, "en", "Eel é"), (2, "en", ""), (3, None, None), (4, "fr", "ÉÈ ono")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    marks = document_markers(spark, str(tmp_path))
    plan = marks._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count(" replace(") + plan.count("(replace(") >= 4  # a letter is counted without a regular expression
    found = {r["cell_id"]: r for r in marks.collect()}
    assert (found["1"]["share_e"], found["1"]["share_accent"], found["2"]["share_e"]) == (2 / 5, 1 / 5, 0.0)
    assert found["3"]["share_e"] is None and (found["4"]["share_o"], found["4"]["share_accent"]) == (2 / 6, 2 / 6)


def test_entries_stay_in_place_for_tables_of_cells_and_features(spark, monkeypatch):
    """Above the session's threshold too, a table measured to be small is sent to the entries; a larger one is joined with the same result."""
    from markertree import session
    from markertree.operators.features import welch_scores
    from markertree.operators.linear import pls_weights_sparse
    from markertree.operators.normalize import scale_to_depth
    from markertree.operators.qc import features_in_cells

    long = session.materialize(spark.range(400).select(
        F.lit("b").alias("batch"), (F.col("id") % 40).cast("string").alias("cell_id"), F.concat(F.lit("f"), F.col("id") % 13).alias("feature"),
        (F.col("id") % 5).cast("double").alias("value")).dropDuplicates(["cell_id", "feature"]))
    cells = long.select("batch", "cell_id").distinct().select("*", F.col("cell_id").cast("double").alias("y"), (F.col("cell_id") % 2).alias("group"))
    found = lambda: [scale_to_depth(long), features_in_cells(long, 2), pls_weights_sparse(long, cells.select("batch", "cell_id", "y"), ["batch"]),
                     welch_scores(long, cells.select("batch", "cell_id", "group"), by=["batch"])]
    rows = lambda dfs: [sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()) for df in dfs]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        sent = found()
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in sent]
        assert all("BroadcastHashJoin" in p for p in plans[:3]) and not any("SortMergeJoin" in p for p in plans[:2])
        monkeypatch.setattr(session, "LOOKUP_ROWS", 0)
        joined = found()
        assert "SortMergeJoin" in joined[0]._jdf.queryExecution().executedPlan().toString()
        assert rows(sent) == rows(joined) and all(rows(sent))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
