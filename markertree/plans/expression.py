"""Trees on expression: every node is embedded anew (PCA, or correlation with named gene sets), then split.

A node's embedding is a small matrix, so a row's node stays a function of the row: level by level the packed
expression is projected in Arrow batches with the embeddings of its open node.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markertree.operators import linear as L
from markertree.operators import knots as K
from markertree.operators.profiles import PROFILES, Profile
from markertree.operators.quantiles import exact_quantiles
from markertree.operators.scan import group_limits, pair_candidates, scan_markers, scan_pairs
from markertree.plans.tree import Tree, rule_from_record
from markertree.session import bounded_rows, discard, lookup, materialize


@dataclass
class Embedding:
    matrix: np.ndarray      # width x columns
    offset: np.ndarray
    names: list[str]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (x - self.offset) @ self.matrix


Embedder = Callable[[L.Gram], Embedding]


def pca_embedder(components: int = 5, scale: bool = True) -> Embedder:
    """Leading components of the node's own cells, features scaled to unit variance.

    Clipping of extreme scaled values would break the Gram algebra and is left out.
    """

    def embed(g: L.Gram) -> Embedding:
        model = L.pca_from(g, components, scale)
        return Embedding(model.matrix, model.offset, [f"PC{i}" for i in range(model.matrix.shape[1])])

    return embed


def gene_set_embedder(sets: list[list[int]], reg: float = 1e-3) -> Embedder:
    """For each named gene set one canonical pair: the set against all other genes (two columns per set)."""

    def embed(g: L.Gram) -> Embedding:
        width = len(g.mean)
        columns, names = [], []
        for i, members in enumerate(sets):
            inside = np.asarray(sorted(members), dtype=int)
            outside = np.setdiff1d(np.arange(width), inside)
            order = np.concatenate([inside, outside])
            part = L.Gram(g.n, g.mean[order], g.scatter[np.ix_(order, order)])
            model = L.cca_from(part, [len(inside), len(outside)], 1, reg)
            for side, (ids, m) in enumerate(((inside, model.maps[0]), (outside, model.maps[1]))):
                full = np.zeros(width)
                full[ids] = m.matrix[:, 0]
                columns.append(full)
                names.append(f"CC{i}_{side}")
        return Embedding(np.array(columns).T, g.mean, names)

    return embed


def _embed_rows(rows: DataFrame, width: int, embeddings: dict[str, Embedding], names: list[str]) -> DataFrame:
    keep = [f for f in rows.schema.fields if f.name not in ("idx", "val")]
    schema = T.StructType(keep + [T.StructField(n, T.DoubleType()) for n in names])
    kept = [f.name for f in keep]

    def run(batches):
        for pdf in batches:
            out = np.full((len(pdf), len(names)), np.nan)
            pdf = pdf.reset_index(drop=True)
            for path, part in pdf.groupby("path", sort=False):
                e = embeddings.get(path)
                if e is None:
                    continue
                ix = part.index.to_numpy()
                for start in range(0, len(ix), L.BLOCK):
                    block = ix[start:start + L.BLOCK]
                    out[block, :len(e.names)] = e.scores(L.dense_block(pdf.iloc[block], width, None, "idx", "val"))
            yield pd.concat([pdf[kept], pd.DataFrame(out, columns=names)], axis=1)

    return rows.mapInPandas(run, schema)


def _side_of(rule: dict, scores: np.ndarray, names: list[str]) -> np.ndarray:
    """-1 / 1, or 0 for outliers and unsure rows."""
    ok = np.ones(len(scores), dtype=bool)
    for column, lo, hi in rule["fences"]:
        v = scores[:, names.index(column)]
        ok &= (v > lo) & (v < hi)
    inner = rule["inner"]
    if inner["kind"] == "intervals":
        v = scores[:, names.index(inner["marker"])]
        first = -1 if inner["starts"] == "L" else 1
        side = np.where(np.searchsorted(np.asarray(inner["cuts"]), v, side="left") % 2 == 0, first, -first)
    else:
        x = scores[:, [names.index(m) for m in inner["markers"]]]
        k, d = len(inner["weights"]), x.shape[1]
        label = K.merged_labels(x, inner["weights"], np.reshape(inner["means"], (k, d)), np.reshape(inner["covs"], (k, d, d)), inner["merged"])
        mine = 1 if inner["side"] == "R" else -1
        side = np.where(label == inner["chosen"], mine, -mine)
    if rule.get("sides"):
        columns = [names.index(c) for c in rule["key"]]
        x = scores[:, columns]
        logs = K.log_densities(x, np.array([s["mean"] for s in rule["sides"]]), np.array([s["cov"] for s in rule["sides"]]))
        sure = np.where(side < 0, logs[:, 0] > logs[:, 1], logs[:, 1] > logs[:, 0])
        ok &= sure
    return np.where(ok, side, 0)


@dataclass
class ExpressionTree:
    tree: Tree
    features: list[str]
    embeddings: dict[str, Embedding]
    rules: dict[str, dict]

    def place(self, rows: DataFrame) -> DataFrame:
        """Add ``path`` and ``dropped`` (outlier or unsure at that node)."""
        width, rules, embeddings = len(self.features), self.rules, self.embeddings
        schema = T.StructType(rows.schema.fields + [T.StructField("path", T.StringType()), T.StructField("dropped", T.BooleanType())])

        def run(batches):
            for pdf in batches:
                pdf = pdf.reset_index(drop=True)
                path = np.full(len(pdf), "", dtype=object)
                dropped = np.zeros(len(pdf), dtype=bool)
                todo = [("", np.arange(len(pdf)))]
                while todo:
                    at, ix = todo.pop()
                    rule = rules.get(at)
                    if rule is None or len(ix) == 0:
                        continue
                    e = embeddings[at]
                    side = np.zeros(len(ix), dtype=int)
                    for start in range(0, len(ix), L.BLOCK):
                        block = ix[start:start + L.BLOCK]
                        side[start:start + L.BLOCK] = _side_of(rule, e.scores(L.dense_block(pdf.iloc[block], width, None, "idx", "val")), e.names)
                    dropped[ix[side == 0]] = True
                    for s, letter in ((-1, "L"), (1, "R")):
                        part = ix[side == s]
                        path[part] = at + letter
                        todo.append((at + letter, part))
                pdf["path"], pdf["dropped"] = path, dropped
                yield pdf

        return rows.mapInPandas(run, schema)

    def loadings(self, spark) -> DataFrame:
        rows = [(p, self.features[i], e.names[j], float(e.matrix[i, j])) for p, e in self.embeddings.items()
                for j in range(e.matrix.shape[1]) for i in range(e.matrix.shape[0])]
        return spark.createDataFrame(rows, "path string, feature string, component string, w double")


def _fences(level: DataFrame, names: list[str], factor: float, max_drop: int, min_left: int) -> dict[str, tuple]:
    """Outlier fences of every open node at once: {path: (fences, share removed, alarm)}.

    Quantiles, ranges and kept counts are one aggregate each; the walk over at most a handful of columns runs on the driver.
    """
    long = level.select("path", *names).unpivot(["path"], names, "feature", "value")
    q = exact_quantiles(long, ["path", "feature"], "value", [0.25, 0.75])
    ends = long.groupBy("path", "feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    stat: dict[str, dict] = {}
    for r in bounded_rows(q.join(ends, ["path", "feature"])):
        stat.setdefault(r["path"], {})[r["feature"]] = r
    proposals, alarms = {}, {}
    for path, cols in stat.items():
        fences, alarm = [], False
        for name in names:
            s = cols.get(name)
            if s is None:
                continue
            reach = factor * (s["q1"] - s["q0"])
            spread = s["hi"] - s["lo"]
            alarm = alarm or spread > 5 * reach
            if spread >= 3 * reach:
                fences.append((name, s["q0"] - reach, s["q1"] + reach))
        proposals[path], alarms[path] = fences, alarm
    spark = level.sparkSession
    rows = [(p, i, n, lo, hi) for p, f in proposals.items() for i, (n, lo, hi) in enumerate(f)]
    counts = {r["path"]: r["n"] for r in bounded_rows(level.groupBy("path").agg(F.count(F.lit(1)).alias("n")))}
    out = {p: ([], 0.0, alarms.get(p, False)) for p in counts}
    if not rows:
        return out
    table = spark.createDataFrame(rows, "path string, i int, feature string, lo double, hi double")
    values = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    # the first fence a cell violates, per node with fences; counts by that index give every prefix
    limits = table.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("i", "feature", "lo", "hi"))).alias("_f"))
    hit = level.join(F.broadcast(limits), "path").withColumn("_v", values).select("path", F.aggregate(
        F.filter("_f", lambda f: (F.col("_v")[f["feature"]] <= f["lo"]) | (F.col("_v")[f["feature"]] >= f["hi"])),
        F.lit(-1), lambda s, f: F.when(s < 0, f["i"]).otherwise(s)).alias("first"))
    lost: dict[str, dict[int, int]] = {}
    for r in bounded_rows(hit.groupBy("path", "first").agg(F.count(F.lit(1)).alias("n"))):
        lost.setdefault(r["path"], {})[r["first"]] = r["n"]
    for path, fences in proposals.items():
        kept, removed = [], 0
        for i, fence in enumerate(fences):
            removed += lost.get(path, {}).get(i, 0)
            if removed > max_drop or counts[path] - removed < min_left:
                s = stat[path][fence[0]]
                # only the lowest and the highest cell of this column go
                kept, removed = [(fence[0], s["lo"], s["hi"])], 2
                break
            kept.append(fence)
        out[path] = (kept, removed / max(counts[path], 1), alarms[path])
    return out


def grow_expression(rows: DataFrame, features: list[str], embed: Embedder | None = None, profile: Profile | str = "component",
                    min_cells: int = 100, max_depth: int | None = None, outlier_factor: float | None = 4.0, max_drop: int = 30,
                    confident: bool = True) -> ExpressionTree:
    """Grow a tree on packed expression rows (``idx``, ``val`` over ``features``).

    Per level: one Gram per open node (one job), outlier fences and, where more than one percent went, a second
    embedding; then the usual scan on the components. ``confident`` keeps in each child only cells
    denser under their own side than under the other.
    """
    p = PROFILES[profile] if isinstance(profile, str) else profile
    embed = embed or pca_embedder()
    width = len(features)
    rows = materialize(rows.select("idx", "val"))
    out = ExpressionTree(Tree(), features, {}, {})
    total = None
    while out.tree.open_paths():
        paths = out.tree.open_paths()
        level = out.place(rows.select("idx", "val")).filter(~F.col("dropped") & F.col("path").isin(paths)).drop("dropped")
        grams = {k[0]: g for k, g in L.gram(level, width, ["path"], array=None, idx="idx", val="val").items()}
        total = total or sum(g.n for g in grams.values())
        live = []
        for path in paths:
            node, g = out.tree.nodes[path], grams.get(path)
            node.n = g.n if g else 0
            node.weight = node.n / max(total, 1)
            if max_depth is not None and len(path) >= max_depth:
                node.close("depth")
            elif node.n < max(min_cells, p.min_cells):
                node.close("small size")
            else:
                live.append(path)
                out.embeddings[path] = embed(g)
        if not live:
            break
        level = level.filter(F.col("path").isin(live))
        names = out.embeddings[live[0]].names
        scored = _embed_rows(level, width, {q: out.embeddings[q] for q in live}, names)
        fences = {q: ([], 0.0, False) for q in live}
        if outlier_factor is not None:
            fences = _fences(scored, names, outlier_factor, max_drop, 50)
            again = [q for q in live if fences[q][1] > 0.01 or fences[q][2]]
            if again:
                inside = _inside(level.filter(F.col("path").isin(again)), width, out.embeddings, fences)
                for key, g in L.gram(inside, width, ["path"], array=None, idx="idx", val="val").items():
                    fresh = embed(g)
                    # fences were measured on the first embedding; keep its columns beside the new ones
                    old = out.embeddings[key[0]]
                    out.embeddings[key[0]] = Embedding(
                        np.hstack([fresh.matrix, old.matrix]), g.mean, fresh.names + [f"_{n}" for n in old.names])
                    shift = (old.offset - g.mean) @ old.matrix
                    fences[key[0]] = ([(f"_{n}", lo + shift[old.names.index(n)], hi + shift[old.names.index(n)])
                                       for n, lo, hi in fences[key[0]][0]], *fences[key[0]][1:])
        rules_now = {q: {"fences": fences[q][0]} for q in live}
        filtered = _scores_inside(level, width, {q: out.embeddings[q] for q in live}, rules_now, names)
        _split_level(out, filtered, names, live, p, rules_now, confident)
    return out


def _inside(level: DataFrame, width: int, embeddings: dict, fences: dict) -> DataFrame:
    maps = {q: (embeddings[q], fences[q][0]) for q in fences if q in embeddings}

    def run(batches):
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            ok = np.ones(len(pdf), dtype=bool)
            for path, part in pdf.groupby("path", sort=False):
                e, f = maps[path]
                ix = part.index.to_numpy()
                for start in range(0, len(ix), L.BLOCK):
                    block = ix[start:start + L.BLOCK]
                    s = e.scores(L.dense_block(pdf.iloc[block], width, None, "idx", "val"))
                    for name, lo, hi in f:
                        v = s[:, e.names.index(name)]
                        ok[block] &= (v > lo) & (v < hi)
            yield pdf[ok]

    return level.mapInPandas(run, level.schema)


def _scores_inside(level: DataFrame, width: int, embeddings: dict, rules: dict, names: list[str]) -> DataFrame:
    fenced = {q: (embeddings[q], rules[q]["fences"]) for q in embeddings}
    inside = _inside(level, width, embeddings, {q: (f,) for q, (_, f) in fenced.items()})
    short = {q: Embedding(e.matrix[:, :len(names)], e.offset, names) for q, e in embeddings.items()}
    return _embed_rows(inside, width, short, names)


def _split_level(out: ExpressionTree, scored: DataFrame, names: list[str], live: list[str], p: Profile, rules: dict, confident: bool) -> None:
    level = scored.select("path", *names)
    limits = group_limits(level, ["path"], names)
    table = level.sparkSession.createDataFrame([tuple(r) for r in bounded_rows(limits)], limits.schema)
    records = bounded_rows(scan_markers(level, ["path"], names, table, p))
    pairs = pair_candidates(records, ["path"], p, p.merge_cutoff)
    if pairs:
        records += bounded_rows(scan_pairs(level, ["path"], pairs, table, p))
    best: dict[str, object] = {}
    for r in records:
        if r["separable"]:
            node = out.tree.nodes[r["path"]]
            node.scores["+".join(r["key"])] = r["score"]
            if r["path"] not in best or (r["score"], -len(r["key"])) > (best[r["path"]]["score"], -len(best[r["path"]]["key"])):
                best[r["path"]] = r
    for path in live:
        node = out.tree.nodes[path]
        r = best.get(path)
        if r is None or r["score"] <= -1000:
            node.close("no separable features")
        elif r["score"] < p.stop_score:
            node.close("split lowers likelihood")
        elif min(r["n_chosen"], r["n"] - r["n_chosen"]) < p.min_partition:
            node.close("small partition")
        else:
            inner, side = rule_from_record(r, len(r["key"]))
            rules[path].update(inner=inner, key=list(r["key"]))
            node.key, node.score, node.dominant = list(r["key"]), r["score"], {"L": "left", "R": "right"}[side]
            chosen, rest = (r["n_chosen"], r["mean_chosen"]), (r["n"] - r["n_chosen"], r["mean_rest"])
            right, left = (chosen, rest) if side == "R" else (rest, chosen)
            node.n_left, node.n_right, node.mean_left, node.mean_right = int(left[0]), int(right[0]), list(left[1]), list(right[1])
    splitting = [q for q in live if out.tree.nodes[q].status == "open"]
    if confident and splitting:
        _add_confidence(out, scored, names, splitting, rules)
    for path in splitting:
        if out.tree.nodes[path].status == "open":
            out.rules[path] = rules[path]
            out.tree.split(path, {"kind": "embedding", **{k: v for k, v in rules[path].items() if k in ("key", "inner")}})


def _add_confidence(out: ExpressionTree, scored: DataFrame, names: list[str], paths: list[str], rules: dict) -> None:
    """Side Gaussians on the key columns; a side with fewer than 20 sure cells closes the node."""
    from markertree.plans.tree import side_column

    side = None
    for q in paths:
        cond, s = F.col("path") == q, side_column(rules[q]["inner"])
        side = F.when(cond, s) if side is None else side.when(cond, s)
    sided = scored.filter(F.col("path").isin(paths)).withColumn("side", side)
    packed = sided.select("path", "side", F.array(*names).alias("x"))
    grams = L.gram(packed, len(names), ["path", "side"])
    for q in paths:
        columns = [names.index(c) for c in rules[q]["key"]]
        sides = []
        for s in "LR":
            g = grams.get((q, s))
            if g is None or g.n < 2:
                sides = None
                break
            cov = g.cov()[np.ix_(columns, columns)] + K.RIDGE * np.eye(len(columns))
            sides.append({"mean": g.mean[columns].tolist(), "cov": cov.tolist()})
        rules[q]["sides"] = sides
    check = _count_sure(sided, names, {q: rules[q] for q in paths})
    for q in paths:
        if min(check.get((q, -1), 0), check.get((q, 1), 0)) < 20:
            out.tree.nodes[q].close("low confidence split")


def _count_sure(sided: DataFrame, names: list[str], rules: dict) -> dict:
    bare = {q: {**r, "fences": []} for q, r in rules.items()}

    def run(batches):
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            side = np.zeros(len(pdf), dtype=int)
            for path, part in pdf.groupby("path", sort=False):
                ix = part.index.to_numpy()
                side[ix] = _side_of(bare[path], part[names].to_numpy(dtype=float), names)
            yield pd.DataFrame({"path": pdf["path"], "s": side})

    counts = sided.select("path", *names).mapInPandas(run, "path string, s int").groupBy("path", "s").agg(F.count(F.lit(1)).alias("n"))
    return {(r["path"], r["s"]): r["n"] for r in bounded_rows(counts)}


# ------------------------------------------------------------------ metagene splits

def split_by_metagenes(long_counts: DataFrame, cells: DataFrame, rows: DataFrame, features: list[str], components: int = 10,
                       threshold: float = 0.1, min_cells: int = 200, min_side: int = 10) -> dict | None:
    """Two-way split of one node by a Dirichlet-multinomial mixture on metagene counts.

    ``rows`` are the node's packed log-normalised rows for the PCA, ``long_counts`` its raw counts. Returns None when a stop rule applies.
    """
    from markertree.operators.metagenes import count_arrays, dirichlet_labels, fit_dirichlet, metagene_counts, metagenes
    from markertree.operators.scan import component_count_curve

    rows = materialize(rows.select("idx", "val"))
    g = L.gram(rows, len(features), array=None, idx="idx", val="val")[()]
    if g.n < min_cells:
        return None
    model = L.pca_from(g, components)
    names = [f"PC{i}" for i in range(components)]
    scored = L.apply_map(rows.select("idx", "val"), model.matrix, model.offset, None, "idx", "val").select(
        *[F.element_at("scores", i + 1).alias(n) for i, n in enumerate(names)])
    curve = {(r["feature"], r["k"]): r["bic"] for r in bounded_rows(component_count_curve(scored, [], names, 2))}
    first = next((i for i, n in enumerate(names) if curve[(n, 1)] < curve.get((n, 2), np.inf)), len(names) - 1)
    used = names[:min(first + 1, len(names))]
    genes = metagenes(L.loadings_table(rows.sparkSession, model, features), threshold, used)
    labels = sorted(r[0] for r in bounded_rows(genes.select("metagene").distinct()))
    arrays = materialize(count_arrays(metagene_counts(long_counts, genes), labels, cells))
    fitted = fit_dirichlet(arrays, len(labels), 2)
    labelled = dirichlet_labels(arrays, fitted)
    sizes = {r["label"]: r["n"] for r in bounded_rows(labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")))}
    if min(sizes.get(0, 0), sizes.get(1, 0)) < min_side:
        return None
    return {"cells": labelled, "metagenes": genes, "model": fitted, "n_components": len(used)}


# ------------------------------------------------------------------ veto by expression

def expression_veto(long: DataFrame, genes_per_side: int | None = None, large: int = 10_000):
    """A ``veto`` for ``grow``: a candidate split stands only if a discriminant on expression separates its sides.

    For all proposals of a level together: differential genes of the two sides, a linear discriminant on them, and the overlap of
    its two score distributions against a size-dependent bar. Cells are matched by ``cell_id``.
    """
    from markertree.operators import local_gram as G
    from markertree.operators.assign import projection_overlap
    from markertree.plans.tree import side_column

    def solve(node, raw, sums):
        within, n = G.within_scatter(raw, sums)
        mean = {p: s / max(m, 1) for p, (m, s) in sums.items()}
        level = max(np.trace(within) / max(n - 2, 1) / len(within), 1e-12)
        w = np.linalg.solve(within / max(n - 2, 1) + 1e-9 * level * np.eye(len(within)), mean["R"] - mean["L"])
        w = w / max(np.linalg.norm(w), 1e-300)
        return pd.DataFrame([(node, w, float(sum(s for _, s in sums.values()) @ w / n))], columns=["node", "w", "centre"])

    def veto(proposals: list, placed: DataFrame) -> set[int]:
        spark = placed.sparkSession
        side = F.coalesce(*[F.when(F.col("path") == path, side_column(rule)) for path, _, rule in proposals])
        groups = materialize(placed.filter(F.col("path").isin([path for path, _, _ in proposals])).select(
            F.col("path").alias("node"), F.col("cell_id").alias("cell"), side.alias("side")).filter(F.col("side").isNotNull()))
        sizes: dict[str, dict[str, int]] = {}
        for r in bounded_rows(groups.groupBy("node", "side").agg(F.count(F.lit(1)).alias("n"))):
            sizes.setdefault(r["node"], {})[r["side"]] = r["n"]
        sizes = {node: n for node, n in sizes.items() if len(n) == 2 and min(n.values()) > 1}
        if not sizes:
            return set()
        rows = [(node, n["L"], n["R"], genes_per_side or (200 if 500 < n["L"] + n["R"] < 5000 else 1000)) for node, n in sorted(sizes.items())]
        table = spark.createDataFrame(rows, "node string, nl bigint, nr bigint, top int")
        cells = groups.join(table.select("node"), "node")
        entries = materialize(
            long.select(F.col("cell_id").alias("cell"), F.col("feature").alias("i"), F.col("value").alias("v")).join(lookup(cells), "cell"))
        index = G.node_features(G.side_features(G.side_sums(entries, ["node"]), table, ["node"]))
        solved = materialize(G.solve_nodes(
            entries.withColumnRenamed("side", "part").select("node", "part", "cell", "i", "v"), index, sizes, solve,
            "node string, w array<double>, centre double"))
        scored = entries.join(G.node_weights(solved, index), ["node", "i"]).groupBy("node", "cell").agg(F.sum(F.col("v") * F.col("w")).alias("_h"))
        h = cells.join(scored, ["node", "cell"], "left").join(solved.select("node", "centre"), "node").select(
            "node", "side", (F.coalesce("_h", F.lit(0.0)) - F.col("centre")).alias("h"))
        passed = {r["node"] for r in projection_overlap(h, "side", large, ["node"]).filter("separable").select("node").collect()}
        discard(entries)
        discard(groups)
        return {i for i, (path, _, _) in enumerate(proposals) if path in passed}

    return veto
