"""Chat formatting: reply trees to root-to-leaf paths, each formatted as one conversation.

Only DataFrame operations. A message knows its parent; pointer doubling (self-joins of the message table with itself)
finds every message's root, depth and summed score in about log2(depth) rounds, and marks the messages of each
chosen path in as many. No round copies whole paths, so a thread of n messages costs n log n rows, not n squared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markertree.session import materialize

OPEN, CLOSE, END = "<|", "|>", "<|end|>"


def escape(text: Column) -> Column:
    """Reversible: no ``<`` is left, so no marker can occur inside a text."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("|"), F.lit("&bar;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&bar;"), F.lit("|")))


def linear_replies(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a reply tree in which each row answers the one before it.

    Order is by turn, then role and text, nulls first; repeated rows are turns of their own; a null role or text is
    empty; other columns are left behind. Rows with a null conv_id form one conversation.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select(
        "conv_id", F.row_number().over(order).cast("long").alias("msg_id"), "role", "text", F.lit(0.0).alias("score"),
    ).withColumn("parent_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1))


def chosen_paths(messages: DataFrame, paths_per_tree: int = 1) -> DataFrame:
    """The best root-to-leaf paths of each reply tree, as rows (conv_id, root_id, path, depth, msg_id, role, text).

    ``messages`` has (conv_id, msg_id, parent_id, role, text, score), msg_id unique in its conversation. A branch scores
    the sum over its path (null: 0); paths are ranked from 1, ties to the smaller leaf id. A parent that is missing or
    null makes a root; messages on a cycle reach no root and have no path.
    """
    m = messages.select("conv_id", "msg_id", "parent_id", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score"))
    ids = m.select(F.col("conv_id").alias("_c"), F.col("msg_id").alias("_m"))
    up = m.join(ids, F.col("_c").eqNullSafe(m.conv_id) & (F.col("_m") == m.parent_id), "left").select(
        "conv_id", "msg_id", F.col("_m").alias("up"), "score", F.lit(0).alias("depth"),
        F.col("msg_id").alias("root"))
    # after k rounds: up is the ancestor 2^k above, score and depth cover the messages passed on the way
    state = materialize(up.withColumn("depth", F.col("up").isNotNull().cast("long")))
    parents = m.select("conv_id", F.col("parent_id").alias("msg_id")).distinct()
    active, done = state.filter(F.col("up").isNotNull()), state.filter(F.col("up").isNull())
    steps = []
    rounds = state.count().bit_length()  # no path is longer than the table: what is active after them is on a cycle
    while len(steps) < rounds and active.limit(1).count():
        steps.append(active.select("conv_id", "msg_id", "up"))
        a, b = active.alias("a"), active.unionByName(done).alias("b")
        joined = materialize(a.join(
            b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.up") == F.col("b.msg_id"))).select(
            "a.conv_id", "a.msg_id", F.col("b.up").alias("up"), (F.col("a.score") + F.col("b.score")).alias("score"),
            (F.col("a.depth") + F.col("b.depth")).alias("depth"), F.col("b.root").alias("root")))
        active, done = joined.filter(F.col("up").isNotNull()), done.unionByName(joined.filter(F.col("up").isNull()))
    leaves = done.join(parents.select(F.col("conv_id").alias("_c"), F.col("msg_id").alias("_m")),
                         F.col("_c").eqNullSafe(F.col("conv_id")) & (F.col("_m") == F.col("msg_id")), "left_anti")
    rank = Window.partitionBy("conv_id", "root").orderBy(F.desc("score"), "msg_id")
    on_path = leaves.withColumn("path", F.row_number().over(rank)).filter(F.col("path") <= paths_per_tree).select(
        "conv_id", F.col("root").alias("root_id"), "path", "msg_id")
    for step in reversed(steps):  # the ancestors 2^k above, for falling k: each is added once
        above = on_path.alias("p").join(step.alias("s"), F.col("p.conv_id").eqNullSafe(F.col("s.conv_id"))
                                        & (F.col("p.msg_id") == F.col("s.msg_id")))
        on_path = materialize(on_path.unionByName(
            above.select("p.conv_id", "p.root_id", "p.path", F.col("s.up").alias("msg_id"))))
    body = m.select(F.col("conv_id").alias("_c"), F.col("msg_id").alias("_m"), "role", "text")
    depth = done.select(F.col("conv_id").alias("_c2"), F.col("msg_id").alias("_m2"), "depth")
    return (
        on_path.join(body, F.col("_c").eqNullSafe(F.col("conv_id")) & (F.col("_m") == F.col("msg_id")))
        .join(depth, F.col("_c2").eqNullSafe(F.col("conv_id")) & (F.col("_m2") == F.col("msg_id")))
        .select("conv_id", "root_id", "path", "depth", "msg_id", "role", "text")
    )


def format_paths(paths: DataFrame) -> DataFrame:
    """One row per path: (conv_id, root_id, path, formatted, loss_spans).

    A turn is ``<|role|>text<|end|>`` with role and text escaped. ``loss_spans`` are (start from 1, length) in code
    points of the escaped assistant texts. A null role or text reads as empty; no paths give no rows.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = paths.select(
        "conv_id", "root_id", "path", "depth", F.concat(F.lit(OPEN), _escape_role(role), F.lit(CLOSE)).alias("head"),
        escape(text).alias("body"), (role == "assistant").alias("loss"))
    grouped = turns.groupBy("conv_id", "root_id", "path").agg(
        F.sort_array(F.collect_list(F.struct("depth", "head", "body", "loss"))).alias("turns"))
    formatted = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))))
    walked = F.aggregate(
        "turns",
        F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + F.lit(len(END))).alias("at"),
            F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length")))))
            .otherwise(acc["spans"]).alias("spans")))
    return grouped.select("conv_id", "root_id", "path", formatted.alias("formatted"), walked["spans"].alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted conversation holds."""
    pieces = F.split(formatted, r"<\|end\|>")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        at = F.instr(piece, F.lit(CLOSE))
        return F.struct(
            _unescape_role(F.substring(piece, F.lit(len(OPEN) + 1), at - F.lit(len(OPEN) + 1))).alias("role"),
            unescape(F.substring(piece, at + F.lit(len(CLOSE)), F.length(piece))).alias("text"))

    return F.transform(pieces, turn)


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"], s["length"]))))
