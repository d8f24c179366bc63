"""Null roles and texts in reply trees keep their turns."""

from pyspark.sql import functions as F

from markertree.llm import chat

MESSAGES = "conv_id long, msg_id long, parent_id long, role string, text string, score double"


def test_null_turns_stay_and_the_loss_follows(spark):
    rows = [(1, 1, None, "user", None, 0.0), (1, 2, 1, None, "who", 0.0), (1, 3, 2, "assistant", None, 0.0), (1, 4, 3, "assistant", "yes", 0.0)]
    made = chat.format_paths(chat.chosen_paths(spark.createDataFrame(rows, MESSAGES)))
    row = made.select(chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [tuple(t) for t in row.turns] == [("user", ""), ("", "who"), ("assistant", ""), ("assistant", "yes")]
    assert row.loss == "yes"
