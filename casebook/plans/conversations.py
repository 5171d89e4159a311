"""Thread history and question/answer pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.operators.windows import top_k, with_next, with_preceding

HISTORY = 8
BLOCK = 4096


def history(messages: DataFrame, payload: Column, k: int = HISTORY, thread: str = "conv_id", order: str = "turn", width: int = BLOCK) -> DataFrame:
    """For every message the last k messages before it, oldest first; diagram turns do not count."""
    return with_preceding(messages.filter("diagram IS NULL"), [thread], order, payload, k, "history", width)


def last_questions(messages: DataFrame, k: int = 2, thread: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last k user turns of each thread."""
    return top_k(messages.filter("role = 'user'"), [thread], [F.col(order).desc()], k)


def exchanges(messages: DataFrame, thread: str = "conv_id", order: str = "turn", width: int = BLOCK) -> DataFrame:
    """User turns with the assistant answer that follows at once."""
    following = F.struct(F.col("role").alias("role"), F.col("text").alias("text"))
    rows = with_next(messages, [thread], order, following, "_next", width)
    return rows.filter("role = 'user' AND _next.role = 'assistant'").select(
        thread, order, F.col("text").alias("question"), F.col("_next.text").alias("answer")
    )
