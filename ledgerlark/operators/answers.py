"""Answers to planned questions: evidence, sentence, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark import fixed
from ledgerlark.operators import questions, tools
from ledgerlark.operators.filters import broadcast_if_small
from ledgerlark.session import stored
from ledgerlark.sources.star import SalesStar


def answer_plans(planned: DataFrame, star: SalesStar, quality: DataFrame) -> DataFrame:
    """One row per question.  ``planned`` is read several times.

    Many questions may be one call, so the evidence, a row for each distinct
    call, is broadcast if its bytes allow it.
    """
    calls = planned.where(F.col("status") == questions.PLANNED)
    evidence = stored(tools.run_tools(calls, star, quality), "evidence")
    evidence = broadcast_if_small(evidence.withColumnRenamed("status", "call_status"))
    answered = F.col("call_status") == tools.OK
    status = (
        F.when(F.col("status") != questions.PLANNED, F.col("status"))
        .when(answered, "answered")
        .otherwise("unavailable")
    )
    return planned.join(evidence, list(tools.CALL), "left").select(
        "conv_id",
        "turn",
        status.alias("status"),
        F.when(F.col("status") != questions.PLANNED, F.col("reason"))
        .when(answered, F.col("answer"))
        .otherwise(fixed.UNAVAILABLE_TEXT)
        .alias("answer"),
        "tool",
        "parameters",
        "result",
        "action",
        "ingestion_run_id",
        "generated_at",
    )


def answer_messages(messages: DataFrame, star: SalesStar, quality: DataFrame) -> DataFrame:
    """Plan and answer every user message of the conversations.

    The plan is written once, since its distinct calls are read by every tool.
    """
    asked = questions.questions(questions.with_history(messages))
    return answer_plans(stored(questions.plan(asked, star), "plans"), star, quality)
