"""Evaluation pairs, their scores and the score summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageloom.operators.conversation import pair_turns
from passageloom.operators.scoring import SCORES, score_pairs
from passageloom.operators.stats import describe_scores


def message_pairs(messages: DataFrame) -> DataFrame:
    """``(pair_id, reference, candidate)``: each question as reference, the answer after it as candidate."""
    pair_id = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    return pair_turns(messages).select(
        pair_id.alias("pair_id"), F.col("question").alias("reference"), F.col("answer").alias("candidate")
    )


def evaluate(pairs: DataFrame, **options) -> DataFrame:
    """Summary statistics of all four scores."""
    return describe_scores(score_pairs(pairs, **options), SCORES)
