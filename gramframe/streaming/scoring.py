"""Fitted, stateless transforms on a streaming input.

Preprocessing statistics, angle encoding and kernel-expansion scoring hold no state beyond
the fitted model (a handful of numbers and a bounded landmark set), so a stream of rows can
be scored with the same operators as a table: ``readStream`` -> transform -> ``writeStream``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import recursions as rec
from ..operators import kernel_stats as ks
from ..operators.encode import encode_angles
from ..operators.prep import Preprocessor


def score_stream(stream: DataFrame, pre: Preprocessor, landmarks: DataFrame, feature_map: str,
                 repetitions: int, features: list[str]) -> DataFrame:
    """Streaming rows -> (row..., score, pred) with a fitted preprocessor and landmark model
    (landmarks: encoded rows with coefficients, e.g. ``class_mean_coefficients``)."""
    enc = encode_angles(pre.transform(stream), features)
    angles = [f"a{q}" for q in range(len(features))]
    s = ks.kernel_scores(enc, landmarks, rec.fidelity_kernel(feature_map, repetitions), angles)
    return s.withColumn("pred", (F.col("score") > 0).cast("int"))
