"""Validation of streams: the batch plan on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.validate import ValidationPlan, ValidationResult


def validate_stream(stream: DataFrame, plan: ValidationPlan, on_result: Callable[[ValidationResult, int], None], checkpoint: str) -> StreamingQuery:
    """Runs the plan on every micro-batch and hands its result on; the caller awaits or stops the query."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, k: on_result(plan.run(batch), k)).start()
