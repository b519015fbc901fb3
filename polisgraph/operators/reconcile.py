"""Reconciliation of a measured value with a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(rows: DataFrame, measured: str, reference: str) -> DataFrame:
    """``rows`` with delta, its size and direction, a status, a severity and a confidence.

    Without one of the two values the row needs review, with medium confidence and no delta.  Values are compared after
    rounding to cents: a shortfall is an extraction gap, a surplus a source inconsistency.
    """
    delta = F.round(F.col(measured) - F.col(reference), 2).cast("decimal(18,2)")
    direction = F.when(delta > 0, "measured_gt_reference").when(delta < 0, "reference_gt_measured").when(delta == 0, "equal")
    status = F.when(delta.isNull(), "needs_review").when(delta == 0, "reconciled").when(delta < 0, "extraction_gap").otherwise("source_inconsistency")
    out = rows.withColumns({"delta": delta, "absolute_delta": F.abs(delta).cast("decimal(18,2)"), "direction": direction, "status": status, "confidence": F.when(delta.isNull(), "medium").otherwise("high")})
    return out.withColumn("severity", F.when(F.col("status") == "reconciled", "info").otherwise("warn"))
