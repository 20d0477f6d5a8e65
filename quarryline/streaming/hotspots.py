"""Streaming churn per file (an extension: the batch operators have no streaming counterpart to reproduce).

Late rows are accepted within the watermark; a window is given out once when the watermark has passed it.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators.changes import plain_path


def churn(changes: DataFrame, window: str = "7 days", late: str = "30 days") -> DataFrame:
    """(window, repo, path, rows, churn) over a stream of changes by ``recorded_at``."""
    rows = changes.select(F.col("recorded_at").cast("timestamp").alias("at"), "repo", plain_path(F.col("path")).alias("path"), (F.coalesce("added", F.lit(0)) + F.coalesce("deleted", F.lit(0))).alias("churn"))
    return rows.withWatermark("at", late).groupBy(F.window("at", window), "repo", "path").agg(F.count("*").alias("rows"), F.sum("churn").alias("churn"))
