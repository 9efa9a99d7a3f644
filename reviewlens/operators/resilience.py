"""Circuit breaker and rate limit over recorded calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values.
WINDOW, LEAST_CALLS, MODEL_RATE, AGENT_RATE, A_SECOND = 10, 5, 0.5, 0.6, 10


def breaker(calls: DataFrame, key: str = "caller", size: int = WINDOW, least: int = LEAST_CALLS, rate: float = MODEL_RATE) -> DataFrame:
    """Over each caller's last ``size`` calls: their number, the failure rate, and whether the breaker opens."""
    w = Window.partitionBy(key).orderBy("ts", "call_id").rowsBetween(1 - size, 0)
    out = calls.withColumns({"calls": F.count(F.lit(1)).over(w).cast("int"), "failure_rate": F.avg(F.col("failed").cast("double")).over(w)})
    return out.withColumn("open", (F.col("calls") >= least) & (F.col("failure_rate") >= rate))


def admitted(calls: DataFrame, key: str = "caller", a_second: int = A_SECOND) -> DataFrame:
    """ST8: the first ``a_second`` calls of every caller in every second."""
    out = calls.withColumn("second", F.date_trunc("second", F.col("ts")))
    nth = F.row_number().over(Window.partitionBy(key, "second").orderBy("ts", "call_id"))
    return out.withColumn("nth", nth).where(F.col("nth") <= a_second)
