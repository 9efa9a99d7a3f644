"""Severities: normal names and the two scales on which findings are ordered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
SEVERITIES = ("CRITICAL", "WARNING", "INFO")


def normal(severity: Column) -> Column:
    """HIGH and ERROR are CRITICAL, MEDIUM is WARNING; anything else, and null, is INFO."""
    s = F.upper(F.trim(severity))
    return F.when(s.isin("CRITICAL", "HIGH", "ERROR"), "CRITICAL").when(s.isin("WARNING", "MEDIUM"), "WARNING").otherwise("INFO")


def weight(severity: Column) -> Column:
    """For ranking: 3, 2, 1; unknown counts as INFO."""
    s = F.upper(severity)
    return F.when(s == "CRITICAL", 3).when(s == "WARNING", 2).otherwise(1)


def rank(severity: Column) -> Column:
    """For deduplication: 3, 2, 1; unknown is below INFO."""
    s = F.upper(severity)
    return F.when(s == "CRITICAL", 3).when(s == "WARNING", 2).when(s == "INFO", 1).otherwise(0)
