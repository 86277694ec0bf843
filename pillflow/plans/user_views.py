"""User directory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pillflow.functions import predicates as P


def user_list(users: DataFrame, name_part: str | None = None) -> DataFrame:
    """Users for display, optionally those with a part in their name."""
    return users.where(P.name_contains(F.col("username"), name_part)).select(
        F.col("id").alias("ID"), F.col("kundennummer").alias("Kundennummer"),
        F.col("username").alias("Benutzername"), F.col("role").alias("Rolle"))
