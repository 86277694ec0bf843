"""Reviewing the action log. Input: entries with a real time in ``ts``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pillflow.functions import predicates as P
from pillflow.functions.scalars import AsOf, day, hours_between
from pillflow.operators.ranking import rank_rows, sorted_slices


def log_list(log: DataFrame) -> DataFrame:
    """The three columns of the log, whatever helper columns were added."""
    return log.select(F.col("zeitstempel").alias("Zeitstempel"), F.col("kundennummer").alias("Benutzer"),
                      F.col("aktion").alias("Aktion"))


def log_search(log: DataFrame, action: str | None = None) -> DataFrame:
    """Entries whose action matches a pattern."""
    return log_list(log.where(P.action_matches(F.col("aktion"), action)))


def log_review(log: DataFrame, on: AsOf, start: str = "00:00:00", end: str = "23:59:59") -> DataFrame:
    """Entries of one day between two clock times, both included."""
    return log_list(log.where(P.dated(F.col("zeitstempel"), on) & P.within_clock(F.col("ts"), start, end)))


def log_review_stored(days: DataFrame, on: AsOf, start: str = "00:00:00", end: str = "23:59:59") -> DataFrame:
    """The same over the log as it is stored by day, where all other days are not even read."""
    return log_list(days.where((F.col("tag") == day(on)) & P.within_clock(F.col("ts"), start, end)))


def log_by_time(log: DataFrame) -> DataFrame:
    """Entries with their place in the order of time, 1, 2, 3, ..., in ``rang``."""
    return rank_rows(log, "ts", "kundennummer", "aktion")


def mean_time_between_failures(log: DataFrame) -> DataFrame:
    """Mean hours between critical failures; NULL below two. The gaps add up to the span from first to last."""
    return mean_time_of(failure_span(log))


def failure_span(log: DataFrame) -> DataFrame:
    """Number, first and last time of critical failures, which can be carried on from batch to batch."""
    return log.where(P.critical(F.col("aktion"))).agg(
        F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def mean_time_of(failures: DataFrame) -> DataFrame:
    mean = F.when(F.col("n") > 1, hours_between(F.col("first"), F.col("last")) / (F.col("n") - 1))
    return failures.select(F.col("n").alias("ausfaelle"), mean.alias("mtbf_stunden"))


def failure_gaps(log: DataFrame) -> DataFrame:
    """Critical failures with the hours since the one before; NULL for the first.

    The failures are cut into ordered slices. Within a slice the one before is next to it; the first of a slice
    follows the last of the slice before, and there is one such row per slice, which is few.
    """
    failures = log.where(P.critical(F.col("aktion"))).select("ts", "kundennummer", "aktion")
    slices = sorted_slices(failures, "ts", "kundennummer", "aktion")
    ends = slices.groupBy("_slice").agg(F.max("ts").alias("end"))
    ends = ends.select("_slice", F.lag("end").over(Window.orderBy("_slice")).alias("end_before"))
    inside = F.lag("ts").over(Window.partitionBy("_slice").orderBy("_place"))
    linked = slices.withColumn("inside", inside).join(F.broadcast(ends), "_slice")
    before = F.coalesce("inside", "end_before")
    return linked.select("ts", "kundennummer", "aktion", hours_between(before, F.col("ts")).alias("abstand_stunden"))
