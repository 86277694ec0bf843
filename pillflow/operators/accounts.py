"""Registering and removing users."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pillflow.functions import predicates as P
from pillflow.operators import lookups as L
from pillflow.operators.ranking import rank_rows
from pillflow.schemas import ADMIN, MISSING_FIELD, OK, TAKEN, USER

FIRST_NUMBER = 10000000  # customer numbers have eight digits


@dataclass(frozen=True)
class Registration:
    """Register users: the first request per name wins, and the first user of all becomes administrator.

    ``last_number`` and ``last_id`` are the highest ever given, where that is known: a user who has been removed and
    never ordered anything leaves no other trace. ``has_admin`` tells whether there is an administrator; without it
    that is seen from ``users_before``, which must then hold all users and not only those with names asked for.
    """

    users_before: DataFrame
    requests: DataFrame
    orders_before: DataFrame | None = None
    last_number: int = 0
    last_id: int = 0
    has_admin: bool | None = None

    @cached_property
    def _firsts(self) -> DataFrame:
        usable = self.requests.where(P.filled(F.col("username")))
        firsts = usable.groupBy("username").agg(F.min(F.struct("seq", "role")).alias("first"))
        known = firsts.select("username", F.col("first.seq").alias("first_seq"), F.col("first.role").alias("role"))
        return L.taken_flags(known, self.users_before)

    @cached_property
    def new_users(self) -> DataFrame:
        """Numbered on from the highest number and id ever given, so that nobody gets what was another's.

        A customer who has been removed may still be named in orders, which therefore count as well.
        """
        number = F.max(F.col("kundennummer").try_cast("long"))
        users = self.users_before.agg(number.alias("number"), F.max("id").alias("id"), F.count_if(F.col("role") == ADMIN).alias("admins")).first()
        ordered = self.orders_before.agg(number).first()[0] if self.orders_before is not None else None
        last_number = max(users.number or 0, ordered or 0, self.last_number, FIRST_NUMBER - 1)
        last_id = max(users.id or 0, self.last_id)
        role = F.coalesce("role", F.lit(USER))
        if not (users.admins if self.has_admin is None else self.has_admin):
            role = F.when(F.col("rang") == 1, ADMIN).otherwise(role)
        in_order = rank_rows(self._firsts.where(~F.col("taken")), "first_seq")
        return in_order.select(
            (F.col("rang") + last_id).alias("id"), (F.col("rang") + last_number).cast("string").alias("kundennummer"),
            "username", role.alias("role"))

    @cached_property
    def outcomes(self) -> DataFrame:
        usable = P.filled(F.col("username"))
        known = self._firsts.join(self.new_users.select("username", "kundennummer"), "username", "left").drop("role")
        judged = L.with_facts(self.requests, known, ["username"], usable)
        code = F.when(~usable, MISSING_FIELD).when(F.col("taken") | (F.col("seq") > F.col("first_seq")), TAKEN).otherwise(OK)
        return judged.select("seq", "username", code.alias("code"),
                             F.when(code == OK, F.col("kundennummer")).alias("detail"))

    @cached_property
    def users(self) -> DataFrame:
        return self.users_before.unionByName(self.new_users)


def remove_users(users: DataFrame, usernames: DataFrame) -> DataFrame:
    """Users without those named; unknown names are passed over."""
    return users.join(usernames.select("username"), "username", "left_anti").select(*users.columns)
