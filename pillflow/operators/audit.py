"""Writing down what a batch did."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pillflow.functions.messages import answer, log_text
from pillflow.functions.scalars import AsOf, customer_or_unknown
from pillflow.operators.carts import Checkout
from pillflow.operators.orders import Cancellation
from pillflow.plans.order_views import joined_names
from pillflow.schemas import OK


def answers(operation: str, outcomes: DataFrame) -> DataFrame:
    """Outcomes with the text for the user in ``antwort``."""
    return outcomes.withColumn("antwort", answer(operation, outcomes.columns))


def audit_log(operation: str, outcomes: DataFrame, at: AsOf, customer: str = "kundennummer") -> DataFrame:
    """Action-log rows of a batch; the customer is 'Unbekannt' where the outcomes name none."""
    who = F.col(customer) if customer in outcomes.columns else F.lit(None).cast("string")
    rows = outcomes.select(
        F.lit(str(at)[:19].replace("T", " ")).alias("zeitstempel"),
        customer_or_unknown(who).alias("kundennummer"),
        log_text(operation, outcomes.columns).alias("aktion"))
    return rows.where(F.col("aktion").isNotNull())


def _with_names(lines: DataFrame, operation: str, at: AsOf) -> DataFrame:
    """One entry per order with the names of its goods."""
    orders = joined_names(lines, ["bestellgruppe_id", "kundennummer"], by=("id",))
    return audit_log(operation, orders.withColumns({"code": F.lit(OK), "detail": F.col("bestellgruppe_id")}), at)


def checkout_answers(checkout: Checkout) -> DataFrame:
    """Outcomes of a checkout with the text for the user, who is told the names of the goods ordered."""
    names = joined_names(checkout.new_orders, ["bestellgruppe_id"], by=("id",))
    named = names.select(F.col("bestellgruppe_id").cast("string").alias("detail"), F.lit(OK).alias("code"), "namen")
    return answers("checkout", checkout.outcomes.join(named, ["code", "detail"], "left"))


def checkout_log(checkout: Checkout, at: AsOf) -> DataFrame:
    """Entries for the orders placed."""
    return _with_names(checkout.new_orders, "checkout", at)


def cancellation_log(cancellation: Cancellation, at: AsOf) -> DataFrame:
    """Entries for the orders cancelled, with what went back into the store room."""
    return _with_names(cancellation.returned_lines, "cancellation", at)


def status_log(requests: DataFrame, at: AsOf) -> DataFrame:
    """Entries for status requests, one each."""
    return audit_log("status", requests.withColumn("code", F.lit(OK)), at)
