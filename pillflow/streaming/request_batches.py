"""Requests as micro-batches against the current snapshot.

An operation reads the pieces of a table that its requests name, judges the requests once, and says what changes.
Outcomes, new state and log entries come from the same result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pillflow.functions.scalars import AsOf
from pillflow.operators import audit
from pillflow.operators.accounts import Registration, remove_users
from pillflow.operators.carts import Checkout
from pillflow.operators.dispenser import Fill, Return
from pillflow.operators.lookups import open_lines_of
from pillflow.operators.orders import Cancellation, set_order_status
from pillflow.operators.stockroom import Intake, Removal
from pillflow.plans.quality import rates_of
from pillflow.schemas import ADMIN, OK
from pillflow.session import keep
from pillflow.sources.action_log import write_log
from pillflow.sources.snapshots import Append, Change, Rewrite, Snapshots
from pillflow.sources.tables import COMPACT


@dataclass(frozen=True)
class Step:
    """What a batch of requests does: changes of tables, outcomes, and the log entries it makes at a given time
    of its outcomes as they are written."""

    changes: dict[str, Change]
    outcomes: DataFrame | None = None
    log: Callable[[AsOf, DataFrame | None], DataFrame] | None = None


Operation = Callable[[Snapshots, DataFrame], Step]


def _logged(operation: str) -> Callable[[AsOf, DataFrame], DataFrame]:
    return lambda at, outcomes: audit.audit_log(operation, outcomes, at)


def intake(as_of: AsOf) -> Operation:
    def run(tables: Snapshots, requests: DataFrame) -> Step:
        stock, _ = tables.near("stock", requests)
        result = Intake(stock, tables.read("orders"), requests, as_of)
        return Step({"stock": Append(result.accepted)}, result.outcomes, _logged("intake"))
    return run


def removal() -> Operation:
    def run(tables: Snapshots, requests: DataFrame) -> Step:
        stock, pieces = tables.near("stock", requests)
        result = Removal(stock, requests)
        return Step({"stock": Rewrite(result.stock, pieces)}, result.outcomes, _logged("removal"))
    return run


def fill(as_of: AsOf) -> Operation:
    """Channels are those of the whole dispenser, goods those that are asked for."""
    def run(tables: Snapshots, requests: DataFrame) -> Step:
        stock, pieces = tables.near("stock", requests)
        result = Fill(stock, requests, as_of, tables.read("stock"))
        return Step({"stock": Rewrite(result.stock, pieces)}, result.outcomes, _logged("fill"))
    return run


def give_back() -> Operation:
    def run(tables: Snapshots, requests: DataFrame) -> Step:
        stock, pieces = tables.near("stock", requests)
        result = Return(stock, requests)
        return Step({"stock": Rewrite(result.stock, pieces)}, result.outcomes, _logged("return"))
    return run


def checkout(as_of: AsOf) -> Operation:
    """Requests are cart lines with their ``kundennummer``; a cart arrives within one micro-batch."""
    def run(tables: Snapshots, requests: DataFrame) -> Step:
        carts = requests.select("cart_id", "kundennummer").distinct()
        lines = requests.select("cart_id", "line_no", "barcode").where("barcode is not null")
        stock, pieces = tables.near("stock", lines)
        given = tables.counters()
        result = Checkout(stock, None, carts, lines, as_of, given.get("order_id", 0), given.get("order_group", 0))
        changes = {"stock": Rewrite(result.stock, pieces), "orders": Append(result.new_orders)}
        return Step(changes, keep(result.outcomes), lambda at, _: audit.checkout_log(result, at))
    return run


def cancellation(as_of: AsOf) -> Operation:
    def run(tables: Snapshots, requests: DataFrame) -> Step:
        orders, order_pieces = tables.near("orders", requests)
        pairs = requests.select("bestellgruppe_id", "kundennummer").distinct()
        stock, stock_pieces = tables.near("stock", open_lines_of(pairs, orders).select("barcode"))
        result = Cancellation(stock, orders, requests, as_of)
        changes = {"stock": Rewrite(result.stock, stock_pieces), "orders": Rewrite(result.orders, order_pieces)}
        return Step(changes, keep(result.outcomes), lambda at, _: audit.cancellation_log(result, at))
    return run


def status_change() -> Operation:
    def run(tables: Snapshots, requests: DataFrame) -> Step:
        orders, pieces = tables.near("orders", requests)
        return Step({"orders": Rewrite(set_order_status(orders, requests), pieces)}, None, lambda at, _: audit.status_log(requests, at))
    return run


def registration() -> Operation:
    """Numbers go on from the highest ever published, those of users since removed included."""
    def run(tables: Snapshots, requests: DataFrame) -> Step:
        users, _ = tables.near("users", requests)
        given = tables.counters()
        has_admin = not tables.read("users").where(F.col("role") == ADMIN).isEmpty()
        result = Registration(users, requests, None, given.get("customer_number", 0), given.get("user_id", 0), has_admin)
        return Step({"users": Append(result.new_users)}, result.outcomes, _logged("registration"))
    return run


def user_removal() -> Operation:
    """Requests name users; the reference to them in orders stays, and so do the numbers given."""
    def run(tables: Snapshots, requests: DataFrame) -> Step:
        users, pieces = tables.near("users", requests)
        return Step({"users": Rewrite(remove_users(users, requests), pieces)})
    return run


_JUDGED, _ACCEPTED = "judged by ", "accepted by "


def published_rates(tables: Snapshots) -> DataFrame:
    """Success and error rate of each stream over all outcomes published so far, from the manifest alone."""
    given = tables.tallies()
    names = [n.removeprefix(_JUDGED) for n in given if n.startswith(_JUDGED)]
    counted = [(n, given[_JUDGED + n], given[_ACCEPTED + n]) for n in names if given[_JUDGED + n]]
    return rates_of(tables.spark.createDataFrame(counted, "vorgang string, anzahl long, ok long"))


@dataclass(frozen=True)
class RequestStream:
    """Applies an operation to each micro-batch and publishes the result as a new snapshot.

    The number of the micro-batch is published together with the tables, so one that Spark hands over again
    after a failure is passed over; so are the numbers of outcomes so far, which therefore count none twice. The outcomes of each micro-batch go to a folder of their own, and so do the log
    entries it makes where ``log_path`` is given, with the time ``at``.
    """

    name: str
    tables: Snapshots
    operation: Operation
    outcomes_path: str
    log_path: str | None = None
    at: AsOf | None = None

    def apply(self, requests: DataFrame, batch_id: int) -> None:
        if self.tables.has_batch(self.name, batch_id):
            return
        # All results are made from the requests, which are read and parsed once.
        step = self.operation(self.tables, keep(requests))
        tallies, outcomes = {}, step.outcomes
        if outcomes is not None:
            # Judged once, as they are written; what is counted and logged is read from there.
            path = f"{self.outcomes_path}/batch={batch_id}"
            outcomes.write.options(**COMPACT).mode("overwrite").parquet(path)
            outcomes = self.tables.spark.read.schema(outcomes.schema).parquet(path)
            tallies = self._counted(outcomes)
        if self.log_path and step.log is not None:
            write_log(step.log(self.at, outcomes), f"{self.log_path}/{self.name}-{batch_id}")
        self.tables.commit(step.changes, self.name, batch_id, tallies)

    def _counted(self, outcomes: DataFrame) -> dict[str, int]:
        so_far = self.tables.tallies()
        here = outcomes.agg(F.count("*").alias(_JUDGED), F.count_if(F.col("code") == OK).alias(_ACCEPTED)).first()
        return {what + self.name: so_far.get(what + self.name, 0) + here[what] for what in (_JUDGED, _ACCEPTED)}

    def start(self, requests: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return (
            requests.writeStream.foreachBatch(self.apply).queryName(self.name)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
        )
