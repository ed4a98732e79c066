"""Admission of batches and release of checkpoints, as a driver-side gate and as a plan over budgets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Budget:
    """What a table has in flight."""

    in_memory: int = 0
    durable_pending: int = 0
    unresolved: int = 0

    def empty(self) -> bool:
        return not (self.in_memory or self.durable_pending or self.unresolved)


class Coordinator:
    """At most one batch of a table in memory, one awaiting durability, one unresolved; all intake pauses when recovery is full."""

    def __init__(self, recovery_limit: int = 2):
        self.recovery_limit = max(1, recovery_limit)
        self.external_depth = 0
        self.budgets: dict[str, Budget] = {}

    def _of(self, table: str) -> Budget:
        return self.budgets.setdefault(table, Budget())

    def _drop_empty(self, table: str) -> None:
        if table in self.budgets and self.budgets[table].empty():
            del self.budgets[table]

    def recovery_depth(self) -> int:
        return self.external_depth + sum(b.unresolved for b in self.budgets.values())

    def saturated(self) -> bool:
        return self.recovery_depth() >= self.recovery_limit

    def try_admit(self, table: str) -> str | None:
        """None if a batch may be taken in, else the reason; an admitted batch counts as in memory."""
        if self.saturated():
            return "recovery queue saturated"
        b = self.budgets.get(table, Budget())
        if b.in_memory or b.durable_pending or b.unresolved:
            return "table budget exhausted"
        self._of(table).in_memory += 1
        return None

    def checkpoint_decision(self, table: str) -> str | None:
        """None if a checkpoint may be acknowledged; an unresolved commit outranks a batch in flight."""
        b = self.budgets.get(table, Budget())
        if b.unresolved:
            return "unresolved commit"
        if b.in_memory:
            return "batch in flight"
        return None

    def set_external_depth(self, depth: int) -> None:
        self.external_depth = depth

    def record_materialized(self, table: str) -> None:
        b = self._of(table)
        b.in_memory = max(0, b.in_memory - 1)
        b.durable_pending = 1

    def record_unresolved(self, table: str) -> None:
        b = self._of(table)
        b.in_memory, b.durable_pending, b.unresolved = max(0, b.in_memory - 1), 0, 1

    def record_committed(self, table: str) -> None:
        b = self._of(table)
        b.durable_pending = b.unresolved = 0
        self._drop_empty(table)

    def release(self, table: str) -> None:
        b = self._of(table)
        b.in_memory = max(0, b.in_memory - 1)
        self._drop_empty(table)


def decisions(spark: SparkSession, recovery_limit: int = 2) -> DataFrame:
    """Decisions for every budget of zero or one of each kind and external depths up to three."""
    bits = spark.range(32).select(
        (F.col("id") % 2).alias("in_memory"), (F.expr("id div 2") % 2).alias("pending"), (F.expr("id div 4") % 2).alias("unresolved"), F.expr("id div 8").alias("external")
    )
    full = F.col("external") + F.col("unresolved") >= recovery_limit
    admit = F.when(full, "recovery queue saturated").when(F.col("in_memory") + F.col("pending") + F.col("unresolved") > 0, "table budget exhausted").otherwise("admit")
    release = F.when(F.col("unresolved") > 0, "unresolved commit").when(F.col("in_memory") > 0, "batch in flight").otherwise("release")
    return bits.select("*", admit.alias("admission"), release.alias("checkpoint"))


ORACLE = """SELECT in_memory, pending, unresolved, external, CASE WHEN external + unresolved >= 2 THEN 'recovery queue saturated' WHEN in_memory + pending + unresolved > 0 THEN 'table budget exhausted'
  ELSE 'admit' END AS admission, CASE WHEN unresolved > 0 THEN 'unresolved commit' WHEN in_memory > 0 THEN 'batch in flight' ELSE 'release' END AS checkpoint
  FROM (SELECT range % 2 AS in_memory, (range // 2) % 2 AS pending, (range // 4) % 2 AS unresolved, range // 8 AS external FROM range(32))"""
