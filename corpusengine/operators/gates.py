"""Chains of gates: steps before, tests that block, steps after, and counts of what each gate blocked, all in one pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Gate:
    """A named test: rows for which it is true are blocked, for the reason given. A null test blocks nothing."""

    name: str
    blocks: Column
    reason: Column = field(default_factory=lambda: F.lit(None).cast("string"))


@dataclass
class Chain:
    """Steps over a table. The first gate that blocks a row names it; gates after it aren't asked, and steps after don't see it.

    ``before`` steps see all rows; ``after`` names columns and what they become in rows that pass. ``finish`` sees passed and blocked rows together, with the columns ``gate`` and
    ``reason``, null for those that pass, and so decides what becomes of the blocked ones; without it these go.
    """

    gates: Sequence[Gate]
    before: Sequence[Step] = ()
    after: Sequence[tuple[str, Column]] = ()
    finish: Step | None = None

    def __post_init__(self) -> None:
        names = [g.name for g in self.gates]
        if len(set(names)) < len(names):
            raise ValueError(f"gates of the same name: {names}")

    def run(self, rows: DataFrame, observed: Observation | None = None) -> DataFrame:
        """The rows that the chain lets out. ``observed`` gets ``total``, ``passed`` and each gate's count as soon as an action has run; nothing is read twice."""
        for step in self.before:
            rows = step(rows)
        gate, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
        for g in reversed(self.gates):
            blocked = F.coalesce(g.blocks, F.lit(False))
            gate, reason = F.when(blocked, F.lit(g.name)).otherwise(gate), F.when(blocked, g.reason).otherwise(reason)
        rows = rows.withColumn("gate", gate).withColumn("reason", reason)
        if observed is not None:
            counts = [F.count_if(F.col("gate") == g.name).alias(g.name) for g in self.gates]
            rows = rows.observe(observed, F.count("*").alias("total"), F.count_if(F.col("gate").isNull()).alias("passed"), *counts)
        for name, value in self.after:
            # a step after is a column that blocked rows keep as it was
            old = F.col(name) if name in rows.columns else F.lit(None)
            rows = rows.withColumn(name, F.when(F.col("gate").isNull(), value).otherwise(old))
        return self.finish(rows) if self.finish is not None else rows.where("gate is null").drop("gate", "reason")
