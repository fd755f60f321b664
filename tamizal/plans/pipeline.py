"""Pipelines of named DataFrame transforms, and the bounded loop of rounds that answers batches of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamizal.session import Scratch

Transform = Callable[..., DataFrame]


class Capabilities:
    """Transforms by name, so that a plan can be data."""

    def __init__(self) -> None:
        self.known: dict[str, Transform] = {}

    def register(self, name: str, f: Transform | None = None):
        if f is None:
            return lambda g: self.register(name, g)
        self.known[name] = f
        return f

    def run(self, df: DataFrame, plan: list[tuple[str, dict]]) -> DataFrame:
        for name, params in plan:
            df = df.transform(self.known[name], **params)
        return df


def rounds(scratch: Scratch, states: DataFrame, step: Transform, limit: int = 12) -> DataFrame:
    """Applies ``step`` to the open states (column ``done``) until none is open or ``limit`` rounds passed.

    Each round reads only what is still open and is written to the shared folder, so that plans stay short and
    an executor's loss costs a round at most.
    """
    closed, current = [], scratch.keep(states, "round")
    for _ in range(limit):
        closed.append(current.where("done"))
        still = current.where("not done")
        if still.isEmpty():
            break
        current = scratch.keep(step(still), "round")
    else:
        closed.append(current.withColumn("done", F.lit(True)))
    out = closed[0]
    for c in closed[1:]:
        out = out.unionByName(c)
    return out
