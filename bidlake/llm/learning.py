"""Training on a bounded sample: FTRL-proximal in shards, states averaged between rounds.

Each round, every shard of the sample starts from the shared state, goes over its own rows once and sends
its state back; the mean is the next shared state. The driver holds two arrays of the model's fixed size
and never a row of the sample. A row's shard, the order of the rows in a shard and the order in which
states are added follow from the rows alone, so that reruns on any number of cores give the same model.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

SHARDS = 6


@dataclass(frozen=True)
class Ftrl:
    """Follow-the-regularised-leader with elastic-net penalties: weights are sparse through ``l1``."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.001

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        pull = np.maximum(np.abs(z) - self.l1, 0.0)
        return -np.sign(z) * pull / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def step(self, z: np.ndarray, n: np.ndarray, at, gradient: np.ndarray, weights: np.ndarray) -> None:
        """Take in the gradient of the rows ``at``, in place."""
        square = gradient * gradient
        sigma = (np.sqrt(n[at] + square) - np.sqrt(n[at])) / self.alpha
        z[at] += gradient - sigma * weights
        n[at] += square


State = tuple[np.ndarray, np.ndarray]


def train_in_shards(sample: DataFrame, order: list[str], start: State, local: Callable[[list[dict], State, int], State], rounds: int) -> State:
    """``local(rows, state, round)`` goes over one shard. ``sample``: written, bounded, with a column ``shard``; ``order`` tells its rows apart."""
    spark = sample.sparkSession
    state = start

    def over_shards(shared: Broadcast, turn: int) -> Callable[[pa.Table], pa.Table]:
        def run(shard: pa.Table) -> pa.Table:
            rows = shard.sort_by([(c, "ascending") for c in order]).to_pylist()
            z, n = local(rows, (shared.value[0].copy(), shared.value[1].copy()), turn)
            return pa.table({"shard": pa.array([rows[0]["shard"]], pa.int32()), "z": pa.array([z.tobytes()], pa.binary()), "n": pa.array([n.tobytes()], pa.binary())})

        return run

    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(state)
        made = sorted(sample.groupBy("shard").applyInArrow(over_shards(shared, turn), "shard int, z binary, n binary").collect(), key=lambda r: r["shard"])
        shared.unpersist()
        if not made:
            return start
        shape = start[0].shape
        mean = lambda k: (sum(np.frombuffer(r[k]) for r in made) / len(made)).reshape(shape)
        state = (mean("z"), mean("n"))
    return state
