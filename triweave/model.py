"""Data model: designs, bundles of tables and typed errors."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


class ModelError(ValueError):
    """Input that the model refuses; ``code`` names the rule."""

    def __init__(self, code: str, detail: str = ""):
        self.code = code
        super().__init__(f"{code}: {detail}" if detail else code)


@dataclass(frozen=True)
class Design:
    """Which columns of a table of observations are the factors, the weight (None: 1 a row) and the targets."""

    factors: tuple[str, str, str]
    weight: str | None = "w"
    targets: tuple[str, ...] = ("y",)
    row_id: str | None = "row_id"


@dataclass
class Topology:
    """Weights-free state: level dictionaries, unique tuples, and which tuple each observation is.

    levels (q, l, key as string); tuples (tid, a, b, c); obs_map (row_id, tid)
    """

    design: Design
    levels: DataFrame
    tuples: DataFrame
    observations: DataFrame
    topology_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def obs_map(self) -> DataFrame:
        return self.observations.select(self.design.row_id or "row_id", "tid")


@dataclass
class Frame:
    """One generation of weights over a topology: weights (tid, a, b, c, w)."""

    topology: Topology
    weights: DataFrame
    frame_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def require(self, topology: Topology) -> Frame:
        if topology.topology_id != self.topology.topology_id:
            raise ModelError("topology mismatch")
        return self
