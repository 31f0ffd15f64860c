"""A DataFrame and the roles of its columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import missing
from .sampling import row_key


class FrameError(ValueError):
    """The roles don't fit the data."""


@dataclass(frozen=True)
class Frame:
    """Feature columns (null or NaN is missing), label, and optional other roles.

    ``row`` is a unique id; sampling, folds and ties follow it, never the order in
    which rows happen to be read.
    """

    df: DataFrame
    features: tuple[str, ...]
    label: str = "label"
    row: str = "row_id"
    weight: str | None = None
    margin: str | None = None
    group: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "features", tuple(self.features))
        names = set(self.df.columns)
        if not self.features:
            raise FrameError("there are no features")
        for c in (*self.features, self.label, self.row, self.weight, self.margin, self.group):
            if c is not None and c not in names:
                raise FrameError(f"there is no column {c!r}")

    def selected(self) -> DataFrame:
        """Only the columns with a role, features as doubles with null for missing."""
        others = [c for c in (self.row, self.label, self.weight, self.margin, self.group) if c is not None]
        cols = [F.col(f"`{c}`") for c in dict.fromkeys(others)]
        clean = [F.when(~missing(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")).alias(c) for c in self.features]
        return self.df.select(*cols, *clean)

    def column(self, feature: str) -> DataFrame:
        return self.selected().select(self.row, feature)

    def has_missing(self) -> dict[str, bool]:
        s = self.selected()
        r = s.agg(*[F.coalesce(F.bool_or(F.col(f"`{c}`").isNull()), F.lit(False)).alias(c) for c in self.features]).first()
        return {c: bool(r[c]) for c in self.features}

    def checked(self) -> Frame:
        """Raises if a label is missing or a row id repeats."""
        r = self.df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col(f"`{self.row}`")).alias("d"), F.coalesce(F.bool_or(missing(F.col(f"`{self.label}`").cast("double"))), F.lit(False)).alias("bad")).first()
        if not r["n"]:
            raise FrameError("there are no rows")
        if r["bad"]:
            raise FrameError("a label is missing")
        if r["d"] != r["n"]:
            raise FrameError("row ids repeat")
        return self

    def cells(self) -> int:
        return self.df.count() * len(self.features)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None, np.ndarray | None, np.ndarray]:
        """x, y, weight, margin, group and hashes of the row ids on the driver, in row order."""
        t = self.selected().withColumn("__key", row_key(F.col(f"`{self.row}`"))).orderBy(self.row).toArrow()  # Row objects would take many times the memory
        number = lambda c: t[c].to_numpy().astype(float)  # noqa: E731  null is NaN
        margin = None
        if self.margin is not None:
            listed = pa.types.is_list(t[self.margin].type)
            margin = np.array(t[self.margin].to_pylist(), float).reshape(len(t), -1) if listed else number(self.margin)
        x = np.stack([number(c) for c in self.features], 1)
        return x, number(self.label), None if self.weight is None else number(self.weight), margin, None if self.group is None else t[self.group].to_numpy(), t["__key"].to_numpy()
