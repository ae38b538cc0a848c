"""Transform chains [P1, P2, P8-P10]: filter, then drop, then mask, sink-wide first and then by table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import compile_filter
from ..functions.masks import drop_keys, mask, mask_map
from ..model import full_name
from ..sources.config import Sink, Transform


@dataclass(frozen=True)
class Compiled:
    keep: Column | None
    drop: tuple[str, ...]
    mask: tuple[tuple[str, str], ...]
    key: bytes

    def rewrite(self, data: Column) -> Column:
        return mask_map(drop_keys(data, list(self.drop)), dict(self.mask), self.key)


def compile_transform(spec: Transform, key: bytes = b"") -> Compiled | None:
    """Fails now for a bad filter, an unknown strategy or a missing key; None if there is nothing to do."""
    if spec.empty:
        return None
    for _, strategy in spec.mask:
        mask(strategy, key)
    return Compiled(compile_filter(spec.filter) if spec.filter else None, spec.drop_columns, spec.mask, key)


def _apply(events: DataFrame, step: Compiled | None, where: Column | None = None) -> DataFrame:
    if step is None:
        return events
    here = F.lit(True) if where is None else where
    if step.keep is not None:
        events = events.where(F.when(here, step.keep).otherwise(F.lit(True)))
    if not (step.drop or step.mask):
        return events
    new = {c: F.when(here, step.rewrite(F.col(c))).otherwise(F.col(c)) for c in ("old_data", "new_data")}
    return events.withColumns(new)


def transform(events: DataFrame, sink: Sink, key: bytes = b"") -> DataFrame:
    """The sink's chain, and after it the chain of the event's table (full name, else bare name)."""
    events = _apply(events, compile_transform(sink.transform, key))
    for name, table in sorted(sink.tables.items(), key=lambda x: ("." in x[0], x[0])):
        step = compile_transform(table.transform, key)
        if step is None:
            continue
        if "." in name:
            here = full_name() == name
        else:  # a full name in the routing wins over the bare one
            longer = [n for n in sink.tables if "." in n and n.split(".", 1)[1] == name]
            here = (F.col("table") == name) & (~full_name().isin(*longer) if longer else F.lit(True))
        events = _apply(events, step, here)
    return events
