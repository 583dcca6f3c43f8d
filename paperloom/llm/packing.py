"""Filling containers of fixed capacity with items (problem 8).

Bounded-space online best-fit: every task keeps a fixed number of open bins per container kind in a
bitset keyed by free space.  An item goes into the open bin with the least free space that holds it
(the lowest set bit at or above its size); if none does, a new bin is opened, and if too many are
open the fullest (the lowest set bit) is closed.  Items pass through once, in the order of the scan;
nothing is shuffled, and a task holds no more than ``open_bins`` bins per kind.

Only items larger than the capacity are cut: into full containers and one rest that is placed like
any other item.

Defined results: null sizes count as 0; items of size 0 take a place in some bin without filling it;
capacities that are null or below 1 are no containers; repeated rows are packed as often as they
come; an empty table packs nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

OPEN_BINS = 64
_OUT = "container_kind string, container_id string, {key} {kind}, piece_no int, n_pieces int, tokens long"


class BestFit:
    """The open bins of one container kind."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.free: dict[int, list[int]] = {}  # free space -> bins
        self.bits, self.n_open, self.made = 0, 0, 0

    def _take(self, space: int) -> int:
        bins = self.free[space]
        chosen = bins.pop()
        if not bins:
            del self.free[space]
            self.bits &= ~(1 << space)
        self.n_open -= 1
        return chosen

    def _put(self, chosen: int, space: int) -> None:
        if space == 0:
            return  # full
        if self.n_open >= self.most:
            fullest = (self.bits & -self.bits).bit_length() - 1
            if space <= fullest:
                return  # this bin is the fullest itself and stays closed
            self._take(fullest)
        self.free.setdefault(space, []).append(chosen)
        self.bits |= 1 << space
        self.n_open += 1

    def place(self, size: int) -> int:
        """The bin of an item that is no larger than the capacity."""
        fitting = self.bits >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            chosen = self._take(space)
        else:
            space, chosen = self.capacity, self.made
            self.made += 1
        self._put(chosen, space - size)
        return chosen

    def add(self, size: int) -> list[tuple[int, int]]:
        """(bin, tokens) of each piece of an item."""
        out = []
        if size > self.capacity:
            whole, size = divmod(size, self.capacity)
            out = [(self.made + i, self.capacity) for i in range(whole)]
            self.made += whole
            if size == 0:
                return out
        return [*out, (self.place(size), size)]


def pack(items: DataFrame, key: str, size: str, containers: DataFrame, open_bins: int = OPEN_BINS) -> DataFrame:
    """(container_kind, container_id, key, piece_no, n_pieces, tokens): where every piece of every item goes.

    ``containers`` (container_kind, capacity_tokens) is a small fixed table and is read to the driver.
    """
    kinds = sorted(
        {(r["container_kind"], int(r["capacity_tokens"])) for r in containers.filter("container_kind is not null and capacity_tokens > 0").collect()}
    )
    slim = items.select(items[key].alias("_key"), items[size].cast("long").alias("_size"))
    key_type = slim.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        bins = [(kind, BestFit(capacity, open_bins)) for kind, capacity in kinds]
        for batch in batches:
            sizes = batch["_size"].fillna(0).astype("int64").tolist()
            keys = batch["_key"].tolist()
            for kind, fit in bins:
                rows = []
                for k, n in zip(keys, sizes):
                    pieces = fit.add(n)
                    rows += [(f"{kind}/{part}/{b}", k, i + 1, len(pieces), t) for i, (b, t) in enumerate(pieces)]
                frame = pd.DataFrame(rows, columns=["container_id", key, "piece_no", "n_pieces", "tokens"])
                frame.insert(0, "container_kind", kind)
                yield frame

    return slim.mapInPandas(run, _OUT.format(key=f"`{key}`", kind=key_type))
