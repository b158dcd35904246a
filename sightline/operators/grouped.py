"""Whole groups of rows handed to a task, many groups at a call.

A grouped map starts a call for every group, which costs more than the work on
a small one. Here rows come ordered by their key, and a task takes from each
Arrow batch all groups that are complete.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def changes(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Whether a row's key differs from that of the row before; the first row's does. Nulls are one key."""
    out = np.ones(len(table), bool)
    out[1:] = False
    for k in keys:
        column = table[k].combine_chunks()
        a, b = column.slice(1), column.slice(0, max(len(column) - 1, 0))
        out[1:] |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        out[1:] |= pc.not_equal(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
    return out


class Groups:
    """Takes tables ordered by ``keys`` and returns tables that hold whole groups; at most one group is held back."""

    def __init__(self, keys: Sequence[str]):
        self.keys, self.held = list(keys), []

    def push(self, table: pa.Table) -> Iterator[pa.Table]:
        if not len(table):
            return
        new = changes(table, self.keys)
        if self.held:
            seam = pa.concat_tables([self.held[-1].slice(len(self.held[-1]) - 1), table.slice(0, 1)])
            new[0] = changes(seam, self.keys)[1]
        at = np.flatnonzero(new)
        if not len(at):
            self.held.append(table)
            return
        done = [*self.held, table.slice(0, at[-1])]
        self.held = [table.slice(at[-1])]
        if sum(map(len, done)):
            yield pa.concat_tables(done).combine_chunks()

    def rest(self) -> Iterator[pa.Table]:
        if self.held:
            yield pa.concat_tables(self.held).combine_chunks()
        self.held = []
