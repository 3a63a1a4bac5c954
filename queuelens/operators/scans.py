"""Scans whose next state depends on the last one (rate limits, breakers, ...).

State machines cannot be written as a window. Both forms here cut each key into
slices (see ``slices``), describe every slice as a function of the state in
which it is entered, go through these descriptions in order, and then run all
slices at once from their true entry state. That is two passes over the rows,
whatever the data and whatever the machine remembers.

* ``affine_scan``: the step is ``v = m * v + b``, a slice is one such step.
* ``machine_scan``: the step is a machine of ``machines``.

A task holds the rows of one slice; only the descriptions of a key's slices, one
small value a slice, come together in one task, and pass through it in order.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from queuelens.operators.machines import Machine
from queuelens.operators.slices import SLICE_ROWS, place_of, sliced

Batches = Iterator[pa.RecordBatch]


def _keyed(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_rows: int) -> tuple[DataFrame, bool]:
    """``df`` with ``_slice`` and the key as text, which workers compare; and whether any key is cut."""
    at, cell = place_of(df, order[0])
    rows, cut = sliced(df, keys, at, slice_rows, cell)
    return rows.withColumn("_key", F.to_json("_key")), cut


def _with_fields(df: DataFrame, more: dict[str, str]) -> StructType:
    return StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in more.items())).fields])


def _lined(df: DataFrame, order: Sequence[str], descending: bool = False) -> DataFrame:
    direction = [F.col(c).desc() if descending else F.col(c) for c in order]
    return df.repartition("_key", "_slice").sortWithinPartitions("_key", "_slice", *direction)


def _slices(batches: Batches) -> Iterator[tuple[tuple[str, int], pa.Table]]:
    """The rows of each (key, slice) of a sorted partition, one slice at a time."""
    where, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("_key").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        part = batch.column("_slice").to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            here = (batch.column("_key")[a].as_py(), int(part[a]))
            if here != where and held:
                yield where, pa.Table.from_batches(held)
                held = []
            where = here
            held.append(batch.slice(a, b - a))
    if held:
        yield where, pa.Table.from_batches(held)


def _columns(table: pa.Table, inputs: Sequence[str]) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in inputs]


def _summaries(machine: Machine, inputs: Sequence[str]):
    def run(batches: Batches) -> Batches:
        for (key, part), table in _slices(batches):
            made = pickle.dumps(machine.summarise(_columns(table, inputs)))
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([part], pa.int32()), pa.array([made], pa.binary())], ["_key", "_slice", "_summary"])

    return run


def _entry_states(machine: Machine):
    """The state in which each slice is entered, from the summaries of a key in order."""
    def run(batches: Batches) -> Batches:
        current, state = None, None
        for batch in batches:
            entries = []
            for key, summary in zip(batch.column("_key").to_pylist(), batch.column("_summary").to_pylist()):
                if key != current:
                    current, state = key, machine.fresh
                entries.append(pickle.dumps(state))
                state = machine.follow(pickle.loads(summary), state)
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_slice"), pa.array(entries, pa.binary())], ["_key", "_slice", "_entry"])

    return run


def _outputs(machine: Machine, inputs: Sequence[str], kept: Sequence[str], outputs: Sequence[str]):
    def run(batches: Batches) -> Batches:
        for _, table in _slices(batches):
            made = machine.run(_columns(table, inputs), pickle.loads(table.column("_entry")[0].as_py()))
            out = table.select(kept)
            for name, values in zip(outputs, made, strict=True):
                out = out.append_column(name, pa.array(values))
            yield from out.to_batches()

    return run


def machine_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], machine: Machine, inputs: dict[str, Column],
                 outputs: dict[str, str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Run ``machine`` over each key along ``order`` and add its ``outputs`` (name to SQL type).

    ``inputs`` are the machine's columns; rows where one of them is null are left out. Null keys are a key of their
    own. ``order`` must tell all rows of a key apart.
    """
    named = {f"_in{i}": c for i, c in enumerate(inputs.values())}
    rows, cut = _keyed(df.withColumns(named).dropna(subset=list(named)), keys, order, slice_rows)
    schema = _with_fields(df, outputs)
    if not cut:  # every slice is a whole key
        entered = rows.withColumn("_entry", F.lit(pickle.dumps(machine.fresh)))
    else:
        lean = _lined(rows.select("_key", "_slice", *dict.fromkeys([*order, *named])), order).select("_key", "_slice", *named)
        summaries = lean.mapInArrow(_summaries(machine, list(named)), "_key string, _slice int, _summary binary")
        entries = (summaries.repartition("_key").sortWithinPartitions("_key", "_slice")
                   .mapInArrow(_entry_states(machine), "_key string, _slice int, _entry binary"))
        entered = rows.join(entries, ["_key", "_slice"])
    return _lined(entered, order).mapInArrow(_outputs(machine, list(named), df.columns, list(outputs)), schema)


# --- v = m * v + b --------------------------------------------------------

def _composed(m: np.ndarray, b: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps up to each row composed into one, anew from each row where ``start`` is true: log2(rows) array steps."""
    m, b, done, d = m.copy(), b.copy(), start.copy(), 1
    done[:1] = True
    while d < len(m) and not done.all():
        go = np.flatnonzero(~done[d:]) + d
        back = go - d
        m_back, b_back, stop = m[back], b[back], done[back]
        b[go] += m[go] * b_back
        m[go] *= m_back
        done[go] |= stop
        d *= 2
    return m, b


def _starts(pdf: pd.DataFrame, cols: Sequence[str], before: tuple | None) -> tuple[np.ndarray, tuple]:
    """Rows that begin a group, and the last row's group."""
    new = np.ones(len(pdf), dtype=bool)
    new[1:] = np.logical_or.reduce([pdf[c].to_numpy()[1:] != pdf[c].to_numpy()[:-1] for c in cols])
    new[0] = tuple(pdf[cols].iloc[0]) != before
    return new, tuple(pdf[cols].iloc[-1])


def _steps(pdf: pd.DataFrame, cols: Sequence[str], before: tuple | None, carried: tuple[float, float]):
    """(rows that begin a group, last group, composed m, composed b), going on from the last batch."""
    new, last = _starts(pdf, cols, before)
    m, b = _composed(pdf["_m"].to_numpy(float), pdf["_a"].to_numpy(float), new)
    if not new[0]:
        upto = int(new.argmax()) or len(new)
        b[:upto] += m[:upto] * carried[1]
        m[:upto] *= carried[0]
    return new, last, m, b


GROUP = ["_key", "_slice"]


def _slice_steps(batches):
    """One step (m, b) for each slice."""
    group, carried = None, (1.0, 0.0)
    for pdf in batches:
        if not len(pdf):
            continue
        new, last, m, b = _steps(pdf, GROUP, group, carried)
        ends = np.flatnonzero(new) - 1
        out = pdf[GROUP].iloc[ends[ends >= 0]].assign(_m=m[ends[ends >= 0]], _a=b[ends[ends >= 0]])
        if group is not None and new[0]:
            yield pd.DataFrame([(*group, *carried)], columns=[*GROUP, "_m", "_a"])
        yield out
        group, carried = last, (float(m[-1]), float(b[-1]))
    if group is not None:
        yield pd.DataFrame([(*group, *carried)], columns=[*GROUP, "_m", "_a"])


def _entry_values(batches):
    """The value before each slice from the steps of a key's slices, in scan order."""
    group, carried = None, (1.0, 0.0)
    for pdf in batches:
        if not len(pdf):
            continue
        new, last, m, b = _steps(pdf, ["_key"], group, carried)
        yield pdf[GROUP].assign(_entry=np.where(new, 0.0, np.r_[carried[1], b[:-1]]))
        group, carried = last, (float(m[-1]), float(b[-1]))


def _values(kept: Sequence[str], name: str):
    def run(batches: Batches) -> Batches:
        group, carried = None, (1.0, 0.0)
        for batch in batches:
            if not batch.num_rows:
                continue
            pdf = pa.Table.from_batches([batch]).select([*GROUP, "_m", "_a", "_entry"]).to_pandas()
            _, last, m, b = _steps(pdf, GROUP, group, carried)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(m * pdf["_entry"].to_numpy(float) + b)], [*kept, name])
            group, carried = last, (float(m[-1]), float(b[-1]))

    return run


def affine_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], m, a, name: str, descending: bool = False,
                slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add ``name`` where ``v = m * v_before + a`` along ``order``, v starting at 0.

    With ``descending`` the scan runs from the last row to the first. Values are composed pairwise, so they agree
    with a row by row loop to rounding.
    """
    rows, cut = _keyed(df.withColumns({"_m": m.cast("double"), "_a": a.cast("double")}), keys, order, slice_rows)
    if not cut:
        entered = rows.withColumn("_entry", F.lit(0.0))
    else:
        lean = _lined(rows.select(*dict.fromkeys([*GROUP, *order, "_m", "_a"])), order, descending).select(*GROUP, "_m", "_a")
        steps = lean.mapInPandas(_slice_steps, "_key string, _slice int, _m double, _a double")
        along = F.col("_slice").desc() if descending else F.col("_slice")
        entries = steps.repartition("_key").sortWithinPartitions("_key", along).mapInPandas(_entry_values, "_key string, _slice int, _entry double")
        entered = rows.join(entries, GROUP)
    return _lined(entered, order, descending).mapInArrow(_values(df.columns, name), _with_fields(df, {name: "double"}))
