"""Ordered state machines over the rows of each key.

``fold`` streams the rows of every key through a small step function.  Rows
arrive sorted, one Arrow batch at a time, and only the state of the current key
is held, so memory does not grow with the size of a key.

A key too large for one task is cut into ordered slices.  A machine that can
describe a slice as a function of the state it starts from (``summarise`` and
``advance``) lets all slices run at once: summarise each slice, chain the
summaries per key, replay each slice from its own entry state.  Any other machine
hands its state from slice to slice in rounds: every round runs all keys in
parallel and no task ever sees more than one slice of a key.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsframe.operators.ordered import SLICE, group_sizes, join_keys, slice_groups
from opsframe.session import rows_per_task, scratch_folder

_ARROW = {
    "string": pa.string(),
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
}


@dataclass(frozen=True)
class Machine:
    """A per-key state machine.

    ``start(row)`` gives the state before the first row of a key and
    ``step(state, row)`` gives ``(state, output tuple)``; ``row`` is a tuple of
    the input columns.  States must survive JSON (lists, numbers, strings).
    """

    start: Callable
    step: Callable
    outputs: Sequence[tuple[str, str]]
    summarise: Callable | None = None  # iterator of rows -> summary
    advance: Callable | None = None  # (state, summary) -> state after the slice


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[column.to_pylist() for column in batch.columns])


def _batch(rows: list[tuple], fields: Sequence[tuple[str, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=_ARROW[t]) for c, (_, t) in zip(columns, fields)],
        names=[n for n, _ in fields],
    )


def _ddl(fields: Sequence[tuple[str, str]]) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in fields)


def _fields(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, str]]:
    names = {"bigint": "long"}
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [(c, names.get(types[c], types[c])) for c in columns]


def _runner(machine: Machine, group: int, entry: int | None = None):
    """Task body: first ``group`` columns are the key, ``entry`` the state column."""

    def run(batches):
        current, state = None, None
        fields = None
        for batch in batches:
            if fields is None:
                fields = [
                    (n, _spark_type(t))
                    for n, t in zip(batch.schema.names, batch.schema.types)
                ]
                if entry is not None:
                    fields = fields[:entry] + fields[entry + 1 :]
                fields += list(machine.outputs)
            out = []
            for row in _rows(batch):
                given = None
                if entry is not None:
                    given, row = row[entry], row[:entry] + row[entry + 1 :]
                if row[:group] != current:
                    current = row[:group]
                    state = machine.start(row) if given is None else json.loads(given)
                state, result = machine.step(state, row)
                out.append(row + tuple(result))
            yield _batch(out, fields)

    return run


def _spark_type(arrow_type: pa.DataType) -> str:
    for name, known in _ARROW.items():
        if arrow_type == known:
            return name
    if pa.types.is_large_string(arrow_type):
        return "string"
    raise TypeError(f"fold columns must be plain scalars, not {arrow_type}")


def fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    machine: Machine,
    sized_by: DataFrame | None = None,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Input columns plus the machine's outputs, one output row per input row.

    ``sized_by``: a cheaper frame with at least as many rows per key, counted in
    place of ``df``; ``sizes``: what ``group_sizes`` has found already.
    """
    rest = [c for c in df.columns if c not in keys]
    df = df.select(*keys, *rest)
    fields = _fields(df, df.columns) + list(machine.outputs)
    largest, total = sizes or group_sizes(df if sized_by is None else sized_by, keys)
    if largest <= rows_per_task(df.sparkSession):
        laid = df.repartition(*keys).sortWithinPartitions(*keys, *order)
        return laid.mapInArrow(_runner(machine, len(keys)), _ddl(fields))
    sliced = slice_groups(df, keys, order, total)
    if machine.summarise is not None:
        return _at_once(sliced, keys, order, machine, fields)
    return _in_rounds(sliced, keys, order, machine, fields)


def _at_once(sliced, keys, order, machine, fields):
    n = len(keys)
    names = [c for c in sliced.columns if c != SLICE]
    key_fields = _fields(sliced, keys)
    cut_fields = [*key_fields, (SLICE, "int")]

    def summaries(batches):
        # A slice may hold many keys, each as one run of consecutive rows.
        def all_rows():
            for batch in batches:
                yield from _rows(batch)

        from itertools import groupby

        out = []
        for (key, part), rows in groupby(
            all_rows(), key=lambda r: (r[:n], r[-1])
        ):
            first = next(rows)
            start = json.dumps(machine.start(first[:-1]))

            def chain(first=first, rows=rows):
                yield first[:-1]
                for row in rows:
                    yield row[:-1]

            out.append((*key, part, start, json.dumps(machine.summarise(chain()))))
            if len(out) >= 4096:
                yield _batch(out, [*cut_fields, ("start", "string"), ("summary", "string")])
                out = []
        yield _batch(out, [*cut_fields, ("start", "string"), ("summary", "string")])

    def entries(batches):
        current, state = None, None
        for batch in batches:
            out = []
            for row in _rows(batch):
                if row[:n] != current:
                    current, state = row[:n], json.loads(row[n + 1])
                out.append((*row[: n + 1], json.dumps(state)))
                state = machine.advance(state, json.loads(row[n + 2]))
            yield _batch(out, [*cut_fields, ("_entry", "string")])

    laid = sliced.select(*names, SLICE)
    per_slice = laid.mapInArrow(
        summaries, _ddl([*cut_fields, ("start", "string"), ("summary", "string")])
    )
    entry = (
        per_slice.repartition(*keys)
        .sortWithinPartitions(*keys, SLICE)
        .mapInArrow(entries, _ddl([*cut_fields, ("_entry", "string")]))
    )
    cut = [*keys, SLICE]
    joined = join_keys(sliced, entry, cut).select(
        *keys, SLICE, *[c for c in names if c not in keys], "_entry"
    )
    return _replay(joined, cut, order, machine, fields)


def _replay(joined, cut, order, machine, fields):
    """Run every (key, slice) from the state in ``_entry`` (null: a fresh key)."""
    n = len(cut) - 1
    columns = [c for c in joined.columns if c != "_entry"]
    bare = [c for c in columns if c != SLICE]

    hidden = Machine(
        start=lambda row: machine.start(row[:n] + row[n + 1 :]),
        step=lambda state, row: machine.step(state, row[:n] + row[n + 1 :]),
        outputs=machine.outputs,
    )
    laid = (
        joined.select(*columns, "_entry")
        .repartition(*cut)
        .sortWithinPartitions(*cut, *order)
    )
    with_slice = _fields(joined, columns) + list(machine.outputs)
    out = laid.mapInArrow(
        _runner(hidden, n + 1, entry=len(columns)), _ddl(with_slice)
    )
    return out.select(*bare, *[name for name, _ in machine.outputs])


def _in_rounds(sliced, keys, order, machine, fields):
    """Round n takes the n-th slice of every key, from the state round n - 1 left.

    Rows are filed by round once, so a round reads only its own; most keys have a
    single slice and are done after the first.
    """
    spark = sliced.sparkSession
    folder = scratch_folder(spark, "fold")
    cut = [*keys, SLICE]
    steps = sliced.select(*cut).distinct()
    steps = steps.withColumn(
        "_round", F.row_number().over(Window.partitionBy(*keys).orderBy(SLICE))
    )
    filed = join_keys(sliced, steps, cut)
    filed.write.partitionBy("_round").parquet(f"{folder}/in")
    stated = Machine(
        start=machine.start,
        step=lambda state, row: _keep_state(machine.step(state, row)),
        outputs=[*machine.outputs, ("_state", "string")],
    )
    names = [c for c in sliced.columns if c != SLICE]
    out_ddl = _ddl([*fields, ("_state", "string")])
    waiting = spark.read.schema(filed.schema).parquet(f"{folder}/in")
    rounds = waiting.agg(F.max("_round")).first()[0]
    carry = None
    for number in range(1, rounds + 1):
        part = waiting.filter(F.col("_round") == number).drop("_round")
        if carry is None:
            part = part.withColumn("_entry", F.lit(None).cast("string"))
        else:
            part = join_keys(part, carry, keys, "left")
        part = part.select(*cut, *[c for c in names if c not in keys], "_entry")
        done = f"{folder}/out/_round={number}"
        _replay(part, cut, order, stated, fields).write.parquet(done)
        carry = (
            spark.read.schema(out_ddl)
            .parquet(done)
            .groupBy(*keys)
            .agg(F.max_by("_state", F.struct(*order)).alias("_entry"))
        )
    whole = spark.read.schema(f"{out_ddl}, _round int").parquet(f"{folder}/out")
    return whole.select(*[n for n, _ in fields])


def _keep_state(stepped):
    state, out = stepped
    return state, (*out, json.dumps(state))
