"""Running sums, positions and neighbours over any number of rows, without one task that holds a group of them.

Rows are dealt out by ranges of (group, order) and sorted there. One pass over each part numbers its rows, adds up and
looks at neighbours, as if every part began anew; it holds a batch and one row. What a part can't know is what its
first group brings along from the parts before it, and the row beyond each of its ends. That is one row a part: these
are carried from part to part and added to the rows by a broadcast of as many rows as there are parts.

One shuffle of the rows, one write. The order has to be total (end it with an id), or ties are numbered as they come.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import fresh, written


class Part:
    """One pass over a sorted part: what the rows so far leave behind."""

    def __init__(self, group: int, sums: list[int], shown: list[int], filled: list[int]) -> None:
        """Places of the columns: the group's hash, amounts to add up, columns of neighbours, columns whose last value is kept."""
        self.group, self.sums, self.shown, self.filled = group, sums, shown, filled
        self.at = -1
        self.seen = self.segment = self.position = 0
        self.total: list = [None] * len(sums)
        self.before: list = [None] * len(shown)
        self.last: list = [None] * len(filled)

    def step(self, t: pa.Table, m: int) -> list[pa.Array]:
        """Columns for the first m rows of t; a row behind them, if there is one, is the next."""
        t = t.combine_chunks()
        column = lambda i: t.column(i).chunk(0)
        g = column(self.group).to_numpy()
        changed = np.empty(len(g), bool)
        changed[0] = self.seen > 0 and g[0] != self.at
        changed[1:] = g[1:] != g[:-1]
        row = np.arange(m)
        start = np.maximum.accumulate(np.where(changed[:m], row, -1))
        on = start < 0  # the group began in an earlier batch
        segment = self.segment + np.cumsum(changed[:m])
        position = np.where(on, self.position + row + 1, row - start + 1)
        out = [pa.array(self.seen + row), pa.array(segment), pa.array(position)]
        for k, i in enumerate(self.sums):
            v = pc.fill_null(column(i).slice(0, m), 0).to_numpy(zero_copy_only=False)
            upto = np.cumsum(v)
            began = np.maximum(start, 0)
            run = np.where(on, upto + (0 if self.total[k] is None else self.total[k]), upto - upto[began] + v[began])
            out.append(pa.array(run, column(i).type))
            self.total[k] = run[-1]
        for k, i in enumerate(self.shown):
            v = column(i)
            first = pa.array([self.before[k]], v.type)
            out.append(pc.if_else(pa.array(changed[:m]), pa.scalar(None, v.type), pa.concat_arrays([first, v.slice(0, m - 1)])))
            after = pa.concat_arrays([v.slice(1, m), pa.nulls(m + 1 - len(v), v.type)])
            ends = np.append(changed[1:], True)[:m]
            out.append(pc.if_else(pa.array(ends), pa.scalar(None, v.type), after))
            self.before[k] = v[m - 1].as_py()
        for k, i in enumerate(self.filled):
            v = column(i).slice(0, m)
            known = np.maximum.accumulate(np.where(v.is_valid().to_numpy(zero_copy_only=False), row, -1))
            known[known < start] = -1
            held = pa.concat_arrays([v, pa.array([self.last[k]], v.type), pa.nulls(1, v.type)])
            out.append(held.take(pa.array(np.where(known >= 0, known, np.where(on, m, m + 1)))))
            self.last[k] = out[-1][m - 1].as_py()
        self.at, self.seen, self.segment, self.position = g[m - 1], self.seen + m, int(segment[-1]), int(position[-1])
        return out


def _passed(batches: Iterator, places: tuple, names: list[str]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId()
    part, held = Part(*places), None

    def said(t: pa.Table, m: int) -> Iterator[pa.RecordBatch]:
        own = part.step(t, m)
        for b in pa.table([*t.slice(0, m).columns, pa.array(np.full(m, number)), *own], names=names).to_batches():
            yield b

    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        if t.num_rows > 1:
            yield from said(t, t.num_rows - 1)
            t = t.slice(t.num_rows - 1)
        held = t if t.num_rows else None
    if held is not None:
        yield from said(held, 1)


def scan(
    rows: DataFrame,
    order: list[Column],
    within: list[str] | None = None,
    position: str | None = None,
    running: dict[str, str] | None = None,
    neighbours: dict[str, tuple[str, str]] | None = None,
    latest: dict[str, str] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """rows with new columns, by the order inside each value of `within` (all rows, if there is none).

    position: name of a number from 1. running: {name: column} sums up to the row, nulls as 0 (long or double).
    neighbours: {column: (name of the value in the row before, name of that in the row after)}, null at the ends.
    latest: {name: column} the last value that isn't null, up to and with the row.
    """
    spark = rows.sparkSession
    within, running, neighbours, latest = within or [], running or {}, neighbours or {}, latest or {}
    own = {c: fresh(f"scan_{c}", rows) for c in ("group", "part", "row", "segment", "position")}
    kind = {f.name: f.dataType for f in rows.schema}
    amount = {n: fresh(f"scan_amount_{n}", rows) for n in running}
    widened = rows.withColumns({amount[n]: _summable(c, kind[c]) for n, c in running.items()}) if running else rows
    hashed = widened.withColumn(own["group"], F.xxhash64(*(within or [F.lit(0)])))
    keys = [*(F.col(c).asc_nulls_first() for c in within), *order]
    sorted_ = hashed.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    place = {c: i for i, c in enumerate(sorted_.columns)}
    places = (place[own["group"]], [place[c] for c in amount.values()], [place[c] for c in neighbours], [place[c] for c in latest.values()])
    made = [(own["part"], T.LongType()), (own["row"], T.LongType()), (own["segment"], T.LongType()), (own["position"], T.LongType())]
    made += [(n, sorted_.schema[amount[n]].dataType) for n in running]
    made += [(n, kind[c]) for c, pair in neighbours.items() for n in pair]
    made += [(n, kind[c]) for n, c in latest.items()]
    schema = T.StructType([*sorted_.schema, *(T.StructField(n, t) for n, t in made)])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    names = schema.names
    local = written(sorted_.mapInArrow(lambda batches: _passed(batches, places, names), schema), "scan")
    carried = _carried(local, own, running, neighbours, latest)
    number, first_segment = F.col(own["part"]), F.col(own["segment"]) == 0
    joined = local.join(F.broadcast(carried), number == F.col("carry_part"), "left")  # one row a part
    out = {}
    if position:
        out[position] = F.col(own["position"]) + F.when(first_segment, F.col("carry_position")).otherwise(0)
    for n, c in running.items():
        out[n] = _scaled(F.col(n) + F.when(first_segment, F.col(f"carry_{n}")).otherwise(0), kind[c])
    for c, (before, after) in neighbours.items():
        out[before] = F.when(F.col(own["row"]) == 0, F.col(f"carry_before_{c}")).otherwise(F.col(before))
        out[after] = F.when(F.col(own["row"]) == F.col("carry_last_row"), F.col(f"carry_after_{c}")).otherwise(F.col(after))
    for n in latest:
        out[n] = F.when(first_segment, F.coalesce(n, f"carry_{n}")).otherwise(F.col(n))
    return joined.select(*rows.columns, *(v.alias(k) for k, v in out.items()))


def _summable(column: str, kind: T.DataType) -> Column:
    """Decimals are added up in units of their last place."""
    if isinstance(kind, T.DecimalType):
        return (F.col(column) * F.lit(Decimal(10) ** kind.scale)).cast("long")
    return F.col(column).cast("long" if kind.typeName() in ("byte", "short", "integer", "long") else "double")


def _scaled(total: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DecimalType):
        return (total.cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-kind.scale))).cast(f"decimal(20,{kind.scale})")
    return total


def _carried(local: DataFrame, own: dict, running: dict, neighbours: dict, latest: dict) -> DataFrame:
    """One row a part: what its first group had before it, and the neighbours of its first and last row."""
    spark = local.sparkSession
    row = F.col(own["row"])
    ends = [own["group"], own["segment"], own["position"], own["row"], *running, *neighbours, *latest]
    ends = local.groupBy(own["part"]).agg(F.min_by(F.struct(*ends), row).alias("first"), F.max_by(F.struct(*ends), row).alias("last"))
    zero = {n: 0.0 if local.schema[n].dataType.typeName() == "double" else 0 for n in running}
    out, position, sums, last = [], 0, zero, dict.fromkeys(latest)
    found = ends.orderBy(own["part"]).collect()  # one row a part
    for i, r in enumerate(found):
        back, ahead = found[i - 1].last if i else None, found[i + 1].first if i + 1 < len(found) else None
        goes_on = back is not None and back[own["group"]] == r.first[own["group"]]
        if goes_on:
            # What the group had when the part before began counts on only if that part held nothing else.
            alone = back[own["segment"]] == 0
            position = back[own["position"]] + (position if alone else 0)
            sums = {n: back[n] + (sums[n] if alone else 0) for n in running}
            last = {n: back[n] if back[n] is not None or not alone else last[n] for n in latest}
        else:
            position, sums, last = 0, zero, dict.fromkeys(latest)
        ends_on = ahead is not None and ahead[own["group"]] == r.last[own["group"]]
        out.append((r[own["part"]], position, r.last[own["row"]], *sums.values(), *((back[c] if goes_on else None, ahead[c] if ends_on else None) for c in neighbours), *last.values()))
    kind = {f.name: f.dataType for f in local.schema}
    fields = [("carry_part", T.LongType()), ("carry_position", T.LongType()), ("carry_last_row", T.LongType()), *((f"carry_{n}", kind[n]) for n in running)]
    flat = [(*r[: 3 + len(running)], *(x for pair in r[3 + len(running) : 3 + len(running) + len(neighbours)] for x in pair), *r[3 + len(running) + len(neighbours) :]) for r in out]
    fields += [(f"carry_{side}_{c}", kind[c]) for c in neighbours for side in ("before", "after")] + [(f"carry_{n}", kind[n]) for n in latest]
    return spark.createDataFrame(flat, T.StructType([T.StructField(n, t) for n, t in fields]))
