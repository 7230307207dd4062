"""Ordered work inside groups of any size.

A window over a whole group sorts that group in one task, which fails once one
series or host holds a third of the data. ``scan`` works in two levels instead:
a group is cut into blocks of consecutive positions, windows run inside a
block, and one summary row per block (made by a map-side combined aggregate)
carries what a block needs to know of the blocks around it. No task then sorts
more than ``SPAN`` positions, or more than one row per block of a group.

All outputs a job needs of one order are asked for in one ``scan``: it reads
its input twice, whatever the number of outputs, and shuffles the rows once.

``pos`` is an integer position that never decreases in reading order; rows
sharing a position share a block, and ``ties`` settles them. Group columns and
``pos`` hold no nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seriatim.sources.shared import written

#: Positions per block: what one task sorts at most, ties aside.
SPAN = 1_000_000

BLOCK = "_block"
#: Group and block as one key. Two columns would let Spark leave rows where an
#: earlier shuffle on the group alone has put them, a hot group in one task.
AT = "_group_and_block"
_FIRST = Window.unboundedPreceding


@dataclass(frozen=True)
class _Order:
    """The windows of one order: inside a block, over a group's blocks, over a whole group."""

    group: tuple[str, ...]
    pos: str
    ties: tuple[str, ...]

    def key(self) -> Column:
        return F.struct(self.pos, *self.ties) if self.ties else F.col(self.pos)

    def inside(self, *, descending: bool = False) -> WindowSpec:
        columns = [F.col(c).desc() if descending else F.col(c).asc() for c in (self.pos, *self.ties)]
        return Window.partitionBy(AT).orderBy(*columns)

    def blocks(self, *, descending: bool = False) -> WindowSpec:
        return Window.partitionBy(*self.group).orderBy(F.col(BLOCK).desc() if descending else F.col(BLOCK).asc())

    def blocks_before(self, *, descending: bool = False) -> WindowSpec:
        return self.blocks(descending=descending).rowsBetween(_FIRST, -1)

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.group)


@dataclass(frozen=True)
class _Parts:
    """What one output adds: summary aggregates, windows over them, windows over rows, the result."""

    summary: dict[str, Column] = field(default_factory=dict)
    carried: dict[str, Column] = field(default_factory=dict)
    local: dict[str, Column] = field(default_factory=dict)
    result: Column | None = None


@dataclass(frozen=True)
class Output:
    """One column a ``scan`` adds; ``ties`` replaces the scan's own for this column."""

    parts: Callable[[_Order, str], _Parts]
    ties: tuple[str, ...] | None = None


def place(*, descending: bool = False) -> Output:
    """The row's number in its group, from 1."""

    def parts(order: _Order, n: str) -> _Parts:
        return _Parts(
            {f"{n}_n": F.count(F.lit(1))},
            {f"{n}_before": F.sum(f"{n}_n").over(order.blocks_before(descending=descending))},
            {f"{n}_local": F.row_number().over(order.inside(descending=descending))},
            (F.col(f"{n}_local") + F.coalesce(f"{n}_before", F.lit(0))).cast("bigint"),
        )

    return Output(parts)


def running(value: str) -> Output:
    """The sum of ``value`` up to and including the row."""

    def parts(order: _Order, n: str) -> _Parts:
        return _Parts(
            {f"{n}_sum": F.sum(value)},
            {f"{n}_before": F.sum(f"{n}_sum").over(order.blocks_before())},
            {f"{n}_local": F.sum(value).over(order.inside().rowsBetween(_FIRST, 0))},
            (F.coalesce(f"{n}_local", F.lit(0)) + F.coalesce(f"{n}_before", F.lit(0))).cast("bigint"),
        )

    return Output(parts)


def before(value: str) -> Output:
    """The never-null ``value`` of the row before; null at the start."""

    def parts(order: _Order, n: str) -> _Parts:
        return _Parts(
            {f"{n}_tail": F.max_by(value, order.key())},
            {f"{n}_in": F.lag(f"{n}_tail").over(order.blocks())},
            {f"{n}_local": F.lag(value).over(order.inside())},
            F.coalesce(f"{n}_local", f"{n}_in"),
        )

    return Output(parts)


def after(value: str) -> Output:
    """The never-null ``value`` of the row after; null at the end."""

    def parts(order: _Order, n: str) -> _Parts:
        return _Parts(
            {f"{n}_head": F.min_by(value, order.key())},
            {f"{n}_in": F.lead(f"{n}_head").over(order.blocks())},
            {f"{n}_local": F.lead(value).over(order.inside())},
            F.coalesce(f"{n}_local", f"{n}_in"),
        )

    return Output(parts)


def known_before(value: str, *, inclusive: bool = False, ties: Sequence[str] | None = None) -> Output:
    """The last non-null ``value`` before the row; ``inclusive`` lets a row answer for itself."""
    return _known(value, inclusive=inclusive, ties=ties, descending=False)


def known_after(value: str, *, inclusive: bool = False, ties: Sequence[str] | None = None) -> Output:
    """The first non-null ``value`` after the row."""
    return _known(value, inclusive=inclusive, ties=ties, descending=True)


def _known(value: str, *, inclusive: bool, ties: Sequence[str] | None, descending: bool) -> Output:
    def parts(order: _Order, n: str) -> _Parts:
        key = F.when(F.col(value).isNotNull(), order.key())
        edge = F.min_by(value, key) if descending else F.max_by(value, key)
        # Going back reads in descending order: a frame without an end is worked out anew for every row.
        inside = order.inside(descending=descending).rowsBetween(_FIRST, 0 if inclusive else -1)
        outside = order.blocks_before(descending=descending)
        return _Parts(
            {f"{n}_edge": edge},
            {f"{n}_in": F.last(f"{n}_edge", ignorenulls=True).over(outside)},
            {f"{n}_local": F.last(value, ignorenulls=True).over(inside)},
            F.coalesce(f"{n}_local", f"{n}_in"),
        )

    return Output(parts, None if ties is None else tuple(ties))


def whole(aggregate: Callable[[str], Column], value: str) -> Output:
    """``aggregate`` (a minimum, maximum or sum) of ``value`` over the group."""

    def parts(order: _Order, n: str) -> _Parts:
        return _Parts(
            {f"{n}_part": aggregate(value)},
            {f"{n}_all": aggregate(f"{n}_part").over(order.whole())},
            {},
            F.col(f"{n}_all"),
        )

    return Output(parts)


def size() -> Output:
    """How many rows the group has."""

    def parts(order: _Order, n: str) -> _Parts:
        return _Parts(
            {f"{n}_n": F.count(F.lit(1))}, {f"{n}_all": F.sum(f"{n}_n").over(order.whole())}, {}, F.col(f"{n}_all")
        )

    return Output(parts)


def _keyed(df: DataFrame, group: Sequence[str], pos: str, span: int | None) -> DataFrame:
    """Cut groups into blocks of positions; a table cut by ``range_blocks`` already is."""
    # Whole-number division: a double would merge positions beyond 2^53.
    cut = F.col(BLOCK) if BLOCK in df.columns else F.expr(f"CAST(`{pos}` AS BIGINT) DIV {span or SPAN}")
    return df.withColumn(AT, F.struct(*group, cut.alias(BLOCK))).drop(BLOCK)


def range_blocks(df: DataFrame, group: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Cut groups into blocks by sampled ranges of any order, for orders that are no plain position.

    Needed where a key repeats without bound (a missing order number, a shared
    date) or is no number: rows are range-partitioned on the whole order, which
    ends in a unique column, so blocks come out even. The cut is written once,
    because sampling again could cut elsewhere. ``scan`` uses the blocks as it
    finds them and drops them.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in group], *order)
    return written(ranged.withColumn(BLOCK, F.spark_partition_id().cast("bigint")), "ranges")


def scan(
    df: DataFrame,
    group: Sequence[str],
    pos: str,
    outputs: dict[str, Output],
    *,
    ties: Sequence[str] = (),
    span: int | None = None,
) -> DataFrame:
    """``df`` with a column per output, every input row and column kept."""
    cut = _keyed(df, group, pos, span)
    parts = {}
    for number, (name, output) in enumerate(outputs.items()):
        order = _Order(tuple(group), pos, tuple(ties) if output.ties is None else output.ties)
        parts[name] = output.parts(order, f"_{number}")
    summary = {n: c for p in parts.values() for n, c in p.summary.items()}
    carried = {n: c for p in parts.values() for n, c in p.carried.items()}
    local = {n: c for p in parts.values() for n, c in p.local.items()}
    blocks = cut.groupBy(AT).agg(*[c.alias(n) for n, c in summary.items()]).select("*", f"{AT}.*")
    known = blocks.select(AT, *[c.alias(n) for n, c in carried.items()])
    rows = cut.withColumns(local) if local else cut
    joined = rows.join(known, AT, "left")
    return joined.select(*[c for c in df.columns if c != BLOCK], *[p.result.alias(n) for n, p in parts.items()])


def number_rows(df, group, pos, out, *, ties=(), descending=False, span=None) -> DataFrame:
    """Number rows from 1 inside each group, by ``pos`` then ``ties``."""
    return scan(df, group, pos, {out: place(descending=descending)}, ties=ties, span=span)


def neighbours(df, group, pos, value, before_, after_, *, ties=(), span=None) -> DataFrame:
    """The never-null ``value`` of the rows just before and after, null at either end."""
    return scan(df, group, pos, {before_: before(value), after_: after(value)}, ties=ties, span=span)


def islands(
    df: DataFrame, group: Sequence[str], pos: str, key: str, out: str, *, ties: Sequence[str] = (), span: int | None = None
) -> DataFrame:
    """Number runs of consecutive rows with the same ``key``; a null key is a run of its own.

    Breaks inside a block are found by its own window; the summary of a block
    holds its ends and its breaks, which settles where blocks meet.
    """
    order = _Order(tuple(group), pos, tuple(ties))
    held = F.struct(F.col(key).alias("k"))  # tells a null key from no row

    def breaks(previous: Column, mine: Column) -> Column:
        same = previous.isNotNull() & (previous["k"] == mine)
        return F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)

    rows = _keyed(df, group, pos, span).withColumn("_prev", F.lag(held).over(order.inside()))
    rows = rows.withColumn("_break", F.when(F.col("_prev").isNull(), 0).otherwise(breaks(F.col("_prev"), F.col(key))))
    ends = {"_head": F.min_by(held, order.key()), "_tail": F.max_by(held, order.key())}
    blocks = rows.groupBy(AT).agg(F.sum("_break").alias("_n"), *[c.alias(n) for n, c in ends.items()])
    blocks = blocks.select("*", f"{AT}.*")
    met = blocks.withColumn("_meets", breaks(F.lag("_tail").over(order.blocks()), F.col("_head.k")))
    through = F.sum(F.col("_n") + F.col("_meets")).over(order.blocks().rowsBetween(_FIRST, 0))
    known = met.select(AT, (through - F.col("_n")).alias("_start"))
    counted = rows.withColumn("_inner", F.sum("_break").over(order.inside().rowsBetween(_FIRST, 0)))
    return (
        counted.join(known, AT, "left")
        .withColumn(out, (F.col("_start") + F.col("_inner")).cast("bigint"))
        .drop("_prev", "_break", "_inner", "_start", AT)
    )


def first_of_each(
    df: DataFrame, group: Sequence[str], pos: str, keep: Sequence[str] = (), *, ties: Sequence[str] = ()
) -> DataFrame:
    """One row per group, the earliest by ``pos`` then ``ties``, with the ``keep`` columns.

    A map-side combined aggregate: a group of copies holding a third of all rows
    is cut down to one row per input partition before the shuffle.
    """
    rest = [*ties, *[c for c in keep if c not in (pos, *ties)]]
    if not rest:
        return df.groupBy(*group).agg(F.min(pos).alias(pos))
    return df.groupBy(*group).agg(F.min(F.struct(pos, *rest)).alias("_row")).select(*group, "_row.*")
