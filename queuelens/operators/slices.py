"""Ordered computations that never put one whole key into one task.

A plain ``Window.partitionBy(key)`` moves every row of a key to one task. When
one key may hold a third of all rows that does not scale, so the helpers here
cut each key's line into slices and partition by ``(key, slice)``.

Cuts come from counts. The rows of each key are counted per cell (a minute, or
one step of a numeric order), the counts are summed along the key, and a new
slice begins wherever another ``slice_rows`` rows have gone by. So a burst is
cut as finely as it needs and a quiet key stays whole. Only keys with more rows
than that have cuts; their sorted lists pass the driver and go to every task (at
most ``2 * MOST_CUTS`` numbers, whatever the table), and each row finds its slice
by a binary search in its key's list. Where no key is that large every key is one
slice, and the plan is the plain window.

* ``sweep_frame`` looks back a fixed time: each row enters a frame at one instant
  and leaves it at another, and a running sum over these events answers all rows.
* ``row_frame`` looks at neighbouring rows: the last or first rows of each slice
  are handed to the slices that need them.
* ``prefix_frame`` accumulates from the start of the key: slices are summed, the
  slice totals are accumulated, and each row adds its slice's offset.

Null keys are a key of their own. Rows without a place in the order come first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queuelens.operators.scalars import beside

MINUTE = 60_000_000
#: Rows of a slice, unless that gave more than MOST_CUTS slices.
SLICE_ROWS = 500_000
MOST_CUTS = 1 << 14


def limit_early(df: DataFrame, n: int) -> None:
    """Let Spark limit groups to ``n`` rows before the shuffle.

    ``row_number() <= n`` is only pushed below the exchange up to a threshold;
    without that a window would move whole keys.
    """
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    current = int(df.sparkSession.conf.get(name, "1000"))
    if 0 <= current < n:
        df.sparkSession.conf.set(name, str(n))


def micros(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def key_of(keys: Sequence[str]) -> Column:
    """The key as one value that is never null and equals itself where parts are null."""
    return F.struct(*(keys or [F.lit(0)]))


def place_of(df: DataFrame, name: str) -> tuple[Column, int]:
    """A column as a whole number that grows with it, and the size of a cell of it."""
    if df.schema[name].dataType.typeName().startswith("timestamp"):
        return micros(name), MINUTE
    return F.floor(F.col(name)).cast("long"), 1


def passed(cuts: Column, at: Column) -> Column:
    """How many of the sorted ``cuts`` are at or before ``at``; 0 for no list."""
    steps = F.array(*[F.lit(1 << k) for k in range(MOST_CUTS.bit_length(), -1, -1)])
    return F.when(cuts.isNull() | at.isNull(), F.lit(0)).otherwise(F.aggregate(
        steps, F.lit(0), lambda n, step: n + F.when(F.get(cuts, n + step - 1) <= at, step).otherwise(F.lit(0))))


def cut_lists(places: DataFrame, slice_rows: int = SLICE_ROWS, cell: int = MINUTE) -> DataFrame:
    """(_cut_key, _cuts) of (_key, _at): where new slices begin, for keys of more than ``slice_rows`` rows."""
    counted = (places.filter(F.col("_at").isNotNull()).groupBy("_key", F.floor(F.col("_at") / F.lit(cell)).alias("_cell"))
               .agg(F.count(F.lit(1)).alias("_n")))
    room = counted.agg(F.greatest(F.lit(int(slice_rows)), F.ceil(F.sum("_n") / F.lit(MOST_CUTS))).alias("_room"))
    along = Window.partitionBy("_key").orderBy("_cell")
    before = F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = beside(counted.withColumn("_before", before), room).withColumn("_no", F.floor(F.col("_before") / F.col("_room")))
    return (summed.filter(F.col("_no") > 0).groupBy("_key", "_no").agg((F.min("_cell") * F.lit(cell)).alias("_cut"))
            .groupBy("_key").agg(F.sort_array(F.collect_list("_cut")).alias("_cuts")).withColumnRenamed("_key", "_cut_key"))


def known_cuts(places: DataFrame, rows: int, slice_rows: int = SLICE_ROWS, cell: int = MINUTE) -> DataFrame | None:
    """The lists of ``cut_lists``, worked out; None where no key is large. ``rows`` is the number of all places."""
    lists = cut_lists(places, slice_rows, cell) if rows > slice_rows else None
    found = lists.collect() if lists is not None else []
    return F.broadcast(places.sparkSession.createDataFrame(found, lists.schema)) if found else None


def with_slice(rows: DataFrame, cuts: DataFrame | None, at: Column) -> DataFrame:
    if cuts is None:
        return rows.withColumn("_slice", F.lit(0))
    return (rows.join(cuts, F.col("_key") == F.col("_cut_key"), "left")
            .withColumn("_slice", passed(F.col("_cuts"), at)).drop("_cut_key", "_cuts"))


def sliced(df: DataFrame, keys: Sequence[str], at: Column, slice_rows: int = SLICE_ROWS, cell: int = MINUTE) -> tuple[DataFrame, bool]:
    """``df`` with ``_key`` and ``_slice``, which does not decrease with ``at`` within a key; and whether any key is cut."""
    keyed = df.withColumn("_key", key_of(keys))
    cuts = known_cuts(keyed.select("_key", at.alias("_at")), df.count(), slice_rows, cell)
    return with_slice(keyed, cuts, at), cuts is not None


def sweep_frame(df: DataFrame, keys: Sequence[str], ts: str, frames: dict[str, tuple[int, int]],
                values: dict[str, Column], squares: dict[str, Column] | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Counts and sums of whole numbers over trailing time frames, in one sweep.

    ``frames`` maps a name to ``(back_us, upto_us)``: the frame of a row at t is
    ``[t - back_us, t + upto_us]`` with ``upto_us <= 0``; rows of one instant
    share it, as in SQL ``RANGE``. For each frame f and value v the result has
    ``f_v`` (sum, 0 when empty), and ``f_n`` counts rows. For v in ``squares``
    (whole numbers up to 3e9) ``f_v`` is the exact sum of squares. Rows without
    a time are in no frame and get 0.

    A sliding window frame costs rows times frame size, which a dense key turns
    into a square. Here every row enters each frame at one instant and leaves it
    at another, and a running sum over these events answers all rows at the cost
    of a sort. Events are cut into slices by their own counts, and a slice starts
    from the sums of those before it, so a frame may be longer than any slice.
    Values are whole numbers, so that what leaves cancels exactly.
    """
    columns = df.columns
    squares = squares or {}
    counted = {"n": F.lit(1).cast("long"), **{v: c.cast("long") for v, c in values.items()}}
    for v, c in squares.items():  # two halves, so that sums stay in longs
        square = c.cast("long") * c.cast("long")
        counted[f"{v}_hi"] = F.shiftright(square, 32)
        counted[f"{v}_lo"] = square.bitwiseAND(F.lit(0xFFFFFFFF))
    at = micros(ts)
    base = df.select(F.struct(*columns).alias("_row"), key_of(keys).alias("_key"), at.alias("_t"),
                     *[c.alias(f"_v_{v}") for v, c in counted.items()])
    names = [f"{f}_{v}" for f in frames for v in counted]

    def event(when: Column, deltas: dict[str, Column], row: Column | None = None) -> Column:
        parts = [deltas.get(n, F.lit(None)).cast("long").alias(n) for n in names]
        payload = row if row is not None else F.when(F.lit(False), F.col("_row"))
        return F.struct(when.alias("_at"), *parts, payload.alias("_payload"))

    def moves(f: str, back: int, upto: int) -> list[tuple[Column, int]]:
        return [(F.col("_t") - upto, 1), (F.col("_t") + back + 1, -1)]

    events = [event(F.col("_t"), {}, F.col("_row"))]
    for f, (back, upto) in frames.items():
        events += [event(when, {f"{f}_{v}": F.col(f"_v_{v}") * sign for v in counted}) for when, sign in moves(f, back, upto)]
    lined = base.select("_key", F.explode(F.array(*events)).alias("_e")).select("_key", "_e.*")
    # the counts need no values: only when the events are
    when = F.array(F.col("_t"), *[w for f, (back, upto) in frames.items() for w, _ in moves(f, back, upto)])
    cuts = known_cuts(base.select("_key", F.explode(when).alias("_at")), df.count() * (1 + 2 * len(frames)), slice_rows)
    placed = with_slice(lined, cuts, F.col("_at"))
    local = Window.partitionBy("_key", "_slice").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    here = lambda n: F.coalesce(F.sum(n).over(local), F.lit(0))
    if cuts is None:
        summed = placed.select("_payload", "_at", *[here(n).alias(n) for n in names])
    else:
        summed = placed.join(_offsets(placed, names), ["_key", "_slice"]).select(
            "_payload", "_at", *[(here(n) + F.col(f"_o_{n}")).alias(n) for n in names])
    swept = summed.filter(F.col("_payload").isNotNull()).select(
        "_payload", *[F.when(F.col("_at").isNull(), F.lit(0)).otherwise(F.col(n)).alias(n) for n in names])
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    return swept.select(
        "_payload.*", *[f"{f}_{v}" for f in frames for v in ("n", *values)],
        *[(whole(f"{f}_{v}_hi") * F.lit(1 << 32).cast("decimal(10,0)") + whole(f"{f}_{v}_lo")).cast("decimal(38,0)").alias(f"{f}_{v}")
          for f in frames for v in squares])


def _offsets(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """For each slice the sums ``_o_<name>`` over the slices of its key before it."""
    totals = rows.groupBy("_key", "_slice").agg(*[F.sum(n).alias(f"_t_{n}") for n in names])
    earlier = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_key", "_slice", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in names])


def deviation(n: Column, total: Column, squares: Column, sample: bool) -> Column:
    """Standard deviation from exact whole-number sums; null when undefined."""
    wide = lambda c: c.cast("decimal(19,0)")
    spread = (wide(n) * squares.cast("decimal(38,0)") - wide(total) * wide(total)).cast("double")
    n = n.cast("double")
    return F.sqrt(F.greatest(spread, F.lit(0.0)) / F.nullif(n * (n - 1) if sample else n * n, F.lit(0.0)))


def _edge_rows(rows: DataFrame, order: Sequence[str], count: int, late: bool) -> DataFrame:
    """The ``count`` edge rows of each slice, tagged with the slices needing them.

    The per-slice limit runs before the shuffle (window group limit), so only
    edge rows move. A slice with fewer rows than ``count`` passes on what the
    slice beyond it still owes.
    """
    limit_early(rows, count)
    cols = [F.col(c).desc() if late else F.col(c).asc() for c in order]
    edge = (rows.withColumn("_r", F.row_number().over(
        Window.partitionBy("_key", "_slice").orderBy(*cols)))
        .filter(F.col("_r") <= count))
    along = Window.partitionBy("_key").orderBy(F.col("_slice").asc() if late else F.col("_slice").desc())
    sizes = (rows.groupBy("_key", "_slice")
             .agg(F.least(F.count(F.lit(1)), F.lit(count)).cast("int").alias("n"))
             .withColumn("_next", F.collect_list(F.struct("_slice", "n")).over(along.rowsBetween(1, count)))
             .drop("n").filter(F.size("_next") > 0))
    edge = edge.join(sizes, ["_key", "_slice"])
    # _next[i] is reached when the row and the rows of _next[0..i-1] are not enough
    before = lambda i: F.aggregate(F.slice(F.col("_next"), F.lit(1), i), F.lit(0), lambda a, x: a + x["n"])
    reached = F.filter(F.transform(F.col("_next"), lambda x, i: F.struct(
        x["_slice"].alias("s"), (F.col("_r") + before(i)).alias("d"))), lambda x: x["d"] <= count)
    return (edge.withColumn("_to", F.explode(reached))
            .withColumn("_slice", F.col("_to.s")).drop("_next", "_to", "_r")
            .withColumn("_guest", F.lit(True)))


def row_frame(df: DataFrame, keys: Sequence[str], order: Sequence[str], exprs, before: int = 0, after: int = 0,
              slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Window expressions over the ``before`` previous and ``after`` next rows.

    ``exprs`` maps a window spec (ordered, without a frame) to a dict of
    columns; ``lag``, ``lead`` and ``rowsBetween`` frames within the given reach
    are exact. ``order`` must tell all rows of a key apart; slices are cut along
    its first column, a time or a number.
    """
    base, cut = sliced(df, keys, *_cutting(df, order, slice_rows))
    all_rows = base.withColumn("_guest", F.lit(False))
    if cut and before:
        all_rows = all_rows.unionByName(_edge_rows(base, order, before, True))
    if cut and after:
        all_rows = all_rows.unionByName(_edge_rows(base, order, after, False))
    spec = Window.partitionBy("_key", "_slice").orderBy(*order)
    out = all_rows.select("*", *[c.alias(n) for n, c in exprs(spec).items()])
    return out.filter(~F.col("_guest")).drop("_key", "_slice", "_guest")


def _cutting(df: DataFrame, order: Sequence[str], slice_rows: int) -> tuple[Column, int, int]:
    at, cell = place_of(df, order[0])
    return at, slice_rows, cell


def prefix_frame(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column],
                 at: Callable[[], Column] | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Running sums from the first row of the key to this row.

    Slices are cut along the first column of ``order``, or along what ``at`` makes: a whole number that does not
    decrease with it, only asked for where there is something to cut.
    """
    if at is not None and df.count() > slice_rows:
        rows, cut = sliced(df, keys, at(), slice_rows, 1)
    else:
        rows, cut = sliced(df, keys, *_cutting(df, order, slice_rows))
    rows = rows.select("*", *[value.alias(f"_in_{name}") for name, value in sums.items()])
    local = (Window.partitionBy("_key", "_slice").orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    here = lambda n: F.coalesce(F.sum(f"_in_{n}").over(local), F.lit(0))
    if cut:
        joined = rows.join(_offsets(rows, [f"_in_{n}" for n in sums]), ["_key", "_slice"])
        out = joined.select("*", *[(here(n) + F.col(f"_o__in_{n}")).alias(n) for n in sums]).drop(*[f"_o__in_{n}" for n in sums])
    else:
        out = rows.select("*", *[here(n).alias(n) for n in sums])
    return out.drop("_key", "_slice", *[f"_in_{n}" for n in sums])


def global_position(df: DataFrame, order: str, name: str, buckets: int = 4096, tie: str | None = None,
                    within: tuple[int, int] | None = None) -> DataFrame:
    """1-based position of each row by a numeric column, without one task.

    The column (with ``tie``, if given) must tell all rows apart.

    Rows are dealt into equal ranges of the order column; only the range sizes
    are accumulated in one place. ``within`` gives the bounds of evenly spread
    values, which are else looked for.
    """
    if within is None:
        bounded = beside(df, df.agg(F.min(order).alias("_lo"), F.max(order).alias("_hi")))
    else:
        bounded = df.withColumns({"_lo": F.lit(within[0]), "_hi": F.lit(within[1])})
    width = F.col("_hi") - F.col("_lo") + F.lit(1)
    rows = bounded.withColumn(
        "_range", F.floor((F.col(order) - F.col("_lo")) / width * F.lit(buckets)).cast("long")).drop("_lo", "_hi")
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = Window.partitionBy("_range").orderBy(order, *([tie] if tie else []))
    return (rows.join(offsets, "_range")
            .withColumn(name, F.col("_before") + F.row_number().over(local)).drop("_range", "_before"))
