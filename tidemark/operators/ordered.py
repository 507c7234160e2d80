"""Passes in a global order that no single task has to make.

Rows are dealt to cells along the order by splitters: a sample of the rows, drawn by their checksums, is sorted, and every
OVER-th of it begins a cell. So cells hold about as many rows as each other, whatever the values: skewed, tied, or with a
value far from all others. Rows of equal value are told apart by the columns that break ties and then by their checksum, which
also splits a value that many rows have; only rows that are the same in every column are left, and their order can't be seen.
A window orders each cell; what came before a cell is a prefix sum over one row for each cell. Cells and places depend on the
rows only, so every evaluation finds the same ones. The splitters, CELLS about, are looked up when a pass is planned, as the
plan of a pass over a pass would else hold the sampling of the first many times. No more rows than the sample would have are
ordered by one window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A pass has CELLS cells about, whose splitters are sent to every task; the sample has OVER rows for each.
CELLS, OVER = 4096, 8


def few(df: DataFrame, cells: int) -> bool:
    """Whether df has no more rows than a sample: one window holds them all, and there is nothing to deal."""
    return df.limit(OVER * cells + 1).count() <= OVER * cells


def _tied(df: DataFrame) -> DataFrame:
    return df.withColumn("_tie", F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)))


def _splitters(rows: DataFrame, keys: list[str], cells: int) -> str:
    """Every OVER-th of a sample of the rows, in order, as JSON. The sample is all rows, or those whose checksum leaves 0 by what thins them to OVER * cells about."""
    one_in = max(1, rows.count() // (OVER * cells))
    place = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keys)))
    drawn = rows.filter(F.pmod(F.xxhash64("_tie", F.lit("sample")), F.lit(one_in)) == 0).agg(F.array_sort(F.collect_set(place)).alias("s"))
    return drawn.select(F.to_json(F.filter("s", lambda _, i: i % OVER == OVER - 1), {"ignoreNullFields": "false"})).first()[0]


def dealt(df: DataFrame, order: str, out: str = "_cell", cells: int = CELLS, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with out, a whole number from 0 that never falls along (order, ties, _tie), and _tie, a checksum of the row. Null comes first, NaN last.

    The sample is drawn at once, by two small jobs."""
    rows = _tied(df)
    keys = [order, *ties, "_tie"]
    names = [f"k{i}" for i in range(len(keys))]
    kinds = ", ".join(f"{n}: {rows.schema[c].dataType.simpleString()}" for n, c in zip(names, keys, strict=True))
    kept = F.from_json(F.lit(_splitters(rows, keys, cells)), f"array<struct<{kinds}>>").alias("_kept")
    splitters = df.sparkSession.range(1).select(kept).select(F.size("_kept").alias("_size"), *(F.col(f"_kept.{n}").alias(f"_kept_{n}") for n in names))

    def reached(i: Column) -> Column:
        """Whether splitter i is at or below the row: the first key that differs tells."""
        so = F.lit(True)
        for key, n in reversed(list(zip(keys, names, strict=True))):
            a, b = F.get(f"_kept_{n}", i), F.col(key)
            so = F.coalesce(a < b, a.isNull() & b.isNotNull()) | (a.eqNullSafe(b) & so)
        return (i < F.col("_size")) & so

    # how many splitters that are: a binary search
    steps = F.array(*(F.lit(1 << i) for i in reversed(range((2 * cells).bit_length()))))
    cell = F.aggregate(steps, F.lit(0), lambda low, step: F.when(reached(low + step - 1), low + step).otherwise(low))
    # never null, and known not to be: a join by out would else search once more below a union to drop nulls, in names that the union's parts don't have
    cell = F.coalesce(cell, F.lit(0))
    return rows.crossJoin(F.broadcast(splitters)).withColumn(out, cell).drop("_size", *(f"_kept_{n}" for n in names))


def _before(sums: DataFrame, name: str, by: list[str]) -> Column:
    """What a column sums up to before a cell."""
    return F.coalesce(F.sum(name).over(Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def running_sum(df: DataFrame, order: list[str], value: Column | str, out: str, cells: int = CELLS, by: list[str] | None = None) -> DataFrame:
    """df with out, the sum of value over all rows up to this one by order, within each value of `by` where it is given. Ties that order leaves are broken by the rows' checksums."""
    by, added = by or [], F.col(value) if isinstance(value, str) else value
    if few(df, cells):
        own = Window.partitionBy(*by).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, 0)
        return _tied(df).select(*df.columns, F.sum(added).over(own).alias(out))
    rows = dealt(df, order[0], "_cell", cells, tuple(order[1:])).withColumn("_value", added)
    sums = rows.groupBy(*by, "_cell").agg(F.sum("_value").alias("_sum"))
    base = sums.select(*by, "_cell", _before(sums, "_sum", by).alias("_base"))  # a row for each cell
    own = Window.partitionBy(*by, "_cell").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_own", F.sum("_value").over(own)).join(F.broadcast(base), [*by, "_cell"]).select(*df.columns, (F.col("_base") + F.col("_own")).alias(out))


def numbered(df: DataFrame, order: str, cells: int = CELLS, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with rn, a row's place from 0 by (order, ties), null first: the same at every run, as what is left tied is ordered by the rows' checksums."""
    return running_sum(df, [order, *ties], F.lit(1).cast("long"), "_rn", cells).withColumn("rn", F.col("_rn") - 1).drop("_rn")


def around(df: DataFrame, order: list[str], value: str, before: str, after: str, cells: int = CELLS, by: list[str] | None = None) -> DataFrame:
    """df with before, the last value that isn't null up to and at each row by order, and after, the first one behind it, within each value of `by`.

    A cell's rows look within the cell; what they don't find there is the nearest value of the cells beside it, one row for each."""
    by = by or []
    if few(df, cells):
        return _looked(_tied(df), by, order, value, before, after).select(*df.columns, before, after)
    rows = dealt(df, order[0], "_cell", cells, tuple(order[1:]))
    held = F.when(F.col(value).isNotNull(), F.struct(*order, "_tie", F.col(value).alias("_held")))
    ends = rows.groupBy(*by, "_cell").agg(F.min(held).alias("_low"), F.max(held).alias("_high"))
    up = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*by).orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    beside = ends.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_cell").alias("_at"), F.last("_high", True).over(up)["_held"].alias("_left"), F.last("_low", True).over(down)["_held"].alias("_right"))
    same = F.col("_cell") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    found = _looked(rows, [*by, "_cell"], order, value, "_before", "_after").join(beside, same)
    return found.select(*df.columns, F.coalesce("_before", "_left").alias(before), F.coalesce("_after", "_right").alias(after))


def around_by_key(df: DataFrame, key: str, order: list[str], value: str, before: str, after: str) -> DataFrame:
    """around() where no key has more rows than one task may order: nothing is looked up first."""
    return _looked(_tied(df), [key], order, value, before, after).select(*df.columns, before, after)


def _looked(rows: DataFrame, by: list[str], order: list[str], value: str, before: str, after: str) -> DataFrame:
    """around() in one window each way; the way back takes the reversed order, as a frame that ends with the partition is scanned anew for each row."""
    up = Window.partitionBy(*by).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by).orderBy(*map(F.desc, order), F.desc("_tie")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("*", F.last(value, True).over(up).alias(before), F.last(value, True).over(down).alias(after))


def gaps(df: DataFrame, order: str, cells: int = CELLS) -> DataFrame:
    """(gap): the distance of each value to the next greater or equal one. The last value of a cell is followed by the first of the next one that isn't empty."""
    values = df.select(F.col(order).alias("_v")).filter(F.col("_v").isNotNull())
    if few(values, cells):
        return values.select((F.lead("_v").over(Window.orderBy("_v")) - F.col("_v")).alias("gap")).filter("gap IS NOT NULL")
    rows = dealt(values, "_v", "_cell", cells)
    after = Window.orderBy("_cell")  # a row for each cell
    ends = rows.groupBy("_cell").agg(F.min("_v").alias("_first")).select("_cell", F.lead("_first").over(after).alias("_next"))
    following = F.lead("_v").over(Window.partitionBy("_cell").orderBy("_v"))
    both = rows.withColumn("_after", following).join(F.broadcast(ends), "_cell")
    return both.select((F.coalesce("_after", "_next") - F.col("_v")).alias("gap")).filter("gap IS NOT NULL")


def quantiles(df: DataFrame, column: str, fractions: list[float], cells: int = CELLS) -> DataFrame:
    """One row (n, quantiles array<double>): the linearly interpolated quantiles of a column's values, null ones aside; null without any.

    Equal values are counted first. Cells tell which of them holds a wanted rank, and only the values of those cells are
    ordered: no task has all values."""
    counted = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    if few(counted, cells):
        found = F.percentile("v", F.array(*(F.lit(float(f)) for f in fractions)), F.col("n"))
        return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), found.alias("quantiles"))
    rows = dealt(counted, "v", "_cell", cells)
    sums = rows.groupBy("_cell").agg(F.sum("n").alias("_sum"))
    base = sums.select("_cell", "_sum", _before(sums, "_sum", []).alias("_base"))
    total = sums.agg(F.sum("_sum").alias("total"))
    places = F.array(*(F.lit(float(f)) for f in fractions))
    ranks = F.flatten(F.transform(places, lambda f: F.array(F.floor(f * (F.col("total") - 1)), F.ceil(f * (F.col("total") - 1)))))
    wanted = total.select("total", F.array_distinct(ranks).alias("ranks"))
    asked = base.crossJoin(F.broadcast(wanted)).withColumn("ranks", F.filter("ranks", lambda r: (r >= F.col("_base")) & (r < F.col("_base") + F.col("_sum")))).filter(F.size("ranks") > 0)
    upto = F.sum("n").over(Window.partitionBy("_cell").orderBy("v"))
    inside = rows.join(F.broadcast(asked), "_cell").withColumn("_end", F.col("_base") + upto)
    held = inside.select("v", F.explode(F.filter("ranks", lambda r: (r >= F.col("_end") - F.col("n")) & (r < F.col("_end")))).alias("rank"))
    found = held.agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))  # two entries for each fraction
    between = lambda f: _between(f * (F.col("total") - 1))
    return wanted.crossJoin(F.broadcast(found)).select(F.coalesce("total", F.lit(0)).alias("n"), F.when(F.col("total") > 0, F.transform(places, between)).alias("quantiles"))


def _between(place: Column) -> Column:
    low, high = F.element_at("at", F.floor(place)), F.element_at("at", F.ceil(place))
    return low + (high - low) * (place - F.floor(place))
