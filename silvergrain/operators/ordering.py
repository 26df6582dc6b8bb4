"""Orders, neighbours, first entries and steps through a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from silvergrain.sources.staging import cut


def sort_columns(mode: str) -> list[Column]:
    by_name = [F.lower(F.col("file_name")), F.col("file_name"), F.col("full_path")]
    modes = {"name": by_name, "modified": [F.col("modified_at").desc(), *by_name], "size": [F.col("size_bytes").desc(), *by_name]}
    if mode not in modes:
        raise ValueError(f"no sort mode {mode!r}")
    return modes[mode]


def sorted_entries(catalog: DataFrame, mode: str) -> DataFrame:
    """A distributed range sort; ranks, where wanted, come from ranked()."""
    return catalog.orderBy(*sort_columns(mode))


def ranked(catalog: DataFrame, mode: str, partition: str, to: str = "rank") -> DataFrame:
    """Ranks from 1 in the order of mode within each value of partition."""
    return numbered(catalog, [partition], sort_columns(mode), to, 1)


def _stretched(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Rows with their place __at in the order of group and order, and the task __task that holds their stretch of it."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(g) for g in group], *order]
    placed = cut(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), "placed")
    return placed.withColumn("__task", F.shiftright("__at", 33))


def _with_earlier(placed: DataFrame, group: list[str], own: Column) -> DataFrame:
    """Add __least, the first place of the row's stretch, and __earlier, own summed over the group's stretches before it."""
    stretches = placed.groupBy(*group, "__task").agg(own.alias("__n"), F.min("__at").alias("__least"))
    # a group has one stretch in each task at most
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stretches.select(*[F.col(g).alias(f"__g{k}") for k, g in enumerate(group)], F.col("__task").alias("__t"), "__least", before.alias("__earlier"))
    same = F.col("__task") == F.col("__t")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{k}"))
    return placed.join(starts, same)


def numbered(rows: DataFrame, group: list[str], order: list[Column], to: str, first: int = 0) -> DataFrame:
    """Gapless numbers of each group's rows in order, from first, with no group in one task.

    A range sort gives each task a stretch of the whole order; a row's number
    is its place in its task's stretch of the group, after the sizes of the
    group's earlier stretches. Rows alike in order may swap numbers.
    """
    placed = _with_earlier(_stretched(rows, group, order), group, F.count(F.lit(1)))
    number = (F.col("__at") - F.col("__least") + F.col("__earlier") + first).cast("long")
    return placed.withColumn("__number", number).select(*[c for c in rows.columns if c != to], F.col("__number").alias(to))


def running_sums(rows: DataFrame, group: list[str], order: list[Column], value: str, to: str) -> DataFrame:
    """value summed over each group's rows in order up to the row itself, with no group in one task.

    Sums run inside the stretches of a range sort, after the sums of the
    group's earlier stretches. order has to tell the rows of a group apart.
    """
    placed = _with_earlier(_stretched(rows, group, order), group, F.coalesce(F.sum(value), F.lit(0)))
    stretch = Window.partitionBy(*group, "__task").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("__sum", F.coalesce(F.sum(value).over(stretch), F.lit(0)) + F.col("__earlier")).select(*[c for c in rows.columns if c != to], F.col("__sum").alias(to))


def with_next(rows: DataFrame, group: list[str], order: list[Column], value: str, to: str) -> DataFrame:
    """Add value of the row that follows in each group's order, null for the last, with no group in one task.

    Inside a stretch of a range sort the next row is there; the last row of a
    stretch takes the first of the group's next stretch.
    """
    placed = _stretched(rows, group, order)
    heads = placed.groupBy(*group, "__task").agg(F.min_by(value, "__at").alias("__head"))
    # a group has one stretch in each task at most
    then = F.lead("__head").over(Window.partitionBy(*group).orderBy("__task"))
    ends = heads.select(*[F.col(g).alias(f"__g{k}") for k, g in enumerate(group)], F.col("__task").alias("__t"), then.alias("__then"))
    same = F.col("__task") == F.col("__t")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{k}"))
    own = Window.partitionBy(*group, "__task").orderBy("__at")
    following = placed.withColumns({"__next": F.lead(value).over(own), "__inner": F.lead("__at").over(own).isNotNull()})
    return following.join(ends, same).withColumn("__out", F.when(F.col("__inner"), F.col("__next")).otherwise(F.col("__then"))).select(*[c for c in rows.columns if c != to], F.col("__out").alias(to))


def indexed(catalog: DataFrame, mode: str, to: str = "index") -> DataFrame:
    """The input index: a gapless number from 0 over the whole catalog in the order of mode."""
    return numbered(catalog, [], sort_columns(mode), to)


def advanced(index: Column, count: Column, loop: bool) -> Column:
    """The next index of a show; at the end the first again (loop) or null, which stops it."""
    return F.when(index + 1 < count, index + 1).when(F.lit(loop) & (count > 0), F.lit(0))


def neighbours(indexed: DataFrame, selected: int, most: int, centre: bool = True, where: Column | None = None) -> DataFrame:
    """Rows by distance of index from the selected one, the next before the previous, with place from 1.

    An invalid selection (negative) gives the first rows.
    """
    rows = indexed if where is None else indexed.where(where)
    if selected < 0:
        order = [F.col("index")]
    else:
        if not centre:
            rows = rows.where(F.col("index") != selected)
        order = [F.abs(F.col("index") - selected), F.col("index") < selected]
    near = rows.orderBy(*order).limit(most)
    return near.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # at most most rows


def top_recent(sessions: DataFrame, most: int = 8) -> DataFrame:
    return sessions.orderBy(F.desc("pinned"), F.desc("opened_at"), "label").limit(most)


def register_session(sessions: DataFrame, new: DataFrame, most: int = 8) -> DataFrame:
    """The new session replaces one of the same inputs, whose pin it keeps; then the first most stay."""
    pins = sessions.select("inputs", F.col("pinned").alias("__was"))
    added = new.join(pins, "inputs", "left").withColumn("pinned", F.coalesce("__was", "pinned")).select(*sessions.columns)
    return top_recent(sessions.join(new.select("inputs"), "inputs", "left_anti").select(*sessions.columns).unionByName(added), most)


def stepped(index: Column, delta: int, count: Column) -> Column:
    return F.pmod(index + delta, count)


def shuffled(catalog: DataFrame, current: str, seed: int) -> DataFrame:
    """All but the current entry in an order that depends on the seed alone."""
    return catalog.where(F.col("full_path") != current).orderBy(F.xxhash64(F.lit(seed), "full_path"), "full_path")


def latest(rows: DataFrame, key: str, by: str, *tie: str) -> DataFrame:
    """The newest row of each key."""
    order = F.struct(by, *tie, *[c for c in rows.columns if c not in (key, by, *tie)])
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("__r")).select("__r.*")


def last_successful(results: DataFrame, key: str, index: str, output: str = "output") -> DataFrame:
    """Of each key the output of largest index among the results without an error; keys that only failed have none."""
    return results.where(F.col("error").isNull()).groupBy(key).agg(F.max(index).alias(index), F.max_by(output, index).alias(output))


def contact_sheet(catalog: DataFrame, mode: str, most: int = 180) -> DataFrame:
    """The first entries in the order of mode, with place from 1."""
    first = sorted_entries(catalog, mode).limit(most)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*sort_columns(mode))))  # most rows


def added_to_compare(held: DataFrame, new: DataFrame, most: int = 4, key: str = "full_path") -> DataFrame:
    """The entries compared once new ones are added: those held already stay, and if all together are more than most, none is added."""
    more = new.join(held.select(key), key, "left_anti").dropDuplicates([key])
    room = held.limit(most + 1).count() + more.limit(most + 1).count() <= most
    return held.unionByName(more.select(*held.columns)) if room else held


def first_of(rows: DataFrame, key: str, index: str) -> DataFrame:
    """The row of each key that comes first."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), index).alias("__r")).select("__r.*")


def batches(indexed: DataFrame, size: int = 160, early: tuple[int, ...] = (24, 48), early_until: int = 200) -> DataFrame:
    """Batch of each index (from 0) of a progressive load: small batches first, then equal ones.

    The early batches hold early[0] and then early[1] rows while at most
    early_until are out; smaller sizes are kept.
    """
    steps, out = [], 0
    while out < early_until:
        n = min(size, early[min(len(steps), len(early) - 1)])
        if out + n > early_until:
            break
        steps.append((out, out + n))
        out += n
    number = F.floor((F.col("index") - out) / size) + len(steps)
    for k, (lo, hi) in reversed(list(enumerate(steps))):
        number = F.when((F.col("index") >= lo) & (F.col("index") < hi), F.lit(k)).otherwise(number)
    return indexed.withColumn("batch", number.cast("int"))
