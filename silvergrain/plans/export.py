"""What an export, rename or transfer is going to do, as columns and tables. Nothing here touches a file."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvergrain.functions.naming import base_name, extension, folder, sequence_name
from silvergrain.operators.ordering import numbered, running_sums
from silvergrain.sources.staging import cut

# Formats by extension, and the extension that a format is written with.
FORMATS = {"jpg": "Jpeg", "jpeg": "Jpeg", "png": "Png", "webp": "WebP", "avif": "Avif", "tif": "Tiff", "tiff": "Tiff", "bmp": "Bmp", "jxl": "Jxl", "heic": "Heic", "heif": "Heic"}
WRITTEN = {"Jpeg": ".jpg", "Png": ".png", "WebP": ".webp", "Avif": ".avif", "Tiff": ".tif", "Bmp": ".bmp", "Jxl": ".jxl", "Heic": ".heic"}
WITH_QUALITY = ("Jpeg", "WebP", "Avif", "Jxl", "Heic")
STRIPPABLE = ("Jpeg", "Png")
PHASES = ("Passthrough", "Transcode", "Compression", "Watermark")
# Fixed value: the long edge below which a picture isn't made smaller for a target size.
LEAST_EDGE = 640


@dataclass(frozen=True)
class ExportRequest:
    format: str = "Original"
    fallback: str = "Original"
    long_edge: int = 0
    target_bytes: int = 0
    strip_metadata: bool = False
    keep_encoded: bool = False
    watermark: bool = False


def _mapped(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def source_format(path: Column) -> Column:
    """Null for types that can't be written."""
    return _mapped(FORMATS, F.lower(F.substring(extension(path), 2, 100)))


def plan_export(catalog: DataFrame, request: ExportRequest) -> DataFrame:
    """Add output_format, target_extension, mode and phase to each entry; entries that can't be written have a null mode."""
    path, size, source = F.col("full_path"), F.col("size_bytes"), source_format(F.col("full_path"))
    own = request.format == "Original"
    plain = not (request.strip_metadata or request.keep_encoded or request.watermark or request.long_edge > 0 or request.target_bytes > 0) and own
    fallback = F.lit(None if request.fallback == "Original" else request.fallback)
    output = F.lit("Original") if plain else F.coalesce(source, fallback) if own else F.lit(request.format)
    kept = F.lower(extension(path))
    written = _mapped(WRITTEN, output)
    target = kept if plain else F.when(source.isNotNull(), kept).otherwise(written) if own else written
    fits = (size > 0) & (size <= request.target_bytes) & F.lit(request.target_bytes > 0 and not (request.strip_metadata or request.watermark or request.long_edge > 0))
    # a request to keep the encoded data names its format by now, so its source has to be of it
    same = F.lit(True) if own and not request.keep_encoded else F.coalesce(source == output, F.lit(False))
    strip = F.lit(own and request.strip_metadata and request.keep_encoded and not (request.watermark or request.long_edge > 0 or request.target_bytes > 0)) & (source == output) & output.isin(*STRIPPABLE)
    mode = (
        F.lit("CopySource")
        if plain
        else F.when(output.isNull(), F.lit(None))
        .when(F.coalesce(strip, F.lit(False)), "StripMetadata")
        .when(fits & same, "TargetSizeCopy")
        .when(output.isin(*WITH_QUALITY) & F.lit(request.target_bytes > 0), "TargetSizeReencode")
        .otherwise("Reencode")
    )
    out = catalog.withColumns({"output_format": output, "target_extension": target, "mode": mode})
    phase = F.when(F.col("mode").isin("CopySource", "StripMetadata", "TargetSizeCopy"), "Passthrough").when(F.col("mode") == "TargetSizeReencode", "Compression").when(F.col("mode").isNull(), F.lit(None)).otherwise("Watermark" if request.watermark else "Compression" if request.target_bytes > 0 else "Transcode")
    return out.withColumn("phase", phase)


def phases(planned: DataFrame) -> DataFrame:
    """(phase_order, phase, operations, bytes) of the phases that have any, cheap ones first."""
    order = F.array_position(F.array(*[F.lit(p) for p in PHASES]), F.col("phase"))
    return planned.where("phase is not null").groupBy("phase").agg(F.count(F.lit(1)).alias("operations"), F.sum("size_bytes").alias("bytes")).withColumn("phase_order", order.cast("int"))


def first_long_edge(edge: Column, size: Column, target: Column) -> Column:
    """Long edge to try first for a target size."""
    ratio = target / size
    scaled = F.floor(edge * F.greatest(F.least(F.pow(ratio, 0.35) * 1.08, F.lit(0.94)), F.lit(0.45))).cast("int")
    small = (edge <= LEAST_EDGE) | (size <= 0) | (target <= 0) | (target >= size)
    return F.when(small, F.greatest(edge, F.lit(LEAST_EDGE))).when((ratio >= 0.72) | (scaled >= edge), edge).otherwise(F.greatest(scaled, F.lit(LEAST_EDGE)))


def next_long_edge(edge: Column, size: Column, target: Column) -> Column:
    """Long edge of the next try: by the square root of the missing ratio, a step of 8 to 30 percent."""
    step = F.greatest(F.least(F.sqrt(target / size) * 0.97, F.lit(0.92)), F.lit(0.70))
    return F.when((edge <= LEAST_EDGE) | (size <= 0) | (target <= 0), edge).otherwise(F.greatest(F.least(F.floor(edge * step).cast("int"), edge - 1), F.lit(LEAST_EDGE)))


def best_quality(probes: DataFrame, target: Column, least: int = 1, most: int = 100) -> DataFrame:
    """(key, quality, within) from probed sizes (key, quality, bytes): the highest quality that keeps the target, else the least.

    Every quality's size is a row here, so no search is needed.
    """
    inside = probes.where(F.col("quality").between(least, most))
    return inside.groupBy("key").agg(F.coalesce(F.max(F.when(F.col("bytes") <= target, F.col("quality"))), F.lit(least)).alias("quality"), F.coalesce(F.bool_or(F.col("bytes") <= target), F.lit(False)).alias("within"))


# Fixed value: probes between the largest and the least quality, at most.
INNER_PROBES = 5


def search_quality(items: DataFrame, probe: Callable[[DataFrame], DataFrame], least: int, most: int) -> DataFrame:
    """(key, quality, within, probed) of items (key, target): the quality to encode each with, by few probes.

    probe: rows (key, quality) -> (key, quality, bytes), called once a round for
    all items that are still searched. The largest quality is probed first, then the
    least; if only the least keeps the target, qualities between are estimated
    from the sizes on both sides, INNER_PROBES times at most, until one meets
    the target exactly or none lies between. probed lists an item's qualities in order; an item whose probe gives no
    size ends there with within null.
    """
    least = max(1, min(100, least))
    most = max(least, min(100, most))
    lit = lambda v, kind="int": F.lit(v).cast(kind)
    state = cut(items.select("key", F.col("target").cast("long").alias("target"), lit(most).alias("next"), lit(least).alias("lo"), lit(most).alias("hi"), lit(None, "long").alias("lo_bytes"), lit(None, "long").alias("hi_bytes"), lit(least).alias("quality"), lit(None, "boolean").alias("within"), F.array().cast("array<int>").alias("probed")), "search")
    for turn in range(INNER_PROBES + 2):
        open_ = state.where("next is not null")
        if open_.limit(1).count() == 0:
            break
        sizes = cut(probe(open_.select("key", F.col("next").alias("quality"))).select("key", F.col("bytes").cast("long").alias("bytes")), "probed")
        n, size, target = F.col("next"), F.col("bytes"), F.col("target")
        fits = size <= target
        asked = state.join(sizes, "key", "left").withColumn("probed", F.when(n.isNotNull() & size.isNotNull(), F.concat("probed", F.array(n))).otherwise(F.col("probed")))
        lost = n.isNotNull() & size.isNull()
        if turn == 0:
            more = ~fits & F.lit(least < most)
            changed = {"hi_bytes": size, "quality": F.when(fits, lit(most)).otherwise(lit(least)), "within": F.when(fits, True).when(~more, False), "next": F.when(more, lit(least))}
        elif turn == 1:
            changed = {"lo_bytes": F.coalesce(F.when(n.isNotNull(), size), "lo_bytes"), "within": F.when(n.isNotNull(), fits).otherwise(F.col("within")), "next": F.when(fits & F.lit(most - least > 1), lit(0))}
        else:
            better = n.isNotNull() & fits
            worse = n.isNotNull() & ~fits
            changed = {"lo": F.when(better, n).otherwise(F.col("lo")), "lo_bytes": F.when(better, size).otherwise(F.col("lo_bytes")), "hi": F.when(worse, n).otherwise(F.col("hi")), "hi_bytes": F.when(worse, size).otherwise(F.col("hi_bytes")), "quality": F.when(better, n).otherwise(F.col("quality")), "next": F.when(n.isNotNull() & (size != target), lit(0))}
        after = asked.withColumns({k: F.when(lost, F.lit(None) if k in ("within", "next") else F.col(k)).otherwise(v) for k, v in changed.items()}).drop("bytes")
        if turn >= 1:
            span, held = F.col("hi") - F.col("lo"), F.greatest(F.least(target, "hi_bytes"), "lo_bytes") - F.col("lo_bytes")
            guess = F.col("lo") + F.when(F.col("hi_bytes") <= F.col("lo_bytes"), F.floor(span / 2)).otherwise(F.round(span * (held / F.nullif(F.col("hi_bytes") - F.col("lo_bytes"), F.lit(0)))))
            inner = F.greatest(F.least(guess, F.col("hi") - 1), F.col("lo") + 1).cast("int")
            after = after.withColumn("next", F.when(F.col("next").isNotNull() & (span > 1), inner))
        state = cut(after, "search")
    return state.select("key", "quality", "within", "probed")


def available_targets(sources: DataFrame, taken: DataFrame, destination: str, label: str, order: str = "rank") -> DataFrame:
    """target_path of each source in a folder: its name, or the name with _label01 and so on where taken.

    The result is that of trying one candidate after another for one source after
    another, by order and path: a candidate is taken if it is among taken, is a
    source's own path (sources exist) or was given to an earlier source. Sources of
    one name count over the free numbers, which lie between the sorted taken
    ones; no row holds a name's numbers. A source that is itself called like
    another name's numbered candidate competes for it: whoever comes first has
    it, which is settled in rounds, as many as such cases depend on each other.
    """
    path = F.col("full_path")
    numbering = "^(.*)_" + re.escape(label) + "([0-9]{2,})((?:[.][^./]*)?)$"

    def candidate(c: Column) -> tuple[Column, Column]:
        """The name that c is a numbered candidate of, and its number; null where it is none."""
        n = F.regexp_extract(c, numbering, 2).try_cast("long")
        return F.regexp_replace(c, numbering, "$1$3"), F.when((n > 0) & (F.format_string("%02d", n) == F.regexp_extract(c, numbering, 2)), n)

    wanted = sources.withColumns({"__base": base_name(path), "__ext": extension(path)}).withColumn("__first", F.concat(F.lit(destination + "/"), "__base", "__ext"))
    turned = cut(numbered(wanted, ["__first"], [F.col(order), path], "__turn", 1), "turned")
    there = cut(taken.select(F.col("path").alias("__path")).unionByName(sources.select(path.alias("__path"))).distinct(), "there")
    parent, number = candidate(F.col("__path"))
    fixed = cut(there.select(parent.alias("__first"), number.alias("__n")).where("__n is not null"), "numbers")
    free = turned.where("__turn = 1").select("__first", F.struct(F.col(order), path).alias("__when")).join(there, F.col("__first") == F.col("__path"), "left_anti")
    parent, number = candidate(F.col("__first"))
    rivals = free.select(F.col("__first").alias("__child"), "__when", parent.alias("__first"), number.alias("__n")).where("__n is not null")
    rivals = cut(rivals.join(turned.select("__first").distinct(), "__first", "left_semi"), "rivals")
    won, any_rivals = rivals, rivals.limit(1).count() > 0
    while True:
        lost = rivals.join(won.select("__child"), "__child", "left_anti").select(F.col("__child").alias("__first"))
        own = free.select("__first").join(lost, "__first", "left_anti").withColumn("__own", F.lit(1))
        # how many numbers a source has to go through; 0 is the name itself
        counted = turned.join(own, "__first", "left").withColumn("__k", F.col("__turn") - F.coalesce("__own", F.lit(0))).drop("__own", "__turn")
        busy = fixed.unionByName(won.select("__first", "__n")).distinct()
        if not any_rivals:
            break
        asked = busy.withColumn("__b", F.lit(1)).join(rivals, ["__first", "__n"], "full").withColumn("__b", F.coalesce("__b", F.lit(0)))
        below = running_sums(asked, ["__first"], [F.col("__n"), F.col("__child")], "__b", "__below").where("__child is not null")
        reached = below.withColumn("__k", F.col("__n") - F.col("__below") + F.col("__b")).join(counted.select("__first", "__k", F.struct(F.col(order), path).alias("__theirs")), ["__first", "__k"], "left")
        now = cut(reached.where("__theirs is null or __when < __theirs").select("__child", "__when", "__first", "__n"), "won")
        same = now.join(won, "__child", "left_anti").limit(1).count() + won.join(now, "__child", "left_anti").limit(1).count() == 0
        won = now
        if same:
            break
    # the i-th taken number n leaves n - i free ones before it: a source's number is its count and the taken ones with fewer free ones before
    gaps = running_sums(busy.withColumn("__one", F.lit(1)), ["__first"], [F.col("__n")], "__one", "__i").select("__first", (F.col("__n") - F.col("__i")).alias("__k"), F.lit(1).alias("__b"))
    both = counted.withColumn("__b", F.lit(0)).unionByName(gaps, allowMissingColumns=True)
    placed = running_sums(both, ["__first"], [F.col("__k"), F.col("__b"), F.col(order), path], "__b", "__more").where("__b = 0")
    named = F.when(F.col("__k") == 0, F.col("__first")).otherwise(F.concat(F.lit(destination + "/"), "__base", F.lit("_" + label), F.format_string("%02d", F.col("__k") + F.col("__more")), "__ext"))
    return placed.withColumn("target_path", named).select(*sources.columns, "target_path")


def rename_plan(sources: DataFrame, existing: DataFrame, base: str, separator: str, start: int, digits: int, total: Column, index: str = "index") -> DataFrame:
    """target_path and problem (null, 'duplicate' or 'exists') of each source; a target that is another source is free (a swap)."""
    name = sequence_name(base.strip(), separator, start, digits, F.col(index), total)
    planned = sources.withColumn("target_path", F.concat(folder(F.col("full_path")), F.lit("/"), name, extension(F.col("full_path"))))
    again = planned.groupBy("target_path").agg(F.count(F.lit(1)).alias("__n"))
    free = existing.select(F.col("path").alias("target_path")).join(sources.select(F.col("full_path").alias("target_path")), "target_path", "left_anti").distinct().withColumn("__there", F.lit(True))
    judged = planned.join(again, "target_path").join(free, "target_path", "left")
    problem = F.when(F.col("__n") > 1, "duplicate").when(F.col("__there"), "exists")
    return judged.withColumn("problem", problem).select(*sources.columns, "target_path", "problem")


def transfer_plan(sources: DataFrame, existing: DataFrame, destination: str) -> DataFrame:
    """A move: entries already there are left out; problem as in rename_plan."""
    target = F.concat(F.lit(destination + "/"), F.regexp_extract("full_path", "([^/]*)$", 1))
    moving = sources.withColumn("target_path", target).where(F.col("full_path") != F.col("target_path"))
    again = moving.groupBy("target_path").agg(F.count(F.lit(1)).alias("__n"))
    there = existing.select(F.col("path").alias("target_path")).distinct().withColumn("__there", F.lit(True))
    judged = moving.join(again, "target_path").join(there, "target_path", "left")
    return judged.withColumn("problem", F.when(F.col("__n") > 1, "duplicate").when(F.col("__there"), "exists")).select(*sources.columns, "target_path", "problem")


def memory_pressure(available: Column, threshold: Column, load: Column, heap: Column, working: Column) -> Column:
    """Low, Moderate, High or Critical by the largest of three ratios."""
    ratio = lambda a, b: F.when((a <= 0) | (b <= 0), F.lit(0.0)).otherwise(a / b)
    limit = F.when(threshold > 0, threshold).otherwise(F.floor(available * 0.85))
    most = F.greatest(ratio(load, limit), ratio(heap, available), ratio(working, available))
    return F.when(most >= 0.92, "Critical").when(most >= 0.80, "High").when(most >= 0.65, "Moderate").otherwise("Low")
