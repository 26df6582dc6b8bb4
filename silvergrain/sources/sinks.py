"""Writing states, logs and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silvergrain.operators.ordering import numbered


def content_hash(state: DataFrame) -> str:
    """A hash of all rows that doesn't depend on their order."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(state.columns))))
    r = state.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(row).alias("x"), F.sum(row.cast("decimal(38,0)")).alias("s")).first()
    return f"{r['n']}:{r['x']}:{r['s']}"


def write_snapshot(state: DataFrame, path: str, *order: Any, unless: str | None = None) -> str:
    """Overwrite a JSON state, in order; nothing is written if its content hash is unless. Returns the hash."""
    now = content_hash(state)
    if now != unless:
        (state.orderBy(*order) if order else state).write.mode("overwrite").json(path)
    return now


def append_events(events: DataFrame, path: str, at: str = "ts") -> None:
    """JSON lines in a folder per UTC day."""
    events.withColumn("day", F.to_date(at)).write.partitionBy("day").mode("append").json(path)


def retained(files: DataFrame, most: int, name: str = "name", at: str = "modified_at") -> DataFrame:
    """The newest files; the others may go."""
    return files.orderBy(F.desc(at), F.desc(name)).limit(most)


def batch_report(results: DataFrame) -> DataFrame:
    """total, succeeded, failed of rows with an error column (null when fine)."""
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def run_each(items: DataFrame, fn: Callable[[dict], Any], result: T.DataType | str, key: str) -> DataFrame:
    """(key, result, error) of fn on each row; an exception becomes its row's error and stops nothing else."""
    import pandas as pd

    kind = result if isinstance(result, str) else result.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.to_dict("records"):
                try:
                    out.append((row[key], fn(row), None))
                except Exception as e:
                    out.append((row[key], None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "result", "error"])

    return items.mapInPandas(run, f"{key} {items.schema[key].dataType.simpleString()}, result {kind}, error string")


def path_list(entries: DataFrame, rank: str = "rank") -> DataFrame:
    """paths: the distinct paths in order, a line each. For selections, which fit one row."""
    first = entries.groupBy("full_path").agg(F.min(rank).alias("rank"))
    return first.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "full_path"))), lambda s: s["full_path"]), "\n").alias("paths"))


def path_lines(entries: DataFrame, rank: str = "rank") -> DataFrame:
    """(line, full_path): the distinct paths in order, a row each and numbered from 0, for lists of any length."""
    first = entries.groupBy("full_path").agg(F.min(rank).alias("__rank"))
    return numbered(first, [], [F.col("__rank"), F.col("full_path")], "line").select("line", "full_path")


def operation_reports(results: DataFrame, operation: str = "operation") -> DataFrame:
    """(operation, report): one JSON text for each operation with total, succeeded and failed of its results (error null when fine)."""
    per = results.groupBy(operation).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return per.select(operation, F.to_json(F.struct("total", "succeeded", "failed")).alias("report"))


def write_operation_reports(results: DataFrame, folder: str, operation: str = "operation", index: str = "index") -> None:
    """A folder for each operation with its report and, beside it, its failures by index as JSON lines."""
    operation_reports(results, operation).repartition(operation).write.mode("overwrite").partitionBy(operation).text(f"{folder}/reports")
    failed = results.where(F.col("error").isNotNull()).select(operation, index, "error")
    failed.repartition(operation).sortWithinPartitions(operation, index).write.mode("overwrite").partitionBy(operation).json(f"{folder}/failures")


def failures(results: DataFrame, index: str = "index") -> DataFrame:
    """(index, error) of the rows that failed, in order."""
    return results.where(F.col("error").isNotNull()).select(index, "error").orderBy(index)


def shown_of_total(shown: DataFrame, everything: DataFrame) -> DataFrame:
    """shown, total and their text."""
    a, b = shown.agg(F.count(F.lit(1)).alias("shown")), everything.agg(F.count(F.lit(1)).alias("total"))
    return a.crossJoin(b).withColumn("text", F.when(F.col("shown") == F.col("total"), F.col("total").cast("string")).otherwise(F.concat_ws(" / ", F.col("shown").cast("string"), F.col("total").cast("string"))))  # one row each


def scenario_figures(runs: DataFrame) -> DataFrame:
    """Add throughput (items a second) and cpu_percent (0 to 100 of all processors) to runs (items, elapsed_ms, cpu_ms, processors)."""
    elapsed = F.col("elapsed_ms")
    percent = F.when(elapsed > 0, 100.0 * F.col("cpu_ms") / elapsed / F.greatest(F.col("processors"), F.lit(1))).otherwise(F.lit(0.0))
    return runs.withColumns({"throughput": F.when(elapsed > 0, 1000.0 * F.col("items") / elapsed).otherwise(F.lit(0.0)), "cpu_percent": F.greatest(F.least(percent, F.lit(100.0)), F.lit(0.0))})


def write_reports(runs: DataFrame, folder: str) -> None:
    """The runs as CSV, JSON and a Markdown table, each in a folder of its own."""
    runs.write.mode("overwrite").option("header", "true").csv(f"{folder}/csv")
    runs.write.mode("overwrite").json(f"{folder}/json")
    head = ["| " + " | ".join(runs.columns) + " |", "|" + " --- |" * len(runs.columns)]
    lines = runs.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in runs.columns]), F.lit(" |")).alias("value"), F.lit(1).alias("__o"))
    first = runs.sparkSession.createDataFrame([("\n".join(head), 0)], "value string, __o int")
    first.unionByName(lines).coalesce(1).orderBy("__o", "value").select("value").write.mode("overwrite").text(f"{folder}/markdown")  # a row per scenario
