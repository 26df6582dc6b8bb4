"""Filters of a catalog. Unknown labels raise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvergrain.functions.naming import folder, format_label, size_bucket


def text_search(query: str | None) -> Column | None:
    """Case-insensitive substring of name or path; blank means no filter."""
    q = (query or "").strip().lower()
    if not q:
        return None
    return F.contains(F.lower("file_name"), F.lit(q)) | F.contains(F.lower("full_path"), F.lit(q))


def has_format(label: str | None) -> Column | None:
    return None if not label else F.lower(format_label(F.col("full_path"))) == label.lower()


def in_size(label: str | None) -> Column | None:
    if not label:
        return None
    if label not in ("small", "medium", "large", "huge"):
        raise ValueError(f"no size bucket {label!r}")
    return size_bucket(F.col("size_bytes")) == label


def in_review(label: str | None) -> Column | None:
    """Reviewed entries have a status or a rating."""
    if not label:
        return None
    reviewed = (F.col("status") != "None") | (F.col("rating") > 0)
    kinds = {"reviewed": reviewed, "unreviewed": ~reviewed, "keep": F.col("status") == "Keep", "reject": F.col("status") == "Reject"}
    if label not in kinds:
        raise ValueError(f"no review filter {label!r}")
    return kinds[label]


def rated(label: str | None) -> Column | None:
    """'unrated', or the least rating as a number from 1 to 5."""
    if not label:
        return None
    if label == "unrated":
        return F.col("rating") == 0
    if label not in ("1", "2", "3", "4", "5"):
        raise ValueError(f"no rating filter {label!r}")
    return F.col("rating") >= int(label)


def any_active(*labels: str | None) -> bool:
    return any(x and x.strip() for x in labels)


def select_entries(catalog: DataFrame, search: str | None = None, format: str | None = None, size: str | None = None, review: str | None = None, rating: str | None = None) -> DataFrame:
    """All active filters at once; without any, the catalog as it is."""
    active = [c for c in (text_search(search), has_format(format), in_size(size), in_review(review), rated(rating)) if c is not None]
    return catalog.where(reduce(lambda a, b: a & b, active)) if active else catalog


def under(path: Column, root: Column, recursive: bool = True) -> Column:
    """The root itself, a file directly in it, or (recursive) anywhere below; a sibling of a longer name is outside."""
    below = F.startswith(path, F.concat(root, F.lit("/")))
    return (path == root) | (below if recursive else folder(path) == root)


#: Inputs that are looked through in one scan; more of them go by a join on the entries' ancestors.
FEW_ROOTS = 100


def visible(catalog: DataFrame, inputs: DataFrame, recursive: bool = True) -> DataFrame:
    """Entries under any input (column root).

    A few inputs (counted) are one filter of the scan. With many, each of an
    entry's ancestors, which are few, is looked up by equality.
    """
    roots = [r["root"] for r in inputs.select("root").where("root is not null").distinct().limit(FEW_ROOTS + 1).collect()]
    if len(roots) <= FEW_ROOTS:
        return catalog.where(reduce(lambda a, b: a | b, [under(F.col("full_path"), F.lit(r), recursive) for r in sorted(roots)], F.lit(False)))
    parts = F.split("full_path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    wanted = ups if recursive else F.array(F.col("full_path"), folder(F.col("full_path")))
    hits = catalog.select("full_path", F.explode(wanted).alias("root")).join(inputs.select("root").distinct(), "root", "left_semi").select("full_path").distinct()
    return catalog.join(hits, "full_path", "left_semi")


def reload_after_copy(targets: DataFrame, inputs: DataFrame, recursive: bool = True) -> DataFrame:
    """reload: whether any copied target (full_path) lies in the scope of the inputs."""
    return visible(targets, inputs, recursive).agg((F.count(F.lit(1)) > 0).alias("reload"))


def needs_warmup(has_preview: Column, loading: Column, failed: Column) -> Column:
    """Entries without a preview that none is being made for and none has failed for."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return no(has_preview) & no(loading) & no(failed)


def refresh_in_place(inputs: DataFrame) -> DataFrame:
    """in_place: whether no input is a folder."""
    return inputs.agg(F.coalesce(F.bool_and(~F.col("is_folder")), F.lit(True)).alias("in_place"))


def resolve_targets(whole: bool, selected: DataFrame | None, current: str | None, catalog: DataFrame) -> DataFrame:
    """What an operation works on: everything, else the selection (full_path; of any size), else the current entry, else nothing."""
    if whole:
        return catalog
    if selected is not None and selected.limit(1).count():
        return catalog.join(selected.select("full_path").distinct(), "full_path", "left_semi")
    return catalog.where(F.col("full_path") == current) if current else catalog.limit(0)
