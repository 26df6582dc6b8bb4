"""Names, sizes and labels of catalog entries as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of pictures, lower case.
PICTURE_EXTENSIONS = ("avif", "arw", "bmp", "cr3", "dng", "gif", "heic", "heif", "ico", "jpeg", "jpg", "jxl", "nef", "png", "psd", "svg", "tif", "tiff", "webp")


def extension(path: Column) -> Column:
    """With its dot, as written; empty without one."""
    return F.regexp_extract(path, r"([.][^./]+)$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"[.][^.]*$", "")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def is_picture(path: Column) -> Column:
    return F.lower(F.substring(extension(path), 2, 100)).isin(*PICTURE_EXTENSIONS)


def format_label(path: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(F.substring(extension(path), 2, 100)), F.lit("")), F.lit("unknown"))


def size_bucket(size: Column) -> Column:
    """Half-open buckets split at 2, 8 and 20 MiB."""
    mib = 1024 * 1024
    return F.when(size < 2 * mib, "small").when(size < 8 * mib, "medium").when(size < 20 * mib, "large").otherwise("huge")


def human_size(size: Column) -> Column:
    """1024-based, B to TB, at most two decimals, rounded half up."""
    value = size.cast("double")
    out = None
    for k, name in enumerate(("B", "KB", "MB", "GB", "TB")):
        shown = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value / float(1024**k)), r"0+$", ""), r"\.$", "")
        text = F.concat(shown, F.lit(f" {name}"))
        fits = size < 1024 ** (k + 1)
        out = F.when(fits, text) if out is None else out.when(fits, text) if k < 4 else out.otherwise(text)
    return out


def stars(rating: Column) -> Column:
    return F.concat(F.repeat(F.lit("★"), rating.cast("int")), F.repeat(F.lit("☆"), (5 - rating).cast("int")))


def sequence_name(base: str, separator: str, start: int, digits: int, index: Column, count: Column) -> Column:
    """base, or with several entries base, separator and the running number, widened rather than cut."""
    number = F.lit(start).cast("int") + index.cast("int")  # an overflow raises
    return F.when(count == 1, F.lit(base)).otherwise(F.concat(F.lit(base + separator), F.format_string(f"%0{digits}d", number)))


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r'[\x00-\x1f<>:"/\\|?*]', "_")


def review_text(rating: Column, status: Column) -> Column:
    """Status and stars of a reviewed entry; empty without a review."""
    return F.concat_ws(" ", F.when(status != "None", status), F.when(rating > 0, stars(rating)))


def csv_field(value: Column) -> Column:
    """In quotes, quotes doubled; null is empty."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(value, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def merged_properties(first: Column, second: Column) -> Column:
    """Both maps; of a key in both the second one's value. Null maps are empty."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    a, b = F.coalesce(first, none), F.coalesce(second, none)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
