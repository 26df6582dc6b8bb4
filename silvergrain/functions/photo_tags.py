"""Readable values of photo tags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_text(value: Column) -> Column:
    """Without NULs, trimmed; blank is null."""
    return F.nullif(F.trim(F.replace(value, F.lit("\0"), F.lit(""))), F.lit(""))


def _number(value: Column, decimals: int) -> Column:
    shown = F.format_string(f"%.{decimals}f", value)
    return F.regexp_replace(F.regexp_replace(shown, r"0+$", ""), r"\.$", "") if decimals else shown


def taken_at(value: Column) -> Column:
    """'yyyy:MM:dd HH:mm:ss' as 'yyyy-MM-dd HH:mm:ss'; anything else as it is."""
    text = clean_text(value)
    return F.coalesce(F.date_format(F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")), "yyyy-MM-dd HH:mm:ss"), text)


def shifted(value: Column, minutes: int) -> Column:
    """A tag's time moved by minutes; unreadable ones stay."""
    at = F.try_to_timestamp(value, F.lit("yyyy:MM:dd HH:mm:ss"))
    return F.coalesce(F.date_format(at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes), F.lit(0)), "yyyy:MM:dd HH:mm:ss"), value)


def exposure(seconds: Column) -> Column:
    """From one second on as such; else as 1/n where n is nearly whole; else with three decimals."""
    n = 1 / seconds
    near = F.abs(n - F.bround(n, 0)) < 0.01
    return F.when(seconds <= 0, F.lit(None)).when(seconds >= 1, F.concat(_number(seconds, 3), F.lit(" s"))).when(near, F.concat(F.lit("1/"), F.bround(n, 0).cast("long"), F.lit(" s"))).otherwise(F.concat(_number(seconds, 3), F.lit(" s")))


def aperture(value: Column) -> Column:
    return F.concat(F.lit("f/"), _number(value, 1))


def camera(make: Column, model: Column) -> Column:
    """The model, with the make before it unless it names it itself."""
    m, k = clean_text(model), clean_text(make)
    return F.when(m.isNull(), k).when(k.isNull(), m).when(F.startswith(F.lower(m), F.lower(k)), m).otherwise(F.concat_ws(" ", k, m))


def orientation(code: Column) -> Column:
    names = ["normal", "mirrored", "rotated 180", "mirrored, rotated 180", "mirrored, rotated 270", "rotated 90", "mirrored, rotated 90", "rotated 270"]
    return F.when(code.between(1, 8), F.element_at(F.array(*[F.lit(n) for n in names]), F.greatest(F.least(code, F.lit(8)), F.lit(1)).cast("int")))


def flash_fired(code: Column) -> Column:
    return code.bitwiseAND(1) == 1


def coordinate(parts: Column, reference: Column) -> Column:
    """Degrees, minutes and seconds with their reference."""
    return F.concat(reference, F.lit(" "), _number(parts[0], 0), F.lit("° "), _number(parts[1], 0), F.lit("′ "), _number(parts[2], 2), F.lit("″"))


def user_comment(value: Column) -> Column:
    """Bytes with an eight-byte code name: UNICODE (big-endian), ASCII, else UTF-8."""
    head, body = F.substring(value, 1, 8), F.substring(value, 9, 1 << 30)
    name = F.decode(head, "ISO-8859-1")
    text = F.when(F.startswith(name, F.lit("UNICODE")), F.decode(body, "UTF-16BE")).when(F.startswith(name, F.lit("ASCII")), F.decode(body, "US-ASCII")).otherwise(F.decode(value, "UTF-8"))
    return clean_text(text)


def joined(values: Column) -> Column:
    return F.array_join(F.filter(values, lambda x: clean_text(x).isNotNull()), ", ")


def iso(value: Column) -> Column:
    return F.when(value > 0, F.concat(F.lit("ISO "), value.cast("long").cast("string")))


def focal_length(millimetres: Column) -> Column:
    return F.when(millimetres > 0, F.concat(_number(millimetres, 1), F.lit(" mm")))


def white_balance(code: Column) -> Column:
    return F.when(code == 0, "automatic").when(code == 1, "manual")


def colour_space(code: Column) -> Column:
    return F.when(code == 1, "sRGB").when(code == 2, "Adobe RGB").when(code == 65535, "uncalibrated")


def first_text(*values: Column) -> Column:
    """The first that says something, cleaned."""
    return F.coalesce(*[clean_text(v) for v in values])


def described(tags: DataFrame) -> DataFrame:
    """A row's tags as shown: the time from the original, digitised or plain date, the text from description or comment.

    Columns that tags lacks count as null.
    """
    kinds = {"original": "string", "digitised": "string", "plain": "string", "description": "string", "comment": "string", "iso": "int", "focal": "double", "balance": "int", "space": "int", "orientation": "int", "orientation_fallback": "int"}
    c = {k: F.col(k) if k in tags.columns else F.lit(None).cast(t) for k, t in kinds.items()}
    shown = {
        "taken": taken_at(first_text(c["original"], c["digitised"], c["plain"])),
        "text": first_text(c["description"], c["comment"]),
        "iso_text": iso(c["iso"]),
        "focal_text": focal_length(c["focal"]),
        "balance_text": white_balance(c["balance"]),
        "space_text": colour_space(c["space"]),
        "orientation_text": orientation(F.coalesce(F.when(c["orientation"] > 0, c["orientation"]), c["orientation_fallback"])),
    }
    return tags.withColumns(shown)
