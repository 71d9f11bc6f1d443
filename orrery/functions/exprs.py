"""Column functions: all built-in expressions, none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clamp(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """v within [low, high]; null stays null (greatest and least alone would skip it)."""
    return F.when(v.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), v)))


def ramp(v: Column, a: float, b: float) -> Column:
    """0 at a, 1 at b, linear between."""
    return clamp((v - a) / (b - a))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def gradient_hash(v: Column, bits: int = 63) -> Column:
    """One bit per pair of neighbours, first pair highest: set where the value rises."""
    rises = lambda i: F.when(F.get(v, i + 1) > F.get(v, i), F.lit(1)).otherwise(F.lit(0)).cast("long")
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), lambda acc, i: acc * 2 + rises(i))


def unsigned_to_signed(v: Column) -> Column:
    """A decimal(20,0) holding an unsigned 64-bit number -> the long of the same bits."""
    v = v.cast("decimal(20,0)")
    return F.when(v >= F.lit("9223372036854775808").cast("decimal(20,0)"), v - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(v).cast("long")


def micros(ts: str = "taken") -> Column:
    """Microseconds of a timestamp without zone since 1970."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def kind_of(faces: Column, largest: Column) -> Column:
    """Class of an item by how many subjects it has and the area of the largest."""
    return F.when(F.coalesce(faces, F.lit(0)) == 0, "detail").when(largest < 0.004, "far").when(faces == 1, "portrait").when(faces == 2, "couple").otherwise("group")


def landscape(width: Column, height: Column) -> Column:
    """Whether a frame is wide; square ones and those without a height aren't."""
    return (height > 0) & (width > 1.2 * height)


def is_grey(saturation: Column) -> Column:
    return saturation < 0.06


def last_number(name: Column) -> Column:
    """The last run of digits in a name; null without one."""
    return F.nullif(F.regexp_extract(name, r"(\d+)\D*$", 1), F.lit("")).cast("long")


def overlap_cut(box: list[Column], window: list[Column]) -> Column:
    """Share of a box (x, y, w, h) that lies outside a window, rounded to 3 places; areas count as 1 at least."""
    side = lambda k: F.greatest(F.lit(0.0), F.least(box[k] + box[k + 2], window[k] + window[k + 2]) - F.greatest(box[k], window[k]))
    return F.round(1 - side(0) * side(1) / F.greatest(F.lit(1.0), box[2] * box[3]), 3)


def crop_window(width: Column, height: Column, aspect: Column, cx: Column, cy: Column, head: float = 0.42) -> list[Column]:
    """Largest window of an aspect, the subject at `head` of its height, kept inside the frame: x, y, w, h."""
    w = F.least(width, height * aspect)
    h = F.least(height, width / aspect)
    x = F.greatest(F.lit(0.0), F.least(width - w, cx - w / 2))
    y = F.greatest(F.lit(0.0), F.least(height - h, cy - h * head))
    return [x, y, w, h]


def normalized_name(name: Column) -> Column:
    """Lower-cased base name without its extension."""
    return F.regexp_replace(F.lower(F.trim(F.element_at(F.split(F.regexp_replace(name, r"\\", "/"), "/"), -1))), r"\.[a-z0-9]+$", "")


def auto_slides(vertical: Column, landscape: Column, most: int = 20) -> Column:
    """How many slides so many upright and wide items make; wide ones share, a slide has five at most."""
    n = vertical + landscape
    wanted = F.greatest(F.ceil((vertical * 6 + landscape * 5) / 10), F.ceil(n / 5))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(most), n, wanted))).cast("long")
