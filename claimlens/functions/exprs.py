"""Column builders shared by the operators: draws, hash order, money, dates, boxes, sets, rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42
#: Overlaps from which boxes count as the same.
STRICT_IOU, RELAXED_IOU = 0.5, 0.3


def held(df):
    """df with its columns computed here and once; later expressions are not merged into theirs."""
    return df.select(F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def draw(key: str | Column, tag: str, seed: int = SEED) -> Column:
    """A number below 2**32 from a hash of seed, key and tag; the same in every engine with SHA-256."""
    text = F.concat(F.lit(f"{seed}:"), col(key).cast("string"), F.lit(f":{tag}"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def hash_order(key: str | Column, salt: int | str) -> Column:
    """Hex digest that puts rows in a fixed pseudo-random order."""
    return F.sha2(F.concat(F.lit(f"{salt}:"), col(key).cast("string")), 256)


def cents(amount: str | Column) -> Column:
    """Money as whole cents, half up; null for what is no number."""
    return (F.round(F.expr(f"try_cast({amount} as decimal(20,6))") if isinstance(amount, str) else amount.cast("decimal(20,6)"), 2) * 100).cast("bigint")


def money_text(c: str | Column) -> Column:
    """Cents as text with two decimals."""
    return (col(c).cast("decimal(20,0)") / 100).cast("decimal(20,2)").cast("string")


def is_money(text: str) -> Column:
    """Digits, a point and two digits."""
    return F.coalesce(F.col(text).rlike(r"^[0-9]+\.[0-9]{2}$"), F.lit(False))


def iso_date(text: str) -> Column:
    """A date written as yyyy-MM-dd, else null."""
    return F.when(F.col(text).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr(f"try_to_date({text}, 'yyyy-MM-dd')"))


def rate(part: str | Column, whole: str | Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(col(whole) == 0, F.lit(0.0)).otherwise(F.try_divide(col(part).cast("double"), col(whole).cast("double")))


def clip(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def same_set(a: str | Column, b: str | Column) -> Column:
    """Whether two arrays hold the same values; null counts as empty."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(col(a), none), F.coalesce(col(b), none)
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Shared share of two sets; 1 if both are empty, 0 if one is."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(col(a), none), F.coalesce(col(b), none)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.try_divide(F.size(F.array_intersect(a, b)), union).cast("double"))


def scaled_box(x: Column, extent: Column | int) -> Column:
    """A pixel on the scale 0 to 1000, half even."""
    extent = extent if isinstance(extent, Column) else F.lit(extent)
    return F.greatest(F.lit(0), F.least(F.lit(1000), F.bround(x * 1000.0 / extent).cast("int")))


def iou(p: Column, t: Column) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 if the union has no area."""
    v = lambda b, k: F.get(b, F.lit(k)).cast("double")
    span = lambda a, b: F.greatest(F.lit(0.0), b - a)
    inter = span(F.greatest(v(p, 0), v(t, 0)), F.least(v(p, 2), v(t, 2))) * span(F.greatest(v(p, 1), v(t, 1)), F.least(v(p, 3), v(t, 3)))
    area = lambda b: span(v(b, 0), v(b, 2)) * span(v(b, 1), v(b, 3))
    union = area(p) + area(t) - inter
    return F.when(union <= 0, F.lit(0.0)).otherwise(F.try_divide(inter, union))


def centre_inside(p: Column, t: Column) -> Column:
    v = lambda b, k: F.get(b, F.lit(k)).cast("double")
    cx, cy = (v(p, 0) + v(p, 2)) / 2, (v(p, 1) + v(p, 3)) / 2
    return (cx >= v(t, 0)) & (cx <= v(t, 2)) & (cy >= v(t, 1)) & (cy <= v(t, 3))


def strict_match(p: Column, t: Column) -> Column:
    return F.coalesce(iou(p, t) >= STRICT_IOU, F.lit(False))


def relaxed_match(p: Column, t: Column) -> Column:
    return F.coalesce((iou(p, t) >= RELAXED_IOU) | centre_inside(p, t), F.lit(False))


def some_of(*pairs: tuple[Column, Column], kind: str = "string") -> Column:
    """array of the values whose condition holds, in order; of lists of one value, as a filter would be run item by item."""
    none = F.array().cast(f"array<{kind}>")
    return F.flatten(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.array(v)).otherwise(none) for c, v in pairs)))


def reasons(*pairs: tuple[Column, str | Column]) -> Column:
    """array<string> of the names whose condition holds, in order; null names are left out."""
    return some_of(*((c, F.lit(n)) if isinstance(n, str) else (F.coalesce(c, F.lit(False)) & n.isNotNull(), n) for c, n in pairs))


def dpo_loss(margin: str | Column, beta: float) -> Column:
    """-log(sigmoid(beta * margin)), without overflow for large negative margins."""
    x = F.lit(beta) * col(margin)
    return F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def ipo_loss(margin: str | Column, beta: float) -> Column:
    return F.pow(col(margin) - 1 / (2 * beta), 2)
