"""Rectangle and page-coordinate algebra as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


class Rect:
    """Four columns named ``{prefix}x0`` … ``{prefix}y1``; bounds only, no data."""

    def __init__(self, prefix: str = "", x0=None, y0=None, x1=None, y1=None):
        self.x0 = _c(x0 if x0 is not None else prefix + "x0")
        self.y0 = _c(y0 if y0 is not None else prefix + "y0")
        self.x1 = _c(x1 if x1 is not None else prefix + "x1")
        self.y1 = _c(y1 if y1 is not None else prefix + "y1")

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def cx(self) -> Column:
        return (self.x0 + self.x1) / 2

    @property
    def cy(self) -> Column:
        return (self.y0 + self.y1) / 2


def tolerance(a: Column, b: Column) -> Column:
    return F.lit(64 * EPSILON) * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))


def near(a: Column, b: Column) -> Column:
    """Equal up to 64 machine epsilons of the larger magnitude."""
    return F.abs(a - b) <= tolerance(a, b)


def contains(outer: Rect, inner: Rect) -> Column:
    """Inside or equal, forgiving an epsilon on each edge."""
    return (
        ((inner.x0 >= outer.x0) | near(inner.x0, outer.x0))
        & ((inner.y0 >= outer.y0) | near(inner.y0, outer.y0))
        & ((inner.x1 <= outer.x1) | near(inner.x1, outer.x1))
        & ((inner.y1 <= outer.y1) | near(inner.y1, outer.y1))
    )


def intersects(a: Rect, b: Rect) -> Column:
    """Open intervals: touching edges do not count."""
    return (a.x0 < b.x1) & (a.x1 > b.x0) & (a.y0 < b.y1) & (a.y1 > b.y0)


def overlap_width(a: Rect, b: Rect) -> Column:
    return F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)


def overlap_height(a: Rect, b: Rect) -> Column:
    return F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)


def material_overlap(a: Rect, b: Rect) -> Column:
    """Intersecting by more than a rounding touch on both axes."""
    return (
        intersects(a, b)
        & ~near(F.greatest(a.x0, b.x0), F.least(a.x1, b.x1))
        & ~near(F.greatest(a.y0, b.y0), F.least(a.y1, b.y1))
    )


def area(r: Rect) -> Column:
    return F.greatest(F.lit(0.0), r.width) * F.greatest(F.lit(0.0), r.height)


def intersection_area(a: Rect, b: Rect) -> Column:
    return F.greatest(F.lit(0.0), overlap_width(a, b)) * F.greatest(F.lit(0.0), overlap_height(a, b))


def iou(a: Rect, b: Rect) -> Column:
    both = intersection_area(a, b)
    total = area(a) + area(b) - both
    return F.when(total > 0, both / total).otherwise(F.lit(0.0))


def union(a: Rect, b: Rect) -> list[Column]:
    return [
        F.least(a.x0, b.x0).alias("x0"),
        F.least(a.y0, b.y0).alias("y0"),
        F.greatest(a.x1, b.x1).alias("x1"),
        F.greatest(a.y1, b.y1).alias("y1"),
    ]


def clamp(r: Rect, width: Column, height: Column, smallest: float = 24.0) -> list[Column]:
    """Order the edges, move them into the page and keep at least ``smallest`` each way."""

    def axis(a: Column, b: Column, limit: Column) -> tuple[Column, Column]:
        need = F.least(F.lit(smallest), limit)
        lo = F.greatest(F.lit(0.0), F.least(F.least(a, b), limit))
        hi = F.greatest(F.lit(0.0), F.least(F.greatest(a, b), limit))
        short = hi - lo < need
        hi2 = F.when(short, F.least(limit, lo + need)).otherwise(hi)
        lo2 = F.when(short, F.greatest(F.lit(0.0), hi2 - need)).otherwise(lo)
        return lo2, hi2

    x0, x1 = axis(r.x0, r.x1, width)
    y0, y1 = axis(r.y0, r.y1, height)
    return [x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")]


def rotate(r: Rect, rotation: Column, width: Column, height: Column) -> list[Column]:
    """Unrotated page coordinates to the visible page; ``width`` and ``height`` are unrotated."""

    def pick(r0: Column, r90: Column, r180: Column, r270: Column) -> Column:
        return F.when(rotation == 90, r90).when(rotation == 180, r180).when(rotation == 270, r270).otherwise(r0)

    return [
        pick(r.x0, height - r.y1, width - r.x1, r.y0).alias("x0"),
        pick(r.y0, r.x0, height - r.y1, width - r.x1).alias("y0"),
        pick(r.x1, height - r.y0, width - r.x0, r.y1).alias("x1"),
        pick(r.y1, r.x1, height - r.y0, width - r.x0).alias("y1"),
    ]


def to_visible(
    r: Rect, box_x0: Column, box_y0: Column, box_w: Column, box_h: Column, rotation: Column, user_unit: Column
) -> list[Column]:
    """Crop-box offset, rotation and user unit: stored rectangle to visible points."""
    moved = Rect(x0=r.x0 - box_x0, y0=r.y0 - box_y0, x1=r.x1 - box_x0, y1=r.y1 - box_y0)
    turned = rotate(moved, rotation, box_w, box_h)
    return [(c * user_unit).alias(n) for c, n in zip(turned, ("x0", "y0", "x1", "y1"))]


def from_visible(
    r: Rect, box_x0: Column, box_y0: Column, box_w: Column, box_h: Column, rotation: Column, user_unit: Column
) -> list[Column]:
    """Inverse of :func:`to_visible`."""
    small = Rect(x0=r.x0 / user_unit, y0=r.y0 / user_unit, x1=r.x1 / user_unit, y1=r.y1 / user_unit)
    back = (F.lit(360) - rotation) % 360
    quarter = rotation.isin(90, 270)
    shown_w = F.when(quarter, box_h).otherwise(box_w)
    shown_h = F.when(quarter, box_w).otherwise(box_h)
    turned = rotate(small, back, shown_w, shown_h)
    shift = (box_x0, box_y0, box_x0, box_y0)
    return [(c + s).alias(n) for c, s, n in zip(turned, shift, ("x0", "y0", "x1", "y1"))]


def pt_to_mm(c: Column) -> Column:
    return c * 25.4 / 72


def mm_to_pt(c: Column) -> Column:
    return c * 72 / 25.4


def slot_rect(left: Column, right: Column, page_width: Column, top: Column, height: Column) -> list[Column]:
    """Margins plus top and height give the rectangle of one slot."""
    return [left.alias("x0"), top.alias("y0"), (page_width - right).alias("x1"), (top + height).alias("y1")]


def same_row(label: Rect, value: Rect, loose: Column | bool = False) -> Column:
    """Value text on the label's visual row; a table cell (``loose``) forgives more."""
    loose = loose if isinstance(loose, Column) else F.lit(loose)
    lh, vh = label.height, value.height
    share = F.when(loose, F.lit(0.15)).otherwise(F.lit(0.45))
    drift = F.when(loose, F.lit(1.8)).otherwise(F.lit(1.2))
    return (
        (vh >= lh * 0.35)
        & (vh <= lh * 1.5)
        & (overlap_height(label, value) >= F.least(lh, vh) * share)
        & (F.abs((label.y0 + label.y1) - (value.y0 + value.y1)) <= lh * drift)
    )


def wrapped(a: Rect, b: Rect) -> Column:
    """``b`` continues ``a`` on the next text line of the same cell."""
    h = F.least(a.height, b.height)
    aligned = (F.abs(a.x0 - b.x0) <= h * 0.3) | (F.abs((a.x0 + a.x1) - (b.x0 + b.x1)) <= h * 0.6)
    step = b.y0 - a.y0
    return (
        (h > 0)
        & (F.greatest(a.height, b.height) <= h * 1.5)
        & aligned
        & (step >= h * 0.7)
        & (step <= h * 1.5)
    )


def bands(lo: Column, hi: Column, step: float) -> Column:
    """All bands of height ``step`` an interval touches, for explode-and-equi-join range joins."""
    return F.sequence(F.floor(lo / step), F.floor(F.greatest(lo, hi) / step))


def band(at: Column, step: float) -> Column:
    return F.floor(at / step)
