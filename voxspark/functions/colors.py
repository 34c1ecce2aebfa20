"""Colours as 0xRRGGBB integer columns; ``channels`` takes them apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxspark import constants as C
from voxspark.functions.geometry import _col
from voxspark.functions.labels import _lookup, classify_label, is_finite, truncated


def rgb(r, g, b) -> Column:
    r, g, b = (_col(v).cast("int") for v in (r, g, b))
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def channels(color) -> list[Column]:
    """Columns r, g and b of a colour."""
    return [F.shiftright(_col(color), shift).bitwiseAND(255).alias(n) for shift, n in ((16, "r"), (8, "g"), (0, "b"))]


def _fixed(color) -> Column:
    r, g, b = color
    return F.lit((r << 16) + (g << 8) + b)


def _byte(level: Column) -> Column:
    return F.floor(level * 255 + 0.5)


def _hue_level(low: float, high: float, hue: Column) -> Column:
    """Channel level of a hue: up over the first sixth of the circle, level to a half, down to two thirds."""
    turn = hue - F.floor(hue)
    gap = high - low
    ramp = F.least(gap * 6 * turn, gap * (F.lit(2 / 3) - turn) * 6, F.lit(gap))
    return low + F.greatest(ramp, F.lit(0.0))


def component_color(label) -> Column:
    """A stable, well spread colour per whole label."""
    saturation, lightness = C.COMPONENT_SATURATION, C.COMPONENT_LIGHTNESS
    high = lightness + saturation - lightness * saturation
    low = 2 * lightness - high
    hue = (F.abs(truncated(label)).cast("double") * C.COMPONENT_HUE_STEP % 360) / 360
    return rgb(*[_byte(_hue_level(low, high, hue + shift)) for shift in (1 / 3, 0.0, -1 / 3)])


def scalar_color(value) -> Column:
    value = _col(value).cast("double")
    strength = F.sqrt(F.abs(value) / C.SCALAR_FAR_THRESHOLD)

    def ramp(target):
        return rgb(*[_byte(F.least(F.greatest(1 - strength + t * strength, F.lit(0.0)), F.lit(1.0))) for t in target])

    far = ~is_finite(value) | (F.abs(value) > C.SCALAR_FAR_THRESHOLD)
    return (
        F.when(far, _fixed((0, 0, 0)))
        .when(value >= 0, ramp(C.SCALAR_POSITIVE_TARGET))
        .otherwise(ramp(C.SCALAR_NEGATIVE_TARGET))
    )


def category_rgb(category) -> Column:
    return _lookup([(key, int(color[1:], 16)) for key, _, color in C.CATEGORIES], _col(category))


def label_color(value, kind) -> Column:
    """Colour of a volume cell by its label value and volume kind."""
    value, kind = _col(value).cast("double"), _col(kind)
    category = classify_label(value, kind)
    shifted = F.when(kind == "finalCclComponents", F.greatest(F.lit(0.0), value - 3)).otherwise(value)
    return (
        F.when(kind == "scalarField", scalar_color(value))
        .when(~is_finite(value), _fixed(C.NEUTRAL_RGB))
        .when((kind == "linfinityDistanceCases") | (category == "components"), component_color(shifted))
        .when(category.isNull(), _fixed(C.NEUTRAL_RGB))
        .otherwise(category_rgb(category))
    )


def _case_color(cases, case) -> Column:
    case = _col(case).cast("int")
    chain = None
    for number, _, color in cases:
        chain = F.when(case == number, _fixed(color)) if chain is None else chain.when(case == number, _fixed(color))
    return chain.otherwise(_fixed(C.UNAVAILABLE_RGB))


def fallback_color(case) -> Column:
    return _case_color(C.FALLBACK_CASES, case)


def rank_color(rank) -> Column:
    return _case_color(C.RANK_CASES, rank)


def edge_color(flags) -> Column:
    flags = _col(flags).cast("int")
    levels = [
        F.when(flags.bitwiseAND(1 << axis) == 0, C.EDGE_ABSENT)
        .when(flags.bitwiseAND(8 << axis) != 0, C.EDGE_POSITIVE)
        .otherwise(C.EDGE_NEGATIVE)
        for axis in range(3)
    ]
    return F.when(flags.bitwiseAND(7) == 0, _fixed(C.NO_EDGE_RGB)).otherwise(rgb(*levels))


def voxel_color(mode, flags="flags", dual=("dx", "dy", "dz"), case="ovoxel_type", rank="qef_rank") -> Column:
    """Colour of a voxel record in one of the five modes; mode is a name or a column."""
    named = isinstance(mode, str) and mode in C.COLOR_MODES
    mode = F.lit(mode) if named else _col(mode)
    return (
        F.when(mode == "fallback", fallback_color(case))
        .when(mode == "rank", rank_color(rank))
        .when(mode == "dual", rgb(*dual))
        .when(mode == "edges", edge_color(flags))
        .otherwise(_fixed(C.OCCUPANCY_RGB))
    )
