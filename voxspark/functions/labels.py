"""Label classification, display names and inspector texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxspark import constants as C
from voxspark.functions.geometry import _col


def is_finite(value) -> Column:
    value = _col(value).cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def truncated(value) -> Column:
    """Whole part towards zero as BIGINT; NULL where it is not finite, clamped beyond 64 bits."""
    value = _col(value).cast("double")
    limit = 2**63 - 1
    beyond = F.when(value > 0, F.lit(limit)).otherwise(F.lit(-limit))
    return F.coalesce(value.try_cast("bigint"), F.when(is_finite(value), beyond))


def _lookup(pairs, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in pairs for v in pair]), key)


def classify_label(value, kind) -> Column:
    """Category of a label value for a volume kind; NULL for scalar fields and non-finite values."""
    label, kind = truncated(value), _col(kind)
    tables = {name: _lookup([(F.lit(n).cast("long"), c) for n, c in table.items()], label) for name, table in C.LABEL_CATEGORIES.items()}
    above = F.when(label > max(C.LABEL_CATEGORIES["finalCclComponents"]), "components")
    unknown = F.lit("unknown")
    picked = (
        F.when(kind == "scalarField", F.lit(None).cast("string"))
        .when(kind == "linfinityDistanceCases", "linfCase")
        .when(kind == "boundaryMask", F.when(label == 0, unknown).otherwise("surface"))
        .when(kind == "componentLabels", F.when(label == 0, unknown).otherwise("components"))
        .when(kind == "finalCclComponents", F.coalesce(tables["finalCclComponents"], above))
        .when(kind == "finalCclCases", F.coalesce(tables["finalCclCases"], unknown))
        .when(kind == "surfaceBoundaryClassification", F.coalesce(tables["surfaceBoundaryClassification"], unknown))
        .otherwise(F.coalesce(tables["pipelineLabels"], unknown))
    )
    return F.when(label.isNotNull(), picked)


def category_label(category) -> Column:
    return _lookup([(key, label) for key, label, _ in C.CATEGORIES], _col(category))


def category_color(category) -> Column:
    return _lookup([(key, color) for key, _, color in C.CATEGORIES], _col(category))


def category_order(category) -> Column:
    return _lookup([(key, order) for order, (key, _, _) in enumerate(C.CATEGORIES)], _col(category))


def categories(spark: SparkSession) -> DataFrame:
    """The category dimension: key, label, colour and display order."""
    rows = [(key, label, color, order) for order, (key, label, color) in enumerate(C.CATEGORIES)]
    return spark.createDataFrame(rows, "category string, label string, color string, ord int")


def number_text(value) -> Column:
    """Whole numbers without decimals, others with four."""
    value = _col(value).cast("double")
    whole = is_finite(value) & (value == F.floor(F.when(is_finite(value), value)))
    return F.when(whole, truncated(value).cast("string")).otherwise(F.format_string("%.4f", value))


def short_phrase(text, fallback) -> Column:
    """The part before the first colon, or a shortened text if that part is empty."""
    trimmed = F.regexp_replace(_col(text), r"^\s+|\s+$", "")
    head = F.regexp_replace(F.substring_index(trimmed, ":", 1), r"\s+$", "")
    cut = F.concat(F.regexp_replace(F.substring(trimmed, 1, 25), r"\s+$", ""), F.lit("..."))
    return (
        F.when(trimmed.isNull() | (trimmed == ""), _col(fallback))
        .when(head != "", head)
        .when(F.length(trimmed) <= 28, trimmed)
        .otherwise(cut)
    )


def label_code(value) -> Column:
    """Key of a label value in a manifest: its whole part as text."""
    return truncated(value).cast("string")


def inspector_label(value, kind, text) -> Column:
    """Text an inspector shows for a label value of a volume kind; ``text`` is its manifest text or NULL."""
    value, kind = _col(value), _col(kind)
    number = number_text(value)
    case = F.concat(F.lit("case "), number)
    category = classify_label(value, kind)
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(
            (kind == "finalCclComponents") & (value > 3),
            F.concat(F.lit("component "), number_text(value - 3)),
        )
        .when((kind == "finalCclCases") & category.isNotNull(), F.concat_ws(" ", number, category_label(category)))
        .when(kind == "linfinityDistanceCases", short_phrase(F.coalesce(_col(text), case), case))
        .otherwise(number)
    )


def scalar_side(value) -> Column:
    value = _col(value)
    return (
        F.when(~is_finite(value), "-")
        .when(F.abs(value) > C.SCALAR_FAR_THRESHOLD, "far field")
        .when(value >= 0, "positive / outside")
        .otherwise("negative / inside")
    )


def fallback_description(case) -> Column:
    found = _lookup([(number, label) for number, label, _ in C.FALLBACK_CASES], _col(case).cast("int"))
    return F.coalesce(found, F.lit("unavailable"))


def rank_deficient(rank) -> Column:
    rank = _col(rank)
    return F.when(rank.between(0, C.MAX_ATTRIBUTE_CASE), rank < C.MAX_ATTRIBUTE_CASE)


def rank_description(rank) -> Column:
    deficient = rank_deficient(rank)
    suffix = F.when(deficient, " · rank deficient").otherwise(" · full rank")
    return F.coalesce(F.when(deficient.isNotNull(), F.concat(_col(rank).cast("string"), suffix)), F.lit("Unavailable"))


def edge_description(flags) -> Column:
    """Signed edges such as 'X+, Z−', or 'none'."""
    flags = _col(flags).cast("int")
    parts = []
    for axis, name in enumerate("XYZ"):
        sign = F.when(flags.bitwiseAND(8 << axis) != 0, name + "+").otherwise(name + "−")
        parts.append(F.when(flags.bitwiseAND(1 << axis) != 0, sign))
    return F.when(flags.bitwiseAND(7) == 0, "none").otherwise(F.concat_ws(", ", *parts))


def effective_mode(mode, has_type, has_rank) -> Column:
    """Modes that need an absent attribute fall back to occupancy."""
    mode = _col(mode)
    missing = ((mode == "fallback") & ~_col(has_type)) | ((mode == "rank") & ~_col(has_rank))
    return F.when(missing, "occupancy").otherwise(mode)
