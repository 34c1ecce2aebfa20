"""Text helpers: sizes, ages, paths, safe names and resolution arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxspark.constants import AXES, MAX_INPUT_BYTES
from voxspark.functions.geometry import _col


def bytes_text(size) -> Column:
    """'512 B', '1.3 KB' ... up to GB, one decimal rounded half up; '' for negative or missing sizes."""
    size = _col(size).cast("long")

    def scaled(power: int, unit: str) -> Column:
        whole = 1024**power
        tenths = F.floor(size / whole) * 10 + F.floor(((size % whole) * 10 + whole // 2) / whole)
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" " + unit))

    return (
        F.when(size.isNull() | (size < 0), "")
        .when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024**2, scaled(1, "KB"))
        .when(size < 1024**3, scaled(2, "MB"))
        .otherwise(scaled(3, "GB"))
    )


def age_text(milliseconds) -> Column:
    """Rounded age in minutes, hours or days, at least one of the unit."""
    age = _col(milliseconds)
    minute, hour, day = 60_000, 3_600_000, 86_400_000

    def rounded(unit: int, suffix: str) -> Column:
        count = F.greatest(F.lit(1).cast("long"), F.floor(age / unit + 0.5))
        return F.concat(count.cast("string"), F.lit(suffix))

    return (
        F.when(age.isNull() | (age <= 0), "0m")
        .when(age < hour, rounded(minute, "m"))
        .when(age < day, rounded(hour, "h"))
        .otherwise(rounded(day, "d"))
    )


def base_name(path, default: str = "remote") -> Column:
    """Last non-empty part of a path."""
    last = F.regexp_extract(_col(path), r"([^/]+)/*$", 1)
    return F.when(last == "", default).otherwise(last)


def file_name(path) -> Column:
    """Everything after the last slash."""
    return F.substring_index(_col(path), "/", -1)


def directory_name(path) -> Column:
    """Everything before the last slash, '/' if there is nothing."""
    parent = F.regexp_extract(_col(path), r"^(.+)/[^/]*$", 1)
    return F.when(parent == "", "/").otherwise(parent)


def folder_label(label) -> Column:
    """Short 'host:folder' form of a folder path that may carry a host."""
    label = _col(label)
    host = F.substring_index(label, ":", 1)
    after = F.regexp_replace(label, r"^[^:]*:", "")
    return (
        F.when(label == "(selected folder)", label)
        .when(F.instr(label, ":") > 0, F.concat(host, F.lit(":"), base_name(after)))
        .otherwise(base_name(label))
    )


def safe_file_name(name, default: str = "input.vxz") -> Column:
    """Base name with runs of unusual characters replaced by one underscore."""
    base = F.regexp_extract(_col(name), r"([^/]*)/*$", 1)
    clean = F.regexp_replace(F.regexp_replace(base, r"\x00", ""), r"[^A-Za-z0-9._-]+", "_")
    return F.when(clean.isNull() | (clean == ""), default).otherwise(clean)


def parse_resolution(text) -> Column:
    """struct<value, valid>: blank or 'auto' is a valid NULL, positive whole numbers are kept."""
    trimmed = F.lower(F.trim(_col(text)))
    number = F.when(
        trimmed.rlike(r"^[+]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"), trimmed.try_cast("double")
    )
    whole = number.isNotNull() & (number > 0) & (number <= 2**31 - 1) & (number == F.floor(number))
    auto = trimmed.isNull() | trimmed.isin("", "auto")
    return F.struct(F.when(~auto & whole, number.cast("int")).alias("value"), (auto | F.coalesce(whole, F.lit(False))).alias("valid"))


def clamp_fraction(fraction) -> Column:
    return F.least(F.greatest(_col(fraction).cast("double"), F.lit(0.0)), F.lit(1.0))


def valid_store_id(identity) -> Column:
    return _col(identity).rlike("^[a-f0-9]{64}$")


def valid_slice_request(identity, axis, index) -> Column:
    index = _col(index).cast("double")
    return (
        F.coalesce(valid_store_id(identity), F.lit(False))
        & F.coalesce(_col(axis).isin(*AXES), F.lit(False))
        & F.coalesce((index >= 0) & (index == F.floor(index)), F.lit(False))
    )


def valid_input_size(size) -> Column:
    return F.coalesce(_col(size).between(1, MAX_INPUT_BYTES), F.lit(False))


def input_identity(digest, resolution) -> Column:
    """Identity of an input: its digest, combined with an explicit resolution if there is one."""
    keyed = F.sha2(F.concat(_col(digest), F.lit(":r="), _col(resolution).cast("string")), 256)
    return F.when(_col(resolution).isNull(), _col(digest)).otherwise(keyed)
