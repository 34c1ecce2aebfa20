"""Grid, world and slice coordinates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxspark.constants import AXES, COORD_BITS, COORD_MASK, MORTON_AXIS_BITS, OVERLAY_MAX_PIXELS


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(value)


def check_axis(axis: str) -> str:
    if axis not in AXES:
        raise ValueError(f"axis must be one of {AXES}, got {axis!r}")
    return axis


def axis_index(axis) -> Column:
    """0, 1 or 2 for an axis-name column; an unknown name raises when the row is read."""
    name = _col(axis)
    return (
        F.when(name == "x", 0)
        .when(name == "y", 1)
        .when(name == "z", 2)
        .otherwise(F.raise_error(F.concat(F.lit("unknown axis "), F.coalesce(name, F.lit("null")))).cast("int"))
    )


def _by_axis(axis, x: Column, y: Column, z: Column) -> Column:
    """Pick a column by a fixed axis name (str in AXES) or by an axis-name column."""
    if isinstance(axis, str) and axis in AXES:
        return {"x": x, "y": y, "z": z}[axis]
    name = _col(axis)
    return F.when(name == "x", x).when(name == "y", y).when(name == "z", z)


# --- voxels: cell centred in [-0.5, 0.5] ---------------------------------------------------------


def cell_center(coord, resolution) -> Column:
    return (_col(coord) + 0.5) / _col(resolution) - 0.5


def dual_position(coord, dual, resolution) -> Column:
    """World position of a dual vertex in double precision."""
    return (_col(coord) + _col(dual) / F.lit(255.0)) / _col(resolution) - 0.5


def _dual_local_f32(coord, dual) -> Column:
    step = (_col(dual).cast("double") / 255.0).cast("float")
    return _col(coord).cast("float") + step


def dual_position_f32(coord, dual, resolution) -> Column:
    """World position of a dual vertex with every step rounded to single precision."""
    local = _dual_local_f32(coord, dual)
    scaled = (local.cast("double") / _col(resolution).cast("double")).cast("float")
    return scaled - F.lit(0.5).cast("float")


def split_position_f32(coord, dual, resolution) -> Column:
    """Single precision position used for the quad split: times 1/R instead of divided by R."""
    inverse = (F.lit(1.0) / _col(resolution).cast("double")).cast("float")
    return _dual_local_f32(coord, dual) * inverse - F.lit(0.5).cast("float")


# --- packed and interleaved keys -------------------------------------------------------------------


def fits_key(*coords) -> Column:
    ok = F.lit(True)
    for coord in coords:
        ok = ok & _col(coord).between(0, COORD_MASK)
    return ok


def pack_cell(x, y, z) -> Column:
    """x, y, z of 21 bits each in one non-negative BIGINT; NULL outside that range."""
    x, y, z = (_col(v).cast("long") for v in (x, y, z))
    packed = F.shiftleft(x, 2 * COORD_BITS).bitwiseOR(F.shiftleft(y, COORD_BITS)).bitwiseOR(z)
    return F.when(fits_key(x, y, z), packed)


def unpack_cell(cell) -> tuple[Column, Column, Column]:
    cell = _col(cell)
    return tuple(
        F.shiftright(cell, shift).bitwiseAND(F.lit(COORD_MASK).cast("long")).cast("int")
        for shift in (2 * COORD_BITS, COORD_BITS, 0)
    )


def pack_dual(dx, dy, dz) -> Column:
    """Three dual offsets of 8 bits each in one INT."""
    dx, dy, dz = (_col(v).cast("int") for v in (dx, dy, dz))
    return F.shiftleft(dx, 16).bitwiseOR(F.shiftleft(dy, 8)).bitwiseOR(dz)


def unpack_dual(dual) -> tuple[Column, Column, Column]:
    dual = _col(dual)
    return tuple(F.shiftright(dual, shift).bitwiseAND(255) for shift in (16, 8, 0))


def morton_encode(x, y, z) -> Column:
    """Interleave 10 bits per axis; x takes the highest bit of every triple."""
    code = F.lit(0)
    for bit in range(MORTON_AXIS_BITS):
        for offset, coord in ((2, x), (1, y), (0, z)):
            moved = F.shiftleft(F.shiftright(_col(coord).cast("int"), bit).bitwiseAND(1), 3 * bit + offset)
            code = code.bitwiseOR(moved)
    return code


def morton_decode(code) -> tuple[Column, Column, Column]:
    axes = []
    for offset in (2, 1, 0):
        value = F.lit(0)
        for bit in range(MORTON_AXIS_BITS):
            picked = F.shiftright(_col(code).cast("int"), 3 * bit + offset).bitwiseAND(1)
            value = value.bitwiseOR(F.shiftleft(picked, bit))
        axes.append(value)
    return tuple(axes)


# --- slices of the voxel grid ----------------------------------------------------------------------


def grid_to_pixel(axis, x, y, z, resolution) -> tuple[Column, Column]:
    x, y, z = _col(x), _col(y), _col(z)
    top = _col(resolution) - 1
    return _by_axis(axis, z, x, x), _by_axis(axis, top - y, top - z, top - y)


def pixel_to_grid(axis, index, px, py, size) -> tuple[Column, Column, Column]:
    """Grid cell under a slice pixel; size is the pixel height of the slice."""
    index, px = _col(index), _col(px)
    up = _col(size) - 1 - _col(py)
    return _by_axis(axis, index, px, px), _by_axis(axis, up, index, up), _by_axis(axis, px, up, index)


def dual_to_slice(axis, coords, dual, resolution) -> dict[str, Column]:
    """Continuous pixel and [-1, 1] plane position of a dual vertex seen along an axis."""
    x, y, z = (_col(c) + _col(d) / F.lit(255.0) for c, d in zip(coords, dual))
    resolution = _col(resolution)
    pixel_x = _by_axis(axis, z, x, x)
    pixel_y = resolution - _by_axis(axis, y, z, y)
    return {
        "pixel_x": pixel_x,
        "pixel_y": pixel_y,
        "plane_x": pixel_x / resolution * 2 - 1,
        "plane_y": F.lit(1.0) - pixel_y / resolution * 2,
    }


def overlay_scale(resolution) -> Column:
    return F.when(_col(resolution) * 2 <= OVERLAY_MAX_PIXELS, 2).otherwise(1)


def clamp_index(index, size) -> Column:
    """Nearest valid slice index; half way rounds up."""
    return F.least(F.greatest(F.floor(_col(index) + 0.5), F.lit(0).cast("long")), (_col(size) - 1).cast("long"))


def middle_index(size) -> Column:
    return F.floor((_col(size) - 1) / 2)


# --- label volumes: node centred in [-1, 1] ---------------------------------------------------------


def node_position(index, size) -> Column:
    return F.when(_col(size) <= 1, F.lit(0.0)).otherwise(F.lit(-1.0) + _col(index) * 2 / (_col(size) - 1))


def flat_offset(i, j, k, nx, ny, nz, fortran_order) -> Column:
    i, j, k, nx, ny, nz = (_col(v).cast("long") for v in (i, j, k, nx, ny, nz))
    return F.when(_col(fortran_order), i + nx * (j + ny * k)).otherwise(k + nz * (j + ny * i))


def flat_to_node(offset, nx, ny, nz, fortran_order) -> tuple[Column, Column, Column]:
    offset, nx, ny, nz = (_col(v).cast("long") for v in (offset, nx, ny, nz))
    fortran = _col(fortran_order)
    first_f, rest_f = offset % nx, F.floor(offset / nx)
    last_c, rest_c = offset % nz, F.floor(offset / nz)
    return (
        F.when(fortran, first_f).otherwise(F.floor(rest_c / ny)).cast("int"),
        F.when(fortran, rest_f % ny).otherwise(rest_c % ny).cast("int"),
        F.when(fortran, F.floor(rest_f / ny)).otherwise(last_c).cast("int"),
    )


def slice_width(axis, nx, ny, nz) -> Column:
    return _by_axis(axis, _col(nz), _col(nx), _col(nx))


def slice_height(axis, nx, ny, nz) -> Column:
    return _by_axis(axis, _col(ny), _col(nz), _col(ny))


def slice_plane_position(index, size, node_centred) -> Column:
    return F.when(_col(node_centred), node_position(index, size)).otherwise(cell_center(index, size))


# --- clustering ---------------------------------------------------------------------------------------


def cluster_coord(coord, dual, width) -> Column:
    """Cluster index along one axis, exact in units of 1/255 cell."""
    units = _col(coord).cast("long") * 255 + _col(dual)
    size = _col(width).cast("long") * 255
    return F.floor((units - units % size) / size).cast("long")
