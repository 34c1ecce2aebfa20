"""Writes small voxel files for tests and round trips."""

from __future__ import annotations

import json
import lzma
import zlib

import numpy as np
import zstandard


def _pack(data: bytes, compression: str) -> bytes:
    if compression == "deflate":
        packer = zlib.compressobj(wbits=-15)
        return packer.compress(data) + packer.flush()
    if compression == "lzma":
        return lzma.compress(data, format=lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "preset": 6}])
    if compression == "zstd":
        return zstandard.ZstdCompressor().compress(data)
    return data


def _codes(cells: np.ndarray, bits: int) -> np.ndarray:
    """Interleaved coordinates of cells, x first."""
    codes = np.zeros(len(cells), np.int64)
    for bit in range(bits):
        for axis in range(3):
            codes |= (cells[:, axis] >> bit & 1) << 3 * bit + 2 - axis
    return codes


def _tree(codes: np.ndarray, depth: int) -> bytes:
    """Child masks of all nodes, depth first: in order of their first cells, and of levels where these are equal."""
    firsts, masks = [], []
    for level in range(depth):
        children = np.unique(codes >> 3 * (depth - 1 - level))
        nodes, starts = np.unique(children >> 3, return_index=True)
        firsts.append(nodes << 3 * (depth - level))
        masks.append(np.add.reduceat(1 << (children & 7), starts))
    # The levels come one after the other, and a stable sort keeps them so.
    return np.concatenate(masks)[np.argsort(np.concatenate(firsts), kind="stable")].astype(np.uint8).tobytes()


def vxz_bytes(cells, dual, flags, types=None, ranks=None, chunk_size=4, compression="none", layout="all", changes=None):
    """(bytes of a file, its order of voxels as row indices); voxels are stored chunk by chunk."""
    cells = np.asarray(cells, np.int64).reshape(-1, 3)
    attributes = [("dual_vertices", np.asarray(dual)), ("intersected", np.asarray(flags)[:, None])]
    if types is not None:
        attributes.append(("ovoxel_type", np.asarray(types)[:, None]))
    if ranks is not None:
        attributes.append(("qef_rank", np.asarray(ranks)[:, None]))
    depth = chunk_size.bit_length() - 1
    at, codes = cells // chunk_size, _codes(cells % chunk_size, depth)
    placed = np.lexsort((codes, *at.T[::-1]))
    edges = np.flatnonzero((np.diff(at[placed], axis=0) != 0).any(axis=1)) + 1
    body, chunks, start = [], [], 0
    for rows in np.split(placed, edges) if len(placed) else []:
        streams = {"svo": _tree(codes[rows], depth)}
        if layout == "all":
            streams["attr"] = np.hstack([v[rows] for _, v in attributes]).astype(np.uint8).tobytes()
        for name, values in attributes if layout != "all" else []:
            if layout == "as_is":
                streams[name] = values[rows].astype(np.uint8).tobytes()
            else:
                for channel in range(values.shape[1]):
                    streams[f"{name}_{channel}"] = values[rows, channel].astype(np.uint8).tobytes()
        chunk, offset, packed = {"idx": at[rows[0]].tolist()}, 0, b""
        for name, data in streams.items():
            data = _pack(data, compression)
            chunk[name] = [offset, len(data)]
            packed, offset = packed + data, offset + len(data)
        chunk["ptr"] = [start, len(packed)]
        body.append(packed)
        start += len(packed)
        chunks.append(chunk)
    header = {
        "num_voxel": len(cells),
        "chunk_size": chunk_size,
        "filter": "none",
        "compression": compression,
        "compression_level": 6 if compression == "lzma" else None,
        "attr_interleave": layout,
        "attr": [[name, values.shape[1]] for name, values in attributes],
        "chunks": chunks,
        **(changes or {}),
    }
    text = json.dumps(header).encode()
    return b"VXZ\0" + (8 + len(text)).to_bytes(4, "big") + text + b"".join(body), placed.tolist()


def write_vxz(path, *arguments, **options):
    """Write voxels chunk by chunk in file order and return that order as row indices."""
    content, order = vxz_bytes(*arguments, **options)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)
    return order


def sphere(resolution: int, radius: float):
    """Voxels of a sphere surface: cells, dual offsets and signed edge flags."""
    corner = np.arange(resolution + 1) - resolution / 2
    inside = corner[:, None, None] ** 2 + corner[None, :, None] ** 2 + corner[None, None, :] ** 2 < radius**2
    low, high = slice(None, -1), slice(1, None)
    corners = [inside[a, b, c] for a in (low, high) for b in (low, high) for c in (low, high)]
    total = sum(c.astype(int) for c in corners)
    far = inside[high, high, high]
    ends = [inside[low, high, high], inside[high, low, high], inside[high, high, low]]
    flags = sum(((e != far) * (np.where(far, 9, 1) << axis)) for axis, e in enumerate(ends))
    cells = np.argwhere((total > 0) & (total < 8))
    chosen = flags[tuple(cells.T)]
    return cells, np.full((len(cells), 3), 128), chosen
