from __future__ import annotations

import json
import time
from collections import defaultdict

import numpy as np
import pytest

from checks.voxel_files import vxz_bytes


def plain(cells, chunk_size):
    """(index, row numbers, octree) of every chunk, cell by cell."""
    depth, members = chunk_size.bit_length() - 1, defaultdict(list)

    def code(row):
        local = [int(v) % chunk_size for v in cells[row]]
        return sum((v >> bit & 1) << 3 * bit + 2 - axis for bit in range(depth) for axis, v in enumerate(local))

    def node(codes, level):
        groups = defaultdict(list)
        for each in codes:
            groups[each >> 3 * (depth - 1 - level) & 7].append(each)
        mask = bytes([sum(1 << child for child in groups)])
        return mask if level == depth - 1 else mask + b"".join(node(groups[child], level + 1) for child in sorted(groups))

    for row, cell in enumerate(cells):
        members[tuple(int(v) // chunk_size for v in cell)].append(row)
    for index in sorted(members):
        rows = sorted(members[index], key=code)
        yield list(index), rows, node([code(r) for r in rows], 0)


@pytest.mark.parametrize("chunk_size", [2, 8, 32])
@pytest.mark.parametrize("layout", ["all", "as_is", "none"])
def test_files_are_those_of_plain_loops(chunk_size, layout):
    draw = np.random.default_rng(chunk_size)
    cells = draw.integers(0, 20, (150, 3)) - [3, 0, 0]
    cells[100:] = cells[:50]
    dual, flags = draw.integers(0, 256, (150, 3)), draw.integers(0, 64, 150)
    content, order = vxz_bytes(cells, dual, flags, chunk_size=chunk_size, layout=layout)
    size = int.from_bytes(content[4:8], "big")
    header, body, expected = json.loads(content[8:size]), content[size:], []
    for chunk, (index, rows, tree) in zip(header["chunks"], plain(cells, chunk_size), strict=True):
        start, length = chunk["ptr"]
        expected += rows
        table = np.column_stack([dual[rows], flags[rows]]).astype(np.uint8)
        attributes = table.tobytes() if layout == "all" else table[:, :3].tobytes() + table[:, 3].tobytes() if layout == "as_is" else table.T.tobytes()
        assert chunk["idx"] == index and chunk["svo"] == [0, len(tree)] and body[start : start + length] == tree + attributes
    assert order == expected
    assert vxz_bytes(cells[:0], dual[:0], flags[:0])[1] == []


def test_large_files_are_written_without_a_step_a_voxel():
    cells = np.stack(np.unravel_index(np.arange(1 << 18), (64, 64, 64)), 1)
    began = time.process_time()
    vxz_bytes(cells, np.zeros((1 << 18, 3), int), np.zeros(1 << 18, int), chunk_size=8)
    assert time.process_time() - began < 2.5  # about 8 s cell by cell
