"""Fixed values of the file formats, label scales and palettes that results depend on."""

from __future__ import annotations

# --- fixed values: voxel file format -------------------------------------------------------
VXZ_MAGIC = b"VXZ"
VXZ_VERSION = 0
VXZ_FILTER = "none"
VXZ_REQUIRED_ATTRIBUTES = {"dual_vertices": 3, "intersected": 1}
VXZ_OPTIONAL_ATTRIBUTES = ("ovoxel_type", "qef_rank")
MISSING_ATTRIBUTE = 255
MAX_ATTRIBUTE_CASE = 3
COORD_BITS = 21
COORD_MASK = (1 << COORD_BITS) - 1
MORTON_AXIS_BITS = 10
UINT16_MAX = 65_535
MAX_INPUT_BYTES = 2 * 1024 * 1024 * 1024

# --- fixed values: prepared store ----------------------------------------------------------
FORMAT_VERSION = 3
STORE_VERSION = 5
STORE_ARTEFACTS = (
    "metadata.json",
    "coords.npy",
    "dual.npy",
    "intersected.npy",
    "ovoxel_type.npy",
    "qef_rank.npy",
    "voxels.bin",
    "mesh.bin",
)
POINT_BUDGET = 750_000
MESH_FACE_BUDGET = 5_000_000

# --- fixed values: signed edge topology ----------------------------------------------------
# For an edge along x, y or z: the offsets of the second, third and fourth voxel around it.
EDGE_NEIGHBOURS = (
    ((0, 0, 1), (0, 1, 1), (0, 1, 0)),
    ((1, 0, 0), (1, 0, 1), (0, 0, 1)),
    ((0, 1, 0), (1, 1, 0), (1, 0, 0)),
)

# --- fixed values: axes, colour modes, volume kinds ----------------------------------------
AXES = ("x", "y", "z")
COLOR_MODES = ("occupancy", "edges", "dual", "fallback", "rank")
VOLUME_KINDS = (
    "pipelineLabels",
    "finalCclComponents",
    "finalCclCases",
    "componentLabels",
    "boundaryMask",
    "surfaceBoundaryClassification",
    "linfinityDistanceCases",
    "scalarField",
)

# --- fixed values: label categories in display order (key, label, colour) --------------------
CATEGORIES = (
    ("unknown", "Unknown / background", "#1f2933"),
    ("outside", "Outside", "#2563eb"),
    ("inside", "Inside", "#dc2626"),
    ("band", "Unresolved band", "#facc15"),
    ("surface", "Surface barrier", "#000000"),
    ("components", "CCL components", "#74b9ff"),
    ("insideOnly", "Inside-only case", "#22c55e"),
    ("outsideOnly", "Outside-only case", "#a855f7"),
    ("bothSides", "Both-sides case", "#f97316"),
    ("isolated", "Isolated case", "#06b6d4"),
    ("linfCase", "L-infinity distance case", "#64748b"),
    ("surfaceBoundaryInside", "Surface boundary inside", "#39ff14"),
    ("surfaceBoundaryOutside", "Surface boundary outside", "#ff00ff"),
)

# --- fixed values: category per integer label, by volume kind --------------------------------
LABEL_CATEGORIES = {
    "pipelineLabels": {0: "unknown", 1: "outside", 2: "inside", 3: "band", 4: "surface"},
    "finalCclComponents": {0: "unknown", 1: "outside", 2: "inside", 3: "surface"},
    "finalCclCases": {
        0: "unknown",
        1: "outside",
        2: "inside",
        3: "surface",
        4: "insideOnly",
        5: "outsideOnly",
        6: "bothSides",
        7: "isolated",
    },
    "surfaceBoundaryClassification": {
        0: "unknown",
        1: "outside",
        2: "inside",
        3: "surfaceBoundaryInside",
        4: "surfaceBoundaryOutside",
    },
}

# --- fixed values: fallback cases and rank cases (case, label, rgb) ---------------------------
FALLBACK_CASES = (
    (0, "0 · Interior (3D unconstrained)", (37, 99, 235)),
    (1, "1 · Voxel face (2D optimum)", (16, 185, 129)),
    (2, "2 · Voxel edge (1D optimum)", (245, 158, 11)),
    (3, "3 · Voxel corner", (225, 29, 72)),
)
RANK_CASES = (
    (0, "Rank 0 · deficient", (190, 24, 93)),
    (1, "Rank 1 · deficient", (220, 38, 38)),
    (2, "Rank 2 · deficient", (245, 158, 11)),
    (3, "Rank 3 · full rank", (16, 185, 129)),
)
UNAVAILABLE_RGB = (100, 116, 139)
OCCUPANCY_RGB = (22, 150, 200)
NO_EDGE_RGB = (92, 105, 122)
EDGE_ABSENT, EDGE_NEGATIVE, EDGE_POSITIVE = 28, 145, 255
SLICE_BACKGROUND_RGB = (244, 247, 250)
NEUTRAL_RGB = (127, 127, 127)

# --- fixed values: scalar field ramp and pseudo-random hues -----------------------------------
SCALAR_FAR_THRESHOLD = 0.1
SCALAR_POSITIVE_TARGET = (0.9, 0.05, 0.05)
SCALAR_NEGATIVE_TARGET = (0.05, 0.2, 0.95)
COMPONENT_HUE_STEP = 137.508
COMPONENT_SATURATION = 0.68
COMPONENT_LIGHTNESS = 0.57

# --- fixed values: other limits -----------------------------------------------------------------
OVERLAY_MAX_PIXELS = 4096
MIN_NORMALIZABLE_EDGE = 1e-12
MAX_SAFE_INTEGER = 9_007_199_254_740_991
UNSAFE_LABELS = "One or more 64-bit labels exceeded JavaScript's safe integer range."

# --- fixed values: volume kind per base file name (patterns on the lower-cased stem) ------------
VOLUME_KIND_PATTERNS = (
    (
        r"^(000_initial_ccl_labels|\d{3}_final_ccl_labels|\d{3}_inside_filtered_labels"
        r"|\d{3}_free_space_labels|\d{3}_final_labels)$",
        "pipelineLabels",
    ),
    (r"^\d{3}_(original|closed)_boundary$", "boundaryMask"),
    (r"^\d{3}_final_ccl_components$", "finalCclComponents"),
    (r"^\d{3}_pseudo_boundary_components$", "componentLabels"),
    (r"^\d{3}_final_ccl_cases$", "finalCclCases"),
    (r"^\d{3}_surface_boundary_classification$", "surfaceBoundaryClassification"),
    (r"^999_scalar_field$", "scalarField"),
    (r"^999_linf_distance_cases$", "linfinityDistanceCases"),
)

# --- fixed values: folder selection names, orders and scores --------------------------------------
MANIFEST_NAME = "npy_labels.json"
MESH_NAME_PATTERN = r"(?i)\.(ply|obj|stl)$"
SPECIAL_VOLUME_ORDER = {
    "000_initial_ccl_labels.npy": 0.0,
    "999_scalar_field.npy": 999.0,
    "999_linf_distance_cases.npy": 999.1,
}
STANDALONE_PATTERN = (
    r"(?i)^(\d{3})_(original_boundary|closed_boundary|free_space_labels"
    r"|pseudo_boundary_components|final_labels)\.npy$"
)
FINAL_CCL_PATTERN = r"(?i)^(\d{3})_final_ccl_(labels|components|cases)\.npy$"
INSIDE_FILTERED_PATTERN = r"(?i)^(\d{3})_inside_filtered_labels\.npy$"
SURFACE_BOUNDARY_PATTERN = r"(?i)^(\d{3})_surface_boundary_classification\.npy$"
ROLE_ORDER_OFFSET = {
    "label": 0.0,
    "components": 0.1,
    "cases": 0.2,
    "insideFiltered": 0.0,
    "surfaceBoundary": 0.0,
}
ROLE_SCORE = {
    "label": 100,
    "components": 90,
    "cases": 90,
    "insideFiltered": 40,
    "surfaceBoundary": 40,
}
CANDIDATE_MESH_SCORE = 1000
DIRECTORY_MESH_SCORE = 10_000
DIRECTORY_VOLUME_SCORE = 100
MESH_NAME_ORDER = {"voxel_input_mesh.ply": 0, "mesh.ply": 1}
