"""Tolerances and defaults, in points unless the name says otherwise. Every operator takes them as arguments."""

from __future__ import annotations

# What results depend on, by subject.
TOPOLOGY, CURVE_SEGMENTS = 0.01, 16
TEXT_NEAR, ARROW_NEAR, ENDPOINT_NEAR, WIRE_MARK_NEAR, SYMBOL_NEAR = 6.0, 10.0, 5.0, 7.0, 30.0
ENDPOINT_CHARS, ENDPOINT_TOKENS = 8, 2
AMBIGUITY, DIAGONAL_FACTOR = 1.5, 1.6
CLUSTER_DISTANCE, MERGE_DISTANCE, ALIGNMENT, FONT, FONT_REACH = 5.0, 5.0, 2.0, 0.2, 0.8
ENDPOINT_COMPONENT, RELATION_POINT, ENDPOINT_FALLBACK, BOX_ADJACENCY, CONTAINMENT_SHARE = 10.0, 0.1, 5.0, 1.0, 0.6
WIRE_SEED_LENGTH, TERMINAL_DIAGONAL_LENGTH, FLOW_COSINE = 8.0, 10.0, 0.5
CONTAINER_AREA_SHARE, CONTAINER_TAGS, CONTAINER_LABELLED = 0.2, 10, 3
DEVICE_TAG = r"^\s*(?:\d+\s+)?-[A-Za-z]"
FRAME_EXTENSION, CONTENT_INSET, CONTENT_INSET_SHARE, FRAME_EDGE, FRAME_SPAN, FRAME_INSIDE = 2.0, 1.0, 0.01, 2.0, 0.35, 0.25
GRID_COORDINATE, GRID_COVERAGE = 0.8, 0.9
ENTITY_CONTAINMENT, ENTITY_GAP, ENTITY_FACE_AREA, CLOSED_EDGE, REGION_AREA = 1.0, 8.0, 100.0, 0.75, 1.0
CIRCULARITY, CIRCLE_ASPECT, BOX_FILL, BOX_SPANS = 0.82, 0.25, 0.86, 1.2
PIN_SIZE, CIRCLE_DIAMETER, CIRCLE_SIZE_ABSOLUTE, CIRCLE_SIZE_RELATIVE = 1.0, 12.0, 0.5, 0.08
ARROW_SIZE, ARROW_AREA, PIN_POINT, ISOSCELES, EQUILATERAL, DIRECTION_AXIS = 20.0, 0.5, 0.5, 0.15, 0.1, 0.2
MARK_LENGTH, MARK_END, MARK_CENTRE, MARK_AXIS_DEGREES, MARK_ANGLE_DEGREES, MARK_LENGTH_RELATIVE = 12.0, 0.5, 0.35, 5.0, 3.0, 0.08
QUERY_SLACK, ANCHOR_GAP, SHAPE, MISSING_VECTORS, SYMBOL_OVERLAP = 0.01, 0.75, 0.75, 0.1, 0.5
ROTATIONS = (0, 90, 180, 270)
LINK_IOU, LINK_COMPONENT = 0.45, 70.0
NEAREST_COUNT, NEAREST_RATIO, NEAREST_SLACK = 5, 1.2, 1e-9
MAX_HOPS, LIST_LIMIT, VECTORS_ON_PAGE, SNIPPET = 50, 500, 2000, 1800

ENTITY_KINDS = ("component", "wire", "endpoint", "net", "group")
CROSS_PAGE_KINDS = ("transfer", "hyperlink")
EDGE_KINDS = ("connection", "contains", *CROSS_PAGE_KINDS)
SKIPPABLE, OMITTABLE = ("endpoint", "net", "wire", "group"), ("group", "net", "wire", "endpoint", "hyperlink", "transfer")
DEFAULT_SKIP, DEFAULT_OMIT = ("endpoint", "net"), ("group", "hyperlink")
ARROW_IO = {"upstream": "input", "downstream": "output"}
DIAGRAM_TYPES = ("single", "multi", "plc_io")
