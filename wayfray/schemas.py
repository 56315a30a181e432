"""Schemas and fixed values of the road-network model."""

from __future__ import annotations

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
LINE = T.ArrayType(POINT)
RINGS = T.ArrayType(LINE)

# Feature classes of drivable, main and arterial roads; None keeps all.
ROAD_SETS: dict[str, tuple[str, ...] | None] = {
    "drive": ("S1100", "S1200", "S1400", "S1500", "S1630", "S1640"),
    "main": ("S1100", "S1200", "S1400"),
    "arterial": ("S1100", "S1200"),
    "all": None,
}
# How likely a road of a class is to survive.
FITNESS = {"S1100": 0.95, "S1200": 0.85, "S1400": 0.55, "S1500": 0.25, "S1630": 0.70, "S1640": 0.40, "S1730": 0.30, "S1740": 0.30, "S1780": 0.25}
DEFAULT_FITNESS = 0.5
# Names that a zone layer may give its id, best first.
GEOID_COLUMNS = ("GEOID20", "GEOID10", "GEOID")
# The label of a road without a name, and the exponent of two-dimensional percolation.
UNNAMED = "__unnamed__"
TAU_2D = 187 / 91

PROTOCOLS = ("random", "fitness", "betweenness")
SCENARIO = ["protocol", "unit", "p", "p_milli", "replicate"]
GLOBAL_COLUMNS = [
    "level", "scope", "protocol", "unit", "p", "replicate", "frag_nominal", "frag_effective", "marooned_frac",
    "zone_mean_frag_effective", "giant_frac", "second_frac", "n_components", "label", "fips",
]
ZONE_COLUMNS = ["level", "scope", "protocol", "unit", "p", "zone_id", "n_edges", "frag_nominal", "frag_marooned", "frag_effective", "label", "fips"]
