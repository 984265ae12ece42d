"""Names of files and features as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted file endings, longest first.
MODEL_SUFFIXES = (".obj", ".ply", ".stl", ".vtp")
LANDMARK_SUFFIXES = (".mrk.json", ".fcsv", ".json", ".csv")
TEXTURE_SUFFIXES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp")
AVERAGE_PATTERN = "^(average|mean)_texture"


def _pattern(suffixes: tuple) -> str:
    return "(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"


def has_suffix(name: Column, suffixes: tuple) -> Column:
    return F.lower(name).rlike(_pattern(suffixes))


def stem(name: Column, suffixes: tuple) -> Column:
    """The name without its suffix; case of the rest is kept."""
    return F.regexp_replace(name, "(?i)" + _pattern(suffixes), "")


def is_hidden(name: Column) -> Column:
    return name.startswith(".")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_average_texture(name: Column) -> Column:
    return F.lower(name).rlike(AVERAGE_PATTERN)


def color_feature(face_id: Column, channel: Column) -> Column:
    return F.concat(F.lit("face_"), face_id.cast("string"), F.lit("."), channel)


def area_feature(label: Column, normalization: str) -> Column:
    return F.concat(F.lit("cluster_"), label.cast("string"), F.lit(f".area_{normalization}"))


def feature_face(name: Column) -> Column:
    """Face id in a colour feature name, NULL for any other name."""
    return F.when(
        name.rlike(r"^face_\d+\.(L|a|b)$"),
        F.regexp_extract(name, r"^face_(\d+)\.", 1),
    ).cast("bigint")


def feature_channel(name: Column) -> Column:
    return F.when(name.rlike(r"^face_\d+\.(L|a|b)$"), F.regexp_extract(name, r"\.(L|a|b)$", 1))
