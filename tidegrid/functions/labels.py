"""Label encodings, row policies and captions, as Column and DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.constants import FOLDER_WEIGHT, IGNORE_LABEL, MAX_OBJECT_LENGTH_M, PIX_TO_M

LOW = "LOW"
SCORED = ("HIGH", "MEDIUM")
# drawing order of label confidences
CONFIDENCE_RANK = {"LOW": 0, "MEDIUM": 1, "HIGH": 2}
GEO_AND_BOX_COLUMNS = ("detect_lat", "detect_lon", "top", "left", "bottom", "right")


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _false(c: Column) -> Column:
    return F.coalesce(~c, F.lit(False))


def keep_confident(labels: DataFrame) -> DataFrame:
    """Rows whose label is HIGH or MEDIUM."""
    return labels.filter(F.col("confidence").isin(*SCORED))


def blank_low(labels: DataFrame) -> DataFrame:
    """Keep LOW rows but forget their classes and length."""
    sure = F.col("confidence") != LOW
    return labels.withColumns({c: F.when(sure, F.col(c)) for c in ("is_vessel", "is_fishing", "vessel_length_m")})


def apply_low_policy(labels: DataFrame, filter_low: bool = False, blank: bool = False) -> DataFrame:
    """Apply at most one of the two policies for LOW rows."""
    if filter_low and blank:
        raise ValueError("LOW rows can be filtered or blanked, not both")
    if filter_low:
        return keep_confident(labels)
    return blank_low(labels) if blank else labels


def drop_geometry(labels: DataFrame) -> DataFrame:
    return labels.drop(*GEO_AND_BOX_COLUMNS)


def three_class(is_vessel: Column, is_fishing: Column) -> Column:
    """0 non-vessel or unknown, 1 vessel, 2 fishing; a known fishing status implies a vessel."""
    vessel = is_fishing.isNotNull() | _true(is_vessel)
    return vessel.cast("bigint") + _true(is_fishing).cast("bigint")


def three_class_vessel(label: Column) -> Column:
    return label != 0


def three_class_fishing(label: Column) -> Column:
    return label == 2


def four_class(is_vessel: Column, is_fishing: Column) -> Column:
    """0 unknown, 1 non-vessel, 2 vessel, 3 fishing; the fishing status wins over the vessel status."""
    return (
        F.when(_true(is_fishing), 3)
        .when(_false(is_fishing), 2)
        .when(_true(is_vessel), 2)
        .when(_false(is_vessel), 1)
        .otherwise(0)
        .cast("bigint")
    )


def length_to_pixels(length_m: Column) -> Column:
    return F.coalesce(length_m, F.lit(0.0)) / F.lit(float(PIX_TO_M))


def length_to_metres(length_px: Column) -> Column:
    return length_px * F.lit(float(PIX_TO_M))


def near_shore_target(km: Column) -> Column:
    """Near-shore flag of targets and of scoring: 2 km included."""
    return _true(km <= 2)


def near_shore_balance(km: Column) -> Column:
    """Near-shore flag used for balancing and stratifying: 2 km excluded."""
    return _true(km < 2)


def unknown_to_code(flag: Column) -> Column:
    return F.coalesce(flag.cast("bigint"), F.lit(IGNORE_LABEL).cast("bigint"))


def code_to_unknown(code: Column) -> Column:
    return F.when(code != IGNORE_LABEL, code)


def folder_weight(folder: Column) -> Column:
    chain = None
    for name, weight in FOLDER_WEIGHT.items():
        chain = F.when(folder == name, weight) if chain is None else chain.when(folder == name, weight)
    return chain


def cap_length(length_m: Column) -> Column:
    # least() skips NULLs, and a missing length must stay missing
    return F.when(length_m.isNotNull(), F.least(length_m, F.lit(float(MAX_OBJECT_LENGTH_M))))


def confidence_rank(confidence: Column) -> Column:
    chain = None
    for name, rank in CONFIDENCE_RANK.items():
        chain = F.when(confidence == name, rank) if chain is None else chain.when(confidence == name, rank)
    return chain


def scene_path(root: str, folder: Column, scene_id: Column) -> Column:
    return F.concat_ws("/", F.lit(root), folder, scene_id)


def scene_of_path(path: Column) -> Column:
    """File or folder name without its extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def folder_of_path(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def _by_flag(flag: Column, no: str, yes: str, unknown: str) -> Column:
    return F.when(flag.isNull(), unknown).when(flag, yes).otherwise(no)


def two_decimals(p: Column) -> Column:
    """A score in [0, 1] with two decimals, rounded from its exact binary value, ties to even."""
    scaled = p * F.lit(float(1 << 30))
    whole = F.floor(scaled).cast("bigint")
    rest_hundreds = (scaled - whole) * 100.0
    hundreds = whole * 100 + F.floor(rest_hundreds).cast("bigint")
    more = rest_hundreds > F.floor(rest_hundreds)
    q, rest = F.shiftright(hundreds, 30), hundreds.bitwiseAND(F.lit((1 << 30) - 1))
    half = F.lit(1 << 29)
    up = (rest > half) | ((rest == half) & (more | (q % 2 == 1)))
    q = q + up.cast("bigint")
    return F.concat(F.floor(q / 100).cast("string"), F.lit("."), F.lpad((q % 100).cast("string"), 2, "0"))


def caption(
    is_vessel: Column,
    is_fishing: Column,
    vessel_p: Column | None = None,
    fishing_p: Column | None = None,
    score: Column | None = None,
) -> Column:
    """Text of a detection: P/V/U, then nothing, /F or /U, each with its score when given."""
    vessel = _by_flag(is_vessel, "P", "V", "U")
    fishing = _by_flag(is_fishing, "", "/F", "/U")
    if vessel_p is not None:
        vessel = F.concat(F.lit(" "), vessel, two_decimals(vessel_p))
    if fishing_p is not None:
        fishing = F.concat(F.lit(" "), fishing, two_decimals(fishing_p))
    text = F.concat(vessel, fishing)
    return text if score is None else F.concat(text, F.lit(" "), two_decimals(score))


def colour_class(is_vessel: Column, is_fishing: Column) -> Column:
    """Colour name of a detection: the fishing status matters for vessels only."""
    return (
        F.when(is_vessel.isNull(), "gray")
        .when(~is_vessel, "pink")
        .when(is_fishing.isNull(), "purple")
        .when(is_fishing, "orange")
        .otherwise("mint")
    )
