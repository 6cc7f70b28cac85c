"""Fixed values of the domain."""

# metres per pixel
PIX_TO_M = 10
# length cap used when lengths are compared, metres
MAX_OBJECT_LENGTH_M = 500
# class value meaning "unknown"
IGNORE_LABEL = 255
# raster value meaning "no data"
NODATA = -32768
# largest distance of a correct detection, metres, and the "close to shore" distance, kilometres
DISTANCE_TOLERANCE_M = 200
SHORE_TOLERANCE_KM = 2
# lowest score a decoded detection may have
SCORE_FLOOR = 0.3
# weight of a sample by the folder it comes from
FOLDER_WEIGHT = {"train": 0.25, "validation": 1.0, "valid": 1.0, "test": 0.1}
# file of each raster channel
CHANNEL_FILES = {
    "vv": "VV_dB.tif",
    "vh": "VH_dB.tif",
    "bathymetry": "bathymetry.tif",
    "wind_direction": "owiWindDirection.tif",
    "wind_quality": "owiWindQuality.tif",
    "wind_speed": "owiWindSpeed.tif",
    "mask": "owiMask.tif",
}
# location that gathers unrelated open-sea scenes
SINK_LOCATION = "19"
# scenes of the small fixed training and validation lists
TINY_TRAIN_SCENES = (
    "05bc615a9b0e1159t",
    "72dba3e82f782f67t",
    "2899cfb18883251bt",
    "e98ca5aba8849b06t",
    "cbe4ad26fe73f118t",
)
TINY_VALID_SCENES = ("590dd08f71056cacv", "b1844cde847a3942v")


def linspace(start: float, stop: float, count: int) -> list[float]:
    """Evenly spaced values with both ends included."""
    step = (stop - start) / (count - 1)
    return [start + i * step for i in range(count - 1)] + [stop]


# grid of class thresholds scored for both class scores
CLASS_THRESHOLDS = linspace(0.0, 1.0, 50)
# objectness thresholds tried when none are given
OBJECTNESS_THRESHOLDS = linspace(0.4, 0.6, 21)
