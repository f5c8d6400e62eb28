"""Declared schemas and the fixed values of the domain."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ["date", "latitude", "longitude"]


def _daily(*measures: str, time: str = "time", lat: str = "latitude", lon: str = "longitude"):
    fields = [T.StructField(time, T.TimestampNTZType())]
    fields += [T.StructField(c, T.DoubleType()) for c in (lat, lon, *measures)]
    return T.StructType(fields)


FWI_DAILY = _daily("fwi")
TEMP_MAX_DAILY = _daily("temperature_max", "temperature_max_celsius")
TEMP_MEAN_DAILY = _daily("temperature_mean", "temperature_mean_celsius")
ATMOSPHERE_MEASURES = [
    "10m_u_component_of_wind",
    "10m_v_component_of_wind",
    "2m_dewpoint_temperature",
    "total_precipitation",
]
ATMOSPHERE_DAILY = _daily(*ATMOSPHERE_MEASURES)
LAND_DAILY = _daily("d2m", "t2m", "u10", "v10", "tp")
REGIONAL_DAILY = _daily("si10", "r2", "t2m", "tp")
CLIMATE_MODEL_DAILY = _daily("tasmax", "huss", "sfcWind", "pr", lat="lat", lon="lon")
LANDCOVER = T.StructType(
    [
        T.StructField("longitude", T.DoubleType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("landcover", T.IntegerType()),
        T.StructField("landcover_class", T.StringType()),
    ]
)
EXPOSURE = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in ("latitude", "longitude", "value")]
)

# ---- Fixed values (must equal the published inputs for right results) -------------------------
# Boxes are (south, north, west, east) in degrees.
STUDY_BOX = (36.8, 42.2, -9.6, -6.2)
MAINLAND_BOX = (36.5, 42.2, -9.6, -6.0)
MERGE_BOX = (36.0, 43.0, -10.0, -6.0)
WIDENED_BOX = (35.0, 44.0, -11.0, -5.0)

# Named, overlapping map regions: name, south, north, west, east.
REGIONS = [
    ("Full", 35.5, 43.5, -10.5, -5.5),
    ("Northern", 40.5, 42.5, -9.5, -6.0),
    ("Central", 38.5, 40.5, -9.5, -6.5),
    ("Southern", 36.0, 38.5, -9.0, -6.5),
]

# Land-cover class codes of the 10 m world product.
LANDCOVER_CLASSES = {
    10: "Tree cover",
    20: "Shrubland",
    30: "Grassland",
    40: "Cropland",
    50: "Built-up",
    60: "Bare / sparse vegetation",
    70: "Snow and ice",
    80: "Permanent water bodies",
    90: "Herbaceous wetland",
    95: "Mangroves",
    100: "Moss and lichen",
}

# Fire-danger band edges.
FINE_BANDS = [0, 5, 12, 24, 38, 50, 100]
COARSE_BANDS = [0, 5, 10, 20, 30, 50, 100]
MAP_LEVELS = [0, 5, 12, 24, 38, 50, 75, 100]

# Feature category -> keywords.
FEATURE_CATEGORIES = {
    "Temperature": ["temp", "temperature", "2m"],
    "Humidity": ["humidity", "rh", "dewpoint"],
    "Wind": ["wind", "u_component", "v_component", "speed", "u10", "v10"],
    "Precipitation": ["precip", "rain", "precipitation", "tp"],
    "Pressure": ["pressure", "msl", "sp"],
    "Radiation": ["radiation", "solar", "ssr"],
    "Spatial": ["spatial", "distance", "lat", "lon"],
    "Gradient": ["gradient"],
    "Variability": ["variability", "range", "std"],
}

# Summary category -> keywords; a feature counts in the first category that matches.
SUMMARY_CATEGORIES = {
    "Temperature": ["temp", "2m"],
    "Humidity": ["humidity", "rh", "dewpoint"],
    "Wind": ["wind", "component", "speed"],
    "Precipitation": ["precip", "rain", "tp"],
    "Spatial": ["spatial", "distance", "lat", "lon"],
    "Gradient": ["gradient"],
    "Variability": ["variability", "var", "std", "range"],
}

# Display names: ordered replacements.
NAME_REPLACEMENTS = [
    ("feature_downscaled_", ""),
    ("feature_gradient_", "grad_"),
    ("feature_spatial_", "spatial_"),
    ("_variability", "_var"),
    ("_spatial_range", "_s_range"),
    ("temperature", "temp"),
    ("humidity", "humid"),
    ("precipitation", "precip"),
    ("u_component", "u_comp"),
    ("v_component", "v_comp"),
    ("surface_pressure", "surf_press"),
    ("total_precipitation", "tot_precip"),
    ("2m_temperature", "2m_temp"),
    ("surface_net_solar_radiation", "net_solar"),
    ("distance_to_50km", "dist_50km"),
    ("num_50km_points", "n_50km_pts"),
    ("lat_50km", "lat_50k"),
    ("lon_50km", "lon_50k"),
]

KM_PER_DEGREE = 111.32
KM_PER_DEGREE_LAT = 110.574
KM_PER_DEGREE_LON = 111.320
KELVIN_OFFSET = 273.15
# -----------------------------------------------------------------------------------------------
