"""Column layouts shared by all modules.

A *tile* is one row: a box of voxels in absolute coordinates plus its payload.
``pixels`` holds ``x_dim * y_dim * z_dim`` unsigned grey values, z-major, then y, then x.
"""

from pyspark.sql import types as T

AXES = ("x", "y", "z")
ORIGIN = ["x", "y", "z"]
DIMS = ["x_dim", "y_dim", "z_dim"]
BOX = ORIGIN + DIMS
EXTENT = ["width", "height", "depth"]
VOLUME = ["image_id", "zoom_out"]
TILE_KEY = VOLUME + BOX
TILE_META = ["image_id", "name", "zoom_out"] + BOX

TILES = T.StructType(
    [
        T.StructField("image_id", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("zoom_out", T.IntegerType()),
        *[T.StructField(c, T.IntegerType()) for c in BOX],
        T.StructField("pixels", T.BinaryType()),
    ]
)

VOXELS = T.StructType([T.StructField(c, T.IntegerType()) for c in ["image_id", "x", "y", "z", "v"]])

# One request line of text holds these eight integers.
ROI_LINE = T.StructType(
    [T.StructField(c, T.IntegerType()) for c in VOLUME + ORIGIN + EXTENT]
)

ROI = T.StructType([T.StructField("req_id", T.LongType()), *ROI_LINE.fields])

IMAGES = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])
