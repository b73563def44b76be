"""Declarative analytics over gridded and polygon data on Spark."""

from gridloom.functions.api import *  # noqa: F403
from gridloom.functions.dtypes import DataType
from gridloom.operators.mosaic import Mosaic, MosaicEmpty
from gridloom.operators.regrid import ResamplingMethod
from gridloom.plans.geometry import Area, MapProjection, Window
from gridloom.plans.layer import Layer, find_intersection, find_union
from gridloom.sources.grids import InvalidRasterBand, area_raster, constant, empty_raster, empty_raster_like, from_array, from_table, h3_tile, read_narrow_raster, read_raster, read_raster_like, read_rasters
from gridloom.sources.sinks import bands_to_parquet, to_geotiff
from gridloom.sources.vectors import read_shape, read_shape_like, rectangles
