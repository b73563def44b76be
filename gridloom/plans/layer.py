"""Layers: lazily computed grids, their expression trees, and the lowering of a tree to one DataFrame plan.

Only a tree's leaves read data.  An action decides the final rectangle of pixels from the operators' footprints, reads
each leaf within that rectangle (the bounds reach the scans), brings the leaves together on (y, x) and computes
the whole pixel-wise tree in one projection.  Leaves of one table are columns of one scan; formulas of the row number
and constants are no relations at all.
"""

from __future__ import annotations

import itertools
import math
import operator as python_operator
import uuid
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.dtypes import DataType
from gridloom.functions.pointwise import OPERATORS, Footprint, Value
from gridloom.plans.geometry import Area, MapProjection, Window

MISMATCH = "layers and areas must have one projection and pixel step"
#: Pixels of the largest array that is gathered on the driver.
MOST_PIXELS = 1 << 28
#: Pixels of the largest window that may be broadcast.
MOST_BROADCAST = 1 << 20


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def within(df: DataFrame, w: Window) -> DataFrame:
    """The pixels of a window; the bounds are plain comparisons, so scans can prune by them."""
    return df.filter((F.col("y") >= w.yoff) & (F.col("y") < w.yend) & (F.col("x") >= w.xoff) & (F.col("x") < w.xend))


def lattice(w: Window) -> DataFrame:
    """(y, x) of every pixel of a window, made without a scan."""
    cells = session().range(w.xsize * w.ysize)
    return cells.select(F.expr(f"id div {w.xsize} + {w.yoff}").alias("y"), F.expr(f"id % {w.xsize} + {w.xoff}").alias("x"))


def joinable(df: DataFrame, w: Window) -> DataFrame:
    """The pixels of a window to be joined to others; only if they are few may they be broadcast.

    Spark goes by the size of files, which says nothing of how many pixels are made of them.
    """
    return df.hint("merge") if w.xsize * w.ysize > MOST_BROADCAST else df


def kind_of(df: DataFrame, column: str = "v") -> str:
    name = df.schema[column].dataType.simpleString()
    return "b" if name == "boolean" else "f" if name in ("float", "double") else "i"


class Layer:
    """What all layers can do.  Subclasses give children, area and values."""

    children: tuple[Layer, ...] = ()
    name: str = ""

    # ------------------------------------------------------------------------------------------------- metadata
    def _area(self, forced: bool = False) -> Area:
        raise NotImplementedError

    @property
    def area(self) -> Area:
        """The footprint.  If constants make it the whole world, it is taken again without them."""
        area = self._area()
        return self._area(True) if area.is_world else area

    @property
    def projection(self) -> MapProjection | None:
        return next((p for c in self.children if (p := c.projection) is not None), None)

    @property
    def dimensions(self) -> tuple[int, int]:
        """(width, height) in pixels; AttributeError without a projection."""
        if self.projection is None:
            raise AttributeError("the layer has no projection")
        return self.area.pixel_dimensions

    @property
    def datatype(self) -> DataType:
        return DataType.joint([c.datatype for c in self.children])

    @property
    def nodata(self) -> float | None:
        return None

    @property
    def window(self) -> Window:
        """The final rectangle in lattice cells."""
        area = self.area
        if area.is_world or area.projection is None:
            raise ValueError("the layer has no projection, so its pixels are not defined")
        return area.window

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def close(self) -> None:
        """Nothing is held open; here so that layers work in with statements."""

    def park(self) -> None:
        """Nothing is held open: a layer of files can be pickled as it is, and reads them where it is used."""

    unpark = park

    # ------------------------------------------------------------------------------------------------ operators
    def _binary(self, name: str, other: object, swapped: bool = False) -> Layer:
        other = as_layer(other)
        return Expression(name, (other, self) if swapped else (self, other))

    def _unary(self, name: str, **params) -> Layer:
        return Expression(name, (self,), params)

    def __hash__(self) -> int:
        return id(self)

    def abs(self) -> Layer:
        return self._unary("abs")

    def floor(self) -> Layer:
        return self._unary("floor")

    def ceil(self) -> Layer:
        return self._unary("ceil")

    def round(self) -> Layer:
        """To the nearest whole number, halves to the even one."""
        return self._unary("round")

    def log(self) -> Layer:
        return self._unary("log")

    def log2(self) -> Layer:
        return self._unary("log2")

    def log10(self) -> Layer:
        return self._unary("log10")

    def exp(self) -> Layer:
        return self._unary("exp")

    def exp2(self) -> Layer:
        return self._unary("exp2")

    def isnan(self) -> Layer:
        return self._unary("isnan")

    def nan_to_num(self, nan: float = 0.0, posinf: float | None = None, neginf: float | None = None) -> Layer:
        """infinities become the given values, or the ends of the declared type's range."""
        low, top = self.datatype.limits
        return self._unary("nan_to_num", nan=nan, posinf=float(top) if posinf is None else posinf, neginf=float(low) if neginf is None else neginf)

    def isin(self, test_elements: Iterable) -> Layer:
        return self._unary("isin", elements=tuple(e.item() if isinstance(e, np.generic) else e for e in test_elements))

    def clip(self, min: float | None = None, max: float | None = None) -> Layer:
        return self._unary("clip", low=min, high=max)

    def as_type(self, datatype: DataType) -> Layer:
        return self._unary("as_type", datatype=datatype)

    def logical_and(self, other: object) -> Layer:
        return self._binary("logical_and", other)

    def logical_or(self, other: object) -> Layer:
        return self._binary("logical_or", other)

    def logical_xor(self, other: object) -> Layer:
        return self._binary("logical_xor", other)

    def logical_not(self) -> Layer:
        return self._unary("logical_not")

    def conv2d(self, weights) -> Layer:
        """Cross-correlation with an odd square kernel; beyond the data are zeros."""
        from gridloom.operators.convolve import Convolved

        return Convolved(self, weights)

    def as_area(self, area: Area | Layer) -> Layer:
        """The same data with another footprint: cut, or widened with zeros.  The last one counts."""
        if isinstance(area, Layer):
            area = area.area
        if not isinstance(area, Area):
            raise TypeError("as_area takes an area or a layer")
        own = self.projection
        if area.projection is None:
            if own is None:
                raise ValueError("neither the layer nor the area has a projection")
            area = area.project_like(own if self.area.is_world else self.area)
        elif own is not None and own != area.projection:
            raise ValueError(MISMATCH)
        return Recast(self, area)

    def as_projection(self, projection: MapProjection, method=None) -> Layer:
        from gridloom.operators.regrid import Reprojected, ResamplingMethod

        return Reprojected(self, projection, method or ResamplingMethod.Nearest)

    def latlng_for_pixel(self, x: int, y: int) -> tuple[float, float]:
        """(latitude, longitude) of the top-left corner of pixel x, y of the layer."""
        from gridloom.plans import crs

        left, xstep, _, top, _, ystep = self.area.geo_transform
        lng, lat = crs.to_lonlat(self.projection.name, x * xstep + left, y * ystep + top)
        return float(lat), float(lng)

    def pixel_for_latlng(self, lat: float, lng: float) -> tuple[int, int]:
        """The pixel (x, y) of the layer that holds a point."""
        from gridloom.plans import crs

        left, xstep, _, top, _, ystep = self.area.geo_transform
        x, y = crs.from_lonlat(self.projection.name, lng, lat)
        snug = lambda v: round(v) if abs(v - round(v)) < 1e-6 else math.floor(v)
        return int(snug((float(x) - left) / xstep)), int(snug((float(y) - top) / ystep))

    # -------------------------------------------------------------------------------------------------- actions
    def frame(self, window: Window | None = None, sparse: bool = False) -> DataFrame:
        """(y, x, v) on the lattice: v is bigint (whole numbers, truths) or double.

        sparse: pixels outside all leaves may be missing, which is allowed only where they would be 0.
        """
        w = self.window if window is None else window
        rows, value = lower(self, w, sparse)
        return rows.select("y", "x", value.number.alias("v"))

    def sum(self, callback: Callable[[float], None] | None = None) -> float:
        return _scalar(self.sum_frame(), callback)

    def sum_frame(self) -> DataFrame:
        """One row, one column: the sum in double precision; NaN if there is one, 0 without pixels."""
        rows = self.frame(sparse=at_zero(self) == 0)
        return rows.agg(F.coalesce(F.sum(F.col("v").cast("double")), F.lit(0.0)).alias("sum"))

    parallel_sum = sum

    def min(self) -> float:
        return _scalar(self.extreme_frame("min"))

    def max(self) -> float:
        return _scalar(self.extreme_frame("max"))

    def extreme_frame(self, which: str) -> DataFrame:
        """One row: the least or greatest pixel; NaN pixels don't count (inf or -inf if there are no others)."""
        v = F.col("v").cast("double")
        best = (F.min if which == "min" else F.max)(F.when(~F.isnan(v), v))
        return self.frame().agg(F.coalesce(best, F.lit(math.inf if which == "min" else -math.inf)).alias(which))

    def unique(self, return_counts: bool = False, most: int = 10_000_000):
        """Sorted distinct values (NaN once, last), with ``return_counts`` also how often each occurs.

        They come to the driver: ValueError if there are more than ``most``; ``unique_frame`` has no such bound.
        """
        rows = self.unique_frame().orderBy("v").limit(most + 1).toPandas()
        if len(rows) > most:
            raise ValueError(f"more than {most} distinct values: use unique_frame")
        return (rows["v"].to_numpy(), rows["n"].to_numpy()) if return_counts else rows["v"].to_numpy()

    def unique_frame(self) -> DataFrame:
        """(v, n): the histogram of values, unordered."""
        return self.frame().groupBy("v").agg(F.count("*").alias("n"))

    def read_array(self, x: int, y: int, width: int, height: int) -> np.ndarray:
        """The pixels of a rectangle, counted from the layer's top-left; outside everything they are computed of zeros."""
        if width <= 0 or height <= 0:
            raise ValueError("width and height must be positive")
        w = self.window
        return densify(self.frame(Window(w.xoff + x, w.yoff + y, width, height)), Window(w.xoff + x, w.yoff + y, width, height))

    def array(self) -> np.ndarray:
        return self.read_array(0, 0, *self.dimensions)

    def show(self, ax=None, max_pixels: int = 1000, **kwargs):
        """Draw every n-th pixel with matplotlib, at most ``max_pixels`` each way."""
        import matplotlib.pyplot as plt

        return (ax or plt.gca()).imshow(self.thumbnail(max_pixels), **kwargs)

    def thumbnail_frame(self, max_pixels: int = 1000) -> DataFrame:
        """(y, x, v): every n-th pixel, numbered from 0."""
        w = self.window
        n = max(1, max(w.xsize, w.ysize) // max_pixels)
        y, x = F.col("y") - w.yoff, F.col("x") - w.xoff
        return self.frame().filter((y % n == 0) & (x % n == 0)).select((y / n).cast("bigint").alias("y"), (x / n).cast("bigint").alias("x"), "v")

    def thumbnail(self, max_pixels: int = 1000) -> np.ndarray:
        w = self.window
        n = max(1, max(w.xsize, w.ysize) // max_pixels)
        return densify(self.thumbnail_frame(max_pixels), Window(0, 0, -(-w.xsize // n), -(-w.ysize // n)))

    def to_parquet(self, path: str, nodata: float | None = None, and_sum: bool = False) -> float | None:
        from gridloom.sources.sinks import to_parquet

        return to_parquet(self, path, nodata, and_sum)

    def save(self, destination, area: Area | Layer | None = None, and_sum: bool = False, callback: Callable[[float], None] | None = None, band: int = 1) -> float | None:
        """Write the layer, over ``area`` if one is given: a GeoTIFF file if the name ends so, else a Parquet grid.

        destination may also be a layer that was read from a file: then its ``band`` is replaced, and its area and type win.
        """
        if isinstance(destination, Layer):
            from gridloom.sources.grids import replace_band

            return replace_band(self if area is None else self.as_area(area), destination, band, and_sum, callback)
        layer = self if area is None else self.as_area(area)
        if str(destination).lower().endswith((".tif", ".tiff")):
            return layer.to_geotiff(destination, and_sum, callback=callback)
        if callback:
            callback(0.0)
        out = layer.to_parquet(str(destination), and_sum=and_sum)
        if callback:
            callback(1.0)
        return out

    parallel_save = save

    def to_geotiff(self, filename, and_sum: bool = False, parallelism=None, callback=None, nodata: float | None = None, sparse: bool = False) -> float | None:
        from gridloom.sources.sinks import layer_to_geotiff

        return layer_to_geotiff(self, filename, and_sum, callback, nodata, sparse)

    def describe(self) -> str:
        return self.name or type(self).__name__

    def pretty_print(self) -> str:
        """The tree as indented text; it is printed and returned."""

        def lines(node: Layer, depth: int) -> Iterable[str]:
            yield "  " * depth + node.describe()
            for c in node.children:
                yield from lines(c, depth + 1)

        text = "\n".join(lines(self, 0))
        print(text)
        return text

    def to_graphviz(self) -> str:
        """The tree in DOT; equal parts are one node."""
        numbers: dict = {}
        out: list[str] = []

        def visit(node: Layer) -> int:
            if node.key in numbers:
                return numbers[node.key]
            own = numbers[node.key] = len(numbers)
            out.append(f'  n{own} [label="{node.describe()}"];')
            for c in node.children:
                out.append(f"  n{own} -> n{visit(c)};")
            return own

        visit(self)
        return "digraph {\n" + "\n".join(out) + "\n}"

    @property
    def key(self):
        """Equal for layers that are sure to hold the same data."""
        return id(self)


def _dunder(name: str, swapped: bool):
    return lambda self, other: self._binary(name, other, swapped)


for _name, _method in {"add": "add", "sub": "sub", "mul": "mul", "truediv": "truediv", "floordiv": "floordiv", "mod": "mod", "pow": "pow"}.items():
    setattr(Layer, f"__{_method}__", _dunder(_name, False))
    setattr(Layer, f"__r{_method}__", _dunder(_name, True))
for _name, _method in {"eq": "eq", "ne": "ne", "lt": "lt", "le": "le", "gt": "gt", "ge": "ge", "bit_and": "and", "bit_or": "or", "lshift": "lshift", "rshift": "rshift"}.items():
    setattr(Layer, f"__{_method}__", _dunder(_name, False))
for _name in ("neg", "pos"):
    setattr(Layer, f"__{_name}__", lambda self, n=_name: self._unary(n))


def _scalar(df: DataFrame, callback: Callable[[float], None] | None = None) -> float:
    if callback:
        callback(0.0)
    out = df.first()[0]
    if callback:
        callback(1.0)
    return out


def densify(df: DataFrame, w: Window) -> np.ndarray:
    """The pixels of a window as an array; what has no row is 0."""
    if w.xsize * w.ysize > MOST_PIXELS:
        raise ValueError(f"more than {MOST_PIXELS} pixels don't go to the driver: use frame, or save the layer")
    rows = df.toPandas()
    kind = np.float64 if kind_of(df) == "f" else np.int64
    out = np.zeros((w.ysize, w.xsize), kind)
    out[rows["y"].to_numpy(np.int64) - w.yoff, rows["x"].to_numpy(np.int64) - w.xoff] = rows["v"].to_numpy(kind)
    return out


# -------------------------------------------------------------------------------------------------------- leaves
class Literal(Layer):
    """A plain number in an expression."""

    def __init__(self, value):
        if isinstance(value, np.ndarray):
            if value.ndim:
                raise ValueError("arrays can't be operands; make a layer of them with from_array")
            value = value[()]
        if isinstance(value, np.generic):
            self._datatype, value = DataType.of_literal(value), value.item()
        else:
            self._datatype = DataType.of_literal(value)
        if not isinstance(value, (int, float, bool)):
            raise ValueError(f"{value!r} is no number")
        self.value = value

    def _area(self, forced: bool = False) -> Area:
        return Area.world()

    @property
    def datatype(self) -> DataType:
        return self._datatype

    @property
    def key(self):
        return ("literal", self._datatype, self.value)

    def describe(self) -> str:
        return repr(self.value)

    def value_at(self, y: Column, x: Column) -> Value:
        if isinstance(self.value, bool):
            return Value(F.lit(self.value), "b")
        return Value(F.lit(self.value).cast("double" if isinstance(self.value, float) else "bigint"), "f" if isinstance(self.value, float) else "i")


class Constant(Literal):
    """A constant layer: everywhere, always Float64."""

    def __init__(self, value):
        super().__init__(float(value))


class Formula(Layer):
    """A leaf that is computed from the pixel's numbers alone.  formula: (y, x) columns to a Value."""

    def __init__(self, formula: Callable[[Column, Column], Value], area: Area, datatype: DataType, name: str = "", key=None):
        self.value_at, self._own, self._datatype, self.name = formula, area, datatype, name
        self._key = key

    def _area(self, forced: bool = False) -> Area:
        return self._own

    @property
    def projection(self) -> MapProjection | None:
        return self._own.projection

    @property
    def datatype(self) -> DataType:
        return self._datatype

    @property
    def key(self):
        return self._key or id(self)


class Data(Layer):
    """A leaf with rows: ``pixels`` gives those of a window as (y, x, v); what has no row is 0."""

    #: Every pixel of the layer's area has a row; complete: every pixel of any window that is asked for has one.
    dense = False
    complete = False

    def __init__(self, area: Area, datatype: DataType, nodata: float | None = None, name: str = ""):
        self._own, self._datatype, self._nodata = area, datatype, nodata
        self.name = name or uuid.uuid4().hex

    def _area(self, forced: bool = False) -> Area:
        return self._own

    @property
    def projection(self) -> MapProjection | None:
        return self._own.projection

    @property
    def datatype(self) -> DataType:
        return self._datatype

    @property
    def nodata(self) -> float | None:
        return self._nodata

    def pixels(self, w: Window) -> DataFrame:
        raise NotImplementedError


class PixelTable:
    """A DataFrame with y, x and one column for each band; layers made of it share scans.

    rows: y and x are lattice cell numbers, one row each.  dense: every cell of the area has a row.
    """

    _numbers = itertools.count()

    def __init__(self, rows: DataFrame, dense: bool = False, key=None):
        self.rows, self.dense = rows, dense
        self.key = key if key is not None else next(self._numbers)

    def kind(self, band: str) -> str:
        return kind_of(self.rows, band)

    def within(self, w: Window, bands: Sequence[str]) -> DataFrame:
        """At least y, x and ``bands`` of the pixels of a window."""
        return within(self.rows, w)

    def __reduce__(self):
        raise TypeError("layers of tables in memory can't be pickled")


class TableLayer(Data):
    """One band of a PixelTable.  Values equal to nodata are NaN unless they are to be kept."""

    def __init__(self, table: PixelTable, band: str, area: Area, datatype: DataType, nodata: float | None = None, ignore_nodata: bool = False, name: str = ""):
        super().__init__(area, datatype, nodata, name or band)
        self.table, self.band, self.masked = table, band, nodata is not None and not ignore_nodata

    @property
    def key(self):
        return ("table", self.table.key, self.band, self.masked and self._nodata)

    @property
    def dense(self) -> bool:
        return self.table.dense

    @property
    def value(self) -> Column:
        kind = "double" if self.table.kind(self.band) == "f" else "bigint"
        v = F.col(self.band).cast(kind)
        if not self.masked:
            return v
        if isinstance(self._nodata, float) and math.isnan(self._nodata):
            return v
        return F.when(v == F.lit(self._nodata).cast("double"), F.lit(math.nan)).otherwise(v.cast("double"))

    def pixels(self, w: Window) -> DataFrame:
        return self.table.within(w, [self.band]).select("y", "x", self.value.alias("v"))


class RowLayer(Data):
    """A raster one pixel wide whose values hold for the whole row: (y, v), joined on y and never widened."""

    def __init__(self, rows: DataFrame, area: Area, datatype: DataType, nodata: float | None = None, name: str = ""):
        super().__init__(area, datatype, nodata, name)
        v = F.col("v").cast("double" if kind_of(rows) == "f" else "bigint")
        if nodata is not None:
            v = F.when(v == F.lit(nodata).cast("double"), F.lit(math.nan)).otherwise(v.cast("double"))
        self.rows = rows.select("y", v.alias("v"))


# --------------------------------------------------------------------------------------------------- expressions
def as_layer(value: object) -> Layer:
    if value is None:
        raise ValueError("None is no operand")
    return value if isinstance(value, Layer) else Literal(value)


class Expression(Layer):
    """An operator over layers.  Literals, projections and operator names are checked when it is built."""

    def __init__(self, op: str, children: Sequence[object], params: dict | None = None):
        self.op, self.params = OPERATORS[op], params or {}
        self.children = tuple(as_layer(c) for c in children)
        known = [p for c in self.children if (p := c.projection) is not None]
        if any(p != known[0] for p in known):
            raise ValueError(MISMATCH)

    def _area(self, forced: bool = False) -> Area:
        areas = [c._area(forced) for c in self.children]
        if forced:
            areas = [a for a in areas if not a.is_world] or [Area.world()]
        if self.op.footprint is Footprint.FIRST:
            return areas[0]
        if self.op.footprint is Footprint.UNION:
            return reduce(python_operator.or_, areas)
        try:
            return reduce(python_operator.and_, areas)
        except ValueError:
            if not forced:
                raise
            return reduce(python_operator.or_, areas)

    @property
    def datatype(self) -> DataType:
        return self.params["datatype"] if self.op.name == "as_type" else super().datatype

    @property
    def key(self):
        return (self.op.name, tuple(sorted((k, str(v)) for k, v in self.params.items())), tuple(c.key for c in self.children))

    def describe(self) -> str:
        return self.op.name + (f" {self.params}" if self.params else "")

    def __reduce__(self):
        return Expression, (self.op.name, self.children, self.params)


class Recast(Layer):
    """The same values under another footprint."""

    def __init__(self, child: Layer, area: Area):
        self.children, self._own = (child,), area

    def _area(self, forced: bool = False) -> Area:
        return self._own

    @property
    def projection(self) -> MapProjection | None:
        return self._own.projection or self.children[0].projection

    @property
    def nodata(self) -> float | None:
        return self.children[0].nodata

    @property
    def key(self):
        return self.children[0].key  # pixel values don't depend on the footprint

    def describe(self) -> str:
        return "as_area"


_AT_ZERO = {"add": python_operator.add, "sub": python_operator.sub, "mul": python_operator.mul, "eq": python_operator.eq, "ne": python_operator.ne, "lt": python_operator.lt, "le": python_operator.le, "gt": python_operator.gt, "ge": python_operator.ge, "bit_and": lambda a, b: int(a) & int(b), "bit_or": lambda a, b: int(a) | int(b), "logical_and": lambda a, b: bool(a) and bool(b), "logical_or": lambda a, b: bool(a) or bool(b), "logical_xor": lambda a, b: bool(a) != bool(b), "logical_not": lambda a: not a, "maximum": max, "minimum": min, "where": lambda c, a, b: a if c else b}


def at_zero(node: Layer) -> float | None:
    """What a tree gives where all its data is 0; None if that isn't known."""
    if isinstance(node, Literal):
        return node.value
    if isinstance(node, Formula):
        return None
    if isinstance(node, Data):
        return None if isinstance(node, RowLayer) or any(at_zero(c) != 0 for c in node.children) else 0
    if isinstance(node, Recast):
        return at_zero(node.children[0])
    if not isinstance(node, Expression):
        return None
    values = [at_zero(c) for c in node.children]
    name = node.op.name
    if any(v is None for v in values):
        return None
    if name in _AT_ZERO:
        return float(_AT_ZERO[name](*values))
    if name == "isin":
        return float(values[0] in node.params["elements"])
    if name == "clip":
        low, high = node.params["low"], node.params["high"]
        return min(max(values[0], values[0] if low is None else low), math.inf if high is None else high)
    return 0.0 if node.op.keeps_zero and not any(values) else None


# ------------------------------------------------------------------------------------------------------ lowering
def leaves(node: Layer) -> Iterable[Layer]:
    if isinstance(node, (Data, Formula, Literal)):
        yield node
    else:
        for c in node.children:
            yield from leaves(c)


def lower(root: Layer, w: Window, sparse: bool = False) -> tuple[DataFrame, Value]:
    """(rows with y, x and the leaves' columns, the tree's value over them) for the pixels of a window."""
    columns: dict = {}
    tables: dict = {}
    others: list[Data] = []
    rows_of: list[RowLayer] = []
    for leaf in leaves(root):
        if not isinstance(leaf, Data) or leaf.key in columns:
            continue
        columns[leaf.key] = f"l{len(columns)}"
        if isinstance(leaf, TableLayer):
            tables.setdefault(leaf.table.key, []).append(leaf)
        elif isinstance(leaf, RowLayer):
            rows_of.append(leaf)
        else:
            others.append(leaf)
    kinds: dict = {}
    parts: list[tuple[DataFrame, list[str], bool]] = []  # rows, columns, whether every pixel of the window has a row
    for group in tables.values():
        df = group[0].table.within(w, [leaf.band for leaf in group]).select("y", "x", *[leaf.value.alias(columns[leaf.key]) for leaf in group])
        full = all(leaf.dense and leaf.area.window.contains(w) for leaf in group)
        parts.append((df, [columns[leaf.key] for leaf in group], full))
    for leaf in others:
        df = leaf.pixels(w).select("y", "x", F.col("v").alias(columns[leaf.key]))
        parts.append((df, [columns[leaf.key]], leaf.complete or leaf.dense and leaf.area.window.contains(w)))
    for df, names, _ in parts:
        kinds |= {n: kind_of(df, n) for n in names}

    parts.sort(key=lambda p: not p[2])
    if parts and parts[0][2]:
        rows = parts[0][0]
        for df, _, _ in parts[1:]:
            rows = rows.join(joinable(df, w), ["y", "x"], "left")
    elif sparse and len(parts) == 1:
        rows = parts[0][0]
    elif parts and (sparse or len(parts) > 1):  # a row from any part is enough: one shuffle for all of them
        every = [n for _, names, _ in parts for n in names]
        stack = [df.select("y", "x", *[(F.col(n) if n in names else F.lit(None).cast("double" if kinds[n] == "f" else "boolean" if kinds[n] == "b" else "bigint")).alias(n) for n in every]) for df, names, _ in parts]
        if not sparse:
            stack.append(lattice(w).select("y", "x", *[F.lit(None).cast("double" if kinds[n] == "f" else "boolean" if kinds[n] == "b" else "bigint").alias(n) for n in every]))
        rows = reduce(DataFrame.union, stack).groupBy("y", "x").agg(*[F.max(n).alias(n) for n in every])
    else:
        rows = lattice(w)
        for df, _, _ in parts:
            rows = rows.join(joinable(df, w), ["y", "x"], "left")
    for leaf in rows_of:
        n = columns[leaf.key]
        kinds[n] = kind_of(leaf.rows)
        own = leaf.rows.filter((F.col("y") >= w.yoff) & (F.col("y") < w.yend))
        rows = rows.join(own.select("y", F.col("v").alias(n)), "y", "left")  # one row a raster row: small beside the pixels

    done: dict = {}

    def value(node: Layer) -> Value:
        if node.key not in done:
            if isinstance(node, (Literal, Formula)):
                out = node.value_at(F.col("y"), F.col("x"))
            elif isinstance(node, Data):
                n = columns[node.key]
                zero = F.lit(False) if kinds[n] == "b" else F.lit(0.0) if kinds[n] == "f" else F.lit(0)
                out = Value(F.coalesce(F.col(n), zero.cast("double" if kinds[n] == "f" else "boolean" if kinds[n] == "b" else "bigint")), kinds[n])
            elif isinstance(node, Recast):
                out = value(node.children[0])
            else:
                out = node.op.kernel(*[value(c) for c in node.children], **node.params)
            done[node.key] = out
        return done[node.key]

    return rows, value(root)


def find_union(layers: Sequence[Layer]) -> Area:
    """The box round all layers; those that are everywhere don't count."""
    areas = [a for layer in layers if not (a := layer.area).is_world]
    if not areas:
        raise ValueError("at least one layer must have an area")
    return reduce(python_operator.or_, areas)


def find_intersection(layers: Sequence[Layer]) -> Area:
    if not layers:
        raise ValueError("no layers")
    return reduce(python_operator.and_, [layer.area for layer in layers])
