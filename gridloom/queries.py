"""The queries of the grid engine over the driver's tables, with the SQL that each must agree with.

Grids (step 1 x -1, so that cell numbers are coordinates): ``elev``, ``code`` and ``price`` lie on the parts (50
columns), ``shift`` is elev moved by 3 rows and 5 columns, ``qty`` and ``cnt`` are sums and counts of lineitem,
``evt`` counts events by day and user, ``emb`` is the embeddings, ``tall`` grows with the scale.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import gridloom as g
from gridloom.functions.dtypes import DataType
from gridloom.plans.geometry import Area, MapProjection, Window
from gridloom.plans.layer import Formula, Layer, RowLayer
from gridloom.sources import sinks
from gridloom.sources.grids import is_uniform_rows, narrowed, rasters_in

UNIT = MapProjection("ESRI:54009", 1.0, -1.0)
METHODS = g.ResamplingMethod
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def parts_of(rows: int) -> int:
    """How many parts to deal rows to whose groups are about as many as they are.

    A task's memory is that of one part: 2^18 rows up to 200 parts, which Spark writes without sorting them, then up to 2^21.
    """
    return max(1, min(-(-rows >> 18), 200), -(-rows >> 21))


class Grids:
    """The layers, made when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def height(self) -> int:
        return self.table("part").agg(F.max("p_partkey")).first()[0] // 50 + 1

    def part(self, *bands: str, dy: int = 0, dx: int = 0, nodata: float | None = None, ignore_nodata: bool = False):
        code = F.create_map(*[F.lit(v) for pair in (("ECONOMY", 1), ("LARGE", 2), ("MEDIUM", 3), ("PROMO", 4), ("SMALL", 5)) for v in pair])
        rows = self.table("part").select(
            (F.floor(F.col("p_partkey") / 50) + dy).alias("y"), (F.col("p_partkey") % 50 + dx).alias("x"), F.col("p_size").alias("elev"),
            F.coalesce(F.try_element_at(code, F.split("p_type", " ")[0]), F.lit(6)).alias("code"), F.col("p_retailprice").alias("price"),
        )
        window = Window(dx, dy, 50, self.height)
        layers = g.from_table(rows, list(bands), window, UNIT, True, nodata, ignore_nodata, key=("part", self.dir, dy, dx))
        return layers[0] if len(bands) == 1 else layers

    @property
    def elev(self):
        return self.part("elev")

    @property
    def shift(self):
        return self.part("elev", dy=3, dx=5)

    def lineitem(self, what: str, dy: int = 0, dx: int = 0):
        rows = self.table("lineitem").groupBy((F.col("l_suppkey") % 50 + dy).alias("y"), (F.col("l_partkey") % 64 + dx).alias("x")).agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("cnt"))
        return g.from_table(rows, what, Window(dx, dy, 64, 50), UNIT, key=("lineitem", self.dir, dy, dx))

    @property
    def events(self):
        rows = self.table("events").groupBy((F.dayofmonth("ts") - 1).cast("bigint").alias("y"), (F.col("user_id") % 32).alias("x")).agg(F.count("*").alias("v"))
        return g.from_table(rows, "v", Window(0, 0, 32, 31), UNIT)

    @property
    def embeddings(self):
        rows = self.table("embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "v")).select("y", F.col("x").cast("bigint").alias("x"), "v")
        return g.from_table(rows, "v", Window(0, 0, 64, self.table("embeddings").agg(F.max("vec_id")).first()[0] + 1), UNIT, True)

    @property
    def tall(self):
        lines = self.table("lineitem")
        top = lines.agg(F.max("l_orderkey"), F.max("l_linenumber"), F.count("*")).first()
        cells = lines.select(F.col("l_orderkey").alias("y"), F.col("l_linenumber").cast("bigint").alias("x"), "l_quantity")
        rows = cells.repartition(parts_of(top[2]), "y", "x").groupBy("y", "x").agg(F.sum("l_quantity").alias("v"))
        return g.from_table(rows, "v", Window(0, 0, top[1] + 1, top[0] + 1), UNIT, key=("tall", self.dir))

    def rects(self, burn="s_nationkey", where: str | None = None):
        h = self.height
        t = self.table("supplier").select(
            "s_suppkey", "s_nationkey", (F.col("s_suppkey") % 40).cast("double").alias("left"), (-(F.col("s_suppkey") * 7 % h)).cast("double").alias("top"),
            (F.col("s_suppkey") % 40 + 1 + F.col("s_nationkey") % 5).cast("double").alias("right"), (-(F.col("s_suppkey") * 7 % h + 1 + F.col("s_suppkey") % 3)).cast("double").alias("bottom"),
        )
        return g.rectangles(t, UNIT, burn, "s_suppkey", where, datatype=DataType.Int64 if isinstance(burn, str) else None)


# --------------------------------------------------------------------------------------------- SQL of the same grids
ELEV = "select p_partkey // 50 as y, p_partkey % 50 as x, cast(p_size as bigint) as v from part"
PRICE = "select p_partkey // 50 as y, p_partkey % 50 as x, p_retailprice as v from part"
CODE = """select p_partkey // 50 as y, p_partkey % 50 as x, case split_part(p_type, ' ', 1) when 'ECONOMY' then 1 when 'LARGE' then 2
    when 'MEDIUM' then 3 when 'PROMO' then 4 when 'SMALL' then 5 else 6 end as v from part"""
SHIFT = "select p_partkey // 50 + 3 as y, p_partkey % 50 + 5 as x, cast(p_size as bigint) as v from part"
QTY = "select l_suppkey % 50 as y, l_partkey % 64 as x, sum(l_quantity) as v from lineitem group by 1, 2"
CNT = "select l_suppkey % 50 + 10 as y, l_partkey % 64 + 8 as x, count(*) as v from lineitem group by 1, 2"
EVT = "select cast(day(ts) - 1 as bigint) as y, user_id % 32 as x, count(*) as v from events group by 1, 2"
EMB = "select vec_id as y, cast(i - 1 as bigint) as x, embedding[i] as v from (select vec_id, embedding, unnest(generate_series(1, 64)) as i from embeddings)"
TALL = "select l_orderkey as y, cast(l_linenumber as bigint) as x, sum(l_quantity) as v from lineitem group by 1, 2"
H = "(select max(p_partkey) // 50 + 1 from part)"
RECTS = f"""select s_suppkey, s_nationkey, s_suppkey % 40 as x0, s_suppkey * 7 % {H} as y0, s_suppkey % 40 + s_nationkey % 5 as x1,
    s_suppkey * 7 % {H} + s_suppkey % 3 as y1 from supplier"""


def box(y0: str, y1: str, x0: str, x1: str) -> str:
    """All cells with y0 <= y < y1 and x0 <= x < x1."""
    return f"select y, x from (select unnest(generate_series({y0}, {y1} - 1)) as y) cross join (select unnest(generate_series({x0}, {x1} - 1)) as x)"


def union_sql(expression: str, a: str = ELEV, b: str = SHIFT, grid: str = box("0", f"{H} + 3", "0", "55")) -> str:
    return f"""with a as ({a}), b as ({b}), g as ({grid}),
        m as (select g.y, g.x, coalesce(a.v, 0) as a, coalesce(b.v, 0) as b from g left join a on g.y = a.y and g.x = a.x left join b on g.y = b.y and g.x = b.x)
        select y, x, {expression} as v from m"""


def shared_sql(expression: str, a: str = ELEV, b: str = SHIFT) -> str:
    return f"""with a as ({a}), b as ({b}), m as (select a.y, a.x, a.v as a, b.v as b from a join b on a.y = b.y and a.x = b.x)
        select y, x, {expression} as v from m"""


def own_sql(expression: str, a: str = ELEV) -> str:
    return f"with m as ({a}) select y, x, {expression} as v from m"


def add(name: str, layer: Callable[[Grids], Layer | DataFrame], sql: str | None) -> None:
    """Register a query; a layer stands for its pixels (y, x, v)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = layer(Grids(spark, sf_dir))
        return out.frame() if isinstance(out, Layer) else out

    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = sql


def truth(condition: str) -> str:
    return f"cast(case when {condition} then 1 else 0 end as bigint)"


def rounded(layer: Layer, digits: int = 6) -> DataFrame:
    return layer.frame().withColumn("v", F.round("v", digits) + F.lit(0.0))


def whole(expression: str) -> str:
    return f"cast({expression} as bigint)"


# ------------------------------------------------------------------------------------------------------- arithmetic
add("add_union", lambda q: q.elev + q.shift, union_sql("a + b"))
add("radd", lambda q: 100 + q.elev, own_sql("100 + v"))
add("sub_union", lambda q: q.elev - q.shift, union_sql("a - b"))
add("rsub", lambda q: 100 - q.elev, own_sql("100 - v"))
add("mul_intersection", lambda q: q.elev * q.shift, shared_sql("a * b"))
add("rmul", lambda q: 3 * q.elev, own_sql("3 * v"))
add("truediv", lambda q: rounded(q.elev / q.shift), shared_sql("round(a / b, 6)"))
add("truediv_by_zero", lambda q: (q.elev - 25) / (q.elev % 5), own_sql("case when v % 5 <> 0 then (v - 25)::double / (v % 5) when v = 25 then 'nan'::double else sign(v - 25) * 'inf'::double end"))
add("rtruediv", lambda q: rounded(100 / q.elev), own_sql("round(100 / v, 6)"))
add("floordiv", lambda q: (q.elev - 25) // 7, own_sql(whole("floor((v - 25) / 7.0)")))
add("rfloordiv", lambda q: -100 // q.elev, own_sql(whole("floor(-100.0 / v)")))
add("mod", lambda q: (q.elev - 25) % -7, own_sql("(((v - 25) % -7) - 7) % -7"))
add("rmod", lambda q: 100 % q.elev, own_sql("100 % v"))
add("pow", lambda q: q.elev**2, own_sql("v * v"))
add("rpow", lambda q: 2.0 ** (q.elev % 10), own_sql("power(2.0::double, v % 10)"))
add("floordiv_big", lambda q: (q.elev * 2**57 + 1) // -3, own_sql("cast(-((v::hugeint * 144115188075855872 + 1 + 2) // 3) as bigint)"))
add("mod_big", lambda q: (q.elev * 2**57 + 1) % 1000003, own_sql("cast((v::hugeint * 144115188075855872 + 1) % 1000003 as bigint)"))
add("pow_big", lambda q: (q.elev + 94906200) ** 2, own_sql("cast((v::hugeint + 94906200) * (v::hugeint + 94906200) as bigint)"))
_wrap = "cast((({}) + 9223372036854775808::hugeint) % 18446744073709551616::hugeint - 9223372036854775808::hugeint as bigint)"
add("mul_wraps", lambda q: q.elev * 2**60, own_sql(_wrap.format("v::hugeint * 1152921504606846976")))
add("add_wraps", lambda q: q.elev + (2**63 - 20), own_sql(_wrap.format("v::hugeint + 9223372036854775788")))
add("neg", lambda q: -q.elev, own_sql("-v"))
add("pos", lambda q: +q.elev, own_sql("v"))
# ------------------------------------------------------------------------------------------------------- comparison
add("eq_intersection", lambda q: q.elev == q.shift, shared_sql(truth("a = b")))
add("ne_union", lambda q: q.elev != q.shift, union_sql(truth("a <> b")))
add("lt", lambda q: q.elev < q.shift, union_sql(truth("a < b")))
add("le", lambda q: q.elev <= q.shift, union_sql(truth("a <= b")))
add("gt", lambda q: q.elev > q.shift, union_sql(truth("a > b")))
add("ge", lambda q: q.elev >= q.shift, union_sql(truth("a >= b")))
add("compare_nan", lambda q: q.part("elev", nodata=13.0) < 20, own_sql(truth("v < 20 and v <> 13")))
# ---------------------------------------------------------------------------------------------------- bits and logic
add("bit_and", lambda q: q.elev & q.shift, shared_sql("a & b"))
add("bit_or", lambda q: q.elev | q.shift, union_sql("a | b"))
add("lshift", lambda q: q.elev << (q.part("code") * 7), f"with e as ({ELEV}), c as ({CODE}) select e.y, e.x, e.v * cast(power(2, 7 * c.v) as bigint) as v from e join c on e.y = c.y and e.x = c.x")
add("rshift", lambda q: q.elev >> 2, own_sql("v >> 2"))
add("logical_and", lambda q: g.logical_and(q.elev % 2, q.shift % 3), shared_sql(truth("a % 2 <> 0 and b % 3 <> 0")))
add("logical_or", lambda q: g.logical_or(q.elev % 2, q.shift % 3), union_sql(truth("a % 2 <> 0 or b % 3 <> 0")))
add("logical_xor", lambda q: g.logical_xor(q.elev % 2, q.shift % 3), union_sql(truth("(a % 2 <> 0) <> (b % 3 <> 0)")))
add("logical_not", lambda q: g.logical_not(q.elev % 3), own_sql(truth("v % 3 = 0")))
# -------------------------------------------------------------------------------------------------------- functions
add("abs", lambda q: g.abs(q.elev - 25), own_sql("abs(v - 25)"))
add("floor", lambda q: g.floor(q.part("price") / 7), own_sql("floor(v / 7)", PRICE))
add("ceil", lambda q: g.ceil(q.part("price") / 7), own_sql("ceil(v / 7)", PRICE))
add("round_even", lambda q: g.round(q.elev / 2), own_sql("round_even(v / 2.0, 0)::double"))
add("log", lambda q: rounded(g.log(q.elev)), own_sql("round(ln(v), 6)"))
add("log_edges", lambda q: rounded(g.log(q.elev - 25) * 0 + (q.elev > 25)), own_sql("case when v = 25 then 'nan'::double when v < 25 then 'nan'::double else 1.0 end"))
add("log2", lambda q: rounded(g.log2(q.elev)), own_sql("round(log2(v), 6)"))
add("log10", lambda q: rounded(g.log10(q.elev)), own_sql("round(log10(v), 6)"))
add("exp", lambda q: rounded(g.exp(q.elev / 50)), own_sql("round(exp(v / 50), 6)"))
add("exp2", lambda q: g.exp2(q.elev), own_sql("power(2.0::double, v)"))
add("isnan", lambda q: q.part("elev", nodata=13.0).isnan(), own_sql(truth("v = 13")))
add("nan_to_num", lambda q: g.nan_to_num(q.part("elev", nodata=13.0), nan=-1), own_sql("case when v = 13 then -1.0::double else v::double end"))
add("isin", lambda q: g.isin(q.part("code"), [1, 3]), own_sql(truth("v in (1, 3)"), CODE))
add("clip", lambda q: g.clip(q.elev, 10, 35), own_sql("least(greatest(v, 10), 35)"))
add("clip_lower", lambda q: g.clip(q.elev, min=10), own_sql("greatest(v, 10)"))
add("clip_upper", lambda q: g.clip(q.elev, max=35), own_sql("least(v, 35)"))
add("as_type", lambda q: (q.part("price") / 7).as_type(DataType.Int32), own_sql(whole("trunc(v / 7)"), PRICE))
add("as_type_wraps", lambda q: (q.elev * 11).as_type(DataType.Byte), own_sql("(v * 11) % 256"))
add("minimum", lambda q: g.minimum(q.elev, q.shift), union_sql("least(a, b)"))
add("maximum", lambda q: g.maximum(q.elev, q.shift), union_sql("greatest(a, b)"))
add("where", lambda q: g.where(q.elev > 25, q.elev, q.shift), f"with a as ({ELEV}), b as ({SHIFT}) select a.y, a.x, case when a.v > 25 then a.v else coalesce(b.v, 0) end as v from a left join b on a.y = b.y and a.x = b.x")
# -------------------------------------------------------------------------------------------------------- footprints
add("world_constant_union", lambda q: q.elev + g.constant(2.5), own_sql("v + 2.5::double"))
add("disjoint_world_product", lambda q: (q.elev.as_area(q.elev.area) + 1) * (q.part("elev", dy=3, dx=60) + 1), union_sql("(a + 1) * (b + 1)", ELEV, SHIFT.replace("+ 5", "+ 60"), box("0", f"{H} + 3", "0", "110")))
add("as_area_clip", lambda q: q.elev.as_area(Area(5.0, -1.0, 25.0, -3.0)), own_sql("v") + " where y between 1 and 2 and x between 5 and 24")
add("as_area_pad", lambda q: q.elev.as_area(Area(-2.0, 2.0, 20.0, -3.0, UNIT)), f"with a as ({ELEV}), g as ({box('-2', '3', '-2', '20')}) select g.y, g.x, coalesce(a.v, 0) as v from g left join a on g.y = a.y and g.x = a.x")
add("as_area_last_wins", lambda q: q.elev.as_area(Area(5.0, -1.0, 6.0, -2.0)).as_area(Area(0.0, 0.0, 50.0, -3.0)), own_sql("v") + " where y < 3")
add("offset_grid_nearest", lambda q: q.elev + g.from_table(q.shift.table.rows, "elev", Window(5, 3, 50, q.height), UNIT, True, offset=(0.4, -0.3)), union_sql("a + b"))
add("inner_footprint", lambda q: (q.elev == q.shift) + q.elev, f"with a as ({ELEV}), b as ({SHIFT}) select a.y, a.x, {truth('a.v = coalesce(b.v, 0)')} + a.v as v from a left join b on a.y = b.y and a.x = b.x")


def _areas(q: Grids, find) -> DataFrame:
    a = find([q.elev, q.shift, g.constant(1)] if find is g.find_union else [q.elev, q.shift])
    return q.spark.createDataFrame([(a.left, a.top, a.right, a.bottom)], "left_x double, top_y double, right_x double, bottom_y double")


add("find_union", lambda q: _areas(q, g.find_union), f"select 0.0::double as left_x, 0.0::double as top_y, 55.0::double as right_x, -({H} + 3)::double as bottom_y")
add("find_intersection", lambda q: _areas(q, g.find_intersection), f"select 5.0::double as left_x, -3.0::double as top_y, 50.0::double as right_x, -{H}::double as bottom_y")
# -------------------------------------------------------------------------------------------------------- aggregates
add("sum", lambda q: (q.lineitem("qty") + q.lineitem("cnt", 10, 8)).sum_frame(), f"select (select sum(v) from ({QTY})) + (select sum(v) from ({CNT}))::double as sum")
add("min", lambda q: q.part("elev", nodata=1.0).extreme_frame("min"), f"select min(v)::double as min from ({ELEV}) where v <> 1")
add("max", lambda q: q.part("elev", nodata=50.0).extreme_frame("max"), f"select max(v)::double as max from ({ELEV}) where v <> 50")
add("unique", lambda q: q.part("code").unique_frame().select("v"), f"select distinct v::bigint as v from ({CODE})")
add("unique_counts", lambda q: q.part("code").unique_frame(), f"select v::bigint as v, count(*) as n from ({CODE}) group by 1")
add("sum_layers", lambda q: g.sum([q.elev, q.shift, q.lineitem("cnt", 10, 8)]), union_sql("a + b", f"select y, x, sum(v)::bigint as v from ({ELEV} union all {SHIFT}) group by 1, 2", CNT, box("0", f"greatest({H} + 3, 60)", "0", "72")).replace("a + b as v", "(a + b)::bigint as v"))
add("any_layers", lambda q: g.any([q.elev % 2, q.shift % 3]), union_sql(truth("a % 2 <> 0 or b % 3 <> 0")))
add("all_layers", lambda q: g.all([q.elev % 2, q.shift % 3]), shared_sql(truth("a % 2 <> 0 and b % 3 <> 0")))
add("sum_tall", lambda q: q.tall.sum_frame(), "select sum(l_quantity) as sum from lineitem")
# --------------------------------------------------------------------------------------------------------- sources
add("scan_raster", lambda q: q.lineitem("qty"), f"with a as ({QTY}), g as ({box('0', '50', '0', '64')}) select g.y, g.x, coalesce(v, 0) as v from g left join a on g.y = a.y and g.x = a.x")
add("scan_sparse", lambda q: q.events, f"with a as ({EVT}), g as ({box('0', '31', '0', '32')}) select g.y, g.x, coalesce(v, 0) as v from g left join a on g.y = a.y and g.x = a.x")
add("scan_band", lambda q: q.part("elev", "code", "price")[2], own_sql("v", PRICE))
add("scan_bands_together", lambda q: (lambda b: b[0] * 10 + b[1])(q.part("elev", "code")), f"with e as ({ELEV}), c as ({CODE}) select e.y, e.x, (e.v * 10 + c.v)::bigint as v from e join c on e.y = c.y and e.x = c.x")
add("scan_nodata", lambda q: q.part("elev", nodata=13.0), own_sql("case when v = 13 then 'nan'::double else v::double end"))
add("scan_ignore_nodata", lambda q: q.part("elev", nodata=13.0, ignore_nodata=True), own_sql("v"))
add("from_array", lambda q: g.from_array([[1, 2, 3], [4, 5, 6]], (2.0, -1.0), UNIT) + 0, "select (i // 3 + 1)::bigint as y, (i % 3 + 2)::bigint as x, (i + 1)::bigint as v from (select unnest(generate_series(0, 5)) as i)")
add("constant_fill", lambda q: g.constant(7).as_area(Area(0.0, 0.0, 4.0, -3.0, UNIT)), f"select y, x, 7.0::double as v from ({box('0', '3', '0', '4')})")


def _narrow(q: Grids) -> Layer:
    rows = q.elev.frame().groupBy("y").agg(F.max("v").alias("v"))
    return q.elev * RowLayer(rows, q.elev.area, DataType.Int64)


add("narrow_broadcast", _narrow, f"with a as ({ELEV}), r as (select y, max(v) as v from a group by y) select a.y, a.x, a.v * r.v as v from a join r on a.y = r.y")
_E = "0.0818191908426215"
_A = lambda f: f"(pi() * 6356752.314245179 * 6356752.314245179 * (ln((1 + {_E} * sin(radians({f}))) / (1 - {_E} * sin(radians({f})))) / (2 * {_E}) + sin(radians({f})) / ((1 + {_E} * sin(radians({f}))) * (1 - {_E} * sin(radians({f}))))))"
add("area_raster_geographic", lambda q: rounded(g.area_raster(MapProjection("EPSG:4326", 10.0, -10.0)), -2), f"select y, x, round(abs(({_A('-10.0 * y')} - {_A('-10.0 * (y + 1)')}) * 10.0 / 360), -2) + 0.0 as v from ({box('-9', '9', '-18', '18')})")
add("area_raster_projected", lambda q: g.area_raster(MapProjection("ESRI:54009", 2.0, -3.0)).as_area(q.elev.area.__class__(0.0, 0.0, 8.0, -9.0)), f"select y, x, 6.0::double as v from ({box('0', '3', '0', '4')})")
# --------------------------------------------------------------------------------------------------------- mosaics
add("group_priority", lambda q: g.Mosaic([q.shift, q.elev]), f"with a as ({ELEV}), b as ({SHIFT}), g as ({box('0', f'{H} + 3', '0', '55')}) select g.y, g.x, coalesce(b.v, a.v, 0)::double as v from g left join a on g.y = a.y and g.x = a.x left join b on g.y = b.y and g.x = b.x")
add("group_nodata_fallthrough", lambda q: g.Mosaic([q.part("elev", nodata=13.0), q.shift]), f"with a as ({ELEV} where p_size <> 13), b as ({SHIFT}), g as ({box('0', f'{H} + 3', '0', '55')}) select g.y, g.x, coalesce(a.v, b.v, 0)::double as v from g left join a on g.y = a.y and g.x = a.x left join b on g.y = b.y and g.x = b.x")


def _tiles(q: Grids, missing: int | None = None) -> Layer:
    h = q.height
    rows = q.elev.table.rows
    n = max(1, h // 4)
    tiles = [g.from_table(rows.filter((F.col("y") >= y) & (F.col("y") < y + n)), "elev", Window(0, y, 50, min(n, h - y)), UNIT, True) for y in range(0, h, n)]
    return g.Mosaic([t for i, t in enumerate(tiles) if i != missing])


add("tiled_mosaic", lambda q: _tiles(q), own_sql("v::double"))
add("tiled_missing_tile", lambda q: _tiles(q, 1), own_sql(f"case when y // greatest(1, {H} // 4) = 1 then 0.0 else v::double end"))
# -------------------------------------------------------------------------------------------------------- re-gridding
BLUR = [[1, 2, 1], [2, 4, 2], [1, 2, 1]]


def conv_sql(a: str, grid: str) -> str:
    return f"""with a as ({a}), k(dy, dx, w) as (values (-1, -1, 1), (-1, 0, 2), (-1, 1, 1), (0, -1, 2), (0, 0, 4), (0, 1, 2), (1, -1, 1), (1, 0, 2), (1, 1, 1)), g as ({grid})
        select g.y, g.x, coalesce(sum(a.v * k.w), 0)::double as v from g cross join k left join a on a.y = g.y + k.dy and a.x = g.x + k.dx group by 1, 2"""


add("conv2d_blur", lambda q: q.elev.conv2d(BLUR), conv_sql(ELEV, box("0", H, "0", "50")))
add("conv2d_expr", lambda q: (q.elev * q.part("code")).conv2d(BLUR), conv_sql(f"select e.y, e.x, e.v * c.v as v from ({ELEV}) e join ({CODE}) c on e.y = c.y and e.x = c.x", box("0", H, "0", "50")))
add("conv2d_row_kernel", lambda q: rounded(q.embeddings.conv2d([[0, 0, 0], [1, 0, -1], [0, 0, 0]]), 4), f"with a as ({EMB}) select a.y, a.x, round(coalesce(l.v::double, 0) - coalesce(r.v::double, 0), 4) + 0.0 as v from a left join a l on l.y = a.y and l.x = a.x - 1 left join a r on r.y = a.y and r.x = a.x + 1")
HALF, DOUBLE = MapProjection("ESRI:54009", 0.5, -0.5), MapProjection("ESRI:54009", 2.0, -2.0)
add("rescale_nearest_up", lambda q: q.elev.as_projection(HALF), f"with a as ({ELEV}), k as ({box('0', '2', '0', '2')}) select a.y * 2 + k.y as y, a.x * 2 + k.x as x, a.v::double as v from a cross join k")
add("rescale_nearest_down", lambda q: q.elev.as_projection(DOUBLE), own_sql("v::double").replace("select y, x", "select y // 2 as y, x // 2 as x") + " where y % 2 = 1 and x % 2 = 1")
_odd = f"with a as ({ELEV}) select y // 2 as y, x // 2 as x, "
_end = " as v from a group by 1, 2"
add("rescale_avg", lambda q: q.elev.as_projection(DOUBLE, METHODS.Average), _odd + "avg(v)" + _end)
add("rescale_min", lambda q: q.elev.as_projection(DOUBLE, METHODS.Min), _odd + "min(v)::double" + _end)
add("rescale_max", lambda q: q.elev.as_projection(DOUBLE, METHODS.Max), _odd + "max(v)::double" + _end)
add("rescale_med", lambda q: q.elev.as_projection(DOUBLE, METHODS.Med), _odd + "median(v)::double" + _end)
add("rescale_mode", lambda q: q.part("code").as_projection(DOUBLE, METHODS.Mode), f"with n as (select y // 2 as y, x // 2 as x, v, count(*) as n from ({CODE}) group by 1, 2, 3) select y, x, arg_max(v, n * 1000 - v)::double as v from n group by 1, 2")
add("rescale_rms", lambda q: rounded(q.elev.as_projection(DOUBLE, METHODS.RootMeanSquare)), _odd + "round(sqrt(avg(v * v)), 6)" + _end)
add("rescale_sum", lambda q: q.elev.as_projection(DOUBLE, METHODS.Sum), _odd + "sum(v)::double" + _end)
add("rescale_sum_up", lambda q: q.elev.as_projection(HALF, METHODS.Sum), f"with a as ({ELEV}), k as ({box('0', '2', '0', '2')}) select a.y * 2 + k.y as y, a.x * 2 + k.x as x, a.v / 4 as v from a cross join k")
add("rescale_in_expression", lambda q: (q.elev.as_projection(DOUBLE, METHODS.Sum) > 100).sum_frame(), f"select sum(case when v > 100 then 1 else 0 end)::double as sum from ({_odd}sum(v){_end})")
# across coordinate systems: the parts on web Mercator, to longitude and latitude; 4 x 4 points for each target
WARP = MapProjection("EPSG:4326", 1.5e-5, -1.5e-5)
_R = "6378137.0::double"


def _mercator(q: Grids, band: str = "elev") -> Layer:
    return g.from_table(q.part(band).table.rows, band, Window(0, 0, 50, q.height), MapProjection("EPSG:3857", 1.0, -1.0), True)


def warp_sql(value: str, a: str = ELEV, points: int = 4, inner: str = "n", size: str = "1") -> str:
    """value: an aggregate over v, n (points of a source pixel in the target) and size (of the target in source pixels)."""
    lat = "-1.5e-5::double * (y + (j + 0.5::double) / {0})".format(points)
    return f"""with a as ({a}),
        h as (select cast(ceil(degrees(50 / {_R}) / 1.5e-5) as bigint) as w, cast(ceil(-degrees(2 * atan(exp(-{H} / {_R})) - pi() / 2) / 1.5e-5) as bigint) as h),
        g as (select y, x from (select unnest(generate_series(0, (select h from h) - 1)) as y) cross join (select unnest(generate_series(0, (select w from h) - 1)) as x)),
        k as ({box("0", str(points), "0", str(points))}),
        p as (select g.y, g.x, cast(floor({_R} * radians(1.5e-5::double * (g.x + (k.x + 0.5::double) / {points})) + 1e-9) as bigint) as cx,
                cast(floor(-{_R} * ln(tan(pi() / 4 + radians({lat.replace("(y", "(g.y").replace("(j", "(k.y")}) / 2)) + 1e-9) as bigint) as cy
              from g cross join k),
        c as (select y, x, cy, cx, count(*) / {points * points}::double as n from p group by 1, 2, 3, 4),
        m as (select c.y, c.x, a.v::double as v, n, {_R} * radians(1.5e-5::double) * {_R} * (ln(tan(pi() / 4 + radians(-1.5e-5::double * c.y) / 2)) - ln(tan(pi() / 4 + radians(-1.5e-5::double * (c.y + 1)) / 2))) as size
              from c join a on a.y = c.cy and a.x = c.cx),
        r as (select y, x, {value} as v from m group by 1, 2)
        select g.y, g.x, round(coalesce(r.v, 0), 6) + 0.0 as v from g left join r on g.y = r.y and g.x = r.x"""


for _name, _method, _value in (
    ("average", METHODS.Average, "sum(v * n) / sum(n)"), ("min", METHODS.Min, "min(v)"), ("max", METHODS.Max, "max(v)"), ("med", METHODS.Med, "median(v)"),
    ("rms", METHODS.RootMeanSquare, "sqrt(sum(v * v * n) / sum(n))"), ("sum", METHODS.Sum, "sum(v * n * size)"),
):
    add(f"warp_{_name}", lambda q, method=_method: rounded(_mercator(q).as_projection(WARP, method)), warp_sql(_value))
add("warp_nearest", lambda q: rounded(_mercator(q).as_projection(WARP)), warp_sql("max(v)", points=1))
add("warp_mode", lambda q: rounded(_mercator(q, "code").as_projection(WARP, METHODS.Mode)), warp_sql("arg_max(v, round(n * 1000) * 1000 - v)", CODE).replace("m as (select c.y", "m0 as (select c.y").replace("r as (select y, x,", "m as (select y, x, v, sum(n) as n from m0 group by 1, 2, 3),\n        r as (select y, x,"))
add("warp_constant", lambda q: (_mercator(q) * 0 + 1).as_projection(WARP, METHODS.Average).unique_frame().select(F.round("v", 9).alias("v")), "select 1.0::double as v")
# --------------------------------------------------------------------------------------------------------- vectors
_cells = f"with s as ({RECTS}), r as (select s_suppkey, s_nationkey, x0, x1, unnest(generate_series(y0, y1)) as y from s), c as (select s_suppkey, s_nationkey, y, unnest(generate_series(x0, x1)) as x from r)"
_frame = "g as (select y, x from (select unnest(generate_series((select min(y) from c), (select max(y) from c))) as y) cross join (select unnest(generate_series((select min(x) from c), (select max(x) from c))) as x))"


def burn_sql(value: str, where: str = "true") -> str:
    return f"{_cells.replace('from supplier', f'from supplier where {where}')}, b as (select y, x, {value} as v from c group by 1, 2), {_frame} select g.y, g.x, coalesce(b.v, 0)::bigint as v from g left join b on g.y = b.y and g.x = b.x"


add("rasterize_fixed", lambda q: q.rects(1), burn_sql("1"))
add("rasterize_field", lambda q: q.rects(), burn_sql("arg_max(s_nationkey, s_suppkey)"))
add("rasterize_filter", lambda q: q.rects(where="s_nationkey < 10"), burn_sql("arg_max(s_nationkey, s_suppkey)", "s_nationkey < 10"))
add("rasterize_mask_sum", lambda q: (q.elev * q.rects(1)).sum_frame(), f"{_cells}, m as (select distinct y, x from c) select coalesce(sum(v), 0)::double as sum from ({ELEV}) a join m on a.y = m.y and a.x = m.x")


def _polygons(q: Grids) -> Layer:
    """The rectangles once more, as rings that a task walks."""
    from gridloom.operators.rasterize import Shapes

    r = q.rects()
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(point("left", "top"), point("right", "top"), point("right", "bottom"), point("left", "bottom"), point("left", "top"))
    return Shapes(r.features.select("priority", "burn", F.array(ring).alias("rings")), r.area, DataType.Int64)


add("rasterize_polygons", _polygons, burn_sql("arg_max(s_nationkey, s_suppkey)"))


def _triangles(q: Grids) -> Layer:
    """Right triangles whose legs are 2 to 6 pixels long: other than rectangles, they have slanted edges."""
    from gridloom.operators.rasterize import Shapes
    from gridloom.plans.geometry import Window as Box

    h = q.height
    t = q.table("supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 40).cast("double").alias("x0"), (F.col("s_suppkey") * 7 % h).cast("double").alias("y0"), (F.col("s_nationkey") % 5 + 2).cast("double").alias("n"))
    point = lambda x, y: F.struct(x.alias("x"), (-y).alias("y"))
    x, y, n = F.col("x0"), F.col("y0"), F.col("n")
    ring = F.array(point(x, y), point(x + n, y), point(x, y + n), point(x, y))
    features = t.select(F.col("s_suppkey").alias("priority"), F.col("s_nationkey").alias("burn"), F.array(ring).alias("rings"))
    return Shapes(features, Area.of_window(Box(0, 0, 46, h + 6), UNIT), DataType.Int64)


add("rasterize_triangles", _triangles, f"""with s as (select s_suppkey, s_nationkey, s_suppkey % 40 as x0, s_suppkey * 7 % {H} as y0, s_nationkey % 5 + 2 as n from supplier),
    k as ({box("0", "6", "0", "6")}), c as (select s_suppkey, s_nationkey, y0 + k.y as y, x0 + k.x as x from s join k on k.x + k.y <= n - 1),
    b as (select y, x, arg_max(s_nationkey, s_suppkey) as v from c group by 1, 2), g as ({box("0", f"{H} + 6", "0", "46")})
    select g.y, g.x, coalesce(b.v, 0)::bigint as v from g left join b on g.y = b.y and g.x = b.x""")


def _folder(q: Grids) -> str:
    """A new folder that driver and executors share."""
    import os
    import tempfile
    import uuid

    base = q.spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not q.spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="gridloom-")
    path = f"{base.removeprefix('file://')}/grids/{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def _shape_file(q: Grids) -> str:
    """The rectangles as a GeoJSON file, in the order of their priority."""
    import json

    def feature(r) -> dict:
        x0, y0, x1, y1 = r["left"], r["top"], r["right"], r["bottom"]
        return {"type": "Feature", "properties": {"nation": r["burn"]}, "geometry": {"type": "Polygon", "coordinates": [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]}}

    path = f"{_folder(q)}/rectangles.geojson"
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"type": "FeatureCollection", "features": [feature(r) for r in q.rects().features.orderBy("priority").collect()]}, f)
    return path


add("shape_file", lambda q: g.read_shape(_shape_file(q), UNIT, burn_value="nation"), burn_sql("arg_max(s_nationkey, s_suppkey)"))
add("shape_filter", lambda q: g.read_shape(_shape_file(q), UNIT, "nation < 10", DataType.Int64), burn_sql("1", "s_nationkey < 10"))
add("shape_like", lambda q: g.read_shape_like(_shape_file(q), q.elev, burn_value="nation"), burn_sql("arg_max(s_nationkey, s_suppkey)"))
add("shape_mask", lambda q: (q.elev * g.read_shape_like(_shape_file(q), q.elev)).sum_frame(), ORACLE_SQL["rasterize_mask_sum"])
# ----------------------------------------------------------------------------------------------------------- sinks
add("multiband_align", lambda q: sinks.aligned([q.elev, q.shift], ["first", "second"])[0].withColumns({"first": F.col("first").cast("bigint"), "second": F.col("second").cast("bigint")}), union_sql("a").replace("a as v", 'a as "first", b as "second"'))
add("read_window", lambda q: q.elev.frame(Window(10, 1, 5, 2)), own_sql("v") + " where y between 1 and 2 and x between 10 and 14")
add("show_downsample", lambda q: q.tall.thumbnail_frame(100), f"with t as ({TALL}), s as (select greatest(1, (max(y) + 1) // 100) as n, max(y) as hy, max(x) as hx from t), g as (select y, x from s, (select unnest(generate_series(0, (select hy from s))) as y) cross join (select unnest(generate_series(0, (select hx from s))) as x) where y % n = 0 and x % n = 0) select g.y // n as y, g.x // n as x, coalesce(t.v, 0) as v from g cross join s left join t on t.y = g.y and t.x = g.x")


def _saved(q: Grids, layer: Layer, name: str = "a.tif") -> str:
    path = f"{_folder(q)}/{name}"
    layer.save(path)
    return path


def _one(q: Grids, schema: str, *values) -> DataFrame:
    return q.spark.createDataFrame([values], schema)


add("save_and_sum", lambda q: g.read_raster(_saved(q, q.elev, "a.parquet")), own_sql("v"))
add("save_total", lambda q: _one(q, "sum double", q.elev.parallel_save(f"{_folder(q)}/a.parquet", and_sum=True)), f"select sum(v)::double as sum from ({ELEV})")
add("geotiff_total", lambda q: _one(q, "sum double", q.elev.to_geotiff(f"{_folder(q)}/a.tif", and_sum=True)), f"select sum(v)::double as sum from ({ELEV})")
add("geotiff_round_trip", lambda q: g.read_raster(_saved(q, q.elev)), own_sql("v"))
add("geotiff_nodata", lambda q: g.read_raster((lambda path: q.part("elev", nodata=13.0).to_geotiff(path, nodata=-1, sparse=True) or path)(f"{_folder(q)}/a.tif")), own_sql("case when v = 13 then 'nan'::double else v::double end"))
add("geotiff_window", lambda q: g.read_raster(_saved(q, q.elev)).as_area(Area(5.0, -1.0, 25.0, -3.0)), own_sql("v") + " where y between 1 and 2 and x between 5 and 24")
add("geotiff_bands", lambda q: g.read_raster((lambda path: g.to_geotiff(path, [q.elev, q.shift], ["one", "two"]) or path)(f"{_folder(q)}/a.tif"), 2), union_sql("b"))
add("read_like", lambda q: g.read_raster_like(_saved(q, q.elev), q.elev.as_projection(DOUBLE), METHODS.Average), ORACLE_SQL["rescale_avg"])
add("rasters_list", lambda q: g.read_rasters([_saved(q, q.shift), _saved(q, q.elev, "a.parquet")]), ORACLE_SQL["group_priority"])


def _globe(q: Grids, rows: DataFrame, band: str, width: int) -> Layer:
    return g.from_table(rows, band, Window(0, 0, width, q.height), MapProjection("EPSG:4326", 1.0, -1.0), True)


def _narrow_file(q: Grids) -> Layer:
    rows = q.elev.frame().groupBy("y").agg(F.max("v").alias("v")).select("y", F.lit(0).cast("bigint").alias("x"), "v")
    return _globe(q, q.elev.table.rows, "elev", 50) * g.read_narrow_raster(_saved(q, _globe(q, rows, "v", 1)))


def _folder_mosaic(q: Grids) -> Layer:
    folder = _folder(q)
    q.shift.save(f"{folder}/a.tif")
    q.elev.save(f"{folder}/b.tif")
    return rasters_in(folder)


def _into_band(q: Grids) -> Layer:
    destination = g.empty_raster_like(q.elev, f"{_folder(q)}/a.tif", bands=2)
    q.elev.save(destination, band=1)
    q.shift.save(g.read_raster(destination.source[0]), band=2)
    return g.read_raster(destination.source[0], 1) * 100 + g.read_raster(destination.source[0], 2)


def _pickled(q: Grids) -> Layer:
    import pickle

    return pickle.loads(pickle.dumps(g.read_raster(_saved(q, q.elev)) * 2 + 1))


def _uniform(q: Grids) -> DataFrame:
    even = g.from_table(q.elev.table.rows.withColumn("elev", F.col("y") * 3), "elev", Window(0, 0, 50, q.height), UNIT, True)
    return _one(q, "even boolean, elev boolean", is_uniform_rows(even), is_uniform_rows(q.elev))


def _narrowed(q: Grids) -> Layer:
    even = g.from_table(q.elev.table.rows.withColumn("elev", F.col("y") * 3), "elev", Window(0, 0, 50, q.height), UNIT, True)
    return q.elev * narrowed(even)


add("narrow_file", _narrow_file, ORACLE_SQL["narrow_broadcast"])
add("narrowed", _narrowed, own_sql("3 * y * v"))
add("uniform_rows", _uniform, "select true as even, false as elev")
add("folder_mosaic", _folder_mosaic, ORACLE_SQL["group_priority"])
add("save_into_band", _into_band, f"with a as ({ELEV}), b as ({SHIFT}) select a.y, a.x, (a.v * 100 + coalesce(b.v, 0))::bigint as v from a left join b on a.y = b.y and a.x = b.x")
add("pickled", _pickled, own_sql("v * 2 + 1"))
add("parallel_sum", lambda q: _one(q, "sum double", (q.elev * q.elev).parallel_sum()), f"select sum(v * v)::double as sum from ({ELEV})")
add("mosaic_single", lambda q: g.Mosaic([q.part("elev", nodata=13.0)]), own_sql("case when v = 13 then 0.0::double else v::double end"))
add("mosaic_of_expressions", lambda q: g.Mosaic([q.rects(1), q.elev * 2]), f"""{_cells}, b as (select distinct y, x from c), span as (select min(y) as y0, max(y) as y1, min(x) as x0, max(x) as x1 from c), a as ({ELEV}),
    g as (select y, x from (select unnest(generate_series(0, greatest({H} - 1, (select y1 from span)))) as y) cross join (select unnest(generate_series(0, greatest(49, (select x1 from span)))) as x))
    select g.y, g.x, (case when g.y between y0 and y1 and g.x between x0 and x1 then (b.y is not null)::int else coalesce(a.v * 2, 0) end)::double as v
    from g cross join span left join b on g.y = b.y and g.x = b.x left join a on g.y = a.y and g.x = a.x""")
add("mosaic_type", lambda q: _one(q, "datatype string", g.Mosaic([q.part("price"), q.elev]).datatype.value), "select 'int32' as datatype")


def _metadata(q: Grids) -> DataFrame:
    layer = q.part("elev", dy=3, dx=5, nodata=13.0)
    a = layer.area
    return _one(q, "name string, width int, height int, datatype string, nodata double, projection string, left_x double, top_y double, right_x double, bottom_y double", layer.name, *layer.dimensions, layer.datatype.value, layer.nodata, layer.projection.name, a.left, a.top, a.right, a.bottom)


def _reprojected_area(q: Grids) -> DataFrame:
    a = Area(-10.0, 10.0, 10.0, -10.0, MapProjection("EPSG:4326", 0.5, -0.5)).reproject(MapProjection("EPSG:3857", 1e5, -1e5))
    b = Area(0.2, -0.2, 3.7, -2.2).project_like(q.elev.area)
    return q.spark.createDataFrame([("reproject", a.left, a.top, a.right, a.bottom), ("project_like", b.left, b.top, b.right, b.bottom)], "what string, left_x double, top_y double, right_x double, bottom_y double")


def _tree(q: Grids) -> DataFrame:
    seen: list[float] = []
    with (q.elev + q.shift) * 2 as layer:
        layer.sum(callback=seen.append)
        text, dot = layer.pretty_print(), layer.to_graphviz()
    return _one(q, "lines string, nodes int, edges int, progress string", text.replace("\n", "|"), dot.count("label"), dot.count("->"), " ".join(map(str, seen)))


add("metadata", _metadata, f"select 'elev' as name, 50 as width, {H}::int as height, 'int32' as datatype, 13.0::double as nodata, 'ESRI:54009' as projection, 5.0::double as left_x, -3.0::double as top_y, 55.0::double as right_x, -({H} + 3)::double as bottom_y")
add("reprojected_area", _reprojected_area, f"""select 'reproject' as what, floor({_R} * radians(-10) / 1e5) * 1e5 as left_x, ceil({_R} * ln(tan(pi() / 4 + radians(10) / 2)) / 1e5) * 1e5 as top_y, ceil({_R} * radians(10) / 1e5) * 1e5 as right_x,
    -ceil({_R} * ln(tan(pi() / 4 + radians(10) / 2)) / 1e5) * 1e5 as bottom_y union all select 'project_like', 0.0, 0.0, 4.0, -3.0""")
add("tree", _tree, "select 'mul|  add|    elev|    elev|  2' as lines, 5::int as nodes, 4::int as edges, '0.0 1.0' as progress")


def _places(q: Grids) -> DataFrame:
    layer = Formula(lambda y, x: None, Area(-10.0, 10.0, 10.0, -10.0, MapProjection("EPSG:4326", 0.5, -0.5)), DataType.Byte)
    rows = [(x, y, *layer.latlng_for_pixel(x, y), *layer.pixel_for_latlng(10.1 - 0.5 * (y + 1), -9.9 + 0.5 * x)) for x in range(5) for y in range(5)]
    return q.spark.createDataFrame(rows, "px bigint, py bigint, lat double, lng double, back_x bigint, back_y bigint")


add("pixel_places", _places, f"select x as px, y as py, 10 - 0.5::double * y as lat, 0.5::double * x - 10 as lng, x as back_x, y as back_y from ({box('0', '5', '0', '5')})")


# ---------------------------------------------------------------------------------------------------------- whole jobs
def area_of_habitat(q: Grids) -> DataFrame:
    elev, code = q.part("elev", "code")
    suitable = code.isin([1, 3]) & ((elev >= 10) & (elev <= 35))
    return (suitable * (q.rects(1, "s_nationkey < 10"))).sum_frame()


_masked = f"{_cells.replace('from supplier', 'from supplier where s_nationkey < 10')}, m as (select distinct y, x from c)"
add("area_of_habitat", area_of_habitat, f"{_masked} select count(*)::double as sum from ({ELEV}) e join ({CODE}) k on e.y = k.y and e.x = k.x join m on e.y = m.y and e.x = m.x where e.v between 10 and 35 and k.v in (1, 3)")
add("cloud_mask", lambda q: g.where(q.part("code") == 6, float("nan"), q.elev).nan_to_num(-1.0), f"with e as ({ELEV}), c as ({CODE}) select e.y, e.x, case when c.v = 6 then -1.0::double else e.v::double end as v from e join c on e.y = c.y and e.x = c.x")
add("species_richness", lambda q: g.sum([q.rects(1, f"s_nationkey = {k}") for k in range(0, 25, 6)]), f"{_cells.replace('from supplier', 'from supplier where s_nationkey % 6 = 0')}, b as (select y, x, count(distinct s_nationkey) as v from c group by 1, 2), {_frame} select g.y, g.x, coalesce(b.v, 0)::bigint as v from g left join b on g.y = b.y and g.x = b.x")
add("tall_mask_sum", lambda q: ((q.tall > 50) * q.tall).sum_frame(), f"select coalesce(sum(v), 0)::double as sum from ({TALL}) where v > 50")
