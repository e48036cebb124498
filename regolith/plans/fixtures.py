"""Inputs of the registered queries, derived from the test tables.

No mesh, image or camera comes with the tables, so each fixture reads one as
such: a height field from lineitem, images from orders, point clouds from
embeddings, a graph from orders, requests from events.  For each there is a
frame and, for the oracle, the text of a common table expression.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDE = 17
SPACING = 0.1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of eight maplets: k, r, c, h and their points x, y, z; an absent cell is an invalid sample."""
    t = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    keys = [(F.col("l_suppkey") % 8).alias("k"), (F.col("l_partkey") % SIDE).alias("r"), (F.col("l_orderkey") % SIDE).alias("c")]
    h = F.sum(F.round(F.col("l_discount") * 100).cast("long")).cast("double") / (F.lit(100.0) * F.count("*").cast("double"))
    return t.groupBy(*keys).agg(h.alias("h")).select("k", "r", "c", "h", ((F.col("c") - 8).cast("double") * F.lit(0.1)).alias("x"), ((F.col("r") - 8).cast("double") * F.lit(0.1)).alias("y"), (F.col("h") * F.lit(5.0)).alias("z"))


HF = """hf as materialized (select k, r, c, h, (c - 8)::double * 0.1::double as x, (r - 8)::double * 0.1::double as y, h * 5.0::double as z from (
  select l_suppkey % 8 as k, l_partkey % 17 as r, l_orderkey % 17 as c,
         sum(cast(round(l_discount * 100) as bigint))::double / (100.0::double * count(*)::double) as h
  from lineitem where l_returnflag = 'R' group by 1, 2, 3))"""


def _corner(name: str, dr: int, dc: int) -> str:
    return f"left join hf {name} on {name}.k = a.k and {name}.r = a.r + {dr} and {name}.c = a.c + {dc}"


# Cells are named by their corner (r, c); a cell whose first corner is absent still has a triangle.
HFM = HF + """,
cells as (select distinct k, r, c from (select k, r, c from hf union all select k, r, c - 1 from hf union all select k, r - 1, c from hf union all select k, r - 1, c - 1 from hf) where r between 0 and 15 and c between 0 and 15),
corner as (select g.k, g.r, g.c, g.r * 17 + g.c as va, a.h is not null as a, b.h is not null as b, c.h is not null as cc, d.h is not null as d
  from cells g left join hf a on a.k = g.k and a.r = g.r and a.c = g.c left join hf b on b.k = g.k and b.r = g.r and b.c = g.c + 1
  left join hf c on c.k = g.k and c.r = g.r + 1 and c.c = g.c left join hf d on d.k = g.k and d.r = g.r + 1 and d.c = g.c + 1),
hfm as materialized (
  select k, (r * 16 + c) * 2 as fid, va as v0, va + 1 as v1, case when a and d then va + 18 else va + 17 end as v2 from corner where a and b and (d or cc) and (case when a and d then d else cc end)
  union all
  select k, (r * 16 + c) * 2 + 1, case when a and d then va else va + 1 end, va + 18, va + 17 from corner where cc and d and (case when a and d then a else b end)),
vert as materialized (select k, r * 17 + c as vid, x, y, z from hf)"""

# Faces with their corner points, centroid and unit normal.
TRI = HFM + """,
crn as (select k, fid, v0, v1, v2, unnest([0, 1, 2]) as i, unnest([v0, v1, v2]) as vid from hfm),
tri as materialized (select k, fid, any_value(v0) as v0, any_value(v1) as v1, any_value(v2) as v2, max(x) filter (where i = 0) as ax, max(y) filter (where i = 0) as ay, max(z) filter (where i = 0) as az,
  max(x) filter (where i = 1) as bx, max(y) filter (where i = 1) as by_, max(z) filter (where i = 1) as bz, max(x) filter (where i = 2) as cx, max(y) filter (where i = 2) as cy, max(z) filter (where i = 2) as cz from crn join vert using (k, vid) group by k, fid),
raw as (select *, ((by_ - ay) * (cz - az) - (bz - az) * (cy - ay)) as gx, ((bz - az) * (cx - ax) - (bx - ax) * (cz - az)) as gy, ((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) as gz from tri),
face as materialized (select *, sqrt(gx * gx + gy * gy + gz * gz) as two, ax / 3.0::double + bx / 3.0::double + cx / 3.0::double as mx, ay / 3.0::double + by_ / 3.0::double + cy / 3.0::double as my, az / 3.0::double + bz / 3.0::double + cz / 3.0::double as mz from raw),
geo as materialized (select *, case when two > 0 then gx / two else 0.0::double end as nx, case when two > 0 then gy / two else 0.0::double end as ny, case when two > 0 then gz / two else 0.0::double end as nz, two * 0.5::double as area from face)"""


def clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two clouds: id, x, y, z, ref (odd ids) or not."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xyz")], (F.col("vec_id") % 2 == 1).alias("ref"), "label")


PTS = """pts as materialized (select vec_id as id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, vec_id % 2 = 1 as ref, label from embeddings),
rec as (select * from pts where not ref), ref as (select * from pts where ref)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of four 16 x 16 images: image_id, row, col, value, valid."""
    o = table(spark, sf_dir, "orders")
    keys = [(F.col("o_custkey") % 4).alias("image_id"), (F.floor(F.col("o_orderkey") / 16) % 16).alias("row"), (F.col("o_orderkey") % 16).alias("col")]
    value = F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / (F.lit(50000000.0) * F.count("*").cast("double"))
    return o.groupBy(*keys).agg(value.alias("value"), (F.sum("o_orderkey") % 7 != 0).alias("valid"))


IMG = """img as materialized (select o_custkey % 4 as image_id, (o_orderkey // 16) % 16 as row, o_orderkey % 16 as col,
  sum(cast(round(o_totalprice * 100) as bigint))::double / (50000000.0::double * count(*)::double) as value, sum(o_orderkey) % 7 <> 0 as valid from orders group by 1, 2, 3)"""


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of all orders; its node ids grow with the table, one and a half an order."""
    o = table(spark, sf_dir, "orders")
    ids = F.lit(max(o.count() * 3 // 2, 1))
    return o.select((F.col("o_custkey") % ids).alias("a"), ((F.col("o_orderkey") * 7 + 3) % ids).alias("b")).distinct()


GR = "gr as materialized (select distinct o_custkey % ids as a, (o_orderkey * 7 + 3) % ids as b from orders, (select greatest(count(*) * 3 // 2, 1) as ids from orders))"


def camera_rows() -> list[tuple]:
    """Thirteen cameras: id, focal length, principal point, width, R (row-major), t, Sun direction; decimals of nine digits."""

    def unit(a):
        n = math.sqrt(sum(x * x for x in a))
        return [x / n for x in a]

    def cross(a, b):
        return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]

    rows = []
    for i in range(13):
        if i == 12:
            r, t, sun = [[1, 0, 0], [0, -1, 0], [0, 0, -1]], [0, 0, 3], unit([0.3, 0.2, 1])
        else:
            angle = 2 * math.pi * i / 12
            eye = [1.5 * math.cos(angle), 1.5 * math.sin(angle), 2.5]
            forward = unit([-x for x in eye])
            right = unit(cross(forward, [0, 0, 1]))
            r = [right, cross(forward, right), forward]
            t = [-sum(x * e for x, e in zip(row, eye, strict=True)) for row in r]
            sun = unit([math.cos(angle + 0.7), math.sin(angle + 0.7), 1.2])
        rows.append((i, 64.0, 31.5, 64, *[round(float(x), 9) for row in r for x in row], *[round(float(x), 9) for x in t], *[round(float(x), 9) for x in sun]))
    return rows


CAMERA_COLUMNS = ["cam", "f", "pp", "side", *[f"r{i}{j}" for i in range(3) for j in range(3)], "t0", "t1", "t2", "s0", "s1", "s2"]


def cameras(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(camera_rows(), "cam long, f double, pp double, side int, " + ", ".join(f"{c} double" for c in CAMERA_COLUMNS[4:]))


CAM = f"cam({', '.join(CAMERA_COLUMNS)}) as (values " + ", ".join("(" + ", ".join(f"{x!r}::double" if isinstance(x, float) else f"{x}::{'bigint' if k == 0 else 'int'}" for k, x in enumerate(row)) + ")" for row in camera_rows()) + ")"


def order_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera for each order, turned about the vertical and looking down: cam, f, pp, side, R, t, Sun direction, and the customer k."""
    o = table(spark, sf_dir, "orders")
    a = F.radians((F.col("o_orderkey") * 37 % 360).cast("double"))
    eye = [F.col("o_custkey") % 101 / F.lit(50.0) - F.lit(1.0), F.col("o_orderkey") % 97 / F.lit(48.0) - F.lit(1.0), F.lit(2.0) + F.col("o_totalprice") / F.lit(170003.0)]
    d = o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("cam"), "o_orderdate", F.cos(a).alias("ca"), F.sin(a).alias("sa"), *[x.alias(n) for x, n in zip(eye, ("x", "y", "z"), strict=True)])
    rows = [["ca", "sa", 0.0], ["sa", "-ca", 0.0], [0.0, 0.0, -1.0]]
    value = lambda e: -F.col(e[1:]) if isinstance(e, str) and e[0] == "-" else F.col(e) if isinstance(e, str) else F.lit(e)
    r = [[value(e) for e in row] for row in rows]
    t = [-(row[0] * F.col("x") + row[1] * F.col("y") + row[2] * F.col("z")) for row in r]
    flat = F.sqrt(F.lit(0.5))
    return d.select("k", "cam", "o_orderdate", F.lit(64.0).alias("f"), F.lit(31.5).alias("pp"), F.lit(64).alias("side"), *[r[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)], *[x.alias(f"t{i}") for i, x in enumerate(t)],
                    (F.col("ca") * flat).alias("s0"), (F.col("sa") * flat).alias("s1"), flat.alias("s2"))


ORDER_CAM = """oc0 as (select o_custkey as k, o_orderkey as cam, o_orderdate, cos(radians((o_orderkey * 37 % 360)::double)) as ca, sin(radians((o_orderkey * 37 % 360)::double)) as sa,
  o_custkey % 101 / 50.0::double - 1.0::double as x, o_orderkey % 97 / 48.0::double - 1.0::double as y, 2.0::double + o_totalprice / 170003.0::double as z from orders),
oc as materialized (select k, cam, o_orderdate, 64.0::double as f, 31.5::double as pp, 64 as side, ca as r00, sa as r01, 0.0::double as r02, sa as r10, -ca as r11, 0.0::double as r12, 0.0::double as r20, 0.0::double as r21, -1.0::double as r22,
  -(ca * x + sa * y) as t0, -(sa * x - ca * y) as t1, z as t2, ca * sqrt(0.5::double) as s0, sa * sqrt(0.5::double) as s1, sqrt(0.5::double) as s2 from oc0)"""


def supplier_maplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A maplet for each supplier, of one of fifteen shapes: k, ny, nx, spacing."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("k"), (F.lit(9) + F.col("s_suppkey") % 5).cast("int").alias("ny"), (F.lit(9) + F.floor(F.col("s_suppkey") / 4) % 3).cast("int").alias("nx"), F.lit(0.1).alias("spacing"))


SUPPLIER_MAPLETS = "sm as (select s_suppkey as k, 9 + s_suppkey % 5 as ny, 9 + (s_suppkey // 4) % 3 as nx, 0.1::double as spacing from supplier)"


def written_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maplets of lineitem as OBJ text, all kinds of references in turn: mesh, no, line."""
    hf = heights(spark, sf_dir).select("k", "r", "c")
    at = F.row_number().over(Window.partitionBy("k").orderBy("r", "c"))
    v = hf.select("k", "r", "c", at.cast("long").alias("n"), F.count("*").over(Window.partitionBy("k")).alias("all"))
    place = F.col("r") * SIDE + F.col("c")
    number = lambda x: F.format_string("%.1f", (F.col(x) - 8).cast("double") / F.lit(10.0))
    points = v.select("k", (place * 2).alias("no"), F.concat(F.lit("v "), number("c"), F.lit(" "), number("r"), F.when(F.col("n") % 3 == 0, " 0.0 0.5 0.5 0.5").otherwise("  0.0 # a point")).alias("line"))
    notes = v.select("k", (place * 2 + 1).alias("no"), F.when(F.col("n") % 2 == 0, "vn 0 0 1").otherwise("").alias("line"))
    near = F.explode(F.array(*[F.struct((F.col("r") - i).alias("r"), (F.col("c") - j).alias("c"), F.lit(2 * i + j).alias("corner")) for i in (0, 1) for j in (0, 1)]))
    cell = v.select("k", "n", "all", near.alias("s")).groupBy("k", "s.r", "s.c").agg(F.max("all").alias("all"), *[F.max(F.when(F.col("s.corner") == n, F.col("n"))).alias(f"n{n}") for n in range(4)])
    cell = cell.filter("n0 is not null and n1 is not null and n2 is not null and n3 is not null")
    ring = [F.col(f"n{n}") for n in (0, 1, 3, 2)]
    kind = (F.col("r") + F.col("c")) % 4
    line = (
        F.when(kind == 0, F.format_string("f %d %d %d %d", *ring)).when(kind == 1, F.format_string("f %d/1 %d/2 %d/3 %d/4\r", *ring))
        .when(kind == 2, F.format_string("f %d//1 %d/2/3 %d//1 %d", *ring)).otherwise(F.format_string("f %d %d %d # half", *[x - F.col("all") - 1 for x in ring[:3]]))
    )
    faces = cell.select("k", (F.lit(2000) + F.col("r") * SIDE + F.col("c")).alias("no"), line.alias("line"))
    return points.unionByName(notes).unionByName(faces).withColumnRenamed("k", "mesh")
