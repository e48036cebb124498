"""Registered queries: height fields, meshes and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from regolith.functions import sqltext as S
from regolith.functions.vec import micro
from regolith.operators import maplet, mesh, raster
from regolith.plans import fixtures as X

LIGHT = (-0.3, -0.2, -1.0)
_L = sum(x * x for x in LIGHT) ** 0.5
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _mesh(spark, sf):
    hf = X.heights(spark, sf)
    return maplet.vertices(hf, X.SIDE), maplet.triangles(hf, X.SIDE)


def _maplets(spark):
    """Eight maplets of 17 x 17 samples, turned about z by quarter turns and shifted."""
    turns = [(1, 0, 0, 1), (0, -1, 1, 0), (-1, 0, 0, -1), (0, 1, -1, 0)]
    rows = [(k, X.SIDE, X.SIDE, 0.5 * k, 0.25 * k, 0.125 * k, *[float(x) for x in (t[0], t[1], 0, t[2], t[3], 0, 0, 0, 1)], X.SPACING) for k in range(8) for t in [turns[k % 4]]]
    return spark.createDataFrame(rows, "k long, ny int, nx int, ox double, oy double, oz double, " + ", ".join(f"b{i}{j} double" for i in range(3) for j in range(3)) + ", spacing double")


def _down(spark):
    return X.cameras(spark).filter("cam = 12")


@query(f"""with {X.HF}, m as (select *, 0.5::double * k as ox, 0.25::double * k as oy, 0.125::double * k as oz, (c - 8.0::double) * 0.1::double as u, (r - 8.0::double) * 0.1::double as v, k % 4 as q from hf)
select k, r, c, {S.micro("case q when 0 then ox + u when 1 then ox - v when 2 then ox - u else ox + v end")} as px, {S.micro("case q when 0 then oy + v when 1 then oy + u when 2 then oy - v else oy - u end")} as py, {S.micro("oz + h")} as pz from m""")
def hf_body_points(spark, sf):
    s = X.heights(spark, sf).select("k", "r", "c", "h", F.lit(True).alias("valid"))
    return maplet.body_points(s, _maplets(spark)).select("k", "r", "c", *[micro(F.col(f"p{a}")).alias(f"p{a}") for a in "xyz"])


GRADIENT = f"""{X.HF}, grid as (select k.k, r.r, c.c, coalesce(h.h, 0.0::double) as h, h.h is not null as valid from range(8) k(k), range(17) r(r), range(17) c(c) left join hf h on h.k = k.k and h.r = r.r and h.c = c.c),
near as (select *, lag(h) over a as hl, lead(h) over a as hr, lag(h) over d as hu, lead(h) over d as hd, coalesce(lag(valid) over a, valid) as vl, coalesce(lead(valid) over a, valid) as vr, coalesce(lag(valid) over d, valid) as vu, coalesce(lead(valid) over d, valid) as vd
  from grid window a as (partition by k, r order by c), d as (partition by k, c order by r)),
slopes as (select k, r, c, h, valid, case when hl is null then (hr - h) / 0.1::double when hr is null then (h - hl) / 0.1::double else (hr - hl) / 0.2::double end as p,
  case when hu is null then (hd - h) / 0.1::double when hd is null then (h - hu) / 0.1::double else (hd - hu) / 0.2::double end as q, valid and vl and vr and vu and vd as usable from near)"""


def _slopes(spark, sf):
    grid = maplet.complete_grid(X.heights(spark, sf), _maplets(spark))
    return maplet.gradient(grid, X.SPACING)


@query(f"with {GRADIENT} select k, r, c, {S.micro('p')} as p, {S.micro('q')} as q, usable from slopes")
def hf_gradient(spark, sf):
    return _slopes(spark, sf).select("k", "r", "c", micro(F.col("p")).alias("p"), micro(F.col("q")).alias("q"), "usable")


@query(f"with {GRADIENT} select k, r, c, {S.micro('-p / sqrt(1.0::double + p * p + q * q)')} as nx, {S.micro('-q / sqrt(1.0::double + p * p + q * q)')} as ny, {S.micro('1.0::double / sqrt(1.0::double + p * p + q * q)')} as nz from slopes where usable")
def hf_normals(spark, sf):
    return maplet.normals(_slopes(spark, sf)).filter("usable").select("k", "r", "c", *[micro(F.col(f"n{a}")).alias(f"n{a}") for a in "xyz"])


@query(f"with {X.HFM} select k as mesh, fid, v0, v1, v2 from hfm")
def hf_triangles(spark, sf):
    return _mesh(spark, sf)[1]


@query(f"with {X.TRI} select k as mesh, fid, {S.micro('mx')} as mx, {S.micro('my')} as my, {S.micro('mz')} as mz, {S.micro('nx')} as nx, {S.micro('ny')} as ny, {S.micro('nz')} as nz, {S.micro('area')} as area from geo")
def mesh_face_geometry(spark, sf):
    return mesh.face_geometry(*_mesh(spark, sf)).select("mesh", "fid", *[micro(F.col(c)).alias(c) for c in ("mx", "my", "mz", "nx", "ny", "nz", "area")])


@query(f"with {X.TRI} select k as mesh, count(*) filter (where area > 0) as faces, (sum({S.micro('area')}) filter (where area > 0))::bigint as area from geo group by k")
def mesh_area(spark, sf):
    return mesh.proper_faces(mesh.face_geometry(*_mesh(spark, sf))).groupBy("mesh").agg(F.count("*").alias("faces"), F.sum(micro(F.col("area"))).alias("area"))


EDGES = """, e as (select k, unnest([v0, v1, v2]) as p, unnest([v1, v2, v0]) as q from hfm),
ed as (select k, least(p, q) as lo, greatest(p, q) as hi, count(*) as n, sum(case when p < q then 1 else -1 end) as turn from e group by 1, 2, 3)"""


@query(f"""with {X.HFM}{EDGES}, by_edge as (select k, count(*) filter (where n = 1) as boundary, count(*) filter (where n > 2) as nonmanifold, count(*) filter (where turn <> 0) as unbalanced, count(*) as n_edges from ed group by k),
loose as (select k, count(*) as unreferenced from vert v where not exists (select 1 from hfm f where f.k = v.k and v.vid in (f.v0, f.v1, f.v2)) group by k),
again as (select k, (count(*) - count(distinct list_sort([v0, v1, v2]))) as repeated from hfm group by k)
select k as mesh, boundary, nonmanifold, unbalanced, n_edges, coalesce(unreferenced, 0) as unreferenced, coalesce(repeated, 0) as repeated from by_edge left join loose using (k) left join again using (k)""")
def mesh_edge_topology(spark, sf):
    return mesh.edge_topology(*_mesh(spark, sf))


@query(f"with {X.HFM} select k as mesh, vid, min(vid) over (partition by k, floor(x * 5), floor(y * 5)) as welded from vert")
def mesh_weld_vertices(spark, sf):
    v = _mesh(spark, sf)[0].select("mesh", "vid", F.floor(F.col("x") * 5).alias("x"), F.floor(F.col("y") * 5).alias("y"), F.lit(0).alias("z"))
    return mesh.weld(v).select("mesh", "vid", "welded")


@query(f"""with {X.HFM}, bad as (select k as mesh, count(*) filter (where isnan(x) or isnan(y) or isnan(z)) as bad_vertices from vert where vid % 5 <> 0 group by k),
lost as (select f.k as mesh, count(distinct fid) as lost_faces from hfm f where v0 % 5 = 0 or v1 % 5 = 0 or v2 % 5 = 0 group by f.k)
select mesh, bad_vertices, coalesce(lost_faces, 0) as lost_faces, 0::bigint as twice_faces from bad left join lost using (mesh)""")
def mesh_violations(spark, sf):
    v, f = _mesh(spark, sf)
    return mesh.violations(v.filter("vid % 5 <> 0"), f)


@query(f"with {X.HF} select k, r // 4 as br, c // 4 as bc, count(*) as n, {', '.join(S.micro(f'{g}({a})') + f' as {n}_{a}' for a in 'xyz' for g, n in (('min', 'lo'), ('max', 'hi')))} from hf group by 1, 2, 3")
def mesh_block_bounds(spark, sf):
    b = mesh.bounds(X.heights(spark, sf).select("k", F.floor(F.col("r") / 4).alias("br"), F.floor(F.col("c") / 4).alias("bc"), "x", "y", "z"), "k", "br", "bc")
    return b.select("k", "br", "bc", "n", *[micro(F.col(f"{n}_{a}")).alias(f"{n}_{a}") for a in "xyz" for n in ("lo", "hi")])


@query(None)
def mesh_blocks_median_split(spark, sf):
    """Split until no leaf has more than 16 points."""
    pts = X.clouds(spark, sf).select("id", "x", "y", "z", F.lit(0).alias("mesh"))
    return mesh.median_split(pts, most=16).select("id", "path")


@query(None)
def mesh_leaves(spark, sf):
    return _leaves(spark, sf, None)


def _leaves(spark, sf, levels):
    from pyspark.sql import Window

    pts = X.clouds(spark, sf).select("id", "x", "y", "z", F.lit(0).alias("mesh"))
    leaves = mesh.bounds(mesh.median_split(pts, levels, most=16), "path")
    return leaves.select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("leaf"), "n", micro(F.col("lo_x")).alias("lo_x"), micro(F.col("hi_x")).alias("hi_x"))


@query(None)
def mesh_components(spark, sf):
    from regolith.operators.graph import components

    return components(X.graph(spark, sf))


@query(None)
def largest_component(spark, sf):
    from regolith.operators.graph import components

    return _largest(components(X.graph(spark, sf)))


def _largest(c):
    best = c.groupBy("root").count().agg(F.max_by("root", F.struct("count", -F.col("root"))).alias("root"))
    return c.join(F.broadcast(best), "root", "left_semi")


EYE = [f"(-({S.dot((f'r0{i}', f'r1{i}', f'r2{i}'), ('t0', 't1', 't2'))}))" for i in range(3)]
N3, M3 = S.v("nx", "ny", "nz"), S.v("mx", "my", "mz")


@query(f"with {X.TRI}, {X.CAM}, s as (select geo.*, cam.cam, {EYE[0]} as e0, {EYE[1]} as e1, {EYE[2]} as e2 from geo, cam) select k as mesh, cam, count(*) as facing from s where {S.dot(N3, S.v('e0', 'e1', 'e2'))} > {S.dot(N3, M3)} group by 1, 2")
def hf_backface_cull(spark, sf):
    g = mesh.face_geometry(*_mesh(spark, sf))
    return raster.cull_backfaces(raster.with_cameras(g, X.cameras(spark))).groupBy("mesh", "cam").agg(F.count("*").alias("facing"))


def _plane(p: tuple[str, str, str]) -> str:
    world = S.apply_back("r", p)
    off = S.dot(p, S.v("t0", "t1", "t2"))
    c, e = [f"((lo_{a} + hi_{a}) / 2.0::double)" for a in "xyz"], [f"((hi_{a} - lo_{a}) / 2.0::double)" for a in "xyz"]
    ab = tuple(f"abs({w})" for w in world)
    radius = S.dot(tuple(e), ab)
    slack = f"{16 * 2.0**-23!r}::double * ({S.dot(tuple(f'abs({x})' for x in c), ab)} + abs({off}) + {radius} + 1.0::double)"
    return f"({S.dot(tuple(c), world)} + {off} + {radius} >= -({slack}))"


_Z, _O = "0.0::double", "1.0::double"


@query(f"""with {X.HF}, {X.CAM}, blk as (select k, r // 4 as br, c // 4 as bc, {', '.join(f'{g}({a}) as {n}_{a}' for a in 'xyz' for g, n in (('min', 'lo'), ('max', 'hi')))} from hf group by 1, 2, 3),
near as (select cam, f * 4 as f, pp, side, {', '.join(X.CAMERA_COLUMNS[4:])} from cam)
select k, br, bc, cam, {_plane(('f', _Z, 'pp'))} and {_plane(('(-f)', _Z, '(side - pp)'))} and {_plane((_Z, 'f', 'pp'))} and {_plane((_Z, '(-f)', '(side - pp)'))} and {_plane((_Z, _Z, _O))} as visible from blk, near""")
def hf_frustum_blocks(spark, sf):
    b = mesh.bounds(X.heights(spark, sf).select("k", F.floor(F.col("r") / 4).alias("br"), F.floor(F.col("c") / 4).alias("bc"), "x", "y", "z"), "k", "br", "bc")
    close = X.cameras(spark).withColumn("f", F.col("f") * 4)
    return raster.frustum_blocks(b, close).select("k", "br", "bc", "cam", "visible")


def _cam_point(n: str) -> list[str]:
    y = "by_" if n == "b" else f"{n}y"
    return [f"({S.dot((f'r{i}0', f'r{i}1', f'r{i}2'), (f'{n}x', y, f'{n}z'))} + t{i}) as {n}{i}" for i in range(3)]


RENDER = f"""{X.TRI}, {X.CAM}, down as (select * from cam where cam = 12),
facing as (select geo.*, down.*, {EYE[0]} as e0, {EYE[1]} as e1, {EYE[2]} as e2 from geo, down),
pt as (select *, {', '.join(x for n in 'abc' for x in _cam_point(n))} from facing where {S.dot(N3, S.v('e0', 'e1', 'e2'))} > {S.dot(N3, M3)}),
uv as (select *, f * a0 / a2 + pp as u0, f * a1 / a2 + pp as v0_, f * b0 / b2 + pp as u1, f * b1 / b2 + pp as v1_, f * c0 / c2 + pp as u2, f * c1 / c2 + pp as v2_ from pt where a2 > 1e-6::double and b2 > 1e-6::double and c2 > 1e-6::double),
box as (select *, least(greatest(ceil(least(u0, u1, u2) - 0.5::double), 0), 63)::int as x0, least(greatest(floor(greatest(u0, u1, u2) - 0.5::double), 0), 63)::int as x1,
  least(greatest(ceil(least(v0_, v1_, v2_) - 0.5::double), 0), 63)::int as y0, least(greatest(floor(greatest(v0_, v1_, v2_) - 0.5::double), 0), 63)::int as y1, (u1 - u0) * (v2_ - v0_) - (u2 - u0) * (v1_ - v0_) as twice from uv),
vis as materialized (select * from box where abs(twice) > 1e-12::double and greatest(u0, u1, u2) >= 0 and least(u0, u1, u2) < 64 and greatest(v0_, v1_, v2_) >= 0 and least(v0_, v1_, v2_) < 64 and x1 >= x0 and y1 >= y0),
span as (select k, min(least(a2, b2, c2)) as zmin, max(greatest(a2, b2, c2)) as zmax from vis group by k),
px1 as (select *, unnest(range(y0, y1 + 1)) as py from vis),
px2 as (select *, unnest(range(x0, x1 + 1)) as px from px1),
wgt as (select *, px + 0.5::double as fx, py + 0.5::double as fy from px2),
inside as (select *, (u1 - fx) * (v2_ - fy) - (u2 - fx) * (v1_ - fy) as w0, (u2 - fx) * (v0_ - fy) - (u0 - fx) * (v2_ - fy) as w1, (u0 - fx) * (v1_ - fy) - (u1 - fx) * (v0_ - fy) as w2 from wgt),
dep as (select *, w0 / twice * (1.0::double / a2) + w1 / twice * (1.0::double / b2) + w2 / twice * (1.0::double / c2) as iz from inside where w0 * sign(twice) >= 0 and w1 * sign(twice) >= 0 and w2 * sign(twice) >= 0),
quant as (select dep.k, fid, px, py, cast(floor(least(greatest((1.0::double / iz - zmin) / greatest(zmax - zmin, 1e-9::double), 0.0::double), 1.0::double) * 16777215.0::double) as bigint) as zq from dep join span using (k) where iz > 0),
zb as materialized (select k, px, py, min(row(zq, fid)) as b from quant group by 1, 2, 3)"""


@query(f"with {RENDER} select k as mesh, 12::bigint as cam, px, py, b[1] as zq, b[2] as fid from zb")
def hf_render_zbuffer(spark, sf):
    g = mesh.face_geometry(*_mesh(spark, sf))
    seen = raster.cull_backfaces(raster.with_cameras(g, _down(spark)))
    return raster.z_buffer(raster.project_faces(seen, 1e-6, 64, 64)).select("mesh", "cam", F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py"), "zq", "fid")


SHADE = f"cast(floor((0.15::double + 0.85::double * least(greatest({S.dot(N3, tuple(f'{-x / _L!r}::double' for x in LIGHT))}, 0.0::double), 1.0::double)) * 255.0::double) as int)"


@query(f"with {RENDER} select zb.k as mesh, px, py, {SHADE} as gray from zb join geo on geo.k = zb.k and geo.fid = zb.b[2]")
def hf_render_shade(spark, sf):
    g = mesh.face_geometry(*_mesh(spark, sf))
    return raster.render(g, _down(spark), LIGHT).select("mesh", F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py"), "gray")


@query(f"with {RENDER}, sh as (select zb.k, px, py, {SHADE} as gray from zb join geo on geo.k = zb.k and geo.fid = zb.b[2]) select k.k as mesh, y.y as py, sum(coalesce(gray, 7))::bigint as total from range(8) k(k), range(64) y(y), range(64) x(x) left join sh on sh.k = k.k and sh.px = x.x and sh.py = y.y group by 1, 2")
def hf_render_frame(spark, sf):
    g = mesh.face_geometry(*_mesh(spark, sf))
    shaded = raster.render(g, _down(spark), LIGHT)
    f = raster.frame(shaded.drop("cam"), spark.range(8).select(F.col("id").alias("mesh")), 64, 64, 7)
    return f.groupBy("mesh", F.col("py").cast("long").alias("py")).agg(F.sum("gray").alias("total"))


@query(f"with {X.ORDER_CAM} select cam, {', '.join(f'{S.micro(e)} as e{i}' for i, e in enumerate(EYE))} from oc")
def cam_centers(spark, sf):
    return maplet.camera_centers(X.order_cameras(spark, sf)).select("cam", *[micro(F.col(f"e{i}")).alias(f"e{i}") for i in range(3)])


PROJECT = f"""{X.HF}, {X.CAM}, pr as (select k, r, c, cam, f, pp, {', '.join(f"({S.dot((f'r{i}0', f'r{i}1', f'r{i}2'), ('x', 'y', 'z'))} + t{i}) as {n}" for i, n in enumerate(('cx', 'cy', 'depth')))} from hf, cam)"""


@query(f"with {PROJECT} select k, r, c, cam, {S.micro('f * cx / depth + pp')} as u, {S.micro('f * cy / depth + pp')} as v from pr where depth > 1e-6::double")
def project_samples(spark, sf):
    p = maplet.project(X.heights(spark, sf), X.cameras(spark)).filter(F.col("depth") > 1e-6)
    return p.select("k", "r", "c", "cam", micro(F.col("u")).alias("u"), micro(F.col("v")).alias("v"))


_A = {n: [f"(f * ({a} * depth - {c} * {z}) / (depth * depth))" for a, c, z in ((f"r0{j}", "cx", f"r2{j}"), (f"r1{j}", "cy", f"r2{j}"))] for n, j in (("u", 0), ("v", 1))}


@query(f"""with {X.HF}, {X.CAM}, cen as (select k, 0.0::double as x, 0.0::double as y, max(z) as z from hf group by k), pr as (select k, cam, f, {', '.join(f'r{i}{j}' for i in range(3) for j in range(3))}, {', '.join(f"({S.dot((f'r{i}0', f'r{i}1', f'r{i}2'), ('x', 'y', 'z'))} + t{i}) as {n}" for i, n in enumerate(('cx', 'cy', 'depth')))} from cen, cam),
jac as (select k, cam, depth, {_A['u'][0]} as a, {_A['u'][1]} as c, {_A['v'][0]} as b, {_A['v'][1]} as d from pr), td as (select *, a * a + b * b + c * c + d * d as tr, a * d - b * c as det from jac)
select k, cam, {S.micro('1.0::double / greatest(sqrt(greatest((tr - sqrt(greatest(tr * tr - 4.0::double * det * det, 0.0::double))) / 2.0::double, 0.0::double)), 1e-6::double)')} as gsd from td where depth > 1e-6::double""")
def gsd(spark, sf):
    c = X.heights(spark, sf).groupBy("k").agg(F.max("z").alias("z")).select("k", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), "z", *[F.lit(1.0 if i == j else 0.0).alias(f"{n}{a}") for i, n in enumerate("uv") for j, a in enumerate("xyz")])
    return maplet.ground_sample_distance(c, X.cameras(spark)).select("k", "cam", micro(F.col("gsd")).alias("gsd"))


BILINEAR = f"""{X.IMG}, qs as (select i.image_id, n.n as qid0, (n.n % 31) * 0.5::double as u, (n.n // 31) * 0.5::double as v from range(961) n(n), range(4) i(image_id)),
cor as (select *, cast(floor(u) as bigint) as x0, cast(floor(v) as bigint) as y0 from qs),
cn as (select image_id, qid0, x0 + i.i as col, y0 + j.j as row, (case when i.i = 1 then u - x0 else 1.0::double - (u - x0) end) * (case when j.j = 1 then v - y0 else 1.0::double - (v - y0) end) as w from cor, range(2) i(i), range(2) j(j))"""


@query(f"with {BILINEAR} select cn.image_id, qid0, {S.micro('sum(coalesce(value, 0.0::double) * w)')} as value, bool_and(coalesce(valid, false)) as usable from cn left join img on img.image_id = cn.image_id and img.row = cn.row and img.col = cn.col where w <> 0 group by 1, 2")
def bilinear_lookup(spark, sf):
    q = spark.range(961).crossJoin(spark.range(4).select(F.col("id").alias("image_id"))).select((F.col("image_id") * 1000 + F.col("id")).alias("qid"), "image_id", ((F.col("id") % 31) * F.lit(0.5)).alias("u"), (F.floor(F.col("id") / 31) * F.lit(0.5)).alias("v"))
    r = maplet.bilinear(q, X.images(spark, sf), 16, 16)
    return r.select("image_id", (F.col("qid") % 1000).alias("qid0"), micro(F.col("value")).alias("value"), "usable")


@query(f"""with {X.HF}, s as (select k, count(*)::double as n, sum(x) as sx, sum(y) as sy, sum(h) as sh, sum(x * x) as sxx, sum(x * y) as sxy, sum(y * y) as syy, sum(x * h) as sxh, sum(y * h) as syh from hf group by k),
c as (select *, sxx - sx * sx / n as xx, sxy - sx * sy / n as xy, syy - sy * sy / n as yy, sxh - sx * sh / n as xh, syh - sy * sh / n as yh from s)
select k, cast(round((xh * yy - yh * xy) / (xx * yy - xy * xy) * 1000000) as bigint) as a, cast(round((yh * xx - xh * xy) / (xx * yy - xy * xy) * 1000000) as bigint) as b from c""")
def plane_fit(spark, sf):
    return maplet.plane_fit(X.heights(spark, sf)).select("k", *[F.round(F.col(c) * 1000000).cast("long").alias(c) for c in "ab"])


@query(f"with {X.SUPPLIER_MAPLETS}, m as (select k, ny * nx as n, coalesce(ny <> lag(ny) over (order by k) or nx <> lag(nx) over (order by k), false) as turn from sm) select k, (sum(n) over (order by k) - n)::bigint as start, (sum(turn::int) over (order by k))::bigint as run from m")
def packed_offsets(spark, sf):
    return maplet.packed_offsets(X.supplier_maplets(spark, sf)).select("k", F.col("start").cast("long").alias("start"), F.col("run").cast("long").alias("run"))


@query(f"with {X.HF}, d as (select k, r, c, ((r - 8) * (r - 8) + (c - 8) * (c - 8))::double as d from hf where (r + c) % 3 = 0) select k, r, c, d from d qualify row_number() over (partition by k order by d, r, c) = 1")
def nearest_to_center(spark, sf):
    return maplet.nearest_to_center(X.heights(spark, sf).filter("(r + c) % 3 = 0"), 8.0, 8.0)


_ORBIT = {"ex": "12.5::double * cos(a)", "ey": "12.5::double * sin(a)", "ez": "0.0::double", "t0": "0.0::double", "t1": "0.0::double", "t2": "12.5::double", "l0": "-sqrt(0.5::double) * (cos(a) + sin(a))", "l1": "sqrt(0.5::double) * (cos(a) - sin(a))", "l2": "0.0::double"}


_FAR = "greatest(max(sqrt(x * x + y * y + z * z)) / sin(radians(15.0::double)) / 0.85::double, 1.0::double)"
_TURNED = {c: e.replace("12.5::double", "far") for c, e in _ORBIT.items()}


@query(f"with {X.HF}, d as (select k, {_FAR} as far from hf group by k), r as (select k, far, i as request, radians(i::double) as a from d, range(360) q(i)) select k, request, {', '.join(f'round({e}, 6) + 0.0::double as {c}' for c, e in _TURNED.items())} from r")
def orbit_requests(spark, sf):
    """A turn of cameras about each maplet, as far away as its points need to fill the view."""
    far = raster.filling_distance(X.heights(spark, sf), "k", 30.0)
    return raster.orbits(far, 360, 45.0).select("k", "request", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in _ORBIT])


def flagship(spark, sf):
    return hf_render_shade(spark, sf)

