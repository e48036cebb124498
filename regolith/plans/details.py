"""Registered queries: occlusion, light, depth costs, checks of leaves and cameras, choices of images."""

from __future__ import annotations

from pyspark.sql import functions as F

from regolith.functions.scratch import keep
from regolith.operators import growth, information, maplet, mesh, occlusion, photometry, planner, raster, views
from regolith.plans import fixtures as X
from regolith.plans.photometric import OBS, observations
from regolith.plans.surface import _maplets, _mesh
from regolith.sources import reports

QUERIES: dict = {}
SQL: dict[str, str] = {}
SUN = (0.48, 0.36, 0.8)
STEPS = 17


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _body(spark, sf):
    """Points of all maplets in the body frame, and their faces, numbered over all maplets."""
    p = maplet.body_points(X.heights(spark, sf).select("k", "r", "c", "h", F.lit(True).alias("valid")), _maplets(spark)).select("k", "r", "c", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))
    p = keep(p)
    t = mesh.corners(maplet.vertices(p, X.SIDE), maplet.triangles(X.heights(spark, sf), X.SIDE))
    return p, keep(t.select(F.col("mesh").alias("owner"), (F.col("mesh") * 1000 + F.col("fid")).alias("fid"), *[f"{n}{a}" for n in "abc" for a in "xyz"]))


_TURNED = {"px": "case q when 0 then ox + u when 1 then ox - v when 2 then ox - u else ox + v end", "py": "case q when 0 then oy + v when 1 then oy + u when 2 then oy - v else oy - u end", "pz": "oz + h"}
_D = [f"{x!r}::double" for x in SUN]
TERRAIN = f"""{X.HFM}, bp as materialized (select k, r, c, {', '.join(f'{e} as {n}' for n, e in _TURNED.items())} from (select *, 0.5::double * k as ox, 0.25::double * k as oy, 0.125::double * k as oz, (c - 8.0::double) * 0.1::double as u, (r - 8.0::double) * 0.1::double as v, k % 4 as q from hf)),
bt as materialized (select f.k as owner, f.k * 1000 + fid as fid, {', '.join(f'{n}.p{a} as {n}{a}_' for n in 'abc' for a in 'xyz')} from hfm f {' '.join(f'join bp {n} on {n}.k = f.k and {n}.r * 17 + {n}.c = f.v{i}' for i, n in enumerate('abc'))}),
cov as materialized (select m.k as k, fid from range(8) m(k) join bt on abs(m.k - owner) = 1 where {' and '.join(f'abs({n}{a}_ - {s}::double * m.k) <= 0.8::double + 1e-6::double' for n in 'abc' for a, s in (('x', 0.5), ('y', 0.25)))}),
fr as (select bp.k, r, c, bt.fid, bx_ - ax_ as e1x, by_ - ay_ as e1y, bz_ - az_ as e1z, cx_ - ax_ as e2x, cy_ - ay_ as e2y, cz_ - az_ as e2z, px - ax_ as sx, py - ay_ as sy, pz - az_ as sz from bp, bt),
fm as (select *, {_D[1]} * e2z - {_D[2]} * e2y as ux, {_D[2]} * e2x - {_D[0]} * e2z as uy, {_D[0]} * e2y - {_D[1]} * e2x as uz, sy * e1z - sz * e1y as vx, sz * e1x - sx * e1z as vy, sx * e1y - sy * e1x as vz from fr),
fd as (select *, e1x * ux + e1y * uy + e1z * uz as det from fm),
met as (select distinct k, r, c, fid from fd where abs(det) > 1e-12::double and (sx * ux + sy * uy + sz * uz) / det >= 0 and ({_D[0]} * vx + {_D[1]} * vy + {_D[2]} * vz) / det >= 0 and (sx * ux + sy * uy + sz * uz) / det + ({_D[0]} * vx + {_D[1]} * vy + {_D[2]} * vz) / det <= 1 and (e2x * vx + e2y * vy + e2z * vz) / det > 1e-5::double)"""


@query(f"with {TERRAIN} select k, count(*) as n, sum(fid)::bigint as fids from cov group by k")
def covered_faces(spark, sf):
    """Faces of maplets next in number that lie over a maplet's own grid."""
    _, t = _body(spark, sf)
    return _covered(spark, t).groupBy("k").agg(F.count("*").alias("n"), F.sum("fid").alias("fids"))


def _covered(spark, faces):
    m = _maplets(spark)
    near = m.select("k", F.explode(F.array(F.col("k") - 1, F.col("k") + 1)).alias("owner"))
    return keep(occlusion.covered_faces(faces, m, near))


@query(f"with {TERRAIN} select distinct met.k, r, c from met left join cov on cov.k = met.k and cov.fid = met.fid where cov.fid is null")
def sun_shadow(spark, sf):
    """Samples of all maplets from which terrain hides the Sun."""
    p, t = _body(spark, sf)
    rays = p.select((F.col("k") * 289 + F.col("r") * 17 + F.col("c")).alias("rid"), "k", *[F.col(a).alias(f"o{a}") for a in "xyz"], *[F.lit(x).alias(f"d{a}") for a, x in zip("xyz", SUN, strict=True)])
    hidden = occlusion.hidden_rays(occlusion.until_out(rays, t, 1e-5), t, _covered(spark, t), 0.25, 1e-5)
    return hidden.select(F.floor(F.col("rid") / 289).alias("k"), F.floor(F.col("rid") % 289 / 17).alias("r"), (F.col("rid") % 17).alias("c"))


GRAM = f"{OBS}, lit as (select k, r, c, sx, sy, sz from dd where coalesce(read and observed > 0 and stencil and ce > 0.1::double and ci > 0.1::double, false)), gram as (select k, r, c, count(*) as n, {', '.join(f'sum(s{a} * s{b}) as g{a}{b}' for i, a in enumerate('xyz') for b in 'xyz'[i:])} from lit group by 1, 2, 3)"


@query(f"with {GRAM} select k, r, c, n, {', '.join(f'round(g{a}{b}, 6) + 0.0::double as g{a}{b}' for i, a in enumerate('xyz') for b in 'xyz'[i:])}, round(gxx * (gyy * gzz - gyz * gyz) - gxy * (gxy * gzz - gyz * gxz) + gxz * (gxy * gyz - gyy * gxz), 6) + 0.0::double as volume from gram")
def light_gram(spark, sf):
    """The Gram matrix of the lights of each sample; its volume is the product of the three eigenvalues."""
    g = photometry.light_gram(observations(spark, sf), "k", "r", "c")
    names = {f"g{a}{b}": f"a{i + 1}{j + 1}" for i, a in enumerate("xyz") for j, b in enumerate("xyz") if i <= j}
    return g.select("k", "r", "c", "n", *[(F.round(a, 6) + F.lit(0.0)).alias(n) for n, a in names.items()], (F.round(F.col("low") * F.col("middle") * F.col("high"), 6) + F.lit(0.0)).alias("volume"))


@query(None)
def photometric_depth(spark, sf):
    """Of each sample the offset at which its observations agree best with one normal, out of 17 trial heights."""
    o = keep(observations(spark, sf, STEPS).withColumn("step", F.col("k") % STEPS).withColumn("k", F.floor(F.col("k") / STEPS)).withColumn("offset", (F.col("step") - STEPS // 2) * F.lit(0.01)))
    costs = photometry.depth_costs(o.filter(F.col("step") == STEPS // 2), o)
    return growth.depth_minimum(costs.withColumn("s", F.col("r") * X.SIDE + F.col("c"))).select("k", "s", F.round("offset", 6).alias("offset"), F.round("sharpness", 6).alias("sharpness"))


@query(f"with {X.TRI} select k as mesh, round(sqrt(max(greatest({', '.join('pow({0}x - mx, 2) + pow({1} - my, 2) + pow({0}z - mz, 2)'.format(n, 'by_' if n == 'b' else n + 'y') for n in 'abc')}))), 6) as radius from geo group by k")
def mesh_radius(spark, sf):
    return mesh.max_radius(mesh.face_geometry(*_mesh(spark, sf))).select("mesh", F.round("radius", 6).alias("radius"))


@query(f"with {X.TRI} select k as mesh, fid, v0, v1, v2 from geo where fid // 64 = 3")
def block_faces(spark, sf):
    g = mesh.face_geometry(*_mesh(spark, sf))
    return mesh.block_faces(g, g.select("mesh", "fid", F.floor(F.col("fid") / 64).alias("block")), 3).select("mesh", "fid", "v0", "v1", "v2")


@query(f"with {X.HFM}, m as (select k, fid from hfm where fid % 7 <> 0 union all select k, fid from hfm where fid % 5 = 0 union all select k, 600 + fid from hfm where fid < 4), h as (select k, fid, count(*) as n from m group by 1, 2) select k as mesh, count(*) filter (where n is null) as missing, count(*) filter (where f.fid is not null and n > 1) as repeated, count(*) filter (where f.fid is null) as unknown from hfm f full join h using (k, fid) group by k")
def leaf_integrity(spark, sf):
    f = _mesh(spark, sf)[1]
    m = f.filter("fid % 7 <> 0").select("mesh", "fid").unionByName(f.filter("fid % 5 = 0").select("mesh", "fid")).unionByName(f.filter("fid < 4").select("mesh", (F.col("fid") + 600).alias("fid")))
    return mesh.leaf_integrity(f, m)


@query(f"with {X.HF} select k, r, c from hf where k % 3 <> 1")
def active_samples(spark, sf):
    s = maplet.complete_grid(X.heights(spark, sf), _maplets(spark))
    return maplet.active_samples(s, _maplets(spark).select("k", (F.col("k") % 3 != 1).alias("active"))).select("k", "r", "c")


@query("select o_orderkey as cam, case o_orderkey % 5 when 1 then 'the rotation is not orthonormal' when 2 then 'the focal length is not positive' when 3 then 'the frame has no usable size' when 4 then 'the rotation mirrors' end as error from orders")
def camera_faults(spark, sf):
    """Cameras of all orders, most of them spoilt in one of four ways."""
    c = X.order_cameras(spark, sf).withColumn("way", F.col("cam") % 5)
    c = c.withColumn("r00", F.when(F.col("way") == 1, F.col("r00") + 0.5).otherwise(F.col("r00"))).withColumn("f", F.when(F.col("way") == 2, -F.col("f")).otherwise(F.col("f"))).withColumn("side", F.when(F.col("way") == 3, 100000).otherwise(F.col("side")))
    c = c.withColumns({f"r2{j}": F.when(F.col("way") == 4, -F.col(f"r2{j}")).otherwise(F.col(f"r2{j}")) for j in range(3)})
    return raster.camera_faults(c)


FACTS = "f as (select label as k, vec_id as cam, 0.01::double + (vec_id * 37 % 101)::double / 1000.0::double as gsd, (vec_id * 7 % 40)::bigint as usable, 60::bigint as valid, 0.1::double as spacing from embeddings)"


@query(f"with {FACTS} select k, cam, gsd from f where spacing / gsd >= 4.0::double and usable >= 4 and usable >= 0.25::double * valid qualify row_number() over (partition by k order by gsd, cam) = 1")
def sharpest_image(spark, sf):
    e = X.table(spark, sf, "embeddings")
    f = e.select(F.col("label").alias("k"), F.col("vec_id").alias("cam"), (F.lit(0.01) + (F.col("vec_id") * 37 % 101).cast("double") / 1000.0).alias("gsd"), (F.col("vec_id") * 7 % 40).alias("usable"), F.lit(60).alias("valid"), F.lit(0.1).alias("spacing"))
    return views.sharpest(f)


@query("select distinct label as k from embeddings where vec_id % 5 = 0 union select distinct label + 3 from embeddings where vec_id % 7 = 0")
def to_update(spark, sf):
    e = X.table(spark, sf, "embeddings")
    return views.to_update(e.filter("vec_id % 5 = 0").select(F.col("label").alias("k")), e.filter("vec_id % 7 = 0").select((F.col("label") + 3).alias("k")))


_SIDE = "select vec_id as pair, embedding[{0}]::double as lo_u, embedding[{0}]::double + 0.2::double as hi_u, embedding[{1}]::double as lo_v, embedding[{1}]::double + 0.2::double as hi_v, 0.1::double as half_u, 0.1::double as half_v from embeddings"
_MEETS = "lo_u <= half_u and hi_u >= -half_u and lo_v <= half_v and hi_v >= -half_v"


@query(f"with a as ({_SIDE.format(1, 2)}), b as ({_SIDE.format(3, 4)}) select pair from a where {_MEETS} intersect select pair from b where {_MEETS}")
def footprints_meet(spark, sf):
    e = X.table(spark, sf, "embeddings")
    side = lambda i, j: e.select(F.col("vec_id").alias("pair"), *[x.alias(n) for n, at in (("u", i), ("v", j)) for x, n in ((F.col("embedding")[at].cast("double"), f"lo_{n}"), (F.col("embedding")[at].cast("double") + F.lit(0.2), f"hi_{n}"), (F.lit(0.1), f"half_{n}"))])
    return growth.footprints_meet(side(0, 1), side(2, 3))


@query(f"with {X.HF}, s as (select k, r * 17 + c as s, x, y from hf), m as (select vec_id % 8 as k, vec_id % 289 as s, 1.0::double + vec_id % 3 as weight, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings) select k, s, sum(weight) as weight, round(sum(weight * ((m.x - s.x) * 0.6::double + (m.y - s.y) * 0.0::double + m.z * 0.8::double)) / sum(weight), 6) + 0.0::double as height from m join s using (k, s) group by 1, 2")
def height_anchors(spark, sf):
    s = X.heights(spark, sf).select("k", (F.col("r") * 17 + F.col("c")).alias("s"), F.col("x").alias("bx"), F.col("y").alias("by"), F.lit(0.0).alias("bz"), F.lit(0.6).alias("nx"), F.lit(0.0).alias("ny"), F.lit(0.8).alias("nz"))
    v = F.col("vec_id")
    m = X.table(spark, sf, "embeddings").select((v % 8).alias("k"), (v % 289).alias("s"), (F.lit(1.0) + v % 3).alias("weight"), *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")])
    return growth.height_anchors(s, m).select("k", "s", "weight", (F.round("height", 6) + F.lit(0.0)).alias("height"))


@query("select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1")
def first_wins(spark, sf):
    return reports.first_wins(X.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("select label as scene, min(vec_id) as slot from embeddings where embedding[1] > 0.1 group by label")
def first_accepted(spark, sf):
    p = X.table(spark, sf, "embeddings").select(F.col("label").alias("scene"), F.col("vec_id").alias("slot"), (F.col("embedding")[0] > 0.1).alias("accepted"))
    return information.first_accepted(p)


@query("select o_orderkey as id, round((((o_orderkey % 256) / 255.0::double) * 0.2126::double + ((o_orderkey * 7 % 256) / 255.0::double) * 0.7152::double + ((o_orderkey * 13 % 256) / 255.0::double) * 0.0722::double - 0.1::double) / 2.0::double, 6) + 0.0::double as value from orders")
def radiance(spark, sf):
    k = F.col("o_orderkey")
    one = lambda x: photometry.radiance(x % 256, 255.0)
    gray = photometry.luma(one(k), one(k * 7), one(k * 13))
    return X.table(spark, sf, "orders").select(k.alias("id"), (F.round(photometry.radiance(gray, None, 0.1, 2.0), 6) + F.lit(0.0)).alias("value"))


@query(f"with {X.SUPPLIER_MAPLETS} select k, round((nx - 1) * spacing, 9) as extent_u, round((ny - 1) * spacing, 9) as extent_v from sm")
def maplet_extents(spark, sf):
    return maplet.extents(X.supplier_maplets(spark, sf)).select("k", F.round("extent_u", 9).alias("extent_u"), F.round("extent_v", 9).alias("extent_v"))


@query(f"""with {X.TRI}, n as (select k as mesh, step, area, mz, nx * cos(step * {2 * 3.141592653589793 / 8!r}::double) * 0.6::double - ny * sin(step * {2 * 3.141592653589793 / 8!r}::double) * 0.6::double + nz * 0.8::double as cos_i from geo, range(8) s(step)), w as (select *, area / (1.0::double + exp(-10.0::double * cos_i)) as w from n)
select mesh, step, round(sum(w * mz) / sum(w), 6) as pooled, round(sum(w), 6) as lit from w group by 1, 2""")
def phase_pool(spark, sf):
    n = planner.incidence(mesh.face_geometry(*_mesh(spark, sf)), (0.6, 0.0, 0.8), 8).withColumnRenamed("mz", "value")
    return planner.phase_pool(n, "mesh", "step").select("mesh", F.col("step").cast("long").alias("step"), F.round("pooled", 6).alias("pooled"), F.round("lit", 6).alias("lit"))
