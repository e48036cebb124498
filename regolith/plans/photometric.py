"""Registered queries: photometry, view selection, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from regolith.functions import sqltext as S
from regolith.functions.vec import micro, sub, unit, vec
from regolith.operators import maplet, photometry, views
from regolith.plans import fixtures as X
from regolith.plans.surface import EYE, GRADIENT, _slopes

QUERIES: dict = {}
SQL: dict[str, str] = {}
CAMS = "cam in (0, 2, 3, 5, 6, 8, 9, 12)"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def observations(spark, sf, steps: int = 1):
    """Samples in eight cameras, read from the 16 x 16 images (f = 16, principal point 7.5): the full chain of an observation.

    With several steps each sample is observed at as many heights, 0.01 apart, and k is k * steps + step.
    """
    s = _slopes(spark, sf)
    if steps > 1:
        s = s.crossJoin(spark.range(steps).withColumnRenamed("id", "step")).withColumn("k", F.col("k") * steps + F.col("step")).withColumn("h", F.col("h") + (F.col("step") - steps // 2) * F.lit(0.01)).drop("step")
    s = s.select("k", "r", "c", ((F.col("c") - 8).cast("double") * F.lit(0.1)).alias("x"), ((F.col("r") - 8).cast("double") * F.lit(0.1)).alias("y"), F.col("h").alias("z"), F.col("p"), F.col("q"), F.col("usable").alias("stencil"))
    cams = maplet.camera_centers(X.cameras(spark).filter(CAMS)).withColumn("f", F.lit(16.0)).withColumn("pp", F.lit(7.5)).withColumn("image_id", F.col("cam") % 4)
    p = maplet.project(s, cams).withColumn("qid", (F.col("k") * 289 + F.col("r") * 17 + F.col("c")) * 16 + F.col("cam"))
    p = p.select("*", *[v.alias(n) for v, n in zip(unit(sub(vec("e0", "e1", "e2"), vec("x", "y", "z"))), ("wx", "wy", "wz"), strict=True)])
    read = maplet.bilinear(p.select("qid", "image_id", "u", "v"), X.images(spark, sf), 16, 16).select("qid", F.col("value").alias("observed"), F.col("usable").alias("read"))
    o = p.join(read, "qid").select("k", "r", "c", "cam", "p", "q", "stencil", "depth", "observed", "read", F.col("s0").alias("sx"), F.col("s1").alias("sy"), F.col("s2").alias("sz"), "wx", "wy", "wz", F.lit(0.5).alias("rho"))
    return photometry.usable(photometry.lunar_lambert(o))


_W = [f"e{i} - {a}" for i, a in enumerate("xyz")]
_LEN = f"greatest(sqrt({' + '.join(f'({w}) * ({w})' for w in _W)}), 1e-6::double)"


def _deriv(slope: str, at: int) -> str:
    dn = [f"(-n{k} * {slope} / (len * len) - {'1.0::double / len' if k == at else '0.0::double'})" for k in range(3)]
    return f"(0.5::double + 1.0::double * ce / (den * den)) * ({dn[0]} * sx + {dn[1]} * sy + {dn[2]} * sz) + (-1.0::double * ci / (den * den)) * ({dn[0]} * wx + {dn[1]} * wy + {dn[2]} * wz)"


OBS = f"""{GRADIENT}, {X.IMG}, {X.CAM}, cc as (select *, {', '.join(f'{e} as e{i}' for i, e in enumerate(EYE))} from cam where {CAMS}),
smp as (select k, r, c, (c - 8)::double * 0.1::double as x, (r - 8)::double * 0.1::double as y, h as z, p, q, usable as stencil from slopes),
pr as (select smp.*, cc.*, {', '.join(f"({S.dot((f'r{i}0', f'r{i}1', f'r{i}2'), ('x', 'y', 'z'))} + t{i}) as {n}" for i, n in enumerate(('cx', 'cy', 'depth')))} from smp, cc),
uv as (select *, 16.0::double * cx / depth + 7.5::double as u, 16.0::double * cy / depth + 7.5::double as v, {', '.join(f'({w}) / {_LEN} as w{a}' for w, a in zip(_W, 'xyz', strict=True))} from pr where depth > 1e-6::double),
cor as (select k, r, c, cam, cam % 4 as image_id, u, v, cast(floor(u) as bigint) as x0, cast(floor(v) as bigint) as y0 from uv where u >= 0 and v >= 0 and u <= 15 and v <= 15),
cn as (select k, r, c, cam, image_id, x0 + i.i as pc, y0 + j.j as pr, (case when i.i = 1 then u - x0 else 1.0::double - (u - x0) end) * (case when j.j = 1 then v - y0 else 1.0::double - (v - y0) end) as w from cor, range(2) i(i), range(2) j(j)),
rd as (select cn.k, cn.r, cn.c, cn.cam, sum(coalesce(value, 0.0::double) * w) as observed, bool_and(coalesce(valid, false)) as read from cn left join img on img.image_id = cn.image_id and img.row = cn.pr and img.col = cn.pc where w <> 0 group by 1, 2, 3, 4),
ll as (select uv.k, uv.r, uv.c, uv.cam, p, q, stencil, observed, coalesce(read, false) as read, depth, s0 as sx, s1 as sy, s2 as sz, wx, wy, wz, sqrt(1.0::double + p * p + q * q) as len from uv left join rd on rd.k = uv.k and rd.r = uv.r and rd.c = uv.c and rd.cam = uv.cam),
nn as (select *, -p / len as n0, -q / len as n1, 1.0::double / len as n2 from ll),
co as (select *, n0 * sx + n1 * sy + n2 * sz as ci, n0 * wx + n1 * wy + n2 * wz as ce from nn),
dd as (select *, greatest(ci + ce, 1e-6::double) as den from co),
obs as materialized (select k, r, c, cam, p, q, observed, 0.5::double * ci + 1.0::double * ci / den as f, {_deriv('p', 0)} as fp, {_deriv('q', 1)} as fq, ci, ce, coalesce(read and observed > 0 and stencil and ce > 0.1::double and ci > 0.1::double, false) as usable from dd)"""


@query(f"with {OBS} select k, r, c, cam, {S.micro('f')} as f, {S.micro('fp')} as fp, {S.micro('fq')} as fq from obs")
def lunar_lambert(spark, sf):
    return observations(spark, sf).filter("depth > 1e-6").select("k", "r", "c", "cam", *[micro(F.col(c)).alias(c) for c in ("f", "fp", "fq")])


@query(f"with {OBS} select k, cam, count(*) filter (where usable) as usable, count(*) as n from obs group by 1, 2")
def usable_mask(spark, sf):
    return observations(spark, sf).filter("depth > 1e-6").groupBy("k", "cam").agg(F.count_if("usable").alias("usable"), F.count("*").alias("n"))


EQ = f"""{OBS}, wr as (select *, observed - 0.5::double * f as res from obs where usable), ww as (select *, least(1.0::double, 0.04::double / greatest(abs(res), 1e-6::double)) as w from wr),
eq as (select k, r, c, sum(w * (0.5::double * fp * (0.5::double * fp))) as a11, sum(w * (0.5::double * fp * (0.5::double * fq))) as a12, sum(w * (0.5::double * fq * (0.5::double * fq))) as a22, sum(w * (0.5::double * fp * res)) as b1, sum(w * (0.5::double * fq * res)) as b2, sum(w * (res * res)) as cost, count(*) as n from ww group by 1, 2, 3)"""


@query(f"with {EQ} select k, r, c, n, {', '.join(f'round({c}, 6) + 0.0::double as {c}' for c in ('a11', 'a12', 'a22', 'b1', 'b2', 'cost'))} from eq")
def huber_normal_eq(spark, sf):
    e = photometry.normal_equations(observations(spark, sf), "k", "r", "c")
    return e.select("k", "r", "c", "n", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("a11", "a12", "a22", "b1", "b2", "cost")])


@query(f"""with {EQ}, t as (select *, a11 + a22 as tr, sqrt((a11 - a22) * (a11 - a22) + 4.0::double * a12 * a12) as gap from eq), u as (select *, (tr - gap) / greatest(tr + gap, 1e-6::double) as ratio, 0.001::double * greatest(tr, 1e-6::double) as lam from t),
v as (select *, n >= 3 and ratio > 1e-4::double as active, (a11 + lam) * (a22 + lam) - a12 * a12 as det from u)
select k, r, c, active, round(case when active then least(greatest(((a22 + lam) * b1 - a12 * b2) / det, -0.3::double), 0.3::double) else 0.0::double end, 5) + 0.0::double as dp, round(case when active then least(greatest(((a11 + lam) * b2 - a12 * b1) / det, -0.3::double), 0.3::double) else 0.0::double end, 5) + 0.0::double as dq from v""")
def slope_step_2x2(spark, sf):
    e = photometry.normal_equations(observations(spark, sf), "k", "r", "c")
    return photometry.slope_step(e).select("k", "r", "c", "active", (F.round("dp", 5) + F.lit(0.0)).alias("dp"), (F.round("dq", 5) + F.lit(0.0)).alias("dq"))


@query(f"with {EQ}, t as (select *, a11 + a22 as tr, sqrt((a11 - a22) * (a11 - a22) + 4.0::double * a12 * a12) as gap, sqrt(cost / greatest(n, 1)) as rms from eq) select k, r, c, round(rms, 6) as rms, round(case when n >= 3 then least(n / 5.0::double, 1.0::double) * least(greatest((tr - gap) / greatest(tr + gap, 1e-6::double), 0.0::double) / 0.03::double, 1.0::double) * exp(-(rms / 0.02::double) * (rms / 0.02::double)) else 0.0::double end, 6) as confidence from t")
def slope_confidence(spark, sf):
    e = photometry.slope_step(photometry.normal_equations(observations(spark, sf), "k", "r", "c"))
    return photometry.confidence(e).select("k", "r", "c", F.round("rms", 6).alias("rms"), F.round("confidence", 6).alias("confidence"))


@query(f"""with {GRADIENT}, g as (select k, r, c, h, p * 0.9::double as p, q * 0.9::double as q, 1.0::double + (r + c) % 3 as w from slopes),
a as (select k, r as o, greatest(c - 1, 0) as lo, least(c + 1, 16) as hi, case when c in (0, 16) then 1.0::double else 0.5::double end as coef, w * (p * 0.1::double - (case when c in (0, 16) then 1.0::double else 0.5::double end) * (coalesce(lead(h) over x, h) - coalesce(lag(h) over x, h))) as res from g window x as (partition by k, r order by c)),
b as (select k, c as o, greatest(r - 1, 0) as lo, least(r + 1, 16) as hi, case when r in (0, 16) then 1.0::double else 0.5::double end as coef, w * (q * 0.1::double - (case when r in (0, 16) then 1.0::double else 0.5::double end) * (coalesce(lead(h) over x, h) - coalesce(lag(h) over x, h))) as res from g window x as (partition by k, c order by r)),
e as (select k, o as r, lo as c, -(coef * res) as v from a union all select k, o, hi, coef * res from a union all select k, lo, o, -(coef * res) from b union all select k, hi, o, coef * res from b)
select k, r, c, round(sum(v), 6) + 0.0::double as v from e group by 1, 2, 3""")
def slope_residual_scatter(spark, sf):
    g = _slopes(spark, sf).select("k", "r", "c", "h", (F.col("p") * 0.9).alias("p"), (F.col("q") * 0.9).alias("q"), (F.lit(1.0) + (F.col("r") + F.col("c")) % 3).alias("w"))
    return photometry.slope_residual_scatter(g, X.SPACING).select("k", "r", "c", (F.round("v", 6) + F.lit(0.0)).alias("v"))


@query(None)
def fit_slopes(spark, sf):
    return photometry.fit_slopes(observations(spark, sf))


@query(None)
def integrate_slopes(spark, sf):
    return photometry.integrate(_slopes(spark, sf).select("k", "r", "c", "h", "p", "q", F.when(F.col("usable"), 1.0).otherwise(0.0).alias("w")), X.SPACING)


@query(None)
def refine(spark, sf):
    return photometry.refine(observations(spark, sf), _slopes(spark, sf), X.SPACING)


NCC = f"""{X.IMG}, pr as (select a.image_id as k, o.o - 2 as off, a.value as va, b.value as vb from img a, range(5) o(o), img b where b.image_id = (a.image_id + 1) % 4 and b.row = a.row and b.col = a.col + o.o - 2 and a.valid and b.valid),
sc as (select k, off, count(*) as n, case when stddev_pop(va) >= 0.01 and stddev_pop(vb) >= 0.01 then corr(va, vb) end as ncc from pr group by 1, 2)"""


def _ncc(spark, sf):
    img = X.images(spark, sf).filter("valid")
    a = img.select(F.col("image_id").alias("k"), "row", "col", F.col("value").alias("a")).crossJoin(spark.range(5).select((F.col("id") - 2).alias("off")))
    b = img.select(F.pmod(F.col("image_id") - 1, F.lit(4)).alias("k"), "row", F.col("col").alias("col2"), F.col("value").alias("b"))
    return photometry.correlation(a.withColumn("col2", F.col("col") + F.col("off")).join(b, ["k", "row", "col2"]), "k", "off")


@query(f"with {NCC} select k, off, n, round(ncc, 6) as ncc from sc")
def stereo_ncc(spark, sf):
    return _ncc(spark, sf).select("k", "off", "n", F.round("ncc", 6).alias("ncc"))


@query(f"with {NCC}, s as (select *, lag(ncc) over (partition by k order by off) as l, lead(ncc) over (partition by k order by off) as r from sc), b as (select * from s qualify row_number() over (partition by k order by ncc desc, off) = 1) select k, off, round(off + 0.5::double * (r - l) / (2.0::double * ncc - l - r), 4) as peak from b where l is not null and r is not null and 2.0::double * ncc - l - r > 1e-4::double")
def stereo_peak(spark, sf):
    return photometry.interior_peak(_ncc(spark, sf), "k", "off", "ncc").select("k", "off", F.round("peak", 4).alias("peak"))


@query(f"with {OBS} select k, cam, count(*) as n from obs where usable group by 1, 2 having count(*) >= 9")
def view_link(spark, sf):
    return views.links(observations(spark, sf), 9)


@query(f"with {X.GR}, e as (select row_number() over (order by a, b) as edge_id, a, b from gr), u as (select a as node, b as neighbor, edge_id from e union all select b, a, edge_id from e) select node, neighbor, row_number() over (partition by node order by edge_id, neighbor) as place from u")
def adjacency(spark, sf):
    e = X.graph(spark, sf).select("a", "b", F.struct("a", "b").alias("edge_id"))
    return views.adjacency(e).select("node", "neighbor", F.col("place").cast("long").alias("place"))


OVER = """m as (select vec_id as k, embedding[1]::double * 2 as x, embedding[2]::double * 2 as y, embedding[3]::double * 2 as z, 0.2::double as radius, case when vec_id % 3 = 0 then 1.0::double else 0.6::double end as nz, case when vec_id % 3 = 0 then 0.0::double else 0.8::double end as nx from embeddings), f as (select k, k % 40 + i as fid from m, range(3) r(i))"""


@query(f"with {OVER}, sh as (select distinct p.k as a, q.k as b from f p join f q using (fid) where p.k < q.k) select a.k as a, b.k as b from m a join m b on a.k < b.k and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.4::double * 0.4::double and a.nx * b.nx + a.nz * b.nz >= 0.9::double join sh on sh.a = a.k and sh.b = b.k")
def overlap_pairs(spark, sf):
    e = X.table(spark, sf, "embeddings")
    third = F.col("k") % 3 == 0
    m = e.select(F.col("vec_id").alias("k"), *[(F.col("embedding")[i].cast("double") * 2).alias(a) for i, a in enumerate("xyz")], F.lit(0.2).alias("radius")).select("*", F.when(third, 0.0).otherwise(0.8).alias("nx"), F.lit(0.0).alias("ny"), F.when(third, 1.0).otherwise(0.6).alias("nz"))
    f = m.select("k", F.explode(F.sequence(F.col("k") % 40, F.col("k") % 40 + 2)).alias("fid"))
    return views.overlaps(m, f, 0.5, 0.9)


_AXES = ("v0", "v1", "v2", "s0", "s1", "s2")


def _views_sql(most: int) -> str:
    """The rounds of the selection one after another, each as two steps: the next image of a maplet, then what that leaves."""
    size = "greatest(sqrt(e0 * e0 + e1 * e1 + e2 * e2), 1e-6::double)"
    steps = [f"with {X.ORDER_CAM}, ce as (select *, {', '.join(f'{e} as e{i}' for i, e in enumerate(EYE))} from oc), z0 as (select k, cam, {', '.join(f'e{i} / {size} as v{i}' for i in range(3))}, s0, s1, s2, 'infinity'::double as far, null::bigint as place from ce)"]
    for n in range(most):
        steps.append(f"n{n} as (select k, cam as nc, {', '.join(f'{x} as n{x}' for x in _AXES)} from z{n} where place is null and far > {2 * (1 - 0.99996)!r}::double qualify row_number() over (partition by k order by far desc, cam desc) = 1)")
        reach = " + ".join(f"pow({x} - n{x}, 2)" for x in _AXES)
        steps.append(f"z{n + 1} as (select z{n}.k, cam, {', '.join(_AXES)}, coalesce(least(far, round({reach}, 9)), far) as far, case when place is null and cam = nc then {n} else place end as place from z{n} left join n{n} on n{n}.k = z{n}.k)")
    return ", ".join(steps) + f" select k, place::bigint as place, cam from z{most} where place is not null"


@query(_views_sql(6))
def select_views_fps(spark, sf):
    c = maplet.camera_centers(X.order_cameras(spark, sf))
    v = unit(vec("e0", "e1", "e2"))
    return views.select_views(c.select("k", "cam", *[x.alias(f"v{i}") for i, x in enumerate(v)], "s0", "s1", "s2"), 6)


@query(f"""with {OBS}, u as (select k, count(*) filter (where usable) as usable, count(*) as valid, 0.004::double * (k + 1) as gsd from obs where cam = 12 group by k), ok as (select * from u where usable >= 4 and usable >= 0.05::double * valid and 0.1::double / gsd >= 4.0::double) select k, usable, row_number() over (order by k) as turn from ok qualify row_number() over (order by k) <= 3""")
def split_eligibility(spark, sf):
    o = observations(spark, sf).filter("cam = 12 and depth > 1e-6").groupBy("k").agg(F.count_if("usable").alias("usable"), F.count("*").alias("valid"))
    f = o.select("*", (F.lit(0.004) * (F.col("k") + 1)).alias("gsd"), F.lit(0.1).alias("spacing"), F.lit(0).alias("level"), F.lit(True).alias("sun_known"))
    return views.split_candidates(f, most=3, coverage=0.05).select("k", "usable", F.col("turn").cast("long").alias("turn"))


@query(f"""with {X.PTS}, p as (select *, embed[4]::double as nx, embed[5]::double as ny, embed[6]::double as nz, 1.0::double + id % 4 as quality from (select pts.*, e.embedding as embed from pts join embeddings e on e.vec_id = pts.id)),
g as (select floor(x / 0.1::double)::bigint as g0, floor(y / 0.1::double)::bigint as g1, floor(z / 0.1::double)::bigint as g2, (nx >= 0)::int as h0, (ny >= 0)::int as h1, (nz >= 0)::int as h2, count(*) as n, sum(quality * x) / sum(quality) as mx, avg(quality) as quality from p group by 1, 2, 3, 4, 5, 6)
select g0, g1, g2, h0, h1, h2, n, round(mx, 6) + 0.0::double as mx, round(quality / (select quantile_cont(quality, 0.5) from g), 6) as relative from g""")
def voxel_fuse(spark, sf):
    e = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate(("x", "y", "z", "nx", "ny", "nz"))])
    f = views.voxel_fuse(e.withColumn("quality", F.lit(1.0) + F.col("id") % 4), 0.1)
    return f.select("g0", "g1", "g2", "h0", "h1", "h2", "n", (F.round("mx", 6) + F.lit(0.0)).alias("mx"), F.round("relative", 6).alias("relative"))

