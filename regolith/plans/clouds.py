"""Registered queries: point clouds, sampling, spatial joins and registration."""

from __future__ import annotations


from pyspark.sql import functions as F

from regolith.functions import sqltext as S
from regolith.functions.vec import micro
from regolith.operators import mesh, register, sampling, spatial
from regolith.plans import fixtures as X
from regolith.plans.surface import _mesh

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _clouds(spark, sf):
    p = X.clouds(spark, sf).select("id", "x", "y", "z", "ref")
    return p.filter(~F.col("ref")).drop("ref"), p.filter("ref").drop("ref")


def _sides(spark, sf):
    rec, ref = _clouds(spark, sf)
    return rec.withColumnRenamed("id", "qid"), ref.withColumnRenamed("id", "rid")


D2 = "((q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y) + (q.z - r.z) * (q.z - r.z))"
PAIRS = f"{X.PTS}, pr as (select q.id as qid, r.id as rid, {D2} as d2 from rec q, ref r)"


@query(f"with {PAIRS}, b as (select qid, min(row(d2, rid)) as b from pr group by qid) select qid, b[2] as rid, {S.micro('sqrt(b[1])')} as d from b")
def nn_exact(spark, sf):
    return spatial.nearest(*_sides(spark, sf), 0.5).select("qid", "rid", micro(F.sqrt("d2")).alias("d"))


@query(f"with {PAIRS}, b as (select qid, min(row(d2, rid)) as b from pr where d2 < 0.0225::double group by qid) select rec.id as qid, coalesce(b[2], -1) as rid, coalesce({S.micro('sqrt(b[1])')}, -1) as d from rec left join b on b.qid = rec.id")
def nn_bounded(spark, sf):
    return spatial.nearest_within(*_sides(spark, sf), 0.15).select("qid", F.coalesce("rid", F.lit(-1)).alias("rid"), F.coalesce(micro(F.sqrt("d2")), F.lit(-1)).alias("d"))


@query(f"with {PAIRS} select qid, rid, {S.micro('d2')} as d2 from pr where d2 <= 0.2::double * 0.2::double")
def radius_pairs(spark, sf):
    return spatial.radius_pairs(*_sides(spark, sf), 0.2).select("qid", "rid", micro(F.col("d2")).alias("d2"))


def _faces(spark, sf):
    g = mesh.proper_faces(mesh.face_geometry(*_mesh(spark, sf)))
    return g.select("mesh", F.col("fid").cast("long").alias("fid"), *[f"{n}{x}" for n in "abc" for x in "xyz"], micro(F.col("area")).alias("weight"))


CDF = f"{X.TRI}, wf as (select *, {S.micro('area')} as weight from geo), cdf as materialized (select *, sum(weight) over (partition by k order by fid rows unbounded preceding) as upto, sum(weight) over (partition by k) as total from wf)"


@query(f"with {CDF} select k as mesh, fid, upto::bigint as upto from cdf")
def sample_area_cdf(spark, sf):
    return sampling.running_weight(_faces(spark, sf)).select("mesh", "fid", "upto")


@query(f"with {CDF}, mx as (select k, max(total) as total from cdf group by k), t as (select k, tid, total * ((tid * 37) % 101) / 101.0::double as t from mx, range(101) r(tid)) select t.k as mesh, tid, min(fid) as fid from t join cdf on cdf.k = t.k and cdf.upto >= t.t group by 1, 2")
def sample_cdf_lookup(spark, sf):
    cdf = sampling.running_weight(_faces(spark, sf))
    t = cdf.groupBy("mesh").agg(F.max("total").alias("total")).crossJoin(spark.range(101).withColumnRenamed("id", "tid"))
    return sampling.cdf_lookup(t.select("mesh", "tid", (F.col("total") * ((F.col("tid") * 37) % 101) / F.lit(101.0)).alias("t")), cdf)


@query(f"""with {CDF}, mx as (select k, max(total) as total from cdf group by k), s as (select k, i, total from mx, range(500) r(i)),
f as (select s.k, s.i, min(fid) as fid from s join cdf on cdf.k = s.k and (2 * s.i + 1) * s.total <= 1000 * cdf.upto group by 1, 2),
b as (select f.*, sqrt(fmod((i + 0.5::double) * 0.61803398875::double, 1.0::double)) as root, fmod((i + 0.5::double) * 0.41421356237::double, 1.0::double) as sec from f)
select b.k as mesh, i as sample, b.fid, {', '.join(S.micro(f'a{x} * (1.0::double - root) + b{x if x != "y" else "y_"} * (root * (1.0::double - sec)) + c{x} * (root * sec)') + f' as p{x}' for x in 'xyz')} from b join cdf on cdf.k = b.k and cdf.fid = b.fid""")
def sample_stratified(spark, sf):
    return sampling.stratified(_faces(spark, sf), 500).select("mesh", "sample", "fid", *[micro(F.col(f"p{x}")).alias(f"p{x}") for x in "xyz"])


_HASH = "('0x' || substr(md5('7:' || k || ':' || tid || ':{0}'), 1, 13))::bigint::double / 4503599627370496.0::double"


@query(f"""with {CDF}, mx as (select k, max(total) as total from cdf group by k), t as (select k, tid, {_HASH.format(0)} * total::double as t, {_HASH.format(1)} as u0, {_HASH.format(2)} as v0 from mx, range(200) r(tid)),
uv as (select *, case when u0 + v0 > 1 then 1 - u0 else u0 end as u, case when u0 + v0 > 1 then 1 - v0 else v0 end as v from t), f as (select uv.k, tid, any_value(u) as u, any_value(v) as v, min(fid) as fid from uv join cdf on cdf.k = uv.k and cdf.upto >= uv.t group by 1, 2)
select f.k as mesh, tid as sample, f.fid, {', '.join(S.micro('a{0} + u * (b{1} - a{0}) + v * (c{0} - a{0})'.format(x, x if x != 'y' else 'y_')) + f' as p{x}' for x in 'xyz')} from f join cdf on cdf.k = f.k and cdf.fid = f.fid""")
def sample_random(spark, sf):
    return sampling.random_samples(_faces(spark, sf), 200, 7).select("mesh", "sample", "fid", *[micro(F.col(f"p{x}")).alias(f"p{x}") for x in "xyz"])


@query(f"with {X.PTS}, l as (select min(x) as lx, max(x) as hx, min(y) as ly, max(y) as hy, min(z) as lz, max(z) as hz from ref) select round(avg((exists (select 1 from ref r where {D2} < 0.0625::double))::int::double), 9) as precision from rec q")
def fscore_precision(spark, sf):
    rec, ref = _clouds(spark, sf)
    return register.f_score(rec, ref, 0.25).select(F.round("precision", 9).alias("precision"))


@query(f"""with {PAIRS}, p as (select avg(case when m < 0.0625::double then 1.0::double else 0.0::double end) as p, avg(sqrt(m)) as dp from (select qid, min(d2) as m from pr group by qid)), r as (select avg(case when m < 0.0625::double then 1.0::double else 0.0::double end) as r, avg(sqrt(m)) as dr from (select rid, min(d2) as m from pr group by rid)),
b as (select sqrt(power(max(x) - min(x), 2) + power(max(y) - min(y), 2) + power(max(z) - min(z), 2)) as diagonal from ref)
select round(2.0::double * p * r / (p + r), 6) as f, round((dp + dr) / 2.0::double / diagonal, 6) as chamfer from p, r, b""")
def fscore_chamfer(spark, sf):
    rec, ref = _clouds(spark, sf)
    a = spatial.nearest(rec.withColumnRenamed("id", "qid"), ref.withColumnRenamed("id", "rid"), 0.5).agg(F.avg(F.sqrt("d2")).alias("dp"))
    b = spatial.nearest(ref.withColumnRenamed("id", "qid"), rec.withColumnRenamed("id", "rid"), 0.5).agg(F.avg(F.sqrt("d2")).alias("dr"))
    size = ref.agg(F.sqrt(sum((F.pow(F.max(c) - F.min(c), 2) for c in "yz"), F.pow(F.max("x") - F.min("x"), 2))).alias("diagonal"))
    return register.f_score(rec, ref, 0.25).crossJoin(a).crossJoin(b).crossJoin(size).select(F.round("f", 6).alias("f"), F.round((F.col("dp") + F.col("dr")) / 2.0 / F.col("diagonal"), 6).alias("chamfer"))


@query(f"with {PAIRS}, d as (select sqrt(min(d2)) as d from pr group by qid), q as (select quantile_cont(d, 0.9) as q from d) select round(q, 6) as q, count(*) as kept, round(sqrt(avg(d * d)), 6) as rms from d, q where d <= q group by q")
def trimmed_rms(spark, sf):
    d = spatial.nearest(*_sides(spark, sf), 0.5).select(F.sqrt("d2").alias("d"))
    return register.trimmed_rms(d).select(F.round("q", 6).alias("q"), "kept", F.round("rms", 6).alias("rms"))


@query(f"with {X.PTS} select ref, count(*) as n, {', '.join(f'round(avg({a}), 6) as m{a}' for a in 'xyz')}, {', '.join(f'round(covar_samp({a}, {b}), 6) as c{a}{b}' for i, a in enumerate('xyz') for b in 'xyz'[i:])} from pts group by ref")
def pca_moments(spark, sf):
    m = register.moments(X.clouds(spark, sf), "ref")
    return m.select("ref", "n", *[F.round(c, 6).alias(c) for c in m.columns if c[0] in "mc"])


@query(f"with {PAIRS}, b as (select qid, min(row(d2, rid)) as b from pr group by qid), j as (select q.x as sx, q.y as sy, q.z as sz, r.x as dx, r.y as dy, r.z as dz from b join rec q on q.id = qid join ref r on r.id = b[2]) select count(*) as n, round(sum(sx), 6) as sum_sx, round(sum(dz), 6) as sum_dz, round(sum(dx * sy), 6) as sum_dxsy, round(sum(sx * sx + sy * sy + sz * sz), 6) as sum_ss from j")
def umeyama_sums(spark, sf):
    q, r = _sides(spark, sf)
    n = spatial.nearest(q, r, 0.5).select("qid", "rid")
    j = n.join(q.select("qid", *[F.col(a).alias(f"s{a}") for a in "xyz"]), "qid").join(r.select("rid", *[F.col(a).alias(f"d{a}") for a in "xyz"]), "rid")
    return register.pair_sums(j).select("n", *[F.round(c, 6).alias(c) for c in ("sum_sx", "sum_dz", "sum_dxsy", "sum_ss")])


_ROT = ", ".join("(" + ", ".join([str(k)] + [f"{x!r}::double" for row in g for x in row]) + ")" for k, g in enumerate(register.cube_rotations()))


@query(f"""with {X.PTS}, rot(g, r00, r01, r02, r10, r11, r12, r20, r21, r22) as (values {_ROT}),
q as (select g, id, {', '.join(f'r{i}0 * x + r{i}1 * y + r{i}2 * z as {a}' for i, a in enumerate('xyz'))} from rec, rot), m as (select q.g, q.id, min({D2}) as d2 from q, ref r group by 1, 2), e as (select g::bigint as g, round(avg(sqrt(d2)), 6) as error from m group by g)
select g, error from e order by error, g limit 4""")
def cube_rotations_rank(spark, sf):
    return _ranked(spark, *_sides(spark, sf))


def _ranked(spark, q, r):
    rows = [(k, *[x for row in g for x in row]) for k, g in enumerate(register.cube_rotations())]
    rot = spark.createDataFrame(rows, "g long, " + ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)))
    turned = q.crossJoin(F.broadcast(rot)).select((F.col("qid") * 100 + F.col("g")).alias("qid"), *[(F.col(f"r{i}0") * F.col("x") + F.col(f"r{i}1") * F.col("y") + F.col(f"r{i}2") * F.col("z")).alias(a) for i, a in enumerate("xyz")])
    e = spatial.nearest(turned, r, 0.5).groupBy((F.col("qid") % 100).alias("g")).agg(F.round(F.avg(F.sqrt("d2")), 6).alias("error"))
    return e.orderBy("error", "g").limit(4)


@query(None)
def icp_register(spark, sf):
    rec, ref = _clouds(spark, sf)
    return register.align(rec, ref)


@query(None)
def mesh_similarity(spark, sf):
    rec, ref = _clouds(spark, sf)
    return register.cloud_similarity(rec, ref, 0.05)


QP = "sin(i * 0.37::double) * 0.7::double as x, cos(i * 0.53::double) * 0.7::double as y"


@query(f"""with {X.TRI}, p as (select i as pid, ((i * 7) % 160) * 0.01::double - 0.795::double as x, ((i * 13) % 160) * 0.01::double - 0.793::double as y from range(300) r(i)), t as (select * from geo),
j as (select k, pid, fid, x, y, ax, ay, az, bx - ax as bx, by_ - ay as by_, bz - az as bz, cx - ax as cx, cy - ay as cy, cz - az as cz from p, t), d as (select *, bx * cy - by_ * cx as det, x - ax as dx, y - ay as dy from j),
u as (select *, (dx * cy - dy * cx) / det as u, (bx * dy - by_ * dx) / det as v from d where det <> 0), h as (select *, az + u * bz + v * cz as z from u where u >= -1e-6::double and v >= -1e-6::double and u + v <= 1.000001::double),
b as (select k, pid, min(row(abs(z), fid, z)) as b from h where abs(z) <= 0.4::double group by k, pid) select m.k as mesh, p.pid, {S.micro('b[3]')} as z, b[2] as fid from range(8) m(k) cross join p left join b on b.k = m.k and b.pid = p.pid""")
def point_heights(spark, sf):
    """The points over each maplet's mesh."""
    f = _faces(spark, sf)
    p = spark.range(300).select(F.col("id").alias("pid"), (((F.col("id") * 7) % 160) * F.lit(0.01) - F.lit(0.795)).alias("x"), (((F.col("id") * 13) % 160) * F.lit(0.01) - F.lit(0.793)).alias("y"))
    every = p.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("mesh"))
    return spatial.heights_on_plane(every, f, 0.1, 0.4, on=("mesh",)).select("mesh", "pid", micro(F.col("z")).alias("z"), "fid")


RAY = f"""{X.TRI}, t as (select * from geo), o as (select k, r * 17 + c as rid, x as ox, y as oy, z + 1e-4::double as oz from hf), ray as (select *, 0.6::double as dx, 0.0::double as dy, 0.8::double as dz, 1.5::double as far from o),
m as (select ray.k, rid, far, bx - ax as e1x, by_ - ay as e1y, bz - az as e1z, cx - ax as e2x, cy - ay as e2y, cz - az as e2z, ox - ax as sx, oy - ay as sy, oz - az as sz, dx, dy, dz from ray join t on t.k = ray.k),
n as (select *, dy * e2z - dz * e2y as px, dz * e2x - dx * e2z as py, dx * e2y - dy * e2x as pz, sy * e1z - sz * e1y as qx, sz * e1x - sx * e1z as qy, sx * e1y - sy * e1x as qz from m),
k2 as (select *, e1x * px + e1y * py + e1z * pz as det from n), h as (select distinct k, rid from k2 where abs(det) > 1e-12::double and (sx * px + sy * py + sz * pz) / det >= 0 and (dx * qx + dy * qy + dz * qz) / det >= 0 and (sx * px + sy * py + sz * pz) / det + (dx * qx + dy * qy + dz * qz) / det <= 1 and (e2x * qx + e2y * qy + e2z * qz) / det > 1e-5::double and (e2x * qx + e2y * qy + e2z * qz) / det < far - 1e-5::double)"""


@query(f"with {RAY} select k as mesh, rid from ray where not exists (select 1 from h where h.k = ray.k and h.rid = ray.rid)")
def ray_clear(spark, sf):
    """The rays from each maplet's samples that its own mesh leaves clear."""
    s = X.heights(spark, sf)
    rays = s.select(F.col("k").alias("mesh"), (F.col("r") * 17 + F.col("c")).alias("rid"), F.col("x").alias("ox"), F.col("y").alias("oy"), (F.col("z") + F.lit(1e-4)).alias("oz"), F.lit(0.6).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.8).alias("dz"), F.lit(1.5).alias("far"))
    return spatial.clear_rays(rays, _faces(spark, sf), 0.25, 1e-5, on=("mesh",)).select("mesh", "rid")
