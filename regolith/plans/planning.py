"""Registered queries: OBJ text, planning, streaming."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from regolith.functions import sqltext as S
from regolith.functions.scratch import keep, shared_dir
from regolith.functions.vec import micro
from regolith.operators import maplet, mesh, planner, raster
from regolith.plans import fixtures as X
from regolith.plans.surface import EYE, RENDER, _mesh
from regolith.sources import obj
from regolith.streaming import render_queue

QUERIES: dict = {}
SQL: dict[str, str] = {}
SUN = (0.6, 0.0, 0.8)
SPIN, CENTER, RADIUS = (2.0, -3.0, 1.0), (2.3, -3.2, 1.1), 2.0


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


WRITTEN = f"{X.HF}, wv as (select k, r, c, row_number() over (partition by k order by r, c) - 1 as n from hf)"


@query(f"""with {WRITTEN}, wc as (select a.k, a.r, a.c, a.n as n0, b.n as n1, d.n as n2, c.n as n3 from wv a join wv b on b.k = a.k and b.r = a.r and b.c = a.c + 1 join wv c on c.k = a.k and c.r = a.r + 1 and c.c = a.c join wv d on d.k = a.k and d.r = a.r + 1 and d.c = a.c + 1),
wf as (select k, r, c, 0 as half, n0 as v0, n1 as v1, n2 as v2 from wc union all select k, r, c, 1, n0, n2, n3 from wc where (r + c) % 4 <> 3)
select k as mesh, row_number() over (partition by k order by r, c, half) - 1 as fid, v0, v1, v2 from wf""")
def obj_faces(spark, sf):
    """Triangles of OBJ text with fans, references of all kinds, notes and carriage returns."""
    return obj.faces_of(X.written_mesh(spark, sf)).select("mesh", "fid", "v0", "v1", "v2")


@query(f"with {WRITTEN} select k as mesh, n as vid, c - 8 as x, r - 8 as y from wv")
def obj_vertices(spark, sf):
    v = obj.vertices_of(X.written_mesh(spark, sf))
    return v.select("mesh", F.col("vid").cast("long").alias("vid"), *[F.round(F.col(a).cast("double") * 10).cast("long").alias(a) for a in "xy"])


@query(f"""with {X.HFM}, used as (select distinct k, unnest([v0, v1, v2]) as vid from hfm), dense as (select k, vid, row_number() over (partition by k order by vid) as n from used)
select f.k as mesh, fid as no, 'f ' || a.n || ' ' || b.n || ' ' || c.n as line from hfm f join dense a on a.k = f.k and a.vid = v0 join dense b on b.k = f.k and b.vid = v1 join dense c on c.k = f.k and c.vid = v2""")
def obj_export_lines(spark, sf):
    return obj.obj_lines(*_mesh(spark, sf)).filter("part = 1").select("mesh", "no", "line")


def _positions(spark):
    return maplet.camera_centers(X.cameras(spark)).select(F.col("cam").alias("pos"), F.col("e0").alias("px"), F.col("e1").alias("py"), F.col("e2").alias("pz"))


EYES = f"{X.ORDER_CAM}, ps as (select k, cam as pos, o_orderdate, {', '.join(f'{e} as p{a}' for e, a in zip(EYE, 'xyz', strict=True))} from oc)"
GRID = f"{EYES}, gd as (select ps.*, pos * 6 + step as cand, step * {2 * math.pi / 6!r}::double as phase from ps, range(6) s(step))"


def _places(spark, sf):
    """A position for each order; a customer's are one scene."""
    c = maplet.camera_centers(X.order_cameras(spark, sf))
    return c.select("k", "o_orderdate", F.col("cam").alias("pos"), *[F.col(f"e{i}").alias(f"p{a}") for i, a in enumerate("xyz")])


@query(f"with {GRID} select cand, pos, {S.micro('phase')} as phase from gd")
def candidates_grid(spark, sf):
    return planner.candidate_grid(_places(spark, sf), 6).select("cand", "pos", micro(F.col("phase")).alias("phase"))


def _told(c):
    """Candidates with what a plan knows of them."""
    return c.select("*", *[F.lit(x).alias(f"s{a}") for a, x in zip("xyz", SUN, strict=True)], (F.col("cand") * 37 % 50).cast("double").alias("time"), (F.col("cand") % 11 == 3).alias("selected"), (F.col("cand") % 7 != 0).alias("valid"), (F.col("cand") % 5).cast("double").alias("travel"))


def _framed(spark):
    return planner.body_frame(_told(planner.candidate_grid(_positions(spark), 6)).withColumn("scene", F.lit("one")), SPIN, CENTER)


def _framed_orders(spark, sf):
    return planner.body_frame(_told(planner.candidate_grid(_places(spark, sf), 6)).withColumnRenamed("k", "scene"), SPIN, CENTER)


_off = [f"(p{a} - {x!r}::double)" for a, x in zip("xyz", SPIN, strict=True)]
TOLD = f"{GRID}, st as (select *, (cand * 37 % 50)::double as time, cand % 11 = 3 as selected, cand % 7 <> 0 as valid, (cand % 5)::double as travel from gd)"


@query(f"with {GRID} select cand, round({SPIN[0]!r}::double + {_off[0]} * cos(phase) + {_off[1]} * sin(phase), 6) + 0.0::double as bx, round({SPIN[1]!r}::double + {_off[1]} * cos(phase) - {_off[0]} * sin(phase), 6) + 0.0::double as by_, round(pz, 6) as bz, round(0.6::double * cos(phase), 6) + 0.0::double as ux, round(-0.6::double * sin(phase), 6) + 0.0::double as uy from gd")
def body_frame(spark, sf):
    return _framed_orders(spark, sf).select("cand", *[(F.round(x, 6) + F.lit(0.0)).alias(n) for x, n in (("bx", "bx"), ("by", "by_"), ("bz", "bz"), ("ux", "ux"), ("uy", "uy"))])


@query(f"with {TOLD}, m as (select k, count(*) filter (where selected) as taken, max(time) filter (where selected) as latest from st group by k) select cand, valid and not selected and (latest is null or time >= latest) and taken < 20 and travel <= 3 as allowed from st join m using (k)")
def action_mask(spark, sf):
    return planner.action_mask(_framed_orders(spark, sf), 20, 3.0).select("cand", "allowed")


@query(f"with {TOLD}, m as (select k, min(time) as t0, max(time) as t1 from st group by k) select cand, round((pz - 1.1::double) / 2.0::double, 6) + 0.0::double as f2, round(sin(phase), 6) + 0.0::double as f12, round(cos(phase), 6) + 0.0::double as f13, round((time - t0) / greatest(t1 - t0, 1e-12::double), 6) + 0.0::double as f14, selected::int::double as f15, travel / 2.0::double as f16 from st join m using (k)")
def planner_features(spark, sf):
    f = planner.candidate_features(_framed_orders(spark, sf), SPIN, CENTER, RADIUS)
    return f.select("cand", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("f2", "f12", "f13", "f14", "f15", "f16")])


@query(None)
def greedy_plan(spark, sf):
    """A plan for each maplet's mesh, all over the same candidates."""
    c = _framed(spark).drop("scene").crossJoin(spark.range(8).select(F.col("id").cast("string").alias("scene")))
    g = mesh.face_geometry(*_mesh(spark, sf)).select(F.col("mesh").cast("string").alias("scene"), *[F.col(x).alias(f"g{i}") for i, x in enumerate(("mx", "my", "mz", "nx", "ny", "nz", "area", "ax", "ay", "az"))])
    return planner.greedy_plan(planner.candidate_features(c, SPIN, CENTER, RADIUS), g, c.select("scene", "cand", "px", "py", "pz", "time", "valid"), planner.weights(3), 6, RADIUS)


@query(f"""with {X.TRI}, n as (select k as mesh, fid, nx, ny, nz, nx * 0.6::double as cc, -ny * 0.6::double as cs, nz * 0.8::double as c0 from geo)
select mesh, fid, step, sqrt(cc * cc + cs * cs) + c0 > 0 as ever_lit, round(cc * cos(step * {2 * math.pi / 8!r}::double) + cs * sin(step * {2 * math.pi / 8!r}::double) + c0, 6) + 0.0::double as cos_i from n, range(8) s(step)""")
def incidence_harmonic(spark, sf):
    n = mesh.face_geometry(*_mesh(spark, sf)).select("mesh", "fid", "nx", "ny", "nz")
    return planner.incidence(n, SUN, 8).select("mesh", "fid", F.col("step").cast("long").alias("step"), "ever_lit", (F.round("cos_i", 6) + F.lit(0.0)).alias("cos_i"))


@query(f"with {X.PTS}, r as (select label as scene, id as slot0, row_number() over (partition by label order by id) - 1 as slot, x as s from pts), e as (select *, exp(s - max(s) over (partition by scene)) as e, count(*) over (partition by scene) as n from r), h as (select *, e / sum(e) over (partition by scene) as share from e) select scene, slot, round(slot * 0.01::double + sum(share) over (partition by scene order by slot rows unbounded preceding) * ({2 * math.pi!r}::double - n * 0.01::double), 5) as phase from h")
def phase_sequence(spark, sf):
    from pyspark.sql import Window

    raw = X.clouds(spark, sf).select(F.col("label").alias("scene"), (F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1).cast("long").alias("slot"), F.col("x").alias("s"))
    return planner.phase_sequence(raw, 0.01).select("scene", "slot", F.round("phase", 5).alias("phase"))


@query(f"with {X.PTS} select label, round(sum((1.0::double + id % 3) * x * x * z) / (sum((1.0::double + id % 3) * x * x) + 1e-9::double), 6) as pooled, count(*) as n from pts group by label")
def var_pool(spark, sf):
    p = X.clouds(spark, sf).select("label", (F.lit(1.0) + F.col("id") % 3).alias("w"), F.col("x").alias("u"), "z")
    return planner.variance_pool(p, "label").select("label", F.round("pooled", 6).alias("pooled"), "n")


LIGHTS = [(-0.3, -0.2, -1.0), (0.5, 0.0, -1.0), (0.0, 0.4, -0.9)]


@query(f"""with {RENDER}, q as (select event_id, event_id % 3 as l from events), px0 as (select geo.nx, geo.ny, geo.nz, count(*) as n from zb join geo on geo.k = zb.k and geo.fid = zb.b[2] where zb.k = 0 group by zb.b[2], geo.nx, geo.ny, geo.nz),
lt(l, tx, ty, tz) as (values {', '.join(f'({i}, ' + ', '.join(f'{-x / sum(y * y for y in v) ** 0.5!r}::double' for x in v) + ')' for i, v in enumerate(LIGHTS))}),
gr2 as (select l, sum(n)::bigint as pixels, sum(n * cast(floor((0.15::double + 0.85::double * least(greatest(nx * tx + ny * ty + nz * tz, 0.0::double), 1.0::double)) * 255.0::double) as bigint))::bigint as gray from px0, lt group by l)
select event_id::varchar as request_id, case when event_id % 50 = 7 then 0 else pixels end as pixels, case when event_id % 50 = 7 then 0 else gray end as gray, case when event_id % 50 = 7 then 'the light has no direction' end as error from q join gr2 using (l)""")
def stream_requests(spark, sf):
    """A request for each of all events, in files of about 5,000."""
    e = X.table(spark, sf, "events")
    return _served(spark, sf, e, 4 + e.count() // 5000, 8)


def _served(spark, sf, e, files, in_flight):
    root = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    dark = F.col("event_id") % 50 == 7
    light = [F.when(dark, 0.0).otherwise(F.element_at(F.array(*[F.lit(v[i]) for v in LIGHTS]), (F.col("event_id") % 3 + 1).cast("int"))).alias(f"l{a}") for i, a in enumerate("xyz")]
    e.select(F.col("event_id").cast("string").alias("request_id"), F.lit(12).cast("long").alias("cam"), *light, F.col("ts").cast("timestamp").alias("ts")).repartition(files).write.json(f"{root}/in")
    g = keep(mesh.face_geometry(*_mesh(spark, sf)).filter("mesh = 0"))
    seen = raster.cull_backfaces(raster.with_cameras(g, X.cameras(spark).filter("cam = 12")))
    buffer = keep(raster.z_buffer(raster.project_faces(seen, 1e-6, 64, 64)))
    run = render_queue.serve(render_queue.requests(spark, f"{root}/in", in_flight), buffer, g, f"{root}/out", f"{root}/cp")
    run.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("request_id", "pixels", "gray", "error")




@query("""with a as (select user_id, max(ts) as latest from events where event_id % 2 = 0 group by user_id)
select event_id, user_id from events e left join a using (user_id) where event_id % 2 = 0 or latest is null or ts >= latest""")
def stream_latest(spark, sf):
    """All events in two micro-batches, the even ones first: what of the second does not go back before its user's latest."""
    root = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    e = X.table(spark, sf, "events").select("event_id", "user_id", "ts")
    schema = e.schema
    for odd in (0, 1):  # one file after the other, so that they are read in this order
        e.filter(F.col("event_id") % 2 == odd).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    render_queue.latest_per_key(stream, "user_id", "ts", f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out/rows").select("event_id", "user_id")
