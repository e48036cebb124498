"""Registered queries: tiling, splitting, depth search, acceptance, information."""

from __future__ import annotations

from pyspark.sql import functions as F

from regolith.functions import sqltext as S
from regolith.functions.scratch import keep
from regolith.functions.vec import micro
from regolith.operators import growth, information, maplet, mesh
from regolith.plans import fixtures as X
from regolith.plans.photometric import OBS, observations
from regolith.plans.surface import _maplets, _mesh
from regolith.streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(None)
def tile_mesh(spark, sf):
    """Each maplet's mesh tiled anew: centres, and their heights over the mesh."""
    g = keep(mesh.proper_faces(mesh.face_geometry(*_mesh(spark, sf))))
    c = keep(growth.seed_maplets(g.select("mesh", F.col("fid").alias("id"), F.col("mx").alias("x"), F.col("my").alias("y"), F.col("mz").alias("z"), "nx", "ny", "nz", F.col("area").alias("weight")), 0.4))
    t = g.select("mesh", "fid", *[f"{n}{a}" for n in "abc" for a in "xyz"], *[F.col(f"n{a}").alias(f"tn{a}") for a in "xyz"])
    return growth.tile_heights(c, t, 5, 0.2, 0.5).join(c.select("mesh", "k"), "k").select("mesh", "k", "r", "c", micro(F.col("h")).alias("h"), "fid")


@query(None)
def split_children(spark, sf):
    grid = maplet.complete_grid(X.heights(spark, sf), _maplets(spark))
    return growth.split_maplets(grid, X.SPACING, 8).select("parent", "k", "r", "c", "h", "valid")


COSTS = "costs as (select vec_id as s, vec_id % 8 as k, i as step, (i - 8) * 0.01::double as offset, 0.0001::double + power((i - 8) * 0.01::double - embedding[1]::double * 0.05::double, 2) as cost from embeddings, range(17) r(i))"


@query(f"""with {COSTS}, n as (select *, lag(cost) over w as l, lead(cost) over w as r, lead("offset") over w - "offset" as width from costs window w as (partition by k, s order by step)), b as (select * from n qualify row_number() over (partition by k, s order by cost, step) = 1)
select k, s, round("offset" + least(greatest(0.5::double * (l - r) / (l + r - 2.0::double * cost), -1.0::double), 1.0::double) * width, 6) as "offset", round(least((l + r - 2.0::double * cost) / 0.0004::double, 1.0::double), 6) as sharpness from b where l is not null and r is not null and l + r - 2.0::double * cost > 0.000004::double and cost < 0.0004::double""".replace(" as offset", ' as "offset"'))
def depth_minimum(spark, sf):
    e = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("s"), (F.col("vec_id") % 8).alias("k"), F.col("embedding")[0].cast("double").alias("e"), F.explode(F.sequence(F.lit(0), F.lit(16))).alias("step"))
    off = (F.col("step") - 8) * F.lit(0.01)
    costs = e.select("k", "s", "step", off.alias("offset"), (F.lit(0.0001) + F.pow(off - F.col("e") * F.lit(0.05), F.lit(2.0))).alias("cost"))
    return growth.depth_minimum(costs).select("k", "s", (F.round("offset", 6)).alias("offset"), F.round("sharpness", 6).alias("sharpness"))


@query("""with b as (select label as k, avg(embedding[1]::double * embedding[1]::double) as cost, count(*) as n from embeddings group by label), t as (select label as k, i as step, avg(power(embedding[1]::double - power(0.5::double, i) * embedding[2]::double, 2)) as cost, count(*) - (case when i = 0 and label % 2 = 0 then 1 else 0 end) as n from embeddings, range(5) r(i) group by 1, 2),
f as (select t.k, min(row(step, t.cost)) as b from t join b on b.k = t.k and b.n = t.n where t.cost < b.cost * 0.999999::double group by t.k) select b.k, coalesce(f.b[1], -1) as step, round(cost, 6) as before, round(coalesce(f.b[2], cost), 6) as after from b left join f on f.k = b.k""")
def height_acceptance(spark, sf):
    e = X.table(spark, sf, "embeddings").select(F.col("label").alias("k"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(2)])
    before = e.groupBy("k").agg(F.avg(F.col("e0") * F.col("e0")).alias("cost"), F.count("*").alias("n"))
    steps = e.crossJoin(spark.range(5).withColumnRenamed("id", "step"))
    d = F.col("e0") - F.pow(F.lit(0.5), F.col("step")) * F.col("e1")
    trials = steps.groupBy("k", "step").agg(F.avg(F.pow(d, F.lit(2.0))).alias("cost"), F.count("*").alias("m")).select("k", "step", "cost", (F.col("m") - F.when((F.col("step") == 0) & (F.col("k") % 2 == 0), 1).otherwise(0)).alias("n"))
    return growth.accept_heights(before, trials).select("k", F.coalesce("step", F.lit(-1)).alias("step"), F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


@query(f"""with {X.GR}, p as (select row_number() over (order by a, b) as edge, a, b, a % 5 as sa, b % 5 as sb, 1.0::double as weight from gr where a < b), e as (select n as maplet, s as sample, n * 10 + i as new_maplet, s as new_sample from (select distinct a as n from gr union select b from gr) u, range(5) x(s), range(2) y(i) where (n + s + i) % 3 <> 0),
j as (select edge, l.new_maplet as na, l.new_sample as nsa, r.new_maplet as nb, r.new_sample as nsb, weight / count(*) over (partition by edge) as weight from p join e l on l.maplet = a and l.sample = sa join e r on r.maplet = b and r.sample = sb)
select least(na, nb) as a, greatest(na, nb) as b, case when na > nb then nsb else nsa end as sa, case when na > nb then nsa else nsb end as sb, {S.micro('weight')} as weight from j""")
def overlap_remap(spark, sf):
    return _remapped(X.graph(spark, sf), F.struct("a", "b"))


def _remapped(g, edge):
    spark = g.sparkSession
    p = g.filter("a < b").select(edge.alias("edge"), "a", "b", (F.col("a") % 5).alias("sa"), (F.col("b") % 5).alias("sb"), F.lit(1.0).alias("weight"))
    n = g.select(F.col("a").alias("maplet")).union(g.select("b")).distinct()
    e = n.crossJoin(spark.range(5).withColumnRenamed("id", "sample")).crossJoin(spark.range(2).withColumnRenamed("id", "i")).filter("(maplet + sample + i) % 3 <> 0")
    ends = e.select("maplet", "sample", (F.col("maplet") * 10 + F.col("i")).alias("new_maplet"), F.col("sample").alias("new_sample"))
    return growth.remap_overlaps(p, ends).select("a", "b", "sa", "sb", micro(F.col("weight")).alias("weight"))


@query(f"with {OBS}, o as (select k, cam, f * 1.0::double as b, 1.0::double + ci as h, 0.0004::double as n from obs where usable), s as (select k, cam, sum(b * b / n) as bb, sum(b * h / n) as bh, sum(h * h / n) as hh from o group by 1, 2) select k, cam, round((bb - bh * bh / (hh + 2.0::double)) / 1000.0::double, 4) as information from s")
def effective_information(spark, sf):
    o = observations(spark, sf).filter("usable").select("k", "cam", F.col("f").alias("b"), (F.lit(1.0) + F.col("ci")).alias("h"), F.lit(0.0004).alias("variance"))
    return information.effective_information(o, "k", "cam", prior=2.0).select("k", "cam", F.round(F.col("information") / F.lit(1000.0), 4).alias("information"))


@query("with r as (select vec_id as obs, vec_id % 6 as i, embedding[1]::double as v, label as k from embeddings union all select vec_id, 6 + vec_id % 2, embedding[2]::double, label from embeddings), p as (select a.k, a.i, b.i as j, sum(a.v * b.v / 0.25::double) as f from r a join r b on a.k = b.k and a.obs = b.obs group by 1, 2, 3) select k, i, j, round(f, 6) as f from p")
def joint_information(spark, sf):
    e = X.table(spark, sf, "embeddings")
    one = lambda i, at: e.select(F.col("label").alias("k"), F.col("vec_id").alias("obs"), i.alias("i"), F.col("embedding")[at].cast("double").alias("value"), F.lit(0.5).alias("sigma"))
    rows = one(F.col("vec_id") % 6, 0).unionByName(one(F.lit(6) + F.col("vec_id") % 2, 1))
    return information.information(rows, "k").select("k", "i", "j", F.round("f", 6).alias("f"))


@query(f"with {OBS}, u as (select k, count(*) filter (where usable) as usable, count(distinct cam) filter (where usable) as images from obs group by k), l as (select k, count(*) as links from (select k, cam from obs where usable group by 1, 2 having count(*) >= 40) group by k) select k, usable, images, coalesce(links, 0) as links, case when links is null then 'no_visible_initial_surface' when images < 3 then 'insufficient_observations' else 'updated' end as status from u left join l using (k)")
def update_report(spark, sf):
    o = observations(spark, sf).filter("depth > 1e-6")
    from regolith.operators import views

    return ingest.report(views.links(o, 40), o)
