"""All registered queries and their SQL."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import cluster, filters, mesh, metrics, register, spatial, volume
from ..sources import formats
from ..storage import session_dir, stored
from . import fixtures as fx
from . import pipelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to 6 places, without negative zeros."""
    return df.select(*[(F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema.fields])


def query(name: str, sql: str | None = None) -> Callable:
    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: rounded(run(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return run

    return add


def r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


def nn(query: str, target: str, name: str = "nn") -> str:
    """CTE of the nearest target of every query point, ties by id."""
    return f"{name} AS (SELECT q.pid AS pid, min(struct_pack(d2 := (q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y)+(q.z-t.z)*(q.z-t.z), nid := t.pid)) AS b FROM {query} q, {target} t GROUP BY q.pid)"


D2 = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)"
C = f"WITH {fx.CLOUD_SQL}"
POINT = f"pid, {r('x', 'y', 'z')}"
BOUNDS = "min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y, min(z) AS lo_z, max(z) AS hi_z"
INSIDE = "x BETWEEN lo_x AND hi_x AND y BETWEEN lo_y AND hi_y AND z BETWEEN lo_z AND hi_z"

# projections

POSE = g.compose(g.rotation((1, 2, 3), 0.3), g.translation(0.1, -0.2, 0.3))


@query("q_transform", f"{C} SELECT pid, " + ", ".join(f"round({POSE[i, 0]!r}*x + {POSE[i, 1]!r}*y + {POSE[i, 2]!r}*z + {POSE[i, 3]!r}, 6) + 0.0 AS {a}" for i, a in enumerate("xyz")).replace("np.float64(", "(") + " FROM cloud")
def _(spark, d):
    return g.transform(fx.cloud(spark, d), POSE)


STEPS = [g.rotation((0, 0, 1), 0.1), g.translation(1, 2, 3), g.rotation((1, 0, 0), -0.2)]
#: One step of an ordered product of 4x4 matrices as lists by rows.
MATMUL = "list_transform(range(16), lambda i: list_sum(list_transform(range(4), lambda k: s.m[(4 * (i // 4) + k + 1)::INTEGER] * p.t[(4 * k + i % 4 + 1)::INTEGER])))"
PRODUCT = f"prod(seq, t) AS (SELECT -1, [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]::DOUBLE[] UNION ALL SELECT s.seq, {MATMUL} FROM prod p JOIN steps s ON s.seq = p.seq + 1)"


def turn(axis: str, angle: str) -> str:
    """SQL of a rotation about a coordinate axis."""
    c, n = f"cos({angle})", f"sin({angle})"
    rows = {"x": f"1, 0, 0, 0, 0, {c}, -{n}, 0, 0, {n}, {c}, 0", "y": f"{c}, 0, {n}, 0, 0, 1, 0, 0, -{n}, 0, {c}, 0", "z": f"{c}, -{n}, 0, 0, {n}, {c}, 0, 0, 0, 0, 1, 0"}
    return f"[{rows[axis]}, 0, 0, 0, 1]::DOUBLE[]"


def move(x: str, y: str, z: str) -> str:
    return f"[1, 0, 0, {x}, 0, 1, 0, {y}, 0, 0, 1, {z}, 0, 0, 0, 1]::DOUBLE[]"


@query("q_compose", f"WITH RECURSIVE steps(seq, m) AS (VALUES (0, {turn('z', '0.1')}), (1, {move('1', '2', '3')}), (2, {turn('x', '-0.2')})), {PRODUCT} SELECT (k // 4)::INTEGER AS i, (k % 4)::INTEGER AS j, round(t[(k + 1)::INTEGER], 6) + 0.0 AS v FROM prod, range(16) r(k) WHERE seq = 2")
def _(spark, d):
    steps = spark.createDataFrame([(k, [float(v) for v in m.ravel()]) for k, m in enumerate(STEPS)], "seq int, m array<double>")
    return g.compose_rows(steps).select(F.posexplode("t").alias("k", "v")).select((F.col("k") / 4).cast("int").alias("i"), F.pmod("k", F.lit(4)).cast("int").alias("j"), "v")


ANGLES = (0.3, -1.2, 2.5)


@query("q_rot", f"{C}, k AS (SELECT 1 / sqrt(14.0) AS kx, 2 / sqrt(14.0) AS ky, 3 / sqrt(14.0) AS kz), a(t) AS (VALUES {', '.join(f'({t}::DOUBLE)' for t in ANGLES)}), d AS (SELECT *, kx*x + ky*y + kz*z AS dot FROM cloud, k, a) SELECT pid, t AS angle, round(x*cos(t) + (ky*z - kz*y)*sin(t) + kx*dot*(1 - cos(t)), 6) + 0.0 AS x, round(y*cos(t) + (kz*x - kx*z)*sin(t) + ky*dot*(1 - cos(t)), 6) + 0.0 AS y, round(z*cos(t) + (kx*y - ky*x)*sin(t) + kz*dot*(1 - cos(t)), 6) + 0.0 AS z FROM d")
def _(spark, d):
    c = fx.cloud(spark, d)
    turned = [g.transform(c, g.rotation((1, 2, 3), t)).withColumn("angle", F.lit(t)) for t in ANGLES]
    return turned[0].union(turned[1]).union(turned[2])


@query("q_translate", f"{C} SELECT pid, round(x + 0.5, 6) + 0.0 AS x, round(y - 0.25, 6) + 0.0 AS y, round(z + 2.0, 6) + 0.0 AS z FROM cloud")
def _(spark, d):
    return g.transform(fx.cloud(spark, d), g.translation(0.5, -0.25, 2.0))


KEYS_SQL = ", ".join([*[f"('{k}', {move(*v)})" for k, v in {"W": ("0", "0", "0.05"), "S": ("0", "0", "-0.05"), "A": ("-0.05", "0", "0"), "D": ("0.05", "0", "0"), "Q": ("0", "0.05", "0"), "E": ("0", "-0.05", "0")}.items()], *[f"('{k}', {turn(a, s + 'radians(1)')})" for k, a, s in (("J", "y", ""), ("L", "y", "-"), ("I", "x", ""), ("K", "x", "-"), ("U", "z", ""), ("O", "z", "-"))]])
TYPED = "WWaQjLuOIzkDXW"


@query("q_replay", f"WITH RECURSIVE typed AS (SELECT k AS seq, upper(substr('{TYPED}', k::INTEGER + 1, 1)) AS key FROM range({len(TYPED)}) r(k)), keys(key, m) AS (VALUES {KEYS_SQL}), steps AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, m FROM typed JOIN keys USING (key) WHERE seq < (SELECT min(seq) FROM typed WHERE key = 'X')), {PRODUCT} SELECT k::INTEGER AS k, round(t[(k + 1)::INTEGER], 6) + 0.0 AS v FROM prod, range(16) r(k) WHERE seq = (SELECT max(seq) FROM steps)")
def _(spark, d):
    keys = spark.createDataFrame(list(enumerate(TYPED)), "seq int, key string")
    return g.replay(keys).select(F.posexplode("t").alias("k", "v"))


@query("q_scale", f"{C}, c AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM cloud) SELECT pid AS vid, " + ", ".join(f"round(c{a} + 0.001*({a} - c{a}), 6) + 0.0 AS {a}" for a in "xyz") + " FROM cloud, c")
def _(spark, d):
    return g.scale(fx.cloud(spark, d).withColumnRenamed("pid", "vid"), 0.001)


DIMS = "dims AS (SELECT " + ", ".join(f"min({a}) - 0.05 AS o{a}, (ceil(((max({a}) + 0.05) - (min({a}) - 0.05)) / 0.1) + 1)::INTEGER AS n{a}" for a in "xyz") + " FROM cloud)"
CELLS = "cells AS (SELECT pid, " + ", ".join(f"least(greatest(floor(({a} - o{a}) / 0.1)::INTEGER, 0), n{a} - 1) AS i{a}" for a in "xyz") + " FROM cloud, dims)"
OCC = "occ AS (SELECT DISTINCT ix, iy, iz FROM cells)"


@query("q_grid_dims", f"{C}, {DIMS} SELECT {r('ox', 'oy', 'oz')}, nx, ny, nz FROM dims")
def _(spark, d):
    return g.grid_dims(fx.cloud(spark, d), 0.1, 0.05)


@query("q_voxel_index", f"{C}, {DIMS}, {CELLS} SELECT * FROM cells")
def _(spark, d):
    c = fx.cloud(spark, d)
    return g.voxel_index(c, g.grid_dims(c, 0.1, 0.05), 0.1).select("pid", "ix", "iy", "iz")


def _jet_sql(v: str) -> str:
    return ", ".join(f"round(least(greatest(1.5 - abs(4*({v}) - {k}), 0), 1), 6)::DOUBLE + 0.0 AS {c}" for c, k in (("r", 3), ("g", 2), ("b", 1)))


@query("q_jet", f"{C}, {nn('pred', 'gt')} SELECT pid, {_jet_sql('least(greatest(sqrt(b.d2) / 0.2, 0), 1)')} FROM nn")
def _(spark, d):
    return pipelines.error_cloud(fx.predicted(spark, d), fx.truth(spark, d)).select("pid", "r", "g", "b")


@query("q_paint", f"{C} SELECT pid, 0.6::DOUBLE AS r, 0.6::DOUBLE AS g, 0.6::DOUBLE AS b FROM gt")
def _(spark, d):
    return g.paint(fx.truth(spark, d), 0.6, 0.6, 0.6).select("pid", "r", "g", "b")


@query("q_intensity", f"{C} SELECT pid, round(embedding[4]::FLOAT::DOUBLE, 6) + 0.0 AS intensity FROM cloud")
def _(spark, d):
    c = fx.cloud(spark, d, "embedding").withColumn("reflectance", F.slice("embedding", 4, 2)).drop("embedding")
    return g.intensity(c).select("pid", F.col("intensity").cast("double").alias("intensity"))


# filters


@query("q_crop_bbox", f"{C}, box AS (SELECT {BOUNDS} FROM gt) SELECT {POINT} FROM pred, box WHERE {INSIDE}")
def _(spark, d):
    return filters.crop(fx.predicted(spark, d), filters.bounds(fx.truth(spark, d)))


@query("q_crop_bbox_z", f"{C}, box AS (SELECT min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y, min(z) - 0.05 AS lo_z, max(z) + 0.05 AS hi_z FROM gt) SELECT {POINT} FROM pred, box WHERE {INSIDE}")
def _(spark, d):
    return filters.crop(fx.predicted(spark, d), filters.padded(filters.bounds(fx.truth(spark, d)), 0.05, ("z",)))


@query("q_crop_bbox_expand", f"{C}, box AS (SELECT " + ", ".join(f"min({a}) - 0.1 AS lo_{a}, max({a}) + 0.1 AS hi_{a}" for a in "xyz") + f" FROM gt) SELECT {POINT} FROM pred, box WHERE {INSIDE}")
def _(spark, d):
    return filters.crop(fx.predicted(spark, d), filters.padded(filters.bounds(fx.truth(spark, d)), 0.1))


@query("q_crop_bbox_scaled", f"{C}, s AS (SELECT * FROM cloud WHERE pid < 20), box AS (SELECT " + ", ".join(f"(min({a})+max({a}))/2 - 0.5*((max({a})-min({a}))/2) AS lo_{a}, (min({a})+max({a}))/2 + 0.5*((max({a})-min({a}))/2) AS hi_{a}" for a in "xyz") + f" FROM s) SELECT {POINT} FROM cloud, box WHERE {INSIDE}")
def _(spark, d):
    c = fx.cloud(spark, d)
    return filters.crop(c, filters.scaled(filters.bounds(c.where("pid < 20")), 0.5))


@query("q_select_by_index", f"{C} SELECT {POINT} FROM cloud WHERE pid IN (SELECT vec_id * 3 FROM embeddings)")
def _(spark, d):
    c = fx.cloud(spark, d)
    return filters.select_by_index(c, c.select((F.col("pid") * 3).alias("pid")))


def draw(key: str, seed: int, what: int = 0) -> str:
    """SQL of the draws that sampling goes by."""
    return f"('0x' || substr(md5({key}::VARCHAR || ':{seed}:{what}'), 1, 15))::BIGINT"


@query("q_sample", f"{C} SELECT {POINT} FROM (SELECT * FROM cloud ORDER BY {draw('pid', 42)}, pid LIMIT 100)")
def _(spark, d):
    return filters.sample(fx.cloud(spark, d), 100)


# joins


@query("q_nn_inner", f"{C}, {nn('pred', 'gt')} SELECT pid, b.nid AS nid, round(sqrt(b.d2), 6) AS dist FROM nn WHERE b.d2 < 0.2*0.2")
def _(spark, d):
    return spatial.nn_truncated(fx.truth(spark, d), fx.predicted(spark, d), 0.2)


@query("q_nn_clamp", f"{C}, {nn('pred', 'gt')} SELECT pid, b.nid AS nid, round(CASE WHEN b.d2 < 0.05*0.05 THEN sqrt(b.d2) ELSE 0.05 END, 6) AS dist FROM nn")
def _(spark, d):
    return spatial.nn_truncated(fx.truth(spark, d), fx.predicted(spark, d), 0.05, ignore_outlier=False)


@query("q_nn_full", f"{C}, {nn('pred', 'gt')} SELECT pid, b.nid AS nid, round(sqrt(b.d2), 6) AS dist FROM nn")
def _(spark, d):
    return spatial.nearest(fx.predicted(spark, d), fx.truth(spark, d))


@query("q_within_semi", f"{C} SELECT {POINT} FROM pred a WHERE EXISTS (SELECT 1 FROM gt b WHERE {D2} < 0.05*0.05)")
def _(spark, d):
    return spatial.within(fx.predicted(spark, d), fx.truth(spark, d), 0.05)


@query("q_crop_intersection", f"{C}, m AS (SELECT * FROM cloud WHERE pid % 5 > 1), met AS (SELECT a.pid, count(DISTINCT b.pid % 5) AS n FROM gt a, m b WHERE {D2} < 0.1*0.1 GROUP BY a.pid) SELECT {POINT} FROM gt WHERE pid IN (SELECT pid FROM met WHERE n = (SELECT count(DISTINCT pid % 5) FROM m))")
def _(spark, d):
    methods = fx.cloud(spark, d).where("pid % 5 > 1").withColumn("cloud_id", (F.col("pid") % 5).cast("string"))
    return pipelines.crop_intersection(fx.truth(spark, d), methods, 0.1)


# neighbourhoods


def ranked(k: int, src: str = "cloud", name: str = "rk") -> str:
    return f"{name} AS (SELECT a.pid, b.pid AS nid, {D2} AS d2 FROM {src} a, {src} b QUALIFY row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, b.pid) <= {k})"


def kdist(k: int, src: str = "cloud", name: str = "kd") -> str:
    return f"{ranked(k + 1, src, name + '_r')}, {name} AS (SELECT pid, sqrt(max(d2)) AS dk FROM {name}_r GROUP BY pid)"


def sor(k: int, std: float, src: str = "cloud", name: str = "sor") -> str:
    return f"{ranked(k, src, name + '_r')}, {name}_m AS (SELECT pid, avg(sqrt(d2)) AS m FROM {name}_r GROUP BY pid), {name} AS (SELECT * FROM {src} WHERE pid IN (SELECT pid FROM {name}_m WHERE m > 0 AND m < (SELECT avg(m) + {std} * stddev_samp(m) FROM {name}_m)))"


def ror(n: int, radius: float, src: str = "cloud", name: str = "ror") -> str:
    return f"{name} AS (SELECT * FROM {src} WHERE pid IN (SELECT a.pid FROM {src} a, {src} b WHERE {D2} < {radius}*{radius} GROUP BY a.pid HAVING count(*) > {n}))"


@query("q_kdist", f"{C}, {kdist(16)} SELECT pid, round(dk, 6) AS dk FROM kd")
def _(spark, d):
    return spatial.kth_distance(fx.cloud(spark, d), 16)


@query("q_knn", f"{C}, {ranked(5)} SELECT pid, nid, round(d2, 6) AS d2, row_number() OVER (PARTITION BY pid ORDER BY d2, nid)::INTEGER AS rank FROM rk")
def _(spark, d):
    c = fx.cloud(spark, d)
    return spatial.knn(c, c, 5)


@query("q_sor", f"{C}, {sor(25, 1.8)} SELECT {POINT} FROM sor")
def _(spark, d):
    return filters.statistical_outliers(fx.cloud(spark, d), 25, 1.8)


@query("q_knn_pct", f"{C}, {kdist(16)} SELECT {POINT} FROM cloud JOIN kd USING (pid) WHERE dk <= (SELECT quantile_cont(dk, 0.95) FROM kd)")
def _(spark, d):
    return filters.knn_percentile(fx.cloud(spark, d), 16, 95.0, 1.0)


@query("q_knn_pct_scaled", f"{C}, {kdist(16)} SELECT {POINT} FROM cloud JOIN kd USING (pid) WHERE dk <= (SELECT quantile_cont(dk, 0.97) * 1.1 FROM kd)")
def _(spark, d):
    return filters.knn_percentile(fx.cloud(spark, d))


@query("q_knn_pct_zrelax", f"{C}, {kdist(16)}, k AS (SELECT * FROM cloud JOIN kd USING (pid)) SELECT {POINT} FROM k WHERE dk <= CASE WHEN z > 0.1 THEN (SELECT quantile_cont(dk, 0.95) * 1.3 FROM k WHERE z > 0.1) ELSE (SELECT quantile_cont(dk, 0.95) FROM k) END")
def _(spark, d):
    return filters.knn_percentile(fx.cloud(spark, d), 16, 95.0, 1.0, True, 0.1, 1.3)


@query("q_ror", f"{C}, {ror(6, 0.1)} SELECT {POINT} FROM ror")
def _(spark, d):
    return filters.radius_outliers(fx.cloud(spark, d), 6, 0.1)


@query("q_sor_ror", f"{C}, {sor(25, 1.8)}, {ror(6, 0.1, 'sor')} SELECT (SELECT count(*) FROM cloud) AS n_before, count(*) AS n_after, (SELECT count(*) FROM cloud) - count(*) AS n_removed, round(100.0 * count(*) / (SELECT count(*) FROM cloud), 6)::DOUBLE AS pct_kept FROM ror")
def _(spark, d):
    c = fx.cloud(spark, d)
    return filters.removed(c, filters.filter_outliers(c, 25, 1.8, 0.1, 6))


@query("q_adaptive_eps", f"{C}, {kdist(16)} SELECT round(1.6 * median(dk), 6) AS eps FROM kd")
def _(spark, d):
    return cluster.adaptive_eps(fx.cloud(spark, d))


EPS, MIN_PTS = 0.06, 6


def dbscan(src: str, eps: str, n: int) -> str:
    """CTEs that end in clustered(pid, x, y, z, label)."""
    return f"""pairs AS (SELECT a.pid AS a, b.pid AS b FROM {src} a, {src} b WHERE {D2} < {eps}*{eps}),
core AS (SELECT a AS pid FROM pairs GROUP BY a HAVING count(*) >= {n}),
links AS (SELECT a, b FROM pairs WHERE a IN (SELECT pid FROM core) AND b IN (SELECT pid FROM core)),
reach AS (SELECT pid, pid AS root FROM core UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.pid AND r.root < l.b),
comp AS (SELECT pid, min(root) AS comp FROM reach GROUP BY pid),
lab AS (SELECT pid, (dense_rank() OVER (ORDER BY comp) - 1)::INTEGER AS label FROM comp),
border AS (SELECT p.a AS pid, min(label) AS label FROM pairs p JOIN lab ON lab.pid = p.b GROUP BY p.a),
clustered AS (SELECT c.pid, c.x, c.y, c.z, coalesce(lab.label, border.label, -1)::INTEGER AS label FROM {src} c LEFT JOIN lab USING (pid) LEFT JOIN border USING (pid))"""


DBSCAN = dbscan("cloud", str(EPS), MIN_PTS)
CR = C.replace("WITH ", "WITH RECURSIVE ", 1)


def _clustered(spark: SparkSession, d: str) -> DataFrame:
    return stored(cluster.dbscan(fx.cloud(spark, d), EPS, MIN_PTS), "clustered")


@query("q_dbscan", f"{CR}, {DBSCAN} SELECT {POINT}, label FROM clustered")
def _(spark, d):
    return cluster.dbscan(fx.cloud(spark, d), EPS, MIN_PTS)


def stats(axes: str = "xy") -> str:
    """CTEs of the central cluster and the largest other."""
    box = ", ".join(f"(min({a})+max({a}))/2 AS mid_{a}" for a in axes)
    square = " + ".join(f"(avg({a})-any_value(mid_{a}))*(avg({a})-any_value(mid_{a}))" for a in axes)
    return f"""box AS (SELECT {box} FROM clustered),
stats AS (SELECT label, count(*) AS n, {square} AS d2 FROM clustered, box WHERE label >= 0 GROUP BY label),
central AS (SELECT label FROM stats ORDER BY d2, label LIMIT 1),
extra AS (SELECT label FROM stats WHERE label NOT IN (SELECT label FROM central) ORDER BY n DESC, label DESC LIMIT 1)"""


STATS = stats()
TOP = "top AS (SELECT label FROM clustered WHERE label >= 0 GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)"


@query("q_keep_central", f"{CR}, {DBSCAN}, {STATS} SELECT {POINT}, label FROM clustered WHERE label IN (SELECT label FROM central UNION ALL SELECT label FROM extra) OR NOT EXISTS (SELECT 1 FROM stats)")
def _(spark, d):
    return cluster.keep_central(_clustered(spark, d), 0)


@query("q_keep_central_strict", f"{CR}, {DBSCAN}, {STATS} SELECT {POINT}, label FROM clustered WHERE label IN (SELECT label FROM central) OR NOT EXISTS (SELECT 1 FROM stats)")
def _(spark, d):
    return cluster.keep_central(_clustered(spark, d), 0, strict_keep_extra=True)


@query("q_keep_largest", f"{CR}, {DBSCAN}, {TOP} SELECT {POINT}, label FROM clustered WHERE label IN (SELECT label FROM top) OR NOT EXISTS (SELECT 1 FROM top)")
def _(spark, d):
    return cluster.keep_largest(_clustered(spark, d))


def normals_sql(src: str, k: int, radius: float | None = None) -> str:
    """CTEs that end in normals(pid, nx, ny, nz): the eigenvector of the
    smallest eigenvalue in closed form, turned to one half-space."""
    near = "" if radius is None else f" WHERE d2 < {radius}*{radius}"
    m = ", ".join(f"covar_pop(t.{a}, t.{b}) AS {a}{b}" for a, b in ("xx", "yy", "zz", "xy", "xz", "yz"))
    return f"""{ranked(k, src, 'nr')},
mom AS (SELECT nr.pid, count(*) AS n, {m} FROM nr JOIN {src} t ON t.pid = nr.nid{near} GROUP BY nr.pid),
e1 AS (SELECT *, (xx+yy+zz)/3 AS q FROM mom),
e2 AS (SELECT *, sqrt(((xx-q)*(xx-q)+(yy-q)*(yy-q)+(zz-q)*(zz-q)+2*(xy*xy+xz*xz+yz*yz))/6) AS p FROM e1),
e3 AS (SELECT *, CASE WHEN p > 0 THEN ((xx-q)*((yy-q)*(zz-q)-yz*yz) - xy*(xy*(zz-q)-yz*xz) + xz*(xy*yz-(yy-q)*xz))/(2*p*p*p) ELSE 0 END AS r FROM e2),
e4 AS (SELECT *, q + 2*p*cos(acos(least(greatest(r, -1), 1))/3 + 2*pi()/3) AS l FROM e3),
rows3 AS (SELECT pid, n, unnest([
 [xy*yz-xz*(yy-l), xz*xy-(xx-l)*yz, (xx-l)*(yy-l)-xy*xy],
 [xy*(zz-l)-xz*yz, xz*xz-(xx-l)*(zz-l), (xx-l)*yz-xy*xz],
 [(yy-l)*(zz-l)-yz*yz, yz*xz-xy*(zz-l), xy*yz-(yy-l)*xz]]) AS c FROM e4),
best AS (SELECT pid, any_value(n) AS n, arg_max(c, c[1]*c[1]+c[2]*c[2]+c[3]*c[3]) AS c FROM rows3 GROUP BY pid),
unit AS (SELECT pid, n, list_transform(c, lambda v: v / nullif(sqrt(c[1]*c[1]+c[2]*c[2]+c[3]*c[3]), 0) * CASE WHEN c[1]+0.5*c[2]+0.25*c[3] < 0 THEN -1 ELSE 1 END) AS c FROM best),
normals AS (SELECT pid, CASE WHEN n < 3 THEN 0 ELSE c[1] END AS nx, CASE WHEN n < 3 THEN 0 ELSE c[2] END AS ny, CASE WHEN n < 3 THEN 1 ELSE c[3] END AS nz FROM unit)"""


def one_side(cloud: DataFrame) -> DataFrame:
    """Normals have no sign: turned to one half-space, to 4 places."""
    sign = F.when(F.col("nx") + 0.5 * F.col("ny") + 0.25 * F.col("nz") < 0, -1.0).otherwise(1.0)
    return cloud.withColumns({n: F.round(F.col(n) * sign, 4) + F.lit(0.0) for n in ("nx", "ny", "nz")})


NORMAL = ", ".join(f"round({n}, 4) + 0.0 AS {n}" for n in ("nx", "ny", "nz"))


@query("q_normals", f"{C}, {normals_sql('cloud', 30, 0.3)} SELECT pid, {r('x', 'y', 'z')}, {NORMAL} FROM cloud JOIN normals USING (pid)")
def _(spark, d):
    return one_side(register.normals(fx.cloud(spark, d), 0.3, 30))


@query("q_pipeline_a", f"{C}, box AS (SELECT " + ", ".join(f"min({a}) - 0.1 AS lo_{a}, max({a}) + 0.1 AS hi_{a}" for a in "xyz") + f" FROM gt) SELECT {POINT} FROM pred a, box WHERE {INSIDE} AND EXISTS (SELECT 1 FROM gt b WHERE {D2} < 0.1*0.1)")
def _(spark, d):
    return pipelines.clean_near_truth(fx.predicted(spark, d), fx.truth(spark, d))


KEPT = "label IN (SELECT label FROM central UNION ALL SELECT label FROM extra) OR NOT EXISTS (SELECT 1 FROM stats)"


@query("q_pipeline_b", f"{CR}, {sor(25, 1.8, 'cloud', 's1')}, {kdist(16, 's1', 'k1')}, s2 AS (SELECT s1.* FROM s1 JOIN k1 USING (pid) WHERE dk <= (SELECT quantile_cont(dk, 0.95) FROM k1)), {kdist(16, 's2', 'k2')}, {dbscan('s2', '(SELECT 1.6 * median(dk) FROM k2)', 22)}, {stats('xyz')} SELECT {POINT} FROM clustered WHERE {KEPT}")
def _(spark, d):
    return pipelines.clean_knn(fx.cloud(spark, d))


@query("q_pipeline_c", f"{CR}, {sor(25, 1.8, 'cloud', 's1')}, {ror(6, 0.3, 's1', 's2')}, {dbscan('s2', '0.15', 16)}, {TOP} SELECT {POINT} FROM clustered WHERE label IN (SELECT label FROM top) OR NOT EXISTS (SELECT 1 FROM top)")
def _(spark, d):
    return pipelines.clean_clusters(fx.cloud(spark, d))


# aggregates


@query("q_voxel_down", f"{C}, box AS (SELECT {BOUNDS} FROM cloud) SELECT min(pid) AS pid, " + ", ".join(f"round(avg({a}), 6) + 0.0 AS {a}" for a in "xyz") + " FROM cloud, box GROUP BY " + ", ".join(f"floor(({a} - (lo_{a} - 0.1/2)) / 0.1)" for a in "xyz"))
def _(spark, d):
    return metrics.voxel_downsample(fx.cloud(spark, d), 0.1)


RECON = f"""box AS (SELECT {BOUNDS} FROM gt), cropped AS (SELECT pid, x, y, z FROM pred, box WHERE {INSIDE}),
{nn('cropped', 'gt', 'fwd')}, {nn('gt', 'cropped', 'bwd')},
dp AS (SELECT sqrt(b.d2) AS dist FROM fwd WHERE b.d2 < 0.1*0.1), dr AS (SELECT CASE WHEN b.d2 < 0.15*0.15 THEN sqrt(b.d2) ELSE 0.15 END AS dist FROM bwd),
p AS (SELECT avg(dist) AS mp, avg(dist*dist) AS sp, avg(CASE WHEN dist < 0.05 THEN 100.0 ELSE 0.0 END)::DOUBLE AS hp FROM dp),
q AS (SELECT avg(dist) AS mr, avg(dist*dist) AS sr, avg(CASE WHEN dist < 0.05 THEN 100.0 ELSE 0.0 END)::DOUBLE AS hr FROM dr)
SELECT round(mp, 6) AS mae_acc, round(mr, 6) AS mae_com, round(0.5*(mp+mr), 6) AS chamfer_l1, round(sqrt(0.5*(sp+sr)), 6) AS chamfer_l2, round(hp, 6) AS precision_pct, round(hr, 6) AS recall_pct,
round(2*hp*hr/nullif(hp+hr, 0), 6) AS f_score_pct, 0.05::DOUBLE AS threshold, 0.1::DOUBLE AS truncation_acc, 0.15::DOUBLE AS truncation_com FROM p, q"""


@query("q_recon_metrics", f"{C}, {RECON}")
def _(spark, d):
    return pipelines.eval_cloud(fx.predicted(spark, d), fx.truth(spark, d), 0.0, 0.05, 0.1, 0.15, align=False)


@query("q_eval_pcd", f"{C}, {RECON}")
def _(spark, d):
    """The whole evaluation of a moved cloud, aligned on the unmoved one."""
    pred = fx.predicted(spark, d)
    moved = g.transform(pred, g.compose(g.rotation((0, 0, 1), 0.2), g.translation(0.3, -0.1, 0.2)))
    return pipelines.eval_cloud(moved, fx.truth(spark, d), 0.0, 0.05, 0.1, 0.15, icp_target=pred, schedule=((0.01, 0.1, "p2p", 30), (0.005, 0.05, "p2l", 30)))


@query("q_report", f"{C}, recon AS (SELECT * FROM (WITH {RECON.replace('box AS', 'box AS', 1)})) SELECT * FROM (SELECT unnest(['MAE_accuracy (m)', 'MAE_completeness (m)', 'Chamfer_L1 (m)', 'Chamfer_L2 (m)', 'Precision [Accuracy] (%)', 'Recall [Completeness] (%)', 'F-score (%)', 'threshold', 'truncation_acc', 'truncation_com']) AS metric, unnest([mae_acc, mae_com, chamfer_l1, chamfer_l2, precision_pct, recall_pct, f_score_pct, threshold, truncation_acc, truncation_com]) AS value FROM recon)")
def _(spark, d):
    return metrics.report(pipelines.eval_cloud(fx.predicted(spark, d), fx.truth(spark, d), 0.0, 0.05, 0.1, 0.15, align=False))


@query("q_error_dist", f"{C}, {nn('pred', 'gt')}, e AS (SELECT sqrt(b.d2) AS dist FROM nn) SELECT round(avg(CASE WHEN dist < 0.05 THEN 100.0 ELSE 0.0 END)::DOUBLE, 6) AS pct_near, round(avg(CASE WHEN dist < 0.2 THEN 100.0 ELSE 0.0 END)::DOUBLE, 6) AS pct_far, round(min(dist), 6) AS min_dist, round(median(dist), 6) AS median_dist, round(max(dist), 6) AS max_dist FROM e")
def _(spark, d):
    return metrics.error_distribution(fx.predicted(spark, d), fx.truth(spark, d))


@query(
    "q_depth_metrics",
    f"""WITH {fx.DEPTH_SQL}, v AS (SELECT pred AS p, trgt AS t FROM depth WHERE pred > 0 AND trgt > 0 AND trgt < 10)
SELECT round(avg(abs(p-t)/t), 6) AS abs_rel, round(avg(abs(p-t)), 6) AS abs_diff, round(avg((p-t)*(p-t)/t), 6) AS sq_rel, round(sqrt(avg((p-t)*(p-t))), 6) AS rmse,
round(sqrt(avg((ln(p)-ln(t))*(ln(p)-ln(t)))), 6) AS log_rmse, """
    + ", ".join(f"round(avg(CASE WHEN greatest(t/p, p/t) < {1.25**k!r} THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS r{k}" for k in (1, 2, 3))
    + ", round((SELECT avg(CASE WHEN pred > 0 THEN 1.0 ELSE 0.0 END) FROM depth)::DOUBLE, 6) AS complete FROM v",
)
def _(spark, d):
    return metrics.depth_metrics(fx.depth(spark, d))


@query("q_bounds", f"{C} SELECT " + ", ".join(f"round({f}({a}), 6) + 0.0 AS {n}_{a}" for a in "xyz" for n, f in (("lo", "min"), ("hi", "max"))) + " FROM cloud")
def _(spark, d):
    return filters.bounds(fx.cloud(spark, d))


@query("q_centroid", f"{C} SELECT label, round(avg(x), 6) + 0.0 AS cx, round(avg(y), 6) + 0.0 AS cy, round(avg(z), 6) + 0.0 AS cz FROM cloud GROUP BY label")
def _(spark, d):
    return metrics.centroid(fx.cloud(spark, d, "label"), "label")


@query("q_xy_cov", f"{C} SELECT round(var_pop(x), 6) + 0.0 AS cxx, round(covar_pop(x, y), 6) + 0.0 AS cxy, round(var_pop(y), 6) + 0.0 AS cyy FROM cloud")
def _(spark, d):
    return metrics.xy_covariance(fx.cloud(spark, d))


@query("q_runtime", "WITH b(method, variant, voxel_m, mean_ms, sd_ms) AS (VALUES " + ", ".join(f"('{m}', '{v}', {x}::DOUBLE, {a}::DOUBLE, {s}::DOUBLE)" for m, v, x, a, s in fx.BENCH) + ") SELECT b.voxel_m, b.method, b.variant, b.mean_ms, b.sd_ms, round(1000.0 / b.mean_ms, 6) AS per_s, round(r.mean_ms / b.mean_ms, 6) AS speedup FROM b LEFT JOIN (SELECT * FROM b WHERE method = 'field method') r ON r.voxel_m = b.voxel_m")
def _(spark, d):
    return metrics.speedup(fx.bench(spark), "field method")


@query("q_runtime_runs", "SELECT l_returnflag AS method, l_linestatus AS variant, l_tax AS voxel_m, round(avg(l_quantity), 6) AS mean_ms, round(stddev_samp(l_quantity), 6) AS sd_ms, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return metrics.runtime_summary(li.selectExpr("l_returnflag as method", "l_linestatus as variant", "l_tax as voxel_m", "l_quantity as ms"))


# meshes

M = f"WITH {fx.MESH_SQL}"
DM = f"WITH {fx.DIRTY_SQL}"
TRI = """tri AS (SELECT f.fid, f.i0, f.i1, f.i2,
(b.y-a.y)*(c.z-a.z)-(b.z-a.z)*(c.y-a.y) AS ux, (b.z-a.z)*(c.x-a.x)-(b.x-a.x)*(c.z-a.z) AS uy, (b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x) AS uz
FROM faces f JOIN vertices a ON a.vid = f.i0 JOIN vertices b ON b.vid = f.i1 JOIN vertices c ON c.vid = f.i2),
sized AS (SELECT *, sqrt(ux*ux+uy*uy+uz*uz) AS len FROM tri)"""


@query("q_mesh_area", f"{M}, {TRI} SELECT round(sum(0.5*len), 6) AS area FROM sized")
def _(spark, d):
    return mesh.surface_area(*fx.mesh(spark, d))


@query("q_sample_budget", f"{M}, {TRI} SELECT least(greatest(sum(0.5*len)/(0.01*0.01)*10, 100000), 8000000)::DOUBLE::BIGINT AS n FROM sized".replace("::DOUBLE::BIGINT", "::BIGINT").replace("SELECT least(", "SELECT floor(least(", 1).replace("8000000)", "8000000))", 1))
def _(spark, d):
    return mesh.sample_budget(mesh.surface_area(*fx.mesh(spark, d)), 0.01)


@query("q_dedup_vertices", f"{DM}, k AS (SELECT x, y, z, min(vid) AS keep FROM vertices GROUP BY x, y, z), m AS (SELECT vid, keep FROM vertices JOIN k USING (x, y, z)) SELECT f.fid, a.keep AS i0, b.keep AS i1, c.keep AS i2 FROM faces f JOIN m a ON a.vid = i0 JOIN m b ON b.vid = i1 JOIN m c ON c.vid = i2")
def _(spark, d):
    return mesh.merge_vertices(*fx.dirty_mesh(spark, d))[1]


@query("q_dedup_vertices_kept", f"{DM} SELECT min(vid) AS vid, x + 0.0 AS x, y + 0.0 AS y, z + 0.0 AS z FROM vertices GROUP BY x, y, z")
def _(spark, d):
    return mesh.merge_vertices(*fx.dirty_mesh(spark, d))[0]


LATTICE = "f AS (SELECT fid, i0 % 6 AS i0, i1 % 6 AS i1, i2 % 6 AS i2 FROM faces)"


def _lattice(spark: SparkSession, d: str) -> DataFrame:
    return fx.dirty_mesh(spark, d)[1].select("fid", *[(F.col(i) % 6).alias(i) for i in ("i0", "i1", "i2")])


@query("q_dedup_tris", f"{DM}, {LATTICE}, c AS (SELECT *, CASE WHEN i0 <= i1 AND i0 <= i2 THEN [i0, i1, i2] WHEN i1 <= i0 AND i1 <= i2 THEN [i1, i2, i0] ELSE [i2, i0, i1] END AS key FROM f) SELECT fid, i0, i1, i2 FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY fid) = 1")
def _(spark, d):
    return mesh.drop_duplicate_faces(_lattice(spark, d))


@query("q_degenerate", f"{DM}, {LATTICE} SELECT fid, i0, i1, i2 FROM f WHERE i0 <> i1 AND i1 <> i2 AND i0 <> i2")
def _(spark, d):
    return mesh.drop_degenerate_faces(_lattice(spark, d))


@query("q_nonmanifold", f"{DM.replace('faces AS (', 'faces0 AS (')}, faces AS (SELECT fid, i0 % 40 AS i0, i1 % 40 AS i1, i2 % 40 AS i2 FROM faces0), {TRI}, e AS (SELECT fid, len, unnest([[least(i0,i1),greatest(i0,i1)],[least(i1,i2),greatest(i1,i2)],[least(i2,i0),greatest(i2,i0)]]) AS e FROM sized), gone AS (SELECT fid FROM (SELECT fid, row_number() OVER (PARTITION BY e ORDER BY round(0.5*len, 12) DESC, fid) AS k FROM e) WHERE k > 2) SELECT fid, i0, i1, i2 FROM faces WHERE fid NOT IN (SELECT fid FROM gone)")
def _(spark, d):
    vertices, faces = fx.dirty_mesh(spark, d)
    return mesh.drop_nonmanifold_faces(vertices, faces.select("fid", *[(F.col(i) % 40).alias(i) for i in ("i0", "i1", "i2")]))


@query("q_vertex_normals", f"{M}, {TRI}, n AS (SELECT unnest([i0, i1, i2]) AS vid, ux/nullif(len,0) AS ux, uy/nullif(len,0) AS uy, uz/nullif(len,0) AS uz FROM sized), s AS (SELECT vid, sum(ux) AS sx, sum(uy) AS sy, sum(uz) AS sz, sqrt(sum(ux)*sum(ux)+sum(uy)*sum(uy)+sum(uz)*sum(uz)) AS len FROM n GROUP BY vid) SELECT vid, {r('x', 'y', 'z')}, round(sx/nullif(len,0), 6) + 0.0 AS nx, round(sy/nullif(len,0), 6) + 0.0 AS ny, round(sz/nullif(len,0), 6) + 0.0 AS nz FROM vertices LEFT JOIN s USING (vid)")
def _(spark, d):
    return mesh.vertex_normals(*fx.mesh(spark, d))


def surface_points(n: str) -> str:
    """CTEs after TRI that end in points(pid, x, y, z, fid)."""
    u = lambda k: f"(({draw('pid', 42, k)})::DOUBLE + 0.5) / 1152921504606846976.0::DOUBLE"
    at = ", ".join(f"(1-r)*ax_{k} + r*(1-q)*bx_{k} + r*q*cx_{k} AS {k}" for k in "xyz")
    corners = ", ".join(f"{v}.{k} AS {v}x_{k}" for v in "abc" for k in "xyz")
    return f"""shares AS (SELECT fid, i0, i1, i2, sum(0.5*len) OVER (ORDER BY fid % {mesh.BLOCKS}, fid) AS hi, sum(0.5*len) OVER () AS total, 0.5*len AS area FROM sized),
spans AS (SELECT *, round({n} * (hi - area) / total)::BIGINT AS k0, round({n} * hi / total)::BIGINT AS k1 FROM shares),
picked AS (SELECT fid, i0, i1, i2, unnest(range(k0, k1)) AS pid FROM spans),
drawn AS (SELECT picked.*, sqrt({u(1)}) AS r, {u(2)} AS q, {corners} FROM picked JOIN vertices a ON a.vid = i0 JOIN vertices b ON b.vid = i1 JOIN vertices c ON c.vid = i2),
points AS (SELECT pid, {at}, fid FROM drawn)"""


@query("q_surface_sample", f"{M}, {TRI}, {surface_points('5000.0')} SELECT {POINT}, fid FROM points")
def _(spark, d):
    return mesh.sample_surface(*fx.mesh(spark, d), 5000)


BUDGET = "(SELECT floor(least(greatest(sum(0.5*len)/(0.1*0.1)*10, 1000), 20000)) FROM sized)"


@query("q_mesh_to_cloud", f"{M}, {TRI}, {surface_points(BUDGET)}, pbox AS (SELECT {BOUNDS} FROM points), voxels AS (SELECT min(pid) AS pid, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM points, pbox GROUP BY floor((x - (lo_x - 0.1/2)) / 0.1), floor((y - (lo_y - 0.1/2)) / 0.1), floor((z - (lo_z - 0.1/2)) / 0.1)), {normals_sql('voxels', 30)} SELECT pid, {r('x', 'y', 'z')}, {NORMAL} FROM voxels JOIN normals USING (pid)")
def _(spark, d):
    return one_side(pipelines.mesh_to_cloud(*fx.mesh(spark, d), voxel=0.1, low=1000, high=20_000)[2])


# volumes


@query("q_occupancy", f"{C}, {DIMS}, {CELLS}, {OCC} SELECT * FROM occ")
def _(spark, d):
    return volume.occupancy(fx.cloud(spark, d), 0.1, 0.05)


@query("q_boundary_midpoints", f"{C}, {DIMS}, {CELLS}, {OCC}, s(axis, dir) AS (VALUES (0,-1),(0,1),(1,-1),(1,1),(2,-1),(2,1)), n AS (SELECT ix, iy, iz, axis, dir, ix + CASE WHEN axis = 0 THEN dir ELSE 0 END AS jx, iy + CASE WHEN axis = 1 THEN dir ELSE 0 END AS jy, iz + CASE WHEN axis = 2 THEN dir ELSE 0 END AS jz FROM occ, s) SELECT n.ix, n.iy, n.iz, axis, dir FROM n, dims WHERE jx >= 0 AND jx < nx AND jy >= 0 AND jy < ny AND jz >= 0 AND jz < nz AND NOT EXISTS (SELECT 1 FROM occ o WHERE o.ix = jx AND o.iy = jy AND o.iz = jz)")
def _(spark, d):
    c = fx.cloud(spark, d)
    return volume.boundary_midpoints(volume.occupancy(c, 0.1, 0.05), g.grid_dims(c, 0.1, 0.05))


GRID = f"{C}, {DIMS}, {CELLS}, {OCC}, grid AS (SELECT a.k::INTEGER AS ix, b.k::INTEGER AS iy, c.k::INTEGER AS iz FROM range((SELECT nx FROM dims)) a(k), range((SELECT ny FROM dims)) b(k), range((SELECT nz FROM dims)) c(k)), cellz AS (SELECT g.*, o.ix IS NOT NULL AS occ FROM grid g LEFT JOIN occ o ON o.ix = g.ix AND o.iy = g.iy AND o.iz = g.iz)"
NEAR = "sqrt(min((g.ix-o.ix)*(g.ix-o.ix)+(g.iy-o.iy)*(g.iy-o.iy)+(g.iz-o.iz)*(g.iz-o.iz)))*0.1"


def _grid(spark: SparkSession, d: str) -> DataFrame:
    c = fx.cloud(spark, d)
    return volume.dense(volume.occupancy(c, 0.1, 0.05), g.grid_dims(c, 0.1, 0.05))


@query("q_edt", f"{GRID} SELECT g.ix, g.iy, g.iz, any_value(g.occ) AS occ, round({NEAR}, 6) AS dist FROM cellz g, occ o GROUP BY g.ix, g.iy, g.iz")
def _(spark, d):
    return volume.distance_transform(_grid(spark, d), 0.1)


SDF = f"o1 AS (SELECT g.ix, g.iy, g.iz, any_value(g.occ) AS occ, {NEAR} AS a FROM cellz g, occ o GROUP BY g.ix, g.iy, g.iz), o2 AS (SELECT g.ix, g.iy, g.iz, {NEAR} AS b FROM cellz g, (SELECT * FROM cellz WHERE NOT occ) o GROUP BY g.ix, g.iy, g.iz), signed AS (SELECT ix, iy, iz, occ, a - b AS sdf FROM o1 JOIN o2 USING (ix, iy, iz))"


@query("q_sdf", f"{GRID}, {SDF} SELECT ix, iy, iz, occ, round(sdf, 6) + 0.0 AS sdf FROM signed")
def _(spark, d):
    return volume.signed_distance(_grid(spark, d), 0.1)


def mirrored(i: str, n: str) -> str:
    return f"CASE WHEN {i} < 0 THEN -{i} - 1 WHEN {i} >= {n} THEN 2*{n} - 1 - {i} ELSE {i} END"


SMOOTH = "kern AS (SELECT (k - 4)::INTEGER AS o, exp(-0.5*(k-4)*(k-4)) / sum(exp(-0.5*(k-4)*(k-4))) OVER () AS w FROM range(9) r(k))" + "".join(
    f", pass{p} AS (SELECT " + ", ".join(f"g.i{b}" for b in "xyz") + f", sum(w * s.{'sdf' if p == 0 else 'v'}) AS v FROM grid g, kern, dims JOIN {'signed' if p == 0 else f'pass{p - 1}'} s ON " + " AND ".join(f"s.i{b} = " + (mirrored(f"(g.i{b} + o)", f"n{b}") if b == a else f"g.i{b}") for b in "xyz") + " GROUP BY g.ix, g.iy, g.iz)"
    for p, a in enumerate("xyz")
)


@query("q_gaussian", f"{GRID}, {SDF}, {SMOOTH} SELECT ix, iy, iz, occ, round(v, 6) + 0.0 AS sdf FROM pass2 JOIN cellz USING (ix, iy, iz)")
def _(spark, d):
    return volume.gaussian(volume.signed_distance(_grid(spark, d), 0.1), 1.0)


#: Where an unsmoothed surface crosses: the middles between occupied and empty cells.
SIDES = "sides(axis, dx, dy, dz) AS (VALUES (0,-1,0,0),(0,1,0,0),(1,0,-1,0),(1,0,1,0),(2,0,0,-1),(2,0,0,1)), nb AS (SELECT ix, iy, iz, ix + dx AS jx, iy + dy AS jy, iz + dz AS jz FROM occ, sides), gaps AS (SELECT nb.* FROM nb, dims WHERE jx >= 0 AND jx < nx AND jy >= 0 AND jy < ny AND jz >= 0 AND jz < nz AND NOT EXISTS (SELECT 1 FROM occ o WHERE o.ix = jx AND o.iy = jy AND o.iz = jz)), middles AS (SELECT " + ", ".join(f"o{a} + (i{a} + j{a}) / 2.0 * 0.1 AS {a}" for a in "xyz") + " FROM gaps, dims)"


@query("q_mc", f"{C}, {DIMS}, {CELLS}, {OCC}, {SIDES} SELECT {r('x', 'y', 'z')} FROM middles")
def _(spark, d):
    """The vertices of the zero level of the signed distance."""
    o = g.grid_dims(fx.cloud(spark, d), 0.1, 0.05).first()
    soup = volume.surface(volume.signed_distance(_grid(spark, d), 0.1), 0.1, (o.ox, o.oy, o.oz), slope=2.0)
    return volume.mesh_of(soup)[0].select("x", "y", "z")


WIDE = DIMS.replace("0.05", "0.2")


@query("q_cloud_to_mesh", f"{C}, {WIDE}, {CELLS}, {OCC}, {SIDES} SELECT {r('x', 'y', 'z')} FROM middles")
def _(spark, d):
    return pipelines.cloud_to_mesh(fx.cloud(spark, d), 0.1, 0.2)[0].select("x", "y", "z")


@query("q_mesh_closed", "SELECT 0::BIGINT AS open_edges, 0::BIGINT AS one_way")
def _(spark, d):
    """A surface inside its grid is closed: every edge is passed as often one
    way as the other."""
    _, faces = pipelines.cloud_to_mesh(fx.cloud(spark, d), 0.1, 0.2)
    way = faces.select(F.explode(F.array(*[F.struct(F.col(f"i{i}").alias("a"), F.col(f"i{(i + 1) % 3}").alias("b")) for i in range(3)])).alias("e"))
    edge = way.groupBy(F.least("e.a", "e.b").alias("u"), F.greatest("e.a", "e.b").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("e.a") < F.col("e.b"), 1).otherwise(-1)).alias("net"))
    return edge.agg(F.count_if(F.col("n") % 2 != 0).alias("open_edges"), F.count_if(F.col("net") != 0).alias("one_way"))


# registration

SHIFT = g.compose(g.rotation((0, 0, 1), math.radians(3)), g.translation(0.01, -0.01, 0.005))
#: What undoes it: turned back by 3 degrees after moving back.
BACK = f"WITH RECURSIVE steps(seq, m) AS (VALUES (0, {move('-0.01', '0.01', '-0.005')}), (1, {turn('z', '-radians(3)')})), {PRODUCT} SELECT k::INTEGER AS k, round(t[(k + 1)::INTEGER], 6) + 0.0 AS v FROM prod, range(16) r(k) WHERE seq = 1"


def _flat(spark: SparkSession, t: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.asarray(t).ravel())], "k int, v double")


@query("q_icp_init", BACK)
def _(spark, d):
    c = fx.cloud(spark, d)
    return _flat(spark, register.initial_pose(g.transform(c, SHIFT), c))


@query("q_icp", BACK)
def _(spark, d):
    c = stored(fx.cloud(spark, d), "cloud")
    return _flat(spark, register.icp(stored(g.transform(c, SHIFT), "moved"), c, 0.1, "p2p", 60).transform)


@query("q_icp_planes", BACK)
def _(spark, d):
    c = stored(register.normals(fx.cloud(spark, d), 0.3, 30), "normals")
    return _flat(spark, register.icp(stored(g.transform(c.select("pid", "x", "y", "z"), SHIFT), "moved"), c, 0.1, "p2l", 60).transform)


#: A larger motion of a cloud of the size of a courtyard, for the full schedule.
FAR_BACK = f"WITH RECURSIVE steps(seq, m) AS (VALUES (0, {move('-3', '2', '-1')}), (1, {turn('z', '-0.4')})), {PRODUCT} SELECT k::INTEGER AS k, round(t[(k + 1)::INTEGER], 4) + 0.0 AS v FROM prod, range(16) r(k) WHERE seq = 1"


@query("q_icp_multiscale", FAR_BACK)
def _(spark, d):
    c = fx.cloud(spark, d).select("pid", *[(F.col(a) * 50).alias(a) for a in "xyz"])
    moved = g.transform(c, g.compose(g.rotation((0, 0, 1), 0.4), g.translation(3, -2, 1)))
    return _flat(spark, register.icp_multiscale(moved, c)[1]).withColumn("v", F.round("v", 4))


# larger clouds

BIG = f"WITH {fx.LARGE_SQL}"


@query("q_big_voxels", f"{BIG}, box AS (SELECT {BOUNDS} FROM big) SELECT " + ", ".join(f"round(avg({a}) + 3e-10, 6) + 0.0 AS {a}" for a in "xyz") + " FROM big, box GROUP BY " + ", ".join(f"floor(({a} - (lo_{a} - 2.0/2)) / 2.0)" for a in "xyz"))
def _(spark, d):
    # prices have five decimals, so means often end in a 5 at the seventh: off the tie
    out = metrics.voxel_downsample(fx.large_cloud(spark, d), 2.0)
    return out.select(*[(F.col(a) + F.lit(3e-10)).alias(a) for a in "xyz"])


@query("q_big_crop", f"{BIG} SELECT count(*) AS n FROM big WHERE x BETWEEN 10 AND 20 AND y BETWEEN 10 AND 20 AND z BETWEEN 10 AND 20")
def _(spark, d):
    box = spark.createDataFrame([(10.0, 20.0) * 3], ", ".join(f"lo_{a} double, hi_{a} double" for a in "xyz"))
    return filters.crop(fx.large_cloud(spark, d), box).agg(F.count(F.lit(1)).alias("n"))


#: Neighbours of a few points among all: SQL compares every pair.
SOME = "asked AS (SELECT * FROM big WHERE pid % 300 = 0)"
#: A slice of the cloud, searched against itself.
SLAB = "slab AS (SELECT * FROM big WHERE x >= 20 AND x < 23)"


def _slab(spark: SparkSession, d: str) -> DataFrame:
    return stored(fx.large_cloud(spark, d).where("x >= 20 and x < 23"), "slab")


def smallest(k: int, query: str, target: str, name: str) -> str:
    """CTE (pid, near) of the k smallest (d2, nid) of every query point."""
    return f"{name} AS (SELECT a.pid, min(struct_pack(d2 := {D2}, nid := b.pid), {k}) AS near FROM {query} a, {target} b GROUP BY a.pid)"


@query("q_big_knn", f"{BIG}, {SOME}, {smallest(8, 'asked', 'big', 'nb')} SELECT pid, k::INTEGER AS rank, near[k::INTEGER].nid AS nid, round(near[k::INTEGER].d2, 6) AS d2 FROM nb, range(1, 9) r(k)")
def _(spark, d):
    big = stored(fx.large_cloud(spark, d), "big")
    return spatial.knn(big.where("pid % 300 = 0"), big, 8)


@query("q_big_nearest", f"{BIG}, {SOME}, rest AS (SELECT pid, x + 7.3 AS x, y, z FROM big WHERE pid % 300 <> 0), {smallest(1, 'asked', 'rest', 'nb')} SELECT pid, near[1].nid AS nid, round(sqrt(near[1].d2), 6) AS dist FROM nb")
def _(spark, d):
    big = stored(fx.large_cloud(spark, d), "big")
    return spatial.nearest(big.where("pid % 300 = 0"), big.where("pid % 300 <> 0").withColumn("x", F.col("x") + 7.3))


@query("q_big_sor", f"{BIG}, {SLAB}, {smallest(25, 'slab', 'slab', 'nb')}, m AS (SELECT pid, list_avg(list_transform(near, lambda n: sqrt(n.d2))) AS m FROM nb) SELECT {POINT} FROM slab WHERE pid IN (SELECT pid FROM m WHERE m > 0 AND m < (SELECT avg(m) + 1.8 * stddev_samp(m) FROM m))")
def _(spark, d):
    return filters.statistical_outliers(_slab(spark, d), 25, 1.8)


@query("q_big_knn_pct", f"{BIG}, {SLAB}, {smallest(17, 'slab', 'slab', 'nb')}, kd AS (SELECT pid, sqrt(near[17].d2) AS dk FROM nb) SELECT {POINT} FROM slab JOIN kd USING (pid) WHERE dk <= (SELECT quantile_cont(dk, 0.95) FROM kd)")
def _(spark, d):
    return filters.knn_percentile(_slab(spark, d), 16, 95.0, 1.0)


@query("q_big_ror", f"{BIG}, {SLAB}, {ror(16, 2.5, 'slab')} SELECT {POINT} FROM ror")
def _(spark, d):
    return filters.radius_outliers(_slab(spark, d), 16, 2.5)


@query("q_big_dbscan", f"{BIG.replace('WITH ', 'WITH RECURSIVE ', 1)}, {dbscan('big', '0.45', 4)} SELECT {POINT}, label FROM clustered")
def _(spark, d):
    return cluster.dbscan(stored(fx.large_cloud(spark, d), "big"), 0.45, 4)


@query("q_big_icp", BACK)
def _(spark, d):
    """Registration of a slice; the motion is about the origin of the slice."""
    c = stored(_slab(spark, d).selectExpr("pid", "x - 21 as x", "y - 26 as y", "z - 46 as z"), "fixed")
    return _flat(spark, register.icp(stored(g.transform(c, SHIFT), "moved"), c, 3.0, "p2p", 100, tolerance=1e-12).transform)


# files


def _file(spark: SparkSession, name: str) -> str:
    return f"{session_dir(spark)}/{uuid.uuid4().hex}-{name}"


@query("q_ply_file", f"{C} SELECT pid, {r('x', 'y', 'z')}, label FROM cloud")
def _(spark, d):
    path = _file(spark, "cloud.ply")
    formats.write_cloud(fx.cloud(spark, d, "label"), path)
    return formats.read_cloud(spark, path)


@query("q_pcd_file", f"{C} SELECT pid, {r('x', 'y', 'z')}, round(embedding[4]::FLOAT::DOUBLE, 6) + 0.0 AS intensity FROM cloud")
def _(spark, d):
    """Every attribute through a PCD file, intensity unified, through a PLY file."""
    first, second = _file(spark, "cloud.pcd"), _file(spark, "cloud.ply")
    formats.write_cloud(fx.cloud(spark, d, F.col("embedding")[3].alias("reflectance")), first)
    pipelines.pcd_to_ply(spark, first, second)
    return formats.read_cloud(spark, second).select("pid", "x", "y", "z", F.col("intensity").cast("double").alias("intensity"))


@query("q_stl_file", f"{M} SELECT fid, " + ", ".join(f"round({v}.{k}::FLOAT::DOUBLE, 6) + 0.0 AS {v}{k}" for v in "abc" for k in "xyz") + " FROM faces JOIN vertices a ON a.vid = i0 JOIN vertices b ON b.vid = i1 JOIN vertices c ON c.vid = i2")
def _(spark, d):
    path = _file(spark, "mesh.stl")
    formats.write_stl(*fx.mesh(spark, d), path)
    return spark.read.format("stl").load(path)


@query("q_mesh_file", f"{M} SELECT fid, " + ", ".join(f"round({v}.{k}, 6) + 0.0 AS {v}{k}" for v in "abc" for k in "xyz") + " FROM faces JOIN vertices a ON a.vid = i0 JOIN vertices b ON b.vid = i1 JOIN vertices c ON c.vid = i2")
def _(spark, d):
    path = _file(spark, "mesh.ply")
    formats.write_mesh_ply(*fx.mesh(spark, d), path)
    return mesh.triangles(*formats.read_mesh(spark, path)).selectExpr("fid", *[f"{v}.{k} as {v}{k}" for v in "abc" for k in "xyz"])


@query("q_cloud_or_mesh", f"{M}, {TRI}, {surface_points('800.0')} SELECT {POINT} FROM points")
def _(spark, d):
    """A file without points of its own is sampled."""
    path = _file(spark, "mesh.ply")
    vertices, faces = fx.mesh(spark, d)
    formats.write_mesh_ply(vertices, faces, path)
    stl = path.replace(".ply", ".stl")
    formats.write_stl(*formats.read_mesh(spark, path), stl)
    return mesh.sample_surface(*formats.read_mesh(spark, path), 800).select("pid", "x", "y", "z") if formats.read_cloud_or_mesh(spark, stl, 800).count() == 800 else spark.createDataFrame([], "pid bigint, x double, y double, z double")
