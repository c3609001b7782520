"""Registered queries over the driver's tables, and their SQL.

The raster is the embeddings table: row = vec_id, col = component, v the value.
Doubles are rounded to 6 places where they are returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.functions import phase as P
from phasegrid.operators import bridge as B
from phasegrid.operators import components, costs, flow, grid, seams, tiles
from phasegrid.operators.graph import written
from phasegrid.options import BridgeOptions, CostModel, LaplaceOptions, UnwrapOptions
from phasegrid.plans.unwrap import unwrap
from phasegrid.solvers.tiles import refine_flows, solve_tiles
from phasegrid.sources.raster import embedding_raster, from_blocks, raster_shape, to_blocks

NLOOKS = 4.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(x) -> Column:
    return F.round(x, 6) + 0.0


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """psi (noisy slope), coherence, mask, and an unwrapped raster to post-process."""
    slope = 0.3 * F.col("row") + 0.4 * F.col("col") + 12 * F.col("v")
    df = embedding_raster(spark, sf_dir).withColumns({
        "psi": P.wrap_positive(slope),
        "corr": F.least(F.lit(1.0), 0.3 + 2 * F.abs("v")),
        "mask": F.col("label") != 3,
    })
    return df.select("scene", "row", "col", "v", "label", "psi", "corr", "mask")


def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unwrapped raster with plateaus, spikes and small noise."""
    u = 0.02 * F.col("row") + 0.015 * F.col("col") + F.col("v") + P.TWO_PI * F.when(F.col("row") % 50 == 27, 1).when(F.col("row") % 50 == 41, -2).otherwise(0)
    return raster(spark, sf_dir).withColumn("unw", u + P.TWO_PI * F.when(F.col("col") >= 40, 2).otherwise(0))


#: The same rasters in SQL.
PX = """
n AS (SELECT max(vec_id) + 1 AS nr, 64 AS nc FROM embeddings),
px AS (
  SELECT CAST(vec_id AS INTEGER) AS r, CAST(c AS INTEGER) AS c, v, label, label <> 3 AS mask, least(1.0, CAST(0.3 AS DOUBLE) + 2 * abs(v)) AS corr,
         p - 2 * pi() * floor(p / (2 * pi())) AS psi,
         CAST(0.02 AS DOUBLE) * vec_id + CAST(0.015 AS DOUBLE) * c + v + 2 * pi() * CASE vec_id % 50 WHEN 27 THEN 1 WHEN 41 THEN -2 ELSE 0 END
           + 2 * pi() * CASE WHEN c >= 40 THEN 2 ELSE 0 END AS unw
  FROM (SELECT vec_id, c, v, label, CAST(0.3 AS DOUBLE) * vec_id + CAST(0.4 AS DOUBLE) * c + 12 * v AS p
        FROM (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS c, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings))
)"""
WRAP = "({0}) - floor(({0}) + 0.5)"
ROW_AXIS = f"""
dr AS (SELECT r, c, {WRAP.format('(psi - lead(psi) OVER w) / (2 * pi())')} AS d, 0.5 * (corr + lead(corr) OVER w) AS rho,
       CASE WHEN mask AND lead(mask) OVER w THEN 1 ELSE 0 END AS w FROM px WINDOW w AS (PARTITION BY c ORDER BY r) QUALIFY lead(r) OVER w IS NOT NULL)"""
COL_AXIS = f"""
dc AS (SELECT r, c, {WRAP.format('(lead(psi) OVER w - psi) / (2 * pi())')} AS d, 0.5 * (corr + lead(corr) OVER w) AS rho,
       CASE WHEN mask AND lead(mask) OVER w THEN 1 ELSE 0 END AS w FROM px WINDOW w AS (PARTITION BY r ORDER BY c) QUALIFY lead(c) OVER w IS NOT NULL)"""


def boxcar_sql(source: str, out: str, value: str, nr: str, nc: str, k: int = 3) -> str:
    """Mirror-padded moving average along rows, then columns, over the whole of `source`."""
    return f"""
{out}_p AS (SELECT r, c, {value} AS x FROM {source} UNION ALL SELECT r, -c, {value} FROM {source} WHERE c BETWEEN 1 AND {k}
  UNION ALL SELECT r, 2 * ({nc} - 1) - c, {value} FROM {source} WHERE c BETWEEN {nc} - 1 - {k} AND {nc} - 2),
{out}_a AS (SELECT * FROM (SELECT r, c, avg(x) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING) AS x FROM {out}_p) WHERE c BETWEEN 0 AND {nc} - 1),
{out}_q AS (SELECT r, c, x FROM {out}_a UNION ALL SELECT -r, c, x FROM {out}_a WHERE r BETWEEN 1 AND {k}
  UNION ALL SELECT 2 * ({nr} - 1) - r, c, x FROM {out}_a WHERE r BETWEEN {nr} - 1 - {k} AND {nr} - 2),
{out} AS (SELECT * FROM (SELECT r, c, avg(x) OVER (PARTITION BY c ORDER BY r ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING) AS average FROM {out}_q) WHERE r BETWEEN 0 AND {nr} - 1)"""


_NR, _NC = "(SELECT nr FROM n)", "(SELECT nc FROM n)"
ARCS = f"""{PX}, {ROW_AXIS}, {COL_AXIS},
{boxcar_sql('dr', 'ar', 'd', f'({_NR} - 1)', _NC)},
{boxcar_sql('dc', 'ac', 'd', _NR, f'({_NC} - 1)')},
k AS (SELECT CAST(1.2 AS DOUBLE) * (CAST(1.3 AS DOUBLE) / 4 + CAST(0.14 AS DOUBLE)) AS thr, CAST(2 * 0.4 AS DOUBLE) + CAST(0.35 AS DOUBLE) * ln(4) + CAST(0.06 AS DOUBLE) * 4 AS pw),
inputs AS (SELECT 'row' AS axis, r, c, d, rho, w, average FROM dr JOIN ar USING (r, c) UNION ALL SELECT 'col', r, c, d, rho, w, average FROM dc JOIN ac USING (r, c)),
parts AS (SELECT axis, r, c, w, 200 * (d - CASE WHEN rho0 > 0 THEN average ELSE CAST(0.5 AS DOUBLE) * average END) AS off,
  (CAST(2 AS DOUBLE) / 12 * CASE WHEN rho0 >= 1 THEN 0 ELSE pow(1 - rho0, pw) END + CAST(0.05 AS DOUBLE)) * 40000 / 100 AS var
  FROM (SELECT *, CASE WHEN rho < thr THEN 0 ELSE rho END AS rho0 FROM inputs, k)),
arcs AS (SELECT axis, r, c, CASE WHEN w = 0 THEN 16000 ELSE greatest(-32768, least(32767, CAST(trunc(round(off, 9)) AS BIGINT))) END AS "offset",
  CASE WHEN w = 0 THEN 32000 ELSE least(32767, greatest(1, CAST(trunc(round(var, 6)) AS BIGINT))) END AS sigsq FROM parts)"""


def incr_sql(flow: str, source: str = "arcs") -> str:
    """poscost and negcost at a flow, step 1."""
    # Whole-number arithmetic: squares by multiplication.
    sq = lambda e: f"(({e}) * ({e}))"
    z = f'(({flow}) * 200 + "offset")'
    up, down = f'(({flow} + 1) * 200 + "offset")', f'(({flow} - 1) * 200 + "offset")'
    cost = lambda e: f"CASE WHEN sigsq = 32000 THEN 0 ELSE greatest(-32000, least(32000, {sq(e)} // sigsq - {sq(z)} // sigsq)) END"
    return f"*, CAST({cost(up)} AS SMALLINT) AS poscost, CAST({cost(down)} AS SMALLINT) AS negcost"


def arcs_of(spark: SparkSession, sf_dir: str, cost: str = "smooth", axis: str | None = None) -> DataFrame:
    df, shape = raster(spark, sf_dir), raster_shape(spark, sf_dir)
    if axis is None:
        return costs.build_costs(df, shape, NLOOKS, cost)
    form = costs.smooth_costs if cost == "smooth" else costs.defo_costs
    return form(costs.arc_inputs(df, axis, shape), axis, NLOOKS)


# ---------------------------------------------------------------- scalars, filters


@query(f"""WITH {PX}, z AS (SELECT r, c, psi, cos(psi) AS re, sin(psi) AS im FROM px)
SELECT r AS "row", c AS "col", round(CASE WHEN atan2(im, re) < 0 THEN atan2(im, re) + 2 * pi() ELSE atan2(im, re) END, 6) + 0.0 AS psi FROM z""")
def wrap_phase(spark, sf_dir):
    """M1, S3: phase of the complex raster."""
    df = raster(spark, sf_dir).select("row", "col", F.cos("psi").alias("re"), F.sin("psi").alias("im"))
    return df.select("row", "col", r6(P.wrapped_phase("re", "im")).alias("psi"))


@query(f"""WITH {PX} SELECT r AS "row", c AS "col", round(x - 2 * pi() * floor(x / (2 * pi())), 6) + 0.0 AS positive,
round({WRAP.format('x')}, 6) + 0.0 AS cycles, round(x - 2 * pi() * round_even(x / (2 * pi()), 0), 6) + 0.0 AS signed,
CAST(floor(k / 7.0) AS BIGINT) AS down, CAST(ceil(k / 7.0) AS BIGINT) AS up,
round(psi + 2 * pi() * round_even((x - psi) / (2 * pi()), 0), 6) + 0.0 AS congruent
FROM (SELECT *, 100 * v AS x, (c - 32) * (r % 5) AS k FROM px)""")
def scalar_functions(spark, sf_dir):
    """M2-M5, M10."""
    df = raster(spark, sf_dir).withColumn("x", 100 * F.col("v")).withColumn("k", ((F.col("col") - 32) * (F.col("row") % 5)).cast("long"))
    seven = F.lit(7).cast("long")
    return df.select(
        "row", "col", r6(P.wrap_positive("x")).alias("positive"), r6(P.wrap_cycles("x")).alias("cycles"), r6(P.wrap_signed("x")).alias("signed"),
        P.floor_div(F.col("k"), seven).alias("down"), P.ceil_div(F.col("k"), seven).alias("up"), r6(P.congruent("x", "psi")).alias("congruent"),
    )


@query("""SELECT o_orderkey, round(13.0 * (o_orderkey % 16 + 1) * (CAST(2.33 AS DOUBLE) * CAST(2.75 AS DOUBLE)) / (CAST(7.5 AS DOUBLE) * CAST(6.0 AS DOUBLE)), 6) + 0.0 AS looks FROM orders""")
def effective_looks(spark, sf_dir):
    """A3: 13 range looks, 1 to 16 azimuth looks."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return df.select("o_orderkey", r6(P.effective_looks(F.lit(13.0), F.col("o_orderkey") % 16 + 1, 2.33, 2.75, 7.5, 6.0)).alias("looks"))


@query(f"""WITH {PX} SELECT d, r AS "row", c AS "col", CASE d WHEN 0 THEN (r - 1) * 64 + c WHEN 1 THEN r * 64 + c WHEN 2 THEN (nr - 1) * 64 + r * 63 + c - 1 ELSE (nr - 1) * 64 + r * 63 + c END AS arc
FROM px, n, range(4) t(d) WHERE NOT (d = 0 AND r = 0) AND NOT (d = 1 AND r = nr - 1) AND NOT (d = 2 AND c = 0) AND NOT (d = 3 AND c = 63)""")
def arc_index(spark, sf_dir):
    """M7."""
    df = raster(spark, sf_dir).withColumn("d", F.explode(F.array(*[F.lit(d).cast("long") for d in range(4)])))
    return df.select("d", "row", "col", P.arc_index("d", "row", "col", *raster_shape(spark, sf_dir)).alias("arc")).where("arc is not null")


@query(f"""WITH {PX}, a AS (SELECT 'row' AS axis, r, c FROM px, n WHERE r < nr - 1 UNION ALL SELECT 'col', r, c FROM px WHERE c < 63)
SELECT axis, r AS "row", c AS "col",
CASE WHEN axis = 'row' THEN CASE WHEN c = 0 THEN (nr - 1) * 63 ELSE r * 63 + c - 1 END ELSE CASE WHEN r = 0 THEN (nr - 1) * 63 ELSE (r - 1) * 63 + c END END AS tail,
CASE WHEN axis = 'row' THEN CASE WHEN c = 63 THEN (nr - 1) * 63 ELSE r * 63 + c END ELSE CASE WHEN r = nr - 1 THEN (nr - 1) * 63 ELSE r * 63 + c END END AS head
FROM a, n WHERE NOT (axis = 'col' AND (r = 0 OR r = nr - 1) AND (c = 0 OR c = 62))""")
def arc_endpoints(spark, sf_dir):
    """M8: nodes at the ends of each arc of the residue network."""
    shape = raster_shape(spark, sf_dir)
    df = raster(spark, sf_dir)
    arcs = df.where(F.col("row") < shape[0] - 1).select(F.lit("row").alias("axis"), "row", "col").union(df.where(F.col("col") < shape[1] - 1).select(F.lit("col"), "row", "col"))
    tail, head = P.arc_endpoints("axis", "row", "col", *shape)
    return arcs.select("axis", "row", "col", tail.alias("tail"), head.alias("head")).where("tail is not null")


@query(f"""WITH {PX}, z AS (SELECT r, c, CASE WHEN c % 9 = 4 THEN CAST('nan' AS DOUBLE) WHEN r % 11 = 3 THEN CAST('inf' AS DOUBLE) ELSE v END AS re, v AS im,
CASE WHEN c % 7 = 2 THEN CAST('nan' AS DOUBLE) ELSE corr END AS corr, mask FROM px)
SELECT r AS "row", c AS "col", round(CASE WHEN isfinite(re) THEN re ELSE 0 END, 6) + 0.0 AS re, round(CASE WHEN isfinite(re) THEN im ELSE 0 END, 6) + 0.0 AS im,
round(CASE WHEN isfinite(corr) THEN corr ELSE 0 END, 6) + 0.0 AS corr, mask, CASE WHEN mask THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS magnitude,
isfinite(corr) AND corr >= 0.4 AS coherent FROM z""")
def clean_inputs(spark, sf_dir):
    """Non-finite values, mask, magnitude, coherence floor."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    df = raster(spark, sf_dir).select(
        "scene", "row", "col", F.when(F.col("col") % 9 == 4, nan).when(F.col("row") % 11 == 3, inf).otherwise(F.col("v")).alias("re"),
        F.col("v").alias("im"), F.when(F.col("col") % 7 == 2, nan).otherwise(F.col("corr")).alias("corr"), F.col("mask").cast("byte").alias("mask"), F.lit(None).cast("double").alias("mag"),
    )
    df = grid.clean(df)
    return df.select("row", "col", r6("re").alias("re"), r6("im").alias("im"), r6("corr").alias("corr"), "mask", grid.masked_magnitude().alias("magnitude"), (F.col("corr") >= 0.4).alias("coherent"))


# ---------------------------------------------------------------- grid


@query(f"""WITH {PX}, {COL_AXIS} SELECT r AS "row", c AS "col", round(d, 6) + 0.0 AS d FROM dc""")
def range_diff(spark, sf_dir):
    """G1, M3."""
    return grid.range_diff(raster(spark, sf_dir)).select("row", "col", r6("d").alias("d"))


@query(f"""WITH {PX}, {ROW_AXIS} SELECT r AS "row", c AS "col", round(d, 6) + 0.0 AS d FROM dr""")
def azimuth_diff(spark, sf_dir):
    """G2."""
    return grid.azimuth_diff(raster(spark, sf_dir)).select("row", "col", r6("d").alias("d"))


@query(f"""WITH {PX}, p AS (SELECT r, c, psi FROM px UNION ALL SELECT r, -c, psi FROM px WHERE c BETWEEN 1 AND 3 UNION ALL SELECT r, 126 - c, psi FROM px WHERE c BETWEEN 60 AND 62)
SELECT r AS "row", c AS "col", round(psi, 6) + 0.0 AS psi FROM p""")
def mirror_pad(spark, sf_dir):
    """G3 along rows."""
    return grid.mirror_pad(raster(spark, sf_dir), "col", 64, 3).select("row", "col", r6("psi").alias("psi"))


@query(f"""WITH {PX}, {boxcar_sql('px', 'a', 'psi', _NR, _NC)} SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS "col", round(average, 6) + 0.0 AS average FROM a""")
def boxcar(spark, sf_dir):
    """7 x 7 average."""
    return grid.boxcar(raster(spark, sf_dir), "psi", raster_shape(spark, sf_dir), (3, 3)).select("row", "col", r6("psi").alias("average"))


@query(f"""WITH {PX}, m AS (SELECT r, c, label = 3 AND c % 13 = 5 AS m FROM px),
g AS (SELECT r, c, bool_or(m) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS m0,
bool_or(m) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m1, bool_or(m) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m2,
bool_or(m) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m3, m AS m4 FROM m)
SELECT r AS "row", c AS "col", m0 OR coalesce(lag(m1, 1) OVER w, false) OR coalesce(lead(m1, 1) OVER w, false) OR coalesce(lag(m2, 2) OVER w, false) OR coalesce(lead(m2, 2) OVER w, false)
OR coalesce(lag(m3, 3) OVER w, false) OR coalesce(lead(m3, 3) OVER w, false) OR coalesce(lag(m4, 4) OVER w, false) OR coalesce(lead(m4, 4) OVER w, false) AS mask
FROM g WINDOW w AS (PARTITION BY c ORDER BY r)""")
def dilate_mask(spark, sf_dir):
    """Four steps from scattered pixels."""
    df = raster(spark, sf_dir).withColumn("mask", (F.col("label") == 3) & (F.col("col") % 13 == 5))
    return grid.dilate(df, 4).select("row", "col", "mask")


@query(f"""WITH {PX}, {ROW_AXIS}, {COL_AXIS} SELECT 'row' AS axis, r AS "row", c AS "col", w AS weight FROM dr UNION ALL SELECT 'col', r, c, w FROM dc""")
def arc_weight(spark, sf_dir):
    """F9."""
    df, shape = raster(spark, sf_dir), raster_shape(spark, sf_dir)
    row = df.select("row", "col", grid.arc_masks(df, "col").alias("weight")).where(F.col("row") < shape[0] - 1)
    col = df.select("row", "col", grid.arc_masks(df, "row").alias("weight")).where(F.col("col") < shape[1] - 1)
    return row.select(F.lit("row").alias("axis"), "row", "col", "weight").union(col.select(F.lit("col"), "row", "col", "weight"))


@query(f"""WITH {PX} SELECT r AS "row", c AS "col", CASE WHEN mask THEN 1 + c % 3 ELSE 0 END AS conncomp FROM px""")
def restore_mask(spark, sf_dir):
    """F13."""
    df = raster(spark, sf_dir).withColumn("conncomp", 1 + F.col("col") % 3)
    return grid.restore_mask(df).select("row", "col", "conncomp")


# ---------------------------------------------------------------- costs

_SMOOTH = f'WITH {ARCS} SELECT axis, r AS "row", c AS "col", CAST("offset" AS SMALLINT) AS "offset", CAST(sigsq AS SMALLINT) AS sigsq FROM arcs'
_OUT = ("axis", "row", "col", "offset", "sigsq")


@query(_SMOOTH + " WHERE axis = 'col'")
def smooth_cost_col(spark, sf_dir):
    """C1, C2."""
    return arcs_of(spark, sf_dir, axis="col").select(*_OUT)


@query(_SMOOTH + " WHERE axis = 'row'")
def smooth_cost_row(spark, sf_dir):
    """C3."""
    return arcs_of(spark, sf_dir, axis="row").select(*_OUT)


@query(_SMOOTH)
def build_costs(spark, sf_dir):
    """All arcs."""
    return arcs_of(spark, sf_dir).select(*_OUT)


_DEFO = f"""WITH {ARCS}, defo AS (SELECT axis, r, c, CASE WHEN w = 0 THEN 16000 ELSE greatest(-32768, least(32767, CAST(round_even(round(off, 9), 0) AS BIGINT))) END AS "offset",
CASE WHEN w = 0 THEN 32000 ELSE least(32767, greatest(1, CAST(trunc(round(var, 6)) AS BIGINT))) END AS sigsq, w FROM parts)
SELECT axis, r AS "row", c AS "col", CAST("offset" AS SMALLINT) AS "offset", CAST(sigsq AS SMALLINT) AS sigsq, CAST(CASE WHEN w = 0 THEN 32000 ELSE 240 END AS SMALLINT) AS dzmax,
CAST(CASE WHEN w = 0 THEN 0 ELSE least(32767, floor(sqrt(240 * sigsq))) END AS SMALLINT) AS laycost FROM defo"""


@query(_DEFO + " WHERE axis = 'col'")
def defo_cost_col(spark, sf_dir):
    """C4."""
    return arcs_of(spark, sf_dir, "defo", "col").select(*_OUT, "dzmax", "laycost")


@query(_DEFO + " WHERE axis = 'row'")
def defo_cost_row(spark, sf_dir):
    """C5, C7; "topo" is the same."""
    return arcs_of(spark, sf_dir, "topo", "row").select(*_OUT, "dzmax", "laycost")


FLOW = "((r + 2 * c) % 5 - 2)"


def _flowing(spark, sf_dir) -> DataFrame:
    return arcs_of(spark, sf_dir).withColumn("flow", (F.col("row") + 2 * F.col("col")) % 5 - 2)


@query(f"""WITH {ARCS}, i AS (SELECT {incr_sql(FLOW)} FROM arcs) SELECT axis, r AS "row", c AS "col", poscost, negcost FROM i""")
def incr_cost(spark, sf_dir):
    """C9, N8."""
    return costs.with_incremental(_flowing(spark, sf_dir)).select("axis", "row", "col", "poscost", "negcost")


@query(f"""WITH {ARCS}, z AS (SELECT axis, r, c, ({FLOW} * 200 + "offset") AS z, ({FLOW} * 200 + "offset" + 600) AS p, ({FLOW} * 200 + "offset" - 600) AS m, sigsq FROM arcs),
raw AS (SELECT axis, r, c, sigsq, p * p // sigsq - z * z // sigsq AS a, m * m // sigsq - z * z // sigsq AS b FROM z)
SELECT axis, r AS "row", c AS "col", CAST(CASE WHEN sigsq = 32000 THEN 0 ELSE greatest(-32000, least(32000, CASE WHEN a > 0 THEN ceil(a / 9.0) ELSE floor(a / 9.0) END)) END AS SMALLINT) AS poscost,
CAST(CASE WHEN sigsq = 32000 THEN 0 ELSE greatest(-32000, least(32000, CASE WHEN b > 0 THEN ceil(b / 9.0) ELSE floor(b / 9.0) END)) END AS SMALLINT) AS negcost FROM raw""")
def incr_cost_step3(spark, sf_dir):
    """C9 with steps of three units: divided by nine, away from zero."""
    return costs.with_incremental(_flowing(spark, sf_dir), step=3).select("axis", "row", "col", "poscost", "negcost")


@query(f"""WITH {ARCS}, i AS (SELECT {incr_sql(FLOW)} FROM arcs)
SELECT min(poscost) AS min_pos, min(negcost) AS min_neg, min(poscost) >= 0 AND min(negcost) >= 0 AS optimal FROM i""")
def early_exit(spark, sf_dir):
    """C10, N6."""
    return costs.early_exit(costs.with_incremental(_flowing(spark, sf_dir))).select("min_pos", "min_neg", "optimal")


@query(f"""WITH {ARCS}, i AS (SELECT {incr_sql('0')} FROM arcs)
SELECT axis, r AS "row", c AS "col", CAST(greatest(1, least(1000, least(poscost, negcost))) AS SMALLINT) AS weight FROM i""")
def init_weight(spark, sf_dir):
    """C11."""
    return arcs_of(spark, sf_dir).select("axis", "row", "col", costs.initial_weight().alias("weight"))


@query(f"""WITH {ARCS} SELECT CAST(sum(CASE WHEN sigsq = 32000 THEN 0 ELSE ({FLOW} * 200 + "offset") * ({FLOW} * 200 + "offset") // sigsq END) AS BIGINT) AS cost FROM arcs""")
def total_cost(spark, sf_dir):
    """C12."""
    return costs.total_cost(_flowing(spark, sf_dir)).select("cost")


@query(f"""WITH {ARCS}, i AS (SELECT {incr_sql('0')} FROM arcs)
SELECT CAST(sigsq AS SMALLINT) AS sigsq, CAST(sign(least(poscost, negcost)) AS INTEGER) AS gain, count(*) AS arcs FROM i GROUP BY ALL""")
def arc_reliability(spark, sf_dir):
    """Flagship: arcs by variance and by the sign of their cheaper unit step."""
    arcs = costs.with_incremental(arcs_of(spark, sf_dir), F.lit(0))
    gain = F.signum(F.least("poscost", "negcost")).cast("int").alias("gain")
    return arcs.groupBy("sigsq", gain).agg(F.count("*").alias("arcs"))


# ---------------------------------------------------------------- flows, integration


@query(f"""WITH {PX}, {ROW_AXIS}, {COL_AXIS}
SELECT a.r AS "row", a.c AS "col", CAST(round_even(a.d - q.d - b.d + p.d, 0) AS TINYINT) AS residue
FROM dc a JOIN dc b ON b.r = a.r + 1 AND b.c = a.c JOIN dr p ON p.r = a.r AND p.c = a.c JOIN dr q ON q.r = a.r AND q.c = a.c + 1""")
def residues(spark, sf_dir):
    """N1."""
    return flow.residues(raster(spark, sf_dir)).select("row", "col", "residue")


SEEDED = """
seeded AS (SELECT 'row' AS axis, r, c, -round_even((lead(unw) OVER w - unw - (lead(psi) OVER w - psi - 2 * pi() * round_even((lead(psi) OVER w - psi) / (2 * pi()), 0))) / (2 * pi()), 0) AS k FROM px WINDOW w AS (PARTITION BY c ORDER BY r) QUALIFY lead(r) OVER w IS NOT NULL
UNION ALL SELECT 'col', r, c, round_even((lead(unw) OVER w - unw - (lead(psi) OVER w - psi - 2 * pi() * round_even((lead(psi) OVER w - psi) / (2 * pi()), 0))) / (2 * pi()), 0) FROM px WINDOW w AS (PARTITION BY r ORDER BY c) QUALIFY lead(c) OVER w IS NOT NULL)"""


@query(f"""WITH {PX}, {SEEDED} SELECT axis, r AS "row", c AS "col", CAST(k AS SMALLINT) AS flow FROM seeded""")
def seeded_flow(spark, sf_dir):
    """N4."""
    return flow.seeded_flows(surface(spark, sf_dir)).select("axis", "row", "col", "flow")


@query(f"""WITH {PX}, s AS (SELECT r, c, psi, lag(psi) OVER w AS q, (r + 2 * c - 2) % 3 - 1 AS kc FROM px WINDOW w AS (PARTITION BY r ORDER BY c)),
f AS (SELECT r, psi, lag(psi) OVER (ORDER BY r) AS q, (r - 1) % 3 - 1 AS kr FROM px WHERE c = 0),
fb AS (SELECT r, sum(CASE WHEN q IS NULL THEN psi ELSE psi - q - 2 * pi() * round_even((psi - q) / (2 * pi()), 0) - 2 * pi() * kr END) OVER (ORDER BY r) AS b FROM f)
SELECT s.r AS "row", s.c AS "col", round(b + sum(CASE WHEN q IS NULL THEN 0 ELSE psi - q - 2 * pi() * round_even((psi - q) / (2 * pi()), 0) + 2 * pi() * kc END) OVER (PARTITION BY s.r ORDER BY s.c), 6) + 0.0 AS unw FROM s JOIN fb ON fb.r = s.r""")
def integrate(spark, sf_dir):
    """P1-P3 with given flows."""
    df = raster(spark, sf_dir).withColumns({"krow": (F.col("row") + 2 * F.col("col")) % 3 - 1, "kcol": (F.col("row") + 2 * F.col("col")) % 3 - 1})
    return flow.integrate(df).select("row", "col", r6("unw").alias("unw"))


@query(f"""WITH {PX} SELECT r AS "row", c AS "col", round(psi + 2 * pi() * round_even((unw - psi) / (2 * pi()), 0), 6) + 0.0 AS unw FROM px""")
def congruence(spark, sf_dir):
    """M10, L9."""
    return surface(spark, sf_dir).select("row", "col", r6(P.congruent("unw", "psi")).alias("unw"))


@query(f"""WITH {PX} SELECT r AS "row", c AS "col", round(unw - 2 * pi() * (SELECT round_even((unw - psi) / (2 * pi()), 0) FROM px WHERE r = 7 AND c = 50), 6) + 0.0 AS unw FROM px""")
def reference_shift(spark, sf_dir):
    """O1."""
    return seams.reference_shift(surface(spark, sf_dir), (7, 50)).select("row", "col", r6("unw").alias("unw"))


_EDGES = f"""{ARCS}, i AS (SELECT {incr_sql(FLOW)} FROM arcs), ends AS (SELECT axis, r, c, poscost, negcost,
CASE WHEN axis = 'row' THEN CASE WHEN c = 0 THEN (nr - 1) * 63 ELSE r * 63 + c - 1 END ELSE CASE WHEN r = 0 THEN (nr - 1) * 63 ELSE (r - 1) * 63 + c END END AS tail,
CASE WHEN axis = 'row' THEN CASE WHEN c = 63 THEN (nr - 1) * 63 ELSE r * 63 + c END ELSE CASE WHEN r = nr - 1 THEN (nr - 1) * 63 ELSE r * 63 + c END END AS head
FROM i, n WHERE NOT (axis = 'col' AND (r = 0 OR r = nr - 1) AND (c = 0 OR c = 62))),
e AS (SELECT tail AS src, head AS dst, CAST(poscost AS BIGINT) AS cost FROM ends UNION ALL SELECT head, tail, negcost FROM ends)"""


@query(f"""WITH {_EDGES}, d1 AS (SELECT dst AS node, least(0, min(cost)) AS d FROM e GROUP BY dst),
b AS (SELECT dst AS node, min(d + cost) AS x FROM e JOIN d1 ON d1.node = src GROUP BY dst)
SELECT d1.node, least(d, x) AS dist, x < d AS improved FROM d1 JOIN b USING (node)""")
def relaxation_rounds(spark, sf_dir):
    """Two Bellman-Ford rounds over the residue network."""
    shape = raster_shape(spark, sf_dir)
    # Written: each round reads the edges again.
    edges = written(flow.residual_edges(costs.with_incremental(_flowing(spark, sf_dir)), shape).select("scene", "src", "dst", "cost"))
    dist = flow.network_nodes(edges, shape)
    for _ in range(2):
        dist = flow.relax(edges, dist.select("scene", "node", "dist"))
    return dist.select("node", "dist", "improved")


# ---------------------------------------------------------------- components


_CELLS = f"""{PX}, cell AS (SELECT r * 64 + c AS id, r, c, unw, corr >= 0.35 AND mask AS valid FROM px),
edge AS (SELECT a.id AS p, b.id AS q FROM cell a JOIN cell b ON b.r = a.r AND b.c = a.c + 1 WHERE a.valid AND b.valid AND abs(a.unw - b.unw) < pi()
UNION ALL SELECT a.id, b.id FROM cell a JOIN cell b ON b.r = a.r + 1 AND b.c = a.c WHERE a.valid AND b.valid AND abs(a.unw - b.unw) < pi()),
adj AS MATERIALIZED (SELECT p, q FROM edge UNION ALL SELECT q, p FROM edge)"""
_CC = """cc(id, root) USING KEY (id) AS (SELECT id, id AS root FROM cell WHERE {valid} UNION
(SELECT k.id, min(f.root) AS root FROM cc f JOIN adj b ON b.p = f.id JOIN recurring.cc k ON k.id = b.q WHERE f.root < k.root GROUP BY k.id))"""


@query(f"""WITH RECURSIVE {_CELLS}, {_CC.format(valid='valid')}, big AS (SELECT root, row_number() OVER (ORDER BY root) AS k FROM cc, n GROUP BY root, nr HAVING count(*) >= greatest(1, trunc(0.0005 * nr * 64)) ORDER BY root LIMIT 32)
SELECT r AS "row", c AS "col", coalesce(k, 0) AS conncomp FROM cell LEFT JOIN cc USING (id) LEFT JOIN big USING (root)""")
def regrow_conncomp(spark, sf_dir):
    """A2, K1-K9: regrow, at most 32 components of at least 0.05 % of the pixels."""
    return components.regrow(surface(spark, sf_dir), raster_shape(spark, sf_dir), 0.35, 0.0005, 32).select("row", "col", "conncomp")


@query(f"""WITH RECURSIVE {ARCS}, i AS (SELECT {incr_sql(FLOW)} FROM arcs), ok AS (SELECT axis, r, c FROM i WHERE least(poscost, negcost) >= 20),
cell AS (SELECT r * 64 + c AS id, r, c, unw, corr >= 0.05 AND mask AS valid FROM px),
edge AS (SELECT a.id AS p, b.id AS q FROM cell a JOIN cell b ON b.r = a.r AND b.c = a.c + 1 JOIN ok ON ok.axis = 'col' AND ok.r = a.r AND ok.c = a.c WHERE a.valid AND b.valid AND abs(a.unw - b.unw) < pi()
UNION ALL SELECT a.id, b.id FROM cell a JOIN cell b ON b.r = a.r + 1 AND b.c = a.c JOIN ok ON ok.axis = 'row' AND ok.r = a.r AND ok.c = a.c WHERE a.valid AND b.valid AND abs(a.unw - b.unw) < pi()),
adj AS MATERIALIZED (SELECT p, q FROM edge UNION ALL SELECT q, p FROM edge), {_CC.format(valid='valid')},
big AS (SELECT root, row_number() OVER (ORDER BY root) AS k FROM cc, n GROUP BY root, nr HAVING count(*) >= greatest(1, floor(0.0005 * nr * 64)) ORDER BY root LIMIT 40)
SELECT r AS "row", c AS "col", coalesce(k, 0) AS conncomp FROM cell LEFT JOIN cc USING (id) LEFT JOIN big USING (root)""")
def conncomp_conf(spark, sf_dir):
    """K1-K9 with the incremental-cost test of the arcs."""
    arcs = costs.with_incremental(_flowing(spark, sf_dir))
    return components.confidence(surface(spark, sf_dir), raster_shape(spark, sf_dir), arcs, 20, 0.0005, 40).select("row", "col", "conncomp")


# ---------------------------------------------------------------- tiles

NT, OV = (3, 2), (9, 7)


@query("""SELECT a AS nrow, b AS ncol, greatest(1, round_even(a / edge, 0))::BIGINT AS tile_rows, greatest(1, round_even(b / edge, 0))::BIGINT AS tile_cols
FROM (SELECT a, b, greatest(a, b) / greatest(1, round_even(greatest(a, b) / 960.0, 0)) AS edge FROM (SELECT o_orderkey % 9000 + 1 AS a, o_custkey % 5000 + 1 AS b FROM orders))""")
def auto_tiles(spark, sf_dir):
    """Target 1024, overlap 64."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") % 9000 + 1).alias("nrow"), (F.col("o_custkey") % 5000 + 1).alias("ncol"))
    longest = F.greatest("nrow", "ncol")
    edge = longest / F.greatest(F.lit(1.0), F.rint(longest / 960.0))
    count = lambda x: F.greatest(F.lit(1.0), F.rint(F.col(x) / edge)).cast("long")
    return o.select("nrow", "ncol", count("nrow").alias("tile_rows"), count("ncol").alias("tile_cols"))


_GEO = f"""{PX}, ax AS (SELECT t, t * (nr - 9) // 3 AS a, CASE WHEN t = 2 THEN nr ELSE (t + 1) * (nr - 9) // 3 + 9 END AS b FROM range(3) x(t), n),
ay AS (SELECT t, t * 57 // 2 AS a, CASE WHEN t = 1 THEN 64 ELSE (t + 1) * 57 // 2 + 7 END AS b FROM range(2) y(t)),
tiles AS (SELECT ax.t AS tr, ay.t AS tc, ax.a AS r0, ay.a AS c0, ax.b AS r1, ay.b AS c1 FROM ax, ay),
tp AS (SELECT tr, tc, r, c, corr, mask, unw + 2 * pi() * (tr - 2 * tc) + CAST(0.001 AS DOUBLE) * ((r * 7 + c * 3 + tr + tc) % 11) AS unw, 1 + (r + c) % (2 + tr + tc) AS conncomp FROM px JOIN tiles ON r >= r0 AND r < r1 AND c >= c0 AND c < c1)"""


@query(f"""WITH {_GEO} SELECT CAST(tr AS INTEGER) AS tr, CAST(tc AS INTEGER) AS tc, CAST(r0 AS INTEGER) AS first_row, CAST(c0 AS INTEGER) AS first_col, CAST(r1 - r0 AS INTEGER) AS nrow, CAST(c1 - c0 AS INTEGER) AS ncol FROM tiles""")
def tile_geometry(spark, sf_dir):
    """T2."""
    return tiles.geometry(spark, raster_shape(spark, sf_dir), NT, OV)


def _tiled(spark, sf_dir) -> DataFrame:
    """Overlapping tiles that disagree by whole cycles and a little noise."""
    t = tiles.split(surface(spark, sf_dir), raster_shape(spark, sf_dir), NT, OV)
    noise = 0.001 * ((F.col("row") * 7 + F.col("col") * 3 + F.col("tr") + F.col("tc")) % 11)
    return t.withColumns({"unw": F.col("unw") + P.TWO_PI * (F.col("tr") - 2 * F.col("tc")) + noise, "conncomp": 1 + (F.col("row") + F.col("col")) % (2 + F.col("tr") + F.col("tc")), "conf": F.col("mask")})


@query(f"""WITH {_GEO} SELECT CAST(tr AS INTEGER) AS tr, CAST(tc AS INTEGER) AS tc, r AS "row", c AS "col" FROM tp""")
def tile_split(spark, sf_dir):
    """T3."""
    return tiles.split(raster(spark, sf_dir), raster_shape(spark, sf_dir), NT, OV).select("tr", "tc", "row", "col")


def _offset_sql(k: str) -> str:
    me = {"h": ("tc", "tr"), "v": ("tr", "tc")}[k]
    return f"""{k}p AS (SELECT b.tr, b.tc, a.unw - b.unw AS d, least(a.corr, b.corr) AS w FROM tp a JOIN tp b ON b.{me[0]} = a.{me[0]} + 1 AND b.{me[1]} = a.{me[1]} AND a.r = b.r AND a.c = b.c WHERE a.corr >= 0.05 AND a.mask),
{k}m AS (SELECT tr, tc, min(d) FILTER (acc >= tot / 2) AS m FROM (SELECT tr, tc, d, sum(w) OVER (PARTITION BY tr, tc ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS acc, sum(w) OVER (PARTITION BY tr, tc) AS tot FROM {k}p) GROUP BY tr, tc)"""


@query(f"""WITH {_GEO}, {_offset_sql('h')} SELECT CAST(tr AS INTEGER) AS tr, CAST(tc AS INTEGER) AS tc, round(m / (2 * pi()), 6) + 0.0 AS cycles FROM hm""")
def horiz_offset(spark, sf_dir):
    """Fractional."""
    t = tiles.neighbour_offsets(_tiled(spark, sf_dir), raster_shape(spark, sf_dir), NT, OV, "horizontal", True)
    return t.select("tr", "tc", r6("cycles").alias("cycles"))


@query(f"""WITH {_GEO}, {_offset_sql('v')} SELECT CAST(tr AS INTEGER) AS tr, CAST(tc AS INTEGER) AS tc, round(m / (2 * pi())) + 0.0 AS cycles FROM vm""")
def vert_offset(spark, sf_dir):
    """Rounded."""
    t = tiles.neighbour_offsets(_tiled(spark, sf_dir), raster_shape(spark, sf_dir), NT, OV, "vertical", False)
    return t.select("tr", "tc", (F.col("cycles") + 0.0).alias("cycles"))


_TILE_K = f"""{_GEO}, {_offset_sql('h')}, {_offset_sql('v')},
tk AS (SELECT t.tr, t.tc, (SELECT coalesce(sum(round(m / (2 * pi()))), 0) FROM hm WHERE hm.tr = 0 AND hm.tc <= t.tc) + (SELECT coalesce(sum(round(m / (2 * pi()))), 0) FROM vm WHERE vm.tc = t.tc AND vm.tr <= t.tr) AS k FROM tiles t)"""


def _offsets(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    t, shape = _tiled(spark, sf_dir), raster_shape(spark, sf_dir)
    sides = [tiles.neighbour_offsets(t, shape, NT, OV, axis, False) for axis in ("horizontal", "vertical")]
    return t, tiles.tile_offsets(*sides, t)


@query(f"""WITH {_TILE_K} SELECT CAST(tr AS INTEGER) AS tr, CAST(tc AS INTEGER) AS tc, k + 0.0 AS cycles FROM tk""")
def tile_offsets(spark, sf_dir):
    """T8."""
    return _offsets(spark, sf_dir)[1].select("tr", "tc", (F.col("cycles") + 0.0).alias("cycles"))


_LABEL_K = """lo AS (SELECT tr, tc, coalesce(sum(m) OVER (ORDER BY tr, tc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM (SELECT tr, tc, max(conncomp) AS m FROM tp GROUP BY tr, tc))"""


@query(f"""WITH {_GEO}, {_LABEL_K} SELECT CAST(tr AS INTEGER) AS tr, CAST(tc AS INTEGER) AS tc, CAST(o AS BIGINT) AS "offset" FROM lo""")
def label_offset(spark, sf_dir):
    """T11."""
    return tiles.label_offsets(_tiled(spark, sf_dir)).select("tr", "tc", F.col("offset").cast("long").alias("offset"))


@query(f"""WITH {_TILE_K}, {_LABEL_K} SELECT r AS "row", c AS "col", round(unw + 2 * pi() * k, 6) + 0.0 AS unw, CAST(conncomp + o AS BIGINT) AS conncomp
FROM tp JOIN tk USING (tr, tc) JOIN lo USING (tr, tc), n WHERE tr = CASE WHEN r >= 2 * (nr - 9) // 3 + 4 THEN 2 WHEN r >= (nr - 9) // 3 + 4 THEN 1 ELSE 0 END AND tc = CASE WHEN c >= 57 // 2 + 3 THEN 1 ELSE 0 END""")
def tile_merge(spark, sf_dir):
    """T9, T10."""
    t, offsets = _offsets(spark, sf_dir)
    out = tiles.merge(t, raster_shape(spark, sf_dir), NT, OV, offsets)
    return out.select("row", "col", r6("unw").alias("unw"), F.col("conncomp").cast("long").alias("conncomp"))


# ---------------------------------------------------------------- seams, spikes

SEAM = 31


def _profile_sql(src: str, p: str, line: str, across: str, place: str) -> str:
    """prof, med, near and filled of one seam of `src`, names prefixed by p."""
    return f"""
{p}prof AS (SELECT l.{line} AS line, CASE WHEN l.mask AND q.mask THEN l.unw - q.unw END AS diff FROM {src} l JOIN {src} q ON q.{line} = l.{line} AND q.{across} = {place} WHERE l.{across} = {place} - 1),
{p}med AS (SELECT line, CASE WHEN diff IS NOT NULL THEN (SELECT list_sort(list(q.diff))[count(q.diff) // 2 + 1] FROM {p}prof q WHERE q.line BETWEEN p.line - 10 AND p.line + 10 AND q.diff IS NOT NULL) END AS diff FROM {p}prof p),
{p}near AS (SELECT line, diff, last_value(CASE WHEN diff IS NOT NULL THEN line END IGNORE NULLS) OVER (ORDER BY line) AS a, last_value(diff IGNORE NULLS) OVER (ORDER BY line) AS x,
first_value(CASE WHEN diff IS NOT NULL THEN line END IGNORE NULLS) OVER (ORDER BY line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b, first_value(diff IGNORE NULLS) OVER (ORDER BY line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y FROM {p}med),
{p}filled AS (SELECT line, CASE WHEN diff IS NOT NULL THEN diff WHEN b - a <= 84 THEN x + (line - a) / CAST(b - a AS DOUBLE) * (y - x) WHEN line - a <= 42 THEN x * (1 - (line - a) / 42.0::DOUBLE) WHEN b - line <= 42 THEN y * (1 - (b - line) / 42.0::DOUBLE) END AS diff FROM {p}near)"""


def _apply_sql(src: str, p: str, line: str, across: str, place: str) -> str:
    return f"""{p}out AS (SELECT r, c, mask, CASE WHEN diff IS NOT NULL AND mask AND {across} >= {place} AND {across} < {place} + 20 THEN unw + diff * (1 - ({across} - {place}) / 20.0::DOUBLE) ELSE unw END AS unw FROM {src} JOIN {p}filled ON line = {line})"""


_SM = f"{PX}, sm AS (SELECT r, c, unw, mask AND (r % 170 < 60) AS mask FROM px)"
_PROFILE = f"{_SM}, {_profile_sql('sm', '', 'r', 'c', str(SEAM))}"
_MIDDLE = "((SELECT nr FROM n) - 8) // 2 + 4"


def _seam(spark, sf_dir) -> DataFrame:
    return surface(spark, sf_dir).withColumn("mask", F.col("mask") & (F.col("row") % 170 < 60))


@query(f"""WITH {_PROFILE} SELECT line, round(diff, 6) + 0.0 AS diff FROM med""")
def seam_profile(spark, sf_dir):
    """B1-B3."""
    return seams.moving_median(seams.seam_profile(_seam(spark, sf_dir), SEAM)).select("line", r6("diff").alias("diff"))


@query(f"""WITH {_PROFILE} SELECT line, round(diff, 6) + 0.0 AS diff FROM filled""")
def seam_fill(spark, sf_dir):
    """B4."""
    return seams.fill_gaps(seams.moving_median(seams.seam_profile(_seam(spark, sf_dir), SEAM))).select("line", r6("diff").alias("diff"))


@query(f"""WITH {_PROFILE}, {_apply_sql('sm', '', 'r', 'c', str(SEAM))} SELECT r AS "row", c AS "col", round(unw, 6) + 0.0 AS unw FROM out""")
def seam_apply(spark, sf_dir):
    """One column seam."""
    df = _seam(spark, sf_dir)
    out = seams.seam_apply(df, seams.fill_gaps(seams.moving_median(seams.seam_profile(df, SEAM))), SEAM, 20)
    return out.select("row", "col", r6("unw").alias("unw"))


@query(f"""WITH {_SM}, {_profile_sql('sm', 'c', 'r', 'c', '32')}, {_apply_sql('sm', 'c', 'r', 'c', '32')}, {_profile_sql('cout', 'r', 'c', 'r', f'({_MIDDLE})')}, {_apply_sql('cout', 'r', 'c', 'r', f'({_MIDDLE})')}
SELECT r AS "row", c AS "col", round(unw, 6) + 0.0 AS unw FROM rout""")
def neighbour_feedback(spark, sf_dir):
    """All seams of two by two tiles, in order."""
    out = seams.neighbour_feedback(_seam(spark, sf_dir), raster_shape(spark, sf_dir), (2, 2), (8, 8), 20)
    return out.select("row", "col", r6("unw").alias("unw"))



def _median_sql(src: str, name: str, line: str) -> str:
    return f"""{name} AS (SELECT {line} AS line, CASE WHEN count(*) FILTER (mask) > 20 THEN (list_sort(list(unw) FILTER (mask)))[count(*) FILTER (mask) // 2 + 1] END AS median FROM {src} GROUP BY {line})"""


def _spike_sql(lm: str, sp: str) -> str:
    return f"""{sp}(line, last, n) AS (SELECT line, median, CAST(0 AS DOUBLE) FROM {lm} WHERE line = 0 UNION ALL
SELECT line, here - 2 * pi() * n, n FROM (SELECT h.line, h.median AS here, CASE WHEN round((h.median - s.last) / (2 * pi())) <> 0 AND a.line IS NOT NULL AND round((h.median - s.last) / (2 * pi())) = round((h.median - a.median) / (2 * pi()))
AND abs(h.median - s.last - 2 * pi() * round((h.median - s.last) / (2 * pi()))) <= 0.5 AND abs(h.median - a.median - 2 * pi() * round((h.median - a.median) / (2 * pi()))) <= 0.5
THEN round((h.median - s.last) / (2 * pi())) ELSE CAST(0 AS DOUBLE) END AS n FROM {sp} s JOIN {lm} h ON h.line = s.line + 1 LEFT JOIN {lm} a ON a.line = h.line + 1))"""


_MED = _median_sql("px", "lm", "r")


@query(f"""WITH {PX}, {_MED} SELECT line, round(median, 6) + 0.0 AS median FROM lm""")
def line_medians(spark, sf_dir):
    """Z1."""
    return seams.line_medians(surface(spark, sf_dir)).select("line", r6("median").alias("median"))


_SPIKE = f"{PX}, {_MED}, {_spike_sql('lm', 'sp')}"


@query(f"""WITH RECURSIVE {_SPIKE} SELECT r AS "row", c AS "col", round(CASE WHEN mask THEN unw - 2 * pi() * n ELSE unw END, 6) + 0.0 AS unw FROM px JOIN sp ON line = r""")
def spike_rows(spark, sf_dir):
    """Z0, Z2 along rows."""
    return seams.fix_spikes_along(surface(spark, sf_dir)).select("row", "col", r6("unw").alias("unw"))


@query(f"""WITH RECURSIVE {_SPIKE}, u1 AS (SELECT r, c, mask, CASE WHEN mask THEN unw - 2 * pi() * n ELSE unw END AS unw FROM px JOIN sp ON line = r),
{_median_sql('u1', 'lm2', 'c')}, {_spike_sql('lm2', 'sp2')} SELECT r AS "row", c AS "col", round(CASE WHEN mask THEN unw - 2 * pi() * n ELSE unw END, 6) + 0.0 AS unw FROM u1 JOIN sp2 ON line = c""")
def fix_cycle_spikes(spark, sf_dir):
    """Z3: rows, then columns."""
    return seams.fix_cycle_spikes(surface(spark, sf_dir)).select("row", "col", r6("unw").alias("unw"))


# ---------------------------------------------------------------- bridging


_REGION = f"""{PX}, cell AS (SELECT r * 64 + c AS id, r, c, unw, label NOT IN (3, 5) AND (c < 38 OR c > 41) AS valid FROM px)"""


def _islands(spark, sf_dir) -> DataFrame:
    """Bands of rows and a gap of columns cut the raster into regions."""
    valid = ~F.col("label").isin(3, 5) & ((F.col("col") < 38) | (F.col("col") > 41))
    return surface(spark, sf_dir).withColumn("mask", valid)


@query(f"""WITH RECURSIVE {_REGION}, runs AS MATERIALIZED (SELECT r, c, min(id) OVER (PARTITION BY r, c - k) AS id FROM (SELECT id, r, c, row_number() OVER (PARTITION BY r ORDER BY c) AS k FROM cell WHERE valid)),
up AS (SELECT DISTINCT a.id AS p, b.id AS q FROM (SELECT id, r - 1 AS rr, c + d AS cc FROM runs CROSS JOIN (VALUES (-1), (0), (1)) t(d)) a JOIN runs b ON b.r = rr AND b.c = cc),
adj AS MATERIALIZED (SELECT p, q FROM up UNION SELECT q, p FROM up), node AS (SELECT DISTINCT id FROM runs),
{_CC.format(valid='true').replace('FROM cell', 'FROM node')},
k AS (SELECT root, row_number() OVER (ORDER BY root) AS k FROM cc JOIN runs USING (id) GROUP BY root HAVING count(*) >= 14)
SELECT cell.r AS "row", cell.c AS "col", coalesce(k, 0) AS label FROM cell LEFT JOIN runs ON runs.r = cell.r AND runs.c = cell.c LEFT JOIN cc ON cc.id = runs.id LEFT JOIN k USING (root)""")
def bridge_label(spark, sf_dir):
    """8-connected regions of at least 14 pixels."""
    return B.region_labels(_islands(spark, sf_dir), raster_shape(spark, sf_dir), 14).select("row", "col", "label")


_STRIPES = f"""{PX}, rg AS (SELECT r, c, unw, v, CAST(CASE WHEN mask AND c % 16 > (r // 40) % 5 THEN 1 + (r // 40) * 4 + c // 16 ELSE 0 END AS BIGINT) AS label FROM px),
lb AS (SELECT r, c, unw, v, label FROM rg)"""


def _stripes(spark, sf_dir) -> DataFrame:
    """Labels made by arithmetic: blocks of 40 rows by up to 15 columns."""
    label = F.when(F.col("mask") & (F.col("col") % 16 > F.floor(F.col("row") / 40) % 5), 1 + F.floor(F.col("row") / 40) * 4 + F.floor(F.col("col") / 16)).otherwise(0)
    return surface(spark, sf_dir).withColumn("label", label.cast("long")).select("scene", "row", "col", "unw", "v", "label")


def _erode_sql(size: int, circular: bool) -> str:
    offs = [(a, b) for a in range(-size, size + 1) for b in range(-size, size + 1) if not circular or a * a + b * b <= size * size]
    vals = ", ".join(f"({a}, {b})" for a, b in offs)
    return f"""se(a, b) AS (VALUES {vals}), alive AS (SELECT DISTINCT x.label FROM (SELECT p.r, p.c, p.label, count(*) AS k FROM (SELECT r, c, label, r + a AS rr, c + b AS cc FROM lb CROSS JOIN se WHERE label > 0) p JOIN lb q ON q.r = rr AND q.c = cc WHERE q.label > 0 GROUP BY ALL) x WHERE k = {len(offs)}),
nw AS (SELECT label, row_number() OVER (ORDER BY label) AS k FROM alive)"""


@query(f"""WITH {_STRIPES}, {_erode_sql(2, False)} SELECT r AS "row", c AS "col", coalesce(k, 0) AS label FROM lb LEFT JOIN nw USING (label)""")
def erode_prune(spark, sf_dir):
    """Square of half width 2."""
    return B.erode_prune(_stripes(spark, sf_dir).select("scene", "row", "col", "label"), raster_shape(spark, sf_dir), 2, False).select("row", "col", "label")


@query(f"""WITH {_STRIPES}, {_erode_sql(3, True)} SELECT r AS "row", c AS "col", coalesce(k, 0) AS label FROM lb LEFT JOIN nw USING (label)""")
def erode_prune_disc(spark, sf_dir):
    """Disc of radius 3."""
    return B.erode_prune(_stripes(spark, sf_dir).select("scene", "row", "col", "label"), raster_shape(spark, sf_dir), 3, True).select("row", "col", "label")


@query(f"""WITH {_STRIPES} SELECT label, count(*) AS n FROM lb WHERE label > 0 GROUP BY label ORDER BY n DESC, label LIMIT 1""")
def ref_region(spark, sf_dir):
    """R7."""
    return B.reference_region(_stripes(spark, sf_dir)).select("label", "n")


@query(f"""WITH {_STRIPES} SELECT label, round(sum(CAST(r AS DOUBLE) * r), 3) AS g_0_0, round(sum(CAST(r AS DOUBLE) * c), 3) AS g_0_1, round(sum(CAST(r AS DOUBLE)), 3) AS g_0_2, round(sum(CAST(c AS DOUBLE) * c), 3) AS g_1_1, round(sum(CAST(c AS DOUBLE)), 3) AS g_1_2,
round(sum(CAST(1 AS DOUBLE)), 3) AS g_2_2, round(sum(r * unw), 3) AS y_0, round(sum(c * unw), 3) AS y_1, round(sum(unw), 3) AS y_2 FROM lb WHERE label > 0 AND unw <> 0 GROUP BY label""")
def ramp_sums(spark, sf_dir):
    """Normal equations of a plane over each whole region."""
    own = _stripes(spark, sf_dir).where("label > 0").withColumn("scene", F.col("label").cast("string"))
    sums = B.ramp_sums(own, "linear")
    return sums.select(F.col("scene").cast("long").alias("label"), *[F.round(c, 3).alias(c) for c in sums.columns if c != "scene"])


@query(f"""WITH {_STRIPES} SELECT r AS "row", c AS "col", round(unw - (CAST(0.02 AS DOUBLE) * r + CAST(0.015 AS DOUBLE) * c + CAST(0.5 AS DOUBLE) * 1), 6) + 0.0 AS unw FROM lb""")
def ramp_apply(spark, sf_dir):
    """R9."""
    df = _stripes(spark, sf_dir).withColumn("_solid", F.col("unw") != 0)
    return B.apply_ramp(df, "linear", (0.02, 0.015, 0.5), -1.0).select("row", "col", r6("unw").alias("unw"))


_BOUND = """bd AS (SELECT p.r, p.c, p.label FROM lb p JOIN lb q ON q.r BETWEEN p.r - 1 AND p.r + 1 AND q.c BETWEEN p.c - 1 AND p.c + 1 WHERE p.label > 0 GROUP BY p.r, p.c, p.label HAVING min(q.label) <> max(q.label)),
pt AS (SELECT r, c, label, k // s AS i FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY r, c) - 1 AS k, greatest(1, count(*) OVER (PARTITION BY label) // 24) AS s FROM bd) WHERE k % s = 0 AND k // s < 24)"""


#: With the production cap, which is no cap for regions of this size.
_WHOLE_BOUND = _BOUND.replace("24", "4096")


@query(f"""WITH {_STRIPES}, {_BOUND} SELECT r AS "row", c AS "col", label FROM bd""")
def boundary(spark, sf_dir):
    """R10."""
    return B.boundary(_stripes(spark, sf_dir)).select("row", "col", "label")


@query(f"""WITH {_STRIPES}, {_BOUND} SELECT label, r AS "row", c AS "col", CAST(i AS INTEGER) AS local FROM pt""")
def boundary_sample(spark, sf_dir):
    """24 points a region."""
    return B.sample_boundary(B.boundary(_stripes(spark, sf_dir)), 24).select("label", "row", "col", "local")


@query(f"""WITH {_STRIPES}, {_WHOLE_BOUND}, pr AS (SELECT a.label AS li, b.label AS lj, CAST(floor(sqrt(CAST((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) AS DOUBLE)) * 64) AS BIGINT) AS q, a.i, b.i AS j, a.r AS y0, a.c AS x0, b.r AS y1, b.c AS x1 FROM pt a JOIN pt b ON a.label <> b.label),
m AS (SELECT li, lj, min({{'q': q, 'i': i, 'j': j, 'y0': y0, 'x0': x0, 'y1': y1, 'x1': x1}}) AS k FROM pr GROUP BY li, lj)
SELECT li, lj, k.q AS q, k.y0 AS y0, k.x0 AS x0, k.y1 AS y1, k.x1 AS x1 FROM m""")
def nn_pairs(spark, sf_dir):
    """Nearest points of each pair of regions."""
    points = B.sample_boundary(B.boundary(_stripes(spark, sf_dir)))
    return B.nearest_pairs(points).select("li", "lj", "q", "y0", "x0", "y1", "x1")


@query(f"""WITH {_STRIPES} SELECT label, y, x, round((list_sort(list(unw)))[count(*) // 2 + 1], 6) + 0.0 AS median FROM lb JOIN (SELECT DISTINCT label AS l, CAST((label - 1) // 4 * 40 + 20 AS INTEGER) AS y, CAST((label - 1) % 4 * 16 + 8 AS INTEGER) AS x FROM lb WHERE label > 0) e ON l = label
WHERE abs(r - y) <= 12 AND abs(c - x) <= 12 GROUP BY label, y, x""")
def region_median(spark, sf_dir):
    """The median of each region in a box of half width 12."""
    df = _stripes(spark, sf_dir)
    ends = df.where("label > 0").select("scene", "label").distinct()
    ends = ends.select("scene", "label", (F.floor((F.col("label") - 1) / 4) * 40 + 20).cast("int").alias("y"), ((F.col("label") - 1) % 4 * 16 + 8).cast("int").alias("x"))
    return B.region_medians(df, ends, 12).select("label", "y", "x", r6("median").alias("median"))


@query()
def bridge(spark, sf_dir):
    """Whole bridging; every value keeps its fraction of a cycle."""
    out = B.bridge(_islands(spark, sf_dir).select("scene", "row", "col", "unw", "mask"), raster_shape(spark, sf_dir), BridgeOptions(ramp_type="linear"))
    return out.select("row", "col", r6("unw").alias("unw"), F.col("conncomp").cast("long").alias("conncomp"))


@query(f"""WITH {_STRIPES}, {_WHOLE_BOUND} SELECT a.label AS a, b.label AS b, a.i, b.i AS j, CAST(floor(sqrt(CAST((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) AS DOUBLE)) * 64) AS BIGINT) AS q
FROM pt a JOIN pt b ON b.label = a.label + 1 AND a.i = b.i""")
def packed_keys(spark, sf_dir):
    """M9: ordering key of the points with the same number of two neighbouring regions."""
    p = B.sample_boundary(B.boundary(_stripes(spark, sf_dir))).select("label", "row", "col", "local")
    other = p.select((F.col("label") - 1).alias("label"), F.col("row").alias("y"), F.col("col").alias("x"), "local")
    k = P.packed_distance(F.col("y") - F.col("row"), F.col("x") - F.col("col"), "local", "local")
    return p.join(other, ["label", "local"]).select(F.col("label").alias("a"), (F.col("label") + 1).alias("b"), F.col("local").cast("long").alias("i"), F.col("local").cast("long").alias("j"), k["q"].alias("q"))


# ---------------------------------------------------------------- least squares, one step


_WEIGHTS = f"""{ARCS}, wr AS (SELECT r, c, CASE WHEN sigsq < 32000 THEN 1.0::DOUBLE / sigsq ELSE 0 END AS w FROM arcs WHERE axis = 'row'), wc AS (SELECT r, c, CASE WHEN sigsq < 32000 THEN 1.0::DOUBLE / sigsq ELSE 0 END AS w FROM arcs WHERE axis = 'col'),
g AS (SELECT a.r, a.c, a.r + 1 AS r2, a.c AS c2, w, b.psi - a.psi - 2 * pi() * round_even((b.psi - a.psi) / (2 * pi()), 0) AS d, b.unw - a.unw AS x FROM wr JOIN px a USING (r, c) JOIN px b ON b.r = a.r + 1 AND b.c = a.c
UNION ALL SELECT a.r, a.c, a.r, a.c + 1, w, b.psi - a.psi - 2 * pi() * round_even((b.psi - a.psi) / (2 * pi()), 0), b.unw - a.unw FROM wc JOIN px a USING (r, c) JOIN px b ON b.r = a.r AND b.c = a.c + 1)"""


def _steps(spark, sf_dir) -> DataFrame:
    """Each arc with its weight, wrapped step d and the step x of the surface."""
    df = surface(spark, sf_dir)
    arcs = arcs_of(spark, sf_dir).select("scene", "axis", "row", "col", P.arc_weight("sigsq").alias("w"))

    def one(axis: str, line: str) -> DataFrame:
        w = grid.along(line)
        return df.select("scene", F.lit(axis).alias("axis"), "row", "col", P.wrap_signed(F.lead("psi").over(w) - F.col("psi")).alias("d"), (F.lead("unw").over(w) - F.col("unw")).alias("x")).where("d is not null")

    return one("row", "col").unionByName(one("col", "row")).join(arcs, ["scene", "axis", "row", "col"])


def _scatter(steps: DataFrame, value: Column) -> DataFrame:
    """Minus the value at the arc's first pixel, plus at its second; and the diagonal."""
    second = F.struct((F.col("row") + F.when(F.col("axis") == "row", 1).otherwise(0)).alias("row"), (F.col("col") + F.when(F.col("axis") == "col", 1).otherwise(0)).alias("col"), value.alias("b"), F.col("w"))
    both = F.explode(F.array(F.struct("row", "col", (-value).alias("b"), "w"), second)).alias("e")
    return steps.select("scene", both).groupBy("scene", "e.row", "e.col").agg(F.sum("e.b").alias("b"), F.sum("e.w").alias("diagonal"))


@query(f"""WITH {_WEIGHTS} SELECT r AS "row", c AS "col", round(sum(b), 6) + 0.0 AS b, round(sum(w), 6) + 0.0 AS diagonal FROM (SELECT r, c, -w * d AS b, w FROM g UNION ALL SELECT r2, c2, w * d, w FROM g) GROUP BY r, c""")
def laplace_assemble(spark, sf_dir):
    """L1, L2, M6: right-hand side and diagonal."""
    return _scatter(_steps(spark, sf_dir), F.col("w") * F.col("d")).select("row", "col", r6("b").alias("b"), r6("diagonal").alias("diagonal"))


@query(f"""WITH {_WEIGHTS} SELECT r AS "row", c AS "col", round(sum(b), 6) + 0.0 AS y FROM (SELECT r, c, -w * x AS b FROM g UNION ALL SELECT r2, c2, w * x FROM g) GROUP BY r, c""")
def laplace_matvec(spark, sf_dir):
    """L3."""
    return _scatter(_steps(spark, sf_dir), F.col("w") * F.col("x")).select("row", "col", r6("b").alias("y"))


@query(f"""WITH {_WEIGHTS} SELECT r AS "row", c AS "col", r2 = r + 1 AS down, round(w / sqrt((x - d) * (x - d) + CAST(0.125 * 0.125 AS DOUBLE)), 6) + 0.0 AS w FROM g""")
def irls_reweight(spark, sf_dir):
    """Third reweighting, delta 0.125."""
    e = F.col("x") - F.col("d")
    return _steps(spark, sf_dir).select("row", "col", (F.col("axis") == "row").alias("down"), r6(F.col("w") / F.sqrt(e * e + 0.125 * 0.125)).alias("w"))


@query(f"""WITH {PX} SELECT round(sum(unw * psi), 3) AS product, round(sum(psi * psi), 3) AS norm, round(sum(psi + CAST(0.5 AS DOUBLE) * unw), 3) AS combined FROM px""")
def vector_products(spark, sf_dir):
    """Dot products and a scaled sum."""
    u, p = F.col("unw"), F.col("psi")
    return surface(spark, sf_dir).agg(F.round(F.sum(u * p), 3).alias("product"), F.round(F.sum(p * p), 3).alias("norm"), F.round(F.sum(p + 0.5 * u), 3).alias("combined"))


# ---------------------------------------------------------------- solvers and whole plans


#: A surface with steps under half a cycle, and blocks of two by three pixels where the phase is noise and the mask is off.
TRUE = """t AS (
  SELECT r, c, NOT (r % 11 IN (4, 5) AND c % 9 IN (3, 4, 5)) AS valid, CAST(0.1 AS DOUBLE) * r + CAST(0.2 AS DOUBLE) * c + 2 * v AS u FROM px
), k AS (SELECT r, c, valid, CAST(floor(u / (2 * pi())) AS BIGINT) AS k FROM t)"""


def known(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[int, int]]:
    """That surface's interferogram: what a solver must give back on valid pixels is known, although there are residues."""
    df = embedding_raster(spark, sf_dir)
    valid = ~((F.col("row") % 11).isin(4, 5) & (F.col("col") % 9).isin(3, 4, 5))
    u = 0.1 * F.col("row") + 0.2 * F.col("col") + F.when(valid, 2 * F.col("v")).otherwise(60 * F.col("v"))
    df = df.select("scene", "row", "col", F.cos(u).cast("float").alias("re"), F.sin(u).cast("float").alias("im"), F.lit(0.9).cast("float").alias("corr"), valid.alias("mask"))
    return df, raster_shape(spark, sf_dir)


@query(f"""WITH {PX}, {TRUE} SELECT k.r AS "row", k.c AS "col", CASE WHEN k.valid THEN k.k - o.k END AS cycles FROM k JOIN k o ON o.r = k.r // 125 * 125 AND o.c = 0""")
def laplace_tiles(spark, sf_dir):
    """Tiles of 125 lines; whole cycles of each valid pixel over the tile's first."""
    df, shape = known(spark, sf_dir)
    df = df.withColumn("psi", P.wrapped_phase("re", "im"))
    from phasegrid.plans.unwrap import _with_arc_costs

    parts = _with_arc_costs(df, costs.build_costs(df, shape, NLOOKS)).withColumns({"tr": F.floor(F.col("row") / 125).cast("int"), "tc": F.lit(0)})
    out = solve_tiles(parts, "laplace", CostModel(), LaplaceOptions()).join(df.select("scene", "row", "col", "psi", "mask"), ["scene", "row", "col"])
    return out.select("row", "col", F.when(F.col("mask"), F.rint((F.col("unw") - F.col("psi")) / P.TWO_PI).cast("long")).alias("cycles"))


def _small_arcs(spark, sf_dir) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    """The raster cut into scenes of 25 rows: each is solved by one task."""
    df, shape = raster(spark, sf_dir), raster_shape(spark, sf_dir)
    df = df.withColumns({"scene": F.concat(F.lit("band"), F.floor(F.col("row") / 25).cast("string")), "row": F.col("row") % 25})
    return df, costs.build_costs(df, (25, shape[1]), NLOOKS), (25, shape[1])


@query(f"""WITH {PX} SELECT 'band' || (r // 25) AS scene, true AS feasible, true AS cheaper, true AS no_pixel_to_move FROM px GROUP BY ALL""")
def refine_flow(spark, sf_dir):
    """From an integrated start to flows that clear the residues, cost less, and that moving no pixel by a cycle makes cheaper."""
    df, arcs, shape = _small_arcs(spark, sf_dir)
    zero = df.withColumns({"krow": F.lit(0), "kcol": F.lit(0)})
    start = flow.seeded_flows(flow.integrate(zero))
    seeded = arcs.join(start, ["scene", "axis", "row", "col"])
    better = refine_flows(seeded, shape)
    before = costs.total_cost(seeded).withColumnRenamed("cost", "before")
    judged = arcs.join(better, ["scene", "axis", "row", "col"])
    after = costs.total_cost(judged)
    wide = flow.arc_flows_wide(better)
    down, across = grid.along("col"), grid.along("row")
    curl = F.col("kcol") - F.lead("krow").over(across) - F.lead("kcol").over(down) + F.col("krow")
    loops = wide.withColumn("curl", curl).join(flow.residues(df), ["scene", "row", "col"])
    sound = loops.groupBy("scene").agg((F.max(F.abs(F.col("curl") + F.col("residue"))) == 0).alias("feasible"))
    # A pixel that moves up by a cycle lowers the flow of the column arc after it and raises that of the row arc.
    steps = costs.with_incremental(judged)
    col, pos, neg = F.col("axis") == "col", F.col("poscost").cast("long"), F.col("negcost").cast("long")
    first = steps.select("scene", "row", "col", F.when(col, neg).otherwise(pos).alias("up"), F.when(col, pos).otherwise(neg).alias("down"))
    last = steps.select("scene", F.when(col, F.col("row")).otherwise(F.col("row") + 1).alias("row"), F.when(col, F.col("col") + 1).otherwise(F.col("col")).alias("col"), F.when(col, pos).otherwise(neg).alias("up"), F.when(col, neg).otherwise(pos).alias("down"))
    moved = first.union(last).groupBy("scene", "row", "col").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    still = moved.groupBy("scene").agg((F.min(F.least("up", "down")) >= 0).alias("no_pixel_to_move"))
    return before.join(after, "scene").join(sound, "scene").join(still, "scene").select("scene", "feasible", (F.col("cost") < F.col("before")).alias("cheaper"), "no_pixel_to_move")


def _whole(spark, sf_dir, **options) -> DataFrame:
    """Whole cycles of valid pixels over the reference pixel; labels of the others."""
    df, shape = known(spark, sf_dir)
    out = unwrap(df, shape, UnwrapOptions(10.0, **options))
    out = out.join(df.select("row", "col", P.wrapped_phase("re", "im").alias("psi"), "mask"), ["row", "col"])
    cycles = F.rint((F.col("unw").cast("double") - F.col("psi")) / P.TWO_PI).cast("long")
    return out.select("row", "col", F.when(F.col("mask"), cycles).alias("cycles"), F.when(F.col("mask"), F.col("conncomp") > 0).otherwise(F.col("conncomp") != 0).alias("labelled"))


_WHOLE = f"""WITH {PX}, {TRUE} SELECT k.r AS "row", k.c AS "col", CASE WHEN k.valid THEN k.k - o.k END AS cycles, k.valid AS labelled FROM k JOIN k o ON o.r = 0 AND o.c = 0"""


@query(_WHOLE)
def unwrap_mcf(spark, sf_dir):
    """Network flow in tiles."""
    shape = raster_shape(spark, sf_dir)
    return _whole(spark, sf_dir, init="mcf", ntiles=(max(1, shape[0] // 100), 1), tile_overlap=8, min_conncomp_frac=0.001)


@query(_WHOLE)
def unwrap_mst(spark, sf_dir):
    """Spanning-tree start."""
    shape = raster_shape(spark, sf_dir)
    return _whole(spark, sf_dir, init="mst", ntiles=(max(1, shape[0] // 100), 1), tile_overlap=8, min_conncomp_frac=0.001)


@query(_WHOLE)
def unwrap_defo(spark, sf_dir):
    """Deformation costs, solved with their own shelf."""
    shape = raster_shape(spark, sf_dir)
    return _whole(spark, sf_dir, cost="defo", init="mcf", ntiles=(max(1, shape[0] // 100), 1), tile_overlap=8, min_conncomp_frac=0.001)


@query(_WHOLE)
def unwrap_laplace(spark, sf_dir):
    """Least squares in tiles, padded mask."""
    shape = raster_shape(spark, sf_dir)
    return _whole(spark, sf_dir, init="laplace", ntiles=(max(1, shape[0] // 125), 1), tile_overlap=16, mask_pad_distance=2, min_conncomp_frac=0.001)


@query(f"""WITH {PX} SELECT r AS "row", c AS "col", round(psi, 4) + 0.0 AS psi FROM (SELECT r, c, CAST(psi AS FLOAT)::DOUBLE AS psi FROM px)""")
def block_round_trip(spark, sf_dir):
    """Long form to tiles of 64 x 32 and back."""
    df = from_blocks(to_blocks(raster(spark, sf_dir), (64, 32), "psi"), "psi")
    return df.select("row", "col", (F.round(F.col("psi").cast("double"), 4) + 0.0).alias("psi"))

