"""The query catalog: each entry is a Spark query over (spark, sf_dir) and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.functions import masks, pixel
from pairloom.operators import geometry, quality, radiometry, sar, stats, tiles
from pairloom.plans import virtual as v
from pairloom.plans.virtual import table
from pairloom.sensors import catalog as sensors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c, n: int = 6):
    return F.round(c, n)


ND = "CASE WHEN {a} + {b} <> 0 THEN ({a} - {b}) / ({a} + {b}) END"


def nd(a: str, b: str) -> str:
    return ND.format(a=a, b=b)


@query(f"SELECT l_orderkey, l_linenumber, round({nd('green', 'swir')}, 6) AS ndsi, round({nd('green', 'nir')}, 6) AS ndwi, round({nd('nir', 'red')}, 6) AS ndvi FROM {v.LI}")
def spectral_indices(spark, sf):
    c = F.col
    return v.li(spark, sf).select("l_orderkey", "l_linenumber", r6(pixel.ndsi(c("green"), c("swir"))).alias("ndsi"), r6(pixel.ndwi(c("green"), c("nir"))).alias("ndwi"), r6(pixel.normalized_difference(c("nir"), c("red"))).alias("ndvi"))


@query("""SELECT l_partkey % 12 AS scl, l_partkey % 12 IN (0, 1) AS nodata, l_partkey % 12 = 3 AS shadow, l_partkey % 12 = 6 AS water, l_partkey % 12 IN (8, 9, 10) AS cloud,
 l_partkey % 12 = 11 AS snow, count(*) AS n FROM lineitem GROUP BY ALL""")
def scl_decode(spark, sf):
    s = F.col("l_partkey") % 12
    cols = {"scl": s} | masks.decode_scl(s)
    return table(spark, sf, "lineitem").select(*[x.alias(k) for k, x in cols.items()]).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT q AS qa, (q & 14) <> 0 AS cloud, (q & 16) <> 0 AS shadow, (q & 32) <> 0 AS snow, (q & 128) <> 0 AS water, (q & 1) <> 0 AS nodata, count(*) AS n
 FROM (SELECT l_partkey % 256 AS q FROM lineitem) GROUP BY ALL""")
def qa_decode(spark, sf):
    q = F.col("l_partkey") % 256
    cols = {"qa": q} | masks.decode_qa_pixel(q)
    return table(spark, sf, "lineitem").select(*[x.alias(k) for k, x in cols.items()]).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


CLOUD = "(blue > 0.3 AND (blue + red + nir) / 3 > 0.35 AND (red - swir) / CASE WHEN red + swir = 0 THEN 1 ELSE red + swir END < 0.8)"
SNOW = f"coalesce({nd('green', 'swir')} > 0.4 AND green > 0.1 AND nir > 0.11, false)"
WATER = f"(coalesce({nd('green', 'nir')} > 0, false) OR coalesce({nd('green', 'swir')} > 0, false))"


def _cloud():
    c = F.col
    return masks.clouds_spectral(c("blue"), c("red"), c("nir"), c("swir"))


@query(f"SELECT l_orderkey, l_linenumber, {CLOUD} AS cloud, {CLOUD} OR nir > 0.012 * 80 AS cloud_or_cirrus FROM {v.LI}")
def cloud_spectral(spark, sf):
    c = F.col
    return v.li(spark, sf).select("l_orderkey", "l_linenumber", _cloud().alias("cloud"), masks.clouds_spectral(c("blue"), c("red"), c("nir"), c("swir"), c("nir") / 80).alias("cloud_or_cirrus"))


@query(f"SELECT l_orderkey, l_linenumber, {SNOW} AS snow FROM {v.LI}")
def snow_mask(spark, sf):
    return v.li(spark, sf).select("l_orderkey", "l_linenumber", masks.detect_snow(F.col("green"), F.col("swir"), F.col("nir")).alias("snow"))


@query(f"SELECT l_orderkey, l_linenumber, {WATER} AS water FROM {v.LI}")
def water_mask(spark, sf):
    return v.li(spark, sf).select("l_orderkey", "l_linenumber", masks.detect_water(F.col("green"), F.col("nir"), F.col("swir")).alias("water"))


@query(f"SELECT l_orderkey, l_linenumber, red = 0 OR nir = 0 AS any_band, red = 0 AND nir = 0 AS all_bands FROM {v.LI}")
def nodata_any_all(spark, sf):
    b = F.array("red", "nir")
    return v.li(spark, sf).select("l_orderkey", "l_linenumber", masks.detect_nodata(b, 0.0).alias("any_band"), masks.detect_nodata(b, 0.0, True).alias("all_bands"))


@query(f"SELECT l_orderkey, l_linenumber, blue >= 0.98 OR green >= 0.98 AS saturated FROM {v.LI}")
def saturation(spark, sf):
    return v.li(spark, sf).select("l_orderkey", "l_linenumber", masks.detect_saturation(F.array("blue", "green"), level=0.98).alias("saturated"))


@query(f"""SELECT code, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM (SELECT CASE WHEN green >= 0.999 THEN 5 WHEN {CLOUD} THEN 1
 WHEN {SNOW} THEN 3 WHEN {WATER} THEN 4 ELSE 0 END::TINYINT AS code FROM {v.LI}) GROUP BY code""")
def validity_mask_fractions(spark, sf):
    c = F.col
    code = masks.validity_code(cloud=_cloud(), snow=masks.detect_snow(c("green"), c("swir"), c("nir")), water=masks.detect_water(c("green"), c("nir"), c("swir")), nodata=masks.detect_saturation(F.array("green"), level=0.999))
    n = v.li(spark, sf).select(code.alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))  # a row a class
    return n.withColumn("fraction", r6(F.col("n") / F.sum("n").over(Window.partitionBy())))


@query("""SELECT l_orderkey, l_linenumber, round(10 * log10(greatest(l_discount, 1e-10)), 6) AS db, round(pow(10, l_quantity / 10 / 10), 4) AS linear
 FROM lineitem""")
def to_db_from_db(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(pixel.to_db(F.col("l_discount"))).alias("db"), r6(pixel.from_db(F.col("l_quantity") / 10), 4).alias("linear"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount <> 0 THEN l_discount * l_discount / ((1 + l_tax) * (1 + l_tax)) END, 9) AS sigma0 FROM lineitem""")
def sigma0(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(pixel.sigma0(F.col("l_discount"), 1 + F.col("l_tax")), 9).alias("sigma0"))


@query(f"""SELECT l_orderkey, l_linenumber, round(least(greatest(green, lo), hi), 6) AS clipped FROM {v.LI},
 (SELECT quantile_cont(green, 0.02) AS lo, quantile_cont(green, 0.98) AS hi FROM {v.LI})""")
def percentile_clip(spark, sf):
    return sar.percentile_clip(v.li(spark, sf), "green").select("l_orderkey", "l_linenumber", r6(F.col("green")).alias("clipped"))


@query(f"""SELECT "row", "col", trunc((least(greatest(v, lo), hi) - lo) / (hi - lo) * 255)::INT AS gray FROM {v.EMB},
 (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM {v.EMB})""")
def uint8_stretch(spark, sf):
    return sar.stretched(v.emb(spark, sf), "v").select("row", "col", F.col("v").alias("gray"))


@query("""SELECT (i * 4 + j)::INT AS tile_index, greatest(i * 1024 - 64, 0)::INT AS row_off, greatest(j * 1024 - 64, 0)::INT AS col_off,
 (least((i + 1) * 1024 + 64, 5000) - greatest(i * 1024 - 64, 0))::INT AS height, (least((j + 1) * 1024 + 64, 4000) - greatest(j * 1024 - 64, 0))::INT AS width
 FROM range(5) a(i), range(4) b(j)""")
def tile_grid(spark, sf):
    return tiles.tile_grid(spark, 5000, 4000, 1024, 64)


@query(f"""SELECT ("row" // 64)::INT AS tile_index, count(*) AS n, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS var, round(min(v), 6) AS lo, round(max(v), 6) AS hi FROM {v.EMB} GROUP BY 1""")
def tile_stats(spark, sf):
    x = v.emb(spark, sf).withColumn("tile_index", tiles.tile_of(F.col("row"), F.col("col"), 64, 64))
    return x.groupBy("tile_index").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("v")).alias("mean"), r6(F.var_pop("v")).alias("var"), r6(F.min("v")).alias("lo"), r6(F.max("v")).alias("hi"))


LAP = f"""(SELECT "row", "col", lag(v) OVER a + lead(v) OVER a + lag(v) OVER b + lead(v) OVER b - 4 * v AS lap FROM {v.EMB} WINDOW a AS (PARTITION BY "row" ORDER BY "col"), b AS (PARTITION BY "col" ORDER BY "row"))"""


@query(f"SELECT round(var_pop(lap), 6) AS blur, count(*) AS n FROM {LAP} WHERE lap IS NOT NULL")
def laplacian_variance(spark, sf):
    return stats.laplacian(v.emb(spark, sf)).agg(r6(F.var_pop("lap")).alias("blur"), F.count(F.lit(1)).alias("n"))


TILE_CLOUD = f"""(SELECT t AS tile_index, avg(CASE WHEN hi <= lo THEN 0 WHEN v > lo + 0.85 * (hi - lo) THEN 1 ELSE 0 END) AS cloud FROM
 (SELECT "row" // 64 AS t, v, quantile_cont(v, 0.01) OVER (PARTITION BY "row" // 64) AS lo, quantile_cont(v, 0.99) OVER (PARTITION BY "row" // 64) AS hi FROM {v.EMB}) GROUP BY 1)"""


@query(f"SELECT tile_index::INT AS tile_index, round(cloud, 6) AS cloud FROM {TILE_CLOUD}")
def cloud_fraction_estimate(spark, sf):
    x = v.emb(spark, sf).withColumn("tile_index", tiles.tile_of(F.col("row"), F.col("col"), 64, 64))
    return stats.cloud_fraction(x, ["tile_index"]).select("tile_index", r6(F.col("cloud")).alias("cloud"))


@query(f"""WITH lap AS (SELECT r // 64 AS t, var_pop(lap) AS blur FROM (SELECT "row" AS r, "row" // 64 AS t0, lag(v) OVER a + lead(v) OVER a + lag(v) OVER b + lead(v) OVER b - 4 * v AS lap FROM {v.EMB}
 WINDOW a AS (PARTITION BY "row" ORDER BY "col"), b AS (PARTITION BY "row" // 64, "col" ORDER BY "row")) WHERE lap IS NOT NULL GROUP BY 1),
 s AS (SELECT avg((abs(v) < 0.001)::INT) AS nodata, avg((v >= 0.3)::INT) AS saturated FROM {v.EMB}),
 q AS (SELECT (SELECT quantile_cont(blur, 0.5) FROM lap) AS blur, (SELECT avg(cloud) FROM {TILE_CLOUD}) AS cloud, nodata, saturated FROM s)
 SELECT round(nodata, 6) AS nodata_fraction, round(saturated, 6) AS saturated_fraction, round(blur, 6) AS blur, round(cloud, 6) AS cloud_fraction,
 round(100 - CASE WHEN saturated > 0.05 THEN least(20, 200 * saturated) ELSE 0 END - CASE WHEN nodata > 0.3 THEN least(25, 50 * nodata) ELSE 0 END
 - CASE WHEN blur < 1 THEN 15 ELSE 0 END - CASE WHEN cloud > 0.5 THEN least(20, 30 * cloud) ELSE 0 END, 4) AS score FROM q""")
def quality_score(spark, sf):
    x = v.emb(spark, sf).withColumn("scene_id", F.lit("s")).withColumn("tile_index", tiles.tile_of(F.col("row"), F.col("col"), 64, 64))
    x = x.withColumn("nodata", F.abs("v") < 0.001).withColumn("saturated", F.col("v") >= 0.3)
    got = quality.assess(x)
    return got.select(*[r6(F.col(c)).alias(c) for c in ("nodata_fraction", "saturated_fraction", "blur", "cloud_fraction")], r6(F.col("score"), 4).alias("score"))


HIST = "least(floor((v - ({lo})) / (({hi}) - ({lo})) * {n}), {n} - 1)::INT"


@query(f"SELECT {HIST.format(lo=-0.3, hi=0.3, n=32)} AS bin, count(*) AS n FROM {v.EMB} WHERE v BETWEEN -0.3 AND 0.3 GROUP BY 1")
def histogram(spark, sf):
    return stats.histogram(v.emb(spark, sf), F.col("v"), -0.3, 0.3, 32)


@query(f"""SELECT bin, n, sum(n) OVER (ORDER BY bin)::BIGINT AS cum, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 6) AS share FROM
 (SELECT {HIST.format(lo=0, hi=105000, n=64)} AS bin, count(*) AS n FROM (SELECT l_extendedprice AS v FROM lineitem) WHERE v BETWEEN 0 AND 105000 GROUP BY 1)""")
def cdf_lut(spark, sf):
    h = stats.histogram(table(spark, sf, "lineitem"), F.col("l_extendedprice"), 0, 105000, 64)  # 64 rows
    return stats.cdf(h).select("bin", "n", "cum", r6(F.col("cum") / F.sum("n").over(Window.partitionBy())).alias("share"))


SUMS = ", ".join(["count(*)::DOUBLE AS w", *(f"round(avg({x}), 4) AS mean_{x}" for x in ("r1", "r2", "m1", "m2")), *(f"round(covar_pop({x}, {y}) / 1000, 3) AS cov_{x}_{y}" for x, y in (("r1", "r1"), ("r1", "m1"), ("r2", "m2"), ("m1", "m2")))])


@query(f"SELECT {SUMS} FROM {v.PAIR}")
def weighted_moments(spark, sf):
    p = v.pair(spark, sf)
    b = {"r1": F.col("ref")[0], "r2": F.col("ref")[1], "m1": F.col("mov")[0], "m2": F.col("mov")[1]}
    sums, names = p.agg(*stats.moment_columns(list(b.values()))), list(b)

    def cov(x, y):
        i, j = sorted((names.index(x), names.index(y)))
        return F.col(f"s{i}_{j}") / F.col("w") - F.col(f"s{i}") / F.col("w") * (F.col(f"s{j}") / F.col("w"))

    pairs = (("r1", "r1"), ("r1", "m1"), ("r2", "m2"), ("m1", "m2"))
    return sums.select("w", *[r6(F.col(f"s{i}") / F.col("w"), 4).alias(f"mean_{x}") for i, x in enumerate(names)], *[r6(cov(x, y) / 1000, 3).alias(f"cov_{x}_{y}") for x, y in pairs])


CHANGE = "(abs(r1 - m1) / CASE WHEN abs(r1) + abs(m1) = 0 THEN 1 ELSE abs(r1) + abs(m1) END + abs(r2 - m2) / CASE WHEN abs(r2) + abs(m2) = 0 THEN 1 ELSE abs(r2) + abs(m2) END) / 2"
PIF = f"""(SELECT * FROM (SELECT *, {CHANGE} AS change, (r1 + r2) / 2 AS bright FROM {v.PAIR}), (SELECT quantile_cont({CHANGE}, 0.2) AS c, quantile_cont((r1 + r2) / 2, 0.3) AS b FROM {v.PAIR}))"""


@query(f"SELECT count(*) AS n, round(avg(r1), 3) AS mean_r1, round(avg(m1), 3) AS mean_m1 FROM {PIF} WHERE change <= c AND bright >= b")
def pif_select(spark, sf):
    p = radiometry.select_pifs(v.pair(spark, sf)).filter("pif")
    return p.agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("ref")[0]), 3).alias("mean_r1"), r6(F.avg(F.col("mov")[0]), 3).alias("mean_m1"))


@query(f"SELECT round(regr_slope(r1, m1), 6) AS gain1, round(regr_intercept(r1, m1), 3) AS offset1, round(regr_slope(r2, m2), 6) AS gain2, round(regr_intercept(r2, m2), 4) AS offset2 FROM {v.PAIR}")
def ols_gain_offset(spark, sf):
    p, cols = v.pair(spark, sf), []
    for k, digits in ((0, 3), (1, 4)):
        g, o = stats.ols(F.col("ref")[k], F.col("mov")[k])
        cols += [r6(g).alias(f"gain{k + 1}"), r6(o, digits).alias(f"offset{k + 1}")]
    return p.agg(*cols)


@query(f"""WITH p AS (SELECT r1 AS y, m1 AS x FROM {PIF} WHERE change <= c AND bright >= b),
 f1 AS (SELECT regr_slope(y, x) AS g, regr_intercept(y, x) AS o FROM p), s1 AS (SELECT p.*, y - (x * g + o) AS e FROM p, f1), p1 AS (SELECT x, y FROM s1, (SELECT stddev_pop(e) AS s FROM s1) WHERE abs(e) <= 2.5 * s),
 f2 AS (SELECT regr_slope(y, x) AS g, regr_intercept(y, x) AS o FROM p1), s2 AS (SELECT p1.*, y - (x * g + o) AS e FROM p1, f2), p2 AS (SELECT x, y FROM s2, (SELECT stddev_pop(e) AS s FROM s2) WHERE abs(e) <= 2.5 * s)
 SELECT 1 AS band, round(regr_slope(y, x), 6) AS gain, round(regr_intercept(y, x), 3) AS "offset", round(regr_r2(y, x), 6) AS r2 FROM p2""")
def pif_trimmed_fit(spark, sf):
    fit = radiometry.fit_pif_linear(radiometry.select_pifs(v.pair(spark, sf)))
    return spark.createDataFrame([(1, round(fit.gains[0], 6), round(fit.offsets[0], 3), round(fit.r2[0], 6))], "band int, gain double, offset double, r2 double")


@query(f"""SELECT round(sum(w), 3) AS w, round(sum(w * r1) / sum(w), 3) AS mean_r1, round(sum(w * m1) / sum(w), 3) AS mean_m1 FROM (SELECT *, exp(-((r1 - m1) / 5000 * ((r1 - m1) / 5000) + (r2 - m2) * (r2 - m2)) / 2) AS w FROM {v.PAIR})""")
def irmad_step_moments(spark, sf):
    r, m = F.col("ref"), F.col("mov")
    d1, d2 = (r[0] - m[0]) / 5000, r[1] - m[1]
    w = pixel.chi2_sf(d1 * d1 + d2 * d2, 2)
    row = v.pair(spark, sf).agg(*stats.moment_columns([r[0], m[0]], w))
    return row.select(r6(F.col("w"), 3).alias("w"), r6(F.col("s0") / F.col("w"), 3).alias("mean_r1"), r6(F.col("s1") / F.col("w"), 3).alias("mean_m1"))


@query()
def irmad_full(spark, sf):
    m = radiometry.irmad(v.pair(spark, sf))
    rows = [(k + 1, float(m.fit.gains[k]), float(m.fit.offsets[k]), float(m.rho[k]), m.iterations, m.converged) for k in range(2)]
    return spark.createDataFrame(rows, "band int, gain double, offset double, rho double, iterations int, converged boolean")


@query()
def histogram_match(spark, sf):
    out, _ = radiometry.match_histograms(v.pair(spark, sf))
    return out.agg(*[r6(f(F.col("mov")[k]), 3).alias(f"{n}{k + 1}") for k in range(2) for n, f in (("mean", F.avg), ("sd", F.stddev_pop), ("lo", F.min), ("hi", F.max))])


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 AND abs(date_diff('day', DATE '1995-01-01', o_orderdate::DATE)) <= 30 THEN 'histogram'
 WHEN o_orderkey % 4 + 1 >= 2 AND o_totalprice >= 1000 * (o_orderkey % 4 + 1) * 50 THEN 'irmad' WHEN o_totalprice >= 500 * 50 THEN 'pif' ELSE 'histogram' END AS method FROM orders""")
def choose_method(spark, sf):
    gap = F.datediff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date"))
    m = radiometry.choose_method(F.col("o_orderkey") % 4 + 1, F.col("o_totalprice") / 50, F.col("o_custkey") % 2 == 0, gap)
    return table(spark, sf, "orders").select("o_orderkey", m.alias("method"))


NAMES = ("S2A_MSIL2A_20240115T083301", "S2B_MSIL1C_x", "LC08_L1TP_174038", "LC09_L2SP_1", "LE07_L1TP_2", "LT05_L1TP_3", "S1A_IW_GRDH_1SDV", "20240101_083000_PSScene", "PHR1A_PMS", "SPOT7_2024", "WV03_scene", "MOD09GA.A2024", "holiday")
FOUND = ("sentinel2", "sentinel2", "landsat8", "landsat9", "landsat7", "landsat5", "sentinel1", "planetscope", "pleiades", "spot", "worldview", "modis", "generic")


@query("SELECT p_partkey, CASE p_partkey % 13 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(FOUND)) + " END AS sensor_id FROM part")
def sensor_detect(spark, sf):
    name = F.get(F.array(*[F.lit(f"/data/{n}.tif") for n in NAMES]), (F.col("p_partkey") % 13).cast("int"))
    return table(spark, sf, "part").select("p_partkey", sensors.detect_column(name).alias("sensor_id"))


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS pos, n_name AS name FROM nation WHERE n_nationkey < 12), m AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS pos, lower(n_name) AS name FROM nation WHERE n_nationkey >= 6 AND n_nationkey < 18)
 SELECT r.pos::INT AS ref_band, min(m.pos)::INT AS mov_band, r.name AS name FROM r JOIN m ON lower(r.name) = lower(m.name) GROUP BY r.pos, r.name""")
def common_bands(spark, sf):
    names = [r["n_name"] for r in table(spark, sf, "nation").filter("n_nationkey < 18").orderBy("n_nationkey").collect()]
    scenes = spark.createDataFrame([(names[:12], [n.lower() for n in names[6:18]])], "ref array<string>, mov array<string>")
    return geometry.common_bands(scenes, "ref", "mov")


@query("""SELECT s_suppkey, greatest(dx, 0)::INT AS col_off, greatest(dy, 0)::INT AS row_off, greatest(least(100, dx + 80) - greatest(dx, 0), 0)::INT AS width, greatest(least(100, dy + 80) - greatest(dy, 0), 0)::INT AS height
 FROM (SELECT s_suppkey, s_suppkey % 150 - 75 AS dx, s_suppkey % 97 - 48 AS dy FROM supplier)""")
def overlap_crop(spark, sf):
    x = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 150 - 75).alias("dx"), (F.col("s_suppkey") % 97 - 48).alias("dy"))
    box = geometry.overlap(F.col("dx"), F.col("dy"), (100, 100), (80, 80))
    return x.select("s_suppkey", *[c.cast("int").alias(k) for k, c in box.items()])


@query("""WITH g AS (SELECT line, px, lead(px) OVER (PARTITION BY line ORDER BY px) AS px2, a, lead(a) OVER (PARTITION BY line ORDER BY px) AS a2 FROM (SELECT unnest([0, 0, 0, 99, 99, 99]) AS line, unnest([0, 50, 99, 0, 50, 99]) AS px, unnest([500.0, 505.0, 510.0, 515.0, 520.0, 525.0])::DOUBLE AS a)),
 c AS (SELECT line, x, min(a + (a2 - a) * (x - px) / (px2 - px)) AS a FROM g, range(100) t(x) WHERE px2 IS NOT NULL AND x BETWEEN px AND px2 GROUP BY 1, 2),
 l AS (SELECT p.y, lo.x, lo.a + (hi.a - lo.a) * p.y / 99 AS a FROM range(100) p(y), c lo, c hi WHERE lo.line = 0 AND hi.line = 99 AND lo.x = hi.x)
 SELECT y::INT AS "row", x::INT AS "col", round(a, 6) AS gain FROM l""")
def calibration_lut(spark, sf):
    vectors = spark.createDataFrame([(0, [0, 50, 99], [500.0, 505.0, 510.0]), (99, [0, 50, 99], [515.0, 520.0, 525.0])], "line int, pixels array<int>, sigma array<double>")
    return sar.calibration_lut(vectors, 100, 100).select("row", "col", r6(F.col("gain")).alias("gain"))


CLOUDS = f"""(SELECT "row", "col" FROM {v.EV} WHERE v > (SELECT quantile_cont(v, 0.9) FROM {v.EV}))"""
SHADOW = f"""(SELECT DISTINCT "row" + dy AS "row", "col" + dx AS "col" FROM {CLOUDS}, (SELECT round_even(h / tan(radians(45::DOUBLE)) / 300 * -sin(radians(135::DOUBLE)), 0)::INT AS dx,
 round_even(h / tan(radians(45::DOUBLE)) / 300 * cos(radians(135::DOUBLE)), 0)::INT AS dy FROM (SELECT unnest([300, 700, 1200, 1800, 2400, 3000])::DOUBLE AS h)) WHERE "row" + dy BETWEEN 0 AND 29 AND "col" + dx BETWEEN 0 AND 23)"""


def _ev_clouds(spark, sf):
    x = v.ev(spark, sf)
    top = x.agg(F.percentile("v", F.lit(0.9)).alias("p"))
    return x.crossJoin(F.broadcast(top)).filter("v > p").select("row", "col")  # one row on the right


@query(f'SELECT "row"::INT AS "row", "col"::INT AS "col" FROM {SHADOW}')
def shadow_projection(spark, sf):
    return geometry.project_shadow(_ev_clouds(spark, sf), 45.0, 135.0, 300.0, (300.0, 700.0, 1200.0, 1800.0, 2400.0, 3000.0), 30, 24)


@query(f"""WITH e AS {v.EV} SELECT e."row", e."col" FROM e SEMI JOIN {SHADOW} s ON e."row" = s."row" AND e."col" = s."col" ANTI JOIN {CLOUDS} c ON e."row" = c."row" AND e."col" = c."col"
 WHERE v <= (SELECT quantile_cont(v, 0.25) FROM e ANTI JOIN {CLOUDS} c ON e."row" = c."row" AND e."col" = c."col")""")
def shadow_confirm(spark, sf):
    return geometry.confirm_shadows(v.ev(spark, sf).withColumnRenamed("v", "nir"), _ev_clouds(spark, sf), 45.0, 135.0, 300.0, (300.0, 700.0, 1200.0, 1800.0, 2400.0, 3000.0), 30, 24)


@query("""SELECT s_suppkey, round(1.01 * x + 0.02 * y + 3, 6) AS u, round(-0.01 * x + 0.99 * y - 4, 6) AS w FROM (SELECT s_suppkey, (s_suppkey % 100)::DOUBLE AS x, (s_suppkey % 37)::DOUBLE AS y FROM supplier)""")
def affine_points(spark, sf):
    t = geometry.Affine([[1.01, 0.02, 3.0], [-0.01, 0.99, -4.0]])
    x, y = t.columns((F.col("s_suppkey") % 100).cast("double"), (F.col("s_suppkey") % 37).cast("double"))
    return table(spark, sf, "supplier").select("s_suppkey", r6(x).alias("u"), r6(y).alias("w"))


@query("""SELECT y::INT AS "row", x::INT AS "col", round(sqrt(pow(0.01 * x + 3, 2) + pow(0.02 * y - 4, 2)), 6) AS displacement FROM (SELECT 32 + 64 * unnest(range(8)) AS y), (SELECT 32 + 64 * unnest(range(10)) AS x)""")
def displacement_map(spark, sf):
    return geometry.displacement_map(spark, geometry.Affine([[1.01, 0.0, 3.0], [0.0, 1.02, -4.0]]), 512, 640, 64).withColumn("displacement", r6(F.col("displacement")))


@query("""WITH p AS (SELECT (s_suppkey % 100)::DOUBLE AS x, (s_suppkey * 7 % 37)::DOUBLE AS y, s_acctbal / 10000 AS e FROM supplier), d AS (SELECT x, y, 1.1 * x + 0.2 * y + 5 + e AS u FROM p),
 m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(u) AS mu, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, u) AS xu, covar_pop(y, u) AS yu FROM d), s AS (SELECT *, (xu * yy - yu * xy) / (xx * yy - xy * xy) AS a, (yu * xx - xu * xy) / (xx * yy - xy * xy) AS b FROM m)
 SELECT round(a, 5) AS a, round(b, 5) AS b, round(mu - a * mx - b * my, 4) AS c FROM s""")
def affine_fit(spark, sf):
    x, y = (F.col("s_suppkey") % 100).cast("double"), (F.col("s_suppkey") * 7 % 37).cast("double")
    p = table(spark, sf, "supplier").select(x.alias("sx"), y.alias("sy"), (1.1 * x + 0.2 * y + 5 + F.col("s_acctbal") / 10000).alias("dx"), y.alias("dy"))
    t = geometry.Affine.fitted(p)
    return spark.createDataFrame([(round(float(t.m[0, 0]), 5), round(float(t.m[0, 1]), 5), round(float(t.m[0, 2]), 4))], "a double, b double, c double")


@query(f"""WITH e AS {v.EMB}, n AS (SELECT max("row") + 1 AS h FROM e), g AS (SELECT "row" AS r, "col" AS c, "row" + 0.25 AS sr, "col" - 0.5 AS sc FROM e),
 k AS (SELECT r, c, floor(sr)::INT + i AS y, floor(sc)::INT + j AS x, (CASE WHEN i = 0 THEN 1 - (sr - floor(sr)) ELSE sr - floor(sr) END) * (CASE WHEN j = 0 THEN 1 - (sc - floor(sc)) ELSE sc - floor(sc) END) AS w FROM g, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))
 SELECT r AS "row", c AS "col", round(sum(w * coalesce(v, 0)), 6) AS v FROM k LEFT JOIN e ON e."row" = y AND e."col" = x GROUP BY r, c""")
def bilinear_warp(spark, sf):
    x = v.emb(spark, sf)
    h = x.agg(F.max("row")).first()[0] + 1
    return geometry.warp(x, geometry.Affine([[1.0, 0.0, 0.5], [0.0, 1.0, -0.25]]), h, 64).select("row", "col", r6(F.col("v")).alias("v"))


K5 = "[1, 4, 6, 4, 1]"


@query(f"""WITH e AS {v.EMB}, n AS (SELECT max("row") + 1 AS h FROM e),
 a AS (SELECT "row" AS r, c2, sum(v * wt) / 16 AS v FROM e, n, (SELECT 2 * unnest(range(32)) AS c2) q, (SELECT unnest(range(5)) AS k, unnest({K5})::DOUBLE AS wt) w WHERE e."col" = CASE WHEN c2 + k - 2 < 0 THEN -(c2 + k - 2) WHEN c2 + k - 2 > 63 THEN 126 - (c2 + k - 2) ELSE c2 + k - 2 END GROUP BY 1, 2),
 b AS (SELECT r2, c2, sum(v * wt) / 16 AS v FROM (SELECT r2, c2, wt, CASE WHEN r2 + k - 2 < 0 THEN -(r2 + k - 2) WHEN r2 + k - 2 >= h THEN 2 * (h - 1) - (r2 + k - 2) ELSE r2 + k - 2 END AS rr, h FROM n, (SELECT unnest(range(0, (SELECT h FROM n), 2)) AS r2) x, (SELECT 2 * unnest(range(32)) AS c2) q, (SELECT unnest(range(5)) AS k, unnest({K5})::DOUBLE AS wt) w) JOIN a USING (c2) WHERE a.r = rr GROUP BY 1, 2)
 SELECT (r2 // 2)::INT AS "row", (c2 // 2)::INT AS "col", round(v, 6) AS v FROM b""")
def pyramid_down(spark, sf):
    x = v.emb(spark, sf)
    h = x.agg(F.max("row")).first()[0] + 1
    return geometry.pyramid_down(x, h, 64).select("row", "col", r6(F.col("v")).alias("v"))


@query(f"""WITH e AS (SELECT "row", "col", v + 1 AS v FROM {v.EMB}), n AS (SELECT max("row") + 1 AS h FROM e),
 s AS (SELECT "row" AS r, "col" AS c, v AS x, (SELECT h FROM n) AS h FROM e),
 k AS (SELECT r, c, x, CASE WHEN r + i < 0 THEN -(r + i) WHEN r + i >= h THEN 2 * (h - 1) - (r + i) ELSE r + i END AS rr, CASE WHEN c + j < 0 THEN -(c + j) WHEN c + j > 63 THEN 126 - (c + j) ELSE c + j END AS cc FROM s, (SELECT unnest(range(-1, 2)) AS i) a, (SELECT unnest(range(-1, 2)) AS j) b)
 SELECT r AS "row", c AS "col", round(avg(v), 6) AS mean, round(var_pop(v), 6) AS var FROM k JOIN e ON e."row" = rr AND e."col" = cc GROUP BY r, c""")
def box_mean_var(spark, sf):
    x = v.emb(spark, sf).withColumn("v", F.col("v") + 1)
    h = x.agg(F.max("row")).first()[0] + 1
    return sar.box_stats(x, h, 64, 3).select("row", "col", r6(F.col("mean")).alias("mean"), r6(F.col("var")).alias("var"))


def _speckled(name):
    def run(spark, sf):
        x = v.emb(spark, sf).select("row", "col", (F.col("v") + 1).alias("v"))
        h = x.agg(F.max("row")).first()[0] + 1
        return sar.speckle_filter(x, h, 64, name).select("row", "col", r6(F.col("v")).alias("v"))

    run.__name__ = name
    return run


for _name in ("refined_lee", "frost", "gamma_map"):
    query()(_speckled(_name))


@query(f"""WITH RECURSIVE e AS {v.EV}, g AS (SELECT r, c FROM range(30) a(r), range(24) b(c) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e."row" = r AND e."col" = c AND e.v > 40)),
 f AS (SELECT r, c FROM g WHERE r IN (0, 29) OR c IN (0, 23) UNION SELECT g.r, g.c FROM f JOIN g ON abs(g.r - f.r) + abs(g.c - f.c) = 1) SELECT r::INT AS "row", c::INT AS "col" FROM f""")
def edge_nodata(spark, sf):
    grid = spark.range(720).select((F.col("id") / 24).cast("int").alias("row"), (F.col("id") % 24).cast("int").alias("col"))
    bad = grid.join(v.ev(spark, sf).filter("v > 40"), ["row", "col"], "left_anti")
    return geometry.edge_connected(bad, 30, 24, 8)


@query("""WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 20 = 0), e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
 d AS (SELECT q.vec_id AS query_id, e.vec_id AS near_id, list_distance(q.x, e.x) AS d FROM q JOIN e ON q.vec_id <> e.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, near_id) AS k FROM d)
 SELECT a.query_id, a.near_id, round(a.d, 6) AS distance, a.d < 0.75 * b.d AS kept FROM r a JOIN r b ON a.query_id = b.query_id AND a.k = 1 AND b.k = 2""")
def knn_ratio_test(spark, sf):
    e = table(spark, sf, "embeddings")
    return geometry.ratio_matches(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding").withColumn("distance", r6(F.col("distance")))
