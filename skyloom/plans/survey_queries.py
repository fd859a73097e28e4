"""Queries of the survey's own operators, each with equivalent SQL."""

from __future__ import annotations

import math
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import scalars as S
from skyloom.operators import archive, lightcurves, pixels, selection
from skyloom.plans import adapters as A
from skyloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
BAD = S.flag_mask()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def sig(c: Column | str) -> Column:
    """Nine digits as text, so that numbers of any size compare alike."""
    return F.format_string("%.8e", F.col(c) if isinstance(c, str) else c)


def num(c: Column | str) -> Column:
    """``sig``, and names for what isn't finite."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c), "nan").when(c == math.inf, "inf").when(c == -math.inf, "-inf").otherwise(F.when(c.isNotNull(), sig(c)))


def lc(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lightcurve")


# -- pieces of SQL ----------------------------------------------------------
def fin(x: str) -> str:
    return f"({x} IS NOT NULL AND isfinite({x}))"


SNR = "CASE WHEN flux_error > 0 AND NOT isnan(flux_error) THEN flux / flux_error WHEN flux IS NOT NULL THEN 0.0::double END"
LIMIT = "(flux_error > flux AND NOT isnan(flux_error))"
LOW = f"coalesce(({SNR}) < 5 AND NOT isnan({SNR}), true)"
FLAGGED = f"coalesce((flag::bigint & {BAD}) <> 0, false)"
CLASS = f"CASE WHEN {LOW} OR {FLAGGED} THEN 'rejected' ELSE 'good' END || CASE WHEN coalesce({LIMIT}, false) THEN '_upper_limits' ELSE '_regular' END"
USABLE = f"{fin('flux')} AND flux > 0 AND mag_ab IS NOT NULL AND NOT isnan(mag_ab)"
SIG = "printf('%.8e', {})"
NUM = "CASE WHEN isnan({0}) THEN 'nan' WHEN isinf({0}) THEN CASE WHEN {0} > 0 THEN 'inf' ELSE '-inf' END WHEN {0} IS NOT NULL THEN printf('%.8e', {0}) END"
_DAYS = "datediff('day', DATE '1858-11-17', o_orderdate::date)::double"
_RA, _DEC = "((o_orderkey * 7) % 350)::double", "((o_orderkey * 13) % 170 - 85)::double"
PLANE = f"""plane AS (SELECT o_orderkey AS planeid, 'ivo://x/qr?' || o_orderkey || '_' || (o_custkey % 4) || '/D' || (o_custkey % 6 + 1) AS did,
  {_DAYS} AS t_lo, {_DAYS} + 0.0013::double AS t_hi, '{S.BANDPASS}D' || (o_custkey % 6 + 1) AS bandpass, {_RA} AS ra0, {_DEC} AS dec0, least({_DEC} + 10, 89.5::double) AS dec1 FROM orders)"""


def _vec(ra: str, dec: str) -> tuple[str, str, str]:
    return f"(cos(radians({dec})) * cos(radians({ra})))", f"(cos(radians({dec})) * sin(radians({ra})))", f"sin(radians({dec}))"


def _side(a: tuple[str, str], b: tuple[str, str]) -> str:
    (ax, ay, az), (bx, by, bz), (px, py, pz) = _vec(*a), _vec(*b), _vec("s.ra", "s.decl")
    return f"(({ay} * {bz} - {az} * {by}) * {px} + ({az} * {bx} - {ax} * {bz}) * {py} + ({ax} * {by} - {ay} * {bx}) * {pz})"


_CORNERS = [("p.ra0", "p.dec0"), ("p.ra0 + 10", "p.dec0"), ("p.ra0 + 10", "p.dec1"), ("p.ra0", "p.dec1")]
_SIDES = [_side(_CORNERS[i], _CORNERS[(i + 1) % 4]) for i in range(4)]
_TOWARDS = " + ".join(f"({ax} * {px} + {ay} * {py} + {az} * {pz})" for (ax, ay, az), (px, py, pz) in ((_vec(*c), _vec("s.ra", "s.decl")) for c in _CORNERS))
INSIDE = f"({_TOWARDS}) > 0 AND (" + " AND ".join(f"{x} >= 0" for x in _SIDES) + " OR " + " AND ".join(f"{x} <= 0" for x in _SIDES) + ")"
PX = """e AS (SELECT vec_id AS img, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
px AS (SELECT img, (pos // 8)::int AS y, (pos % 8)::int AS x, 0.3::double + v::double AS image, 0.01::double + (pos % 7) * 0.001::double AS variance,
  0.05::double + (pos % 8) * 0.002::double AS zodi, CASE WHEN (img * 64 + pos) % 11 = 0 THEN (1 << ((img + pos) % 22)::int) ELSE 0 END AS flags, pos FROM e)"""
STRICT_SQL, RELAXED_SQL = f"(flags & {pixels.STRICT}) = 0", f"(flags & {pixels.RELAXED}) = 0"


def _dist(x0: float, y0: float) -> str:
    return f"sqrt((x - {x0}::double) * (x - {x0}::double) + (y - {y0}::double) * (y - {y0}::double))"


def _clip_sql(start: str, key: str, value: str, extra: str, rounds: int, sigma: float = 3.0) -> str:
    """CTEs r0..rN: rows of ``start`` clipped; rN survive."""
    out = [f"r0 AS ({start})"]
    for i in range(rounds):
        out.append(f"s{i} AS (SELECT {key}, median({value}) AS m, stddev_pop({value}) AS s FROM r{i} GROUP BY {key})")
        out.append(f"r{i + 1} AS (SELECT {key}, {extra}{value} FROM r{i} JOIN s{i} USING ({key}) WHERE {value} >= m - {sigma} * s AND {value} <= m + {sigma} * s)")
    return ",\n".join(out)


# -- catalogue ----------------------------------------------------------------
@query(
    f"""WITH {PLANE} SELECT s.source_id, regexp_extract(p.did, '\\?([^/]+)', 1) AS obs_id, split_part(p.bandpass, '-', -1) AS band, (p.t_lo + p.t_hi) / 2 AS mjd,
  0.75e-6::double * 1e6::double AS wavelength_min, 5.0e-6::double * 1e6::double AS wavelength_max, '{S.ARCHIVE}' || 'ibe/data/' || l_partkey || '_' || l_suppkey || '.fits' AS download_url, p.t_lo AS t_min, p.t_hi AS t_max
FROM sky_source s JOIN plane p ON {INSIDE} JOIN lineitem ON l_orderkey = p.planeid WHERE p.bandpass IN ('{S.BANDPASS}D1', '{S.BANDPASS}D4')"""
)
def obs_search(spark, d):
    return archive.search(A.sources(spark, d), A.artifacts(spark, d), A.planes(spark, d), ("D1", "D4"))


@query(
    f"""WITH {PLANE}, o AS (SELECT s.source_id, regexp_extract(p.did, '\\?([^/]+)', 1) AS obs_id, split_part(p.bandpass, '-', -1) AS band, p.t_lo AS t_min,
  '{S.ARCHIVE}' || 'ibe/data/' || l_partkey || '_' || l_suppkey || '.fits' AS download_url FROM sky_source s JOIN plane p ON {INSIDE} JOIN lineitem ON l_orderkey = p.planeid)
SELECT source_id, obs_id, band, t_min, download_url, row_number() OVER (PARTITION BY source_id ORDER BY t_min, obs_id, band, download_url) AS seq FROM o"""
)
def obs_search_ordered(spark, d):
    """All bands, each source's observations in the order of their start."""
    return archive.search(A.sources(spark, d), A.artifacts(spark, d), A.planes(spark, d), ordered=True, columns=["source_id", "obs_id", "band", "t_min", "download_url"])


@query(f"WITH {PLANE} SELECT s.source_id, p.planeid FROM sky_source s JOIN plane p ON {INSIDE}")
def spatial_join(spark, d):
    return archive.spatial_join(A.sources(spark, d), A.planes(spark, d)).select("source_id", "planeid")


@query("SELECT band, count(*) AS n FROM observation GROUP BY band")
def band_counts(spark, d):
    return archive.band_counts(table(spark, d, "observation"))


@query("SELECT count(*) AS n_observations, coalesce(max(mjd) - min(mjd), 0) AS time_span_days FROM observation")
def time_span(spark, d):
    return archive.time_span(table(spark, d, "observation"))


@query("""WITH b AS (SELECT unnest(['D2', 'D5', 'D9']) AS band), c AS (SELECT band, count(*) AS n FROM observation GROUP BY band)
SELECT band, coalesce(n, 0) AS n, (SELECT max(mjd) - min(mjd) FROM observation) AS time_span_days FROM b LEFT JOIN c USING (band)""")
def filter_by_band(spark, d):
    return archive.filter_by_band(spark, table(spark, d, "observation"), ("D2", "D5", "D9"))


@query("""SELECT obs_id, band, (wavelength_min + wavelength_max) / 2 AS wavelength_center, wavelength_max - wavelength_min AS bandwidth, (t_min + t_max) / 2 AS mid_time,
  'data/' || band || '/' || obs_id || '.fits' AS path, download_url FROM observation""")
def observation_derived(spark, d):
    o = table(spark, d, "observation")
    return o.select(
        "obs_id",
        "band",
        ((F.col("wavelength_min") + F.col("wavelength_max")) / 2).alias("wavelength_center"),
        (F.col("wavelength_max") - F.col("wavelength_min")).alias("bandwidth"),
        ((F.col("t_min") + F.col("t_max")) / 2).alias("mid_time"),
        S.output_path("data", F.col("band"), F.col("obs_id")).alias("path"),
        "download_url",
    )


@query("SELECT source_id, coalesce(nullif(source_name, ''), printf('source_%.4f_%.4f', round(ra::decimal(18, 10), 4)::double, round(decl::decimal(18, 10), 4)::double)) AS label, printf('RA%.4f_Dec%.4f', round(ra::decimal(18, 10), 4)::double, round(decl::decimal(18, 10), 4)::double) AS title FROM sky_source")
def source_labels(spark, d):
    s = A.sources(spark, d)
    return s.select("source_id", S.source_label(F.col("ra"), F.col("dec"), F.col("name")).alias("label"), S.source_label(F.col("ra"), F.col("dec"), style="title").alias("title"))


# -- downloads -------------------------------------------------------------------
@query("""SELECT split_part(local_path, '/', 2) AS band, count(*) FILTER (success) AS n_success, count(*) FILTER (NOT coalesce(success, false)) AS n_failed,
  round(sum(CASE WHEN success THEN coalesce(size_mb, 0) END) / 1024, 6) AS total_gb FROM download_result GROUP BY 1""")
def download_summary(spark, d):
    r = table(spark, d, "download_result").withColumn("band", F.split_part(F.col("local_path"), F.lit("/"), F.lit(2)))
    return archive.download_summary(r, ["band"]).withColumn("total_gb", F.round("total_gb", 6))


@query("""SELECT url, error_text, finished_at, greatest((SELECT count(*) FROM download_result WHERE NOT coalesce(success, false)) - 5, 0) AS n_more
FROM download_result WHERE NOT coalesce(success, false) ORDER BY finished_at, url, error_text LIMIT 5""")
def top5_failures(spark, d):
    return archive.first_failures(table(spark, d, "download_result"))


@query("""SELECT DISTINCT band, obs_id, 'data/' || band || '/' || obs_id || '.fits' AS path FROM observation o
WHERE NOT EXISTS (SELECT 1 FROM download_result r WHERE r.success AND r.local_path = 'data/' || o.band || '/' || o.obs_id || '.fits')""")
def skip_existing_anti(spark, d):
    return archive.still_to_fetch(table(spark, d, "observation"), table(spark, d, "download_result"))


@query("""WITH b AS (SELECT url, finished_at, round(size_mb * 1048576)::bigint AS n FROM download_result WHERE size_mb IS NOT NULL)
SELECT url, finished_at, CASE WHEN n < 1024 THEN printf('%.1f B', n::double) WHEN n < 1024 ** 2 THEN printf('%.1f KB', n / 1024::double) WHEN n < 1024 ** 3 THEN printf('%.1f MB', n / 1048576::double) ELSE printf('%.1f GB', n / 1073741824::double) END AS size FROM b""")
def format_size(spark, d):
    r = table(spark, d, "download_result").where("size_mb IS NOT NULL")
    return r.select("url", "finished_at", S.human_size(F.round(F.col("size_mb") * 1048576).cast("long")).alias("size"))


_TEXTS = """t AS (SELECT o_orderkey AS id, CASE o_orderkey % 11 WHEN 0 THEN (o_orderkey % 500) || 'px' WHEN 1 THEN '0.' || (o_orderkey % 9) WHEN 2 THEN (o_orderkey % 300) || ',' || (o_orderkey % 200) || 'px'
  WHEN 3 THEN (o_orderkey % 90) || 'arcmin' WHEN 4 THEN '-1px' WHEN 5 THEN 'abc' WHEN 6 THEN NULL WHEN 7 THEN (o_orderkey % 4000) || 'arcsec' WHEN 8 THEN '0.0' || (o_orderkey % 30) || 'rad' WHEN 9 THEN (o_orderkey % 7) || 'deg' ELSE '' END AS size,
  CASE o_orderkey % 5 WHEN 0 THEN '70,20' WHEN 1 THEN (o_orderkey % 400) || '.5,' || (o_orderkey % 150) || 'px' WHEN 2 THEN '10,' || (o_orderkey % 120) WHEN 3 THEN '10' ELSE '-3.5,-' || (o_orderkey % 95) || 'deg' END AS center FROM orders)"""
_NUM = "list_transform(regexp_extract_all({}, '-?\\d+\\.?\\d*'), lambda x: x::double)"
_VALID = f"coalesce(regexp_matches(size, '{S._SIZE}') AND len(list_filter({_NUM.format('size')}, lambda x: x <= 0)) = 0, false)"


@query(f"WITH {_TEXTS} SELECT id, {_VALID} AS valid FROM t")
def cutout_validate_size(spark, d):
    return A.cutout_texts(spark, d).select("id", S.valid_cutout_size(F.col("size")).alias("valid"))


@query(f"WITH {_TEXTS} SELECT id, coalesce(regexp_matches(center, '{S._CENTER}') AND (contains(center, 'px') OR ({_NUM.format('center')})[2] BETWEEN -90 AND 90), false) AS valid FROM t")
def cutout_validate_center(spark, d):
    return A.cutout_texts(spark, d).select("id", S.valid_cutout_center(F.col("center")).alias("valid"))


@query(f"WITH {_TEXTS} SELECT id, CASE WHEN size IS NULL OR size = '' THEN '' ELSE '?center=' || center || '&size=' || size END AS params FROM t")
def cutout_url(spark, d):
    t = A.cutout_texts(spark, d)
    return t.select("id", S.cutout_parameters(F.col("size"), F.col("center"), F.lit(1.5), F.lit(2.5)).alias("params"))


@query(f"""WITH {_TEXTS}, u AS (SELECT *, CASE WHEN contains(size, 'arcsec') THEN 1 / 6.2::double WHEN contains(size, 'arcmin') THEN 60 / 6.2::double WHEN contains(size, 'deg') THEN 3600 / 6.2::double
  WHEN contains(size, 'rad') THEN 206265 / 6.2::double WHEN contains(size, 'px') THEN 1.0::double ELSE 3600 / 6.2::double END AS per, {_NUM.format('size')} AS n FROM t)
SELECT id, round(CASE WHEN {_VALID} THEN greatest(71.6::double * (n[1] * per * coalesce(n[2], n[1]) * per / 4161600::double), 5.0::double) ELSE 71.6::double END, 6) AS mb FROM u""")
def cutout_estimate_mb(spark, d):
    return A.cutout_texts(spark, d).select("id", F.round(S.cutout_megabytes(F.col("size")), 6).alias("mb"))


# -- scalar functions on measurements ------------------------------------------------
@query(f"SELECT meas_id, {NUM.format('snr2')} AS snr2, limited FROM (SELECT meas_id, {SNR} AS snr2, {LIMIT} AS limited FROM lightcurve)")
def snr_upper_limit(spark, d):
    m = lc(spark, d)
    return m.select("meas_id", num(S.snr(F.col("flux"), F.col("flux_error"))).alias("snr2"), S.is_upper_limit(F.col("flux"), F.col("flux_error")).alias("limited"))


@query(f"""SELECT meas_id, CASE WHEN {fin('flux')} AND flux > 0 THEN round(23.9::double - 2.5::double * log10(flux), 8) END AS mag,
  CASE WHEN {fin('flux')} AND flux > 0 AND {fin('flux_error')} THEN {SIG.format('2.5::double / ln(10::double) * flux_error / flux')} END AS err FROM lightcurve""")
def ab_magnitude(spark, d):
    f, e = F.col("flux"), F.col("flux_error")
    return lc(spark, d).select("meas_id", F.round(S.ab_magnitude(f), 8).alias("mag"), F.when(S.ab_magnitude_error(f, e).isNotNull(), sig(S.ab_magnitude_error(f, e))).alias("err"))


@query(f"""SELECT meas_id, {NUM.format('jy')} AS jy FROM (SELECT meas_id, pow(10::double, -0.4::double * (mag_ab + 48.6::double)) * 1e23::double AS jy FROM lightcurve)""")
def mag_to_flux(spark, d):
    return lc(spark, d).select("meas_id", num(S.magnitude_to_jansky(F.col("mag_ab"))).alias("jy"))


@query(f"""WITH u AS (SELECT meas_id, snr, CASE meas_id % 4 WHEN 0 THEN 'MJy/sr' WHEN 1 THEN ' uJy / arcsec2' WHEN 2 THEN 'JY/ARCSEC2' ELSE 'parsec' END AS unit FROM lightcurve),
c AS (SELECT meas_id, snr * CASE lower(replace(unit, ' ', '')) WHEN 'mjy/sr' THEN 1::double WHEN 'ujy/arcsec2' THEN 1e12::double / pow(648000::double / pi(), 2) WHEN 'jy/arcsec2' THEN 1e6::double / pow(648000::double / pi(), 2) END AS converted FROM u)
SELECT meas_id, {NUM.format('converted')} AS converted FROM c""")
def unit_convert(spark, d):
    return _converted(lc(spark, d)).select("meas_id", num("converted").alias("converted"))


@query()
def unit_convert_all(spark, d):
    """Every reading, whatever its value."""
    return _converted(lc(spark, d))


def _converted(m):
    k = F.col("meas_id") % 4
    unit = F.when(k == 0, "MJy/sr").when(k == 1, " uJy / arcsec2").when(k == 2, "JY/ARCSEC2").otherwise("parsec")
    return m.select("meas_id", (F.col("snr") * S.unit_factor(unit)).alias("converted"))


@query("SELECT meas_id, CASE WHEN flag < 0 THEN '-' || lpad(bin(-flag::bigint), greatest(21, length(bin(-flag::bigint)))::int, '0') ELSE lpad(bin(flag::bigint), greatest(22, length(bin(flag::bigint)))::int, '0') END AS bits FROM lightcurve")
def flag_binary(spark, d):
    return lc(spark, d).select("meas_id", S.flag_binary(F.col("flag")).alias("bits"))


@query("SELECT meas_id, " + ", ".join(f"(flag::bigint & {1 << b}) <> 0 AS {n.lower()}" for n, b in S.FLAG_BITS.items()) + " FROM lightcurve")
def flag_decode(spark, d):
    return lc(spark, d).select("meas_id", *[c.alias(n.lower()) for n, c in S.decoded_flags(F.col("flag")).items()])


@query(f"SELECT band, count(*) FILTER (flag::bigint & {BAD} <> 0) AS n_bad, count(*) FILTER (flag::bigint & 7 <> 0) AS n_low3, count(*) AS n FROM lightcurve GROUP BY band")
def flag_mask_test(spark, d):
    return lc(spark, d).groupBy("band").agg(F.count_if(S.has_flag(F.col("flag"), BAD)).alias("n_bad"), F.count_if(S.has_flag(F.col("flag"), 7)).alias("n_low3"), F.count(F.lit(1)).alias("n"))


@query("WITH b AS (SELECT unnest(range(32)) AS bit) SELECT bit::int AS bit, count(*) AS n FROM lightcurve, b WHERE (flag::bigint >> bit::int) & 1 = 1 GROUP BY bit ORDER BY n DESC, bit LIMIT 10")
def flag_bits_topk(spark, d):
    return lc(spark, d).select(F.explode(S.set_bits(F.col("flag"))).alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "bit").limit(10)


@query("SELECT CASE WHEN det BETWEEN 1 AND 6 THEN 'D' || det ELSE 'Unknown' END AS band, count(*) AS n FROM (SELECT (meas_id % 9)::int AS det FROM lightcurve) GROUP BY 1")
def detector_band(spark, d):
    return lc(spark, d).groupBy(S.detector_band((F.col("meas_id") % 9).cast("int")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


# -- quality ----------------------------------------------------------------------------
@query(f"SELECT meas_id, {CLASS} AS quality_class FROM lightcurve")
def classify_4way(spark, d):
    return lightcurves.classified(lc(spark, d)).select("meas_id", "quality_class")


@query(f"""WITH q AS (SELECT band, {CLASS} AS quality_class, {SNR} AS snr2, mjd FROM lightcurve)
SELECT band, quality_class, count(*) AS n, CASE WHEN count(*) FILTER (isnan(snr2) OR snr2 = 'inf') > 0 AND count(*) FILTER (isnan(snr2) OR snr2 = '-inf') > 0 THEN 'nan'
  WHEN count(*) FILTER (snr2 = 'inf') > 0 THEN 'inf' WHEN count(*) FILTER (snr2 = '-inf') > 0 THEN '-inf' ELSE {SIG.format('avg(snr2) FILTER (isfinite(snr2))')} END AS mean_snr, min(mjd) AS mjd_min, max(mjd) AS mjd_max
FROM q GROUP BY 1, 2""")
def class_summary(spark, d):
    m = lightcurves.classified(lc(spark, d))
    return m.groupBy("band", "quality_class").agg(F.count(F.lit(1)).alias("n"), num(F.avg(S.snr(F.col("flux"), F.col("flux_error")))).alias("mean_snr"), F.min("mjd").alias("mjd_min"), F.max("mjd").alias("mjd_max"))


@query(f"""WITH q AS (SELECT band, coalesce(({SNR}) < 5, true) AS low, {FLAGGED} AS bad FROM lightcurve)
SELECT band, count(*) AS n_total, count(*) FILTER (NOT low AND NOT bad) AS n_kept, count(*) FILTER (low AND bad) AS rejected_both, count(*) FILTER (low AND NOT bad) AS rejected_snr, count(*) FILTER (NOT low AND bad) AS rejected_flag FROM q GROUP BY band""")
def quality_filter_stats(spark, d):
    return lightcurves.filter_counts(lc(spark, d), keys=["band"])


@query(f"SELECT * EXCLUDE (rn) FROM (SELECT meas_id, source_id, band, flux, row_number() OVER (PARTITION BY source_id, band, obs_id ORDER BY load_id, meas_id) AS rn FROM lightcurve WHERE {USABLE}) WHERE rn = 1")
def usable_once(spark, d):
    """Usable measurements, of repeated deliveries the first: an aggregate instead of a window."""
    first = F.min_by(F.struct("meas_id", "flux"), F.struct("load_id", "meas_id"))
    return lightcurves.usable(lc(spark, d)).groupBy("source_id", "band", "obs_id").agg(first.alias("m")).select("m.meas_id", "source_id", "band", "m.flux")


# -- light curves ------------------------------------------------------------------------
@query(f"""SELECT source_id, obs_id, band, meas_id, mjd, flux, {NUM.format('flux_error')} AS flux_error, {NUM.format('(' + SNR + ')')} AS snr, {LIMIT} AS is_upper_limit,
  CASE WHEN flag < 0 THEN '-' || lpad(bin(-flag::bigint), greatest(21, length(bin(-flag::bigint)))::int, '0') ELSE lpad(bin(flag::bigint), greatest(22, length(bin(flag::bigint)))::int, '0') END AS flag_binary,
  row_number() OVER (PARTITION BY source_id, band ORDER BY mjd NULLS FIRST, obs_id NULLS FIRST, meas_id) AS seq FROM lightcurve WHERE {USABLE}""")
def lightcurve_build(spark, d):
    return lightcurves.light_curve(lightcurves.usable(lc(spark, d))).withColumns({c: num(c) for c in ("flux_error", "snr")})


@query(f"""SELECT source_id, count(*) AS n_measurements, count(DISTINCT band) AS n_bands, string_agg(DISTINCT band, ',' ORDER BY band) AS bands, min(mjd) AS mjd_min, max(mjd) AS mjd_max, max(mjd) - min(mjd) AS time_span_days,
  min(wavelength) AS wavelength_min, max(wavelength) AS wavelength_max, count(*) FILTER ({LIMIT}) AS n_upper_limits, {SIG.format('avg(' + SNR + ')')} AS mean_snr FROM lightcurve WHERE {USABLE} GROUP BY source_id""")
def lightcurve_summary(spark, d):
    return lightcurves.summary(lightcurves.usable(lc(spark, d)), ["source_id"]).withColumn("mean_snr", sig("mean_snr"))


@query(
    "WITH "
    + _clip_sql(f"SELECT source_id, meas_id, flux FROM lightcurve WHERE {fin('flux')} AND NOT coalesce({LIMIT}, false)", "source_id", "flux", "meas_id, ", 10)
    + f" SELECT source_id, meas_id FROM r10 UNION ALL SELECT source_id, meas_id FROM lightcurve WHERE coalesce({LIMIT}, false)"
)
def sigma_clip(spark, d):
    m = lc(spark, d).select("source_id", "meas_id", "flux", "flux_error")
    return lightcurves.clipped(m, ["source_id"]).select("source_id", "meas_id")


@query(f"""WITH q AS (SELECT band, quantile_cont(flux, 0.001) AS a, quantile_cont(flux, 0.999) AS b FROM lightcurve WHERE {fin('flux')} GROUP BY band)
SELECT band, {SIG.format('a - (b - a) * 0.1::double')} AS y_min, {SIG.format('b + (b - a) * 0.1::double')} AS y_max FROM q""")
def percentile_limits(spark, d):
    return lightcurves.plot_limits(lc(spark, d), ["band"], "flux").select("band", sig("y_min").alias("y_min"), sig("y_max").alias("y_max"))


@query(f"""SELECT source_id, band, count(*) AS n, {SIG.format('quantile_cont(flux, 0.25)')} AS q1, {SIG.format('quantile_cont(flux, 0.5)')} AS q2, {SIG.format('quantile_cont(flux, 0.95)')} AS q95 FROM lightcurve WHERE {fin('flux')} GROUP BY 1, 2""")
def exact_percentiles(spark, d):
    q = selection.exact_quantiles(lc(spark, d), ["source_id", "band"], "flux", {"q1": 0.25, "q2": 0.5, "q95": 0.95})
    return q.select("source_id", "band", "n", *[sig(c).alias(c) for c in ("q1", "q2", "q95")])


_HIST = """WITH v AS (SELECT band, {c} AS v FROM lightcurve WHERE {c} IS NOT NULL AND isfinite({c}) AND {where}), r AS (SELECT band, min(v) AS lo, max(v) AS hi FROM v GROUP BY band)
SELECT band, least(floor((v - lo) / ((hi - lo) / 20)), 19)::int AS bin, count(*) AS count FROM v JOIN r USING (band) GROUP BY 1, 2"""


@query(_HIST.format(c="wavelength", where="true"))
def histogram20_wavelength(spark, d):
    return lightcurves.histogram(lc(spark, d), ["band"], "wavelength")


@query(_HIST.format(c="snr", where="flux_error > 0"))
def histogram20_snr(spark, d):
    return lightcurves.histogram(lc(spark, d).where(F.col("flux_error") > 0), ["band"], "snr")


@query(f"""WITH p AS (SELECT band, quantile_cont(snr, 0.95) AS most FROM lightcurve WHERE {fin('snr')} AND flux_error > 0 GROUP BY band)
SELECT * FROM ({_HIST.format(c="snr", where="flux_error > 0 AND snr <= (SELECT most FROM p WHERE p.band IS NOT DISTINCT FROM lightcurve.band)")})""")
def histogram20_snr_p95(spark, d):
    """Up to each band's 95 % value, as the summary plot has it."""
    return lightcurves.histogram(lc(spark, d).where(F.col("flux_error") > 0), ["band"], "snr", upto=0.95)


@query(_HIST.format(c="wavelength", where="true"))
def histogram20_wavelength_all(spark, d):
    """Over all finite wavelengths."""
    return lightcurves.histogram(lc(spark, d), ["band"], "wavelength")


@query(_HIST.format(c="snr", where="flux_error > 0"))
def histogram20_snr_all(spark, d):
    """Over all finite ratios of readings whose error is positive."""
    return lightcurves.histogram(lc(spark, d).where(F.col("flux_error") > 0), ["band"], "snr")


@query("SELECT meas_id, mjd - min(mjd) OVER (PARTITION BY source_id) AS days FROM lightcurve")
def days_since_first(spark, d):
    return lightcurves.days_since_first(lc(spark, d), ["source_id"]).select("meas_id", "days")


@query(f"""WITH c AS (SELECT *, {CLASS} AS quality_class FROM lightcurve), f AS (SELECT source_id, min(mjd) AS f FROM c WHERE quality_class = 'good_regular' GROUP BY 1)
SELECT source_id, meas_id, quality_class, wavelength, bandwidth, {NUM.format("(CASE WHEN quality_class LIKE '%upper_limits' THEN flux + flux_error ELSE flux END)")} AS y,
  {NUM.format("(CASE WHEN quality_class NOT LIKE '%upper_limits' THEN flux_error END)")} AS yerr, mjd - f AS days FROM c LEFT JOIN f USING (source_id) WHERE flux IS NOT NULL AND NOT isnan(flux)""")
def spectrum_series(spark, d):
    return lightcurves.spectrum_series(lc(spark, d)).withColumns({c: num(c) for c in ("y", "yerr")})


@query(f"""WITH c AS (SELECT *, CASE WHEN {LOW} OR {FLAGGED} THEN 'rejected' ELSE 'good' END AS class, coalesce({LIMIT}, false) AS is_limit FROM lightcurve)
SELECT source_id, meas_id, class, mjd, {NUM.format("(CASE WHEN class = 'good' AND is_limit THEN flux + flux_error ELSE flux END)")} AS y, {NUM.format('flux_error')} AS yerr, wavelength, is_limit FROM c WHERE flux IS NOT NULL AND NOT isnan(flux)""")
def lightcurve_series(spark, d):
    return lightcurves.time_series(lc(spark, d)).withColumns({c: num(c) for c in ("y", "yerr")})


@query(f"""WITH c AS (SELECT *, CASE WHEN {LOW} OR {FLAGGED} THEN 'rejected' ELSE 'good' END AS class, coalesce({LIMIT}, false) AS is_limit FROM lightcurve WHERE mag_ab IS NOT NULL AND NOT isnan(mag_ab))
SELECT source_id, meas_id, class, mjd, {NUM.format('mag_ab')} AS y, {NUM.format("mag_ab_error")} AS yerr, wavelength, is_limit,
  row_number() OVER (PARTITION BY source_id ORDER BY mjd NULLS FIRST, meas_id) AS seq FROM c""")
def lightcurve_series_mag(spark, d):
    """The plot's magnitude mode, in its order by time."""
    return lightcurves.time_series(lc(spark, d), magnitude=True, ordered=True).withColumns({c: num(c) for c in ("y", "yerr")})


@query("SELECT band, floor(mjd)::bigint AS day, count(*) AS n FROM lightcurve WHERE mjd IS NOT NULL AND isfinite(mjd) GROUP BY 1, 2")
def band_days(spark, d):
    """Points of the summary plot by band and day."""
    return lightcurves.band_days(lc(spark, d))


@query(f"""SELECT meas_id, source_id, {NUM.format('flux')} AS flux, {NUM.format('flux_error')} AS flux_error, flag FROM lightcurve WHERE NOT coalesce(({SNR}) < 5, true) AND NOT {FLAGGED}""")
def quality_filtered(spark, d):
    """The measurements that pass the quality filter."""
    return lightcurves.quality_filter(lc(spark, d)).select("meas_id", "source_id", num("flux").alias("flux"), num("flux_error").alias("flux_error"), "flag")


@query(f"SELECT meas_id FROM lightcurve WHERE ({SNR}) >= 5 AND flag = 0")
def clean_measurements(spark, d):
    """The strict recipe: snr of five or more and no flag at all."""
    return lightcurves.quality_filter(lc(spark, d), strict=True).select("meas_id")


@query(f"SELECT source_id, min(mjd) - (max(mjd) - min(mjd)) * 0.05::double AS x_min, max(mjd) + (max(mjd) - min(mjd)) * 0.05::double AS x_max FROM lightcurve WHERE mjd IS NOT NULL AND isfinite(mjd) GROUP BY 1")
def axis_limits(spark, d):
    return lightcurves.axis_limits(lc(spark, d), ["source_id"], "mjd")


@query(f"""SELECT band, count(snr) AS n, {SIG.format('avg(snr)')} AS mean, {SIG.format('stddev_samp(snr)')} AS std, min(snr) AS min, max(snr) AS max, round(100 * avg((snr < 5)::int), 6) AS percent_low FROM lightcurve WHERE {fin('snr')} GROUP BY band""")
def describe_snr(spark, d):
    return _described(lc(spark, d).where(S.finite(F.col("snr")))).withColumns({c: sig(c) for c in ("mean", "std")})


@query()
def describe_snr_all(spark, d):
    """Over all finite ratios."""
    return _described(lc(spark, d).where(S.finite(F.col("snr"))))


def _described(m):
    v = F.col("snr")
    return m.groupBy("band").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(100 * F.avg((v < 5).cast("int")), 6).alias("percent_low"))


_ONCE = f"SELECT source_id, obs_id, band, min(flux) AS flux, min(mag_ab) AS mag FROM lightcurve WHERE {fin('flux')} AND {fin('mag_ab')} GROUP BY 1, 2, 3"


@query(f"WITH a AS ({_ONCE}), j AS (SELECT band, (pow(10::double, (23.9::double - mag) / 2.5::double) - flux) / flux * 100 AS p FROM a WHERE flux <> 0 AND source_id IS NOT NULL AND obs_id IS NOT NULL AND band IS NOT NULL) SELECT band, count(*) AS n, printf('%.5e', avg(p)) AS mean_diff, printf('%.5e', stddev_samp(p)) AS std_diff FROM j GROUP BY band")
def compare_curves(spark, d):
    """Delivered fluxes against those that follow from the delivered magnitudes."""
    return compare_curves_all(spark, d).withColumns({c: F.format_string("%.5e", c) for c in ("mean_diff", "std_diff")})


@query()
def compare_curves_all(spark, d):
    """``compare_curves`` over all readings with a finite flux and magnitude."""
    return _compared(lc(spark, d).where(S.finite(F.col("flux")) & S.finite(F.col("mag_ab"))))


def _compared(m):
    m = m.groupBy("source_id", "obs_id", "band").agg(F.min("flux").alias("flux"), F.min("mag_ab").alias("mag"))
    on = ["source_id", "obs_id", "band"]
    other = m.select(*on, F.pow(F.lit(10.0), (F.lit(23.9) - F.col("mag")) / 2.5).alias("flux"))
    return lightcurves.compare(m, other, on)


# -- pixels ---------------------------------------------------------------------------------
X0, Y0, R = 3.5, 3.5, 1.0


@query(f"WITH {PX} SELECT img, count(*) FILTER ({STRICT_SQL}) AS n_strict, count(*) FILTER ({RELAXED_SQL}) AS n_relaxed, round(avg(({STRICT_SQL})::int), 9) AS good_fraction FROM px GROUP BY img")
def pixel_masks(spark, d):
    return A.pixels(spark, d).groupBy("img").agg(F.count_if(pixels.usable(pixels.STRICT)).alias("n_strict"), F.count_if(pixels.usable(pixels.RELAXED)).alias("n_relaxed"), F.round(F.avg(pixels.usable().cast("int")), 9).alias("good_fraction"))


@query(f"""WITH {PX}, b AS (SELECT img, y, x, CASE WHEN flags <> 0 AND (img + pos) % 3 = 0 THEN 'nan'::double ELSE variance END AS v FROM px), m AS (SELECT img, median(v) AS m FROM b WHERE NOT isnan(v) AND v > 0 GROUP BY img)
SELECT img, y, x, round(CASE WHEN isnan(v) THEN m ELSE v END, 9) AS variance FROM b JOIN m USING (img)""")
def variance_repair(spark, d):
    return pixels.repair_variance(A.pixels(spark, d, broken=True)).select("img", "y", "x", F.round("variance", 9).alias("variance"))


_ZODI = f"""z AS (SELECT img, avg(({STRICT_SQL})::int) AS good, sum(image * zodi / variance) FILTER ({STRICT_SQL}) / sum(zodi * zodi / variance) FILTER ({STRICT_SQL}) AS fit FROM px GROUP BY img),
zs AS (SELECT img, good, fit, CASE WHEN good < 0.5 OR fit <= 0 OR fit > 5.2 THEN 1.0::double ELSE fit END AS scale FROM z)"""


@query(f"WITH {PX}, {_ZODI} SELECT img, round(good, 9) AS good_fraction, round(fit, 6) AS fit, round(scale, 6) AS scale FROM zs")
def zodi_scale(spark, d):
    z = pixels.zodi_scale(A.pixels(spark, d), most=5.2)
    return z.select("img", *[F.round(c, k).alias(c) for c, k in (("good_fraction", 9), ("fit", 6), ("scale", 6))])


@query(f"WITH {PX}, {_ZODI} SELECT img, y, x, round(image - scale * zodi, 6) AS image FROM px JOIN zs USING (img)")
def zodi_subtract(spark, d):
    return pixels.subtract_zodi(A.pixels(spark, d), most=5.2).select("img", "y", "x", F.round("image", 6).alias("image"))


@query(f"WITH {PX} SELECT img, round(sum(image), 6) AS raw_flux, round(sqrt(sum(variance)), 6) AS raw_error FROM px WHERE {_dist(X0, Y0)} <= 2 GROUP BY img")
def aperture_sum_center(spark, d):
    return pixels.aperture_sum(A.pixels(spark, d), X0, Y0, 2.0).select("img", F.round("raw_flux", 6).alias("raw_flux"), F.round("raw_error", 6).alias("raw_error"))


@query(f"WITH {PX} SELECT img, coalesce(bit_or(flags) FILTER ((x - {X0}) * (x - {X0}) + (y - {Y0}) * (y - {Y0}) <= 4), 0)::int AS flag FROM px GROUP BY img")
def flag_or(spark, d):
    return pixels.flag_union(A.pixels(spark, d), X0, Y0, 2.0)


_BG = "b AS (SELECT img, median(image) AS m, stddev_pop(image) AS s FROM r3 GROUP BY img)"


def _window_sql(h: int) -> str:
    inside = f"y >= {math.floor(Y0 - h / 2)} AND y < {math.ceil(Y0 + h / 2)} AND x >= {math.floor(X0 - h / 2)} AND x < {math.ceil(X0 + h / 2)} AND {_dist(X0, Y0)} > {R + 0.707}::double"
    return f"""{PX}, w AS (SELECT *, {STRICT_SQL} AS ok, {RELAXED_SQL} AS loose FROM px WHERE {inside}), n AS (SELECT img, count(*) FILTER (ok) AS ns, count(*) FILTER (loose) AS nl FROM w GROUP BY img),
u AS (SELECT img, image FROM w JOIN n USING (img) WHERE CASE WHEN ns >= 10 THEN ok ELSE loose AND nl >= 10 END), k AS (SELECT img, count(*) AS n_usable FROM u GROUP BY img),
{_clip_sql("SELECT img, image FROM u", "img", "image", "", 3)}, {_BG}"""


@query(f"WITH {_window_sql(8)} SELECT img, round(m, 6) AS background, round(s / sqrt(n_usable), 6) AS error, n_usable FROM b JOIN k USING (img)")
def background_window(spark, d):
    b = pixels.window_background(A.pixels(spark, d), X0, Y0, R, size=(8, 8))
    return b.select("img", F.round("background", 6).alias("background"), F.round("error", 6).alias("error"), "n_usable")


def _annulus_sql(least: int) -> str:
    inner, tried = pixels.annulus_plan(X0, Y0, R, 8, 8, least=least)
    d = _dist(X0, Y0)
    rings = ", ".join(f"({d} >= {inner!r}::double AND {d} <= {o!r}::double AND {STRICT_SQL}) AS r{k}" for k, o in enumerate(tried))
    counts = ", ".join(f"count(*) FILTER (r{k}) AS n{k}" for k in range(len(tried)))
    last = len(tried) - 1
    loose = f"({d} >= {inner!r}::double AND {d} <= {tried[-1]!r}::double AND {RELAXED_SQL})" if len(tried) == 5 else f"r{last}"
    pick = "CASE " + " ".join(f"WHEN n{k} >= {least} THEN r{k}" for k in range(len(tried))) + f" ELSE {loose} END"
    return f"""{PX}, w AS (SELECT *, {rings} FROM px), n AS (SELECT img, {counts} FROM w GROUP BY img), u AS (SELECT img, image FROM w JOIN n USING (img) WHERE {pick}),
k AS (SELECT img, count(*) AS n_usable FROM u GROUP BY img), {_clip_sql("SELECT img, image FROM u", "img", "image", "", 3)}, {_BG}"""


@query(f"WITH {_annulus_sql(10)} SELECT img, round(m, 6) AS background, round(s / sqrt(n_usable), 6) AS error, n_usable FROM b JOIN k USING (img)")
def background_annulus(spark, d):
    b = pixels.annulus_background(A.pixels(spark, d), X0, Y0, R, nx=8, ny=8)
    return b.select("img", F.round("background", 6).alias("background"), F.round("error", 6).alias("error"), "n_usable")


_AREA = math.pi * R * R


@query(f"""WITH {_annulus_sql(10)}, a AS (SELECT img, sum(image) AS f, sqrt(sum(variance)) AS e FROM px WHERE {_dist(X0, Y0)} <= {R} GROUP BY img)
SELECT img, round((f - m * {_AREA!r}::double) * 38.44::double, 5) AS flux, round(sqrt(e * e + pow(s / sqrt(n_usable) * {_AREA!r}::double, 2)) * 38.44::double, 5) AS flux_error, n_usable FROM a JOIN b USING (img) JOIN k USING (img)""")
def aperture_full(spark, d):
    px = A.pixels(spark, d)
    p = pixels.photometry(px, pixels.annulus_background(px, X0, Y0, R, nx=8, ny=8), X0, Y0, R)
    return p.select("img", F.round("flux", 5).alias("flux"), F.round("flux_error", 5).alias("flux_error"), "n_usable")


@query(f"WITH {PX} SELECT img, (y - 2)::int AS y, (x - 1)::int AS x, round(image, 6) AS image FROM px WHERE y BETWEEN 2 AND 4 AND x BETWEEN 1 AND 5")
def pixel_cutout(spark, d):
    return pixels.cutout(A.pixels(spark, d), 3.5, 3.5, 3, 5).select("img", "y", "x", F.round("image", 6).alias("image"))


@query(f"WITH {PX} SELECT img, y, x, round(image, 6) AS image FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY image DESC, y, x) AS rn FROM px) WHERE rn = 1")
def psf_peak(spark, d):
    return pixels.peak(A.pixels(spark, d)).select("img", "y", "x", F.round("image", 6).alias("image"))


@query("""WITH z AS (SELECT n_nationkey + 1 AS z, 1 + (n_nationkey % 5) * 1.75::double AS cx, 1 + (n_nationkey // 5) * 1.75::double AS cy FROM nation), p AS (SELECT meas_id, pix_x / 255 AS x, pix_y / 255 AS y FROM lightcurve WHERE pix_x IS NOT NULL AND pix_y IS NOT NULL)
SELECT meas_id, z::int AS zone_id, round(dist, 9) AS zone_distance FROM (SELECT meas_id, z, sqrt((x + 1 - cx) * (x + 1 - cx) + (y + 1 - cy) * (y + 1 - cy)) AS dist, row_number() OVER (PARTITION BY meas_id ORDER BY sqrt((x + 1 - cx) * (x + 1 - cx) + (y + 1 - cy) * (y + 1 - cy)), z) AS rn FROM p, z) WHERE rn = 1""")
def psf_nearest_zone(spark, d):
    p = lc(spark, d).where("pix_x IS NOT NULL AND pix_y IS NOT NULL").select("meas_id", (F.col("pix_x") / 255).alias("x"), (F.col("pix_y") / 255).alias("y"))
    return pixels.nearest_zone(p, A.zones(spark, d)).select("meas_id", "zone_id", F.round("zone_distance", 9).alias("zone_distance"))


@query("""WITH r AS (SELECT meas_id, pix_x, pix_y, 1 + (meas_id % 30) / 10::double AS r FROM lightcurve)
SELECT meas_id, round(r + 1.414::double, 9) AS inner_radius, round(least(sqrt(10 / pi() + (r + 1.414::double) * (r + 1.414::double)), 5), 9) AS outer_radius,
  pix_x >= greatest(r, 5) AND pix_x < 2040 - greatest(r, 5) AND pix_y >= greatest(r, 5) AND pix_y < 2040 - greatest(r, 5) AS inside FROM r""")
def annulus_radii(spark, d):
    r = F.lit(1.0) + (F.col("meas_id") % 30) / 10.0
    a, b = S.annulus_radii(r)
    return lc(spark, d).select("meas_id", F.round(a, 9).alias("inner_radius"), F.round(b, 9).alias("outer_radius"), S.inside_margin(F.col("pix_x"), F.col("pix_y"), F.lit(2040), F.lit(2040), r).alias("inside"))


@query("SELECT meas_id, round(CASE WHEN isfinite(bandwidth) AND bandwidth > 0 AND meas_id % 5 > 0 THEN bandwidth * 300 / (6.2::double * (1 - (meas_id % 5 = 1)::int * 0.5::double)) * 1.25::double ELSE 1.5 END, 9) AS radius FROM lightcurve WHERE bandwidth IS NOT NULL")
def aperture_radius(spark, d):
    k = F.col("meas_id") % 5
    scale = F.when(k == 0, 0.0).when(k == 1, 3.1).otherwise(6.2)
    return lc(spark, d).where("bandwidth IS NOT NULL").select("meas_id", F.round(S.aperture_radius(F.col("bandwidth") * 300, scale), 9).alias("radius"))


_COS = "(sin(radians(decl)) * sin(radians(66.0::double)) + cos(radians(decl)) * cos(radians(66.0::double)) * cos(radians(ra - 268.0::double)))"


def _gnomonic(x: str) -> str:
    """A gnomonic coordinate in pixels, null behind the plane."""
    return f"CASE WHEN {_COS} > 0 THEN printf('%.6e', degrees({x} / {_COS}) / (6.2::double / 3600) + 1019.5::double) END"


@query(f"""SELECT source_id, {_gnomonic('-cos(radians(decl)) * sin(radians(ra - 268.0::double))')} AS pix_x,
  {_gnomonic('(sin(radians(decl)) * cos(radians(66.0::double)) - cos(radians(decl)) * sin(radians(66.0::double)) * cos(radians(ra - 268.0::double)))')} AS pix_y FROM sky_source""")
def wcs_world_to_pixel(spark, d):
    """Gnomonic pixel positions; sources in the other half of the sky have none."""
    s = A.sources(spark, d)
    ahead = F.sin(F.radians("dec")) * math.sin(math.radians(66.0)) + F.cos(F.radians("dec")) * math.cos(math.radians(66.0)) * F.cos(F.radians(F.col("ra") - 268.0)) > 0
    x, y = S.tangent_pixel(F.col("ra"), F.col("dec"), 268.0, 66.0, 6.2, (1020.5, 1020.5))
    return s.select("source_id", *[F.when(ahead, F.format_string("%.6e", v)).alias(n) for v, n in ((x, "pix_x"), (y, "pix_y"))])


def _overlap_table(r: float, size: int = 8) -> str:
    """VALUES of y, x and the pixel's area inside the circle, by integrating chords from kink to kink."""

    def under_arc(x: float) -> float:
        x = min(max(x, -r), r)
        return (x * math.sqrt(r * r - x * x) + r * r * math.asin(x / r)) / 2

    rows = []
    for y in range(size):
        for x in range(size):
            left, low = x - X0 - 0.5, y - Y0 - 0.5
            high = low + 1
            kinks = {left, left + 1} | {s * math.sqrt(r * r - v * v) for v in (0.0, low, high) if abs(v) < r for s in (-1, 1)}
            cuts = sorted(k for k in kinks if left <= k <= left + 1)
            total = 0.0
            for u, v in zip(cuts, cuts[1:]):
                half = math.sqrt(max(r * r - (u + v) ** 2 / 4, 0.0))
                if min(half, high) > max(-half, low):
                    arc = under_arc(v) - under_arc(u)
                    total += (arc if half < high else high * (v - u)) + (arc if -half > low else -low * (v - u))
            rows.append(f"({y}, {x}, {total!r}::double)")
    return f"o(y, x, w) AS (VALUES {', '.join(rows)})"


@query(f"WITH {PX}, {_overlap_table(2.0)} SELECT img, printf('%.5e', sum(w * image)) AS raw_flux, printf('%.5e', sqrt(sum(w * variance))) AS raw_error FROM px JOIN o USING (y, x) GROUP BY img")
def aperture_exact(spark, d):
    """Aperture sums with exact circle-pixel overlaps."""
    from skyloom.operators import apertures

    @F.pandas_udf("double")
    def weight(x, y):
        import pandas as pd

        return pd.Series(apertures.overlap(x - X0, y - Y0, 2.0))

    px = A.pixels(spark, d).withColumn("w", weight("x", "y"))
    return pixels.aperture_sum(px, X0, Y0, 2.0, F.col("w")).select("img", *[F.format_string("%.5e", c).alias(c) for c in ("raw_flux", "raw_error")])


@query()
def mef_photometry(spark, d):
    """Every embedding as the sky of a complete image file with a star, measured by the kernel."""
    import numpy as np

    from skyloom.sources import fits, mef

    def files(batches):
        import pyarrow as pa

        n, scale = 24, 6.2 / 3600
        yy, xx = np.mgrid[0:n, 0:n]
        star = np.exp(-((xx - 12) ** 2 + (yy - 11) ** 2) / 2)
        pp = np.mgrid[0:21, 0:21] - 10
        psf = np.exp(-(pp**2).sum(axis=0) / 18).astype("f4")[None]
        for b in batches:
            out = []
            for key, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sky = np.kron(np.asarray(v, float).reshape(8, 8), np.ones((3, 3))) * 0.05 + 1
                head = {"EXTNAME": "IMAGE", "BUNIT": "MJy/sr", "OBSID": f"v{key}", "DETECTOR": key % 7, "MJD-BEG": 61000.0 + key, "MJD-END": 61000.1 + key, "CRPIX1": 13.0, "CRPIX2": 12.0, "CRVAL1": 150.0, "CRVAL2": 20.0, "CD1_1": -scale, "CD2_2": scale}
                planes = [fits.Hdu(head, (sky + 20 * star).astype("f4")), *[fits.Hdu({"EXTNAME": k}, a) for k, a in (("FLAGS", np.zeros((n, n), "i4")), ("VARIANCE", np.full((n, n), 0.01, "f4")), ("ZODI", np.full((n, n), 0.3, "f4")))]]
                out.append(fits.write([fits.Hdu(), *planes, fits.Hdu({"EXTNAME": "PSF", "OVERSAMP": 10, "XCTR_1": 12.0, "YCTR_1": 12.0}, psf), fits.Hdu({"EXTNAME": "NONE"})]))
            yield pa.RecordBatch.from_arrays([pa.array([f"v{k}.fits" for k in b.column(0).to_pylist()]), pa.array(out, pa.binary())], names=["path", "content"])

    made = table(spark, d, "embeddings").select("vec_id", "embedding").repartition(8, "vec_id").mapInArrow(files, "path string, content binary")
    star = spark.createDataFrame([(1, 150.0, 20.0)], "source_id bigint, ra double, dec double")
    return mef.photometry(made, star, keep_problems=True)


@query("SELECT strftime(loaded_at, '%Y-%m-%d') AS day, band, count(*) AS n FROM lightcurve GROUP BY ALL")
def arrivals_by_day(spark, d):
    """The streaming count of deliveries, over the whole table as a batch."""
    from skyloom.streaming.landing import arrivals

    return arrivals(lc(spark, d)).select(F.date_format("since", "yyyy-MM-dd").alias("day"), "band", "n")

