"""Queries of the data-quality operators (problems 2 to 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators import compact, profile, regrid, spikes
from skyloom.session import run_dir, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.gone_wrong(profile.load_changes(table(spark, d, "lightcurve"), profile.lightcurve_rules()))


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    p = profile.profile(spark, table(spark, d, "lightcurve"), profile.lightcurve_rules())
    return p.select("load_id", "column_name", "n_rows", "n_null", "n_nan", "n_broken", "min", "max", F.round("null_rate", 9).alias("null_rate"), "n_distinct")


def p2_footers(spark: SparkSession, d: str) -> DataFrame:
    return profile.footer_profile(spark, table(spark, d, "lightcurve"), ["mag_ab", "flag", "wavelength", "snr"])


def p2_footer_extrema(spark: SparkSession, d: str) -> DataFrame:
    """What footers and, where they don't do, scans say of each load's columns."""
    return p2_footers(spark, d).select("load_id", "column_name", "n_rows", "n_null", "min", "max", "n_distinct")


def p2_layout(spark: SparkSession, d: str) -> DataFrame:
    """The footers' profile of the table written by load; ``flag`` then needs hardly a row read."""
    by_load = profile.written_by_load(table(spark, d, "lightcurve").select("load_id", "mag_ab", "flag", "wavelength", "snr"), run_dir(spark, "by-load"))
    return profile.footer_profile(spark, by_load, ["mag_ab", "flag", "wavelength", "snr"])


def p2_layout_profile(spark: SparkSession, d: str) -> DataFrame:
    return p2_layout(spark, d).drop("scanned_share")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible(table(spark, d, "lightcurve")).select("source_id", "obs_id", "band")


def p4_grid(spark: SparkSession, d: str) -> DataFrame:
    return regrid.regular_grid(table(spark, d, "lightcurve"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return regrid.empty_periods(p4_grid(spark, d))


def p4_flux(spark: SparkSession, d: str) -> DataFrame:
    """The regression's values, to five digits as text."""
    return p4_grid(spark, d).where("flux IS NOT NULL").select("source_id", "band", "period_no", F.format_string("%.4e", "flux").alias("flux"))


def p4_support(spark: SparkSession, d: str) -> DataFrame:
    return p4_grid(spark, d).select("source_id", "band", "period_no", "n_readings", "period_mid", F.round("support", 6).alias("support"), "status")


def p5_compacted(spark: SparkSession, d: str) -> DataFrame:
    """The compacted records, read back from the files that were swapped in."""
    at = run_dir(spark, "records")
    compact.compact(table(spark, d, "small_file"), at)
    return spark.read.parquet(at)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return compact.repeated(p5_compacted(spark, d))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """Every compacted record with the number of its lines and of their variants."""
    return p5_compacted(spark, d)


def p5_rejects(spark: SparkSession, d: str) -> DataFrame:
    """The non-blank lines that hold no record."""
    at, rejects = run_dir(spark, "records"), run_dir(spark, "rejects")
    compact.compact(table(spark, d, "small_file"), at, rejects=rejects)
    return spark.read.parquet(rejects)


QUERIES = {f.__name__: f for f in (p2_found, p2_profile, p2_footers, p2_footer_extrema, p2_layout, p2_layout_profile, p3_found, p4_found, p4_grid, p4_flux, p4_support, p5_found, p5_records, p5_rejects)}

_COLUMN = """
SELECT load_id, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null,
  count(*) FILTER (isnan({c}::double)) AS n_nan,
  count(*) FILTER ({c} IS NOT NULL AND (isnan({c}::double) OR NOT ({rule}))) AS n_broken,
  min({c}::double) FILTER (NOT isnan({c}::double)) AS min, max({c}::double) FILTER (NOT isnan({c}::double)) AS max,
  round((count(*) - count({c})) / count(*)::double, 9) AS null_rate, count(DISTINCT {c}::double) FILTER (NOT isnan({c}::double)) AS n_distinct
FROM lightcurve GROUP BY load_id"""
_LO = "coalesce(CASE band " + " ".join(f"WHEN '{b}' THEN {x}::double - 0.02::double" for b, (x, _) in profile.BAND_BOUNDS.items()) + " END, 0.7::double)"
_HI = "coalesce(CASE band " + " ".join(f"WHEN '{b}' THEN {y}::double + 0.02::double" for b, (_, y) in profile.BAND_BOUNDS.items()) + " END, 5.1::double)"

_READINGS = """
r AS (SELECT source_id, band, obs_id, min(mjd) AS mjd FROM lightcurve
      WHERE band IN ('D1','D2','D3','D4','D5','D6') AND mjd >= 61041 AND mjd < 61761 AND flux IS NOT NULL AND isfinite(flux)
      GROUP BY ALL),
own AS (SELECT source_id, band, floor((mjd - 61041) / 10)::int AS p, count(*) AS n FROM r GROUP BY ALL),
ends AS (SELECT source_id, band, min(p) AS a, max(p) AS b FROM own GROUP BY ALL),
grid AS (SELECT source_id, band, unnest(generate_series(a, b))::int AS p FROM ends)"""

SQL = {
    "p2_profile": " UNION ALL ".join(
        _COLUMN.format(c=c, rule=rule)
        for c, rule in {
            "mag_ab": "mag_ab BETWEEN -5 AND 40",
            "flag": "flag BETWEEN 0 AND 4194303",
            "wavelength": f"wavelength BETWEEN {_LO} AND {_HI}",
            "snr": "isfinite(snr)",
        }.items()
    ),
    "p4_found": f"WITH {_READINGS} SELECT source_id, band, p AS period_no FROM grid ANTI JOIN own USING (source_id, band, p)",
    "p4_support": f"""WITH {_READINGS},
w AS (SELECT g.source_id, g.band, g.p, greatest(1 - pow(((mjd - 61041) / 10 - (g.p + 0.5::double)) / 2, 2), 0) AS w
      FROM r JOIN grid g ON g.source_id IS NOT DISTINCT FROM r.source_id AND g.band = r.band AND abs((mjd - 61041) / 10 - (g.p + 0.5::double)) <= 2),
s AS (SELECT source_id, band, p, CASE WHEN sum(w) > 0 THEN sum(w) * sum(w) / sum(w * w) ELSE 0 END AS s FROM w GROUP BY ALL)
SELECT g.source_id, g.band, g.p AS period_no, coalesce(n, 0) AS n_readings, 61041 + (g.p + 0.5::double) * 10 AS period_mid,
  round(coalesce(s, 0), 6) AS support,
  CASE WHEN n > 0 THEN 'observed' WHEN coalesce(s, 0) >= 2 THEN 'filled' ELSE 'missing' END AS status
FROM grid g LEFT JOIN own o ON g.source_id IS NOT DISTINCT FROM o.source_id AND g.band = o.band AND g.p = o.p
LEFT JOIN s ON g.source_id IS NOT DISTINCT FROM s.source_id AND g.band = s.band AND g.p = s.p""",
}
SQL["p2_footer_extrema"] = " UNION ALL ".join(
    f"""SELECT load_id, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null,
min({c}::double) FILTER (NOT isnan({c}::double)) AS min, max({c}::double) FILTER (NOT isnan({c}::double)) AS max,
count(DISTINCT {c}::double) FILTER (NOT isnan({c}::double)) AS n_distinct FROM lightcurve GROUP BY load_id"""
    for c in ("mag_ab", "flag", "wavelength", "snr")
)
SQL["p2_layout_profile"] = SQL["p2_footer_extrema"]
SQL["p4_flux"] = f"""WITH {_READINGS.replace("min(mjd) AS mjd FROM", "min(mjd) AS mjd, arg_min(flux, (mjd, flux)) AS flux FROM")},
w AS (SELECT g.source_id, g.band, g.p, (mjd - 61041) / 10 - (g.p + 0.5::double) AS d, greatest(1 - pow(((mjd - 61041) / 10 - (g.p + 0.5::double)) / 2, 2), 0) AS w, flux
      FROM r JOIN grid g ON g.source_id IS NOT DISTINCT FROM r.source_id AND g.band = r.band AND abs((mjd - 61041) / 10 - (g.p + 0.5::double)) <= 2),
s AS (SELECT source_id, band, p, sum(w) AS s0, sum(w * w) AS q, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * flux) AS t0, sum(w * d * flux) AS t1 FROM w GROUP BY ALL)
SELECT source_id, band, p AS period_no, printf('%.4e', CASE WHEN s0 * s2 - s1 * s1 > 1e-9::double * s0 * s0 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END) AS flux
FROM s LEFT JOIN own USING (source_id, band, p) WHERE s0 > 0 AND (n > 0 OR s0 * s0 / q >= 2)"""
_LINES = r"""
WITH l AS (SELECT trim(unnest(string_split_regex(payload, '\r\n|\n|\r')), E' \t\r\n﻿') AS l FROM small_file)"""
_RECORDS = _LINES + r""",
j AS (SELECT l::json AS j FROM l WHERE json_valid(l) AND l LIKE '{%}'),
k AS (SELECT upper(trim(j->>'obs_id')) AS obs_id, trim(j->>'band') AS band, nullif(regexp_extract(j->>'download_url', '/(pv[^/]*)/', 1), '') AS proc_version,
  (j->>'mjd')::double AS mjd, (j->>'wavelength_min')::double AS wavelength_min, (j->>'wavelength_max')::double AS wavelength_max,
  j->>'download_url' AS download_url, (j->>'t_min')::double AS t_min, (j->>'t_max')::double AS t_max FROM j)
"""
_REST = ("mjd", "wavelength_min", "wavelength_max", "download_url", "t_min", "t_max")
SQL["p5_found"] = _RECORDS + "SELECT obs_id, band, proc_version FROM k GROUP BY ALL HAVING count(*) > 1"
SQL["p5_rejects"] = _LINES + " SELECT l AS line FROM l WHERE l <> '' AND NOT (json_valid(l) AND l LIKE '{%}')"
SQL["p5_records"] = f"""{_RECORDS},
v AS (SELECT *, count(*) AS n FROM k GROUP BY ALL),
o AS (SELECT *, {" + ".join(f"({c} IS NULL)::int" for c in _REST)} AS nulls FROM v)
SELECT obs_id, band, proc_version, (sum(n) OVER w)::bigint AS n_lines, count(*) OVER w AS n_variants, {", ".join(_REST)} FROM o
WINDOW w AS (PARTITION BY obs_id, band, proc_version)
QUALIFY row_number() OVER (PARTITION BY obs_id, band, proc_version ORDER BY nulls, {", ".join(f"{c} NULLS FIRST" for c in _REST)}) = 1"""
