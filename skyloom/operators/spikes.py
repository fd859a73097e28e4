"""Implausible readings: phase-space thresholding, stuck runs and bounds.

A series (source and band) is looked at in order of time, in numpy over many series
at once. Series longer than ``block`` readings are cut by count into consecutive blocks of
about that length, each with a margin of readings of its neighbours, so no task holds
more than a block of any series however large the series is and however its readings
lie in time. Order, runs and running
medians are the block's; usual error, thresholds of the ellipsoid, spread and the share
that departs are those of the whole series (``whole_series``) and handed to its blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.functions.logbuckets import is_finite
from skyloom.operators.selection import exact_quantiles
from skyloom.session import bounded_broadcast, checkpointed

BANDS = ("D1", "D2", "D3", "D4", "D5", "D6")
KEYS = ["source_id", "band"]
RESULT = "source_id bigint, obs_id string, band string, spike boolean, stuck boolean, error_spike boolean, level double, spread double"


def implausible(readings: DataFrame, *, start: float = 61041.0, end: float = 61761.0, bands: tuple[str, ...] = BANDS, block: int = 20_000, margin: int = 32, **how) -> DataFrame:
    """source_id, obs_id, band, spike, stuck, error_spike, impossible: one row per reading
    with at least one of the four true.

    ``readings`` needs source_id, obs_id, band, mjd, flux, flux_error. Deliveries of the
    same (source_id, obs_id, band) are one reading. Rows with a null source_id or
    obs_id, or a band that isn't in ``bands``, are no readings and never listed. Null fields
    are missing: they make no reading implausible; one without mjd has no place in
    its series and is only held against the bounds, that below zero among them. Readings within
    60 microseconds are in the order of a hash of obs_id.

    impossible: flux or flux_error NaN or infinite, flux_error <= 0, mjd NaN or
    outside [start, end), flux further below zero than ``how["below"]`` times both its
    error and the series' spread. The others: see ``judge``.
    """
    r = readings.select(F.col("source_id").cast("long").alias("source_id"), "obs_id", "band", *[F.col(c).cast("double").alias(c) for c in ("mjd", "flux", "flux_error")]).where(
        F.col("source_id").isNotNull() & F.col("obs_id").isNotNull() & F.col("band").isin(*bands)
    )
    m, f, e = F.col("mjd"), F.col("flux"), F.col("flux_error")
    inside = (m >= start) & (m < end)
    bad = (m.isNotNull() & ~inside) | (f.isNotNull() & ~is_finite(f)) | (e.isNotNull() & (~is_finite(e) | (e <= 0)))
    bounds = r.where(bad).select("source_id", "obs_id", "band", F.lit(True).alias("impossible"))
    # Readings without a place come along where their flux may be too far below zero.
    placed = (
        r.where(F.when(inside, f.isNotNull() | e.isNotNull()).otherwise(is_finite(f) & (f < 0)))
        .withColumn("code", F.when(inside, order_code(m, F.col("obs_id"), start, end)))
        .drop("mjd")
    )
    long = long_series(placed, block)
    if long.isEmpty():
        series = placed.withColumn("blk", F.lit(0)).withColumn("core", F.lit(True))
    else:
        cut = checkpointed(blocks_of(placed.join(bounded_broadcast(long), KEYS), block, margin))
        given = bounded_broadcast(whole_series(cut, **how))
        short = placed.join(bounded_broadcast(long).select(*KEYS), KEYS, "left_anti").withColumn("blk", F.lit(0).cast("long")).withColumn("core", F.lit(True))
        series = short.withColumn("given", F.lit(None).cast("array<double>")).unionByName(cut.join(given, KEYS, "left"))
    found = judged(series, **how)
    # Only what was found is grouped: deliveries of a reading, and both kinds of finding.
    flags = ("spike", "stuck", "error_spike")
    both = found.select("source_id", "obs_id", "band", *flags, F.col("impossible")).unionByName(bounds.select("source_id", "obs_id", "band", *[F.lit(False).alias(c) for c in flags], "impossible"))
    return both.groupBy("source_id", "obs_id", "band").agg(*[F.bool_or(c).alias(c) for c in (*flags, "impossible")])


#: Bits of an order code: time in steps of 2^-40 of the survey (60 microseconds), then a hash.
TIME_BITS, HASH_BITS = 40, 20


def order_code(mjd: Column, obs_id: Column, start: float, end: float) -> Column:
    """A reading's place in the order of a series, as a long below 2^60: time, then a hash of obs_id."""
    time = F.floor((mjd - F.lit(start)) / F.lit(end - start) * F.lit(float(1 << TIME_BITS))).cast("long")
    return F.shiftleft(time, HASH_BITS) + F.pmod(F.xxhash64(obs_id), F.lit(1 << HASH_BITS))


def long_series(r: DataFrame, block: int) -> DataFrame:
    """source_id, band and n of the series of more than ``block`` rows, of which there are at most rows over ``block``."""
    return checkpointed(r.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block))


def in_blocks(r: DataFrame, start: float, end: float, block: int, margin: int) -> DataFrame:
    """``r`` with columns code, ``blk`` and ``core``; series of at most ``block`` rows are block 0 (see ``blocks_of``)."""
    r = r.withColumn("code", order_code(F.col("mjd"), F.col("obs_id") if "obs_id" in r.columns else F.lit(""), start, end))
    long = long_series(r, block)
    short = r.join(bounded_broadcast(long).select(*KEYS), KEYS, "left_anti").withColumn("blk", F.lit(0).cast("long")).withColumn("core", F.lit(True))
    return short.unionByName(blocks_of(r.join(bounded_broadcast(long), KEYS), block, margin))


def blocks_of(r: DataFrame, block: int, margin: int) -> DataFrame:
    """Rows of long series (with column n, their rows) without copies, each in its block and, with
    core false, in a neighbouring one if fewer than ``margin`` rows lie between.

    A series is counted in slots of its order code, at first 32 to a block of evenly spread
    rows; slots of more than a sixteenth of a block are split into 256, as often as need be.
    At the end only copies of a row have equal codes (but for a coincidence of hashes), and these
    are taken out first. Blocks are made of whole slots by their running count, so
    they hold at most block / 16 rows more than ``block``, and what is
    ordered is slots, not rows. Rows without a code are in the first slot.
    """
    if 2 * margin > block:
        raise ValueError("margin must be at most half a block")
    bits = TIME_BITS + HASH_BITS
    shift = F.greatest(F.lit(bits) - F.ceil(F.log2(32.0 * F.col("n") / F.lit(block))), F.lit(0)).cast("int")

    def slot() -> Column:
        return F.expr("shiftleft(shiftright(coalesce(code, 0L), _shift), _shift)")

    rows = checkpointed(r.dropDuplicates([c for c in r.columns if c != "n"]).withColumn("_shift", shift).drop("n").withColumn("_slot", slot()))
    while True:
        counts = checkpointed(rows.groupBy(*KEYS, "_slot", "_shift").agg(F.count(F.lit(1)).alias("_n")))
        full = counts.where((F.col("_n") > block / 16) & (F.col("_shift") > 0)).select(*KEYS, "_slot", F.lit(True).alias("_full"))
        if full.isEmpty():
            break
        finer = rows.join(bounded_broadcast(full), [*KEYS, "_slot"], "left").withColumn("_shift", F.when(F.col("_full"), F.greatest(F.col("_shift") - 8, F.lit(0))).otherwise(F.col("_shift")))
        rows = checkpointed(finer.drop("_full", "_slot").withColumn("_slot", slot()))
    order = Window.partitionBy(*KEYS).orderBy("_slot")
    upto = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    of = Window.partitionBy(*KEYS, "_blk")
    slots = (
        counts.withColumn("_end", upto)
        .withColumn("_blk", F.floor((F.col("_end") - F.col("_n")) / F.lit(block)).cast("long"))
        .withColumn("_first", F.min(F.col("_end") - F.col("_n")).over(of))
        .withColumn("_last", F.max("_end").over(of))
        .withColumn("_final", F.max("_blk").over(Window.partitionBy(*KEYS)))
    )
    b = F.col("_blk")
    near = F.array(
        F.when((b > 0) & (F.col("_end") - F.col("_n") - F.col("_first") < margin), b - 1),
        b,
        F.when((b < F.col("_final")) & (F.col("_last") - F.col("_end") < margin), b + 1),
    )
    blocks = slots.select(*KEYS, "_slot", "_blk", near.alias("_near"))
    return (
        rows.join(bounded_broadcast(checkpointed(blocks)), [*KEYS, "_slot"])
        .withColumn("blk", F.explode(F.array_compact("_near")))
        .withColumn("core", F.col("blk") == F.col("_blk"))
        .drop("_slot", "_shift", "_blk", "_near")
    )


FOUND = "source_id bigint, obs_id string, band string, spike boolean, stuck boolean, error_spike boolean, impossible boolean, level double, spread double"


#: Figures of a whole series that ``judge`` takes instead of its own, in the order of the column ``given``.
GIVEN = ("usual", "n", "median", "theta", "x", "d1", "z", "u", "spread", "own", "own_spread")
TRACE = "source_id bigint, band string, flux double, level double, ok boolean, plain boolean, u double, d1 double, d2 double"


def whole_series(cut: DataFrame, *, times: float = 8.0, usual_share: float = 0.1, **how) -> DataFrame:
    """source_id, band, given: the figures ``GIVEN`` of each series of ``cut``, the blocks of long series.

    Three passes, each with the figures of those before: the usual error; with each
    block's own ordinary readings the ellipsoid that leaves out candidates;
    with the ordinary readings that follow from these the spread and the departing
    share. Counts, sums and medians are exact and of the whole series.
    """
    how = how | {"times": times, "usual_share": usual_share}
    once = cut.where("core AND code IS NOT NULL").groupBy(*KEYS, "obs_id").agg(F.min(F.struct("code", F.col("flux").isNull().alias("no_f"), "flux", F.col("flux_error").isNull().alias("no_e"), "flux_error")).alias("r"))
    error = once.where("r.flux_error > 0").select(*KEYS, F.col("r.flux_error").alias("e"))
    known = cut.select(*KEYS).distinct().join(exact_quantiles(error, KEYS, "e", {"usual": 0.5}).drop("n"), KEYS, "left")

    def handed(g: DataFrame) -> DataFrame:
        return g.select(*KEYS, F.array(*[(F.col(c) if c in g.columns else F.lit(None)).cast("double") for c in GIVEN]).alias("given"))

    def traced(g: DataFrame) -> DataFrame:
        return checkpointed(judged(cut.join(bounded_broadcast(handed(g)), KEYS), trace=True, **how))

    known = checkpointed(known)
    t = traced(known)
    known = checkpointed(known.join(t.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")), KEYS, "left").join(_ellipsoids(t), KEYS, "left"))
    t = traced(known)
    spread = checkpointed(t.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.when(F.count_if("ok") >= 4, F.stddev_samp(F.when(F.col("ok"), F.col("flux")))).alias("spread")))
    axes = F.expr(f"pow(u / ({_reach_sql('n', times)} * spread), 2) + 2 * pow(d1 / ({_reach_sql('n', times)} * spread), 2) + pow((d2 + 2 * u) / ({_reach_sql('n', times)} * spread), 2) / 2")
    far = F.coalesce(F.col("plain") & (F.col("spread") > 0) & (axes > 1), F.lit(False))
    own = (
        t.join(bounded_broadcast(spread), KEYS)
        .groupBy(*KEYS)
        .agg((F.count_if(far) > F.greatest(usual_share * F.count(F.lit(1)), F.lit(3))).alias("own"), F.stddev_samp(F.when(F.col("ok") | far, F.col("flux"))).alias("own_spread"))
    )
    return checkpointed(handed(known.join(spread.drop("n"), KEYS, "left").join(own, KEYS, "left")))


def _ellipsoids(t: DataFrame) -> DataFrame:
    """Rotation and median absolute deviations of ``_candidates`` over the whole series, and the median flux."""
    turn = checkpointed(t.groupBy(*KEYS).agg(F.atan2(F.sum(F.when(F.col("ok"), F.col("u") * F.col("d2"))), F.sum(F.when(F.col("ok"), F.col("u") * F.col("u")))).alias("theta")))
    c, s = F.cos("theta"), F.sin("theta")
    v = {"median": F.col("flux"), "x": F.col("u") * c + F.col("d2") * s, "d1": F.col("d1"), "z": F.col("d2") * c - F.col("u") * s, "u": F.col("u")}
    each = t.where("ok").join(bounded_broadcast(turn), KEYS).select(*KEYS, F.explode(F.array(*[F.struct(F.lit(k).alias("name"), x.alias("v")) for k, x in v.items()])).alias("x")).select(*KEYS, "x.*")
    mid = checkpointed(exact_quantiles(each, [*KEYS, "name"], "v", {"m": 0.5}).drop("n"))
    off = each.where(F.col("name") != "median").join(bounded_broadcast(mid), [*KEYS, "name"]).select(*KEYS, "name", F.abs(F.col("v") - F.col("m")).alias("v"))
    mad = exact_quantiles(off, [*KEYS, "name"], "v", {"m": 0.5}).select(*KEYS, "name", (1.4826 * F.col("m")).alias("m"))
    every = mid.where(F.col("name") == "median").unionByName(mad)
    wide = every.groupBy(*KEYS).agg(*[F.max(F.when(F.col("name") == k, F.col("m"))).alias(k) for k in v])
    return wide.join(turn, KEYS)


def judged(series: DataFrame, at_once: int = 100_000, trace: bool = False, **how) -> DataFrame:
    """The readings of ``series`` (from ``in_blocks``) that ``judge`` finds.

    A column ``given`` holds what is known of the whole series, null for series in one
    block. trace: what ``whole_series`` needs of each reading instead.
    """
    if "given" not in series.columns:
        series = series.withColumn("given", F.lit(None).cast("array<double>"))
    cols = ["source_id", "band", "blk", "code", "obs_id", "flux", "flux_error", "core", "given"]
    ready = series.select(*cols).repartition("source_id", "band", "blk").sortWithinPartitions("source_id", "band", "blk", "code", "obs_id", F.col("flux").asc_nulls_last(), F.col("flux_error").asc_nulls_last())

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < at_once:
                continue
            t = pa.Table.from_batches(held)
            cut = _last_series(t)
            if cut == 0:  # one block only so far; blocks are bounded
                continue
            yield from _judge_table(t.slice(0, cut), how, trace)
            held = t.slice(cut).combine_chunks().to_batches()
            rows = sum(x.num_rows for x in held)
        if rows:
            yield from _judge_table(pa.Table.from_batches(held), how, trace)

    return ready.mapInArrow(run, TRACE if trace else FOUND)


def _codes(t: pa.Table) -> np.ndarray:
    """True where a row's series differs from the row before."""
    new = np.ones(t.num_rows, bool)
    if t.num_rows > 1:
        same = np.ones(t.num_rows - 1, bool)
        for c in ("source_id", "blk"):
            v = t[c].to_numpy()
            same &= v[1:] == v[:-1]
        b = t["band"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new[1:] = ~(same & (b[1:] == b[:-1]))
    return new


def _last_series(t: pa.Table) -> int:
    """Where the last series of a sorted table begins."""
    return int(np.flatnonzero(_codes(t))[-1])


def _judge_table(t: pa.Table, how: dict, trace: bool = False):
    t = t.combine_chunks()
    new = _codes(t)
    obs = t["obs_id"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    again = np.zeros(len(new), bool)
    again[1:] = (obs[1:] == obs[:-1]) & ~new[1:]
    # Deliveries of one reading follow each other: they have one mjd. The smallest flux counts.
    keep = ~again
    seg = np.cumsum(new)[keep] - 1
    flux, err = (t[c].to_numpy(zero_copy_only=False)[keep] for c in ("flux", "flux_error"))
    loose = np.asarray(t["code"].combine_chunks().is_null())[keep]
    lost, lost_e = np.where(loose, flux, np.nan), np.where(loose, err, np.nan)
    flux, err = np.where(loose, np.nan, flux), np.where(loose, np.nan, err)
    none = [None] * len(GIVEN)
    given = np.array([x or none for x in t["given"].take(pa.array(np.flatnonzero(new))).to_pylist()], float).reshape(-1, len(GIVEN))
    r = judge(seg, flux, err, given={k: given[seg, i] for i, k in enumerate(GIVEN)}, trace=trace, **how)
    core = t["core"].to_numpy(zero_copy_only=False)[keep]
    if loose.any() and not trace:
        s = _Series(seg)
        spread, usual = (np.fmax.reduceat(r[k], s.start)[s.id] for k in ("spread", "usual"))
        with np.errstate(invalid="ignore"):
            e = np.where(np.isfinite(lost_e) & (lost_e > 0) & ~(lost_e >= how.get("error_times", 8.0) * usual), lost_e, usual)
            r["impossible"] |= loose & (lost < -how.get("below", 6.0) * np.fmax(e, spread))
    if trace:
        hit = core & np.isfinite(flux)
        out = t.select(["source_id", "band"]).take(pa.array(np.flatnonzero(keep)[hit]))
        names = ("level", "ok", "plain", "u", "d1", "d2")
        yield pa.RecordBatch.from_arrays([out["source_id"].combine_chunks(), out["band"].combine_chunks(), pa.array(flux[hit]), *[pa.array(r[k][hit]) for k in names]], names=["source_id", "band", "flux", *names])
        return
    hit = (r["spike"] | r["stuck"] | r["error_spike"] | r["impossible"]) & core
    at = np.flatnonzero(keep)[hit]
    out = t.take(pa.array(at))
    yield pa.RecordBatch.from_arrays(
        [out["source_id"].combine_chunks(), out["obs_id"].combine_chunks(), out["band"].combine_chunks(), *[pa.array(r[k][hit]) for k in ("spike", "stuck", "error_spike", "impossible", "level", "spread")]],
        names=["source_id", "obs_id", "band", "spike", "stuck", "error_spike", "impossible", "level", "spread"],
    )


class _Series:
    """Segmented statistics over values sorted by series."""

    def __init__(self, seg: np.ndarray):
        self.n = len(seg)
        self.start = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]]) if self.n else np.zeros(0, int)
        self.size = np.diff(np.r_[self.start, self.n])
        self.id = np.repeat(np.arange(len(self.start)), self.size)

    def sum(self, v):
        return np.bincount(self.id, v, minlength=len(self.start))

    def median(self, v, ok):
        """Median of v where ok, per series; NaN without any."""
        x = np.where(ok, v, np.inf)
        s = x[np.lexsort((x, self.id))]
        n = self.sum(ok.astype(float)).astype(int)
        lo, hi = self.start + np.maximum((n - 1) // 2, 0), self.start + np.minimum(n // 2, np.maximum(self.size - 1, 0))
        with np.errstate(invalid="ignore"):
            return np.where(n > 0, (s[lo] + s[hi]) / 2, np.nan)

    def rolling_median(self, v, ok, half):
        """Median of v where ok over the readings within ``half`` places; NaN if fewer than 3."""
        out = np.full(self.n, np.nan)
        if not self.n:
            return out
        # Between series lies a gap of ``half`` places that count as not ok.
        place = np.arange(self.n) + half * (self.id + 1)
        padded = np.full(self.n + half * (len(self.start) + 1), np.inf)
        padded[place] = np.where(ok, v, np.inf)
        windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1)
        step = max(1, 1_500_000 // (2 * half + 1))
        for a in range(0, self.n, step):
            w = np.sort(windows[place[a : a + step] - half], axis=1)
            n = np.isfinite(w).sum(axis=1)
            r = np.arange(len(w))
            with np.errstate(invalid="ignore"):
                out[a : a + step] = np.where(n >= 3, w[r, np.maximum((n - 1) // 2, 0)] / 2 + w[r, np.minimum(n // 2, 2 * half)] / 2, np.nan)
        return out

    def phase(self, u, ok, lag):
        """First and second difference of u over ``lag`` places; what isn't ok or there counts as 0."""
        v = np.where(ok, u, 0.0)
        a, b = np.zeros(self.n), np.zeros(self.n)
        if self.n > lag:
            same = self.id[lag:] == self.id[:-lag]
            a[lag:] = np.where(same, v[:-lag], 0.0)
            b[:-lag] = np.where(same, v[lag:], 0.0)
        return (b - a) / 2, b - 2 * u + a

    def runs(self, flag):
        """Length of the run of equal flags within the series, for every place."""
        if not self.n:
            return np.zeros(0, int)
        new = np.r_[True, (flag[1:] != flag[:-1]) | (self.id[1:] != self.id[:-1])]
        k = np.cumsum(new) - 1
        return np.bincount(k)[k]


def judge(
    seg: np.ndarray, flux: np.ndarray, err: np.ndarray, *, times: float = 8.0, error_times: float = 8.0, longest: int = 3, stuck: int = 4, equal: float = 1e-6, below: float = 6.0, half: int = 7, rounds: int = 12, usual_share: float = 0.1, given: dict[str, np.ndarray] | None = None, trace: bool = False
) -> dict[str, np.ndarray]:
    """Judge readings sorted by series ``seg`` and time; NaN flux or err means missing.

    stuck: in a run of at least ``stuck`` readings whose flux stays within ``equal`` (relative).
    error_spike: err at least ``error_times`` the series' median error, in a run of at
    most ``longest`` such readings.
    spike: phase-space thresholding. A place is value u (flux less its running median),
    first and second difference over ``longest`` + 1 readings, so that all readings of a
    spike have ordinary ones at both ends. Rounds: what lies outside a robust ellipsoid
    (median absolute deviations times the universal threshold sqrt(2 ln n), the
    value-curvature plane turned by their regression) is left out of level, deviations
    and spread until none is new; a departure of more than ``longest`` readings only at the
    end, as the level must first follow what lasts. Then the ellipsoid is that of the spread, the standard deviation of
    the ordinary readings left (noise and own variation): ``times`` (less one standard
    error, see ``_reach``) its axes, that of the value as long as the spread and the
    others as ordinary readings' differences then are. A reading outside is a
    spike if no more than ``longest`` consecutive readings stay off by half as much on the
    same side. If more than ``usual_share``
    of a series (and more than 3 readings) departs, that counts as its own variation.
    Series of fewer than 4 ordinary readings have no spikes.
    impossible: flux below minus ``below`` times both error and spread.
    given: figures of ``GIVEN`` for each reading, used where they aren't NaN. trace: more
    of what was computed (``whole_series``).
    """
    n = len(flux)
    s_all = _Series(seg)
    have_e = np.isfinite(err) & (err > 0)
    given = given or {k: np.full(n, np.nan) for k in GIVEN}
    usual = _known(given["usual"], s_all, s_all.median(err, have_e))[s_all.id] if n else err
    with np.errstate(invalid="ignore", divide="ignore"):
        high = have_e & (err >= error_times * usual)
    out = {k: np.zeros(n, bool) for k in ("spike", "stuck", "error_spike", "impossible")} | {k: np.full(n, np.nan) for k in ("level", "spread")} | {"usual": usual}
    at_e = np.flatnonzero(np.isfinite(err))
    if len(at_e):
        s_e = _Series(seg[at_e])
        out["error_spike"][at_e] = high[at_e] & (s_e.runs(high[at_e]) <= longest)
    if trace:
        out |= {k: np.zeros(n, bool) for k in ("ok", "plain")} | {k: np.full(n, np.nan) for k in ("u", "d1", "d2")}
    at = np.flatnonzero(np.isfinite(flux))
    if not len(at):
        return out
    with np.errstate(all="ignore"):
        # Errors that are high for long are no error spikes; the flux beside them counts.
        sound = ~out["error_spike"][at]
        spike, still, level, spread, ok, plain = _judge_flux(seg[at], flux[at], sound & (have_e[at] | ~np.isfinite(err[at])), times, longest, stuck, equal, half, rounds, usual_share, {k: v[at] for k, v in given.items()})
        e = np.where(have_e[at] & ~high[at], err[at], usual[at])
        out["impossible"][at] = flux[at] < -below * np.fmax(e, spread)
        if trace:
            s = _Series(seg[at])
            u = flux[at] - level
            out["ok"][at], out["plain"][at], out["u"][at] = ok, plain, u
            out["d1"][at], out["d2"][at] = s.phase(u, ok, longest + 1)
    out["spike"][at], out["stuck"][at], out["level"][at], out["spread"][at] = spike, still, level, spread
    return out


def _known(given, s, own):
    """Per series: the given figure, the series' own where it is NaN."""
    g = given[s.start]
    return np.where(np.isnan(g), own, g)


def _reach(n, times: float, half: float = 7.0):
    """``times`` less one standard error of a departure in units of the spread.

    The spread of n readings is known to 1 / sqrt(2 n) of itself, the median of 2 half + 1
    readings to 1.25 / sqrt(2 half + 1) deviations: what was ``times`` off may come out at this.
    """
    return times - np.sqrt(times**2 / (2 * np.maximum(n, 4)) + 1.25**2 / (2 * half + 1))


def _reach_sql(n: str, times: float, half: float = 7.0) -> str:
    return f"({times}D - sqrt({times**2}D / (2 * greatest({n}, 4)) + {1.25**2 / (2 * half + 1)}D))"


def _judge_flux(seg, flux, plain, times, longest, stuck, equal, half, rounds, usual_share, given):
    s = _Series(seg)
    lag = longest + 1
    step = np.zeros(s.n, bool)
    step[1:] = (np.abs(flux[1:] - flux[:-1]) <= equal * np.abs(flux[1:])) & (s.id[1:] == s.id[:-1])
    k = np.cumsum(~step) - 1
    still = np.bincount(k)[k] >= stuck
    plain = plain & ~still

    def level_of(s, flux, ok, median):
        lv = s.rolling_median(flux, ok, half)
        return np.where(np.isnan(lv), _known(median, s, s.median(flux, ok))[s.id], lv)

    outside, lasting = np.zeros(s.n, bool), np.zeros(s.n, bool)
    at = np.arange(s.n)  # of the series in which the last round found something
    for _ in range(rounds):
        sub = _Series(seg[at])
        ok = plain[at] & ~outside[at]
        u = flux[at] - level_of(sub, flux[at], ok, given["median"][at])
        new = ok & _candidates(sub, u, ok, lag, {k: v[at] for k, v in given.items()})
        # The strongest first: the weaker ones may only be their shadows in the differences.
        size = np.where(new, np.abs(u), 0.0)
        new &= size >= 0.25 * np.maximum.reduceat(size, sub.start)[sub.id]
        # What would make a departure longer than a spike's is a change that lasts.
        lasting[at[new & (sub.runs(outside[at] | new) > longest)]] = True
        new &= sub.runs(outside[at] | new) <= longest
        outside[at[new]] = True
        busy = sub.sum(new.astype(float)) > 0
        if not busy.any():
            break
        at = at[busy[sub.id]]
    ok = plain & ~outside & ~lasting
    level = level_of(s, flux, ok | lasting, given["median"])
    # Ordinary readings: take back what lies within reach of noise and own variation.
    for _ in range(8):
        res = flux - level
        m = s.sum(ok.astype(float))
        mean = s.sum(np.where(ok, res, 0)) / np.maximum(m, 1)
        sd = np.sqrt(s.sum(np.where(ok, (res - mean[s.id]) ** 2, 0)) / np.maximum(m - 1, 1))
        back = ok | plain & (np.abs(res) < TAKE_BACK * sd[s.id])
        if (back == ok).all():
            break
        ok = back
        level = level_of(s, flux, ok | lasting, given["median"])

    def spread_of(ok):
        m = s.sum(ok.astype(float))
        mean = s.sum(np.where(ok, flux, 0)) / np.maximum(m, 1)
        sd = np.sqrt(s.sum(np.where(ok, (flux - mean[s.id]) ** 2, 0)) / np.maximum(m - 1, 1))
        return np.where(m >= 4, sd, np.nan)

    reach = _reach(_known(given["n"], s, s.size), times)[s.id]
    spread = _known(given["spread"], s, spread_of(ok))[s.id]
    far = plain & _outside(s, flux - level, ok, lag, reach * spread)
    # Where a good part of a series departs, that is how the source varies.
    own = _known(given["own"], s, s.sum(far.astype(float)) > np.maximum(usual_share * s.size, 3))[s.id] > 0
    spread = np.where(own, _known(given["own_spread"], s, spread_of(ok | far & own))[s.id], spread)
    far &= _outside(s, flux - level, ok, lag, reach * spread)
    # A departure lasts as long as readings stay off on the same side by half as much.
    side = np.where(np.abs(flux - level) >= reach / 2 * spread, np.sign(flux - level), 0.0)
    spike = far & (s.runs(side) <= longest)
    return spike, still, level, spread, ok, plain


# Deviations from the level within which a candidate is an ordinary reading after all.
TAKE_BACK = 6.0


def _outside(s, u, ok, lag, axis):
    """Outside the ellipsoid over value and differences whose value axis is ``axis``?

    Of independent readings the first difference has half the value's variance; the second
    follows from the value (minus twice it), with twice its variance left over.
    """
    d1, d2 = s.phase(u, ok, lag)
    rho = (u / axis) ** 2 + 2 * (d1 / axis) ** 2 + ((d2 + 2 * u) / axis) ** 2 / 2
    return (axis > 0) & (rho > 1)


def _candidates(s, u, ok, lag, given):
    """Readings outside the robust ellipsoid over value, first and second difference."""

    def mad(v, name):
        return _known(given[name], s, 1.4826 * s.median(np.abs(v - s.median(v, ok)[s.id]), ok))[s.id]

    lam = np.sqrt(2 * np.log(np.maximum(_known(given["n"], s, s.size), 3)))[s.id]
    d1, d2 = s.phase(u, ok, lag)
    theta = _known(given["theta"], s, np.arctan2(s.sum(np.where(ok, u * d2, 0)), s.sum(np.where(ok, u * u, 0))))[s.id]
    x, z = u * np.cos(theta) + d2 * np.sin(theta), d2 * np.cos(theta) - u * np.sin(theta)
    rho = np.zeros(s.n)
    for v, name in ((x, "x"), (d1, "d1"), (z, "z")):
        a = mad(v, name) * lam
        rho += np.nan_to_num((v / np.where(a > 0, a, np.nan)) ** 2, posinf=np.inf)
    # Differences put a spike's neighbours outside too; a place is found by its own value.
    return (rho > 1) & (np.abs(u) > mad(u, "u") * lam)
