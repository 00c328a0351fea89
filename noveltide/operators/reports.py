"""Summaries and progress reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noveltide.config import EnrichConfig
from noveltide.functions.text import hms
from noveltide.sources import scratch


#: Ranges of a selection step, and distinct values that are looked at on the driver at most.
RANGES, FEW = 64, 10_000


def exact_quantiles(df: DataFrame, column: str, probs: list[float], few: int = FEW, n: int | None = None) -> list[float | None]:
    """Exact quantiles (interpolated) by selection: ranges are counted, and only those that hold a wanted rank are cut again.

    A range's cuts are its approximate quantiles, so each step leaves about a ``RANGES``-th of it.  Values equal to a cut are
    counted on their own: a value of many copies is found as a cut.  ``n`` is the number of values, if it is known.  Steps end when a range has ``few`` values; no task sorts the values.
    """
    values = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    n = values.count() if n is None else n
    if not n:
        return [None] * len(probs)
    places = [p * (n - 1) for p in probs]
    wanted = {r for at in places for r in (math.floor(at), math.ceil(at))}
    found: dict[int, float] = {}
    # (below, above, values up to `below`, values inside, ranks inside); the ends are excluded, None is no end.
    open_ = [(None, None, 0, n, sorted(wanted))]
    while open_:
        number = F.lit(None).cast("int")
        for k, (lo, hi, *_) in enumerate(open_):
            inside = (F.lit(True) if lo is None else F.col("x") > lo) & (F.lit(True) if hi is None else F.col("x") < hi)
            number = F.when(inside, k).otherwise(number)
        rows = values.withColumn("k", number).where("k is not null")
        small = [k for k, r in enumerate(open_) if r[3] <= few]
        large = [k for k, r in enumerate(open_) if r[3] > few]
        counts = []
        if small:
            counts += [(r.k, r.x, True, r.n) for r in rows.where(F.col("k").isin(small)).groupBy("k", "x").agg(F.count("*").alias("n")).collect()]
        if large:
            rows = rows.where(F.col("k").isin(large))
            cuts = {r.k: sorted(set(r.q)) for r in rows.groupBy("k").agg(F.percentile_approx("x", [j / RANGES for j in range(1, RANGES)], 10 * RANGES).alias("q")).collect()}
            place, same = F.lit(None).cast("int"), F.lit(None).cast("boolean")
            for k, q in cuts.items():
                edges = F.array(*map(F.lit, q))
                place = F.when(F.col("k") == k, F.size(F.filter(edges, lambda e: e < F.col("x")))).otherwise(place)
                same = F.when(F.col("k") == k, F.array_contains(edges, F.col("x"))).otherwise(same)
            counts += [(r.k, (cuts[r.k], r.place), r.same, r.n) for r in rows.groupBy("k", place.alias("place"), same.alias("same")).agg(F.count("*").alias("n")).collect()]
        later = []
        for k, (lo, hi, base, _, ranks) in enumerate(open_):
            mine = [c for c in counts if c[0] == k]
            mine = [(x, None, None, size) for _, x, _, size in sorted(mine, key=lambda c: c[1])] if k in small else [(q[j] if same else None, q[j - 1] if j else lo, q[j] if j < len(q) else hi, size) for _, (q, j), same, size in sorted(mine, key=lambda c: (c[1][1], c[2]))]
            for value, below, above, size in mine:
                held = [r for r in ranks if base <= r < base + size]
                if value is not None:
                    found |= dict.fromkeys(held, value)
                elif held:
                    later.append((below, above, base, size, held))
                base += size
        open_ = later
    return [found[lo] if lo == hi else (hi - at) * found[lo] + (at - lo) * found[hi] for at in places for lo, hi in [(math.floor(at), math.ceil(at))]]


def describe(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, sample deviation, minimum, exact quartiles (interpolated) and maximum.

    The column is worked out once and written, as the quartiles are found in several passes over it.
    """
    with scratch.Scratch(df.sparkSession, "describe") as place:
        values = place.write(df.select(F.col(column).cast("double").alias("x")), "values")
        r = values.agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")).first()
        q = exact_quantiles(values, "x", [0.25, 0.5, 0.75], n=r.n)
    return df.sparkSession.createDataFrame([(r.n, r.mean, r.std, r.min, *q, r.max)], "n long, mean double, std double, min double, q25 double, q50 double, q75 double, max double")


def progress(done: Column, cfg: EnrichConfig = EnrichConfig()) -> list[Column]:
    """Share of the corpus in percent and weeks that are left, both rounded half to even."""
    share = F.bround(done / F.lit(cfg.corpus_size) * 100, 2).alias("porcentaje_total")
    weeks = F.bround((F.lit(cfg.corpus_size) - done) / F.lit(cfg.weekly_quota), 0).cast("long").alias("estimacion_semanas_restantes")
    return [share, weeks]


def weekly_report(progress_lines: DataFrame, line_col: str = "line", cfg: EnrichConfig = EnrichConfig()) -> DataFrame:
    """``progreso_total`` (distinct lines), ``porcentaje_total`` and ``estimacion_semanas_restantes``."""
    return progress_lines.agg(F.count_distinct(line_col).alias("progreso_total")).select("progreso_total", *progress(F.col("progreso_total"), cfg))


def quota_reset(now: Column) -> list[Column]:
    """Hours and minutes until next Monday 00:00 (UTC)."""
    left = F.unix_timestamp(F.next_day(now, "MON").cast("timestamp")) - F.unix_timestamp(now)
    return [F.floor(left / 3600).cast("long").alias("horas_para_nueva_cuota"), F.floor(left % 3600 / 60).cast("long").alias("minutos_para_nueva_cuota")]


def run_summary(outcomes: DataFrame, week: str, progress_lines: DataFrame, cfg: EnrichConfig = EnrichConfig()) -> DataFrame:
    """The weekly report of a run from its ``outcome`` rows (``new``, ``existing``, ``error``)."""
    count = [F.count_if(F.col("outcome") == k).alias(n) for k, n in (("new", "descargados_nuevos"), ("existing", "existentes"), ("error", "errores"))]
    return outcomes.agg(*count).select(F.lit(week).alias("semana"), "*").crossJoin(weekly_report(progress_lines, cfg=cfg))


def decade_progress(decades: DataFrame, total: int) -> DataFrame:
    """``done, mean_seconds, eta`` from rows ``decade, seconds`` of the decades that are finished."""
    eta = F.col("mean_seconds") * (F.lit(total) - F.col("done"))
    return decades.agg(F.count("*").alias("done"), F.avg("seconds").alias("mean_seconds")).withColumn("eta", hms(eta))


def count_languages(df: DataFrame, abstract_lang: str = "lang_abstract", title_lang: str = "lang_title", undetected: str = "(sin_deteccion)") -> DataFrame:
    """``idioma, abstract_count, titulo_count`` by language, with rows for undetected texts (if any) and the total."""

    def named(c: str) -> Column:
        return F.when(F.coalesce(c, F.lit("")) == "", F.lit(undetected)).otherwise(F.col(c))

    # One pass: a row per text and side, counted together.
    sides = df.select(F.explode(F.array(F.struct(named(abstract_lang).alias("idioma"), F.lit(1).alias("a"), F.lit(0).alias("t")), F.struct(named(title_lang).alias("idioma"), F.lit(0).alias("a"), F.lit(1).alias("t")))).alias("s")).select("s.*")
    by = sides.groupBy("idioma").agg(F.sum("a").alias("abstract_count"), F.sum("t").alias("titulo_count"))
    total = df.agg(F.lit("TOTAL").alias("idioma"), F.count("*").alias("abstract_count"), F.count("*").alias("titulo_count"))
    return by.unionByName(total)
