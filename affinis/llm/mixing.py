"""Mixing sources to target weights by a time-varying curriculum.

Training time runs from 0 to 1. Each source has a weight schedule, linear
between knots; at every moment the weights are scaled to sum to one. The
integral of a source's schedule times the token budget is its cumulative
demand. A document takes the moment at which its source's demand reaches the
tokens that lie before it in the source's own order; that is the inverse of
the cumulative demand, a quadratic between two knots. A source that runs out
begins again (epoch 1, 2, ...). The result is range-sorted by position.

The order within a source is that of an md5 of the id. Prefix sums are taken in
two levels, over cells of a source (leading digits of the md5) and within a
cell, so no task ever sorts a whole source, however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import col, fresh

#: Leading hexadecimal digits of the md5 that make a cell: 4096 cells a source.
CELL_DIGITS = 3


def _schedules(totals: DataFrame, schedule: dict[str, list[tuple[float, float]]] | None) -> DataFrame:
    """For each source: its tokens, and arrays of knot times and of weights at
    the knots, scaled over the sources."""
    everything = Window.partitionBy()  # one row a source
    if schedule is None:
        root = F.round(F.sqrt(F.col("supply").cast("double")) * 1000).cast("long")
        t = totals.withColumn("root", root)
        first = F.col("supply").cast("double") / F.sum("supply").over(everything).cast("double")
        last = F.col("root").cast("double") / F.sum("root").over(everything).cast("double")
        return t.select("key", "supply", F.array(F.lit(0.0), F.lit(1.0)).alias("times"), F.array(first, last).alias("weights"))
    times = sorted({0.0, 1.0} | {float(t) for knots in schedule.values() for t, _ in knots})
    if times[0] < 0 or times[-1] > 1:
        raise ValueError("knots lie between 0 and 1")

    def at(knots: list[tuple[float, float]], t: float) -> float:
        knots = sorted(knots)
        for (a, u), (b, v) in zip(knots, knots[1:]):
            if a <= t <= b:
                return u if b == a else u + (v - u) * (t - a) / (b - a)
        return knots[0][1] if t < knots[0][0] else knots[-1][1]

    lines = {s: [float(at(k, t)) for t in times] for s, k in schedule.items()}
    if any(w < 0 for line in lines.values() for w in line):
        raise ValueError("weights are at least 0")
    spark = totals.sparkSession
    given = spark.createDataFrame([(f"s{s}", line) for s, line in lines.items()], "key string, raw array<double>")
    known = totals.join(F.broadcast(given), "key", "left").withColumn("raw", F.coalesce("raw", F.array(*[F.lit(0.0)] * len(times))))
    scaled = [F.coalesce(F.try_divide(F.col("raw")[i], F.sum(F.col("raw")[i]).over(everything)), F.lit(0.0)) for i in range(len(times))]
    return known.select("key", "supply", F.array(*[F.lit(t) for t in times]).alias("times"), F.array(*scaled).alias("weights"))


def _segments(n: int) -> tuple[Column, Column]:
    """The linear pieces of a schedule with their integrals, and the whole integral."""
    pieces, low = [], F.lit(0.0)
    for i in range(n - 1):
        width = F.col("times")[i + 1] - F.col("times")[i]
        high = low + width * (F.col("weights")[i] + F.col("weights")[i + 1]) / 2
        pieces.append(F.struct(F.col("times")[i].alias("t"), width.alias("width"), F.col("weights")[i].alias("w"), F.col("weights")[i + 1].alias("v"), low.alias("low"), high.alias("high")))
        low = high
    return F.array(*pieces), low


def mix_sources(docs: DataFrame, schedule: dict[str, list[tuple[float, float]]] | None = None, budget_tokens: float | None = None, id: str = "doc_id", text: str = "text", source: str = "source", tokens: str | None = None, seed: str = "curriculum", columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or its ``columns``) with ``n_tokens``, ``epoch`` and
    ``position``, the token of the training run at which the document starts,
    in the order of position.

    ``schedule`` maps a source to knots (time, weight). None: every source goes
    from its natural share to one in proportion to the square root of its
    tokens. ``budget_tokens`` None: the least budget by which every document is
    placed at least once; if given, documents beyond their source's demand are
    left out. ``tokens`` names a column of token counts; None: a quarter of the
    text's bytes, rounded up.

    A null or empty text has 0 tokens and stands where the next one begins; a
    null source is a source of its own (a schedule can't name it). A null id is
    ordered like any other value, before all. Rows with the same id are ordered
    by tokens; rows equal in both take their places in any order, which does
    not change the set of results. A source that a given schedule does not name
    has weight 0 and is left out. An empty table gives an empty table. If the
    table has columns ``n_tokens``, ``epoch`` or ``position``, the new ones
    have a leading underscore more.
    """
    n_name, e_name, p_name = fresh(docs, "n_tokens", "epoch", "position")
    columns = docs.columns if columns is None else columns
    row = F.struct(*[col(c) for c in columns]).alias("row")
    count = col(tokens).cast("long") if tokens else F.ceil(F.octet_length(col(text)) / 4).cast("long")
    name = col(source).cast("string")
    base = docs.select(
        row,
        F.coalesce(F.concat(F.lit("s"), name), F.lit("n")).alias("key"),
        F.greatest(F.coalesce(count, F.lit(0)), F.lit(0)).alias("n"),
        F.when(col(id).isNull(), F.lit("")).otherwise(F.md5(F.concat(F.lit(seed + "#"), col(id).cast("string")))).alias("place"),
    ).withColumn("cell", F.substring("place", 1, CELL_DIGITS))
    cells = base.groupBy("key", "cell").agg(F.sum("n").alias("in_cell"))
    before = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("skip", F.coalesce(F.sum("in_cell").over(before), F.lit(0)))
    totals = cells.groupBy("key").agg(F.sum("in_cell").alias("supply"))
    plans = _schedules(totals, schedule)
    knots = 2 if schedule is None else len({0.0, 1.0} | {float(t) for k in schedule.values() for t, _ in k})
    pieces, whole = _segments(knots)
    plans = plans.select("key", "supply", pieces.alias("pieces"), whole.alias("share"))
    least = F.max(F.when(F.col("share") > 0, F.col("supply") / F.col("share"))).over(Window.partitionBy())
    plans = plans.withColumn("budget", F.lit(float(budget_tokens)) if budget_tokens is not None else F.coalesce(least, F.lit(0.0)))
    known = cells.select("key", "cell", "skip").join(plans, "key")
    inside = Window.partitionBy("key", "cell").orderBy("place", "n").rowsBetween(Window.unboundedPreceding, -1)
    ranked = base.withColumn("start", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(known, ["key", "cell"])
    ranked = ranked.withColumn("start", F.col("start") + F.col("skip"))
    demand = F.col("budget") * F.col("share")
    times = F.when(F.col("supply") == 0, F.lit(1)).otherwise(F.ceil((demand - F.col("start")) / F.col("supply") - 1e-9))
    if schedule is None and budget_tokens is None:
        times = F.greatest(times, F.lit(1))
    elif schedule is not None:
        times = F.when(F.col("share") > 0, times).otherwise(F.lit(0))
    ranked = ranked.withColumn("times", times.cast("long")).where("times > 0")
    epochs = ranked.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    x = epochs.withColumn("x", F.when(F.col("budget") > 0, (F.col("start") + F.col("epoch") * F.col("supply")) / F.col("budget")).otherwise(F.lit(0.0)))
    piece = F.coalesce(F.get(F.filter("pieces", lambda p: (p["high"] > F.col("x")) & (p["width"] > 0)), F.lit(0)), F.element_at("pieces", -1))
    x = x.withColumn("p", piece)
    y = F.col("x") - F.col("p.low")
    slope = (F.col("p.v") - F.col("p.w")) / F.col("p.width")
    under = F.greatest(F.col("p.w") * F.col("p.w") + slope * 2 * y, F.lit(0.0))
    bottom = F.col("p.w") + F.sqrt(under)
    moment = F.col("p.t") + F.when(bottom > 0, y * 2 / bottom).otherwise(F.lit(0.0))
    (order,) = fresh(docs, "place")
    placed = x.select("row.*", F.col("n").alias(n_name), F.col("epoch").alias(e_name), F.round(moment * F.col("budget")).cast("long").alias(p_name), F.col("place").alias(order))
    return placed.orderBy(p_name, order).drop(order)


#: The same by DuckDB, for the default schedule and budget.
SQL = """
WITH base AS (
  SELECT doc_id, source, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS n, md5('curriculum#' || CAST(doc_id AS VARCHAR)) AS place
  FROM {documents}
), ranked AS (
  SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY source ORDER BY place, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM base
), totals AS (
  SELECT source, CAST(sum(n) AS BIGINT) AS supply, CAST(round(sqrt(CAST(sum(n) AS DOUBLE)) * 1000) AS BIGINT) AS root FROM base GROUP BY source
), plans AS (
  SELECT source, supply, CAST(supply AS DOUBLE) / CAST(CAST(sum(supply) OVER () AS BIGINT) AS DOUBLE) AS w, CAST(root AS DOUBLE) / CAST(CAST(sum(root) OVER () AS BIGINT) AS DOUBLE) AS v FROM totals
), shares AS (
  SELECT *, 0.0::DOUBLE + 1.0::DOUBLE * (w + v) / 2 AS share FROM plans
), budgets AS (
  SELECT *, max(CAST(supply AS DOUBLE) / share) OVER () AS budget FROM shares
), epochs AS (
  SELECT r.*, b.*, unnest(range(greatest(1, CAST(ceil((budget * share - start) / supply - 1e-9::DOUBLE) AS BIGINT)))) AS epoch
  FROM ranked r JOIN budgets b ON r.source = b.source
), moments AS (
  SELECT *, CAST(start + epoch * supply AS DOUBLE) / budget AS x FROM epochs
)
SELECT doc_id, source, n AS n_tokens, epoch,
  CAST(round((x * 2 / (w + sqrt(greatest(w * w + (v - w) * 2 * x, 0.0::DOUBLE)))) * budget) AS BIGINT) AS position
FROM moments
"""
