"""Drawing sources to target shares of the total size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landmosaic.runtime import durable, ranked

#: The target table is read on the driver; more sources than this are an error.
MAX_SOURCES = 10_000
#: Rates tried for each source around the one that the whole source would need, and how far from it.
RATES, REACH = 65, 0.25


def draw_rates(sizes: DataFrame, targets: DataFrame, source: str, total: float | None = None) -> list[tuple]:
    """(source, target_share, max_repeats, available, rate) for each target source.

    ``rate`` is the expected number of copies of each of its documents. With
    no ``total`` it is the largest for which every source can give its share
    within its repeats; sources that have nothing can't, and their share goes
    to the others in proportion. A given total is cut to what the repeats allow.
    """
    want = targets.where(F.col(source).isNotNull()).groupBy(source).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).limit(MAX_SOURCES + 1).collect()
    if len(want) > MAX_SOURCES:
        raise ValueError("too many target sources")
    names = sizes.sparkSession.createDataFrame([(r[source],) for r in want], f"`{source}` string")
    have = {r[source]: r["n"] for r in sizes.join(F.broadcast(names), source, "left_semi").groupBy(source).agg(F.sum("n_tokens").alias("n")).collect()}
    rows = [(r[source], float(r["share"] or 0), int(r["cap"] or 0), int(have.get(r[source]) or 0)) for r in want]
    live = [x for x in rows if x[1] > 0 and x[2] > 0 and x[3] > 0]
    whole = sum(x[1] for x in live)
    most = min((x[2] * x[3] * whole / x[1] for x in live), default=0.0)
    goal = most if total is None else total
    return [(s, share, cap, n, min(float(cap), goal * share / whole / n) if (s, share, cap, n) in live else 0.0) for s, share, cap, n in rows]


def draw(sizes: DataFrame, targets: DataFrame, key: str, source: str, total: float | None = None, seed: int = 7) -> DataFrame:
    """Draw documents so that each source has its target share of the tokens.

    ``sizes`` has (key, source, n_tokens), one row per document. Systematic
    sampling: within a source, ordered by size, expected copies are summed up
    along the documents, one random offset is added, and a document is given
    once for each integer that the sum crosses. Equal rates make the prefix
    sum the rank times the rate, and the rank is found without a one-task
    window. Since no rate is above the source's max_repeats, no document is
    given more often than that. Where a few very long documents weigh much,
    the draw at the plain rate can miss the target by one of them; so the rate
    (the expected copies, not the offset) is the one of RATES values around it
    whose draw comes nearest. All rates are tried in one aggregate.

    Documents without tokens, with a null source or of a source that isn't a
    target are never drawn. Returns (key, source, n_tokens, copies), copies > 0.
    """
    sizes = durable(sizes.where("n_tokens > 0").select(key, source, "n_tokens"))
    rates = draw_rates(sizes, targets, source, total)
    spark = sizes.sparkSession
    table = spark.createDataFrame([(r[0], r[4], r[2]) for r in rates], f"`{source}` string, rate double, cap int")
    offset = F.expr(f"pmod(xxhash64(`{source}`, {int(seed)}), 1000003) / 1000003.0D")
    placed = durable(ranked(sizes.join(F.broadcast(table), source), [F.desc("n_tokens"), F.xxhash64(key), key], [source]).withColumn("offset", offset))

    def copies(rate: str) -> str:
        return f"floor((rank0 + 1) * {rate} + offset) - floor(rank0 * {rate} + offset)"

    half = (RATES - 1) // 2
    factors = [1 + REACH * ((i - half) / half) ** 3 for i in range(RATES)]  # dense around 1
    drawn = placed.groupBy(source).agg(*[F.expr(f"sum(({copies(f'least(rate * {f!r}D, cap)')}) * n_tokens)").alias(f"t{i}") for i, f in enumerate(factors)]).collect()
    goal = {r[0]: r[3] * r[4] for r in rates}
    chosen = [(r[source], factors[min(range(RATES), key=lambda i: (abs(r[f"t{i}"] - goal[r[source]]), abs(i - half), i))]) for r in drawn]
    pick = spark.createDataFrame(chosen, f"`{source}` string, factor double")
    out = placed.join(F.broadcast(pick), source).withColumn("rate", F.least(F.col("rate") * F.col("factor"), F.col("cap")))
    return out.select(key, source, "n_tokens", F.expr(copies("rate")).cast("int").alias("copies")).where("copies > 0")


def reached_shares(drawn: DataFrame, targets: DataFrame, source: str) -> DataFrame:
    """(source, target_share, max_repeats, documents, drawn_tokens, reached_share) of every target source, those with nothing included."""
    per = drawn.groupBy(source).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("drawn_tokens"))
    t = targets.select(source, "target_share", "max_repeats").join(per, source, "left")
    t = t.withColumns({"documents": F.coalesce("documents", F.lit(0)), "drawn_tokens": F.coalesce("drawn_tokens", F.lit(0))})
    whole = F.sum("drawn_tokens").over(Window.partitionBy())  # one row per target source
    return t.withColumn("reached_share", F.coalesce(F.try_divide(F.col("drawn_tokens"), whole), F.lit(0.0)))


