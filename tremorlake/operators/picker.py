"""Arrivals of waves in records, put together from operators on series of any length.

A record before its wave is like noise. How like each stretch is to noise comes from differences of running sums; the
place where the smoothed likeness last falls through its mean, and the peaks before it, come from aggregates and from
`peaks`; of the peaks the one with the steepest growth of energy wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.functions import draws
from tremorlake.functions.lineage import checkpointed
from tremorlake.operators import peaks, scans


def _likeness(samples: DataFrame, rate: float, window: int, share: float, trials: int, seed: int) -> DataFrame:
    """Adds to (key, at, x) rows: n, energy (its share of the record's), width, end and likeness, 1 outside of width to end."""
    blocks = scans.in_blocks(samples, ["key"], ["at"])
    whole = {"__s": F.sum("x"), "__c": F.count("*")}
    sums = {"mean": F.sum("__s").over(scans.by_block()) / F.sum("__c").over(scans.by_block()), "n": F.sum("__c").over(scans.by_block())}
    scaled = scans.carried(blocks, whole, sums).withColumn("z", F.when(F.col("mean") != 0, F.col("x") / F.nullif("mean", F.lit(0.0))).otherwise(F.col("x")))
    gaps = [F.pow(F.col("z") - draws.uniform(seed + t, F.col("key"), F.col("at")), 2).alias(f"g{t}") for t in range(trials)]
    scaled = scaled.select("key", "at", "n", "z", scans.KEY, scans.BLOCK, scans.PLACE, *gaps)
    # Sums before each sample, so that two of them give the sum over what lies between.
    summary = {f"s{t}": F.sum(f"g{t}") for t in range(trials)}
    carried = scans.carried(scaled, summary, {f"b{t}": F.coalesce(F.sum(f"s{t}").over(scans.by_block(None, -1)), F.lit(0.0)) for t in range(trials)})
    before = {f"p{t}": F.col(f"b{t}") + F.sum(f"g{t}").over(scans.inside()) - F.col(f"g{t}") for t in range(trials)}
    made = scans.integrate(carried.withColumns(before), {"energy": F.col("z") * F.col("z")}, 1 / rate)
    made = made.withColumns({"energy": F.col("energy") / F.nullif("energy_whole", F.lit(0.0)), "width": F.when(F.col("n") > window, window).otherwise(F.floor(F.col("n") / 3))})
    made = checkpointed(made.select("key", "at", "n", "width", "energy", *[f"p{t}" for t in range(trials)]))
    half = made.groupBy("key").agg(F.max(F.when(F.col("energy") <= share, F.col("at"))).alias("__h"), F.max("width").alias("__w"), F.max("n").alias("__n"))
    ends = half.where("__h IS NOT NULL").select("key", F.when(F.col("__h") > F.col("__w"), F.col("__h")).otherwise(F.col("__n")).alias("end"))
    earlier = made.select("key", (F.col("at") + F.col("width")).alias("at"), *[F.col(f"p{t}").alias(f"q{t}") for t in range(trials)])
    near = [1 / F.sqrt(F.nullif((F.col(f"p{t}") - F.col(f"q{t}")) / (F.col("width") - 1), F.lit(0.0))) for t in range(trials)]
    inside = (F.col("at") >= F.col("width")) & (F.col("at") < F.col("end")) & (F.col("width") > 1)
    both = made.join(ends, "key", "left").join(earlier, ["key", "at"], "left").withColumn("like", F.when(inside, sum(near[1:], near[0])))
    most = both.groupBy("key").agg(F.max("like").alias("most"))
    return both.join(most, "key").select("key", "at", "n", "width", "end", "energy", F.coalesce(F.col("like") / F.col("most"), F.lit(1.0)).alias("likeness"), inside.alias("inside"))


def _crossings(smooth: DataFrame, rate: float, back: float) -> DataFrame:
    """(key, begin, low) of the records whose smoothed likeness crosses its mean: where candidates are looked for."""
    mean = smooth.groupBy("key").agg(F.avg(F.when(F.col("inside"), F.col("smooth"))).alias("mean"), F.max(F.when(F.col("at") == F.col("end") - 1, F.col("smooth"))).alias("edge"))
    quiet = smooth.join(mean, "key").where("at < end AND mean IS NOT NULL")
    stop = quiet.groupBy("key").agg(F.when(F.first("edge") > F.first("mean"), F.max(F.when(F.col("smooth") <= F.col("mean"), F.col("at")))).otherwise(F.first("end")).alias("stop"))
    crossing = quiet.join(stop, "key").where("at < stop AND smooth >= mean").groupBy("key").agg(F.max("at").alias("crossing"), F.max("stop").alias("stop"))
    begin = crossing.withColumn("begin", F.greatest(F.ceil(F.col("crossing") - back * rate - 0.5), F.lit(0)))
    least = smooth.join(begin, "key").where("at >= begin AND at < stop").groupBy("key", "begin").agg(F.min_by("at", F.struct("smooth", "at")).alias("least"))
    return least.select("key", "begin", F.greatest("least", F.col("begin") + 1).alias("low"))


def _candidates(smooth: DataFrame, ranges: DataFrame, second: int) -> DataFrame:
    """(key, at) of the peaks of three curves from begin to low: the likeness, its slope to the least one, and its fall; the begin where there is none."""
    part = smooth.select("key", "at", "smooth").join(ranges, "key").where("at >= begin AND at <= low")
    final = part.where("at = low").select("key", F.col("smooth").alias("floor"))
    after = part.select("key", (F.col("at") - 1).alias("at"), F.col("smooth").alias("next"))
    joined = part.where("at < low").join(final, "key").join(after, ["key", "at"])
    curves = F.array(F.col("smooth"), (F.col("smooth") - F.col("floor")) / (F.col("low") - F.col("at")), F.col("smooth") - F.col("next"))
    series = joined.select("key", "begin", (F.col("at") - F.col("begin")).alias("place"), F.posexplode(curves).alias("curve", "value"))
    found = peaks.find_peaks(series, ["key", "begin", "curve"], "place", "value", second)
    places = found.select("key", (F.col("begin") + F.col("place")).alias("at")).distinct()
    return places.unionByName(ranges.join(places, "key", "left_anti").select("key", F.col("begin").alias("at")))


def pick_arrivals(records: DataFrame, key: str, values: str, rate: float, window: int = 800, share: float = 0.5, back: float = 2.0, trials: int = 5, seed: int = 1) -> DataFrame:
    """(key, position, status, similarity) of each record: where it stops being like noise, and how like to noise it is around each sample.

    Stretches of `window` samples, or of a third of a shorter record, are compared with uniform noise, drawn anew for each
    of `trials` from the seed, the key and the sample, in the part of the record with the first `share` of its energy.
    Candidates lie in the `back` seconds before the likeness crosses its mean for the last time. status is "picked",
    "no_data" (null or empty: position and similarity null) or "fallback" where the record gives no pick (position 0,
    similarity 1 throughout). Keys tell records apart; samples of null count as 0.
    """
    second = int(rate)
    named = records.select(F.col(key).alias("key"), F.col(values).alias("values"))
    samples = named.select("key", F.posexplode("values").alias("at", "x")).select("key", F.col("at").cast("long").alias("at"), F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x"))
    width = int(rate / 2) + 1
    blocks = scans.in_blocks(_likeness(samples, rate, window, share, trials, seed), ["key"], ["at"])
    smooth = checkpointed(scans.plain(scans.moving_statistics(blocks, "likeness", width, "smooth", "__d")).drop("__d"))
    ranges = checkpointed(_crossings(smooth, rate, back))
    candidates = _candidates(smooth, ranges, second)
    here = candidates.join(smooth.select("key", "at", "energy"), ["key", "at"])
    later = smooth.select("key", (F.col("at") - second).alias("at"), F.col("energy").alias("after"), F.lit(True).alias("there"))
    grown = here.join(later, ["key", "at"], "left")
    ordinal = F.size(F.filter("all", lambda a: a >= F.col("at")))
    growth = F.when(F.col("after") != 0, F.col("energy") / F.nullif("after", F.lit(0.0))).otherwise(ordinal.cast("double"))
    # A record has few candidates: at most one in each second before its crossing on each curve.
    every = candidates.groupBy("key").agg(F.collect_list("at").alias("all"))
    best = grown.join(every, "key").groupBy("key").agg(F.min_by("at", F.struct(growth, "at")).alias("pick"), F.bool_and(F.coalesce("there", F.lit(False))).alias("sound")).where("sound")
    shown: Column = F.when(F.col("inside"), F.col("smooth")).otherwise(1.0)
    similar = smooth.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", shown.alias("v")))), lambda s: s["v"]).alias("similarity"))
    joined = named.join(best, "key", "left").join(similar, "key", "left")
    there = F.coalesce(F.size("values"), F.lit(0)) > 0
    position = F.when(there, F.coalesce("pick", F.lit(0)))
    status = F.when(~there, "no_data").when(F.col("pick").isNull(), "fallback").otherwise("picked")
    ones = F.transform("values", lambda _: F.lit(1.0))
    return joined.select(F.col("key").alias(key), position.cast("int").alias("position"), status.alias("status"), F.when(there, F.when(F.col("pick").isNull(), ones).otherwise(F.col("similarity"))).alias("similarity"))
