"""The population of a search as tables: candidates, clusters, islands, draws, resets, progress."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from featherloom.operators.order import running


@dataclass(frozen=True)
class BufferConfig:
    functions_per_prompt: int = 2
    islands: int = 3
    reset_period_s: int = 4 * 60 * 60
    t_init: float = 0.1
    t_period: int = 30_000


def temperature(n: Column, t_init: float = 0.1, period: int = 30_000) -> Column:
    """Falls from t_init towards 0 within each period of registered programs; 0.001 at least."""
    return F.greatest(F.lit(1e-3), F.lit(t_init) * (1 - (n % period) / F.lit(period)))


def softmax(df: DataFrame, by: list[str], score: str, t: Column, name: str = "p") -> DataFrame:
    """df with the share exp(score / t) / sum within each group of by. The maximum is taken out first; groups are aggregated, not gathered."""
    top = df.groupBy(*by).agg(F.max(score).alias("_top"))
    scaled = df.join(top, by).withColumn("_e", F.exp((F.col(score) - F.col("_top")) / t))
    total = scaled.groupBy(*by).agg(F.sum("_e").alias("_sum"))
    return scaled.join(total, by).withColumn(name, F.col("_e") / F.col("_sum")).drop("_top", "_e", "_sum")


def first_per_id(df: DataFrame, ids: list[str], order: list) -> DataFrame:
    """Of rows delivered more than once, the first by order; one row an id and task is shuffled."""
    rest = [c for c in df.columns if c not in ids]
    key = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{k}") for k, o in enumerate(order)], F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    return df.groupBy(*ids).agg(F.min(key).alias("_first")).select(*ids, *[F.col(f"_first.row.`{c}`").alias(c) for c in rest])


def clusters(candidates: DataFrame) -> DataFrame:
    """(island, signature, score, members): candidates of an island with the same scores per test; score is their mean, -inf of none.

    candidates: (island, signature array<double>).
    """
    mean = F.when(F.size("signature") > 0, F.aggregate("signature", F.lit(0.0), lambda s, x: s + x) / F.size("signature")).otherwise(F.lit(float("-inf")))
    return candidates.groupBy("island", "signature").agg(F.count("*").alias("members")).withColumn("score", mean)


def cluster_shares(candidates: DataFrame, config: BufferConfig = BufferConfig()) -> DataFrame:
    """clusters with p, the share of each in draws of its island at the island's temperature."""
    of = clusters(candidates)
    size = of.groupBy("island").agg(F.sum("members").alias("programs"))
    return softmax(of.join(size, "island"), ["island"], "score", temperature(F.col("programs"), config.t_init, config.t_period))


def member_shares(members: DataFrame, by: list[str], length: str = "length") -> DataFrame:
    """members with p: shorter programs of a cluster are drawn more often, by a softmax over minus (length - min) / max."""
    ends = members.groupBy(*by).agg(F.min(length).alias("_min"), F.max(length).alias("_max"))
    scaled = members.join(ends, by).withColumn("_neg", -(F.col(length) - F.col("_min")) / (F.col("_max") + 1e-6)).drop("_min", "_max")
    return softmax(scaled, by, "_neg", F.lit(1.0)).drop("_neg")


def uniform(*tags: Column | str) -> Column:
    """A number in [0, 1) by a digest of the tags: the same everywhere and at every time."""
    digits = F.substring(F.md5(F.concat_ws(":", *[F.lit(t) if isinstance(t, str) else t.cast("string") for t in tags])), 1, 12)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 48))


def draw(shares: DataFrame, by: list[str], order: list[str], k: int, seed: int = 42, replace: bool = True) -> DataFrame:
    """k draws of each group by share, as (by, draw, order columns): with replacement by inverse distribution, without by the largest
    keys u^(1/p). Clusters of an island are few, as their scores are discrete."""
    if not replace:
        key = F.log(F.greatest(uniform(str(seed), *map(F.col, by + order)), F.lit(1e-300))) / F.greatest(F.col("p"), F.lit(1e-300))
        return shares.withColumn("draw", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(key), *order))).filter(F.col("draw") <= k).select(*by, "draw", *order)
    upto = F.sum("p").over(Window.partitionBy(*by).orderBy(*order))
    last = F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])) == 1
    spans = shares.withColumn("_to", F.when(last, F.lit(2.0)).otherwise(upto)).withColumn("_from", upto - F.col("p"))
    drawn = spans.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn("_u", uniform(str(seed), F.col("draw"), *map(F.col, by)))
    return drawn.filter((F.col("_u") >= F.col("_from")) & (F.col("_u") < F.col("_to"))).select(*by, "draw", *order)


def draw_parents(candidates: DataFrame, config: BufferConfig = BufferConfig(), seed: int = 42) -> DataFrame:
    """(island, turn, candidate, score): the parents of a prompt of each island.

    As many clusters as it has, functions_per_prompt at most, are drawn by their shares with replacement, and of each cluster drawn one member by its length. candidates:
    (island, candidate, signature array<double>, length).
    """
    shares = cluster_shares(candidates.select("island", "signature"), config)
    size = shares.groupBy("island").agg(F.count("*").alias("_clusters"))
    drawn = draw(shares, ["island"], ["signature"], config.functions_per_prompt, seed).join(size, "island").filter("draw <= _clusters").drop("_clusters")
    scored = drawn.join(shares.select("island", "signature", "score"), ["island", "signature"]).withColumnRenamed("draw", "turn")
    members = member_shares(candidates.select("island", "signature", "candidate", "length").join(scored, ["island", "signature"]), ["island", "turn"])
    picked = draw(members, ["island", "turn"], ["candidate"], 1, seed).select("island", "turn", "candidate")
    return picked.join(scored.select("island", "turn", "score"), ["island", "turn"])


def best_per_island(candidates: DataFrame, program: str = "candidate", score: str = "score") -> DataFrame:
    """(island, best, score); of equal scores the smallest program id, as the first to reach it keeps its place."""
    scored = candidates.filter(F.col("island").isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    return scored.groupBy("island").agg(F.max(F.struct(F.col(score).alias("score"), (-F.col(program)).alias("id"))).alias("b")).select("island", (-F.col("b.id")).alias("best"), F.col("b.score").alias("score"))


def weakest(best: DataFrame, seed: int = 42) -> DataFrame:
    """best with reset: the lower half of the islands by best score, rounded down; near ties by a noise of 1e-6. There are few islands."""
    noise = uniform(str(seed), F.col("island")) * 1e-6
    place = F.row_number().over(Window.orderBy(F.col("score") + noise, "island"))
    n = best.count()
    return best.withColumn("reset", place <= n // 2)


def reset(candidates: DataFrame, seed: int = 42) -> DataFrame:
    """The candidates after a reset: weak islands lose theirs and get the best of a surviving island, chosen at random."""
    marked = weakest(best_per_island(candidates), seed)
    gone, kept = marked.filter("reset").select("island"), marked.filter("NOT reset")
    order = F.row_number().over(Window.orderBy("island")) - 1
    founders = kept.select("best", order.alias("_k"))
    count = kept.count()
    if not count:
        return candidates
    seeded = gone.withColumn("_k", F.floor(uniform(f"{seed}:founder", F.col("island")) * count).cast("int")).join(F.broadcast(founders), "_k").select(F.col("island").alias("_to"), "best")
    survivors = candidates.join(F.broadcast(gone), "island", "left_anti")
    moved = candidates.join(F.broadcast(seeded), F.col("candidate") == F.col("best")).withColumn("island", F.col("_to")).select(*candidates.columns).dropDuplicates(["island", "candidate"])
    return survivors.unionByName(moved)


def progress(events: DataFrame, run: str, order: str, score: str = "score", sample_s: str | None = None, eval_s: str | None = None) -> DataFrame:
    """Per event of a run: the best score so far, the counts of scored and failed candidates, the times so far. A NaN score counts as failed.

    See order.running: a run that holds most events is spread over tasks.
    """
    scored = F.col(score).isNotNull() & ~F.isnan(score)
    made = {"best_so_far": ("max", F.when(scored, F.col(score))), "n_ok": ("sum", scored.cast("long")), "n_fail": ("sum", (~scored).cast("long"))}
    for name, column in (("t_sample_so_far", sample_s), ("t_eval_so_far", eval_s)):
        if column:
            made[name] = ("sum", F.coalesce(F.col(column), F.lit(0.0)))
    return running(events, run, order, made)
