"""A sample with given category shares (problem 3)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherloom.session import materialize


@dataclass(frozen=True)
class Target:
    """What is wanted of a category: its weight among all, and its least number of rows."""

    key: int
    weight: int
    least: int
    available: int


def allocate(size: int, targets: list[Target]) -> dict[int, int]:
    """Integer quotas that sum to size where that is possible.

    A quota is the category's share of size, not under its floor min(least, available) and not over its available rows;
    what floors take or caps leave is shared out among the other categories by weight. Fractions are
    rounded by largest remainder, ties by key. If even the floors exceed size, the quotas are the floors.
    """
    low = {t.key: min(t.least, t.available) for t in targets}
    high = {t.key: t.available for t in targets}
    weight = {t.key: max(t.weight, 0) for t in targets}
    want = min(size, sum(high.values()))
    if sum(low.values()) >= want:
        return low
    reachable = sum(high[k] if weight[k] else low[k] for k in low)
    if want > reachable:  # categories of weight 0 take what no weighted one can
        quota = {k: high[k] if weight[k] else low[k] for k in low}
        for k in sorted(k for k in low if not weight[k]):
            more = min(high[k] - quota[k], want - sum(quota.values()))
            quota[k] += more
        return quota

    def at(scale: float) -> dict[int, float]:
        return {k: min(max(scale * weight[k], low[k]), high[k]) for k in low}

    lo, hi = 0.0, float(max(high.values()) + 1)
    while sum(at(hi).values()) < want:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(at(mid).values()) < want else (lo, mid)
    exact = at(hi)
    quota = {k: int(v + 1e-9) for k, v in exact.items()}
    left = want - sum(quota.values())
    for k in sorted(exact, key=lambda k: (quota[k] - exact[k], k)):
        if left and quota[k] < high[k]:
            quota[k] += 1
            left -= 1
    return quota


def with_category(df: DataFrame, targets: DataFrame, key: str, name: str) -> DataFrame:
    """df with ``category``: its key if the targets have it, otherwise the target key of its name compared without case, blanks, - and _ (the smallest of several), otherwise null.

    targets is the stated table of wanted shares; its size is checked in sample_by_targets.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), r"[\s\p{Z}\-_]+", "")
    keys = F.broadcast(targets.select(F.col(f"`{key}`").alias("_key")).filter("_key IS NOT NULL").distinct())
    names = F.broadcast(targets.select(plain(F.col(f"`{name}`")).alias("_name"), F.col(f"`{key}`").alias("_named")).filter("_name IS NOT NULL AND _name <> ''").groupBy("_name").agg(F.min("_named").alias("_named")))
    joined = df.join(keys, F.col(f"`{key}`") == F.col("_key"), "left").withColumn("_plain", plain(F.col(f"`{name}`")))
    return joined.join(names, F.col("_plain") == F.col("_name"), "left").withColumn("category", F.coalesce("_key", "_named")).drop("_key", "_named", "_plain", "_name")


@dataclass(frozen=True)
class Sample:
    rows: DataFrame
    report: DataFrame


def sample_by_targets(df: DataFrame, targets: DataFrame, id_col: str, key: str, name: str, weight: str, least: str, one_in: int = 10, seed: int = 42, cut_rows: int = 50_000, max_targets: int = 100_000) -> Sample:
    """One in one_in of the rows that have a category, with the targets' shares and at least ``least`` rows of each.

    The rows of each category are counted; quotas are allocated by largest remainder with floors and caps (see
    allocate); of each category the rows of the smallest random keys are taken, the key being a digest of seed and id.
    No category is sorted as a whole: a histogram of key prefixes, pre-aggregated in the tasks, finds the one
    prefix in which the quota ends; rows of smaller prefixes are taken as they are and only those of that prefix are
    ranked. Prefixes are so fine that about cut_rows rows of the largest category share one, whatever its size.

    rows: (id, category). report: one row per target with available, wanted (its share of the sample, not rounded, as
    weight x rows / (one_in x sum of weights)), quota, short: available is under wanted or under least, missing: how far the quota stays under wanted, as floors of others or too few rows leave no more,
    and extra: how far it goes over, for the floor's sake or in place of others. Where the floors alone exceed the sample, the quotas are the floors and their sum is more than one in one_in.
    Rows without a category, with null names or keys, are left out. Repeated ids have equal keys and are ranked in any
    order. An empty table gives no rows and a report in which every target of a positive share is short.
    """
    listed = targets.select(F.col(f"`{key}`").cast("long"), F.coalesce(F.col(f"`{weight}`"), F.lit(0)).cast("long"), F.coalesce(F.col(f"`{least}`"), F.lit(0)).cast("long")).filter(F.col(f"`{key}`").isNotNull()).limit(max_targets + 1).collect()
    if len(listed) > max_targets:
        raise ValueError(f"more than {max_targets} targets; targets are to be a small table")
    plain = targets.select(F.col(f"`{key}`").alias("k"), F.col(f"`{name}`").alias("name"))
    keyed = with_category(df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{key}`").alias("k"), F.col(f"`{name}`").alias("name")), plain, "k", "name").filter("category IS NOT NULL").select("id", F.col("category").cast("long").alias("category"))
    counts = {k: n for k, n in keyed.groupBy("category").count().collect()}  # at most one row a target
    rows = sum(counts.values())
    size = (2 * rows + one_in) // (2 * one_in)
    total = sum(w for _, w, _ in listed) or 1
    quota = allocate(size, [Target(k, w, m, counts.get(k, 0)) for k, w, m in listed])
    spark = df.sparkSession
    report = spark.createDataFrame(
        [(k, counts.get(k, 0), w * rows / (total * one_in), m, quota[k], counts.get(k, 0) * total * one_in < w * rows or counts.get(k, 0) < m) for k, w, m in listed],
        "category long, available long, wanted double, least long, quota long, short boolean",
    ).withColumns({"missing": F.greatest(F.col("wanted") - F.col("quota"), F.lit(0.0)), "extra": F.greatest(F.col("quota") - F.col("wanted"), F.lit(0.0))})
    digits = 1
    while max(counts.values(), default=0) > cut_rows * 16**digits:
        digits += 1
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))
    picked = materialize(keyed.select("id", "category", digest.alias("digest")))
    picked = picked.withColumn("prefix", F.substring("digest", 1, digits))
    quotas = F.broadcast(report.select("category", "quota"))  # one row a target
    histogram = picked.groupBy("category", "prefix").count()
    cut = (
        histogram.join(quotas, "category")
        .withColumn("upto", F.expr("sum(count) OVER (PARTITION BY category ORDER BY prefix)"))
        .withColumn("before", F.col("upto") - F.col("count"))
        .filter("before < quota")
        .select("category", "prefix", (F.col("quota") - F.col("before")).alias("open"), "count")
    )
    taken = picked.join(cut, ["category", "prefix"])
    whole = taken.filter("count <= open").select("id", "category")
    last = taken.filter("count > open").withColumn("rank", F.expr("row_number() OVER (PARTITION BY category ORDER BY digest, id)")).filter("rank <= open").select("id", "category")
    return Sample(whole.unionByName(last), report)
