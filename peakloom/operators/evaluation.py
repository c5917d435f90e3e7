"""Evaluation composites: the adduct-aware mass filter, candidate pools ranked by every aggregation, strata and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chem import ChemistryConfig, error_ppm
from .metrics import KS, absent_as_miss, hit_at, reciprocal


def filter_mode(adduct: Column, neutral: Column, config: ChemistryConfig) -> Column:
    """hard, soft or pass: what the configuration asks for an adduct; pass as well without a neutral mass."""
    known = F.when(adduct.isin(*config.disabled_adducts) | neutral.isNull(), "pass").when(adduct.isin(*config.hard_adducts), "hard").when(adduct.isin(*config.soft_adducts), "soft")
    return F.coalesce(known, F.lit("pass"))


def chemistry_filter(rows: DataFrame, config: ChemistryConfig | None = None, query: str = "query", adduct: str = "adduct", neutral: str = "neutral_mass", mass: str = "exact_mass") -> DataFrame:
    """The ranked candidates ``rows`` that a query's mass filter leaves.

    Hard adducts keep candidates within the tolerance, of which there may be none. Soft ones fall back to all of the
    query's where none is, if the configuration says so. Disabled and unknown adducts keep all. A candidate without
    a mass is within no tolerance.
    """
    config = config or ChemistryConfig()
    passes = F.coalesce(F.abs(error_ppm(F.col(neutral), F.col(mass))) <= config.tolerance_ppm, F.lit(False))
    marked = rows.withColumn("__mode", filter_mode(F.col(adduct), F.col(neutral), config)).withColumn("__passes", passes)
    any_pass = F.max("__passes").over(Window.partitionBy(query))
    marked = marked.withColumn("__any", any_pass)
    keep = (F.col("__mode") == "pass") | F.col("__passes")
    if config.fallback:
        keep |= (F.col("__mode") == "soft") & ~F.col("__any")
    return marked.where(keep).drop("__mode", "__passes", "__any")


def multi_observation_filter(rows: DataFrame, observations: DataFrame, config: ChemistryConfig | None = None, group: str = "grp", adduct: str = "adduct", neutral: str = "neutral_mass", mass: str = "exact_mass") -> DataFrame:
    """The candidates ``rows`` (group, mass, ...) that any of their group's observations allows.

    Hard observations, where a group has one, put its soft ones aside; a group with neither keeps all; a group with
    only soft ones keeps all where none is allowed and the configuration falls back.
    """
    config = config or ChemistryConfig()
    seen = observations.withColumn("__mode", filter_mode(F.col(adduct), F.col(neutral), config))
    by_group = seen.groupBy(group).agg(F.collect_list(F.when(F.col("__mode") == "hard", F.col(neutral))).alias("__hard"), F.collect_list(F.when(F.col("__mode") == "soft", F.col(neutral))).alias("__soft"))
    used = rows.join(by_group, group, "left").withColumn("__used", F.when(F.size("__hard") > 0, F.col("__hard")).otherwise(F.col("__soft")))
    within = F.exists("__used", lambda m: F.abs(error_ppm(m, F.col(mass))) <= config.tolerance_ppm)
    used = used.withColumn("__within", F.coalesce(within, F.lit(False)))
    free = F.coalesce(F.size("__used") <= 0, F.lit(True))
    if config.fallback:
        free |= (F.size("__hard") <= 0) & ~F.max("__within").over(Window.partitionBy(group))
    return used.withColumn("__free", free).where("__within or __free").drop("__hard", "__soft", "__used", "__within", "__free")


def place_in(entries: Column, truth: Column, score: str = "score", structure: str = "structure") -> Column:
    """The place of ``truth`` by score, then structure, in an array of entries; null where it isn't among them or has no score."""
    mine = F.get(F.filter(entries, lambda e: e[structure] == truth), F.lit(0))[score]
    ahead = F.filter(entries, lambda e: (e[score] > mine) | ((e[score] == mine) & (e[structure] < truth)))
    return F.when(mine.isNotNull(), F.size(ahead) + 1)


def allowed_entries(entries: Column, passes, mode: Column, config: ChemistryConfig | None = None) -> Column:
    """The entries that a mass filter leaves, as in ``chemistry_filter``; ``passes`` tells whether an entry is within the tolerance."""
    within = F.filter(entries, passes)
    fallback = (mode == "soft") & (F.size(within) == 0) if (config or ChemistryConfig()).fallback else F.lit(False)
    return F.when((mode == "pass") | fallback, entries).otherwise(within)


def comparison(ranks: DataFrame, before: str = "before", after: str = "after", cutoff: int = 25) -> DataFrame:
    """(metric, before, after, delta) of two rank columns of the same queries; n_removed counts the true candidates that ``after`` lost."""
    one = {}
    for name, column in (("b", before), ("a", after)):
        one |= {f"{name}_recall_{k}": F.avg(hit_at(k, column)) for k in KS} | {f"{name}_mrr": F.avg(reciprocal(column, cutoff))}
    lost = F.count_if(F.col(before).isNotNull() & F.col(after).isNull()).cast("double")
    row = ranks.agg(*[c.alias(name) for name, c in one.items()], lost.alias("lost"))
    cells = [F.struct(F.lit(m).alias("metric"), F.col(f"b_{m}").alias("before"), F.col(f"a_{m}").alias("after")) for m in (*[f"recall_{k}" for k in KS], "mrr")]
    cells.append(F.struct(F.lit("n_removed").alias("metric"), F.lit(0.0).alias("before"), F.col("lost").alias("after")))
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*").withColumn("delta", F.col("after") - F.col("before"))


def strata_metrics(ranks: DataFrame, strata: Column, cutoff: int | None = None) -> DataFrame:
    """absent_as_miss by stratum; ``strata`` is an array, so that a query may count in several."""
    return absent_as_miss(ranks.withColumn("stratum", F.explode(strata)), ["stratum"], cutoff)
