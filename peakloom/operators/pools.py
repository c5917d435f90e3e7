"""Candidate sets of several spectra of one group: union, intersection, pools, availability.

``hits`` hold a (spectrum, candidate) once, as the range join gives them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union(hits: DataFrame, group: str = "grp", candidate: str = "structure") -> DataFrame:
    return hits.select(group, candidate).distinct()


def supported(hits: DataFrame, spectra: DataFrame, group: str = "grp", spectrum: str = "spectrum_id", candidate: str = "structure", ignore_empty: bool = False) -> DataFrame:
    """(group, candidate, n_supporting, n_spectra): n_spectra counts all of the group's spectra, or with ``ignore_empty`` those that have a hit."""
    by_candidate = hits.groupBy(group, candidate).agg(F.count("*").alias("n_supporting"))
    counted = hits if ignore_empty else spectra
    sizes = counted.groupBy(group).agg(F.count_distinct(spectrum).alias("n_spectra"))
    return by_candidate.join(sizes, group)


def intersection(hits: DataFrame, spectra: DataFrame, **names) -> DataFrame:
    """Candidates of every spectrum of their group; one empty spectrum leaves a group without."""
    return supported(hits, spectra, **names).where("n_supporting = n_spectra").drop("n_supporting", "n_spectra")


def select_pool(hits: DataFrame, spectra: DataFrame, group: str = "grp", candidate: str = "structure", ignore_empty: bool = False, **names) -> DataFrame:
    """(group, candidate, mode, n_supporting, n_spectra): a group's intersection, or its union where that is empty (union_fallback)."""
    rows = supported(hits, spectra, group=group, candidate=candidate, ignore_empty=ignore_empty, **names)
    full = F.col("n_supporting") == F.col("n_spectra")
    any_full = F.max(full).over(Window.partitionBy(group))
    marked = rows.withColumn("mode", F.when(any_full, "intersection").otherwise("union_fallback"))
    return marked.where(full | (F.col("mode") == "union_fallback"))


def pool_summary(hits: DataFrame, spectra: DataFrame, group: str = "grp", spectrum: str = "spectrum_id", candidate: str = "structure", error: str = "error_ppm", ignore_empty: bool = False) -> DataFrame:
    """select_pool's rows with the mean errors of their supporting spectra, from one pass over the hits."""
    by_candidate = hits.groupBy(group, candidate).agg(F.count("*").alias("n_supporting"), F.avg(error).alias("mean_error_ppm"), F.avg(F.abs(error)).alias("mean_abs_error_ppm"))
    sizes = (hits if ignore_empty else spectra).groupBy(group).agg(F.count_distinct(spectrum).alias("n_spectra"))
    rows = by_candidate.join(sizes, group)
    full = F.col("n_supporting") == F.col("n_spectra")
    any_full = F.max(full).over(Window.partitionBy(group))
    marked = rows.withColumn("mode", F.when(any_full, "intersection").otherwise("union_fallback"))
    return marked.where(full | (F.col("mode") == "union_fallback"))


def manifest(hits: DataFrame, spectra: DataFrame, group: str = "grp", spectrum: str = "spectrum_id", candidate: str = "structure", error: str = "error_ppm", shown: tuple[str, ...] = ("smiles", "formula")) -> DataFrame:
    """The candidates of each group's spectra that have a hit at all: (group, candidate, shown..., candidate_mode,
    num_spectra, num_filtered_spectra, num_supporting_spectra, mean_mass_error_ppm, mean_abs_mass_error_ppm).

    What is shown is that of the first spectrum. The hits are shuffled once, by group; groups without a hit have no row.
    """
    of_group = Window.partitionBy(group)
    rows = hits.repartition(group).withColumn("num_filtered_spectra", F.size(F.collect_set(spectrum).over(of_group)).cast("long"))
    by_candidate = rows.groupBy(group, "num_filtered_spectra", candidate).agg(
        F.min(F.struct(spectrum, *shown)).alias("__first"), F.count("*").alias("num_supporting_spectra"), F.avg(error).alias("mean_mass_error_ppm"), F.avg(F.abs(error)).alias("mean_abs_mass_error_ppm")
    )
    full = F.col("num_supporting_spectra") == F.col("num_filtered_spectra")
    marked = by_candidate.withColumn("candidate_mode", F.when(F.max(full).over(of_group), "intersection").otherwise("union_fallback"))
    sizes = spectra.groupBy(group).agg(F.count_distinct(spectrum).alias("num_spectra"))
    kept = marked.where(full | (F.col("candidate_mode") == "union_fallback")).join(sizes, group)
    return kept.select(group, candidate, *[F.col(f"__first.{c}").alias(c) for c in shown], "candidate_mode", "num_spectra", "num_filtered_spectra", "num_supporting_spectra", "mean_mass_error_ppm", "mean_abs_mass_error_ppm")


def threshold_pool(hits: DataFrame, spectra: DataFrame, thresholds: list[int], group: str = "grp", candidate: str = "structure") -> DataFrame:
    """(threshold, group, candidate, mode): the intersection where it has at least ``threshold`` candidates, else the union."""
    rows = supported(hits, spectra, group=group, candidate=candidate)
    full = F.col("n_supporting") == F.col("n_spectra")
    counted = rows.withColumn("full", full).withColumn("n_full", F.count_if(full).over(Window.partitionBy(group)))
    each = counted.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    use = F.col("n_full") >= F.col("threshold")
    return each.withColumn("mode", F.when(use, "intersection").otherwise("union")).where(~use | F.col("full")).select("threshold", group, candidate, "mode")


def availability_mask(pool: DataFrame, spectra: DataFrame, hits: DataFrame, group: str = "grp", spectrum: str = "spectrum_id", candidate: str = "structure") -> DataFrame:
    """(group, spectrum, candidate, available) for every spectrum of a group and every candidate of its pool."""
    cells = pool.select(group, candidate).join(spectra.select(group, spectrum).distinct(), group)
    marked = hits.select(spectrum, candidate).distinct().withColumn("available", F.lit(True))
    return cells.join(marked, [spectrum, candidate], "left").select(group, spectrum, candidate, F.coalesce("available", F.lit(False)).alias("available"))


def pool_mask(hits: DataFrame, spectra: DataFrame, group: str = "grp", spectrum: str = "spectrum_id", candidate: str = "structure") -> DataFrame:
    """availability_mask of select_pool, from one pass over the hits: each candidate brings the spectra that support it."""
    by_candidate = hits.groupBy(group, candidate).agg(F.collect_set(spectrum).alias("__own"))
    own = spectra.groupBy(group).agg(F.collect_set(spectrum).alias("__all"))
    full = F.size("__own") == F.size("__all")
    rows = by_candidate.join(own, group).withColumn("__any", F.max(full).over(Window.partitionBy(group))).where(full | ~F.col("__any"))
    return rows.select(group, F.explode("__all").alias(spectrum), candidate, "__own").withColumn("available", F.array_contains("__own", F.col(spectrum))).drop("__own")


def stand_ins(spectra: DataFrame, shown: list[str], group: str = "grp", spectrum: str = "spectrum_id") -> DataFrame:
    """(group, owner, members): groups whose spectra agree in ``shown`` have equal pools, so the smallest of them, the
    owner, is asked for all. ``members`` are the group's spectra by ``shown``, so that those of equal place agree too."""
    own = spectra.groupBy(group).agg(F.array_sort(F.collect_set(F.struct(*shown, spectrum))).alias("members"))
    own = own.withColumn("__like", F.transform("members", lambda m: F.struct(*[m[c].alias(c) for c in shown])))
    owners = own.groupBy("__like").agg(F.min(group).alias("owner"))
    return own.join(owners, "__like").select(group, "owner", "members")


def asked(groups: DataFrame, group: str = "grp") -> DataFrame:
    """The owners' spectra."""
    return groups.where(F.col(group) == F.col("owner")).select(group, F.inline("members"))


def for_all(result: DataFrame, groups: DataFrame, group: str = "grp") -> DataFrame:
    """The owners' rows for every group that they stand for. The rows are copied in the last join, so nothing after the mass join shuffles them."""
    shown = [c for c in result.columns if c != group]
    return result.withColumnRenamed(group, "owner").join(groups.select(group, "owner"), "owner").select(group, *shown)


def mask_for_all(mask: DataFrame, groups: DataFrame, group: str = "grp", spectrum: str = "spectrum_id") -> DataFrame:
    """``for_all`` of the rows of ``pool_mask``: a spectrum takes the marks of its owner's spectrum at the same place."""
    placed = groups.select(group, "owner", F.posexplode("members").alias("place", "m")).select(group, "owner", "place", F.col(f"m.{spectrum}").alias(spectrum))
    theirs = placed.where(F.col(group) == F.col("owner")).select(group, spectrum, "place")
    shown = [c for c in mask.columns if c not in (group, spectrum)]
    marks = mask.join(theirs, [group, spectrum]).select(F.col(group).alias("owner"), "place", *shown)
    return marks.join(placed, ["owner", "place"]).select(group, spectrum, *shown)


def key_overlap_checked(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key_overlap with the repeated keys of each side and whether the two id spaces are the same, one to one."""
    counts = key_overlap(left, right, key)
    for name, side in (("left", left), ("right", right)):
        repeated = side.groupBy(key).count().where("count > 1").agg(F.count("*").alias(f"n_{name}_repeated"))
        counts = counts.crossJoin(F.broadcast(repeated))  # one row
    sound = (F.col("n_left_only") == 0) & (F.col("n_right_only") == 0) & (F.col("n_left_repeated") == 0) & (F.col("n_right_repeated") == 0)
    return counts.withColumn("is_bijection", sound)


def one_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi-join whose keys must be unique on both sides; a repeated key fails the job, naming it.

    The check is part of the plan: the rows of each side are counted in the shuffle that the join needs anyway.
    """

    def checked(df: DataFrame, side: str) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(*on))
        bad = F.raise_error(F.concat(F.lit(f"repeated key in the {side} table: "), F.concat_ws(", ", *[F.col(c).cast("string") for c in on])))
        return df.withColumn("__n", n).where(F.when(F.col("__n") > 1, bad).otherwise(F.lit(True)).cast("boolean")).drop("__n")

    return checked(left, "left").join(checked(right, "right"), on, how)


def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys of both, of the left only, of the right only, of either."""
    a = left.select(key).distinct().withColumn("__l", F.lit(True))
    b = right.select(key).distinct().withColumn("__r", F.lit(True))
    both, left_only = F.col("__l").isNotNull() & F.col("__r").isNotNull(), F.col("__r").isNull()
    return a.join(b, key, "full_outer").agg(F.count_if(both).alias("n_both"), F.count_if(left_only).alias("n_left_only"), F.count_if(F.col("__l").isNull()).alias("n_right_only"), F.count("*").alias("n_union"))
