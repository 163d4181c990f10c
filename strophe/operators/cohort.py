"""One row per subject from phenotype rows and the feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: phenotype columns of the cohort table
COHORT_COLUMNS = (
    "repertoire_size", "entropy", "entropy_scaled", "entropy_no_intro", "entropy_scaled_no_intro",
    "repeat_bool", "dyad_bool", "num_dyad", "num_longer", "mean_repeat", "median_repeat",
    "var_repeat", "n_songs", "n_segments", "has_intro", "intro_recurs", "mean_intro", "std_intro",
)


def cohort_table(
    phenotypes: DataFrame, features: DataFrame, rank: str = "manual",
    measures: Sequence[str] = ("duration", "prev_gap", "song_length"),
) -> DataFrame:
    """Phenotype columns of one rank beside mean timings; the newest run of every subject.

    ``phenotypes`` carries ``run`` and ``run_at``. Subjects without a repertoire are left out.
    """
    columns = [c for c in COHORT_COLUMNS if c in phenotypes.columns]
    newest = (
        phenotypes.where(F.col("rank") == rank)
        .groupBy("subject")
        .agg(F.max_by(F.struct("run", *columns), F.struct("run_at", "run")).alias("p"))
        .select("subject", "p.*")
        .where(F.col("repertoire_size") > 0)
    )
    timing = features.groupBy("subject").agg(*[F.avg(m).alias(f"mean_{m}") for m in measures])
    return newest.join(timing, "subject", "left").orderBy("subject")
