"""Observations to the stored feature and target tables, one partition per alignment version."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.operators.alignment import features_as_published
from volpanel.operators.features import FEATURES, build_features, returns_and_targets
from volpanel.operators.panel import number_rows
from volpanel.sources import io
from volpanel.sources.stage import stage

KEEP = ("series_id", "obs_date", "year", "row_no", "har_daily", *FEATURES)


def write_features(observations: DataFrame, publication: DataFrame, root: str) -> None:
    """Write ``features`` in both alignments under ``root``.

    ``publication`` is the publication calendar (``day``, ``publication_date``).
    """
    numbered = stage(number_rows(observations), "numbered")
    by_row = build_features(numbered).select(*KEEP, F.lit("row").alias("alignment"))
    dated = numbered.join(publication.withColumnRenamed("day", "obs_date"), "obs_date", "left")
    as_published = features_as_published(dated).select(*KEEP, F.lit("published").alias("alignment"))
    io.write_table(by_row.unionByName(as_published), f"{root}/features", ("alignment",))


def write_targets(observations: DataFrame, horizons, root: str) -> None:
    t = returns_and_targets(number_rows(observations), horizons)
    io.write_table(t.select("series_id", "obs_date", "row_no", *[f"target_vol_{h}" for h in horizons]), f"{root}/targets")
