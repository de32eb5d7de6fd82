"""Raw tickets to the scored, clustered snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbline.functions import scoring
from kerbline.operators import approval, clusters
from kerbline.session import Written
from kerbline.sources import snapshot, tickets


def score_and_cluster(scored: DataFrame, rounds: int = approval.ROUNDS,
                      model_path: str | None = None) -> DataFrame:
    """Scored tickets with approval probability and cluster label; saves the model when asked."""
    model = approval.fit_approval(scored, rounds)
    if model is not None and model_path is not None:
        model.save(model_path)
    # Written once: clusters are found on the likely tickets and then joined to all, and the trees run only here.
    likely = Written(scored.sparkSession, "scores").keep(approval.score_approval(model, scored))
    return clusters.attach_clusters(likely)


def run(spark: SparkSession, raw_path: str, staging_path: str, scored_path: str, model_path: str | None = None,
        rounds: int = approval.ROUNDS, by_month: bool = False) -> None:
    """Stage the scored tickets as Parquet, then train, cluster and write.

    Training, scoring and clustering each read only the staged columns they use.
    Rows with values that did not parse are listed under ``staging_path``/rejected,
    ids that occur twice under ``staging_path``/duplicates.
    """
    text = tickets.read_violations_text(spark, raw_path)
    tickets.rejected_rows(text).write.mode("overwrite").parquet(f"{staging_path}/rejected")
    scoring.score(tickets.type_violations(text)).write.mode("overwrite").parquet(f"{staging_path}/tickets")
    staged = spark.read.parquet(f"{staging_path}/tickets")
    tickets.duplicate_ids(staged).write.mode("overwrite").parquet(f"{staging_path}/duplicates")
    snapshot.write_scored(score_and_cluster(staged, rounds, model_path), scored_path, by_month)
