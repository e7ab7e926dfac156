"""Loss histories of iterative learners: ``horizon, test_year, epoch, loss`` (epoch from 0)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Share of the last epochs looked at, and the limits in percent.
TAIL, FLAT_PCT, DECLINING_PCT = 0.20, 2.0, 10.0


def convergence_label(history: DataFrame, keys=("horizon", "test_year")) -> DataFrame:
    """Percentage drop of the loss over the last fifth of the epochs, and what it means."""
    keys = list(keys)
    n = history.groupBy(*keys).agg((F.max("epoch") + 1).alias("n_epochs"))
    j = history.join(n, keys)
    # rounds half to even, as the definition asks
    at80 = F.greatest(F.lit(1), F.bround(F.col("n_epochs") * (1 - TAIL)).cast("int") - 1)

    def at(pos):
        return F.max(F.when(F.col("epoch") == pos, F.col("loss")))

    r = j.groupBy(*keys, "n_epochs").agg(
        at(F.lit(0)).alias("loss_start"), at(F.floor(F.col("n_epochs") / 2)).alias("loss_mid"),
        at(at80).alias("loss_p80"), at(F.col("n_epochs") - 1).alias("loss_final"))
    drop = F.when(F.col("loss_p80") > 0, 100 * (F.col("loss_p80") - F.col("loss_final")) / F.col("loss_p80"))
    label = (F.when(drop.isNull(), "undefined").when(drop < FLAT_PCT, "converged")
             .when(drop < DECLINING_PCT, "converging").otherwise("under_trained"))
    return r.withColumns({"tail_drop_pct": drop, "convergence": label,
                          "loss_ratio": F.try_divide(F.col("loss_final"), F.col("loss_start"))})


def convergence_crosstab(labels: DataFrame, by: str = "horizon") -> DataFrame:
    kinds = ["converged", "converging", "under_trained", "undefined"]
    return labels.groupBy(by).agg(*[F.count_if(F.col("convergence") == k).alias(k) for k in kinds])
