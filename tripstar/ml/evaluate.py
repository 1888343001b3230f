"""Split, metrics, selection score and best-model choice, as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the model-selection rule: hold-out share, seed, CV folds,
# and the penalty on the train–test R² gap.
TEST_PERCENT = 20
SEED = 42
N_FOLDS = 5
GAP_PENALTY = 2.0


def hash_bucket(key: Column, seed: int = SEED, buckets: int = 100) -> Column:
    """A stable bucket in [0, buckets) from the md5 of ``seed:key``.

    Depends only on the row key, never on partitioning or row order, so the
    split is the same on every run and every cluster size.
    """
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10)
    return (h.cast("long") % buckets).cast("int")


def with_split(df: DataFrame, key: Column, test_percent: int = TEST_PERCENT, seed: int = SEED) -> DataFrame:
    return df.withColumn("is_test", hash_bucket(key, seed) < test_percent)


def with_fold(df: DataFrame, key: Column, n_folds: int = N_FOLDS, seed: int = SEED) -> DataFrame:
    return df.withColumn("fold", hash_bucket(key, seed, 100) % n_folds)


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                       by: list[str] | None = None) -> DataFrame:
    """RMSE, MAE, R² and MAPE in one aggregate (per group of ``by``).

    R² = 1 − Σe² / Σ(y − ȳ)², with Σ(y − ȳ)² = n · var_pop(y), which Spark merges
    without cancellation. MAPE is in percent over rows with y ≠ 0.
    """
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    e = y - p
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.lit(1.0) - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"),
        (F.avg(F.when(y != 0, F.abs(e / y))) * 100).alias("mape"),
    ]
    return pred.groupBy(*(by or [])).agg(*aggs)


def selection_score(test_r2: Column, train_r2: Column, gap: str = "signed") -> Column:
    """test R² − penalty × (train R² − test R²); ``gap="absolute"`` uses |gap|."""
    g = train_r2 - test_r2
    if gap == "absolute":
        g = F.abs(g)
    elif gap != "signed":
        raise ValueError("gap must be 'signed' or 'absolute'")
    return test_r2 - F.lit(GAP_PENALTY) * g


def with_scores(metrics: DataFrame, gap: str = "signed") -> DataFrame:
    """Add ``r2_gap`` (absolute, as stored) and ``selection_score``."""
    return metrics.withColumns({
        "r2_gap": F.abs(F.col("train_r2") - F.col("test_r2")),
        "selection_score": selection_score(F.col("test_r2"), F.col("train_r2"), gap),
    })


def backfill_scores(metrics: DataFrame) -> DataFrame:
    """Older metric rows lack the gap or the score: derive them the way old readers did.

    gap = stored r2_gap, else train − test; score = stored score, else test − 2 × gap.
    """
    cols = metrics.columns
    stored_gap = F.col("r2_gap") if "r2_gap" in cols else F.lit(None).cast("double")
    stored_score = F.col("selection_score") if "selection_score" in cols else F.lit(None).cast("double")
    gap = F.coalesce(stored_gap, F.col("train_r2") - F.col("test_r2"))
    return metrics.withColumns({
        "r2_gap": gap,
        "selection_score": F.coalesce(stored_score, F.col("test_r2") - F.lit(GAP_PENALTY) * gap),
    })


# Scores equal to this many decimals are a tie (collinear candidates reach the
# same score up to rounding noise, which differs between engines).
TIE_DIGITS = 9


def _tie(c: str) -> Column:
    return F.round(F.col(c), TIE_DIGITS)


def select_best(metrics: DataFrame, by: str = "task", order_col: str = "model_order") -> DataFrame:
    """Highest selection score per task; the earlier model wins a tie."""
    w = Window.partitionBy(by).orderBy(_tie("selection_score").desc(), F.col(order_col).asc())
    return (metrics.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") == 1)
            .drop("_rank"))


METRIC_COLUMNS = ["train_rmse", "test_rmse", "train_mae", "test_mae", "train_r2", "test_r2",
                  "cv_rmse_mean", "cv_rmse_std", "r2_gap", "selection_score"]


def metrics_table(metrics: DataFrame, by: str = "task") -> DataFrame:
    """Wide comparison table with best flags: max score, max test R², min gap."""
    w = Window.partitionBy(by)
    return metrics.select(
        by, "model", *[c for c in METRIC_COLUMNS if c in metrics.columns],
        (_tie("selection_score") == F.max(_tie("selection_score")).over(w)).alias("best_score"),
        (_tie("test_r2") == F.max(_tie("test_r2")).over(w)).alias("best_test_r2"),
        (_tie("r2_gap") == F.min(_tie("r2_gap")).over(w)).alias("smallest_gap"))
