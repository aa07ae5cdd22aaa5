"""Training runs: logs, early stopping, schedules and decoding cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import vectors as V

PATIENCE = 10


def run_log(df: DataFrame) -> DataFrame:
    """Each run and epoch once: repeated rows count once, of different rows of an epoch the one with the least losses."""
    keys = df.where("run_id IS NOT NULL AND epoch IS NOT NULL")
    rest = F.struct(F.col("valid_loss").isNull().alias("n1"), "valid_loss", F.col("train_loss").isNull().alias("n2"), "train_loss", "train_time", "valid_time")
    one = keys.groupBy("run_id", "epoch").agg(F.min(rest).alias("r"))
    return one.select("run_id", "epoch", "r.train_loss", "r.valid_loss", "r.train_time", "r.valid_time")


def early_stopping(log: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """(run_id, epoch, valid_loss, improved, waited, stopped): strict improvements of the running best, epochs waited since, and whether
    the run stops there. Epochs after the stop are left out. A NULL loss is no improvement."""
    of_run = Window.partitionBy("run_id").orderBy("epoch")
    before = F.min("valid_loss").over(of_run.rowsBetween(Window.unboundedPreceding, -1))
    seen = log.withColumn("improved", F.col("valid_loss").isNotNull() & (before.isNull() | (F.col("valid_loss") < before)))
    seen = seen.withColumn("_n", F.row_number().over(of_run)).withColumn("_last", F.max(F.when(F.col("improved"), F.col("_n"))).over(of_run))
    seen = seen.withColumn("waited", (F.col("_n") - F.coalesce("_last", F.lit(0))).cast("long")).withColumn("stopped", F.col("waited") >= patience)
    stops = F.coalesce(F.sum(F.col("stopped").cast("long")).over(of_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return seen.withColumn("_s", stops).where("_s = 0").select("run_id", "epoch", "valid_loss", "improved", "waited", "stopped")


def schedule(steps: DataFrame, warm_up: int, total: str = "total", rate: float = 1e-5) -> DataFrame:
    """``steps`` (…, step, total) with ``lr``: linear up to ``warm_up``, then linear down to 0 at the last step."""
    down = F.greatest(F.lit(0.0), (F.col(total) - F.col("step")) / F.greatest(F.lit(1), F.col(total) - warm_up))
    return steps.withColumn("lr", F.lit(rate) * F.when(F.col("step") < warm_up, F.col("step") / F.lit(max(1, warm_up))).otherwise(down))


def best_trial(df: DataFrame) -> DataFrame:
    """The trial with the least loss, the first by id of equals; trials without a loss are none."""
    row = F.min(F.struct("val_loss", "trial_id", "learning_rate", "batch_size")).alias("b")
    return df.where("val_loss IS NOT NULL AND NOT isnan(val_loss)").agg(row).where("b IS NOT NULL").select("b.trial_id", "b.learning_rate", "b.batch_size", "b.val_loss")


def resume_points(log: DataFrame) -> DataFrame:
    """(run_id, last_epoch, next_epoch, best_loss) of ``run_log`` rows: an epoch is done once its validation loss is known; a run without any starts at 0."""
    done = F.max(F.when(F.col("valid_loss").isNotNull(), F.col("epoch")))
    return log.groupBy("run_id").agg(done.alias("last_epoch"), F.coalesce(done + 1, F.lit(0)).alias("next_epoch"), F.min("valid_loss").alias("best_loss"))


def answers(df: DataFrame, key: str, logits: str, said: dict[int, str], default: str) -> DataFrame:
    """(key, answer): what ``said`` holds for the first greatest of each vector of logits, else the default; the default, too, for NULL and empty vectors."""
    return df.select(key, V.argmax(logits).alias("class")).select(key, V.looked_up("class", said, default).alias("answer"))


def decoding_cut(df: DataFrame, key: str, vector: str, k: int = 50, p: float = 0.95, temperature: float = 1.0) -> DataFrame:
    """(key, token, prob): of each vector of logits the ``k`` largest, then the fewest of these whose probability reaches ``p``."""
    # All inside the row: the vector is sorted, cut and summed as an array, and only what is kept leaves it.
    pairs = F.transform(vector, lambda x, i: F.struct((-(x.cast("double") / temperature)).alias("down"), i.cast("long").alias("token")))
    top = df.select(key, F.slice(F.array_sort(pairs), 1, k).alias("top"))
    risen = F.transform("top", lambda x: F.exp(F.col("top")[0]["down"] - x["down"]))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    top = top.withColumn("e", risen).withColumn("whole", add("e"))
    kept = F.transform("top", lambda x, i: F.struct(x["token"].alias("token"), (F.col("e")[i] / F.col("whole")).alias("prob"), (add(F.slice("e", 1, i)) / F.col("whole")).alias("before")))
    return top.select(key, F.explode(kept).alias("x")).where(F.col("x.before") < p).select(key, "x.token", "x.prob")
