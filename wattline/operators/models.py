"""Per-regime boosted trees: every point of the grid is fitted by a task of its own."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions import boosting
from wattline.operators.calibrate import REGIMES
from wattline.sources.sinks import written

TARGETS = ("price", "floor", "peak")
#: Rows of a regime and split that the fits read; beyond it they are drawn by a hash of their features.
MOST_ROWS = 200_000
#: Rows whose bin numbers travel as one piece.
PIECE = 8192


def _pieces(rows: DataFrame, columns: Sequence[str], cuts: list[np.ndarray]) -> DataFrame:
    """(regime, split, n, y, x): prices and bin numbers of up to ``PIECE`` rows each."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (regime, split), part in frame.groupby(["regime", "split"]):
                for low in range(0, len(part), PIECE):
                    own = part.iloc[low : low + PIECE]
                    x = boosting.bin_numbers([own[c].to_numpy(np.float64, na_value=np.nan) for c in columns], cuts)
                    y = own["target_price"].to_numpy(np.float64)
                    yield pd.DataFrame({"regime": [regime], "split": [split], "n": [len(y)], "y": [y.tobytes()], "x": [x.tobytes()]})

    return rows.mapInPandas(pack, "regime string, split string, n int, y binary, x binary")


def fit_grid(features: DataFrame, columns: Sequence[str], low: float, high: float, depths: Sequence[int], leaves: Sequence[int], rounds: int, class_rounds: int, patience: int | None, bins: int, most_rows: int, seed: int) -> tuple[DataFrame, list[np.ndarray]]:
    """(regime, target, depth, leaf, loss, trees, model, importances) for every point, and the bin edges of the columns.

    The fits of all points are one Spark job with a task per point; bin edges are quantiles over all rows.
    """
    labelled = features.where(F.col("split").isin("train", "val") & F.col("target_price").isNotNull())
    sizes = labelled.groupBy("regime", "split").agg(F.count(F.lit(1)).alias("_n"))
    share = F.pmod(F.xxhash64(F.lit(seed), "target_price", *columns), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = labelled.join(sizes, ["regime", "split"]).where(share < F.lit(float(most_rows)) / F.col("_n"))
    at = [i / (bins - 1) for i in range(1, bins - 1)]
    found = labelled.where("split = 'train'").agg(*[F.percentile_approx(F.col(c).cast("double"), at).alias(f"c{j}") for j, c in enumerate(columns)]).first()
    cuts = [np.unique(np.array(found[f"c{j}"] or [], np.float64)) for j in range(len(columns))]
    pieces = _pieces(drawn.select("regime", "split", "target_price", *[F.col(c).cast("double").alias(c) for c in columns]), columns, cuts)
    # hard points first, so that no long fit starts last
    points = [(t, d, leaf) for d in sorted(depths, reverse=True) for leaf in leaves for t in TARGETS]
    grid = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.lit(d).alias("depth"), F.lit(leaf).alias("leaf")) for t, d, leaf in points]))
    tasks = len(points) * len(REGIMES)
    width = len(columns)

    def fit_point(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        regime, target, depth, leaf = key
        parts = {}
        for split in ("train", "val"):
            own = frame[frame["split"] == split].sort_values(["n", "y"])
            x = np.frombuffer(b"".join(own["x"]), np.uint8).reshape(-1, width)
            y = np.frombuffer(b"".join(own["y"]), np.float64)
            parts[split] = x, y if target == "price" else (y <= low if target == "floor" else y >= high).astype(np.float64)
        classes = target != "price"
        model, losses = boosting.fit(*parts["train"], *parts["val"], bins, classes, depth, leaf, class_rounds if classes else rounds, l2=0.0 if classes else 0.05, patience=patience)
        loss = min(losses) if len(parts["val"][1]) else losses[-1]
        weights = [float(w) for w in model.importances(width)]
        return pd.DataFrame({"regime": [regime], "target": [target], "depth": [depth], "leaf": [leaf], "loss": [loss], "trees": [len(model.trees)], "model": [pickle.dumps(model)], "importances": [weights]})

    spread = pieces.withColumn("g", grid).select("regime", "split", "n", "y", "x", "g.*").repartition(tasks, "regime", "target", "depth", "leaf")
    fitted = spread.groupBy("regime", "target", "depth", "leaf").applyInPandas(fit_point, "regime string, target string, depth int, leaf int, loss double, trees int, model binary, importances array<double>")
    return written(fitted, "fits"), cuts


def regime_gbt(
    features: DataFrame, columns: Sequence[str], low: float, high: float, depths: Sequence[int] = (4, 6, 8), leaves: Sequence[int] = (10, 20, 40),
    rounds: int = 400, class_rounds: int = 300, patience: int | None = 40, bins: int = 64, most_rows: int = MOST_ROWS, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Price regressor plus floor and peak classifiers per regime.

    ``features`` holds ``regime, split, target_price`` and the columns, each of which is a number or null. Every point of
    ``depths`` x ``leaves`` is fitted; the first of the lowest loss on the validation rows (mean absolute error, or the mean squared
    error of the probability) predicts all test rows. The loss is known after every tree: trees after the lowest one
    are dropped, and a fit ends after ``patience`` trees without a lower one (None: all are grown). A regime without
    validation rows is judged on its training rows. The fits read at most about ``most_rows`` rows per regime and split,
    drawn by hash; everything else reads all rows. Returns test predictions with probabilities, and the feature importances.
    """
    spark = features.sparkSession
    ready = written(features, "features")
    fits, cuts = fit_grid(ready, columns, low, high, depths, leaves, rounds, class_rounds, patience, bins, most_rows, seed)
    # ties go to the first point of the grid
    order = F.struct("loss", F.array_position(F.lit(list(depths)), F.col("depth")), F.array_position(F.lit(list(leaves)), F.col("leaf")))
    chosen = written(fits.groupBy("regime", "target").agg(F.min_by(F.struct("depth", "leaf", "loss", "model", "importances"), order).alias("m")).select("regime", "target", "m.*"), "models")
    # three models per regime
    models = spark.sparkContext.broadcast({(r["regime"], r["target"]): pickle.loads(r["model"]) for r in chosen.select("regime", "target", "model").toLocalIterator()})
    test = ready.where(F.col("split") == "test").withColumns({"is_floor": (F.col("target_price") <= low).cast("double"), "is_peak": (F.col("target_price") >= high).cast("double")})
    names = {"price": "prediction", "floor": "floor_p", "peak": "peak_p"}
    own, width = test.columns, len(columns)
    numbers = [F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(columns)]

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = boosting.bin_numbers([frame[f"_x{j}"].to_numpy(np.float64, na_value=np.nan) for j in range(width)], cuts)
            out = frame[own].assign(**dict.fromkeys(names.values(), np.nan))
            for regime, at in frame.groupby("regime").indices.items():
                for target, name in names.items():
                    if (regime, target) in models.value:
                        out.iloc[at, out.columns.get_loc(name)] = models.value[regime, target].predict(x[at])
            yield out

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in test.schema)
    scored = test.select("*", *numbers).mapInPandas(predict, kept + ", prediction double, floor_p double, peak_p double")
    report = chosen.where("target = 'price'").select("regime", F.col("loss").alias("val_mae"), "depth", "leaf")
    rows = F.explode(F.arrays_zip(F.lit(list(columns)).alias("feature"), F.col("importances").alias("importance")))
    importances = chosen.where("target = 'price'").select("regime", rows.alias("r")).select("regime", "r.*")
    return scored.join(report, "regime", "left"), importances
