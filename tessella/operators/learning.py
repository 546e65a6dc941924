"""Small networks, autoencoders, recurrent layers, feature engineering and preprocessing.

Prediction broadcasts the few weights into one Arrow-batched function.
Training is sample by sample in a given order, so stretches of the training
set are taken one after another, each by one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.ranges import quarters
from tessella.sources.scratch import written

ACTIVATIONS = {"relu": lambda x: np.maximum(x, 0.0), "sigmoid": lambda x: 1.0 / (1.0 + np.exp(-x)), "tanh": np.tanh, "linear": lambda x: x}
#: Their slopes, at the same argument.
SLOPES = {
    "relu": lambda x: (x > 0.0).astype(float),
    "sigmoid": lambda x: ACTIVATIONS["sigmoid"](x) * (1.0 - ACTIVATIONS["sigmoid"](x)),
    "tanh": lambda x: 1.0 - np.tanh(x) ** 2,
    "linear": np.ones_like,
}
#: Training rows that one task takes at a time.
STRETCH = 50_000


@dataclass
class Layer:
    weights: np.ndarray
    biases: np.ndarray
    activation: str

    @classmethod
    def fresh(cls, inputs: int, outputs: int, activation: str) -> Layer:
        return cls(np.full((outputs, inputs), 0.1), np.zeros(outputs), activation)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return ACTIVATIONS[self.activation](x @ self.weights.T + self.biases)


@dataclass
class Network:
    """Dense layers with equal first weights; the last is linear. Steps leave out the activation's slope."""

    inputs: int
    outputs: int
    hidden: tuple[int, ...] = (8,)
    activation: str = "relu"
    rate: float = 0.01
    epochs: int = 10
    layers: list[Layer] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not self.layers:
            sizes = [self.inputs, *self.hidden, self.outputs]
            kinds = [self.activation] * len(self.hidden) + ["linear"]
            self.layers = [Layer.fresh(a, b, k) for a, b, k in zip(sizes, sizes[1:], kinds, strict=False)]

    def forward(self, x: np.ndarray) -> np.ndarray:
        if x.shape[-1] != self.inputs:
            raise ValueError(f"{x.shape[-1]} inputs instead of {self.inputs}")
        for layer in self.layers:
            x = layer.forward(x)
        return x

    def step(self, x: np.ndarray, y: np.ndarray) -> float:
        seen = [x]
        for layer in self.layers:
            seen.append(layer.forward(seen[-1]))
        delta = 2.0 * (seen[-1] - y)
        loss = float(np.mean((seen[-1] - y) ** 2))
        for i in reversed(range(len(self.layers))):
            layer = self.layers[i]
            layer.biases = layer.biases - self.rate * delta
            layer.weights = layer.weights - self.rate * np.outer(delta, seen[i])
            delta = layer.weights.T @ delta
        return loss

    def train(self, rows: DataFrame, order: str = "seq") -> dict:
        """Passes over (seq, x, y) in order; the loss is that of the last pass.

        Each step needs the weights of the one before, so stretches of STRETCH
        rows go one after another, each one task that takes the weights and
        gives the next ones; only those come to the driver. Equal places in
        the order follow a hash of x and y.
        """
        from tessella.operators.rfm import positions

        placed = positions(rows.select(order, "x", "y"), [F.col(order).asc(), F.xxhash64("x", "y").asc()], "_i")
        placed = written(placed.withColumn("_stretch", F.floor(F.col("_i") / STRETCH)).repartition("_stretch").sortWithinPartitions("_stretch", "_i"), "training")
        n = placed.count()
        if not n:
            raise ValueError("there are no training rows")
        loss = 0.0
        for _ in range(self.epochs):
            loss = 0.0
            for i in range(-(-n // STRETCH)):
                part = placed.where(F.col("_stretch") == i).select("_i", "x", "y").coalesce(1)
                made = part.mapInPandas(_stepped(self), "loss double, weights array<double>").first()
                loss += made.loss
                self._take(np.array(made.weights))
        return {"epochs": self.epochs, "final_loss": loss / n, "samples_trained": n}

    def _given(self) -> np.ndarray:
        return np.concatenate([v.ravel() for layer in self.layers for v in (layer.weights, layer.biases)])

    def _take(self, values: np.ndarray) -> None:
        for layer in self.layers:
            w, b = layer.weights.size, layer.biases.size
            layer.weights, layer.biases, values = values[:w].reshape(layer.weights.shape), values[w : w + b], values[w + b :]

    def predict(self, rows: DataFrame, column: str = "x") -> DataFrame:
        """Adds ``prediction``."""
        return rows.withColumn("prediction", _applied(self.forward, column))

    def info(self) -> list[str]:
        return [f"Input: {self.inputs}", *[f"Layer {i}: {n.weights.shape[1]} → {n.weights.shape[0]} [{n.activation}]" for i, n in enumerate(self.layers)]]


def _stepped(net: Network) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [f for f in frames if len(f)]
        rows = pd.concat(found).sort_values("_i")  # STRETCH rows at most
        loss = sum(net.step(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(rows["x"], rows["y"], strict=True))
        yield pd.DataFrame({"loss": [loss], "weights": [net._given()]})

    return run


def _applied(f, column: str) -> Column:
    @F.pandas_udf("array<double>")
    def run(xs: pd.Series) -> pd.Series:
        return pd.Series(list(f(np.stack(xs)))) if len(xs) else pd.Series([], dtype=object)

    return run(F.col(column))


@dataclass
class Autoencoder:
    """Encoder and decoder of one layer each. Training works out the loss only; the weights stay."""

    inputs: int
    latent: int
    activation: str = "relu"

    def __post_init__(self) -> None:
        self.encoder, self.decoder = Layer.fresh(self.inputs, self.latent, self.activation), Layer.fresh(self.latent, self.inputs, "linear")

    def encode(self, rows: DataFrame, column: str = "x") -> DataFrame:
        return rows.withColumn("latent", _applied(self.encoder.forward, column))

    def reconstruct(self, rows: DataFrame, column: str = "x") -> DataFrame:
        return rows.withColumn("reconstructed", _applied(lambda x: self.decoder.forward(self.encoder.forward(x)), column))

    def anomaly_scores(self, rows: DataFrame, column: str = "x") -> DataFrame:
        gap = F.zip_with(column, "reconstructed", lambda a, b: (a - b) * (a - b))
        return self.reconstruct(rows, column).withColumn("anomaly_score", F.aggregate(gap, F.lit(0.0), lambda s, v: s + v) / F.size(column))

    def train(self, rows: DataFrame, column: str = "x") -> dict:
        r = self.anomaly_scores(rows, column).agg(F.avg("anomaly_score").alias("loss"), F.count("*").alias("n")).first()
        return {"epochs": 1, "final_loss": r.loss or 0.0, "samples_trained": r.n}


def recurrent_states(rows: DataFrame, key: str, hidden: int) -> DataFrame:
    """Hidden states of tanh(Wx + Uh) with all weights 0.1, over each key's (seq, x) in order.

    Each state needs the one before it, so one task walks a key's rows; they
    come sorted in batches, and only the last state is held between them.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, h = None, None
        for frame in frames:
            out = []
            for k, x in zip(frame["_key"], frame["x"], strict=True):
                if k != last:
                    last, h = k, np.zeros(hidden)
                h = np.tanh(np.full(hidden, 0.1 * np.sum(x)) + 0.1 * h.sum())
                out.append(h)
            yield frame[[key, "seq"]].assign(h=out)

    schema = rows.select(key, "seq").withColumn("h", F.lit(None).cast("array<double>")).schema
    told = F.to_json(F.struct(F.col(key)))  # told apart in Python, null too
    return rows.select(key, "seq", "x", told.alias("_key")).repartition("_key").sortWithinPartitions("_key", "seq").mapInPandas(run, schema)


# Feature engineering over columns.


def standardised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores by the population's deviation; 0 where all values agree."""
    ends = rows.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    out = rows.crossJoin(F.broadcast(ends))  # one row
    for c in columns:
        out = out.withColumn(c, F.when(F.col(f"_s_{c}") > 1e-10, (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 1e-10, F.col(f"_s_{c}"))).otherwise(0.0))
    return out.drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def polynomial(columns: list[str]) -> Column:
    """The columns and all products of two of them, each with itself too, as an array."""
    cells = [F.col(c).cast("double") for c in columns]
    return F.array(*cells, *[a * b for i, a in enumerate(cells) for b in cells[i:]])


def varied(rows: DataFrame, columns: list[str], threshold: float) -> DataFrame:
    """Columns whose variance is above a threshold: feature, variance."""
    one = rows.agg(*[F.var_pop(c).alias(c) for c in columns])
    return one.unpivot([], columns, "feature", "variance").where(F.col("variance") > threshold)


def heuristic_importance(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Share of each column in the sum of absolute values, with its rank."""
    from pyspark.sql import Window

    one = rows.agg(*[F.sum(F.abs(c)).alias(c) for c in columns]).unpivot([], columns, "feature", "total")
    share = F.col("total") / F.sum("total").over(Window.partitionBy())
    out = one.withColumn("importance_score", F.when(F.sum("total").over(Window.partitionBy()) > 0, share).otherwise(0.0))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance_score"), "feature"))).drop("total")  # one row per column


def heuristic_prediction(columns: list[str], importance: list[float]) -> Column:
    """A half and a tenth of the importance-weighted sum, within 0 and 1; importances are in order of rank."""
    total = sum((F.col(c) * F.lit(float(w)) * 0.1 for c, w in zip(columns, importance, strict=True)), F.lit(0.5))
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


#: Different values of a categorical column that are coded.
MOST_VALUES = 10_000


@dataclass
class Preprocessing:
    """Median imputing and scaling of numbers, most frequent imputing and one-hot coding of categories."""

    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    scale: bool = True
    encode: bool = True
    impute: bool = True
    fitted: dict | None = None

    def __post_init__(self) -> None:
        if not self.numeric and not self.categorical:
            raise ValueError("there are neither numeric nor categorical features")

    def fit(self, rows: DataFrame) -> Preprocessing:
        """A median a column, one row of moments, and the modes and values of categories come to the driver.

        Medians come from ranges of counted values. A categorical column with
        more than MOST_VALUES different values is an error, as each would be a place of the vector.
        """
        middle = dict.fromkeys(self.numeric)
        if self.numeric:
            long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in self.numeric])).alias("_")).select("_.*")
            middle |= {r.c: r["median"] for r in quarters(long, ["c"]).select("c", "median").collect()}
        filled = [(F.coalesce(F.col(c), F.lit(middle[c])) if self.impute else F.col(c)).cast("double") for c in self.numeric]
        moments = rows.agg(*[f(x).alias(f"{k}_{c}") for c, x in zip(self.numeric, filled, strict=True) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first().asDict() if self.numeric else {}
        modes, values = {}, {}
        for c in self.categorical:
            per = rows.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.count("*").alias("n"))
            found = per.limit(MOST_VALUES + 1).collect()
            if len(found) > MOST_VALUES:
                raise ValueError(f"{c} has more than {MOST_VALUES} values")
            modes[c] = min(found, key=lambda r: (-r.n, r.v)).v if found else None
            values[c] = sorted(r.v for r in found)
        self.fitted = {"middle": middle, "moments": moments, "modes": modes, "values": values}
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds ``features``; a category that wasn't seen is all zeros."""
        if self.fitted is None:
            raise RuntimeError("transform comes after fit")
        f, out = self.fitted, []
        for c in self.numeric:
            x = (F.coalesce(F.col(c), F.lit(f["middle"][c])) if self.impute else F.col(c)).cast("double")
            if self.scale:
                x = (x - F.lit(f["moments"][f"m_{c}"])) / F.lit(f["moments"][f"s_{c}"] or 1.0)
            out.append(x)
        for c in self.categorical:
            v = F.coalesce(F.col(c).cast("string"), F.lit(f["modes"][c])) if self.impute else F.col(c).cast("string")
            out += [F.coalesce((v == k).cast("double"), F.lit(0.0)) for k in f["values"][c]] if self.encode else [F.array_position(F.array(*[F.lit(k) for k in f["values"][c]]), v).cast("double") - 1]
        return rows.withColumn("features", F.array(*out))

    def fit_transform(self, rows: DataFrame) -> DataFrame:
        return self.fit(rows).transform(rows)


@dataclass
class PreprocessedSegmenter:
    """A preprocessor and a clustering that is fitted to what it makes of the rows.

    ``cluster`` takes rows of (id, features) and gives a model with ``transform``.
    """

    preprocessing: Preprocessing
    cluster: Callable[[DataFrame], object]
    model: object = None

    def fit(self, rows: DataFrame) -> PreprocessedSegmenter:
        self.model = self.cluster(self.preprocessing.fit_transform(rows))
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        if self.model is None:
            raise RuntimeError("predict comes after fit")
        return self.model.transform(self.preprocessing.transform(rows))


def fit_with_preprocessing(rows: DataFrame, cluster: Callable[[DataFrame], object], numeric: tuple[str, ...] = (), categorical: tuple[str, ...] = ()) -> PreprocessedSegmenter:
    """Builds a preprocessor, fits it, then fits the clustering."""
    return PreprocessedSegmenter(Preprocessing(numeric, categorical), cluster).fit(rows)
