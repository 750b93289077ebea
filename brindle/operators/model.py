"""Activity prediction over sequences with built-in learners, and forward passes of given networks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def estimator(name: str, n_inputs: int):
    """A learner by name: logistic, trees, or a two-layer network on the flattened sequence."""
    if name == "logistic":
        return LogisticRegression(featuresCol="features", labelCol="label", maxIter=50, regParam=0.01)
    if name == "trees":
        return GBTClassifier(featuresCol="features", labelCol="label", maxIter=20, seed=42)
    if name == "network":
        return MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", layers=[n_inputs, 32, 16, 2], seed=42, maxIter=100)
    raise ValueError(f"unknown model {name!r}")


def as_vectors(sequences: DataFrame) -> DataFrame:
    """The flattened sequence as features."""
    return sequences.withColumn("features", array_to_vector(F.flatten("sequence")))


def fit_predict(train: DataFrame, score: DataFrame, name: str = "logistic", n_inputs: int = 0) -> DataFrame:
    """``score`` with activity_probability by a learner fitted on ``train`` (sequence, label)."""
    fitted = estimator(name, n_inputs).fit(as_vectors(train))
    made = fitted.transform(as_vectors(score)).withColumn("activity_probability", vector_to_array("probability")[1])
    return made.drop("features", "rawPrediction", "probability", "prediction")


def _linear(x: np.ndarray, w: dict[str, np.ndarray], name: str) -> np.ndarray:
    return x @ w[f"{name}.weight"].T + w[f"{name}.bias"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class SelectiveScan:
    """A sequence classifier of selective state-space blocks, scored with given weights (dropout is off when scoring).

    A block projects its input to a path and a gate; the path goes through a convolution of three steps for each channel and
    SiLU, then through a scan whose step size, input and output weights depend on the input, with a skip connection; gated, projected
    and normalised with the block's input. The mean over steps goes through two dense layers. Weights are named as in a saved
    state: input_proj, layers.k.(in_proj, conv1d, dt_proj, A, B_proj, C_proj, D, out_proj, norm), fc1, fc2.
    """

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: np.asarray(v, np.float64) for k, v in weights.items()}
        self.layers = len({k.split(".")[1] for k in self.w if k.startswith("layers.")})

    def block(self, x: np.ndarray, at: str) -> np.ndarray:
        w = {k[len(at) :]: v for k, v in self.w.items() if k.startswith(at)}
        path, gate = np.split(_linear(x, w, "in_proj"), 2, axis=-1)
        padded = np.pad(path, ((0, 0), (1, 1), (0, 0)))
        steps = x.shape[1]
        path = sum(padded[:, k : k + steps] * w["conv1d.weight"][:, 0, k] for k in range(3)) + w["conv1d.bias"]
        path = path * _sigmoid(path)
        size = np.logaddexp(0, _linear(path, w, "dt_proj"))
        into, out = _linear(path, w, "B_proj"), _linear(path, w, "C_proj")
        decay = -np.exp(w["A"])
        state, seen = np.zeros((len(x), *decay.shape)), []
        for t in range(steps):
            step = size[:, t, :, None]
            state = state * np.exp(step * decay) + step * into[:, t, None, :] * path[:, t, :, None]
            seen.append((state * out[:, t, None, :]).sum(-1) + w["D"] * path[:, t])
        y = _linear(np.stack(seen, 1) * (gate * _sigmoid(gate)), w, "out_proj") + x
        spread = y - y.mean(-1, keepdims=True)
        return spread / np.sqrt((spread**2).mean(-1, keepdims=True) + 1e-5) * w["norm.weight"] + w["norm.bias"]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Probability for each sequence of x (rows, steps, features)."""
        x = _linear(x, self.w, "input_proj")
        for k in range(self.layers):
            x = self.block(x, f"layers.{k}.")
        return _sigmoid(_linear(np.maximum(_linear(x.mean(1), self.w, "fc1"), 0), self.w, "fc2"))[:, 0]

    @classmethod
    def seeded(cls, features: int, width: int = 64, layers: int = 2, states: int = 16, seed: int = 42) -> SelectiveScan:
        """Random weights of the usual sizes, where no trained ones are at hand."""
        rng = np.random.default_rng(seed)
        w: dict[str, np.ndarray] = {}

        def dense(name: str, n_in: int, n_out: int) -> None:
            w[f"{name}.weight"], w[f"{name}.bias"] = (rng.uniform(-(n_in**-0.5), n_in**-0.5, s) for s in ((n_out, n_in), n_out))

        dense("input_proj", features, width)
        for k in range(layers):
            at = f"layers.{k}."
            for name, n_out in (("in_proj", 2 * width), ("dt_proj", width), ("B_proj", states), ("C_proj", states), ("out_proj", width)):
                dense(at + name, width, n_out)
            w[at + "conv1d.weight"], w[at + "conv1d.bias"] = rng.uniform(-0.577, 0.577, (width, 1, 3)), rng.uniform(-0.577, 0.577, width)
            w[at + "A"], w[at + "D"] = rng.normal(size=(width, states)), np.ones(width)
            w[at + "norm.weight"], w[at + "norm.bias"] = np.ones(width), np.zeros(width)
        dense("fc1", width, 32)
        dense("fc2", 32, 1)
        return cls(w)


def forward(sequences: DataFrame, network, key: str = "repo_key") -> DataFrame:
    """(key, activity_probability) by a network given as a function of an array (rows, steps, features), batch by batch."""
    kind = dict(sequences.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack([np.stack(s) for s in batch["sequence"]]).astype(np.float64)
                yield pd.DataFrame({key: batch[key], "activity_probability": network(x)})

    return sequences.select(key, "sequence").mapInPandas(run, f"{key} {kind}, activity_probability double")


def predictions_by_crate(scored: DataFrame, crates: DataFrame, fan_out: bool = False) -> DataFrame:
    """(crate_name, activity_probability): scores by repo_key joined to crates (repo_key, name, place); the last crate of a repo wins, or all with ``fan_out``."""
    names = crates.select("repo_key", "name") if fan_out else crates.groupBy("repo_key").agg(F.max_by("name", "place").alias("name"))
    return scored.join(names, "repo_key").select(F.col("name").alias("crate_name"), "activity_probability")
