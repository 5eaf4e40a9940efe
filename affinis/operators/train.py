"""Training: text classifiers by spark.ml, a threshold as the linkage model, the
losses of contrastive fine-tuning as functions, and configurations."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import col
from ..functions.text import serialize
from .embed import Embedder, Ngrams
from .linkage import evaluate_pairs
from .metrics import best_threshold, class_weights, classification_metrics
from .prep import classification_data, split_of


@dataclass
class LinkageConfig:
    """What a linkage training run needs; JSON in, JSON out."""

    left_on: list[str] = field(default_factory=list)
    right_on: list[str] = field(default_factory=list)
    label: str = "label"
    train: float = 0.8
    val: float = 0.1
    seed: int = 22
    n: int = 3

    @classmethod
    def read(cls, path: str, **changes) -> LinkageConfig:
        with open(path) as file:
            return cls(**(json.load(file) | changes))

    def write(self, path: str) -> None:
        with open(path, "w") as file:
            json.dump(asdict(self), file, indent=1)


def train_linkage(pairs: DataFrame, config: LinkageConfig, embedder: Embedder | None = None) -> tuple[float, dict[str, float]]:
    """The threshold of most F1 on the training split, and the measures of the
    rule on the test split."""
    scored = evaluate_pairs(pairs, config.left_on, config.right_on, embedder or Ngrams(config.n))
    keyed = scored.withColumn("__split", split_of(F.concat_ws("|", serialize(config.left_on), serialize(config.right_on)), config.train, config.val, config.seed))
    found = best_threshold(keyed.where("__split = 'train'"), "score", config.label).collect()
    threshold = found[0]["threshold"] if found and found[0]["threshold"] is not None else 1.0
    test = keyed.where("__split = 'test'").withColumn("__p", F.coalesce((F.col("score") >= threshold).cast("int"), F.lit(0)))
    return threshold, classification_metrics(test, config.label, "__p").collect()[0].asDict()


def train_classifier(df: DataFrame, on: list[str], label: str, features: int = 1 << 14, weighted: bool = True, seed: int = 22) -> tuple[PipelineModel, DataFrame, dict[str, float]]:
    """A text classifier over words and pairs of words, weighted by their rarity,
    with its label numbers and its measures on the test split. ``weighted`` gives rarer labels more weight."""
    data = classification_data(df, on, label, seed=seed).where("number is not null")
    labels = data.where("split = 'train'").select("label", "number").distinct()
    training = data.where("split = 'train'")
    training = training.join(F.broadcast(class_weights(training, "label")), "label") if weighted else training.withColumn("weight", F.lit(1.0))
    steps = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\s+"),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        HashingTF(inputCol="words", outputCol="word_counts", numFeatures=features),
        HashingTF(inputCol="pairs", outputCol="pair_counts", numFeatures=features),
        VectorAssembler(inputCols=["word_counts", "pair_counts"], outputCol="counts"),
        IDF(inputCol="counts", outputCol="features", minDocFreq=2),
        LogisticRegression(labelCol="number", weightCol="weight", maxIter=30, regParam=1e-3),
    ]
    model = Pipeline(stages=steps).fit(training.withColumn("number", F.col("number").cast("double")))
    test = predict(model, data.where("split = 'test'"), "text")
    return model, labels, classification_metrics(test, "number", "prediction", "weighted").collect()[0].asDict()


def predict(model: PipelineModel, df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``prediction`` (a label number) and ``probabilities``."""
    named = df.withColumn("text", F.coalesce(F.col(text), F.lit("")))
    out = model.transform(named)
    return out.select(*[col(c) for c in df.columns], F.col("prediction").cast("long").alias("prediction"), vector_to_array("probability").alias("probabilities"))


def supervised_contrastive_loss(vectors: np.ndarray, labels: np.ndarray, temperature: float = 0.07) -> float:
    """Mean over anchors with a partner of the mean negative log-probability of
    its partners among all others, under a softmax of cosines."""
    x = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    logits = x @ x.T / temperature
    np.fill_diagonal(logits, -np.inf)
    log_p = logits - np.logaddexp.reduce(logits, axis=1, keepdims=True)
    same = labels[:, None] == labels
    np.fill_diagonal(same, False)
    some = same.any(1)
    return float(np.mean([-log_p[i, same[i]].mean() for i in np.flatnonzero(some)])) if some.any() else 0.0


def online_contrastive_loss(distances: np.ndarray, labels: np.ndarray, margin: float = 0.5) -> float:
    """Over hard pairs only: positives farther than the nearest negative, and
    negatives nearer than the farthest positive."""
    far, near = distances[labels == 1], distances[labels == 0]
    hard_near = near[near < (far.max() if len(far) > 1 else near.mean() if len(near) else 0)]
    hard_far = far[far > (near.min() if len(near) > 1 else far.mean() if len(far) else 0)]
    return float((hard_far**2).sum() + (np.maximum(margin - hard_near, 0) ** 2).sum())
