"""Training of the pair scorer: three stages of losses, gradients summed in the cluster, steps on a few weights at the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAGES = ("all_pairs", "top_pairs", "ranking")


@dataclass
class Trained:
    """Weights of the linear scorer (the last one is the bias) and what each epoch saw: (stage, epoch, loss, rate)."""

    features: tuple[str, ...]
    weights: np.ndarray
    history: list[tuple[str, int, float, float]] = field(default_factory=list)

    def score(self) -> Column:
        total = F.lit(float(self.weights[-1]))
        for name, w in zip(self.features, self.weights[:-1], strict=True):
            total = total + F.lit(float(w)) * F.col(name)
        return total


def _slopes(stage: str) -> tuple[Column, Column]:
    """Loss of a mention's row and its slope in the row's score, from score, gold, cost and the mention's other rows.

    all_pairs: every row by itself. top_pairs: the best right row and the best wrong one. ranking: the row that
    violates most, cost * (1 + its score - the best right one's), moves against the best right one.
    """
    own = Window.partitionBy("doc", "men")
    p = 1 / (1 + F.exp(-F.col("score")))
    right = F.col("gold") == 1
    log = lambda x: -F.log(F.greatest(x, F.lit(1e-12)))
    if stage == "all_pairs":
        return F.when(right, log(p)).otherwise(log(1 - p)), p - F.col("gold")
    key = F.struct("score", "ant")
    best = F.max(F.when(right, key)).over(own)
    worst = F.max(F.when(~right, key)).over(own)
    if stage == "top_pairs":
        chosen = (right & (key == best)) | (~right & (key == worst))
        return F.when(chosen & right, log(p)).when(chosen, log(1 - p)).otherwise(0.0), F.when(chosen, p - F.col("gold")).otherwise(0.0)
    slack = F.when(~right, F.col("cost") * (1 + F.col("score") - best["score"])).otherwise(0.0)
    most = F.max(F.struct(slack.alias("slack"), "ant", "cost")).over(own)
    violated = best.isNotNull() & (most["slack"] > 0)
    loss = F.when(violated & (F.col("ant") == most["ant"]), most["slack"]).otherwise(0.0)
    slope = F.when(violated & (F.col("ant") == most["ant"]), most["cost"]).when(violated & (key == best), -most["cost"]).otherwise(0.0)
    return loss, slope


def train_scorer(
    rows: DataFrame, features: tuple[str, ...], epochs: dict[str, int], rate: float = 0.1, decay: float = 0.5, least_rate: float = 1e-4, start: np.ndarray | None = None
) -> Trained:
    """Fits a linear scorer of (doc, men, ant, gold, cost, features); ant -1 is the mention itself.

    Stages follow one another, each from the weights of the one before. An epoch is one pass: slopes are window
    expressions over a mention's rows, and one row of sums (a number a feature) reaches the driver, which takes an
    RMSprop step. Where an epoch's loss doesn't fall, the rate is multiplied by ``decay``, down to ``least_rate``.
    ``rows`` should be a written table: each epoch reads it.
    """
    model = Trained(features, np.zeros(len(features) + 1) if start is None else start.astype(float).copy())
    for stage in STAGES:
        step, square, before = rate, np.zeros(len(features) + 1), np.inf
        for epoch in range(epochs.get(stage, 0)):
            loss, slope = _slopes(stage)
            sloped = rows.withColumn("score", model.score()).withColumns({"loss": loss, "slope": slope})
            sums = [F.sum(F.col("slope") * F.col(f)).alias(f"g{k}") for k, f in enumerate(features)]
            found = sloped.agg(*sums, F.sum("slope").alias("bias"), F.sum("loss").alias("loss"), F.count("*").alias("n")).first()
            n = max(1, found["n"])
            gradient = np.array([*(found[f"g{k}"] or 0.0 for k in range(len(features))), found["bias"] or 0.0]) / n
            mean = (found["loss"] or 0.0) / n
            if mean > before - 1e-9:
                step = max(least_rate, step * decay)
            before = mean
            model.history.append((stage, epoch, mean, step))
            square = 0.9 * square + 0.1 * gradient**2
            model.weights = model.weights - step * gradient / (np.sqrt(square) + 1e-8)
    return model


def training_rows(features: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Pairs with gold (0/1) as rows to train on, and for each mention a row of itself (ant -1, features 0), which is right
    where no antecedent is. Costs: 0.8 for a new entity that is missed, 0.4 for a link that is, 1 for a wrong link, 0 where right."""
    any_gold = F.max("gold").over(Window.partitionBy("doc", "men"))
    pairs = features.select("doc", "men", "ant", "gold", *names, any_gold.alias("linked"))
    own = pairs.groupBy("doc", "men").agg(F.max("linked").alias("linked")).select("doc", "men", F.lit(-1).alias("ant"), (1 - F.col("linked")).alias("gold"), *[F.lit(0).alias(f) for f in names], "linked")
    cost = F.when(F.col("gold") == 1, 0.0).when(F.col("ant") < 0, 0.4).when(F.col("linked") == 1, 1.0).otherwise(0.8)
    return pairs.unionByName(own).withColumn("cost", cost).drop("linked")
