"""Structured determinantal point processes: message passing on trellises, kernels and samplers (numpy kernels)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def elementary_symmetric(values: np.ndarray, k: int) -> np.ndarray:
    """e[j, i]: sum over all j-subsets of the first i values of their products, for j up to k."""
    e = np.zeros((k + 1, len(values) + 1))
    e[0] = 1
    for j in range(1, k + 1):
        e[j, 1:] = np.cumsum(values * e[j - 1, :-1])
    return e


def sample_k(values: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Indices of k eigenvectors, a set with probability in proportion to its product of eigenvalues."""
    e = elementary_symmetric(values, k)
    out, left = [], k
    for i in range(len(values), 0, -1):
        if not left:
            break
        if i == left or rng.random() < values[i - 1] * e[left - 1, i - 1] / e[left, i]:
            out.append(i - 1)
            left -= 1
    return np.array(out[::-1], dtype=int)


@dataclass
class Trellis:
    """Sequences of ``length`` nodes: ``first`` scores a start, ``quality`` every later node, ``step`` a transition."""

    step: np.ndarray
    first: np.ndarray
    quality: np.ndarray
    length: int

    def forward(self) -> np.ndarray:
        """Sum over prefixes that end in a node, for each position."""
        out = [self.first]
        for _ in range(self.length - 1):
            out.append(self.quality * (out[-1] @ self.step))
        return np.array(out)

    def backward(self) -> np.ndarray:
        """Sum over suffixes that follow a node, for each position."""
        out = [np.ones(len(self.first))]
        for _ in range(self.length - 1):
            out.append(self.step @ (self.quality * out[-1]))
        return np.array(out[::-1])

    def partition(self) -> float:
        return float(self.forward()[-1].sum())

    def marginals(self) -> np.ndarray:
        total = self.partition()
        return self.forward() * self.backward() / total if total else np.zeros((self.length, len(self.first)))

    def sample(self, rng: np.random.Generator) -> list[int] | None:
        """One sequence in proportion to its score; None if no sequence has one."""
        back = self.backward()
        weight = self.first * back[0]
        out = []
        for t in range(self.length):
            if t:
                weight = self.step[out[-1]] * self.quality * back[t]
            total = weight.sum()
            if total <= 0:
                return None
            out.append(int(rng.choice(len(weight), p=weight / total)))
        return out

    def second_moment(self, features: np.ndarray) -> np.ndarray:
        """Sum over sequences of score times the outer product of their summed features (the dual kernel)."""
        dims = features.shape[1]
        mass, mean = self.first, self.first[:, None] * features
        square = self.first[:, None, None] * features[:, :, None] * features[:, None, :]
        for _ in range(self.length - 1):
            carried_mass, carried_mean = self.step.T @ mass, self.step.T @ mean
            carried_square = (self.step.T @ square.reshape(len(mass), -1)).reshape(-1, dims, dims)
            outer = features[:, :, None] * features[:, None, :]
            cross = carried_mean[:, :, None] * features[:, None, :]
            square = self.quality[:, None, None] * (carried_square + cross + cross.transpose(0, 2, 1) + carried_mass[:, None, None] * outer)
            mean = self.quality[:, None] * (carried_mean + carried_mass[:, None] * features)
            mass = self.quality * carried_mass
        return square.sum(axis=0)

    def covariance(self, features: np.ndarray) -> np.ndarray:
        """The second moment as an expectation: divided by the partition sum."""
        total = self.partition()
        return self.second_moment(features) / total if total else np.zeros((features.shape[1],) * 2)


def decompose(kernel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (not below 0) and eigenvectors of a symmetric kernel."""
    values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
    return np.maximum(values, 0), vectors


def sample_dpp(values: np.ndarray, vectors: np.ndarray, rng: np.random.Generator, k: int | None = None) -> list[int]:
    """One subset of items of a determinantal process (of size k, if given)."""
    chosen = sample_k(values, k, rng) if k is not None else np.flatnonzero(rng.random(len(values)) < values / (1 + values))
    v = vectors[:, chosen]
    out = []
    for _ in range(v.shape[1]):
        p = (v**2).sum(axis=1)
        item = int(rng.choice(len(p), p=p / p.sum()))
        out.append(item)
        pivot = int(np.abs(v[item]).argmax())
        v = np.delete(v - np.outer(v[:, pivot], v[item] / v[item, pivot]), pivot, axis=1)
        v = np.linalg.qr(v)[0] if v.shape[1] else v
    return sorted(out)


def sample_dual(features: np.ndarray, rng: np.random.Generator, k: int | None = None) -> list[int]:
    """The same from features (items by dims), by way of their dims by dims kernel."""
    values, vectors = decompose(features.T @ features)
    keep = values > values.max(initial=0) * 1e-10
    return sample_dpp(values[keep], features @ vectors[:, keep] / np.sqrt(values[keep]), rng, k)


def sample_sequences(model: Trellis, features: np.ndarray, k: int, rng: np.random.Generator, values=None, vectors=None) -> list[list[int]]:
    """k diverse sequences: eigenvectors of the dual kernel are chosen, then sequences drawn one by one, each
    in proportion to score times its feature's share in what is left of the chosen space."""
    if values is None:
        values, vectors = decompose(model.second_moment(features))
    keep = values > values.max(initial=0) * 1e-10
    values, vectors = values[keep], vectors[:, keep]
    chosen = sample_k(values, min(k, len(values)), rng)
    basis = vectors[:, chosen] / np.sqrt(values[chosen])
    out = []
    while basis.shape[1]:
        # a mixture over basis vectors: pick one, then a sequence by its squared projection (rejection on score samples)
        draws = [s for s in (model.sample(rng) for _ in range(200)) if s]
        if not draws:
            break
        power = np.array([(features[s].sum(axis=0) @ basis) ** 2 for s in draws]).sum(axis=1)
        if power.sum() <= 0:
            break
        pick = draws[int(rng.choice(len(draws), p=power / power.sum()))]
        out.append(pick)
        along = features[pick].sum(axis=0) @ basis
        rest = np.eye(basis.shape[1]) - np.outer(along, along) / (along @ along)
        _, s, vt = np.linalg.svd(rest)
        basis = basis @ vt[s > 0.5].T
    return out


def part_model(items: pd.DataFrame, length: int, threshold: float = 0.2) -> tuple[np.ndarray, Trellis, np.ndarray]:
    """Positions, model and features of one part's items (pos, vec): similarity steps forward in position, and the
    weighted degree as quality of a start."""
    items = items.sort_values("pos")
    v = np.stack(items["vec"].to_numpy()).astype(float)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    v = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
    sim = v @ v.T
    sim[sim <= threshold] = 0
    model = Trellis(np.triu(sim, 1), sim.sum(axis=0) + sim.diagonal(), np.ones(len(v)), length)
    return items["pos"].to_numpy(), model, np.hstack([v[:, :16], np.full((len(v), 1), 0.5)])


def k_sdpp(rows: DataFrame, epochs: int, k: int, length: int, threshold: float = 0.2) -> DataFrame:
    """(part, epoch, path, ord, pos): sampled sequences of items (part, pos, vec), every epoch a group with its own seed.

    The model of a part is built and decomposed once a part; its epochs share it. Parts are bounded by their split size.
    """

    def one(items: pd.DataFrame) -> pd.DataFrame:
        pos, model, features = part_model(items, length, threshold)
        values, vectors = decompose(model.second_moment(features))
        out = []
        part = int(items["part"].iloc[0])
        for epoch in range(epochs):
            rng = np.random.default_rng([part, epoch])
            for path, nodes in enumerate(sample_sequences(model, features, k, rng, values, vectors)):
                out += [(part, epoch, path, o, int(pos[x])) for o, x in enumerate(nodes)]
        return pd.DataFrame(out, columns=["part", "epoch", "path", "ord", "pos"])

    return rows.select("part", "pos", "vec").groupBy("part").applyInPandas(one, "part int, epoch int, path int, ord int, pos long")


def distinct_paths(sampled: DataFrame) -> DataFrame:
    """(part, nodes): sampled sequences once each, as arrays in sampled order."""
    nodes = F.transform(F.array_sort(F.collect_list(F.struct("ord", "pos"))), lambda x: x["pos"])
    return sampled.groupBy("part", "epoch", "path").agg(nodes.alias("nodes")).select("part", "nodes").dropDuplicates()
