"""Hyper-parameters and paths as frozen records with overrides."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class HyperParams:
    """Weights of time decay and entities, and the threshold of an edge (fixed default values)."""

    alpha: float = 10.0
    gamma: float = 0.1
    max_common_ent: int = 5
    max_ent_between: int = 5
    weight_threshold: float = 0.7

    def with_overrides(self, **values) -> HyperParams:
        """Known keys replace, unknown ones are an error, None keeps the default."""
        return replace(self, **{k: v for k, v in values.items() if v is not None})

    @classmethod
    def from_json(cls, text: str) -> HyperParams:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in json.loads(text).items() if k in known})

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


@dataclass(frozen=True)
class Paths:
    """Where tables of a collection stand, all below one root."""

    root: str

    def of(self, table: str, **options) -> str:
        """A table's folder; options (sorted by name) tell variants of it apart."""
        variant = "-".join(f"{k}_{v}" for k, v in sorted(options.items()) if v is not None)
        return "/".join(filter(None, (self.root.rstrip("/"), table, variant)))


def thread_pattern(emb: str, time_decay: bool = False, ent_similarity: bool = False, community: str = "npc") -> str:
    """Name of a thread run: embedding, then what its edges take into account, then the grouping."""
    parts = [emb, "time" if time_decay else "", "ent" if ent_similarity else "", community]
    return "_".join(filter(None, parts))
