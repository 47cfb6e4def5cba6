"""Experiment settings as checked dataclasses, and the matrix of configs."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import product
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class RagConfig:
    chunking: str
    retrieval: str
    rerank: str
    params: tuple[tuple[str, Any], ...] = field(default=(), compare=False)

    @property
    def config_id(self) -> str:
        return f"{self.chunking}__{self.retrieval}__{self.rerank}"


@dataclass(frozen=True)
class Factor:
    name: str
    params: dict = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    path: str | None = None
    split: str = "test"
    n_queries: int | None = None
    max_corpus: int | None = None


@dataclass
class Experiment:
    chunking: list[Factor]
    retrieval: list[Factor]
    rerank: list[Factor]
    datasets: list[DatasetSpec] = field(default_factory=list)
    seed: int = 42
    k_values: tuple[int, ...] = (1, 3, 5, 10)
    top_k_context: int = 5
    depth: int = 100
    bootstrap_iters: int = 10_000
    alpha: float = 0.05

    def matrix(self, expect: int | None = None) -> list[RagConfig]:
        """All combinations of the factors; ``expect`` checks their number."""
        out = [RagConfig(c.name, r.name, x.name, tuple(sorted({"chunking": str(c.params), "retrieval": str(r.params), "rerank": str(x.params)}.items()))) for c, r, x in product(self.chunking, self.retrieval, self.rerank)]
        if expect is not None and len(out) != expect:
            raise ValueError(f"the matrix has {len(out)} configs, not {expect}")
        if len({c.config_id for c in out}) != len(out):
            raise ValueError("config ids repeat")
        return out


def parse_settings(raw: dict) -> Experiment:
    """Settings from a nested mapping; an unknown or missing section raises with its name."""
    for key in ("chunking", "retrieval", "rerank"):
        if not raw.get(key):
            raise ValueError(f"settings lack the section {key}")
    factors = {k: [Factor(x["name"], dict(x.get("params") or {})) for x in raw[k]] for k in ("chunking", "retrieval", "rerank")}
    data = [DatasetSpec(x["name"], x.get("path"), x.get("split", "test"), x.get("n_queries"), x.get("max_corpus")) for x in raw.get("datasets", [])]
    ir = (raw.get("evaluation") or {}).get("ir") or {}
    stats = raw.get("stats") or {}
    return Experiment(**factors, datasets=data, seed=raw.get("seed", 42), k_values=tuple(ir.get("k_values", (1, 3, 5, 10))), top_k_context=(raw.get("generation") or {}).get("top_k_context", 5), bootstrap_iters=stats.get("bootstrap_iters", 10_000), alpha=stats.get("alpha", 0.05))


def load_settings(path: str | Path) -> Experiment:
    """Settings from a JSON file, or YAML where a parser is installed."""
    text = Path(path).read_text()
    if str(path).endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("no YAML parser is installed; give the settings as JSON") from e
        return parse_settings(yaml.safe_load(text))
    return parse_settings(json.loads(text))


def default_experiment() -> Experiment:
    return Experiment([Factor("fixed", {"size": 256}), Factor("semantic", {"max_tokens": 384, "similarity_threshold": 0.55})], [Factor("bm25"), Factor("dense"), Factor("hybrid")], [Factor("none"), Factor("cross_encoder", {"depth": 50})], [DatasetSpec("msmarco"), DatasetSpec("nq")])


def configs_frame(spark: SparkSession, exp: Experiment) -> DataFrame:
    rows = [(c.config_id, c.chunking, c.retrieval, c.rerank) for c in exp.matrix()]
    return spark.createDataFrame(rows, "config_id string, chunking string, retrieval string, rerank string")
