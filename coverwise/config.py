"""QA configuration, search space and configuration tables."""
from __future__ import annotations

import hashlib
import itertools
from dataclasses import asdict, dataclass, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class QaConfig:
    """One point of the search space (defaults equal the reference's)."""
    top_k: int = 3
    relevance_threshold: float = 0.10
    max_rewrites: int = 1
    max_regenerations: int = 1
    min_keyword_overlap: float = 0.04
    prompt_version: str = "v1"

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> "QaConfig":
        """Known keys only; anything else is ignored."""
        names = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in d.items() if k in names})


# The reference's search space (inclusive bounds).
SEARCH_SPACE: dict[str, tuple] = {
    "top_k": ("int", 1, 6),
    "relevance_threshold": ("float", 0.02, 0.30),
    "max_rewrites": ("int", 0, 3),
    "max_regenerations": ("int", 0, 2),
    "min_keyword_overlap": ("float", 0.0, 0.12),
    "prompt_version": ("categorical", ["v1", "v2"]),
}

CONFIG_SCHEMA = T.StructType([
    T.StructField("config_id", T.IntegerType(), False),
    T.StructField("top_k", T.IntegerType(), False),
    T.StructField("relevance_threshold", T.DoubleType(), False),
    T.StructField("max_rewrites", T.IntegerType(), False),
    T.StructField("max_regenerations", T.IntegerType(), False),
    T.StructField("min_keyword_overlap", T.DoubleType(), False),
    T.StructField("prompt_version", T.StringType(), False),
])

# The fixed grid compared against the oracle (FIXTURES section 3): 54 rows.
GRID = {
    "top_k": [1, 3, 5],
    "relevance_threshold": [0.05, 0.10, 0.30],
    "max_rewrites": [0, 1],
    "min_keyword_overlap": [0.0, 0.04, 0.12],
}


def grid_configs(grid: dict[str, list] | None = None) -> list[QaConfig]:
    """Cartesian product of the grid in key order; other fields keep defaults."""
    g = grid or GRID
    keys = list(g)
    return [QaConfig(**dict(zip(keys, combo))) for combo in itertools.product(*(g[k] for k in keys))]


def _unit(seed: int, trial: int, name: str) -> float:
    h = hashlib.sha256(f"{seed}:{trial}:{name}".encode()).digest()
    return int.from_bytes(h[:8], "big") / 2.0 ** 64


def sample_configs(n: int, seed: int = 42, space: dict[str, tuple] | None = None) -> list[QaConfig]:
    """``n`` seeded, independent samples of the search space (hash-based, repeatable).

    Trials are independent, so every one can be scored in the same job.
    """
    sp = space or SEARCH_SPACE
    out = []
    for t in range(n):
        params: dict[str, Any] = {}
        for name, spec in sp.items():
            u = _unit(seed, t, name)
            if spec[0] == "int":
                params[name] = spec[1] + min(int(u * (spec[2] - spec[1] + 1)), spec[2] - spec[1])
            elif spec[0] == "float":
                params[name] = spec[1] + u * (spec[2] - spec[1])
            elif spec[0] == "categorical":
                params[name] = spec[1][min(int(u * len(spec[1])), len(spec[1]) - 1)]
            else:
                raise ValueError(f"unknown kind {spec[0]!r}")
        out.append(QaConfig.from_dict(params))
    return out


def configs_frame(spark: SparkSession, configs: list[QaConfig]) -> DataFrame:
    """A configs table with ``config_id`` = trial number (0-based)."""
    rows = [(i, c.top_k, float(c.relevance_threshold), c.max_rewrites, c.max_regenerations,
             float(c.min_keyword_overlap), c.prompt_version) for i, c in enumerate(configs)]
    return spark.createDataFrame(rows, CONFIG_SCHEMA)
