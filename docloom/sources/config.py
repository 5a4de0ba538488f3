"""Options of the retrieval pipeline: given values before the environment before defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    data_dir: str = "data"
    embedding: str = "hashed"
    chunk_size: int = 800
    chunk_overlap: int = 100
    bm25_top_k: int = 20
    dense_top_k: int = 20
    final_top_k: int = 5
    rrf_k: int = 60
    max_retry_depth: int = 2
    confidence_threshold: float = 0.3


def load(environ: dict[str, str] | None = None, prefix: str = "DOCLOOM_", **given) -> Config:
    """A given None counts as not given; values of the environment are read as the default's type."""
    environ = dict(os.environ) if environ is None else environ
    values = {f.name: type(f.default)(environ[prefix + f.name.upper()]) for f in fields(Config) if prefix + f.name.upper() in environ}
    return Config(**values | {k: v for k, v in given.items() if v is not None})
