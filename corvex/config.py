"""Settings with the defaults and checks of the query surface."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from math import log

from corvex.errors import InvalidConfig

METRICS = ("cosine", "euclidean", "dot", "manhattan")


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise InvalidConfig(what)


@dataclass(frozen=True)
class GraphConfig:
    """Flat graph without stored vectors; ``fast`` and ``accurate`` are variants."""

    m: int = 30
    m0: int = 60
    ef_construction: int = 128
    level_factor: float = 1 / log(30)
    max_layers: int = 16
    metric: str = "cosine"
    ef_search: int = 64
    beam_width: int = 1
    prune_ratio: float = 0.0
    pruning: str = "global"
    keep_hubs: bool = True
    hub_percentile: float = 0.02

    def __post_init__(self) -> None:
        _need(self.m > 0, "m must be positive")
        _need(self.m0 >= self.m, "m0 must be at least m")
        _need(self.ef_construction >= self.m, "ef_construction must be at least m")
        _need(0 <= self.prune_ratio <= 1, "prune_ratio must be in [0, 1]")
        _need(self.beam_width > 0, "beam_width must be positive")
        _need(0 <= self.hub_percentile <= 1, "hub_percentile must be in [0, 1]")
        _need(self.metric in METRICS, f"unknown metric {self.metric}")
        _need(self.pruning in ("global", "local", "proportional"), f"unknown pruning {self.pruning}")

    @classmethod
    def fast(cls) -> "GraphConfig":
        return cls(m=16, m0=32, ef_construction=100, ef_search=32, prune_ratio=0.3)

    @classmethod
    def accurate(cls) -> "GraphConfig":
        return cls(m=48, m0=96, ef_construction=400, ef_search=128)


@dataclass(frozen=True)
class HnswConfig:
    m: int = 16
    m0: int = 32
    ef_construction: int = 200
    level_factor: float = 1 / log(16)
    max_layers: int = 16
    metric: str = "cosine"

    def __post_init__(self) -> None:
        _need(self.m > 0, "m must be positive")
        _need(self.m0 >= self.m, "m0 must be at least m")
        _need(self.ef_construction >= self.m, "ef_construction must be at least m")
        _need(self.metric in METRICS, f"unknown metric {self.metric}")

    @classmethod
    def fast(cls) -> "HnswConfig":
        return cls(m=12, m0=24, ef_construction=100)

    @classmethod
    def accurate(cls) -> "HnswConfig":
        return cls(m=32, m0=64, ef_construction=400)


@dataclass(frozen=True)
class QuantizerConfig:
    subquantizers: int = 8
    centroids: int = 256
    iterations: int = 25
    seed: int | None = None

    def __post_init__(self) -> None:
        _need(self.subquantizers > 0, "subquantizers must be positive")
        _need(1 <= self.centroids <= 65536, "centroids must be in [1, 65536]")

    def width(self, dim: int) -> int:
        _need(dim % self.subquantizers == 0, f"dimension {dim} isn't a multiple of {self.subquantizers}")
        return dim // self.subquantizers

    @property
    def bytes_per_vector(self) -> int:
        return self.subquantizers * (1 if self.centroids <= 256 else 2)

    def compression(self, dim: int) -> float:
        return dim * 4 / self.bytes_per_vector


@dataclass(frozen=True)
class SearchConfig:
    top_k: int = 10
    ef: int = 100
    include_vectors: bool = False
    include_metadata: bool = True
    min_similarity: float | None = None

    @classmethod
    def fast(cls, k: int) -> "SearchConfig":
        return cls(top_k=k, ef=2 * k)

    @classmethod
    def accurate(cls, k: int) -> "SearchConfig":
        return cls(top_k=k, ef=10 * k)

    def with_(self, **changes) -> "SearchConfig":
        return replace(self, **changes)


#: Extensions indexed by default.
EXTENSIONS = ("rs", "py", "js", "ts", "jsx", "tsx", "java", "go", "c", "cpp", "h", "hpp", "cs", "rb", "php", "swift", "kt", "scala", "sql", "sh", "bash", "yaml", "yml", "json", "toml", "md", "rst", "txt")


@dataclass(frozen=True)
class IndexerConfig:
    repos_path: str = "repos"
    indexes_path: str = "indexes"
    max_concurrent_syncs: int = 4
    sync_interval_secs: int = 300
    extensions: tuple[str, ...] = field(default=EXTENSIONS)


#: Dimensions of the embedding presets.
PRESETS = {"bge-small": 384, "bge-base": 768, "bge-large": 1024, "minilm": 384, "jina-small": 512, "jina-base": 768}


@dataclass(frozen=True)
class EmbedderConfig:
    preset: str = "bge-small"
    batch_size: int = 32

    def __post_init__(self) -> None:
        _need(self.preset in PRESETS, f"unknown preset {self.preset}")

    @property
    def dimension(self) -> int:
        return PRESETS[self.preset]


def probe(embedder, text: str = "test") -> int:
    """The dimension of an embedder's vectors, from one text; none is an error."""
    found = embedder([text])
    _need(len(found) == 1 and len(found[0]) > 0, "the embedder gave no vector")
    return len(found[0])


def _value(kind: str, text: str):
    """A setting's text as its type."""
    if kind == "bool":
        return text == "1" or text.lower() == "true"
    if kind == "int":
        return int(text)
    return tuple(x.strip() for x in text.split(",") if x.strip()) if kind.startswith("tuple") else text


def from_environment(base: IndexerConfig | None = None, prefix: str = "CORVEX_", environment: Mapping[str, str] | None = None) -> IndexerConfig:
    """The settings with those in place that the environment names: ``CORVEX_REPOS_PATH`` and so on; paths may also be
    named ``CORVEX_STORAGE__REPOS_PATH``."""
    environment, changes = os.environ if environment is None else environment, {}
    for f in fields(IndexerConfig):
        for name in (f"{prefix}STORAGE__{f.name.upper()}", f"{prefix}{f.name.upper()}"):
            if name in environment:
                changes[f.name] = _value(str(f.type), environment[name])
    return replace(base or IndexerConfig(), **changes)


def from_file(path: str) -> IndexerConfig:
    """Settings from a JSON file, or a YAML file of plain ``key: value`` lines and lists; unknown names are an error."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        given = _plain_yaml(text) if path.endswith((".yaml", ".yml")) else json.loads(text)
    except ValueError as e:
        raise InvalidConfig(f"{path}: {e}") from e
    given = {**given.pop("indexer", {}), **given} if isinstance(given, dict) else {}
    known = {f.name: str(f.type) for f in fields(IndexerConfig)}
    _need(set(given) <= set(known), f"unknown settings {sorted(set(given) - set(known))}")
    return IndexerConfig(**{k: tuple(v) if isinstance(v, list) else v if not isinstance(v, str) else _value(known[k], v) for k, v in given.items()})


def _plain_yaml(text: str) -> dict:
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except ImportError:
        out: dict = {}
        key = None
        for line in text.splitlines():
            body = line.split(" #")[0].strip()
            if not body or body.startswith("#"):
                continue
            if body.startswith("- ") and key:
                out[key] = [*(out[key] or []), body[2:].strip(" \"'")]
            elif ":" in body:
                key, _, value = (x.strip(" \"'") for x in body.partition(":"))
                out[key] = value or None
        return {k: v for k, v in out.items() if v is not None}
