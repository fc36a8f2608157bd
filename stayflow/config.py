"""Settings of a run. Values are the effective defaults; a file (JSON, or YAML where a parser is installed) overrides them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path

from stayflow.functions import constants as C


@dataclass
class DataConfig:
    tables: str = "data"
    prefix: str = ""
    ecg_csv: str | None = None
    output: str = "output"


@dataclass
class ExtractionConfig:
    thresholds: dict[str, tuple[int, int]] = field(default_factory=lambda: dict(C.THRESHOLDS))
    n_patients: int | None = None
    label_categories: tuple[str, ...] = ("source_only", "partial")
    keep_unknown_action: bool = False


@dataclass
class SplitConfig:
    val_fraction: float = 0.1
    seed: int = 42


@dataclass
class BinConfig:
    mode: str = "hybrid"
    n_bins: int = 10


@dataclass
class EcgConfig:
    route: str = "all_branches"
    lookback_days: int = 7
    n_similarity_bins: int = 10


@dataclass
class TimeConfig:
    clock_hours: int = C.CLOCK_HOURS
    gap_edges: list[int] = field(default_factory=lambda: list(C.GAP_EDGES))


@dataclass
class TokenConfig:
    fuse: bool = False
    min_count: int = 1


@dataclass
class TrainingConfig:
    max_len: int = 32768
    overlap: int = 256
    token_budget: int = 32768
    label_weight: float = 75.0
    seed: int = 42


@dataclass
class EvaluationConfig:
    horizons: tuple[int, ...] = (8, 24, 48)
    max_days: int = 7
    max_context: int = 8192
    n_samples: int = 8
    max_new_tokens: int = 500
    temperature: float = 1.0
    top_k: int = 50
    top_p: float = 0.95
    n_bootstrap: int = 1000
    confidence: float = 0.95


@dataclass
class Config:
    data: DataConfig = field(default_factory=DataConfig)
    extraction: ExtractionConfig = field(default_factory=ExtractionConfig)
    split: SplitConfig = field(default_factory=SplitConfig)
    bins: BinConfig = field(default_factory=BinConfig)
    ecg: EcgConfig = field(default_factory=EcgConfig)
    time: TimeConfig = field(default_factory=TimeConfig)
    tokens: TokenConfig = field(default_factory=TokenConfig)
    training: TrainingConfig = field(default_factory=TrainingConfig)
    evaluation: EvaluationConfig = field(default_factory=EvaluationConfig)

    @classmethod
    def load(cls, path: str | None = None) -> Config:
        """Defaults, then what the file has; an unknown section or setting is an error."""
        config = cls()
        for section, values in (_parse(Path(path)) if path else {}).items():
            part = getattr(config, section, None)
            if not is_dataclass(part):
                raise ValueError(f"no section {section}")
            for name, value in (values or {}).items():
                if name not in {f.name for f in fields(part)}:
                    raise ValueError(f"no setting {section}.{name}")
                setattr(part, name, tuple(value) if isinstance(getattr(part, name), tuple) else value)
        return config

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))


def _parse(path: Path) -> dict:
    text = path.read_text()
    if path.suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("no YAML parser is installed; give the settings as JSON") from e
        return yaml.safe_load(text) or {}
    return json.loads(text)
