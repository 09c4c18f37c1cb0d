"""Settings: defaults, then a YAML file, then the environment, then the command line."""

from __future__ import annotations

import logging
import os
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

import yaml

from dialoom.functions.constants import KNOWN_PREFIXES

_log = logging.getLogger("dialoom")

# Which variable sets which setting.
ENVIRONMENT = {
    "PDF_FILENAME": "pdf_filename", "OUTPUT_FILENAME": "output_filename", "OUTPUT_DIR": "output_dir", "OLLAMA_MODEL": "model_name", "OLLAMA_HOST": "ollama_host",
    "MODEL_TEMPERATURE": "temperature", "MAX_BLOCK_SIZE": "max_block_size", "MIN_BLOCK_SIZE": "min_block_size", "EXTRACT_RATIO": "extract_ratio",
    "USE_INTELLIGENT_SEGMENTATION": "use_intelligent_segmentation", "ENABLE_QA_FILTER": "enable_qa_filter", "LOG_LEVEL": "log_level",
}
TRUE_WORDS = ("true", "1", "yes", "on")


@dataclass(frozen=True)
class Config:
    """All settings of a run. `use_intelligent_segmentation` is kept for old files; no operator reads it."""

    # Names and defaults of the settings.
    pdf_filename: str = "uploaded.pdf"
    output_filename: str = "output_final_qa.jsonl"
    output_dir: str = "output"
    model_name: str = "qwen2.5:7b-instruct"
    ollama_host: str = "http://localhost:11434"
    temperature: float = 0.1
    max_block_size: int = 1500
    min_block_size: int = 100
    extract_ratio: float = 1.0
    use_intelligent_segmentation: bool = True
    enable_qa_filter: bool = False
    known_prefixes: list[str] = field(default_factory=lambda: list(KNOWN_PREFIXES))
    log_level: str = "INFO"
    enable_success_log: bool = True
    enable_error_log: bool = True

    def __post_init__(self):
        if self.known_prefixes is None:
            object.__setattr__(self, "known_prefixes", list(KNOWN_PREFIXES))

    @property
    def output_path(self) -> str:
        """The output file's name if that is absolute or a URL, else below the output folder."""
        name = self.output_filename
        return name if os.path.isabs(name) or "://" in name else os.path.join(self.output_dir, name)


KINDS = {f.name: f.type for f in fields(Config)}


def default_path() -> str:
    return str(Path(__file__).resolve().parents[2] / "config" / "config.yaml")


def from_yaml(base: Config, path: str | None) -> Config:
    """Known keys of the file over `base`; a missing, empty or malformed file changes nothing, with a warning for the last."""
    if not path or not os.path.exists(path):
        return base
    try:
        read = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except yaml.YAMLError as e:
        _log.warning("%s is not YAML, defaults are used: %s", path, e)
        return base
    return replace(base, **{k: v for k, v in read.items() if k in KINDS}) if isinstance(read, dict) else base


def from_environment(base: Config, env=os.environ) -> Config:
    """Variables over `base`; one that is set but empty counts, too."""
    kinds = {"float": float, "int": int, "bool": lambda x: x.lower() in TRUE_WORDS}
    return replace(base, **{name: kinds.get(KINDS[name], str)(env[var]) for var, name in ENVIRONMENT.items() if var in env})


def load_config(path: str | None = None, env=os.environ) -> Config:
    return from_environment(from_yaml(Config(), path), env)


def save_config(config: Config, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.safe_dump(asdict(config), allow_unicode=True, sort_keys=False), encoding="utf-8")
