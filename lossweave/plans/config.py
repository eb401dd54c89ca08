"""Settings of scoring and selection, checked on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields
from typing import Any


@dataclass(frozen=True)
class Selection:
    """Which response tokens keep their label."""

    enabled: bool = True
    normalization_exponent: float = 0.5
    ignore_rate: float | None = None
    ignore_zero_scores_only: bool = False
    train_zero_scores_only: bool = False
    train_nonpositive_scores_only: bool = False
    score_file: str | None = None
    score_files: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if not 0 <= float(self.normalization_exponent) <= 1 or not math.isfinite(self.normalization_exponent):
            raise ValueError("normalization_exponent must be in [0, 1]")
        modes = self.ignore_zero_scores_only + self.train_zero_scores_only + self.train_nonpositive_scores_only
        if modes > 1:
            raise ValueError("the zero and non-positive modes exclude each other")
        if modes and self.ignore_rate is not None:
            raise ValueError("ignore_rate excludes the zero and non-positive modes")
        if self.enabled and not modes and self.ignore_rate is None:
            raise ValueError("selection needs ignore_rate or one of the modes")
        if self.ignore_rate is not None and not 0 <= float(self.ignore_rate) <= 1:
            raise ValueError("ignore_rate must be in [0, 1]")
        if self.score_file and self.score_files:
            raise ValueError("score_file and score_files exclude each other")
        if self.enabled and not self.score_file and not self.score_files:
            raise ValueError("selection needs score_file or score_files")

    @property
    def mode(self) -> str:
        return "nonpositive" if self.ignore_zero_scores_only else "nonzero" if self.train_zero_scores_only else "positive" if self.train_nonpositive_scores_only else "fraction"

    def score_path(self, dataset: str, datasets: list[str]) -> str:
        """Score file of a dataset; one plain file serves only where there is one dataset."""
        if self.score_file:
            if len(datasets) != 1:
                raise ValueError("score_file serves exactly one dataset; use score_files")
            return self.score_file
        if dataset not in self.score_files:
            raise ValueError(f"no score file for dataset {dataset!r}")
        return self.score_files[dataset]


@dataclass(frozen=True)
class ScopedSelection(Selection):
    """Selection within reasoning blocks, or a random control over whole responses."""

    selection_scope: str = "think"
    random_mask_zero_count: bool = False
    random_mask_seed: int = 42

    def __post_init__(self):
        super().__post_init__()
        if self.selection_scope not in ("think", "response"):
            raise ValueError("selection_scope must be think or response")
        if not self.ignore_zero_scores_only:
            raise ValueError("scoped selection needs ignore_zero_scores_only")
        if self.random_mask_zero_count != (self.selection_scope == "response"):
            raise ValueError("the random control goes with scope response, and only it")
        if isinstance(self.random_mask_seed, bool) or self.random_mask_seed < 0:
            raise ValueError("random_mask_seed must be a non-negative integer")


@dataclass(frozen=True)
class Scoring:
    """Arguments of a scoring run."""

    input: str
    output: str
    template: str = "qwen3"
    messages_field: str = "messages"
    prompt_field: str | None = None
    response_field: str | None = None
    system_field: str = "system"
    id_field: str | None = None
    start_index: int = 0
    limit: int | None = None
    max_model_len: int = 32768
    truncate_to_length: int | None = None
    score_transform: str = "signed"
    method: str = "entropy"
    ablated_gate_value: float | None = None
    dtype: str = "bfloat16"
    overwrite: bool = False
    fail_fast: bool = False
    model_dir: str = ""
    device: str = "auto"
    attn_implementation: str = "auto"
    trust_remote_code: bool = False
    #: Folder name from which on input and model paths count, whatever is mounted before it.
    workspace: str | None = None
    #: Lines whose scores become durable together; tasks that score them (None: as many as the input has).
    chunk_rows: int = 1_000_000
    partitions: int | None = None
    #: Chunks after which progress is told; 0 tells none.
    progress_interval: int = 0
    #: One file instead of a folder of ordered parts; it passes through the driver.
    single_file: bool = False

    def __post_init__(self):
        if not self.output.endswith(".jsonl"):
            raise ValueError("output must end in .jsonl")
        if self.start_index < 0 or (self.limit is not None and self.limit < 0) or self.chunk_rows < 1:
            raise ValueError("start_index and limit must not be negative, chunk_rows must be positive")
        if self.max_model_len < 2:
            raise ValueError("max_model_len must be at least 2")
        if self.truncate_to_length is not None and not 1 < self.truncate_to_length < self.max_model_len:
            raise ValueError("truncate_to_length must be above 1 and below max_model_len")
        if self.method == "ablation" and (self.ablated_gate_value is None or not 0 <= self.ablated_gate_value < 1):
            raise ValueError("ablation needs ablated_gate_value in [0, 1)")
        if self.method == "entropy" and self.score_transform != "signed":
            raise ValueError("entropy scores have no transform")

    @property
    def score_method(self) -> str:
        """Name of the method that goes into manifests and score parts."""
        shape = "signed_raw" if self.score_transform == "signed" else "positive_clipped"
        if self.method == "gradient":
            return f"response_value_gate_gradient_{shape}_{'v3' if self.truncate_to_length else 'v2'}"
        if self.method == "ablation":
            gate = f"{self.ablated_gate_value:.8g}".replace(".", "p").replace("-", "m")
            return f"value_gate_{gate}_future_response_target_nll_delta_{self.dtype}_{shape}_v2"
        return "response_content_token_negative_log_likelihood_v1"

    @property
    def scorer_kind(self) -> str:
        return {"entropy": "token_nll", "gradient": "value_gradient", "ablation": "value_ablation"}[self.method]

    @property
    def score_semantics(self) -> str:
        """What a score says, for the manifest."""
        if self.method == "entropy":
            return "per_response_content_token_negative_log_likelihood"
        return f"{'signed' if self.score_transform == 'signed' else 'positive_clipped'}_first_order_response_target_nll_change"


#: Training arguments under which token selection has no defined result.
UNSUPPORTED = {"streaming": True, "packing": True, "neat_packing": True, "mask_history": True, "tokenized_path": ..., "eval_dataset": ...}


def guard(training: dict[str, Any]) -> None:
    """Reject training settings that token selection does not support."""
    if training.get("stage", "sft") != "sft":
        raise ValueError("token selection supports stage sft only")
    if training.get("ignore_pad_token_for_loss", True) is False:
        raise ValueError("token selection needs ignore_pad_token_for_loss")
    for name, value in UNSUPPORTED.items():
        if (value is ... and training.get(name)) or (value is not ... and training.get(name) == value):
            raise ValueError(f"token selection does not support {name}")


def selection_from(options: dict[str, Any], scoped: bool = False) -> Selection:
    """Selection from a mapping; unknown keys are errors."""
    kind = ScopedSelection if scoped else Selection
    unknown = set(options) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown selection settings: {sorted(unknown)}")
    return kind(**options)


def load(text: str, overrides: list[str] = (), scoped: bool = False) -> tuple[dict[str, Any], Selection]:
    """(training settings, selection) from YAML text and ``key=value`` overrides (dots reach into mappings)."""
    import yaml

    config = yaml.safe_load(text) or {}
    for item in overrides:
        key, sep, value = item.partition("=")
        if not sep:
            raise ValueError(f"override {item!r} is not key=value")
        at, *_ = [config]
        *parents, last = key.split(".")
        for p in parents:
            at = at.setdefault(p, {})
        at[last] = yaml.safe_load(value)
    options = config.pop("selective_training", None)
    if not isinstance(options, dict):
        raise ValueError("the configuration has no selective_training mapping")
    return config, selection_from(options, scoped)
