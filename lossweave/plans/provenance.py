"""Manifests, resuming and reuse of finished outputs."""

from __future__ import annotations

import json
from typing import Any

from lossweave.sources.files import Files

#: Settings that may differ between a run and the one it resumes, and those that hold paths.
TOLERATED = ("attn_implementation",)
PATHS = ("input", "model_dir")


def sibling(output: str, what: str) -> str:
    """Path beside an output: its errors, manifest or parts."""
    folder, slash, name = output.rpartition("/")
    stem, dot, suffix = name.rpartition(".")
    stem, suffix = (stem, f".{suffix}") if dot and stem else (name, "")
    return {"errors": f"{folder}{slash}{stem}.errors{suffix}", "manifest": f"{folder}{slash}{stem}.manifest.json", "parts": f"{output}.parts"}[what]


def manifest(scoring, files: Files, total: int) -> dict[str, Any]:
    """What fixes the meaning of a score file."""
    source = files.fingerprint(scoring.input)
    end = total if scoring.limit is None else min(total, scoring.start_index + scoring.limit)
    out = {
        "input": source["path"], "input_size": source["size"], "input_mtime_ns": source["mtime_ns"], "model_dir": scoring.model_dir, "template": scoring.template,
        "messages_field": scoring.messages_field, "prompt_field": scoring.prompt_field, "response_field": scoring.response_field, "system_field": scoring.system_field, "id_field": scoring.id_field,
        "scorer_kind": scoring.scorer_kind, "score_method": scoring.score_method, "score_transform": scoring.score_transform,
        "dtype": scoring.dtype, "device": scoring.device, "attn_implementation": scoring.attn_implementation, "trust_remote_code": scoring.trust_remote_code,
        "max_model_len": scoring.max_model_len, "truncate_to_length": scoring.truncate_to_length, "start_index": scoring.start_index, "end_index": max(end, scoring.start_index), "total_records": total,
    }
    if scoring.template == "gemma4":
        out["response_format_contract"] = "native_thought_block"
    return out


def same_place(a: Any, b: Any, marker: str | None) -> bool:
    """Whether two paths are one file under different mount points: equal from the marker folder on."""
    if a == b:
        return True
    if marker and isinstance(a, str) and isinstance(b, str) and f"/{marker}/" in a and f"/{marker}/" in b:
        return a.rpartition(f"/{marker}/")[2] == b.rpartition(f"/{marker}/")[2]
    return False


def differences(old: dict[str, Any], new: dict[str, Any], marker: str | None = None) -> dict[str, tuple[Any, Any]]:
    """Settings of the new run that the old one does not share; paths count as equal beneath the marker folder."""
    return {k: (old.get(k), v) for k, v in new.items() if old.get(k) != v and not (k in PATHS and same_place(old.get(k), v, marker))}


def check_resume(old: dict[str, Any], new: dict[str, Any], marker: str | None = None) -> None:
    """Fail if a run with other settings than ``old`` would add to its parts or output."""
    bad = {k: v for k, v in differences(old, new, marker).items() if k not in TOLERATED}
    if bad:
        raise ValueError(f"cannot resume: {', '.join(f'{k}: {a!r} -> {b!r}' for k, (a, b) in bad.items())}")


def reusable(files: Files, output: str, sources: dict[str, str], overwrite: bool) -> bool:
    """Whether a finished output of the same sources exists; one of others needs ``overwrite``."""
    if overwrite or not files.exists(output):
        return False
    path = sibling(output, "manifest")
    old = json.loads(files.read(path)) if files.exists(path) else {}
    if all(old.get(k) == files.fingerprint(v) for k, v in sources.items()):
        return True
    raise FileExistsError(f"{output} exists with other sources; pass overwrite")
