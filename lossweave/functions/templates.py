"""Chat templates as concatenations of columns."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, functions as F

DEFAULT_SYSTEM = "You are a helpful assistant."


@dataclass(frozen=True)
class Template:
    """Texts around system, user and response; bos: whether a begin token precedes all."""

    user: tuple[str, str]
    end: str
    system: tuple[str, str] | None
    bos: bool = False
    default_system: str | None = None
    inject_think: bool = False
    native_thought: bool = False


# The markers of each template.
_IM = {"user": ("<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n"), "end": "<|im_end|>\n", "system": ("<|im_start|>system\n", "<|im_end|>\n")}
TEMPLATES = {
    "llama3": Template(("<|start_header_id|>user<|end_header_id|>\n\n", "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"), "<|eot_id|>", ("<|start_header_id|>system<|end_header_id|>\n\n", "<|eot_id|>"), bos=True),
    "gemma3": Template(("<start_of_turn>user\n", "<end_of_turn>\n<start_of_turn>model\n"), "<end_of_turn>\n", None, bos=True),
    "gemma4": Template(("<|turn>user\n", "<turn|>\n<|turn>model\n"), "<turn|>\n", ("<|turn>system\n<|think|>", "<turn|>\n"), bos=True, default_system=DEFAULT_SYSTEM, native_thought=True),
    "mimo": Template(**_IM, default_system=DEFAULT_SYSTEM, inject_think=True),
    "qwen3": Template(**_IM, inject_think=True),
    "qwen3_nothink": Template(**_IM),
}
THINK_OPEN, THINK_CLOSE = "<think>", "</think>"
THOUGHT_OPEN, THOUGHT_CLOSE = "<|channel>thought\n", "<channel|>"


def system_text(name: str, system: Column) -> Column:
    """The system text that a template uses; null where it uses none."""
    given = F.when(system != "", system)
    default = TEMPLATES[name].default_system
    return F.coalesce(given, F.lit(default)) if default else given


def system_block(name: str, system: Column) -> Column:
    """Text before the first turn; empty where a template has none."""
    t = TEMPLATES[name]
    if t.system is None:
        return F.lit("")
    return F.coalesce(F.concat(F.lit(t.system[0]), system_text(name, system), F.lit(t.system[1])), F.lit(""))


def prompt_text(name: str, user: Column, system: Column, first: Column) -> Column:
    t = TEMPLATES[name]
    if t.system is None:  # no system role: it opens the first user turn
        user = F.when(first & system_text(name, system).isNotNull(), F.concat(system, F.lit("\n\n"), user)).otherwise(user)
    return F.concat(F.lit(t.user[0]), user, F.lit(t.user[1]))


def response_text(name: str, response: Column) -> Column:
    if not TEMPLATES[name].inject_think:
        return response
    bare = ~F.contains(response, F.lit(THINK_OPEN)) & ~F.contains(response, F.lit(THINK_CLOSE))
    return F.when(bare, F.concat(F.lit(f"{THINK_OPEN}\n\n{THINK_CLOSE}\n\n"), response)).otherwise(response)


def _occurrences(text: Column, mark: str) -> Column:
    return F.size(F.split(text, re.escape(mark).replace("\\\n", "\\n"))) - 1


def native_thought_ok(response: Column) -> Column:
    """Whether a response holds exactly one native thought block, at its start, and no other think tags."""
    foreign = F.contains(response, F.lit(THINK_OPEN)) | F.contains(response, F.lit(THINK_CLOSE))
    return ~foreign & F.startswith(response, F.lit(THOUGHT_OPEN)) & (_occurrences(response, THOUGHT_OPEN) == 1) & (_occurrences(response, THOUGHT_CLOSE) == 1)


#: Words in a model's or an input's path that tell a reasoning run.
REASONING = ("openr1", "openmath", "reason")


def resolve(model_dir: str, requested: str = "auto", input_path: str = "", configs: str | None = None) -> str:
    """Template of a model folder.

    As requested; else as the folder's training note says; else as the training
    settings of that name beneath ``configs`` say (of the parent's name for a
    checkpoint); else by its model type, where a qwen model is taken to reason
    only if its path or the input's says so.
    """
    if requested != "auto":
        if requested not in TEMPLATES:
            raise ValueError(f"unknown template {requested!r}")
        return requested
    at = Path(model_dir)
    note = at / "training_template.json"
    if note.is_file() and (name := json.loads(note.read_text()).get("training_template")) in TEMPLATES:
        return name
    names = [at.name, at.parent.name] if at.name.startswith("checkpoint-") else [at.name]
    for file in (Path(configs) / group / f"{n}.{suffix}" for n in names for suffix in ("yaml", "yml") for group in ("baseline", "selective")) if configs else ():
        if file.is_file():
            import yaml

            name = (yaml.safe_load(file.read_text()) or {}).get("template")
            if name in TEMPLATES:
                return name
    kind = str(json.loads((at / "config.json").read_text()).get("model_type", "")).lower() if (at / "config.json").is_file() else ""
    if "qwen" in kind:
        where = f"{model_dir} {input_path}".lower()
        return "qwen3" if any(w in where for w in REASONING) else "qwen3_nothink"
    for known, name in ((kind == "gemma3", "gemma3"), ("gemma4" in kind, "gemma4"), (kind == "mimo", "mimo"), ("llama" in kind, "llama3")):
        if known:
            return name
    raise ValueError(f"cannot tell the template of {model_dir!r}; name one of {sorted(TEMPLATES)}")


# Fixed value: the chat template of runs without reasoning, so that generation starts as training did.
NOTHINK_CHAT = """{%- for message in messages %}
    {%- if message.role in ['system', 'user', 'assistant'] %}
        {{- '<|im_start|>' + message.role + '\\n' + message.content + '<|im_end|>\\n' }}
    {%- endif %}
{%- endfor %}
{%- if add_generation_prompt %}
    {{- '<|im_start|>assistant\\n' }}
{%- endif %}
"""
