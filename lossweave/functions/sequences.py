"""Token sequences: encoded turns, truncation, positions and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lossweave.functions import templates as T
from lossweave.functions.ranking import bound
from lossweave.functions.tokenizers import Encode

IGNORE = -100
TURN = "struct<source:array<int>,target:array<int>,content:int>"
PLACE = "struct<turn:int,source:int,target:int,content:int,start:int,offset:int,cut_offset:int>"


def fitted_lengths(source: Column, target: Column, cutoff: Column) -> tuple[Column, Column]:
    """Lengths to keep of a prompt and a response under a budget: short sides are kept whole, else both shrink alike."""
    share = F.floor(cutoff.cast("double") * (target.cast("double") / (source + target).cast("double"))).cast("int")
    most = F.when(target * 2 < cutoff, cutoff).when(source * 2 < cutoff, cutoff - source).otherwise(share)
    kept = F.least(most, target)
    return F.least(F.greatest(cutoff - kept, F.lit(0)), source), kept


def encoded_turns(turns: Column, system: Column, template: str, encode: Encode, bos: int | None = None) -> Column:
    """Array of (source ids, target ids, content length) from an array of (user, assistant)."""
    t = T.TEMPLATES[template]
    n_end = F.size(encode(F.lit(t.end)))
    prefix = F.array(F.lit(bos).cast("int")) if t.bos and bos is not None else F.array().cast("array<int>")
    head = F.concat(prefix, encode(T.system_block(template, system)))

    def one(x, i):
        first = i == 0
        source = encode(T.prompt_text(template, x["user"], system, first))
        target = encode(F.concat(T.response_text(template, x["assistant"]), F.lit(t.end)))
        return F.struct(F.when(first, F.concat(head, source)).otherwise(source).alias("source"), target.alias("target"), (F.size(target) - n_end).alias("content"))

    return F.transform(turns, one)


def end_isolated(encoded: Column, template: str, encode: Encode) -> Column:
    """Whether every target ends with the ids of the template's end marker."""
    end = encode(F.lit(T.TEMPLATES[template].end))
    n = F.size(end)
    return F.forall(encoded, lambda x: (n > 0) & (F.size(x["target"]) >= n) & (F.slice(x["target"], F.greatest(F.lit(1), F.size(x["target"]) - n + 1), n) == end))


def layout(encoded: Column, cutoff: Column | None = None, reserved: int = 0) -> Column:
    """Where each kept turn lies: kept lengths, its target's first position, its first score with and without truncation.

    Turns stop once ``cutoff`` is used up; ``reserved`` tokens of it are held back.
    """
    lengths = F.transform(encoded, lambda x: F.struct(F.size(x["source"]).alias("s"), F.size(x["target"]).alias("t"), x["content"].alias("c")))
    zero = F.struct(F.lit(reserved).alias("used"), F.lit(0).alias("turn"), F.lit(0).alias("offset"), F.lit(0).alias("cut"), F.array().cast(f"array<{PLACE}>").alias("out"))

    def step(a, x):
        if cutoff is None:
            s, t, fits = x["s"], x["t"], F.lit(True)
        else:
            s, t = fitted_lengths(x["s"], x["t"], cutoff - a["used"])
            fits = a["used"] < cutoff
        kept = F.least(x["c"], t)
        place = F.struct(a["turn"].alias("turn"), s.alias("source"), t.alias("target"), kept.alias("content"), (a["used"] - reserved + s).alias("start"), a["offset"].alias("offset"), a["cut"].alias("cut_offset"))
        more = F.struct((a["used"] + s + t).alias("used"), (a["turn"] + 1).alias("turn"), (a["offset"] + x["c"]).alias("offset"), (a["cut"] + kept).alias("cut"), F.concat(a["out"], F.array(place)).alias("out"))
        return F.when(fits, more).otherwise(F.struct(a["used"].alias("used"), (a["turn"] + 1).alias("turn"), (a["offset"] + x["c"]).alias("offset"), a["cut"].alias("cut"), a["out"].alias("out")))

    return F.aggregate(lengths, zero, step, lambda a: a["out"])


def token_ids(encoded: Column, places: Column) -> Column:
    return bound(lambda e: F.flatten(F.transform(places, lambda p: F.concat(F.slice(F.get(e, p["turn"])["source"], F.lit(1), p["source"]), F.slice(F.get(e, p["turn"])["target"], F.lit(1), p["target"])))), encoded)


def _span(start: Column, n: Column) -> Column:
    return F.when(n > 0, F.sequence(start, start + n - 1)).otherwise(F.array().cast("array<int>"))


def response_positions(places: Column) -> Column:
    """Positions of response content."""
    return F.flatten(F.transform(places, lambda p: _span(p["start"], p["content"])))


def target_positions(places: Column) -> Column:
    """Positions of response content and end markers."""
    return F.flatten(F.transform(places, lambda p: _span(p["start"], p["target"])))


def totals(encoded: Column, places: Column, reserved: int = 0) -> dict[str, Column]:
    """Sequence and response counts, whole and truncated."""
    add = lambda array, f: F.aggregate(F.transform(array, f), F.lit(0), lambda a, x: a + x)
    return {
        "full_sequence": add(encoded, lambda x: F.size(x["source"]) + F.size(x["target"])) + reserved,
        "full_response": add(encoded, lambda x: x["content"]),
        "cut_sequence": add(places, lambda p: p["source"] + p["target"]) + reserved,
        "cut_response": add(places, lambda p: p["content"]),
    }


def retained(encoded: Column, places: Column, full: Column) -> Column:
    """Mask over the scores: which of them address a token that is still there."""
    part = lambda x, left: F.concat(F.array_repeat(F.lit(True), left), F.array_repeat(F.lit(False), x["content"] - left))
    whole = bound(lambda q: F.flatten(F.transform(encoded, lambda x, t: part(x, F.coalesce(F.get(q, t)["content"], F.lit(0))))), places)
    cut = F.flatten(F.transform(places, lambda p: F.array_repeat(F.lit(True), p["content"])))
    return F.when(full, whole).otherwise(cut)


def scoped(encoded: Column, places: Column, full: Column, flags: Column) -> Column:
    """Per-turn masks over content laid out over the scores."""
    whole = F.flatten(flags)
    cut = bound(lambda f: F.flatten(F.transform(places, lambda p: F.slice(F.get(f, p["turn"]), F.lit(1), p["content"]))), flags)
    return F.when(full, whole).otherwise(cut)


def labels(encoded: Column, places: Column, ignored: Column, full: Column, train_on_prompt: bool = False) -> Column:
    """Labels of the kept tokens: prompts and ignored content as -100."""

    def all_turns(e, mask, whole):
        def turn(p):
            source = F.slice(F.get(e, p["turn"])["source"], F.lit(1), p["source"])
            target = F.slice(F.get(e, p["turn"])["target"], F.lit(1), p["target"])
            flags = F.slice(mask, F.when(whole, p["offset"]).otherwise(p["cut_offset"]) + 1, p["content"])  # shorter than the target: its end is never ignored
            shown = F.zip_with(target, flags, lambda x, m: F.when(m, F.lit(IGNORE)).otherwise(x))
            return F.concat(source if train_on_prompt else F.array_repeat(F.lit(IGNORE), p["source"]), shown)

        return F.flatten(F.transform(places, turn))

    return bound(all_turns, encoded, ignored, full)
