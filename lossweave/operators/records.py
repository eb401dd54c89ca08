"""From raw records to conversations and encoded samples; bad records are classified, not fatal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lossweave.functions import sequences as S
from lossweave.functions import templates as T
from lossweave.functions.tokenizers import Encode

MESSAGES = "array<struct<role:string,content:string>>"
PROMPT_FIELDS = ("prompt", "problem", "instruction")
RESPONSE_FIELDS = ("response", "generated_solution", "output")
# White space as str.strip() sees it.
BLANK = "(?U)^[\\s\\x1c-\\x1f]*$"


def _field(v: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$['{name}']", kind)


def _kind(v: Column, name: str) -> Column:
    """Type of a field; null where it is absent."""
    return F.schema_of_variant(F.variant_get(v, f"$['{name}']", "variant"))


def string_field(v: Column, requested: str | None, candidates: tuple[str, ...]) -> Column:
    """First candidate that is a string; a requested field has no fallback."""
    return F.coalesce(*[F.when(_kind(v, f) == "STRING", _field(v, f)) for f in ((requested,) if requested else candidates)])


def parse(lines: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``record`` (VARIANT) and ``bad``: why a line is no record.  Duplicate keys and NaN tokens count as malformed."""
    v = F.try_parse_json(value)
    kind = F.schema_of_variant(v)
    bad = F.when(F.trim(value) == "", "blank line").when(F.col(value).rlike(BLANK), "blank line").when(v.isNull(), "malformed JSON").when(~F.startswith(kind, F.lit("OBJECT")), "record is not an object")
    return lines.withColumns({"record": v, "bad": bad})


def messages_of(record: Column, field: str = "messages") -> dict[str, Column]:
    """Messages of a record as an array with raw kinds, and whether it has a non-empty list of them."""
    items = F.try_variant_get(record, f"$['{field}']", "array<variant>")
    typed = F.transform(items, lambda m: F.struct(
        F.startswith(F.schema_of_variant(m), F.lit("OBJECT")).alias("object"),
        F.when(_kind(m, "role") == "STRING", _field(m, "role")).alias("role"),
        F.when(_kind(m, "content") == "STRING", _field(m, "content")).alias("content")))
    return {"typed": typed, "has": F.coalesce(F.size(items) > 0, F.lit(False))}


def message_error(typed: Column) -> Column:
    """First message's error in message order; within a message: object, content, role."""
    def judge(m, i):
        before = F.slice(typed, F.lit(1), i)
        late = (m["role"] == "system") & F.exists(before, lambda b: F.coalesce(b["role"] != "system", F.lit(False)))
        return (F.when(~m["object"], "every message must be an object").when(m["content"].isNull(), "every message content must be a string")
                .when(F.coalesce(late, F.lit(False)), "system message after the first turn")
                .when(~F.coalesce(m["role"].isin("system", "user", "assistant"), F.lit(False)), "unsupported message role"))

    return F.get(F.filter(F.transform(typed, judge), lambda e: e.isNotNull()), F.lit(0))


def pairing_error(conversation: Column) -> Column:
    """Whole user/assistant pairs, strictly alternating."""
    n = F.size(conversation)
    order = F.forall(F.transform(conversation, lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda ok: ok)
    return F.when((n == 0) | (n % 2 != 0), "incomplete user/assistant pairs").when(~order, "roles do not alternate")


def turns_of(conversation: Column) -> Column:
    """(user, assistant) of each pair; null for a conversation without any."""
    n = F.floor(F.size(conversation) / 2).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.get(conversation, 2 * i)["content"].alias("user"), F.get(conversation, 2 * i + 1)["content"].alias("assistant")))


def conversations(records: DataFrame, messages: str = "messages", prompt: str | None = None, response: str | None = None, system: str = "system") -> DataFrame:
    """Adds turns, system and error (first failing rule) to rows with ``record`` and ``bad``."""
    r = F.col("record")
    m = messages_of(r, messages)
    out = records.withColumns({"_typed": m["typed"], "_has": m["has"], "_p": string_field(r, prompt, PROMPT_FIELDS), "_r": string_field(r, response, RESPONSE_FIELDS), "_s": _field(r, system), "_sk": _kind(r, system)})
    typed = F.col("_typed")
    spoken = F.transform(F.filter(typed, lambda x: F.coalesce(x["role"] != "system", F.lit(False))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col("_p").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("_r").alias("content")))
    out = out.withColumn("_conv", F.when(F.col("_has"), spoken).otherwise(pair))
    said = F.transform(F.filter(typed, lambda x: F.coalesce(x["role"] == "system", F.lit(False))), lambda x: x["content"])
    joined = F.when(F.col("_has") & (F.size(said) > 0), F.array_join(said, "\n\n")).otherwise(F.when(F.col("_sk") == "STRING", F.col("_s")))
    value_error = (
        F.when(F.col("_sk").isNotNull() & ~F.col("_sk").isin("STRING", "VOID"), "system must be a string")
        .when(F.col("_has"), F.coalesce(message_error(typed), pairing_error(F.col("_conv"))))
        .when(F.col("_p").isNull(), "no prompt field").when(F.col("_r").isNull(), "no response field"))
    empty = F.exists("_conv", lambda x: (x["role"] == "assistant") & x["content"].rlike(BLANK))
    kind = F.when(F.col("bad") == "malformed JSON", "JSONDecodeError").when(F.col("bad").isNotNull(), "ValueError").when(value_error.isNotNull(), "ValueError").when(empty, "EmptyResponseError")
    error = F.coalesce("bad", value_error, F.when(empty, "assistant response is empty"))
    out = out.withColumns({"error_type": kind, "error": error, "system": joined})
    return out.withColumn("turns", F.when(F.col("error").isNull(), turns_of(F.col("_conv")))).drop("_typed", "_has", "_p", "_r", "_s", "_sk", "_conv")


def encode(samples: DataFrame, template: str, encode_: Encode, bos: int | None = None, truncate_to: int | None = None, max_len: int = 32768) -> DataFrame:
    """Adds encoded, places, token_ids, response_positions, target_positions; later errors join earlier ones."""
    ok = F.col("error").isNull()
    if T.TEMPLATES[template].native_thought:
        bad = F.exists("turns", lambda t: ~T.native_thought_ok(t["assistant"]))
        samples = samples.withColumns({"error_type": F.when(ok & bad, "ValueError").otherwise(F.col("error_type")), "error": F.when(ok & bad, "response lacks the native thought block").otherwise(F.col("error"))})
    out = samples.withColumn("encoded", F.when(ok, S.encoded_turns(F.col("turns"), F.col("system"), template, encode_, bos)))
    out = out.withColumn("places", S.layout(F.col("encoded"), F.lit(truncate_to) if truncate_to is not None else None))
    out = out.withColumns({"token_ids": S.token_ids(F.col("encoded"), F.col("places")), "response_positions": S.response_positions(F.col("places")), "target_positions": S.target_positions(F.col("places"))})
    late = (
        F.when(~S.end_isolated(F.col("encoded"), template, encode_), F.struct(F.lit("ValueError").alias("k"), F.lit("cannot isolate the response end").alias("e")))
        .when((F.size("token_ids") == 0) | (F.size("target_positions") == 0), F.struct(F.lit("ValueError").alias("k"), F.lit("empty sequence or targets").alias("e")))
        .when(F.get("response_positions", F.lit(0)) == 0, F.struct(F.lit("ValueError").alias("k"), F.lit("the first response token has no context").alias("e")))
        .when(F.size("token_ids") >= max_len, F.struct(F.lit("SequenceTooLongError").alias("k"), F.lit("sequence too long").alias("e"))))
    out = out.withColumn("_late", F.when(ok, late))
    return out.withColumns({"error_type": F.coalesce("error_type", F.col("_late.k")), "error": F.coalesce("error", F.col("_late.e"))}).drop("_late")


def split_errors(samples: DataFrame, index: str = "source_index", sample_id: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """(good samples, error rows: source_index, line_number, sample_id, error_type, error)."""
    bad = samples.where(F.col("error").isNotNull())
    rows = bad.select(F.col(index).alias("source_index"), (F.col(index) + 1).alias("line_number"), F.col(sample_id).cast("string").alias("sample_id"), "error_type", "error")
    return samples.where(F.col("error").isNull()), rows
