"""Conversations: messages from JSON, tool calls with their outputs, and redaction with one token map for each conversation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import privacy
from ..functions import scalars as S
from ..sources.shared import written

MESSAGES = "array<struct<id:string,role:string,content:string,toolInvocations:array<struct<state:string,toolCallId:string,toolName:string,args:string,result:string>>>>"
ROLES = ("user", "assistant", "system", "data")


def parse_messages(rows: DataFrame, column: str) -> DataFrame:
    """Messages of a JSON array, in order; those of unknown role or without content are left out, an unreadable text has none."""
    out = rows.select(*[c for c in rows.columns if c != column], F.posexplode(F.coalesce(F.from_json(column, MESSAGES), F.array().cast(MESSAGES))).alias("turn", "m"))
    return out.select(*[c for c in rows.columns if c != column], "turn", F.col("m.id").alias("message_id"), F.lower("m.role").alias("role"), F.trim("m.content").alias("text")).filter(F.col("role").isin(*ROLES) & (F.coalesce("text", F.lit("")) != ""))


def tool_calls(rows: DataFrame, column: str) -> DataFrame:
    """The tool calls that assistants' messages of a JSON array hold: call_id, tool_name, state (call, else result), args and
    result as JSON; those without id or name are left out."""
    m = F.explode(F.filter(F.coalesce(F.from_json(column, MESSAGES), F.array().cast(MESSAGES)), lambda x: F.lower(x["role"]) == "assistant"))
    kept = [c for c in rows.columns if c != column]
    calls = rows.select(*kept, m.alias("m")).select(*kept, F.posexplode("m.toolInvocations").alias("call_no", "t")).filter("t.toolCallId <> '' and t.toolName <> ''")
    state = F.when(F.col("t.state") == "call", "call").otherwise("result")
    return calls.select(*kept, "call_no", F.col("t.toolCallId").alias("call_id"), F.col("t.toolName").alias("tool_name"), state.alias("state"), F.coalesce("t.args", F.lit("{}")).alias("args"), F.when(state == "result", F.col("t.result")).alias("result"))


def shown_text(text, tokens) -> Column:
    """A text for display: repaired tokens, and tokens (a map, token to value) back to their values."""
    known = F.map_keys(S.col(tokens))
    return F.aggregate(F.map_entries(S.col(tokens)), repair_tokens(text, known), lambda t, e: F.replace(t, e["key"], e["value"]))


def tool_states(calls: DataFrame, outputs: DataFrame) -> DataFrame:
    """Tool calls (call_id) with their state: result before error before invalid; a call without output stays a call."""
    rank = F.when(F.col("kind") == "result", 0).when(F.col("kind") == "error", 1).otherwise(2)
    best = outputs.groupBy("call_id").agg(F.min(F.struct(rank.alias("rank"), "kind", "output")).alias("o"))
    return calls.join(best, "call_id", "left").select(*calls.columns, F.coalesce(F.when(F.col("o.rank") < 2, F.col("o.kind")), F.when(F.col("o").isNotNull(), "invalid"), F.lit("call")).alias("state"), F.col("o.output").alias("output"))


FOUND = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))


def _find(texts: pd.Series) -> pd.Series:
    """Places, kinds and values of personal data, those that redact_text() replaces."""
    out = []
    for text in texts:
        tokens: dict[str, str] = {}
        privacy.redact_text(text if isinstance(text, str) else None, tokens)
        out.append([{"at": text.find(v), "kind": re.match(r"\[(\w+)_\d+\]", k)[1], "value": v} for k, v in tokens.items()])
    return pd.Series(out, dtype=object)


def redact_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with redacted and token_key, tokens) of rows (conv_id, turn, text). A value has the same token in all turns of a
    conversation; tokens count from its first value on. tokens: conv_id, token_key, token, value.

    token_key names whose tokens a row has: its conversation's or, without conv_id, those of its own text. Null turns, and rows that
    repeat, are redacted like others and none is lost. Only the values found are gathered by conversation, never its turns, so a
    conversation of any length spreads out; each text meets its own values alone, also where many rows share a turn or have none.
    Values are looked for once: those found are written, and read for the tokens and for the texts.
    """
    privacy.small_batches()

    def find(texts: pd.Series) -> pd.Series:
        return _find(texts)

    def replace(texts: pd.Series, values: pd.Series, tokens: pd.Series) -> pd.Series:
        return pd.Series([x if v is None else _replaced(x, zip(v, k, strict=True)) for x, v, k in zip(texts, values, tokens, strict=True)], dtype=object)

    own = F.coalesce(F.col("conv_id").cast("string"), F.concat(F.lit("text-"), F.sha2(F.coalesce("text", F.lit("")), 256)))
    keyed = rows.withColumn("token_key", own).withColumn("text_key_", F.sha2(F.coalesce("text", F.lit("")), 256))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    found = keyed.select("token_key", "conv_id", "text_key_", turn.alias("turn_"), F.explode(F.pandas_udf(find, FOUND)("text")).alias("f"))
    found = written(found.select("token_key", "conv_id", "text_key_", "turn_", "f.*"), "values-found")
    values = found.groupBy("token_key", "conv_id", "value").agg(F.min(F.struct("turn_", "at", "kind")).alias("first"))
    number = F.row_number().over(Window.partitionBy("token_key").orderBy("first", "value"))
    tokens = values.withColumn("token", F.concat(F.lit("["), "first.kind", F.lit("_"), number.cast("string"), F.lit("]"))).select("conv_id", "token_key", "token", "value")
    used = found.select("token_key", "text_key_", "value").distinct().join(tokens.drop("conv_id"), ["token_key", "value"])
    # longest first, so that a value inside another one doesn't break it
    of_text = used.groupBy("token_key", "text_key_").agg(F.array_sort(F.collect_list(F.struct((-F.length("value")).alias("n"), "value", "token"))).alias("used"))
    joined = keyed.join(of_text, ["token_key", "text_key_"], "left")
    text = F.when(F.col("used").isNull(), F.col("text")).otherwise(F.pandas_udf(replace, "string")(F.when(F.col("used").isNotNull(), F.col("text")), F.col("used.value"), F.col("used.token")))
    return joined.withColumn("redacted", text).select(*rows.columns, "redacted", "token_key"), tokens


def _replaced(text: str, pairs) -> str:
    """text with each value's token in its place, one value after the other; what has become a token isn't searched again."""
    parts = [text]  # texts at even places, tokens at odd ones
    for value, token in pairs:
        out = []
        for i, part in enumerate(parts):
            pieces = part.split(value) if i % 2 == 0 else [part]
            out.append(pieces[0])
            for piece in pieces[1:]:
                out += [token, piece]
        parts = out
    return "".join(parts)


def restore_conversations(rows: DataFrame, tokens: DataFrame, column: str = "redacted") -> DataFrame:
    """Adds restored: the tokens of a row's token_key back to their values. Different texts find their values once, by the texts'
    digests, so rows that repeat stay as many as they are."""
    key = F.sha2(F.col(column), 256)
    mine = F.explode(F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(r"(\[[A-Z_]+_\d+\])"), F.lit(1)))).alias("token")
    named = rows.select("token_key", key.alias("text_key_"), mine).distinct().join(tokens.select("token_key", "token", "value"), ["token_key", "token"])
    packed = named.groupBy("token_key", "text_key_").agg(F.collect_list(F.struct("token", "value")).alias("pairs_"))
    joined = rows.withColumn("text_key_", key).join(packed, ["token_key", "text_key_"], "left")
    back = F.aggregate("pairs_", F.col(column), lambda t, p: F.replace(t, p["token"], p["value"]))
    return joined.select(*rows.columns, F.coalesce(back, F.col(column)).alias("restored"))


def repair_tokens(text, known) -> Column:
    """Tokens with a wrong type but a known number get the known type: [NAME_3] becomes [EMAIL_ADDRESS_3]."""
    text, known = S.col(text), S.col(known)
    number = lambda t: F.regexp_extract(t, r"_(\d+)\]$", 1)
    seen = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\[[A-Z_]+_\d+\])"), F.lit(1)))
    wrong = F.filter(seen, lambda t: ~F.array_contains(known, t))
    right = lambda t: F.get(F.filter(known, lambda k: number(k) == number(t)), F.lit(0))
    return F.aggregate(wrong, text, lambda x, t: F.replace(x, t, F.coalesce(right(t), t)))
