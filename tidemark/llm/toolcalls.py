"""Chat formatting: tool calls linked to their results, in a valid order, as canonical JSON.

Calls and results meet in a hash join by identifier.  A call may name another
call that it builds on; the distance to the first call of such a chain is found
by pointer doubling, so a chain of n calls takes about log2(n) joins and no
conversation is ever gathered in one place.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import drop_written, written

_TYPES = {
    "string": str,
    "integer": int,
    "number": (int, float),
    "boolean": bool,
    "array": list,
    "object": dict,
    "null": type(None),
}


def schema_errors(value, schema: dict, path: str = "$") -> list[str]:
    """What in ``value`` breaks ``schema``: type, enum, required, properties,
    additionalProperties, items, minLength, maxLength, minimum and maximum of JSON schema."""
    kinds = schema.get("type")
    if kinds is not None:
        allowed = kinds if isinstance(kinds, list) else [kinds]
        fits = any(
            isinstance(value, _TYPES[k]) and (k == "boolean" or not isinstance(value, bool)) for k in allowed
        )
        if not fits:
            return [f"{path}: not {' or '.join(allowed)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not in enum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{path}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{path}: too long")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{path}: below minimum")
        if value > schema.get("maximum", value):
            out.append(f"{path}: above maximum")
    if isinstance(value, list) and "items" in schema:
        for k, item in enumerate(value):
            out += schema_errors(item, schema["items"], f"{path}[{k}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                out += schema_errors(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{path}.{k}: unknown")
    return out


def canonical_json(value) -> str:
    """Sorted keys, no blanks, text as it is; NaN and infinities are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def check_arguments(name: str | None, arguments: str | None, tools: dict[str, dict]) -> tuple[str | None, list[str]]:
    """Canonical arguments (null if they are no JSON) and what is wrong with them."""
    try:
        value = json.loads(arguments or "", parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
        text = canonical_json(value)
    except (ValueError, RecursionError):
        return None, ["$: not JSON"]
    if name not in tools:
        return text, ["unknown tool"]
    return text, schema_errors(value, tools[name])


def _depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth): calls before this one on its chain; null on or behind a cycle."""
    links = calls.select("conv_id", "call_id", "parent_id")
    parents = links.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_p"))
    state = written(
        links.join(parents, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("parent_id") == F.col("_p")), "left").select(
            "conv_id", "call_id", F.col("_p").alias("jump"), F.when(F.col("_p").isNull(), 0).otherwise(1).cast("long").alias("depth")
        ),
        "call-depths",
    )
    open_before = None
    while True:
        still = state.where(F.col("jump").isNotNull()).count()
        if still == 0 or still == open_before:
            # chains end at doubling distances without a gap: no progress means a cycle
            return state.select("conv_id", "call_id", F.when(F.col("jump").isNull(), F.col("depth")).alias("depth"))
        open_before = still
        ahead = state.select(
            F.col("conv_id").alias("_c"), F.col("call_id").alias("_p"), F.col("jump").alias("_jump"), F.col("depth").alias("_more")
        )
        further = written(
            state.join(ahead, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("jump") == F.col("_p")), "left").select(
                "conv_id", "call_id", F.col("_jump").alias("jump"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")
            ),
            "call-depths",
        )
        drop_written(state)
        state = further


def _first_and_others(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(conv_id, call_id, first, n) of each identifier, and the rows that are not its first one.

    Equal rows are counted before they meet, so an identifier that very many of
    them share stays small.
    """
    keys = ["conv_id", "call_id"]
    counted = rows.where(F.col("call_id").isNotNull()).groupBy(*keys, *order).agg(F.count(F.lit(1)).alias("copies"))
    counted = written(counted, "counted-messages")
    first = counted.groupBy(*keys).agg(F.min(F.struct(*order)).alias("first"), F.sum("copies").alias("n"))
    several = first.where("n > 1").select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_k"), "first")
    left = F.col("copies") - F.struct(*order).eqNullSafe(F.col("first")).cast("int")
    others = (
        counted.join(several, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("call_id") == F.col("_k")))
        .withColumn("left_", left)
        .where("left_ > 0")
        .withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("left_"))))
    )
    return first, others.select(*keys, *order)


def link_tool_calls(calls: DataFrame, results: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """One row for each call, and for each result that no call shows, with its canonical JSON.

    ``calls``: conv_id, call_id, parent_id (the call it builds on, or null), name,
    arguments (JSON text), position.  ``results``: conv_id, call_id, content,
    position.  Other columns are ignored.  ``tools``: JSON schema of the
    arguments by tool name.

    Returns conv_id, call_id, position, depth, status, valid, errors, json.  The
    order (depth, position) is topological within a conversation.  ``status`` is
    linked, early (the result stands before its call), unanswered, orphan (a
    result without a call), repeated, or cyclic (depth null: the chain of parents
    does not end).  Of several calls or results with the same identifier the first
    by position, then by content, is linked; ``errors`` tells of the others, and
    each of them, equal rows too, has a row of its own with the status repeated and
    no depth.  So every result stands in the row of its call or in its own.  A
    parent that is no call of the conversation is named in ``errors``.  Null
    conversations are one conversation; calls and results with a null identifier
    link nothing, and null texts count as empty.
    """
    shown = ["position", "name", "arguments", "parent_id"]
    call, more_calls = _first_and_others(calls.select("conv_id", "call_id", *shown), shown)
    call = call.select("conv_id", "call_id", *[f"first.{c}" for c in shown], F.col("n").alias("calls"))
    loose = calls.where(F.col("call_id").isNull()).select("conv_id", "call_id", *shown, F.lit(1).cast("long").alias("calls"))
    call = written(call, "calls")
    result, more_results = _first_and_others(results.select("conv_id", "call_id", "position", "content"), ["position", "content"])
    result = result.select(
        F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"), F.col("first").alias("_r"), F.col("n").alias("_results")
    )
    depths = _depths(call).select(F.col("conv_id").alias("_dc"), F.col("call_id").alias("_dk"), "depth")
    known = call.select(F.col("conv_id").alias("_pc"), F.col("call_id").alias("_pk"))
    linked = (
        call.unionByName(loose)
        .join(result, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("call_id") == F.col("_call")), "full")
        .join(depths, F.col("conv_id").eqNullSafe(F.col("_dc")) & (F.col("call_id") == F.col("_dk")), "left")
        .join(known, F.col("conv_id").eqNullSafe(F.col("_pc")) & (F.col("parent_id") == F.col("_pk")), "left")
    )

    @F.pandas_udf("valid boolean, errors array<string>, json string")
    def finish(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            out = []
            for r in rows.itertuples(index=False):
                errors = list(r.notes)
                arguments = None
                if r.is_call:
                    arguments, wrong = check_arguments(r.name, r.arguments, tools)
                    errors += wrong
                head = f'{{"arguments":{arguments if arguments is not None else canonical_json(r.arguments)}' if r.is_call else "{"
                tail = canonical_json(
                    {
                        "id": r.call_id,
                        "name": r.name,
                        "result": r.content,
                        "status": r.status,
                    }
                )
                out.append((not errors, errors, f"{head},{tail[1:]}" if r.is_call else tail))
            yield pd.DataFrame(out, columns=["valid", "errors", "json"])

    is_call = F.col("calls").isNotNull()
    status = (
        F.when(~is_call, "orphan")
        .when(F.col("call_id").isNotNull() & F.col("depth").isNull(), "cyclic")
        .when(F.col("_r").isNull(), "unanswered")
        .when(F.col("_r.position") < F.col("position"), "early")
        .otherwise("linked")
    )
    notes = F.array_compact(
        F.array(
            F.when(F.col("calls") > 1, "repeated call"),
            F.when(F.col("_results") > 1, "repeated result"),
            F.when(is_call & F.col("parent_id").isNotNull() & F.col("_pk").isNull(), "unknown parent"),
            F.when(is_call & F.col("call_id").isNull(), "no identifier"),
        )
    )
    rows = linked.select(
        F.when(is_call, F.col("conv_id")).otherwise(F.col("_conv")).alias("conv_id"),
        F.when(is_call, F.col("call_id")).otherwise(F.col("_call")).alias("call_id"),
        F.when(is_call, F.col("position")).otherwise(F.col("_r.position")).alias("position"),
        F.when(is_call & F.col("call_id").isNull(), 0).otherwise(F.col("depth")).cast("long").alias("depth"),
        status.alias("status"),
        is_call.alias("is_call"),
        "name",
        "arguments",
        F.col("_r.content").alias("content"),
        notes.alias("notes"),
    )
    no_text, note = F.lit(None).cast("string"), lambda text: F.array(F.lit(text)).alias("notes")
    loose_results = results.where(F.col("call_id").isNull()).select("conv_id", "call_id", "position", "content")
    for others, is_call, status, text in (
        (more_calls, True, "repeated", "repeated call"),
        (more_results, False, "repeated", "repeated result"),
        (loose_results, False, "orphan", "no identifier"),
    ):
        given = lambda c: F.col(c) if c in others.columns else no_text.alias(c)  # noqa: E731, B023
        rows = rows.unionByName(
            others.select(
                "conv_id", "call_id", "position", F.lit(None).cast("long").alias("depth"), F.lit(status).alias("status"),
                F.lit(is_call).alias("is_call"), given("name"), given("arguments"), given("content"), note(text),
            )
        )
    parts = F.struct(*[F.col(c) for c in ("is_call", "call_id", "name", "arguments", "content", "status", "notes")])
    return rows.withColumn("_done", finish(parts)).select(
        "conv_id", "call_id", "position", "depth", "status", "_done.valid", "_done.errors", "_done.json"
    )


def carry_messages(linked: DataFrame, messages: DataFrame) -> DataFrame:
    """``linked`` (of ``link_tool_calls``) and a row for each turn that is neither call nor result.

    ``messages``: conv_id, position, role, content; other columns are ignored.
    Such a row is an orphan without identifier and depth, is valid, and its
    canonical JSON names its role (null if unknown) and content.  Repeated rows
    are all carried.
    """

    @F.pandas_udf("string")
    def plain(role: pd.Series, content: pd.Series) -> pd.Series:
        texts = [[None if pd.isna(v) else v for v in pair] for pair in zip(role, content)]
        return pd.Series([canonical_json({"content": c, "role": r, "status": "orphan"}) for r, c in texts], dtype=object)

    none = {"call_id": "string", "depth": "long", "status": "string", "valid": "boolean", "errors": "array<string>"}
    rows = messages.select(
        "conv_id", "position", *[F.lit(None).cast(kind).alias(c) for c, kind in none.items()], plain("role", "content").alias("json")
    ).withColumns({"status": F.lit("orphan"), "valid": F.lit(True), "errors": F.array().cast("array<string>")})
    return linked.unionByName(rows)
