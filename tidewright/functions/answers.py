"""Model answers as JSON: fences, tolerant parsing, recovery of truncated arrays, id walks.

Parsed answers are VARIANT columns; what a regular expression or VARIANT can't express (brace scanning, walks of unknown
depth) is an Arrow-batched pandas UDF over small JSON texts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRINGS = T.ArrayType(T.StringType())
ID_KEYS = ("evidence_id", "event_id", "claim_id", "world_event_id")


def strip_fences(raw: Column) -> Column:
    """The first fenced block anywhere, else the text without an opening or closing fence."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    block = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    bare = F.regexp_replace(F.regexp_replace(text, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.when(text.rlike(r"(?s)```(?:json)?\s*(.*?)\s*```"), F.trim(block)).otherwise(bare)


def variant(text: Column) -> Column:
    """The whole text as VARIANT, null where it isn't one JSON value.

    Spark's parser stops after the first value. Within brackets and within an object it can't, and no text fits both but a
    single value.
    """
    in_list, in_object = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"k":'), text, F.lit("}")))
    return F.when(in_list.isNotNull(), F.try_variant_get(in_object, "$.k", "variant"))


def kind(value: Column) -> Column:
    """object, array, string, number, boolean or null of a VARIANT; null where parsing failed."""
    schema = F.schema_of_variant(value)
    return (
        F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean").when(schema == "VOID", "null").when(schema.isNotNull(), "number")
    )


def parse_answer(raw: Column, objects_only: bool = True) -> Column:
    """struct(parsed, parse_ok): the whole text, else its widest braces; with `objects_only` anything but an object fails.

    A whole text that parses to something else than an object isn't searched for braces again.
    """
    whole = variant(raw)
    braces = variant(F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)\{.*\}", 0))
    best = F.coalesce(whole, braces)
    ok = (kind(best) == "object") if objects_only else best.isNotNull()
    ok = F.coalesce(ok, F.lit(False))
    return F.struct(F.when(ok, best).alias("parsed"), ok.alias("parse_ok"))


def field(parsed: Column, path: str, type_: str = "string") -> Column:
    return F.try_variant_get(parsed, f"$.{path}", type_)


def keys_of(json_text: Column) -> Column:
    return F.coalesce(F.json_object_keys(json_text), F.array().cast("array<string>"))


def schema_matches(json_text: Column, wanted: Column) -> Column:
    """Whether a JSON object isn't empty and has all keys of the array `wanted`."""
    keys = keys_of(json_text)
    return (F.size(keys) > 0) & (F.size(F.array_except(wanted, keys)) == 0)


def first_present(json_text: Column, names: list[str]) -> Column:
    """The value of the first key that is present, even if that value is null."""
    keys, out = keys_of(json_text), F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(F.array_contains(keys, F.lit(name)), F.get_json_object(json_text, f"$.{name}")).otherwise(out)
    return out


def cites_forbidden(json_text: Column, forbidden: Column) -> Column:
    """Whether a forbidden id occurs in the serialised answer, as a substring."""
    ids = F.coalesce(forbidden, F.array().cast("array<string>"))
    return F.coalesce(F.exists(ids, lambda f: (f != "") & F.contains(json_text, f)), F.lit(False))


def _present(json_text: Column, name: str) -> Column:
    return F.array_contains(keys_of(json_text), F.lit(name))


def _filled(json_text: Column, name: str) -> Column:
    value = F.get_json_object(json_text, f"$.{name}")
    return F.coalesce(~value.isin("", "false", "0", "[]", "{}"), F.lit(False))


def schema_ok(letter: Column, json_text: Column) -> Column:
    """Required and any-of keys of each probe letter."""
    need = {
        "A": _present(json_text, "knows_truth") & (_filled(json_text, "belief_label") | _filled(json_text, "likely_belief")),
        "B": _present(json_text, "target_knew_truth_at_cutoff") & (_filled(json_text, "reconstructed_prior_belief") | _filled(json_text, "belief_label")),
        "C": _present(json_text, "other_player_knew_truth_at_cutoff") & (_filled(json_text, "other_player_likely_belief") | _filled(json_text, "belief_label")),
        "D": _filled(json_text, "listener") & (_filled(json_text, "predicted_listener_trust_update") | _filled(json_text, "predicted_trust_update")),
    }
    some = F.size(keys_of(json_text)) > 0
    out = some
    for name, rule in need.items():
        out = F.when(letter == name, some & rule).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _walk(value, names: tuple[str, ...], lists: bool) -> Iterator[str]:
    waiting = [value]
    while waiting:
        item = waiting.pop()
        if isinstance(item, list):
            waiting.extend(item)
        elif isinstance(item, dict):
            for key, inner in item.items():
                if key in names and isinstance(inner, str):
                    yield inner
                elif lists and key.endswith("_ids") and isinstance(inner, list):
                    yield from (x for x in inner if isinstance(x, str))
                elif not lists and key == "evidence_ids" and isinstance(inner, list):
                    yield from map(str, inner)
                else:
                    waiting.append(inner)


def _loads(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


@F.pandas_udf(_STRINGS)
def cited_ids(json_text: pd.Series) -> pd.Series:
    """Ids under the known keys and under keys that end in _ids, at any depth; sorted and distinct."""
    return json_text.map(lambda t: sorted(set(_walk(_loads(t), ID_KEYS, True))))


@F.pandas_udf(_STRINGS)
def evidence_ids(json_text: pd.Series) -> pd.Series:
    """Ids under `evidence_ids` alone, at any depth."""
    return json_text.map(lambda t: sorted(set(_walk(_loads(t), (), False))))


def _objects(text: str, start: int, flat: bool = False) -> Iterator[tuple[int, int]]:
    """Spans of top-level {...} after `start`, quotes and escapes respected; `flat` leaves out those within brackets."""
    depth = begin = brackets = 0
    quoted = escaped = False
    for at in range(start, len(text)):
        c = text[at]
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "[]" and not depth:
            brackets += 1 if c == "[" else -1
        elif c == "{":
            begin, depth = (at if depth == 0 else begin), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if not depth and not (flat and brackets):
                yield begin, at + 1


def _doubtful(item: dict) -> str:
    try:
        sure = min(1.0, max(0.0, float(item.get("certainty"))))
    except (TypeError, ValueError):
        sure = 0.5
    return json.dumps({**item, "needs_human_review": True, "certainty": min(sure, 0.5)}, ensure_ascii=False)


def partial_objects(text: str | None, most: int = 4) -> list[str]:
    text = text or ""
    start, out = text.find("["), []
    if start >= 0:
        for a, b in _objects(text, start + 1):
            item = _loads(text[a:b])
            if isinstance(item, dict):
                out.append(_doubtful(item))
                if len(out) == most:
                    break
    return out


@F.pandas_udf(_STRINGS)
def recover_objects(raw: pd.Series) -> pd.Series:
    """Up to four whole objects of a truncated array, marked for review with a certainty of at most 0.5."""
    return raw.map(partial_objects)


@F.pandas_udf(T.StringType())
def recover_object(raw: pd.Series) -> pd.Series:
    """The first balanced object, marked likewise; null where there is none or it doesn't parse."""

    def first(text):
        text = text or ""
        start = text.find("{")
        span = next(_objects(text, start), None) if start >= 0 else None
        item = _loads(text[span[0] : span[1]]) if span else None
        return _doubtful(item) if isinstance(item, dict) else None

    return raw.map(first)


def leading_objects(text: str | None) -> list[str]:
    """Objects of an array's sound head: spans of objects in order, up to one that doesn't parse or that follows something that
    is neither a comma nor a value."""
    text, found, end = (text or "").strip(), [], 1
    if not text.startswith("["):
        return found
    for a, b in _objects(text, 1, flat=True):
        between, item = text[end:a].strip(" \n\r\t,"), _loads(text[a:b])
        if item is None or (between and _loads(f"[{between}]") is None):
            break
        found.append(json.dumps(item, ensure_ascii=False))
        end = b
    return found


@F.pandas_udf(_STRINGS)
def recover_array(raw: pd.Series) -> pd.Series:
    """The objects of an answer's array, as far as it is sound (`leading_objects`); null where there are none."""
    return raw.map(lambda t: leading_objects(t) or None)


@F.pandas_udf(T.StringType())
def stable_hash(json_text: pd.Series) -> pd.Series:
    """sha256 of canonical JSON: sorted keys, no spaces."""
    return json_text.map(lambda t: hashlib.sha256(json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest())


@F.pandas_udf(T.StringType())
def _without(json_text: pd.Series, names: pd.Series) -> pd.Series:
    def strip(value, drop):
        if isinstance(value, dict):
            return {k: strip(v, drop) for k, v in value.items() if k not in drop}
        return [strip(v, drop) for v in value] if isinstance(value, list) else value

    return pd.Series([None if t is None else json.dumps(strip(json.loads(t), set(n)), ensure_ascii=False) for t, n in zip(json_text, names)])


def without_keys(json_text: Column, names: list[str]) -> Column:
    """The JSON without these keys, at any depth."""
    return _without(json_text, F.array(*[F.lit(n) for n in names]))


@F.pandas_udf(T.BooleanType())
def _has_key_value(json_text: pd.Series, key: pd.Series, value: pd.Series) -> pd.Series:
    def found(item, k, v):
        if isinstance(item, dict):
            return item.get(k) == v or any(found(x, k, v) for x in item.values())
        return isinstance(item, list) and any(found(x, k, v) for x in item)

    return pd.Series([found(_loads(t), k, v) for t, k, v in zip(json_text, key, value)])


def has_key_value(json_text: Column, key: str, value: str) -> Column:
    """Whether `key` has this value at any depth."""
    return _has_key_value(json_text, F.lit(key), F.lit(value))


def compact_context(snapshot: Column, sizes: dict[str, int]) -> Column:
    """JSON of the first items of each named array of a struct."""
    return F.to_json(F.struct(*[F.slice(snapshot[name], 1, n).alias(name) for name, n in sizes.items()]))


def task_key(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def split_of(group_id: Column) -> Column:
    """train, dev or test at 70, 20 and 10 of 100 by the first 32 bits of a sha256."""
    value = F.conv(F.substring(F.sha2(group_id.cast("string"), 256), 1, 8), 16, 10).cast("long") % 10
    return F.when(value < 7, "train").when(value < 9, "dev").otherwise("test")
