"""Fields of model payloads, whose types vary: VARIANT in, typed Columns out.

A payload is one VARIANT object. A key that is absent differs from one that holds JSON null: `given` tells, and defaults go
in where the key is absent unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions import answers, text

# Words for a confidence.
CONFIDENCE_WORDS = {"高": 0.9, "中": 0.6, "低": 0.3, "high": 0.9, "medium": 0.6, "low": 0.3}
# End of fixed values.

EMPTY = "array<string>"


def nothing() -> Column:
    return F.array().cast(EMPTY)


def raw(item: Column | str, key: str) -> Column:
    return F.try_variant_get(item, f"$.{key}", "variant")


def given(item: Column | str, key: str) -> Column:
    """Whether the key is there, with null or not."""
    return raw(item, key).isNotNull()


def kind(item: Column | str, key: str) -> Column:
    return answers.kind(raw(item, key))


def string(item: Column | str, key: str, default: str | None = None) -> Column:
    """The value as a string; `default` where the key is absent."""
    value = F.try_variant_get(item, f"$.{key}", "string")
    return value if default is None else F.when(given(item, key), value).otherwise(F.lit(default))


def filled(item: Column | str, key: str, default: str = "unknown") -> Column:
    """The value as a string; `default` where it is absent, null or empty."""
    value = F.try_variant_get(item, f"$.{key}", "string")
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(default)).otherwise(value)


def number(item: Column | str, key: str, default: Column | float) -> Column:
    """The value as a number; `default` where it is absent or none."""
    default = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.try_variant_get(item, f"$.{key}", "string").try_cast("double"), default)


def flag(item: Column | str, key: str, default: bool | Column = False) -> Column:
    default = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.try_variant_get(item, f"$.{key}", "boolean"), default)


def strings(item: Column | str, key: str) -> Column:
    """A list's items as strings; anything else is an empty list."""
    return F.when(kind(item, key) == "array", F.coalesce(F.try_variant_get(item, f"$.{key}", EMPTY), nothing())).otherwise(nothing())


def listed(item: Column | str, key: str) -> Column:
    """A list's items, or the one string that stands for a list."""
    return F.when(kind(item, key) == "string", F.array(string(item, key))).otherwise(strings(item, key))


def objects(item: Column | str, key: str, shape: str) -> Column:
    """A list's objects in the given shape, fields that an object lacks being null; anything else is an empty list."""
    kind_ = f"array<{shape}>"
    return F.when(kind(item, key) == "array", F.coalesce(F.try_variant_get(item, f"$.{key}", kind_), F.array().cast(kind_))).otherwise(F.array().cast(kind_))


def confidence(item: Column | str, key: str = "confidence") -> Column:
    """A number as it is, a word's value, 0 for other words and where it is absent."""
    words = F.create_map(*[F.lit(x) for pair in CONFIDENCE_WORDS.items() for x in pair])
    word = F.coalesce(F.element_at(words, F.lower(text.stripped(string(item, key)))), F.lit(0.0))
    return F.when(kind(item, key) == "string", word).otherwise(F.coalesce(F.try_variant_get(item, f"$.{key}", "double"), F.lit(0.0)))


def clamped(item: Column | str, key: str, default: Column | float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), number(item, key, default)))


def as_objects(item: Column | str, key: str, most: int, default_type: str, width: int = 120) -> Column:
    """Lists, maps and strings as array<struct<type, content>>, `most` of them at most.

    A map gives an entry a key, or one an item where the value is a list; a string is one entry, of type `default_type`;
    items that aren't objects are of type "information".
    """
    shape = "struct<type:string,event_type:string,content:string,description:string,evidence:string>"
    entry = lambda t, c: F.struct(F.substring(t, 1, 40).alias("type"), F.substring(c, 1, width).alias("content"))
    value = raw(item, key)
    items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))

    def of_list(v: Column) -> Column:
        o = F.try_variant_get(v, "$", shape)
        first = lambda *names: F.coalesce(*[F.nullif(o[n], F.lit("")) for n in names])
        return F.when(answers.kind(v) == "object", entry(F.coalesce(first("type", "event_type"), F.lit("information")), F.coalesce(first("content", "description", "evidence"), F.to_json(v)))).otherwise(entry(F.lit("information"), F.try_variant_get(v, "$", "string")))

    pairs = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    of_map = F.flatten(F.transform(pairs, lambda p: F.transform(F.when(answers.kind(p["value"]) == "array", F.try_variant_get(p["value"], "$", "array<variant>")).otherwise(F.array(p["value"])), lambda v: entry(p["key"], F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))))))
    none = F.array().cast("array<struct<type:string,content:string>>")
    out = F.when(kind(item, key) == "object", of_map).when(kind(item, key) == "string", F.array(entry(F.lit(default_type), string(item, key)))).when(kind(item, key) == "array", F.transform(items, of_list)).otherwise(none)
    return F.slice(F.coalesce(out, none), 1, most)


def as_strings(item: Column | str, key: str, most: int, width: int = 120, inside: tuple[str, ...] = ("known_facts", "beliefs", "unknowns", "items", "facts")) -> Column:
    """Lists, maps and strings as array<string>, cut to `width`; of a map its first known list, else its values in key order."""
    nested = [strings(raw(item, key), name) for name in inside]
    hold = F.coalesce(*[F.when(F.size(n) > 0, n) for n in nested])
    values = F.transform(F.map_entries(F.try_variant_get(raw(item, key), "$", "map<string,variant>")), lambda p: F.coalesce(F.try_variant_get(p["value"], "$", "string"), F.to_json(p["value"])))
    out = F.when(kind(item, key) == "object", F.coalesce(hold, values)).otherwise(listed(item, key))
    return F.transform(F.slice(F.coalesce(out, nothing()), 1, most), lambda v: F.substring(v, 1, width))
