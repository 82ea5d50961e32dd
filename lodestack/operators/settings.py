"""Settings over defaults: documents of JSON merged key by key at any depth, in the row where they stand."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

OBJECT = "map<string,variant>"


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _value(default) -> Column:
    return F.parse_json(F.lit(json.dumps(default)))


def _object(text: Column) -> Column:
    """text as an object's map, null if it is none. The parser ends with the first value, so what follows it is told by
    parsing the text inside an array and inside an object: no rest of a text fits both."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    held = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    one = listed.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(one, F.try_variant_get(held, "$.v", OBJECT))


def _over(defaults: dict):
    return lambda own: _merged(own, defaults)


def _merged(own: Column, defaults: dict) -> Column:
    """An object's map over defaults, as a variant object."""
    cells = []
    for name, default in defaults.items():
        mine = own[name]
        if isinstance(default, dict):
            inner = F.try_variant_get(mine, "$", OBJECT)
            mine = F.when(inner.isNotNull(), _bound(inner, _over(default))).otherwise(mine)
        cells += [F.lit(name), F.coalesce(mine, _value(default))]
    if not cells:
        return F.to_variant_object(own)
    others = F.map_filter(own, lambda k, _: ~k.isin(list(defaults)))
    return F.to_variant_object(F.map_concat(others, F.create_map(*cells)))


def over_defaults(text: Column, defaults: dict) -> Column:
    """The JSON document of text over defaults, as a variant.

    Where both hold an object at a key, these are merged in turn; else what the document says stands, its nulls and
    arrays included, and keys without a word in it are those of defaults. A text that is null, no JSON, no object or
    that names a key twice counts as an object without keys. Defaults are one document of the program's, which becomes
    part of the expression; nothing is shuffled and nothing is bounded in the depth of text."""
    own = F.coalesce(_object(text), F.create_map().cast(OBJECT))
    return _bound(own, _over(defaults))


def overrides(text: Column, defaults: dict) -> Column:
    """The sorted dotted paths of defaults' leaves at which the merged document differs from them."""
    paths: list[tuple[list[str], object]] = []

    def walk(at: list[str], value) -> None:
        if isinstance(value, dict) and value:
            for k, v in value.items():
                walk([*at, k], v)
        elif at:
            paths.append((at, value))

    walk([], defaults)
    merged = over_defaults(text, defaults)

    def named(m: Column) -> Column:
        found = []
        for at, value in paths:
            place = "$" + "".join("[" + json.dumps(k) + "]" for k in at)
            same = F.to_json(F.try_variant_get(m, place, "variant")).eqNullSafe(F.to_json(_value(value)))
            found.append(F.when(~same, F.lit(".".join(at))))
        return F.array_sort(F.array_compact(F.array(*found)))

    return _bound(merged, named) if paths else F.array().cast("array<string>")
