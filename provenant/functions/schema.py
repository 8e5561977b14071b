"""JSON values as variants: key-sorted text, a schema check compiled to columns, and what endpoints and user agents may be."""

from __future__ import annotations

import ipaddress
import json
from collections.abc import Callable
from typing import Any
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a schema's type stands for, by the kind of a variant.
KINDS = {"object": r"^OBJECT", "array": r"^ARRAY", "string": r"^STRING$", "boolean": r"^BOOLEAN$", "null": r"^VOID$", "integer": r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"}
#: The paths at which a compatible endpoint may end, what a truthful user agent never says, and its form.
API_ROOTS = ("", "/v1", "/compatible-mode/v1")
DISGUISES = ("mozilla", "chrome", "reddit/", "bot rotation")
AGENT = r"^[A-Za-z][A-Za-z0-9._-]*/[0-9][A-Za-z0-9._-]* \(.+\)$"


def canonical_json(text: Column) -> Column:
    """A JSON text in compact form with the keys of all its objects in order, at any depth; null if it is not JSON."""
    return F.to_json(F.try_parse_json(text))


def _kind(value: Column, kinds: list[str]) -> Column:
    shape = F.schema_of_variant(value)
    return F.coalesce(shape.rlike("|".join(KINDS[k] for k in kinds)), F.lit(False))


def matches_schema(value: Column, schema: dict[str, Any]) -> Column:
    """Whether a variant fits a JSON schema: types, enumerations, required and further properties, items, at any depth.

    A null column (no JSON at all) does not fit.  A variant keeps numbers without trailing
    zeros, so 1.0 is the integer 1.  Of the schema's words, ``type``, ``enum``,
    ``properties``, ``required``, ``additionalProperties: false`` and ``items`` count.
    """
    kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
    fits = [value.isNotNull(), _kind(value, kinds)]
    if "enum" in schema:
        fits.append(F.to_json(value).isin(*(json.dumps(x, ensure_ascii=False, separators=(",", ":"), sort_keys=True) for x in schema["enum"])))
    if "object" in kinds:
        inner = _once(F.try_variant_get(value, "$", "map<string,variant>"), lambda fields: _fields_fit(fields, schema))
        fits.append(inner if kinds == ["object"] else ~_kind(value, ["object"]) | inner)
    if "array" in kinds and "items" in schema:
        items = F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda x: matches_schema(x, schema["items"]))
        fits.append(items if kinds == ["array"] else ~_kind(value, ["array"]) | items)
    return _all(fits)


def _fields_fit(fields: Column, schema: dict[str, Any]) -> Column:
    """Whether an object's fields, as a map, are those that a schema wants."""
    known, required = schema.get("properties", {}), schema.get("required", [])
    names = F.map_keys(fields)
    inner = [F.size(F.array_except(F.array(*map(F.lit, required)), names)) == 0] if required else []
    if schema.get("additionalProperties") is False:
        inner.append(F.size(F.array_except(names, F.array(*map(F.lit, known)).cast("array<string>"))) == 0)
    for name, of in known.items():
        fit = _once(F.element_at(fields, F.lit(name)), _checker(of))
        inner.append(fit if name in required else ~F.array_contains(names, name) | fit)
    return _all(inner)


def _checker(schema: dict[str, Any]) -> Callable[[Column], Column]:
    return lambda x: matches_schema(x, schema)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression of a value that is worked out once, however often the expression names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _all(parts: list[Column]) -> Column:
    """All of some conditions, each looked at only if those before hold."""
    out = F.lit(True)
    for part in reversed(parts):
        out = F.when(F.coalesce(part, F.lit(False)), out).otherwise(F.lit(False))
    return out


def valid_user_agent(value: Column) -> Column:
    """Whether a user agent names a product, a version and a contact, and poses as nobody else."""
    posing = F.lit(False)
    for word in DISGUISES:
        posing |= F.contains(F.lower(value), F.lit(word))
    return F.coalesce(F.trim(value).rlike(AGENT) & ~posing, F.lit(False))


def _class_of(url: str | None) -> str | None:
    try:
        parts = urlsplit(url or "")
        host = parts.hostname or ""
    except ValueError:
        return None
    if parts.scheme not in ("http", "https") or not host or parts.username or parts.password or parts.query or parts.fragment or parts.path.rstrip("/") not in API_ROOTS:
        return None
    if host.casefold() == "localhost":
        return "loopback"
    try:
        address = ipaddress.ip_address(host)
    except ValueError:
        return "remote_or_unknown"
    return "loopback" if address.is_loopback else "private_network" if address.is_private else "remote_or_unknown"


@F.pandas_udf(T.StringType())
def endpoint_class(urls: pd.Series) -> pd.Series:
    """``loopback``, ``private_network`` or ``remote_or_unknown`` of a model endpoint; null for what is none."""
    return urls.map({u: _class_of(u) for u in urls.unique()}, na_action="ignore")
