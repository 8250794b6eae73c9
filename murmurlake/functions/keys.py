"""Keys under which answers to requests are stored.

A key hashes ``service:model:payload``, the payload as JSON with sorted names, so equal requests meet whatever order their fields had.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, FractionalType, StringType, StructType

from murmurlake.functions.text import number_text


def json_string(column: Column) -> Column:
    """A text as a JSON string: quotes, backslashes and control characters escaped, anything else as it is."""
    plain = F.replace(F.replace(column, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = plain
    for code in range(32):
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(json.dumps(chr(code))[1:-1]))
    return F.concat(F.lit('"'), F.when(column.rlike(r"[\x00-\x1f]"), escaped).otherwise(plain), F.lit('"'))


def _code_units(text: str) -> bytes:
    return text.encode("utf-16-be")


def canonical_json(column: Column, kind: DataType) -> Column:
    """JSON of a value of type ``kind``, names sorted at every level; a null field is left out, a null element of an array is null."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: _code_units(f.name))
        parts = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ":"), canonical_json(column[f.name], f.dataType)) for f in fields]
        made = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, ArrayType):
        items = F.transform(column, lambda x: F.coalesce(canonical_json(x, kind.elementType), F.lit("null")))
        made = F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    elif isinstance(kind, StringType):
        made = json_string(column)
    elif isinstance(kind, FractionalType):
        made = number_text(column.cast("double"))
    elif isinstance(kind, BooleanType):
        made = F.when(column, "true").otherwise("false")
    else:
        made = column.cast("string")
    return F.when(column.isNotNull(), made)


def request_key(service: Column, model: Column, payload: Column) -> Column:
    """``payload``: JSON of the request."""
    return F.sha2(F.concat(service, F.lit(":"), model, F.lit(":"), payload), 256)


def by_code_units(texts: Column) -> Column:
    """An array of texts sorted by UTF-16 code units."""
    keyed = F.transform(texts, lambda t: F.struct(F.encode(t, "UTF-16BE").alias("k"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda s: s["t"])


_TEXTS = ArrayType(StringType())


def embedding_key(model: Column, inputs: Column) -> Column:
    """The order of the inputs doesn't matter."""
    payload = F.concat(F.lit('{"inputs":'), canonical_json(by_code_units(inputs), _TEXTS), F.lit("}"))
    return F.concat(F.lit("ai/openai/"), model, F.lit("/"), request_key(F.lit("openai"), model, payload))


def classifier_key(provider: Column, model: Column, signature: Column, messages: Column) -> Column:
    """``messages``: array of struct(message_id, content) in the order asked; ``signature`` tells prompts apart."""
    told = F.transform(messages, lambda m: F.concat(F.lit('{"content":'), json_string(m["content"]), F.lit(',"id":'), m["message_id"].cast("string"), F.lit("}")))
    payload = F.concat(F.lit('{"messages":['), F.array_join(told, ","), F.lit("]}"))
    return F.concat(F.lit("ai/"), F.concat_ws("/", provider, model, signature, request_key(provider, model, payload)))


def _place(name: str, query: Column, region: Column) -> Column:
    bias = F.coalesce(F.concat(F.lit(',"regionBias":'), json_string(region)), F.lit(""))
    return F.concat(F.lit(f'{{"{name}":'), json_string(query), bias, F.lit("}"))


def place_key(kind: Column, query: Column, region: Column) -> Column:
    """``kind``: 'places' or 'geocode'; ``region`` may be null."""
    return F.concat(F.lit("places/"), kind, F.lit("/"), request_key(F.lit("google"), kind, _place("query", query, region)))


def geocode_key(location: Column, region: Column) -> Column:
    return F.concat(F.lit("geo/google/"), request_key(F.lit("google"), F.lit("geocoding"), _place("location", location, region)))


def _readable(column: Column, size: int) -> Column:
    """Letters, digits, hyphens and single underscores, none of them at an end before the cut."""
    joined = F.regexp_replace(F.regexp_replace(column, r"[^a-zA-Z0-9_-]", "_"), "_+", "_")
    return F.substring(F.regexp_replace(joined, "^_|_$", ""), 1, size)


def _short_hash(column: Column) -> Column:
    return F.substring(F.sha2(column, 256), 1, 8)


def url_key(url: Column) -> Column:
    return F.concat(F.lit("web/"), _readable(url, 80), F.lit("_"), _short_hash(url))


def image_key(source: Column, query: Column) -> Column:
    low = F.lower(query)
    return F.concat(F.lit("images/"), source, F.lit("/"), _readable(low, 24), F.lit("-"), _short_hash(low))


def image_filename(url: Column) -> Column:
    return F.concat(_readable(F.regexp_replace(url, "^https?://", ""), 36), F.lit("-"), _short_hash(url), F.lit(".jpg"))


def prompt_signature(*prompts: str) -> str:
    """8 hex digits that change with any of the prompts."""
    return hashlib.sha256("\n".join(prompts).encode()).hexdigest()[:8]
