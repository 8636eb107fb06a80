"""Identifiers that entries of different sources may share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Identifiers in running text, and addresses that say nothing about a client.
IPV4 = r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"
REQUEST_ID = r"(?i)(?:request.?id|x.request.id|trace.?id|correlation.?id)[=: ]+([a-f0-9\-]{8,})"
SESSION_ID = r"(?i)(?:session.?id|sess.?id|jsessionid)[=: ]+([a-zA-Z0-9\-_]{8,})"
NO_CLIENT = ["127.0.0.1", "0.0.0.0"]
#: What a shared identifier of each kind adds to the confidence; units are found but never matched.
WEIGHTS = {"ip": 0.5, "pid": 0.6, "request_id": 0.9, "session_id": 0.8, "uri": 0.4, "user": 0.3}


def _of_text(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    found = [
        F.transform(F.filter(F.regexp_extract_all(text, F.lit(IPV4), F.lit(1)), lambda x: ~x.isin(NO_CLIENT)), lambda x: F.concat(F.lit("ip="), x)),
        F.transform(F.regexp_extract_all(text, F.lit(REQUEST_ID), F.lit(1)), lambda x: F.concat(F.lit("request_id="), x)),
        F.transform(F.regexp_extract_all(text, F.lit(SESSION_ID), F.lit(1)), lambda x: F.concat(F.lit("session_id="), x)),
    ]
    return found


def _of_field(field: Column) -> Column:
    """The identifiers of one field, given as name (in lower case), text and whether it is a text (else a number)."""
    key, text, is_text = field["key"], field["text"], field["is_text"]
    holds = lambda word: F.contains(key, F.lit(word))
    kinds = [
        ("ip", is_text & (holds("ip") | key.isin("client", "remote_addr", "host")) & text.rlike(IPV4)),
        ("uri", is_text & (holds("uri") | key.isin("path", "script", "url"))),
        ("user", is_text & holds("user") & ~text.isin("-", "")),
        ("request_id", is_text & (holds("request_id") | holds("trace_id"))),
        ("session_id", is_text & holds("session")),
        ("unit", is_text & key.isin("unit", "service")),
        ("pid", ~is_text & key.isin("pid", "procid") & text.rlike(r"^\d+$")),
    ]
    return F.array_compact(F.array(*[F.when(is_kind, F.concat(F.lit(f"{kind}="), text)) for kind, is_kind in kinds]))


def _fields(fields: str | Column) -> Column:
    """Name, text and kind of each field, worked out once for all the kinds of identifiers."""
    plain = lambda v: F.when(F.contains(v, F.lit("\\")), F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")).otherwise(F.substring(v, F.lit(2), F.length(v) - 2))

    def one(e: Column) -> Column:
        is_text = F.startswith(e["value"], F.lit('"'))
        return F.struct(F.lower(e["key"]).alias("key"), F.when(is_text, plain(e["value"])).otherwise(e["value"]).alias("text"), is_text.alias("is_text"))

    return F.transform(F.map_entries(field_texts(fields)), one)


def field_texts(fields: str | Column) -> Column:
    """The fields of a JSON object as a map from name to JSON text; null for other text."""
    parsed = F.from_json(fields, "map<string,variant>")
    return F.transform_values(parsed, lambda _, v: F.to_json(v))


def field_text(fields: str | Column, name: str) -> Column:
    """One field of a JSON object as JSON text, as field_texts() has it."""
    return F.to_json(F.try_element_at(F.from_json(fields, "map<string,variant>"), F.lit(name)))


def identifiers(fields: str | Column = "fields", raw: str | Column = "raw", message: str | Column = "message") -> Column:
    """All identifiers as a sorted array of kind=value, each once, from the fields, the raw line and the message."""
    texts = [F.col(x) if isinstance(x, str) else x for x in (raw, message)]
    named = F.flatten(F.transform(_fields(fields), _of_field))
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(named, F.expr("cast(array() as array<string>)")), *[x for t in texts for x in _of_text(t)])))


def matchable(ids: Column) -> Column:
    """Without the kinds that are never matched."""
    return F.filter(ids, lambda x: ~F.startswith(x, F.lit("unit=")))
