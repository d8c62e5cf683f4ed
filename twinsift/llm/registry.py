"""The queries of this subpackage."""

from __future__ import annotations

from twinsift.llm import language, linedup, mixing, neardup, packing, quality, substrings, toolcalls, topk, urls

_MODULES = (substrings, mixing, toolcalls, neardup, linedup, language, topk, packing, quality, urls)


#: The two operators whose tables here lack what they work on, over tables in which it is planted.
_PLANTED = {"tool_calls_planted": toolcalls, "url_aliases_planted": urls}


def queries() -> dict:
    return {m.NAME: m.query for m in _MODULES} | {name: m.planted_query for name, m in _PLANTED.items()}


def oracle_sql() -> dict:
    return {m.NAME: m.SQL for m in _MODULES if m.SQL} | {name: m.PLANTED_SQL for name, m in _PLANTED.items()}
