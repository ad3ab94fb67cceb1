"""Structure-aware rewriting of JSON, CSV, SQL and chat payloads: only values change, all else stays byte for byte."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from hushlake.operators.scan import Settings, detect

Put = Callable[[str], str]
DEEPEST = 128
_SQL_WORDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP")
_SQL_PARTS = (" FROM ", " INTO ", " SET ", " TABLE ", " WHERE ", " VALUES ", " JOIN ", " INDEX ")


def replacer(settings: Settings, operator: Callable[[str, str], str]) -> Put:
    """Text to text: each kept span through ``operator(entity_type, original)``."""

    def put(text: str) -> str:
        out, at = [], 0
        for x in (x for x in detect(text, settings) if x.replaced):
            out += [text[at : x.start], operator(x.entity_type, text[x.start : x.end])]
            at = x.end
        return "".join([*out, text[at:]])

    return put


def walk_json(value, put: Put, depth: int = 0):
    """String values through ``put``; keys, numbers, booleans and nulls stay. Below DEEPEST levels nothing changes."""
    if depth >= DEEPEST:
        return value
    if isinstance(value, str):
        return put(value)
    if isinstance(value, list):
        return [walk_json(v, put, depth + 1) for v in value]
    if isinstance(value, dict):
        return {k: walk_json(v, put, depth + 1) for k, v in value.items()}
    return value


def _number(digits: str) -> float:
    value = float(digits)
    if value in (float("inf"), float("-inf")):
        raise ValueError("a number out of range")
    return value


def _no_number(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def parsed(text: str):
    """The JSON value of a text; a ValueError for all that is none: also NaN, numbers out of range, and what is too deep to read."""
    try:
        return json.loads(text, parse_float=_number, parse_constant=_no_number)
    except RecursionError as e:
        raise ValueError("too deep") from e


def json_text(text: str, put: Put) -> tuple[str, str]:
    """Rewritten document, keys sorted, with its own indentation and a newline at the end; and ok or malformed."""
    try:
        value = parsed(text)
    except ValueError:
        return text, "malformed"
    indent = next((len(m[1]) for m in re.finditer(r"(?m)^( {1,8})\S", text)), 2)
    return json.dumps(walk_json(value, put), sort_keys=True, indent=indent, ensure_ascii=False) + "\n", "ok"


def csv_fields(text: str) -> list[list[tuple[int, int, bool, str]]] | None:
    """Records of (start, end, quoted, value); None where the text isn't of RFC 4180."""
    records, record, at, n = [], [], 0, len(text)
    while True:
        if text[at : at + 1] == '"':
            end = at + 1
            while True:
                end = text.find('"', end)
                if end < 0:
                    return None
                if text[end + 1 : end + 2] == '"':
                    end += 2
                    continue
                break
            record.append((at, end + 1, True, text[at + 1 : end].replace('""', '"')))
            at = end + 1
        else:
            m = re.compile(r"[^,\r\n]*").match(text, at)
            if '"' in m[0]:
                return None
            record.append((at, m.end(), False, m[0]))
            at = m.end()
        nxt = text[at : at + 1]
        if nxt == ",":
            at += 1
            continue
        if nxt == "\r" and text[at + 1 : at + 2] == "\n":
            at += 2
        elif nxt == "\n":
            at += 1
        elif nxt:
            return None
        records.append(record)
        record = []
        if at >= n:
            return records


def csv_text(text: str, put: Put) -> tuple[str, str]:
    records = csv_fields(text)
    if records is None:
        return text, "malformed"
    out, at = [], 0
    for start, end, quoted, value in (f for r in records for f in r):
        new = put(value)
        if new != value:
            out += [text[at:start], '"' + new.replace('"', '""') + '"' if quoted or re.search(r'[",\r\n]', new) else new]
            at = end
    return "".join([*out, text[at:]]), "ok"


_SQL = re.compile(r"(?P<skip>--[^\n]*|/\*.*?(?:\*/|$)|\"[^\"]*(?:\"|$)|`[^`]*(?:`|$))|(?P<e>(?<![\w$])[eE])?'(?P<body>(?(e)(?:[^'\\]|\\.|'')*|(?:[^']|'')*))'|\$(?P<tag>\w*)\$(?P<dollar>.*?)\$(?P=tag)\$", re.S)


def sql_text(text: str, put: Put) -> tuple[str, str]:
    """Literals of a statement: '...', E'...' and $tag$...$tag$; comments and quoted identifiers stay."""
    out, at = [], 0
    for m in _SQL.finditer(text):
        if m["skip"] is not None:
            continue
        if m["tag"] is not None:
            new = put(m["dollar"])
            mark = f"${m['tag']}$"
            literal = f"{mark}{new}{mark}" if mark not in new else "'" + new.replace("'", "''") + "'"
            changed = new != m["dollar"]
        else:
            value = m["body"].replace("''", "'")
            value = re.sub(r"\\(['\\])", r"\1", value) if m["e"] else value
            new = put(value)
            body = new.replace("\\", "\\\\") if m["e"] else new
            literal, changed = (m["e"] or "") + "'" + body.replace("'", "''") + "'", new != value
        if changed:
            out += [text[at : m.start()], literal]
            at = m.end()
    return "".join([*out, text[at:]]), "ok"


def sniff(text: str) -> str:
    """json, sql, csv or text."""
    if text.lstrip()[:1] in ("{", "["):
        try:
            parsed(text)
            return "json"
        except ValueError:
            pass
    words = text.split(None, 1)
    if words and words[0].upper() in _SQL_WORDS and any(p in text.upper() for p in _SQL_PARTS):
        return "sql"
    records = [r for r in csv_fields(text) or [] if any(f[3].strip() for f in r)]
    if len(records) >= 2 and len(records[0]) >= 2 and len({len(r) for r in records}) == 1:
        return "csv"
    return "text"


def _blocks(value, put: Put):
    """Content of a message: a string, or blocks of text, tool results and tool input."""
    if isinstance(value, str):
        return put(value)
    if not isinstance(value, list):
        return value
    out = []
    for b in value:
        if isinstance(b, dict):
            b = dict(b)
            if isinstance(b.get("text"), str):
                b["text"] = put(b["text"])
            if b.get("type") == "tool_result":
                b["content"] = _blocks(b.get("content"), put)
            if b.get("type") == "tool_use":
                b["input"] = walk_json(b.get("input"), put)
        out.append(b)
    return out


def _descriptions(schema, put: Put):
    if isinstance(schema, list):
        return [_descriptions(s, put) for s in schema]
    if not isinstance(schema, dict):
        return schema
    out = dict(schema)
    if isinstance(out.get("description"), str):
        out["description"] = put(out["description"])
    if isinstance(out.get("properties"), dict):
        out["properties"] = {k: _descriptions(v, put) for k, v in out["properties"].items()}
    for k in ("items", "anyOf", "oneOf", "allOf"):
        if k in out:
            out[k] = _descriptions(out[k], put)
    return out


def _arguments(calls, put: Put):
    out = []
    for c in calls or []:
        c = json.loads(json.dumps(c))
        args = (c.get("function") or {}).get("arguments")
        if isinstance(args, str):
            try:
                c["function"]["arguments"] = json.dumps(walk_json(json.loads(args), put), ensure_ascii=False)
            except ValueError:
                c["function"]["arguments"] = put(args)
        out.append(c)
    return out


def chat_payload(value, put: Put, shape: str = "generic"):
    """A request or response: ``blocks`` (system, messages of content blocks), ``choices`` (messages, tool calls, tools, choices), or all strings."""
    if shape == "generic" or not isinstance(value, dict):
        return walk_json(value, put)
    out = dict(value)
    if "system" in out:
        out["system"] = _blocks(out["system"], put)
    if shape == "blocks" and isinstance(out.get("content"), list):
        out["content"] = _blocks(out["content"], put)

    def message(m):
        m = dict(m) if isinstance(m, dict) else m
        if isinstance(m, dict):
            m["content"] = _blocks(m.get("content"), put)
            if "tool_calls" in m:
                m["tool_calls"] = _arguments(m["tool_calls"], put)
        return m

    if isinstance(out.get("messages"), list):
        out["messages"] = [message(m) for m in out["messages"]]
    if isinstance(out.get("choices"), list):
        out["choices"] = [dict(c, message=message(c.get("message"))) if isinstance(c, dict) else c for c in out["choices"]]
    if isinstance(out.get("tools"), list):
        out["tools"] = [dict(t, function=dict(t["function"], parameters=_descriptions(t["function"].get("parameters"), put))) if isinstance(t, dict) and isinstance(t.get("function"), dict) else t for t in out["tools"]]
    return out


def rewritten(text: Column, put: Put, form: str | None = None) -> Column:
    """struct<fmt, text, status> of a payload column; the format is sniffed unless given. A payload of more than 50 MiB is left and marked."""
    walkers = {"json": json_text, "csv": csv_text, "sql": sql_text, "text": lambda t, p: (p(t), "ok")}

    @pandas_udf("struct<fmt:string,text:string,status:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            if t is None:
                rows.append((None, None, None))
            elif len(t.encode()) > 50 * 1024 * 1024:
                rows.append((None, t, "too_large"))
            else:
                fmt = form or sniff(t)
                rows.append((fmt, *walkers[fmt](t, put)))
        return pd.DataFrame(rows, columns=["fmt", "text", "status"])

    return run(text)


def format_of(text: Column) -> Column:
    """The sniffed format of a payload column; null for null."""
    return pandas_udf(lambda s: s.map(lambda t: None if t is None else sniff(t)), "string")(text)


__all__ = ["chat_payload", "csv_fields", "csv_text", "format_of", "json_text", "replacer", "rewritten", "sniff", "sql_text", "walk_json"]
