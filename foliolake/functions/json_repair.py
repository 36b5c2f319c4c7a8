"""Repair of damaged JSON documents. Runs on the rows a strict parser refuses."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Member names that hold boxes and are noise in text.
JUNK_KEYS = frozenset(["bbox", "bounding_box", "box", "box_2d", "coordinates", "polygon"])


def outer_object(text: str) -> str:
    """From the first brace on, code fences dropped."""
    start = text.find("{")
    return "" if start < 0 else re.sub(r"```\s*$", "", text[start:].rstrip())


def _tokens(text: str):
    """(kind, text) of a forgiving JSON scan: punctuation, string (closed or not), word."""
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c in "{}[]:,":
            yield c, c
            i += 1
        elif c.isspace():
            i += 1
        elif c == '"':
            j, out = i + 1, []
            while j < n:
                if text[j] == "\\" and j + 1 < n:
                    out.append(text[j : j + 2])
                    j += 2
                    continue
                if text[j] == '"':
                    # An inner quote isn't followed by what may follow a string.
                    k = j + 1
                    while k < n and text[k].isspace():
                        k += 1
                    if k >= n or text[k] in ",:}]" or (text[k] == '"' and "\n" in text[j + 1 : k + 1]):
                        break
                    out.append('\\"')
                    j += 1
                    continue
                out.append({"\n": "\\n", "\r": "\\r", "\t": "\\t"}.get(text[j], text[j]))
                j += 1
            body = "".join(out)
            yield "string", body[:-1] if body.endswith("\\") and not body.endswith("\\\\") else body
            i = j + 1
        else:
            j = i
            while j < n and text[j] not in '{}[]:,"' and not text[j].isspace():
                j += 1
            yield "word", text[i:j]
            i = j


def _literal(word: str) -> str:
    known = {"none": "null", "nan": "null", "undefined": "null", "true": "true", "false": "false", "null": "null", "infinity": "null", "-infinity": "null"}
    if word.lower() in known:
        return known[word.lower()]
    try:
        float(word)
        return word if re.fullmatch(r"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?", word) else "null"
    except ValueError:
        return json.dumps(word)


def repair_json(text: str | None) -> str | None:
    """The first object of ``text`` as valid JSON, or None where there is no object at all.

    Words around it and code fences go; missing commas are put in, trailing ones taken out; unescaped quotes within strings are
    escaped; None, NaN, undefined become null; what breaks off is closed in the order it was opened, a member cut off before its
    value is dropped. A document that is valid comes out with the same content.
    """
    if not text:
        return None
    body = outer_object(text)
    if not body:
        return None
    try:
        value, _ = json.JSONDecoder().raw_decode(body)
        return json.dumps(value, ensure_ascii=False)
    except (ValueError, RecursionError):
        pass
    out: list[str] = []
    stack: list[list] = []  # [closing bracket, values so far, state]; state of an object: key, colon, value, comma

    def before_value() -> bool:
        """Puts the comma that may be missing; False where a key is due."""
        if not stack:
            return True
        top = stack[-1]
        if top[0] == "]":
            if top[1]:
                out.append(",")
            top[1] += 1
            return True
        return top[2] == "value"

    def done() -> None:
        if stack and stack[-1][0] == "}":
            stack[-1][2] = "key"

    def close() -> None:
        top = stack.pop()
        if top[0] == "}" and top[2] in ("colon", "value"):
            # A key without a value: take it out, and the comma before it.
            del out[top[3] :]
        out.append(top[0])
        done()

    for kind, x in _tokens(body):
        if not stack and out:
            break
        if kind in "{[" and len(kind) == 1:
            if not before_value():
                continue
            out.append(kind)
            stack.append(["}" if kind == "{" else "]", 0, "key", 0])
        elif kind in "}]" and len(kind) == 1:
            if kind in [s[0] for s in stack]:
                while stack and stack[-1][0] != kind:
                    close()
                close()
        elif kind == ":":
            if stack and stack[-1][0] == "}" and stack[-1][2] == "colon":
                out.append(":")
                stack[-1][2] = "value"
        elif kind == ",":
            continue
        else:
            lit = f'"{x}"' if kind == "string" else _literal(x)
            try:
                json.loads(lit)
            except ValueError:
                lit = json.dumps(x)
            if stack and stack[-1][0] == "}" and stack[-1][2] in ("key", "colon"):
                top = stack[-1]
                if top[2] == "colon":
                    del out[top[3] :]
                    top[1] -= 1
                top[3] = len(out)
                out.append(("," if top[1] else "") + (lit if lit.startswith('"') else json.dumps(x)))
                top[1] += 1
                top[2] = "colon"
            elif before_value():
                out.append(lit)
                done()
    while stack:
        close()
    fixed = "".join(out)
    try:
        return json.dumps(json.loads(fixed), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


def strip_keys(text: str | None, keys: frozenset[str] = JUNK_KEYS) -> str | None:
    """Compact JSON without members of the given names (any case) at any depth; None for what is no JSON."""
    if text is None:
        return None

    def clean(x: object) -> object:
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items() if k.lower() not in keys}
        return [clean(v) for v in x] if isinstance(x, list) else x

    try:
        return json.dumps(clean(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


def repaired(text: Column) -> Column:
    """Valid JSON of a document column: as it is where it is valid, repaired where not."""

    @pandas_udf("string")
    def fix(s):  # noqa: ANN001, ANN202
        return s.map(repair_json)

    valid = F.try_parse_json(text).isNotNull() & F.startswith(F.ltrim(text), F.lit("{"))
    return F.when(valid, text).otherwise(fix(F.when(~F.coalesce(valid, F.lit(False)), text)))


def without_keys(text: Column, keys: frozenset[str] = JUNK_KEYS) -> Column:
    @pandas_udf("string")
    def strip(s):  # noqa: ANN001, ANN202
        return s.map(lambda x: strip_keys(x, keys))

    return strip(text)
