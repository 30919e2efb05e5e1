"""Front matter of documents as VARIANT.

A header is block mappings, block and flow lists, flow mappings, plain and quoted
scalars and comments, as documents carry them; anchors, tags, block scalars and
several documents in one are not taken. Numbers, true, false and null are read as such.
A header of another form gives null, as does a document without one.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import front_matter

_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "\\": "\\", '"': '"', "/": "/", " ": " "}
_NUMBER = re.compile(r"[-+]?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?\Z")
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\[\]{},"'#&*!|>%@`:-][^#]*?|-[^\s#][^#]*?)\s*:(?:\s+|\Z)""")


class _Malformed(ValueError):
    pass


def _plain(text: str):
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if _NUMBER.match(text):
        return float(text) if re.search("[.eE]", text) else int(text)
    return text


def _quoted(text: str, at: int) -> tuple[str, int]:
    """The quoted scalar that begins at a place, and the place behind it."""
    mark, out, k = text[at], [], at + 1
    while k < len(text):
        c = text[k]
        if c == mark:
            if mark == "'" and text[k + 1 : k + 2] == "'":
                out.append("'")
                k += 2
                continue
            return "".join(out), k + 1
        if c == "\\" and mark == '"':
            code = text[k + 1 : k + 2]
            size = {"x": 2, "u": 4, "U": 8}.get(code)
            try:
                out.append(chr(int(text[k + 2 : k + 2 + size], 16)) if size else _ESCAPES[code])
            except (KeyError, ValueError) as e:
                raise _Malformed from e
            k += 2 + (size or 0)
            continue
        out.append(c)
        k += 1
    raise _Malformed


def _flow(text: str, at: int):
    """The value that begins at a place within brackets, and the place behind it."""
    at += len(text[at:]) - len(text[at:].lstrip())
    c = text[at : at + 1]
    if c and c in "\"'":
        return _quoted(text, at)
    if c and c in "[{":
        out, end, at = ([], "]", at + 1) if c == "[" else ({}, "}", at + 1)
        while True:
            at += len(text[at:]) - len(text[at:].lstrip())
            if text[at : at + 1] == end:
                return out, at + 1
            if c == "[":
                value, at = _flow(text, at)
                out.append(value)
            else:
                name, at = _flow(text, at)
                at += len(text[at:]) - len(text[at:].lstrip())
                if text[at : at + 1] != ":" or isinstance(name, (list, dict)):
                    raise _Malformed
                value, at = _flow(text, at + 1)
                out[str(name)] = value
            at += len(text[at:]) - len(text[at:].lstrip())
            if text[at : at + 1] == ",":
                at += 1
            elif text[at : at + 1] != end:
                raise _Malformed
    end = re.compile(r"[,\[\]{}]|:(?=\s|\Z|[,\[\]{}])").search(text, at)
    stop = end.start() if end else len(text)
    return _plain(text[at:stop].strip()), stop


def _scalar(text: str):
    """A value that stands on one line, with a comment behind it or not."""
    text = text.strip()
    if text[:1] in ("[", "{", '"', "'"):
        value, end = _flow(text, 0)
        rest = text[end:].strip()
        if rest and not (rest.startswith("#") and text[end].isspace()):
            raise _Malformed
        return value
    if text[:1] in ("&", "*", "!", "|", ">", "%", "@", "`", "]", "}", ","):
        raise _Malformed
    text = re.sub(r"(?:\A|\s)#.*\Z", "", text).strip()
    if re.search(r":(?:\s|\Z)", text):
        raise _Malformed
    return _plain(text)


def _block(lines: list[tuple[int, str]], at: int, indent: int):
    """The mapping or list whose lines have an indent, and the line behind it."""
    listed = lines[at][1] == "-" or lines[at][1].startswith("- ")
    out: list | dict = [] if listed else {}
    while at < len(lines) and lines[at][0] == indent:
        text = lines[at][1]
        if (text == "-" or text.startswith("- ")) != listed:
            if not listed:
                raise _Malformed
            break  # a list may stand at its key's indent
        name = None
        if listed:
            rest = text[1:].strip()
            inner = indent + len(text) - len(text[1:].lstrip()) if rest else indent
            if rest == "-" or rest.startswith("- ") or rest and rest[0] not in "[{" and _KEY.match(rest):
                lines[at] = (inner, rest)
                value, at = _block(lines, at, inner)
                out.append(value)
                continue
        else:
            m = _KEY.match(text)
            if not m:
                raise _Malformed
            name, rest = _scalar(m[1]), text[m.end() :].strip()
            name = m[1].strip() if not isinstance(name, str) else name
            if name in out:
                raise _Malformed
        at += 1
        if rest and not rest.startswith("#"):
            value = _scalar(rest)
            if at < len(lines) and lines[at][0] > indent:
                raise _Malformed
        elif at < len(lines) and (lines[at][0] > indent or not listed and lines[at][0] == indent and (lines[at][1] == "-" or lines[at][1].startswith("- "))):
            value, at = _block(lines, at, lines[at][0])
        else:
            value = None
        if listed:
            out.append(value)
        else:
            out[name] = value
    if at < len(lines) and lines[at][0] > indent:
        raise _Malformed
    return out, at


def to_json(header: str | None) -> str | None:
    """A header as JSON; None for one that is malformed, empty, or no mapping."""
    if not header:
        return None
    try:
        lines = []
        for line in header.split("\n"):
            line = line.rstrip()
            text = line.lstrip(" ")
            if text and not text.startswith("#"):
                if text.startswith("\t"):
                    raise _Malformed
                lines.append((len(line) - len(text), text))
        if not lines:
            return None
        value, end = _block(lines, 0, lines[0][0])
        if end != len(lines) or not isinstance(value, dict):
            return None
        return json.dumps(value, ensure_ascii=False, allow_nan=False)
    except (_Malformed, RecursionError, ValueError):
        return None


@F.pandas_udf(T.StringType())
def _json(headers: pd.Series) -> pd.Series:
    return headers.map(to_json)


def front(document: Column) -> Column:
    """The header of a document as VARIANT; null without one or if it is malformed."""
    return F.try_parse_json(_json(front_matter(document)))


def value(front: Column, path: str, kind: str = "string") -> Column:
    """A field by its path ('$.a.b[0]'); null where there is none or it is of another kind."""
    return F.try_variant_get(front, path, kind)
