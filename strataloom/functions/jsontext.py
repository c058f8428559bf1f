"""Reading JSON that was wrapped, encoded twice or fenced on its way here."""

from __future__ import annotations

import json
import re

_FENCE = re.compile(r"^\s*```[A-Za-z0-9_-]*\s*\n?(.*?)\n?\s*```\s*$", re.S)
#: How often a JSON text may hold another JSON text as its only value.
MAX_WRAPS = 8


def read_json(text):
    """The value of a JSON text, or None where it cannot be read.

    A string that again holds JSON is read again, a fenced block is unwrapped,
    a byte order mark is dropped. Too deep a nesting counts as unreadable.
    """
    value = text
    for _ in range(MAX_WRAPS):
        if not isinstance(value, str):
            return value
        body = value.lstrip("﻿").strip()
        if not body:
            return None
        try:
            value = json.loads(body)
        except (ValueError, RecursionError):
            fenced = _FENCE.match(body)
            if not fenced:
                return None
            value = fenced.group(1)
    return None if isinstance(value, str) else value


def elements(value):
    """(key or None, element) of a list, or of a map from id to element."""
    if isinstance(value, list):
        return [(None, x) for x in value]
    if isinstance(value, dict):
        return list(value.items())
    if isinstance(value, str):
        return elements(read_json(value))
    return []


def id_text(value):
    """An id as text: integers as written, no booleans, nothing for other kinds."""
    if isinstance(value, str):
        return value
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() else repr(value)
    return None
