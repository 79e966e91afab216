"""SQL texts that read JSON documents through the variant type.

These expressions nest deeply and sit inside lambdas; as SQL text each output column is parsed in one step.
"""

from __future__ import annotations

import json

# Kinds of a JSON value, told from the first character of its text; a number has the empty kind.
OBJECT, ARRAY, STRING, BOOLEAN, NULL, NUMBER = "o", "a", "s", "b", "z", ""


def literal(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(column: str) -> str:
    """Quoted column name."""
    return "`" + column.replace("`", "``") + "`"


def document(text: str) -> str:
    return f"try_parse_json({text})"


def json_path(path: str) -> str:
    """``a.b[0].c`` as a variant path; names with unusual characters are quoted."""
    out = "$"
    for part in filter(None, path.split(".")):
        word, *indexes = part.replace("]", "").split("[")
        if word:
            plain = word.replace("_", "a").isalnum() and word.isascii()
            out += f".{word}" if plain else "['" + word.replace("'", "\\'") + "']"
        out += "".join(f"[{int(i)}]" for i in indexes)
    return out


def at(doc: str, path: str, kind: str = "variant") -> str:
    """Value at a dotted, indexed path; null when the path is missing or of another type."""
    return f"try_variant_get({doc}, {literal(json_path(path))}, '{kind}')"


def member(doc: str, path: str) -> str:
    """Value under dotted object keys, taken literally: ``a[0]`` is a key. Null when one is missing."""
    parts = path.split(".")
    if not all(parts):
        return "CAST(NULL AS VARIANT)"
    steps = "".join("[\"" + p + "\"]" if "'" in p else f"['{p}']" for p in parts)
    return f"try_variant_get({doc}, {literal('$' + steps)}, 'variant')"


def members(doc: str, path: str = "") -> str:
    """List at a path as an array, null when the value is missing or no list."""
    return at(doc, path, "array<variant>")


def words(value: str) -> str:
    """Scalar as text, object and array as JSON text."""
    return f"coalesce({at(value, '', 'string')}, to_json({value}))"


def kind(value: str) -> str:
    return f"translate(substr(to_json({value}), 1, 1), '{{[\"tfn0123456789-', 'oasbbz')"


def filled(value: str) -> str:
    """False for missing, null, empty text, empty list and empty object."""
    return f"coalesce(to_json({value}) NOT IN ('null', '\"\"', '[]', '{{}}'), false)"


def filled_object(value: str) -> str:
    return f"coalesce(to_json({value}) LIKE '{{\"%', false)"


def when_filled(value: str) -> str:
    return f"if({filled(value)}, {value}, NULL)"


def filled_text(doc: str, path: str) -> str:
    """Text at a path, null when it is empty."""
    return f"nullif({at(doc, path, 'string')}, '')"


def equals(value: str, expected: object) -> str:
    """Equality with a Python value; numbers compare by value (true is 1), everything else by its JSON text."""
    if isinstance(expected, (bool, int, float)):
        number = f"coalesce({at(value, '', 'double')}, CAST({at(value, '', 'boolean')} AS DOUBLE))"
        hit = f"{kind(value)} IN ('', 'b') AND {number} = CAST({float(expected)!r} AS DOUBLE)"
    elif expected is None:
        return f"coalesce(to_json({value}) = 'null', true)"
    else:
        text = literal(json.dumps(expected, ensure_ascii=False, separators=(",", ":")))
        hit = f"to_json({value}) = to_json(parse_json({text}))"
    return f"coalesce({hit}, false)"
