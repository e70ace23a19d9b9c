"""JSON values with their number literals kept, their digests and their equality keys.

Nothing here recurses in Python, so that no depth of nesting and no literal can stop a job.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from json.decoder import scanstring
from json.encoder import encode_basestring
from typing import Any, NamedTuple

#: Levels of nesting that a text may have.
MAX_DEPTH = 10_000


class Number(str):
    """A number as it was written: 1, 1.0 and 1.00 are three values."""

    __slots__ = ()


def _refuse(word: str):
    raise ValueError(f"{word} isn't JSON")


_DECODER = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_refuse)
_SPACE, _BLANK = re.compile(r"[ \t\n\r]*"), frozenset(" \t\n\r")
_OPENS, _CLOSES = re.compile(r"\[+"), re.compile(r"\]+")
_WORD = re.compile(r"(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|true|false|null")
_WORDS = {"true": True, "false": False, "null": None}
_ESCAPE = re.compile(r"\\(?:u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|(u[dD][89a-fA-F][0-9a-fA-F]{2})|.)", re.DOTALL)


def _mended(text: str) -> str:
    """Escapes of lone surrogates, which no UTF-8 text can hold, become U+FFFD's."""
    if "\\ud" not in text and "\\uD" not in text:
        return text
    return _ESCAPE.sub(lambda m: "\\ufffd" if m[1] else m[0], text)


def _scan(text: str, at: int) -> tuple[Any, int]:
    """``raw_decode`` with a stack of its own: (value, end)."""
    stack: list[tuple[Any, Any]] = []  # containers, with the key under which the next value goes
    while True:
        c = text[at : at + 1]
        if c in _BLANK:
            at = _SPACE.match(text, at).end()
            c = text[at : at + 1]
        if c == "[" or c == "{":
            many = _OPENS.match(text, at).end() - at if c == "[" else 1
            if len(stack) + many > MAX_DEPTH:
                raise ValueError("nested too deeply")
            box, at = ({} if c == "{" else []), at + many
            if many > 1:
                stack.extend([([], None) for _ in range(many - 1)])
            if text[at : at + 1] in _BLANK:
                at = _SPACE.match(text, at).end()
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                key, at = _key(text, at) if c == "{" else (None, at)
                stack.append((box, key))
                continue
            value, at = box, at + 1
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        else:
            found = _WORD.match(text, at)
            if not found:
                raise ValueError(f"no value at {at}")
            value, at = Number(found[0]) if found[1] else _WORDS[found[0]], found.end()
        while stack:  # the value goes into its container, which may be whole then
            box, key = stack.pop()
            if key is None:
                box.append(value)
            else:
                box[key] = value
            if text[at : at + 1] in _BLANK:
                at = _SPACE.match(text, at).end()
            c, at = text[at : at + 1], at + 1
            if c == "]" and key is None:
                value = box
                continue
            if c == ",":
                key, at = _key(text, at) if key is not None else (None, at)
                stack.append((box, key))
                break
            if c != ("]" if key is None else "}"):
                raise ValueError(f"no end of a container at {at}")
            value = box
        else:
            return value, at


def _skip(text: str, at: int) -> int:
    """The end of a value as ``_scan`` finds it, without the value: brackets in a row are one step."""
    stack, depth = [], 0  # 0 for an object, else the number of arrays begun in a row
    while True:
        at = _SPACE.match(text, at).end()
        c = text[at : at + 1]
        if c == "[" or c == "{":
            many = _OPENS.match(text, at).end() - at if c == "[" else 1
            depth += many
            if depth > MAX_DEPTH:
                raise ValueError("nested too deeply")
            at = _SPACE.match(text, at + many).end()
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                at = _key(text, at)[1] if c == "{" else at
                stack.append(0 if c == "{" else many)
                continue
            depth, at = depth - 1, at + 1
            if many > 1:
                stack.append(many - 1)
        elif c == '"':
            at = scanstring(text, at + 1, True)[1]
        else:
            found = _WORD.match(text, at)
            if not found:
                raise ValueError(f"no value at {at}")
            at = found.end()
        while stack:
            at = _SPACE.match(text, at).end()
            c, arrays = text[at : at + 1], stack[-1]
            if c == ",":
                at = at + 1 if arrays else _key(text, at + 1)[1]
                break
            if c != ("]" if arrays else "}"):
                raise ValueError(f"no end of a container at {at}")
            many = min(arrays, _CLOSES.match(text, at).end() - at) if arrays else 1
            depth, at = depth - many, at + many
            if many < arrays:
                stack[-1] -= many
            else:
                stack.pop()
        else:
            return at


def _key(text: str, at: int) -> tuple[str, int]:
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != '"':
        raise ValueError(f"no key at {at}")
    key, at = scanstring(text, at + 1, True)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(f"no colon at {at}")
    return key, at + 1


def _deep(text: str) -> bool:
    """Whether a text may nest too deeply for what recurses."""
    return text.count("[") + text.count("{") >= 500


def _reader(text: str):
    """What reads (value, end) at a place of a text; where it may nest deeply, with a stack of its own."""
    return _scan if _deep(text) else _DECODER.raw_decode


def decode(text: str, first_only: bool = False) -> Any:
    """A JSON text, or its first value alone. Of repeated keys the last counts."""
    text = _mended(text)
    value, end = _reader(text)(text, _SPACE.match(text).end())
    if not first_only and _SPACE.match(text, end).end() != len(text):
        raise ValueError("more than one JSON value")
    return value


def members(text: str) -> dict[str, tuple[int, int]]:
    """Where the values of the first JSON object of a text lie, by key: its numbers stay as written."""
    at = _SPACE.match(text).end()
    if text[at : at + 1] != "{":
        raise ValueError("not an object")
    at, found = _SPACE.match(text, at + 1).end(), {}
    if text[at : at + 1] == "}":
        return found
    end_of = _skip if _deep(text) else lambda text, at: _DECODER.raw_decode(text, at)[1]
    while True:
        key, at = _key(text, at)
        start = _SPACE.match(text, at).end()
        end = end_of(text, start)
        found[key] = start, end
        at = _SPACE.match(text, end).end()
        c, at = text[at : at + 1], at + 1
        if c == "}":
            return found
        if c != ",":
            raise ValueError(f"no end of an object at {at}")


_KINDS = {type(None): "null", bool: "bool", Number: "number", str: "string", list: "array", dict: "object"}


def type_of(value: Any) -> str:
    return _KINDS[type(value)]


_NUMBER = re.compile(r"(-?)0*([0-9]*)(?:\.([0-9]*))?(?:[eE]([+-]?[0-9]+))?")


def number_key(literal: str) -> str | None:
    """Equal for literals of equal numbers; None for what isn't a JSON number. An exponent of
    thousands of digits, which no number type holds, is left as it is written."""
    if literal.isascii() and literal.isdigit() and literal[0] != "0":
        bare = literal.rstrip("0")
        return f"{bare}e{len(literal) - len(bare)}"
    if not _WORD.fullmatch(literal) or literal in _WORDS:
        return None
    sign, whole, part, exponent = _NUMBER.fullmatch(literal).groups()
    digits = (whole + (part or "")).lstrip("0")
    bare = digits.rstrip("0")
    if not bare:
        return "0"
    if exponent and len(exponent) > 4000:
        return f"{sign}{bare}.{len(digits) - len(bare) - len(part or '')}e{exponent}"
    return f"{sign}{bare}e{int(exponent or 0) - len(part or '') + len(digits) - len(bare)}"


class Measured(NamedTuple):
    """``text``: compact JSON, keys in order, number literals as written. ``digest``: SHA-256 of the
    typed, length-prefixed value, durable equality. ``key``: equal for values that are equal as
    numbers, whatever their literals, volatile equality; None where a number isn't JSON's."""

    text: str
    digest: bytes
    key: str | None


def _number(literal: str) -> tuple[str, bytes, str | None]:
    """(text, what is hashed, equality key)."""
    literal = str(literal)
    data = literal.encode()
    return literal, b"#" + len(data).to_bytes(8, "big") + data, number_key(literal)


def _string(value: str) -> tuple[str, bytes, str]:
    data, text = value.encode(), encode_basestring(value)
    return text, b"s" + len(data).to_bytes(8, "big") + data, text


_SCALARS = {Number: _number, str: _string}
_CONSTANTS = {True: ("true", b"b\x01", "true"), False: ("false", b"b\x00", "false"), None: ("null", b"n", "null")}
_CONSTANTS_MEASURED = {x: Measured(text, hashlib.sha256(data).digest(), key) for x, (text, data, key) in _CONSTANTS.items()}


def _whole(scalar):
    """``measured`` of one kind of scalars. A fleet's snapshots repeat each other, so short ones are kept."""

    def one(value: str) -> Measured:
        text, data, key = scalar(value)
        return Measured(text, hashlib.sha256(data).digest(), key)

    return one, lru_cache(1 << 16)(one)


_MEASURED = {kind: _whole(scalar) for kind, scalar in _SCALARS.items()}


def measured(value: Any) -> Measured:
    """Text, digest and key of a value in one walk."""
    kind = type(value)
    if kind in _MEASURED:
        return _MEASURED[kind][len(value) < 128](value)
    if kind not in (list, dict):
        return _CONSTANTS_MEASURED[value]
    texts, parts, keys, todo = [], [], [], [value]
    while todo:
        x = todo.pop()
        kind = type(x)
        if kind is tuple:  # between values: text, and what is hashed
            texts.append(x[0])
            keys.append(x[0])
            parts.append(x[1])
        elif kind is list:
            texts.append("[")
            keys.append("[")
            parts.append(b"[" + len(x).to_bytes(8, "big"))
            todo.append(("]", b""))
            for i in range(len(x) - 1, -1, -1):
                todo.append(x[i])
                if i:
                    todo.append((",", b""))
        elif kind is dict:
            texts.append("{")
            keys.append("{")
            parts.append(b"{" + len(x).to_bytes(8, "big"))
            todo.append(("}", b""))
            names = sorted(x)  # by code point, which is by byte of UTF-8
            for i in range(len(names) - 1, -1, -1):
                name = names[i].encode()
                todo.append(x[names[i]])
                todo.append((("," if i else "") + encode_basestring(names[i]) + ":", b"k" + len(name).to_bytes(8, "big") + name))
        else:
            text, data, key = _SCALARS[kind](x) if kind in _SCALARS else _CONSTANTS[x]
            texts.append(text)
            keys.append(key)
            parts.append(data)
    return Measured("".join(texts), hashlib.sha256(b"".join(parts)).digest(), None if None in keys else "".join(keys))


def encode(value: Any) -> str:
    return measured(value).text


def wire_size(encoded: str) -> int:
    """Bytes of the value as the wire form has it, which escapes five characters to six bytes."""
    plain = len(encoded) if encoded.isascii() else len(encoded.encode()) + 3 * (encoded.count("\u2028") + encoded.count("\u2029"))
    return plain + 5 * (encoded.count("<") + encoded.count(">") + encoded.count("&"))


def value_hash(value: Any) -> bytes:
    return measured(value).digest


def equality_key(value: Any) -> str:
    key = measured(value).key
    if key is None:
        raise ValueError(f"{value} isn't a JSON number")
    return key
