"""A strict JSON reader that keeps what Spark's loses: repeated keys, number lexemes, positions and the first error.

It is the slow path; rows that the two-wrapper test of tessera.functions.text settles never come here.
"""

from __future__ import annotations

import re

SPACE = re.compile(r"[ \t\n\r]*")
DIGITS = re.compile(r"[0-9]*")
PLAIN = re.compile(r'[^"\\\x00-\x1f]*')
ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
WORDS = {"true": "True", "false": "False", "null": "Null"}
# Codes of errors.
CODES = [
    "trailing_data", "invalid_utf8", "unexpected_end_of_input", "expected_scalar_json_value", "expected_object_key", "expected_colon_after_object_key",
    "expected_object_value_separator", "expected_array_element_separator", "invalid_json_literal", "leading_zero_not_allowed", "expected_digit",
    "expected_digit_after_decimal_point", "expected_digit_in_exponent", "unterminated_string", "unescaped_control_character_in_string",
    "unterminated_string_escape", "invalid_string_escape", "unpaired_high_surrogate", "invalid_low_surrogate", "unpaired_low_surrogate",
    "incomplete_unicode_escape", "invalid_unicode_escape_digit",
]


class Bad(ValueError):
    """An error with its code and its place, in characters from the start."""

    def __init__(self, code: str, at: int):
        super().__init__(code)
        self.code, self.at = code, at


def place(s: str, at: int) -> tuple[int, int, int]:
    """(bytes before, line from 1, column in bytes from 1) of a place in characters."""
    before = s[:at]
    start = before.rfind("\n") + 1
    return len(before.encode()), before.count("\n") + 1, len(before[start:].encode()) + 1


def hex_code(s: str, at: int) -> int:
    """The number of the four hexadecimal digits from ``at`` on."""
    if len(s[at : at + 4].encode()) < 4 and at + 4 > len(s):
        raise Bad("incomplete_unicode_escape", at)
    for k in range(at, at + 4):
        if s[k] not in "0123456789abcdefABCDEF":
            raise Bad("invalid_unicode_escape_digit", k)
    return int(s[at : at + 4], 16)


def string_end(s: str, at: int) -> tuple[int, str]:
    """(position after the closing quote, the decoded string) of the string whose quote is at ``at``."""
    out, k = [], at + 1
    while True:
        m = PLAIN.match(s, k)
        out.append(m.group())
        k = m.end()
        char = s[k : k + 1]
        if not char:
            raise Bad("unterminated_string", k)
        if char == '"':
            return k + 1, "".join(out)
        if char != "\\":
            raise Bad("unescaped_control_character_in_string", k)
        kind = s[k + 1 : k + 2]
        if not kind:
            raise Bad("unterminated_string_escape", k + 1)
        if kind in ESCAPES:
            out.append(ESCAPES[kind])
            k += 2
            continue
        if kind != "u":
            raise Bad("invalid_string_escape", k)
        code, end = hex_code(s, k + 2), k + 6
        if 0xDC00 <= code < 0xE000:
            raise Bad("unpaired_low_surrogate", k)
        if 0xD800 <= code < 0xDC00:
            if not s.startswith("\\u", end):
                raise Bad("unpaired_high_surrogate", end)
            low = hex_code(s, end + 2)
            if not 0xDC00 <= low < 0xE000:
                raise Bad("invalid_low_surrogate", end + 2)
            code, end = 0x10000 + ((code - 0xD800) << 10) + low - 0xDC00, end + 6
        out.append(chr(code))
        k = end


def number_end(s: str, at: int) -> int:
    """Where the number that begins at ``at`` ends; what follows is not its concern."""
    k = at + s.startswith("-", at)
    end = DIGITS.match(s, k).end()
    if end == k:
        raise Bad("expected_digit", k)
    if s[k] == "0" and end > k + 1:
        raise Bad("leading_zero_not_allowed", k + 1)
    k = end
    if s.startswith(".", k):
        end = DIGITS.match(s, k + 1).end()
        if end == k + 1:
            raise Bad("expected_digit_after_decimal_point", end)
        k = end
    if s[k : k + 1] in ("e", "E"):
        start = k + 1 + (s[k + 1 : k + 2] in ("+", "-"))
        k = DIGITS.match(s, start).end()
        if k == start:
            raise Bad("expected_digit_in_exponent", k)
    return k


def nodes(s: str) -> list[dict]:
    """The values in order, each with its parent, kind, key or index, which of its parent's equal keys, and span; Bad if invalid.

    An own stack stands for the nesting, so depth has no limit.
    """
    k = SPACE.match(s, 1 if s[:1] == "﻿" else 0).end()
    out: list[dict] = []
    stack: list[dict] = []

    def add(kind: str, start: int, key: str | None) -> dict:
        top = stack[-1] if stack else None
        node = {"kind": kind, "start": start, "end": start, "parent": top["id"] if top else None, "id": len(out), "key": key, "index": None, "occurrence": None, "n": 0, "value": None, "keys": {}, "key_span": (key_start, key_end)}
        if top is not None:
            if top["kind"] == "Array":
                node["index"] = top["n"]
            else:
                node["occurrence"] = top["keys"][key] = top["keys"].get(key, 0) + 1
            top["n"] += 1
        out.append(node)
        return node

    while True:
        key = key_start = key_end = None
        if stack and stack[-1]["kind"] == "Object":
            if s[k : k + 1] != '"':
                raise Bad("expected_object_key", k)
            key_start = k
            k, key = string_end(s, k)
            key_end = k
            k = SPACE.match(s, k).end()
            if s[k : k + 1] != ":":
                raise Bad("expected_colon_after_object_key", k)
            k = SPACE.match(s, k + 1).end()
        char = s[k : k + 1]
        opened = char in ("{", "[") and char != ""
        if opened:
            stack.append(add("Object" if char == "{" else "Array", k, key))
            k = SPACE.match(s, k + 1).end()
            if s[k : k + 1] not in ("}", "]"):
                continue
        elif char == '"':
            node = add("String", k, key)
            k, node["value"] = string_end(s, k)
            node["end"] = k
        elif char and char in "-0123456789":
            end = number_end(s, k)
            node = add("Number", k, key)
            k = node["end"] = end
        elif not char:
            raise Bad("unexpected_end_of_input", k)
        else:
            word = {"t": "true", "f": "false", "n": "null"}.get(char)
            if word is None or not s.startswith(word, k):
                raise Bad("expected_scalar_json_value" if word is None else "invalid_json_literal", k)
            node = add(WORDS[word], k, key)
            k = node["end"] = k + len(word)
        # After a value: closing brackets, then a comma or the end.
        while stack:
            k = SPACE.match(s, k).end()
            top, char = stack[-1], s[k : k + 1]
            if char == ("}" if top["kind"] == "Object" else "]"):
                k += 1
                top["end"] = k
                stack.pop()
            elif char == "," and not (opened and top["n"] == 0):
                k = SPACE.match(s, k + 1).end()
                break
            else:
                if opened and top["n"] == 0:  # just opened, so a first value or key is due
                    break
                raise Bad("expected_object_value_separator" if top["kind"] == "Object" else "expected_array_element_separator", k)
        if not stack:
            k = SPACE.match(s, k).end()
            if k < len(s):
                raise Bad("trailing_data", k)
            return out


def path_part(node: dict) -> str:
    """.key for simple names, else ["key"] or [index]; #n for the n-th of equal keys."""
    import json

    if node["index"] is not None:
        return f"[{node['index']}]"
    simple = re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]*", node["key"])
    return (f".{node['key']}" if simple else f"[{json.dumps(node['key'], ensure_ascii=False)}]") + (f"#{node['occurrence']}" if node["occurrence"] > 1 else "")


def pretty(s: str, indent: int = 2) -> str:
    """The value indented anew, with every lexeme as it was."""
    out, depth, k = [], 0, 0
    for node_text in re.findall(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+', s.lstrip("﻿")):
        out.append(node_text)
    text: list[str] = []
    for i, token in enumerate(out):
        last = out[i - 1] if i else ""
        if token in "}]" and len(token) == 1:
            depth -= 1
            text.append(token if last in ("{", "[") else "\n" + " " * (indent * depth) + token)
        else:
            text.append(("\n" + " " * (indent * depth) if last in ("{", "[", ",") else "") + (": " if token == ":" else token))
            depth += token in ("{", "[")
        k += 1
    return "".join(text)


def sorted_pretty(s: str, depth: int = 0) -> str:
    """The value indented anew with sorted keys, blanks around colons and numbers as %.17g prints them; of equal keys the last counts."""
    found = nodes(s)
    inner: dict[int, list[dict]] = {}
    for n in found[1:]:
        inner.setdefault(n["parent"], []).append(n)

    def quoted(text: str) -> str:
        import json

        return json.dumps(text, ensure_ascii=False).replace("/", "\\/")

    def shown(n: dict, depth: int) -> str:
        pad, own = "\n" + "  " * (depth + 1), inner.get(n["id"], [])
        if n["kind"] == "String":
            return quoted(n["value"])
        if n["kind"] == "Number":
            lexeme = s[n["start"] : n["end"]]
            if re.fullmatch(r"-?[0-9]+", lexeme):
                return "0" if lexeme == "-0" else lexeme
            return f"{float(lexeme):.17g}"
        if n["kind"] not in ("Object", "Array"):
            return n["kind"].lower()
        open_, close = "{}" if n["kind"] == "Object" else "[]"
        end = "\n" + "  " * depth + close
        if not own:
            return open_ + "\n" + end
        if n["kind"] == "Array":
            return open_ + pad + ("," + pad).join(shown(c, depth + 1) for c in own) + end
        last = {c["key"]: c for c in own}
        return open_ + pad + ("," + pad).join(f"{quoted(k)} : {shown(last[k], depth + 1)}" for k in sorted(last, key=lambda k: k.encode("utf-16-be"))) + end

    return shown(found[0], depth)


def key_ranges(s: str) -> dict[str, tuple[int, int]]:
    """Where each key of a root object is written (quotes included), in characters; of equal keys the last."""
    return {n["key"]: n["key_span"] for n in nodes(s)[1:] if n["parent"] == 0 and n["key"] is not None}
