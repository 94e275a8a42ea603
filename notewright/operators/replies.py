"""A reader of almost-JSON as models write it: single quotes, bare keys, Python's literals, cut-off ends."""

from __future__ import annotations

import re

#: Containers inside each other beyond which a text is no reply.
MOST_DEPTH = 400
NUMBER = re.compile(r"-?\d+(\.\d*)?([eE][+-]?\d+)?")
LITERALS = {"true": True, "false": False, "null": None, "none": None, "nan": None}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _plain(token: str):
    """The value of an unquoted token."""
    if token.lower() in LITERALS:
        return LITERALS[token.lower()]
    if NUMBER.fullmatch(token):
        return float(token) if re.search(r"[.eE]", token) else int(token)
    return token


def _after(text: str, i: int) -> str:
    """The next character that is no white space, empty at the end."""
    m = re.compile(r"\S").search(text, i)
    return m.group() if m else ""


def _quoted(text: str, i: int, closers: str) -> tuple[str, int]:
    """(string, place behind it) of the string that opens at ``i``: a quote closes it if what follows can follow a string,
    so apostrophes and quoted words inside stay."""
    quote, out, i = text[i], [], i + 1
    while i < len(text):
        ch = text[i]
        if ch == "\\" and i + 1 < len(text):
            code = text[i + 2 : i + 6]
            if text[i + 1] == "u" and re.fullmatch(r"[0-9a-fA-F]{4}", code):
                out.append(chr(int(code, 16)))
                i += 6
            else:
                out.append(ESCAPES.get(text[i + 1], text[i + 1]))
                i += 2
            continue
        if ch == quote:
            follows = _after(text, i + 1)
            if not follows or follows in closers or (quote == '"' and follows == '"'):
                return "".join(out), i + 1
        out.append(ch)
        i += 1
    return "".join(out), i


def tolerant_json(text: str):
    """The object or list that starts at the first brace or bracket of ``text``, read in one pass; None without one.

    Commas may be too many, or missing behind a string or a container; a closer without its opener is skipped, one that closes an outer
    container closes the inner ones too, and the end of the text closes all. A key without a value is null.
    """
    start = re.search(r"[{\[]", text)
    if not start:
        return None
    root, stack, key = None, [], []
    i = start.start()
    while i < len(text):
        ch = text[i]
        if ch.isspace() or ch == ":":
            i += 1
        elif ch == ",":
            if isinstance(stack[-1], dict) and key[-1] is not None:
                stack[-1][key[-1]], key[-1] = None, None
            i += 1
        elif ch in "{[":
            box: dict | list = {} if ch == "{" else []
            if not stack:
                root = box
            elif isinstance(stack[-1], list):
                stack[-1].append(box)
            else:
                stack[-1]["" if key[-1] is None else key[-1]], key[-1] = box, None
            stack.append(box)
            key.append(None)
            if len(stack) > MOST_DEPTH:
                return None
            i += 1
        elif ch in "}]":
            kind = dict if ch == "}" else list
            if any(isinstance(b, kind) for b in stack):
                while True:
                    closed, left = stack.pop(), key.pop()
                    if left is not None:
                        closed[left] = None
                    if isinstance(closed, kind):
                        break
            i += 1
            if not stack:
                return root
        else:
            in_dict = isinstance(stack[-1], dict)
            naming = in_dict and key[-1] is None
            if ch in "\"'":
                value, i = _quoted(text, i, ":" if naming else ",}]")
            else:
                end = re.compile(r"[:{}\[\],\n]" if naming else r"[{}\[\],\n]").search(text, i)
                token = text[i : end.start() if end else len(text)]
                i += len(token)
                value = token.strip() if naming else _plain(token.strip())
            if naming:
                key[-1] = value
            elif in_dict:
                stack[-1][key[-1]], key[-1] = value, None
            else:
                stack[-1].append(value)
    while stack:
        closed, left = stack.pop(), key.pop()
        if left is not None:
            closed[left] = None
    return root
