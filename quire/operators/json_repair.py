"""What is left of JSON that breaks off: one pass over its tokens by an automaton that knows where the last whole value ended.

The automaton's place is what may come next (a value, a key, a colon, what follows a value) and the stack of open brackets.
Each bracket and each whole value is a point at which the text could be closed. Where the text ends inside a token, a key or
after a comma or colon, it is cut back to the last such point. A text that breaks the grammar before its end is not mended.
"""

from __future__ import annotations

import ast
import json
import re

_BLANK = re.compile(r"[ \t\n\r]*")
_TOKEN = re.compile(r'(?P<string>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<word>true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)|(?P<mark>[][{},:])')
#: A token that the end of the text cuts: an open string, a number that wants a digit, the start of a literal.
_CUT = re.compile(r'(?:"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*(?:\\(?:u[0-9a-fA-F]{0,3})?)?|-?(?:(?:0|[1-9]\d*)(?:\.\d*)?(?:[eE][-+]?)?)?|t(?:ru?)?|f(?:a(?:ls?)?)?|n(?:ul?)?)\Z')
_CLOSER = {"{": "}", "[": "]"}


def closed(text: str) -> str | None:
    """The longest part of the text, from its start, that open brackets' closers make JSON; None for what is no start of a list or record."""
    stack: list[str] = []
    wanted, at, safe = "value", 0, None
    while True:
        at = _BLANK.match(text, at).end()
        if at == len(text):
            break
        token = _TOKEN.match(text, at)
        if token is None or (token["word"] and _CUT.match(text, at) and token.end() < len(text)):
            if not _CUT.match(text, at):
                return None
            break
        kind, said = token.lastgroup, token.group()
        if wanted in ("value", "value or end") and kind != "mark":
            wanted = "more"
        elif wanted in ("value", "value or end") and said in _CLOSER:
            stack.append(_CLOSER[said])
            wanted = "key or end" if said == "{" else "value or end"
        elif wanted in ("key", "key or end") and kind == "string":
            wanted = "colon"
        elif wanted == "colon" and said == ":":
            wanted = "value"
        elif wanted == "more" and said == "," and stack:
            wanted = "key" if stack[-1] == "}" else "value"
        elif stack and said == stack[-1] and wanted in ("more", "key or end", "value or end"):
            stack.pop()
            wanted = "more"
        else:
            return None
        at = token.end()
        if wanted in ("more", "key or end", "value or end"):
            safe = at
    # Nothing has opened or closed a bracket since the last safe place, so the stack is the one that held there.
    return None if safe is None else text[:safe] + "".join(reversed(stack))


def repaired(text: str | None) -> str | None:
    """JSON from a text that breaks off, or from a record written with single quotes; None where it is neither."""
    if text is None:
        return None
    whole = closed(text)
    if whole is not None and whole.lstrip()[:1] in _CLOSER:
        try:
            return json.dumps(json.loads(whole), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None
    try:
        found = ast.literal_eval(text)
        return json.dumps(found, ensure_ascii=False) if isinstance(found, dict) else None
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None
