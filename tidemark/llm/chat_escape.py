"""Reversible escapes: no escaped text holds a mark of the chat format."""

from __future__ import annotations

import re

#: The format's marks start with one of these; a backslash before such a sign makes it ordinary.
SIGNS = "\\<"
_SIGN = re.compile(r"[\\<]")
_PAIR = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _SIGN.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _PAIR.sub(r"\1", text)
