"""Values of literals as languages write them."""

from __future__ import annotations

import re

MAX_EXACT = 1 << 53
# Numeric suffixes by language. Fixed values.
SUFFIXES = {
    "rust": r"(?:[iu](?:8|16|32|64|128|size)|f32|f64)",
    "c": r"(?:[uU]?[lL]{0,2}|[lL]{1,2}[uU]?|[fF])",
    "cpp": r"(?:[uU]?(?:ll|LL|[lLzZ])?|(?:ll|LL|[lLzZ])[uU]?|[fF])",
    "csharp": r"(?:[uU][lL]?|[lL][uU]?|[fFdDmM])",
    "kotlin": r"(?:[uU]?L?|[fF])",
    "java": r"[lLfFdD]",
    "typescript": r"n",
    "python": r"[jJ]",
    "gdscript": r"",
}
# Simple escapes shared by most languages. Fixed values.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "\\": "\\", "'": "'", '"': '"', "`": "`", "b": "\b", "f": "\f", "v": "\v", "a": "\a", "$": "$"}


def decode_number(text: str, language: str) -> float | None:
    """The value of a numeric literal; None where it is none, imaginary, or an integer beyond 2^53."""
    body = text.strip().replace("_", "").replace("'", "") if language in ("cpp", "c") else text.strip().replace("_", "")
    sign = -1 if body.startswith("-") else 1
    body = body.lstrip("+-")
    for head, base, digits in (("0x", 16, "0-9a-fA-F"), ("0b", 2, "01"), ("0o", 8, "0-7")):
        if body[:2].lower() == head:
            m = re.fullmatch(rf"([{digits}]+)(?:{SUFFIXES.get(language, '')})?", body[2:]) if base != 16 or language != "rust" else re.fullmatch(r"([0-9a-fA-F]+?)(?:[iu](?:8|16|32|64|128|size))?", body[2:])
            return _bounded(sign * int(m[1], base)) if m else None
    suffix = SUFFIXES.get(language, "")
    m = re.fullmatch(rf"((?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)({suffix})?", body) if suffix else re.fullmatch(r"((?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)()", body)
    if not m or (m[2] or "").lower() == "j":
        return None
    if m[1].isdigit():
        octal = language in ("c", "cpp") and len(m[1]) > 1 and m[1][0] == "0"
        if octal and set(m[1]) - set("01234567"):
            return None
        return _bounded(sign * int(m[1], 8 if octal else 10))
    value = sign * float(m[1])
    return value if abs(value) != float("inf") else None


def _bounded(n: int) -> float | None:
    return float(n) if abs(n) <= MAX_EXACT else None


def decode_string(body: str) -> str:
    """A string literal's inside with its escapes resolved; an unknown escape stands for its character."""

    def one(m: re.Match) -> str:
        s = m[1]
        if s[0] in "xuU" and len(s) > 1:
            code = int(s.strip("xuU{}"), 16)
            return chr(code) if code <= 0x10FFFF else "\ufffd"
        return ESCAPES.get(s, s)

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u\{[0-9a-fA-F]{1,6}\}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)", one, body, flags=re.S)
