"""LaTeX spans rewritten to plain notation, and Unicode forms: what column expressions can't say."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Macros and their characters.
MACROS = {
    "mu": "u", "times": "×", "cdot": "·", "pm": "±", "approx": "≈", "sim": "~", "to": "→", "rightarrow": "→", "leftrightarrow": "↔", "circ": "°", "degree": "°",
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "eta": "η", "theta": "θ", "lambda": "λ", "nu": "ν", "%": "%",
}
#: Delimiters of math: opening, closing, whether a span may go over lines, whether it always is math.
DELIMITERS = (("\\(", "\\)", False, True), ("\\[", "\\]", True, True), ("$", "$", False, False))
BLANKS = " \t"


def expand(text: str) -> str:
    """Math spans as plain text: scripts bound to their base, dollars only where they hold math."""
    for opening, closing, long, sure in DELIMITERS:
        if opening in text:
            text = "".join(_rewritten(text, opening, closing, long, sure))
    return text


def _rewritten(text: str, opening: str, closing: str, long: bool, sure: bool) -> Iterator[str]:
    """The text piece by piece, its spans between two delimiters in plain notation."""
    done = at = 0  # what went out, and where the next span is sought
    while (start := text.find(opening, at)) >= 0:
        inner = start + len(opening)
        stop = text.find(closing, inner if opening == closing else inner + 1)
        if stop < 0:
            break
        body = text[inner:stop]
        if not body or not long and "\n" in body:
            at = inner
            continue
        end = stop + len(closing)
        left = start
        while left > done and text[left - 1] in BLANKS:
            left -= 1
        right = end
        while right < len(text) and text[right] in BLANKS:
            right += 1
        yield text[done:left]
        if not any(c in "_^\\" for c in body):
            yield text[left:start] + body.strip() + text[end:right] if sure else text[left:right]
        else:
            hangs = body.strip()[:1] in ("_", "^")  # a script belongs to what stands before it
            joined = hangs and left < start and right > end and _goes_on(text[right : right + 2])
            yield ("" if hangs else text[left:start]) + plain(body) + ("" if joined else text[end:right])
        done = at = right
    yield text[done:]


def _goes_on(ahead: str) -> bool:
    """Whether a formula continues: with a number, or a capital that begins no word."""
    return ahead[:1].isdigit() or "A" <= ahead[:1] <= "Z" and not "a" <= ahead[1:2] <= "z"


def plain(body: str) -> str:
    """What stands between math delimiters, read once from left to right."""
    out: list[str] = []
    at = 0
    while at < len(body):
        c = body[at]
        at += 1
        if c == "\\":
            end = at
            while end < len(body) and body[end].isascii() and body[end].isalpha():
                end += 1
            end = end if end > at else at + 1 if body[at : at + 1] == "%" else at
            name, at = body[at:end], end
            out.append(MACROS.get(name, c + name))
        elif c in "_^":
            close = body.find("}", at) if body[at : at + 1] == "{" else -1
            follows = body[at : at + 1]
            out.append("^" if c == "^" else "" if close > 0 or follows.strip() else c)
            if close > 0:
                out.append(_named(body[at + 1 : close]))
                at = close + 1
            elif follows.strip() and follows not in "\\{":
                out.append(follows)
                at += 1
        elif c not in "{}":
            out.append(c)
    return "".join(out).replace("{", "").replace("}", "").strip()


def _named(text: str) -> str:
    return re.sub(r"\\([a-zA-Z]+|%)", lambda m: MACROS.get(m[1], m[0]), text)


def _expand(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else expand(t))


def expanded(c: Column) -> Column:
    """``c`` with its math spans expanded; only texts with a delimiter leave the JVM."""
    marked = F.when(c.rlike(r"\$|\\\(|\\\["), c)
    return F.coalesce(F.pandas_udf(_expand, "string")(marked), c)


def _ascii(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", html.unescape(t)))


def ascii_form(c: Column) -> Column:
    """Letters without their marks, what then isn't ASCII dropped."""
    return F.pandas_udf(_ascii, "string")(c)


def compatible(c: Column) -> Column:
    """HTML entities resolved, compatibility characters replaced."""
    return F.pandas_udf(_compatible, "string")(c)
