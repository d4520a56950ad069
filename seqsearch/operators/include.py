"""Expressions that a match must include, before and after alignment.

Expressions are in ECMAScript syntax. They are counted as a search that goes on behind its last match: what is left counts as a text
of its own, so ``^`` and word borders refer to its beginning, and an expression that matches nothing at all is met any number
of times.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ECMAScript's names of character classes in brackets, and what Java has for them.
_NAMED = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s", "punct": r"\p{Punct}", "print": r"\p{Print}", "graph": r"\p{Graph}", "cntrl": r"\p{Cntrl}", "blank": r"\p{Blank}", "xdigit": r"\p{XDigit}", "d": r"\d", "w": r"\w", "s": r"\s"}
_TOKEN = re.compile(r"\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\c[A-Za-z]|\\[1-9][0-9]*|\\.|\[:\w+:\]|\(\?.|.", re.S)


def java_pattern(expression: str) -> str:
    """An ECMAScript expression in Java's syntax, with the same matches; ValueError for what ECMAScript doesn't have.

    Anchors become those of the whole text, brackets within brackets are literal, and named classes get Java's names. Groups
    other than plain ones, ``(?:``, ``(?=`` and ``(?!``, possessive quantifiers and escapes of other letters are errors.
    """
    out, inside, fresh, repeated = [], False, False, False
    for token in _TOKEN.findall(expression):
        kind = token[0]
        if kind == "\\":
            if len(token) == 1:
                raise ValueError(f"{expression}: ends with a backslash")
            if token[1].isalpha() and token[1] not in ("dDwWsSfnrtv" if inside else "bBdDwWsSfnrtv") and len(token) == 2 and not (inside and token[1] == "b"):
                raise ValueError(f"{expression}: no such escape {token}")
            made = {"\\v": r"\x0B", "\\0": r"\x00"}.get(token, r"\x08" if inside and token == "\\b" else token)
        elif inside and token.startswith("[:"):
            name = token[2:-2]
            if name not in _NAMED:
                raise ValueError(f"{expression}: no such class {token}")
            made = _NAMED[name]
        elif inside:
            inside = not (token == "]" and not fresh)
            made = token if token == "]" and not inside else "\\" + token if token in "[]&~" or (token == "^" and not fresh) else token
        elif token.startswith("(?"):
            if token[2] not in ":=!":
                raise ValueError(f"{expression}: no such group {token}")
            made = token
        elif len(token) > 1:  # "[:name:]" outside brackets is an ordinary set
            out.append(java_pattern(token[0] + token[1:-1] + "]"))
            repeated = False
            continue
        elif token == "[":
            inside, made = True, token
        else:
            if token == "+" and repeated:
                raise ValueError(f"{expression}: nothing to repeat before +")
            made = {"^": r"\A", "$": r"\z", "]": r"\]", "}": "}"}.get(token, token)
        fresh = inside and (token == "[" or (fresh and token == "^"))
        repeated = not inside and kind != "\\" and token in ("*", "+", "?", "}")
        out.append(made)
    if inside:
        raise ValueError(f"{expression}: a bracket isn't closed")
    return "".join(out)


def _free(expression: str) -> bool:
    """Whether matches don't depend on what stands before them and are never empty, so that they can be counted in one go."""
    if re.search(r"[\^$]|\\[bB]|\(\?[=!]", re.sub(r"\\[^bB]|\[\^", "", expression)):
        return False
    try:
        return re.fullmatch(re.sub(r"\[:\w+:\]", "A", expression), "") is None
    except re.error:
        return False


def count_matches(text: Column, expression: str, most: int) -> Column:
    """How often ``expression`` is found in ``text``, each search going on behind the last match; ``most`` at most. Null: null."""
    pattern = java_pattern(expression)
    if _free(expression):
        return F.when(text.isNotNull(), F.least(F.regexp_count(text, F.lit(pattern)), F.lit(most)))
    # what the first match ends with goes; the shortest way to a match is the one that a search finds first
    first = F.lit(r"\A(?s:.*?)(?:" + pattern + ")")

    def once(state: Column, _: Column) -> Column:
        found = state["found"] & F.rlike(state["rest"], first)
        return F.struct(F.when(found, F.regexp_replace(state["rest"], first, F.lit(""))).otherwise(state["rest"]).alias("rest"), found.alias("found"), (state["n"] + found.cast("int")).alias("n"))

    start = F.struct(text.alias("rest"), text.isNotNull().alias("found"), F.lit(0).alias("n"))
    return F.when(text.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, once, lambda s: s["n"]))


def includes(text: Column, conditions: tuple[tuple[str, int], ...]) -> Column:
    """Whether each expression occurs as often as asked. Null: null."""
    return reduce(lambda a, c: a & _occurs(text, *c), conditions, F.lit(True))


def _occurs(text: Column, expression: str, times: int) -> Column:
    if not _free(expression) or re.search(r"\\[1-9]", expression):  # a group would keep what an earlier match has put in it
        return count_matches(text, expression, times) >= times
    # one pass that ends with the last match asked for: each match is the first one behind the last, and is not given up again
    return F.rlike(text, F.lit(rf"\A(?>(?s:.*?)(?:{java_pattern(expression)})){{{times}}}"))


def before_alignment(text: Column) -> Column:
    """A subject's window as the filter before alignment sees it: an illegal residue is ``_`` there, and ``*`` afterwards."""
    return F.when(F.contains(text, F.lit("*")), F.translate(text, "*", "_")).otherwise(text)


def window(seq: str, diagonal: Column, q_len: str, band: int) -> Column:
    """The part of a subject that a band can reach: from ``diagonal - band - q_len`` to ``diagonal + band``, cropped."""
    begin = F.greatest(diagonal - band - F.col(q_len), F.lit(0)).cast("int")
    end = F.least(diagonal + band, F.length(seq)).cast("int")
    return F.substring(F.col(seq), begin + 1, F.greatest(end - begin, F.lit(0)))
