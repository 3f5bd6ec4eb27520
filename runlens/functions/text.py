"""Text helpers over built-in string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "```"
# Python's whitespace for str.strip(): every code point with str.isspace()
# (29 characters, U+3000 among them), derived from the rule, not listed.
PY_WHITESPACE = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_unicode(c) -> Column:
    """``str.strip()`` -- remove Python-whitespace characters from both
    ends (U+3000 included; plain ``trim`` only strips spaces).  ``btrim``
    with the character set: no regex."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))


def strip_code_fence(c) -> Column:
    """Text opening with a code fence loses its first line, and its last
    line too when that starts with a fence.  A one-line fenced text is empty."""
    x = _c(c)
    lines = F.split(x, "\n")
    drop_last = F.element_at(lines, -1).startswith(FENCE)
    n = F.size(lines)
    kept = F.when(drop_last, F.slice(lines, 2, F.greatest(n - 2, F.lit(0)))).otherwise(
        F.slice(lines, 2, F.greatest(n - 1, F.lit(0))))
    return F.when(x.startswith(FENCE), F.array_join(kept, "\n")).otherwise(x)


def outer_span(c, open_ch: str, close_ch: str) -> Column:
    """From the first ``open_ch`` to the last ``close_ch`` after it (the greedy
    regex ``\\{[\\s\\S]*\\}``), or ``''`` when there is none.  Position
    arithmetic instead of a regex (``substring_index`` searches from the end)."""
    x = _c(c)
    i = F.instr(x, open_ch)
    after_last = F.length(F.substring_index(x, close_ch, -1))   # chars after the last close
    j = F.length(x) - after_last                                 # position of the last close
    found = (i > 0) & (F.instr(x, close_ch) > 0) & (j > i)
    return F.when(found, F.substring(x, i, j - i + 1)).otherwise(F.lit(""))


def json_span(c) -> Column:
    """The array span when the text starts with ``[``, else the object span."""
    x = _c(c)
    return F.when(x.startswith("["), outer_span(x, "[", "]")).otherwise(outer_span(x, "{", "}"))


def prompt_text(system, user) -> Column:
    """``strip(system + "\\n" + user)`` -- the newline is always there,
    a NULL part counts as empty."""
    return trim_unicode(F.concat(F.coalesce(_c(system), F.lit("")), F.lit("\n"),
                                 F.coalesce(_c(user), F.lit(""))))


def chat_messages(system, user) -> Column:
    """The message list -- a system entry only when the system text is
    non-empty, then the user entry."""
    sys_msg = F.struct(F.lit("system").alias("role"), F.coalesce(_c(system), F.lit("")).alias("content"))
    usr_msg = F.struct(F.lit("user").alias("role"), F.coalesce(_c(user), F.lit("")).alias("content"))
    return F.filter(F.array(sys_msg, usr_msg),
                    lambda m: (m["role"] == "user") | (F.length(m["content"]) > 0))


def hex_addresses(c) -> Column:
    """Distinct hexadecimal addresses (``0x...``) named in a text."""
    return F.array_distinct(F.regexp_extract_all(_c(c), F.lit(r"(0x[0-9A-Fa-f]+)"), 1))
