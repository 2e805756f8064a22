"""Text helpers as Column expressions; all of them stay on the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(key: Column | str, mapping: Mapping, default) -> Column:
    """Constant-dictionary lookup as a CASE cascade: no join, no shuffle, null key → default."""
    key, out = _col(key), None
    for k, v in mapping.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def contains_any(text: Column | str, words: Iterable[str]) -> Column:
    """Any literal occurs in lower(text); null text counts as no match."""
    low = F.lower(_col(text))
    hit = reduce(lambda a, b: a | b, [low.contains(w) for w in words], F.lit(False))
    return F.coalesce(hit, F.lit(False))


def ellipsis(text: Column | str, n: int) -> Column:
    """First n characters, dots always appended."""
    return F.concat(F.substring(_col(text), 1, n), F.lit("..."))


def ellipsis_if_longer(text: Column | str, n: int = 120) -> Column:
    text = _col(text)
    return F.when(F.char_length(text) > n, ellipsis(text, n)).otherwise(text)


def prefix_key(text: Column | str, n: int = 60) -> Column:
    """Key for texts that begin alike: first n characters, trimmed, lower case."""
    return F.lower(strip(F.substring(_col(text), 1, n)))


def strip(text: Column | str) -> Column:
    """Trim every kind of white space at both ends, not blanks only."""
    return F.btrim(_col(text), F.lit(" \t\n\r\f\x0b"))


def blank_to_null(text: Column | str) -> Column:
    text = _col(text)
    return F.when(strip(text) != "", text)


def hours_label(hours: Column | str) -> Column:
    return F.concat(_col(hours).cast("string"), F.lit(" hours"))


def percent_text(x: Column | str) -> Column:
    """0.874 → "87%"."""
    return F.concat(F.bround(_col(x) * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def padded_id(n: Column | str, prefix: str = "CMP", width: int = 4) -> Column:
    return F.format_string(f"{prefix}%0{width}d", _col(n).cast("bigint"))


def fill_template(template: str, **values: Column | str) -> Column:
    """Fill `{name}` slots of a constant template with columns."""
    parts, rest = [], template
    while "{" in rest:
        head, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        parts += [F.lit(head), _col(values[name]).cast("string")]
    return F.concat(*parts, F.lit(rest))


def short_timestamp(ts: Column | str) -> Column:
    """Display form of an ISO timestamp text: minutes, blank instead of T."""
    return F.replace(F.substring(_col(ts), 1, 16), F.lit("T"), F.lit(" "))


def short_date(ts: Column | str) -> Column:
    return F.substring(_col(ts), 1, 10)


def message_kind(sender: Column | str, type_: Column | str) -> Column:
    """auto_resolution by type, else system / customer by sender, else agent."""
    return (
        F.when(_col(type_) == "auto_resolution", "auto_resolution")
        .when(_col(sender) == "system", "system")
        .when(_col(sender) == "customer", "customer")
        .otherwise("agent")
    )


def message_body(message: Column | str, type_: Column | str) -> Column:
    """Auto-resolution messages lose their known prefix for display."""
    message = _col(message)
    return F.when(
        _col(type_) == "auto_resolution",
        F.replace(message, F.lit(S.AUTO_RESOLUTION_PREFIX), F.lit("")),
    ).otherwise(message)
