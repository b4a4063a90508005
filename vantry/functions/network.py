"""IP address validity and canonical text, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import trimmed

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_G = r"[0-9a-fA-F]{1,4}"
_FULL = rf"({_G}:){{7}}{_G}"
_SHORT = rf"(({_G}(:{_G}){{0,6}})?)::(({_G}(:{_G}){{0,6}})?)"


def is_ipv4(c: Column) -> Column:
    """Dotted quad without leading zeros."""
    return c.rlike(f"^{_V4}$")


def _tail_to_hex(c: Column) -> Column:
    """Rewrite a dotted-quad tail of an IPv6 text as two hex groups."""
    pattern = r"^(.*:)(\d+)\.(\d+)\.(\d+)\.(\d+)$"
    part = [F.regexp_extract(c, pattern, i).try_cast("int") for i in range(2, 6)]
    tail = F.concat_ws(":", F.hex(part[0] * 256 + part[1]), F.hex(part[2] * 256 + part[3]))
    good = c.rlike(rf"^.*:{_V4}$")
    return F.when(good, F.concat(F.regexp_extract(c, pattern, 1), tail)).otherwise(c)


def _groups(c: Column) -> Column:
    return F.size(F.filter(F.split(c, ":"), lambda g: g != ""))


def is_ipv6(c: Column) -> Column:
    """Eight hex groups, or fewer around one ``::``; dotted tails allowed."""
    t = _tail_to_hex(c)
    return t.rlike(f"^{_FULL}$") | (t.rlike(f"^{_SHORT}$") & (_groups(t) <= 7))


def is_ip(c: Column) -> Column:
    """A valid address; the IPv6 test runs only on texts with a colon."""
    return F.when(F.contains(c, F.lit(":")), is_ipv6(c)).otherwise(is_ipv4(c))


def ip_status(t: Column) -> Column:
    """``missing`` / ``valid`` / ``invalid`` for a trimmed text."""
    return F.when(t.isNull(), "missing").when(is_ip(t), "valid").otherwise("invalid")


def ip_text(t: Column) -> Column:
    """The address as written, NULL when it is not an address."""
    return F.when(is_ip(t), t)


def _once(value: Column, then) -> Column:
    """``then`` of a value that is made once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def _canonical_v6(t: Column) -> Column:
    """Lower case without leading zeros, the longest zero run as ``::``; ``t`` is a valid IPv6 text."""
    empty = F.array().cast("array<string>")

    def side(parts: Column, i: int) -> Column:
        text = F.coalesce(F.get(parts, i), F.lit(""))
        return F.when(text == "", empty).otherwise(F.split(text, ":"))

    def fill(parts: Column) -> Column:
        left, right = side(parts, 0), side(parts, 1)
        gap = F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right))
        groups = F.transform(F.concat(left, gap, right), lambda g: F.regexp_replace(g, "^0+(?=.)", ""))
        return F.array_join(groups, ":")

    def squeeze(text: Column) -> Column:
        shortest = None
        for run in range(8, 1, -1):
            pattern = r"^(|.*?:)0(?::0){%d}(|:.*)$" % (run - 1)
            hit = text.rlike(pattern)
            value = F.regexp_replace(text, pattern, "$1:$2")
            shortest = F.when(hit, value) if shortest is None else shortest.when(hit, value)
        return shortest.otherwise(text)

    filled = _once(F.split(F.lower(_tail_to_hex(t)), "::", 2), fill)
    squeezed = _once(filled, squeeze)
    ends = F.regexp_replace(F.regexp_replace(squeezed, "^:(?!:)", "::"), "(?<!:):$", "::")
    return F.regexp_replace(ends, ":{3,}", "::")


def canonical_ip(t: Column) -> Column:
    """Canonical text of an address (already trimmed), NULL when invalid. Texts without a colon meet one test only."""
    return F.when(F.contains(t, F.lit(":")), F.when(is_ipv6(t), _canonical_v6(t))).otherwise(F.when(is_ipv4(t), t))


def with_canonical_ip(df: DataFrame, source: str, target: str) -> DataFrame:
    """Add the canonical text of an address column; the trim is a projection of its own, so it is made once."""
    return df.withColumn("_ip", trimmed(F.col(source))).withColumn(target, canonical_ip(F.col("_ip"))).drop("_ip")
