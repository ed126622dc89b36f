"""Colours: hexadecimal and named values, WCAG relative luminance and contrast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The named highlight colours of word processing documents.
NAMED = {
    "black": "000000", "blue": "0000FF", "cyan": "00FFFF", "green": "00FF00", "magenta": "FF00FF", "red": "FF0000", "yellow": "FFFF00", "white": "FFFFFF",
    "darkblue": "000080", "darkcyan": "008080", "darkgreen": "008000", "darkmagenta": "800080", "darkred": "800000", "darkyellow": "808000", "darkgray": "808080", "lightgray": "C0C0C0",
}


def parse(c: Column) -> Column:
    """Six hexadecimal digits in capitals, or null for auto, none, null and anything else; names count."""
    t = F.upper(F.regexp_replace(F.trim(c), "^#", ""))
    names = F.create_map(*[F.lit(x) for k, v in NAMED.items() for x in (k.upper(), v)])
    return F.when(t.rlike("^[0-9A-F]{6}$"), t).otherwise(F.try_element_at(names, t))


def _channel(hexa: Column, k: int) -> Column:
    v = F.conv(F.substring(hexa, 2 * k + 1, 2), 16, 10).cast("double") / 255.0
    return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def luminance(hexa: Column) -> Column:
    """WCAG relative luminance of six hexadecimal digits; null for null."""
    return _channel(hexa, 0) * 0.2126 + _channel(hexa, 1) * 0.7152 + _channel(hexa, 2) * 0.0722


def contrast(a: Column, b: Column) -> Column:
    """WCAG contrast of two colours, from 1 to 21; null if either is null."""
    x, y = luminance(a), luminance(b)
    return F.when(x.isNotNull() & y.isNotNull(), (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05))
