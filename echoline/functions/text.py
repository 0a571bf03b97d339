"""Text expressions that keep to code points, so results do not depend on a locale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Unicode White_Space property, as a class of a regular expression (fixed values).
WHITE_SPACE = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip_blank(text: Column) -> Column:
    """text without white space at both ends; Spark's trim takes U+0020 only."""
    return F.regexp_replace(text, rf"^{WHITE_SPACE}+|{WHITE_SPACE}+$", "")
