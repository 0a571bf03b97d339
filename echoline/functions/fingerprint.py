"""Content digests of groups. The domain strings carry the tool's name, which the caller may set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name in the domains and prefixes; set it to the name of the tool whose reports are compared.
TOOL = "echoline"


def _hex32(number: Column) -> Column:
    return F.lpad(F.hex(number.cast("bigint")), 8, "0")


def _framed(lines: Column) -> Column:
    """Each line after its length in bytes, as hexadecimal text."""
    return F.array_join(F.transform(lines, lambda x: F.concat(_hex32(F.octet_length(x)), F.hex(F.encode(x, "UTF-8")))), "")


def _digest(domain: str, *parts: Column) -> Column:
    return F.sha2(F.unhex(F.concat(F.lit((domain.encode() + b"\0").hex()), *parts)), 256)


def finding_fingerprint(lines: Column, effective: Column, length: Column, tool: str = TOOL) -> Column:
    """SHA-256 over domain, effective and normalized length, and every line with its length."""
    return F.concat(F.lit(f"{tool}-finding-v1:sha256:"), _digest(f"{tool}-finding-v1", _hex32(effective), _hex32(length), _framed(lines)))


def baseline_fingerprint(lines: Column, effective: Column, tool: str = TOOL) -> Column:
    """As above without the normalized length, in the domain of accepted groups."""
    return F.concat(F.lit("sha256:"), _digest(f"{tool}-baseline-group-v1", _hex32(effective), _framed(lines)))


def is_baseline_fingerprint(text: Column) -> Column:
    return F.coalesce(text.rlike("^sha256:[0-9a-f]{64}$"), F.lit(False))
