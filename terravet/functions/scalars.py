"""Scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap_int32(x: Column) -> Column:
    """The 32-bit two's complement value of a long."""
    return F.pmod(x + F.lit(2147483648), F.lit(4294967296)) - F.lit(2147483648)


def pick_language(texts: Column, locale: str) -> Column:
    """The text in this language, else in English, else the first."""
    return F.coalesce(texts[F.lit(locale)], texts[F.lit("en")], F.get(F.map_values(texts), F.lit(0)))


def centre(low: Column, high: Column) -> Column:
    return (low + high) / 2


def sequence_path(n: Column) -> Column:
    """AAA/BBB/CCC.osc.gz of a sequence number."""
    digits = F.lpad(n.cast("string"), 9, "0")
    return F.concat(F.substring(digits, 1, 3), F.lit("/"), F.substring(digits, 4, 3), F.lit("/"), F.substring(digits, 7, 3), F.lit(".osc.gz"))


def refresh_after(created: Column, updated: Column) -> Column:
    """Seconds to wait after `updated` before a changeset is fetched again: 6 hours, doubled as it ages."""
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(updated.cast("timestamp")) - F.unix_timestamp(created.cast("timestamp"))) / F.lit(21600.0))
    return F.lit(21600.0) * F.pow(F.lit(2.0), F.floor(F.log2(age + 1)))


def signature(objtype: Column, id_: Column, version: Column, deleted: Column) -> Column:
    return F.concat_ws("|", objtype, id_.cast("string"), version.cast("string"), deleted.cast("string"))


def url_escape(x: Column) -> Column:
    return F.url_encode(x)


def batch_number(rank: Column, size: int = 100_000) -> Column:
    return F.floor(rank / size)
