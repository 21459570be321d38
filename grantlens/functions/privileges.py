"""Privilege sets as bit masks.

A set of privileges travels through shuffles as one integer and is turned back into rows only
at the end, so an object × role pair costs one shuffled row instead of up to twelve, and
``bit_or`` merges pairs on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlens.model import KINDS, PRIVILEGES

BIT = {code: 1 << i for i, (code, _) in enumerate(PRIVILEGES)}


def mask_of(codes: str | None) -> int:
    """Mask of a literal code string such as ``'rawd'``."""
    return sum(BIT[c] for c in set(codes or ""))


def code_mask(codes: Column) -> Column:
    """Mask of a column of code strings; unknown codes are ignored, NULL gives 0."""
    mask = F.lit(0)
    for code, bit in BIT.items():
        mask = mask.bitwiseOR(F.when(F.contains(codes, F.lit(code)), F.lit(bit)).otherwise(F.lit(0)))
    return mask


def mask_names(mask: Column) -> Column:
    """Array with the privilege name of each bit that is set, NULL elsewhere."""
    return F.array(
        *[
            F.when(mask.bitwiseAND(F.lit(BIT[code])) != 0, F.lit(name))
            for code, name in PRIVILEGES
        ]
    )


def explode_mask(df: DataFrame, mask: str, into: str = "privilege") -> DataFrame:
    """One row per privilege of ``mask``; the generator and the filter stay in codegen."""
    return (
        df.withColumn(into, F.explode(mask_names(F.col(mask))))
        .where(F.col(into).isNotNull())
        .drop(mask)
    )


def expand_privilege_codes(df: DataFrame, codes: str = "codes") -> DataFrame:
    """Replace a column of code strings by one row per privilege name."""
    return explode_mask(df.withColumn("_mask", code_mask(F.col(codes))), "_mask")


def privilege_list(mask: Column) -> Column:
    """Comma-separated names, for commands that grant several privileges at once."""
    return F.concat_ws(", ", mask_names(mask))


def by_kind(kind: Column, value_of, default=None) -> Column:
    """Value looked up from the kind of object, as one CASE expression."""
    groups: dict = {}
    for k in KINDS:
        groups.setdefault(value_of(k), []).append(k.code)
    expr = None
    for value, codes in groups.items():
        if value is None:
            continue
        test = kind.isin(*codes)
        expr = F.when(test, F.lit(value)) if expr is None else expr.when(test, F.lit(value))
    return expr if default is None else expr.otherwise(F.lit(default))


def expected_mask(kind: Column, function: str) -> Column:
    """Mask expected on a kind of object for 'owner', 'editor', 'reader' or 'public'."""
    return by_kind(kind, lambda k: mask_of(getattr(k, function)) or None, default=0)
