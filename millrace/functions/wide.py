"""Types that Spark lacks: UINT256 as 32 big-endian bytes (which sort right), TIME of day in seconds, ENUM labels, UUID text."""

from __future__ import annotations

import hashlib
import operator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.shared import ship

MOST = (1 << 256) - 1


def pack(value: int | None) -> bytes | None:
    if value is None:
        return None
    if not 0 <= value <= MOST:
        raise OverflowError("out of range for UINT256")
    return value.to_bytes(32, "big")


def unpack(raw: bytes | None) -> int | None:
    return None if raw is None else int.from_bytes(raw, "big")


def _divide(f):
    def run(a: int, b: int) -> int:
        if b == 0:
            raise ZeroDivisionError("UINT256 division by zero")
        return f(a, b)

    return run


_OPERATORS = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": _divide(operator.floordiv), "%": _divide(operator.mod)}


def u256(column: Column) -> Column:
    """From decimal text."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pack(int(t)), na_action="ignore")

    ship()
    return run(column)


def u256_text(column: Column) -> Column:
    @F.pandas_udf("string")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: str(unpack(bytes(b))), na_action="ignore")

    ship()
    return run(column)


def u256_op(sign: str, a: Column, b: Column) -> Column:
    """Checked + - * / %: leaving 0 .. 2^256 - 1 and dividing by zero are errors, NULL stays NULL."""
    f = _OPERATORS[sign]

    @F.pandas_udf("binary")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else pack(f(unpack(bytes(p)), unpack(bytes(q)))) for p, q in zip(x, y)])

    ship()
    return run(a, b)


def u256_sum(column: Column) -> Column:
    """A checked sum: limbs of 32 bits are summed by built-in aggregates, so it has partial sums, and then carried."""
    limbs = [F.sum(F.conv(F.hex(F.substring(column, 1 + 4 * i, 4)), 16, 10).cast("decimal(20,0)")) for i in range(8)]

    @F.pandas_udf("binary")
    def carry(parts: pd.DataFrame) -> pd.Series:
        rows = parts.itertuples(index=False)
        return pd.Series([None if r[0] is None else pack(sum(int(x) << 32 * (7 - i) for i, x in enumerate(r))) for r in rows])

    ship()
    return carry(F.struct(*[x.alias(f"l{i}") for i, x in enumerate(limbs)]))


def time_shift(seconds_of_day: Column, seconds: int) -> Column:
    """TIME plus an interval wraps at midnight."""
    return F.pmod(seconds_of_day + F.lit(seconds), F.lit(86400))


def enum_order(column: Column, labels: list[str]) -> Column:
    """The ordinal by which an ENUM sorts and compares; an unknown label is an error."""
    at = F.array_position(F.array(*[F.lit(x) for x in labels]), column)
    return F.when(at == 0, F.raise_error(F.concat(F.lit("unknown label "), column)).cast("bigint")).otherwise(at)


def uuid_text(column: Column) -> Column:
    """Canonical text; what is no UUID is an error."""
    low = F.lower(column)
    return F.when(low.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$") | low.isNull(), low).otherwise(F.raise_error(F.lit("invalid UUID")).cast("string"))


def generated_uuid(table: str, number: int) -> str:
    """The same for the same table and number."""
    h = hashlib.sha256(f"{table}:{number}".encode()).hexdigest()
    return f"{h[:8]}-{h[8:12]}-4{h[13:16]}-8{h[17:20]}-{h[20:32]}"


def average_decimal(column: Column, scale: int) -> Column:
    """AVG of a DECIMAL keeps the column's scale and truncates toward zero."""
    mean = F.avg(column)
    return F.when(mean >= 0, F.floor(mean, F.lit(scale))).otherwise(F.ceil(mean, F.lit(scale))).cast(f"decimal(18,{scale})")


def checked_date_trunc(unit: str, column: Column) -> Column:
    if unit.lower() not in ("year", "month", "day", "hour", "minute", "second"):
        raise ValueError(f"unknown unit {unit}")
    return F.date_trunc(unit, column).cast("timestamp_ntz")
