"""Clinical cells: text to numbers with censoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that mean "not there".
MISSING = ["", "/", "未查", "未检查", "无"]
# Words for sex and marker results.
MALE, FEMALE = ["男", "male", "m", "1"], ["女", "female", "f", "0"]
POSITIVE, NEGATIVE = ["阳性", "positive", "+", "1"], ["阴性", "negative", "-", "0"]
# Fixed value: the form that a number in a cell has, an optional bound before it.
NUMBER = r"^(<=|>=|<|>|≤|≥)?\s*([-+]?\d+(?:\.\d+)?)$"


def _missing(cell: Column) -> Column:
    return cell.isNull() | F.trim(cell).isin(MISSING)


def numeric(cell: Column) -> Column:
    """struct(value, censor, invalid): censor is -1 below, 1 above a bound; invalid keeps a cell that isn't a number."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.trim(cell), "，", ","), "岁", ""))
    sign, number = F.regexp_extract(text, NUMBER, 1), F.regexp_extract(text, NUMBER, 2)
    ok = ~_missing(cell) & (number != "")
    censor = F.when(ok & sign.isin("<", "<=", "≤"), -1).when(ok & sign.isin(">", ">=", "≥"), 1).otherwise(0)
    return F.struct(F.when(ok, number.try_cast("double")).alias("value"), censor.alias("censor"), F.when(~_missing(cell) & ~ok, F.trim(cell)).alias("invalid"))


def sex(cell: Column) -> Column:
    """1 male, 0 female, else null (a violation for the caller)."""
    text = F.lower(F.trim(cell))
    return F.when(text.isin(MALE), 1.0).when(text.isin(FEMALE), 0.0)


def marker(cell: Column) -> Column:
    """struct(value, invalid) of a positive/negative result."""
    text = F.lower(F.trim(cell))
    value = F.when(_missing(cell), F.lit(None).cast("double")).when(text.isin(POSITIVE), 1.0).when(text.isin(NEGATIVE), 0.0)
    return F.struct(value.alias("value"), F.when(~_missing(cell) & value.isNull(), F.trim(cell)).alias("invalid"))
