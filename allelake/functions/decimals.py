"""Numbers in decimal notation: exact tests and one spelling per value."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal notation: sign, digits with or without a fraction, exponent.
DECIMAL = r"^([+-]?)([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]+))?$"


def is_decimal(c: Column) -> Column:
    """Whether a string is a number in decimal notation. Null gives null; the empty string and a lone point or sign give false."""
    return c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")


def _parts(c: Column) -> tuple[Column, Column, Column]:
    digits = F.concat(F.regexp_extract(c, DECIMAL, 2), F.regexp_extract(c, DECIMAL, 3))
    exponent = F.coalesce(F.regexp_extract(c, DECIMAL, 4).try_cast("bigint"), F.when(F.regexp_extract(c, DECIMAL, 4) == "", 0))
    return digits, F.length(F.regexp_extract(c, DECIMAL, 3)), exponent


def is_whole(c: Column) -> Column:
    """Whether a string is a whole number in decimal notation, judged on its digits: ``2.50e1`` is, ``2.5`` isn't. Exponents beyond 64 bits give false."""
    digits, fraction, exponent = _parts(c)
    plain = c.rlike("^[+-]?[0-9]+$")  # the most of them
    zeros = F.length(digits) - F.length(F.rtrim(digits, F.lit("0")))
    return F.when(plain, True).otherwise(is_decimal(c) & F.coalesce((F.rtrim(digits, F.lit("0")) == "") | (zeros >= fraction - exponent), F.lit(False)))


def one_spelling(c: Column) -> Column:
    """The same string for the same decimal number in any notation: sign, digits without outer zeros, power of ten."""
    digits, fraction, exponent = _parts(c)
    core = F.rtrim(digits, F.lit("0"))
    power = exponent - fraction + F.length(digits) - F.length(core)
    bare = F.ltrim(core, F.lit("0"))
    cut = F.rtrim(c, F.lit("0"))
    plain = F.concat(cut, F.lit("e"), (F.length(c) - F.length(cut)).cast("string"))  # the most of them
    return F.when(c.rlike("^[1-9][0-9]*$"), plain).when(bare == "", F.lit("0")).otherwise(F.concat(F.when(F.regexp_extract(c, DECIMAL, 1) == "-", "-").otherwise(""), bare, F.lit("e"), power.cast("string")))
