"""Numbers as text with six significant digits, as the %g of C prints them, and as a Column expression."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from vouch.functions import text as T

#: The places between which a number in halfway position is compared exactly, and the powers that this takes.
_LEAST, _MOST = -14, 5
_TWOS, _TENS = range(110), range(21)


def _power(base: int, exponents: range, at: Column) -> Column:
    return F.get(F.array(*(F.lit(Decimal(base**i)).cast("decimal(38,0)") for i in exponents)), at.cast("int"))


def _below_half(x: Column, digits: Column, exponent: Column) -> Column:
    """Whether x is less than its own shortest digits (seven of them, the last a 5), or exact with an even sixth: -1, 0 or 1 decides.

    x = m / 2**k for a whole m, so x and the digits are compared as whole decimals. Beyond _LEAST and from 2**53 on, null.
    """
    k = 54 - F.floor(F.log2(x))
    m = (x * F.pow(F.lit(2.0), k.cast("double"))).cast("bigint").cast("decimal(20,0)")
    left = F.try_multiply(m, _power(10, _TENS, 6 - exponent))
    right = F.try_multiply(digits.cast("decimal(7,0)"), _power(2, _TWOS, k))
    whole = F.when((exponent >= 6) & (x < 2.0**53), 0)
    return F.when((exponent >= _LEAST) & (exponent <= _MOST), F.when(left < right, -1).when(left == right, 0).otherwise(1)).otherwise(whole)


def six_digits(number: Column | str) -> Column:
    """Six significant digits, without zeros at the end; as d.dde+XX from a million on and below a ten-thousandth.

    Halves are rounded by the number's exact value, and to even digits where that is a half. (Below 1e-14, and from 2**53
    on, a number whose shortest form is a half is rounded up; numbers below 2.3e-308 keep their shortest digits.)
    """
    x = T.column(number).cast("double")
    size = F.abs(x)
    # a number that is whole or short as it stands needs no rounding; zero has its sign
    whole = F.when((size > 0) & (size < 1e6) & (size == F.floor(size)), x.cast("bigint").cast("string"))
    short = F.when((size >= 1e-3) & (size < 1e6) & (F.char_length(size.cast("string")) <= 7), x.cast("string"))
    zero = F.when(size == 0, F.when(F.startswith(x.cast("string"), F.lit("-")), "-0").otherwise("0"))
    return F.coalesce(whole, short, zero, F.get(F.transform(F.array(x), _rounded_digits), F.lit(0)))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value stands in the expression once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _rounded_digits(x: Column) -> Column:
    """six_digits() of any number, in full."""
    return _once(F.abs(x), lambda size: _once(F.format_string("%.17e", size), lambda long_form: _of_long_form(x, size, long_form)))


def _of_long_form(x: Column, size: Column, long_form: Column) -> Column:
    short_form = F.format_string("%.5e", size)
    exponent = F.substring_index(long_form, "e", -1).try_cast("int")
    seven = F.concat(F.substring(long_form, 1, 1), F.substring(long_form, 3, 6))
    halfway = F.regexp_like(long_form, F.lit(r"^\d\.\d{5}50*e")) & (size > 0)
    side = F.when(halfway, _below_half(size, seven, exponent))
    down = (side < 0) | ((side == 0) & (F.substring(seven, 6, 1).try_cast("int") % 2 == 0))
    rounded = F.when(F.coalesce(down, F.lit(False)), F.concat(F.substring(long_form, 1, 7), F.lit("e"), F.substring_index(long_form, "e", -1))).otherwise(short_form)
    return _once(rounded, lambda digits: _written(x, size, digits))


def _written(x: Column, size: Column, rounded: Column) -> Column:
    """The number as text from its six digits and their power (d.ddddde+XX)."""
    power = F.substring_index(rounded, "e", -1)
    place, digits = power.try_cast("int"), F.concat(F.substring(rounded, 1, 1), F.substring(rounded, 3, 5))
    bare = lambda t: F.regexp_replace(F.regexp_replace(t, r"0+$", ""), r"\.$", "")
    powered = F.concat(bare(F.substring_index(rounded, "e", 1)), F.lit("e"), power)
    large = F.concat(F.substring(digits, F.lit(1), place + 1), F.lit("."), F.substring(digits, place + 2, F.lit(6)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -place - 1), digits)
    shown = F.when((place < -4) | (place > 5), powered).when(place >= 0, bare(large)).otherwise(bare(small))
    sign = F.when(F.startswith(x.cast("string"), F.lit("-")), "-").otherwise("")
    return F.when(F.isnan(x), "nan").when(size == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, shown))


def six_digit_number(number: Column | str) -> Column:
    """The number that six_digits() writes."""
    return six_digits(number).cast("double")
