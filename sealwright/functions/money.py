"""Exact money: amounts of DECIMAL(20,6), rates of DECIMAL(12,8), rounded half to even."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import CurrencyMismatchError, InvalidFxRateError, MissingFxRateError
from ..model import CurrencyPolicy

AMOUNT, RATE = "decimal(20,6)", "decimal(12,8)"


def quantize(amount: Column, precision: int | None = 2) -> Column:
    return amount if precision is None else F.bround(amount, precision)


def check_rate(rate) -> Decimal:
    if rate is None:
        raise MissingFxRateError("two currencies need a rate")
    if isinstance(rate, bool) or not isinstance(rate, Decimal) or not rate.is_finite() or rate <= 0:
        raise InvalidFxRateError(f"{rate!r} is not a positive Decimal")
    return rate


def _rate(rate: Decimal | Column | None) -> Column:
    return rate.cast(RATE) if isinstance(rate, Column) else F.lit(check_rate(rate)).cast(RATE)


def _other(a_currency: Column, b: Column, b_currency: Column, policy: CurrencyPolicy, rate) -> Column:
    """b in a's currency. A mismatch under STRICT_MATCH, or without a rate, is null: a row's problem is no exception."""
    same = b_currency == a_currency
    if policy is CurrencyPolicy.STRICT_MATCH or rate is None:
        return F.when(same, b.cast("decimal(33,14)"))
    return F.when(same, b.cast("decimal(33,14)")).otherwise((b.cast(AMOUNT) * _rate(rate)).cast("decimal(33,14)"))


def add(a: Column, a_currency: Column, b: Column, b_currency: Column, policy=CurrencyPolicy.STRICT_MATCH, rate=None, precision: int | None = 2) -> Column:
    return quantize(a.cast("decimal(33,14)") + _other(a_currency, b, b_currency, policy, rate), precision).cast(AMOUNT)


def subtract(a: Column, a_currency: Column, b: Column, b_currency: Column, policy=CurrencyPolicy.STRICT_MATCH, rate=None, precision: int | None = 2) -> Column:
    return quantize(a.cast("decimal(33,14)") - _other(a_currency, b, b_currency, policy, rate), precision).cast(AMOUNT)


def multiply(a: Column, factor: Decimal, precision: int | None = 2) -> Column:
    if not isinstance(factor, Decimal):
        raise TypeError("factor must be a Decimal")
    return quantize(a.cast(AMOUNT) * F.lit(factor).cast(RATE), precision).cast(AMOUNT)


def compare(a: Column, a_currency: Column, b: Column, b_currency: Column, policy=CurrencyPolicy.STRICT_MATCH, rate=None) -> Column:
    """-1, 0 or 1; nothing is rounded before."""
    return F.signum((a.cast("decimal(33,14)") - _other(a_currency, b, b_currency, policy, rate)).cast("double")).cast("int")


def convert(a: Column, currency: Column, target: str, rate, precision: int | None = 2) -> Column:
    """`a` in the target currency; an amount in that currency already stays as it is."""
    if len(target) != 3 or not target.isascii() or not target.isupper():
        raise CurrencyMismatchError(f"{target!r} is not a currency code")
    return F.when(currency == target, a.cast(AMOUNT)).otherwise(quantize(a.cast(AMOUNT) * _rate(rate), precision).cast(AMOUNT))
