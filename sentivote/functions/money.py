"""Call costs as whole numbers of 1e-10 dollars, so that sums are exact."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentivote import vocab
from sentivote.functions.numbers import rounded_div

PLACES = 10


def _price(model: Column, side: int) -> Column:
    """1e-10 dollars per token: a price per million in ten-thousandths."""
    as_ticks = lambda text: F.lit(int(Decimal(text) * 10_000)).cast("long")
    known = F.create_map(
        *[c for m in vocab.MODELS for c in (F.lit(m.name), as_ticks((m.usd_in_per_m, m.usd_out_per_m)[side]))]
    )
    return F.coalesce(F.try_element_at(known, model), as_ticks(vocab.DEFAULT_PRICE[side]))


def cost_units(model: str = "model", tok_in: str = "tok_in", tok_out: str = "tok_out") -> Column:
    """Cost of a call in 1e-10 dollars; models without a price get the default."""
    tokens = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return tokens(tok_in) * _price(F.col(model), 0) + tokens(tok_out) * _price(F.col(model), 1)


def usd(units: Column, digits: int) -> Column:
    """Dollars, rounded half up to ``digits`` places."""
    return rounded_div(units, F.lit(10 ** (PLACES - digits)).cast("long")).cast("double") / float(10**digits)


def eur(units: Column, digits: int, shared_by: Column | None = None) -> Column:
    """Euros, rounded half up; optionally one share of several."""
    rate = Decimal(str(vocab.USD_PER_EUR)) * 10 ** (PLACES - digits)
    converted = units.cast("decimal(20,0)") / F.lit(rate).cast("decimal(14,2)")
    if shared_by is not None:
        converted = converted / shared_by.cast("decimal(20,0)")
    return F.round(converted, 0).cast("double") / float(10**digits)
