"""Rule-based labels. Thresholds are fixed values and can be overridden per call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.functions.dates import day

# Fixed values: (lower bound, label) from the highest down, and the label below all of them.
SPEND_BANDS = ((1000, "High Value"), (500, "Medium Value"), (100, "Low Value"))
SPEND_OTHERWISE = "New Customer"
TENURE_BANDS = ((365, "High Value"), (90, "Medium Value"))
TENURE_OTHERWISE = "Low Value"
PRICE_BANDS = ((10, "Low"), (25, "Medium"))
PRICE_OTHERWISE = "High"
AGE_BANDS = ((5, "Recent"), (20, "Classic"))
AGE_OTHERWISE = "Vintage"


def _first_match(cases: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    condition, label = cases[0]
    chain = F.when(condition, F.lit(label))
    for condition, label in cases[1:]:
        chain = chain.when(condition, F.lit(label))
    return chain.otherwise(F.lit(otherwise))


def spend_segment(spent: Column, bands=SPEND_BANDS, otherwise: str = SPEND_OTHERWISE) -> Column:
    """Customer segment by total spend; a customer with unknown spend falls to the last label."""
    return _first_match([(spent >= F.lit(low), label) for low, label in bands], otherwise)


def tenure_segment(signup: Column, as_of=None) -> Column:
    """Customer segment by days since sign-up (strictly more than the bound)."""
    days = F.datediff(day(as_of), signup)
    label = _first_match([(days > low, name) for low, name in TENURE_BANDS], TENURE_OTHERWISE)
    return F.when(signup.isNotNull(), label)


def price_tier(price: Column) -> Column:
    """Price tier; no price, no tier."""
    label = _first_match([(price < bound, name) for bound, name in PRICE_BANDS], PRICE_OTHERWISE)
    return F.when(price.isNotNull(), label)


def age_category(year: Column, as_of=None) -> Column:
    """How recent a publication year is relative to the year of ``as_of``."""
    this_year = F.year(day(as_of))
    label = _first_match([(year >= this_year - back, name) for back, name in AGE_BANDS], AGE_OTHERWISE)
    return F.when(year.isNotNull(), label)
