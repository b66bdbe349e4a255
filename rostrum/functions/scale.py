"""Scales of map layers and drift from what documents state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rostrum.functions.text import bind

# Steps of a power of ten that a legend may end at.
NICE_STEPS = (1, 1.5, 2, 2.5, 3, 4, 5, 6, 8, 10)


def nice_ceiling(x: Column) -> Column:
    """The least nice number that isn't below x; 1 where x isn't positive."""
    def up(power: Column) -> Column:
        steps = F.filter(F.array(*[F.lit(float(s)) for s in NICE_STEPS]), lambda s: s * power >= x)
        return F.coalesce(F.get(steps, F.lit(0)), F.lit(10.0)) * power

    return F.when(x <= 0, 1.0).when(x > 0, bind(F.pow(F.lit(10.0), F.floor(F.log10(x))), up))


def ramp(value: Column, top: Column) -> Column:
    """Place from 0 to 1 on a square-root scale that ends at top."""
    return F.sqrt(F.least(F.greatest(value, F.lit(0.0)), top) / top)


def drift(found: Column, stated: Column) -> Column:
    """How far what was found is from what was stated, as a share of that; null where nothing, or zero, was stated."""
    return F.try_divide(F.abs(found - stated), stated)


def drift_note(what: Column, found: Column, stated: Column, most: float) -> Column:
    """A warning where the drift is over `most`, which is 0.15 for areas and 0.30 for corridors; else null."""
    share = drift(found, stated)
    words = F.concat(F.lit("WARNING: "), what, F.lit(" differs from stated by "), F.bround(100 * share).cast("long").cast("string"), F.lit("%"))
    return F.when(share > most, words)
