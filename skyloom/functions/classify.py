"""Threshold ladders, classes and scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(value: Column, steps: list[tuple[float, object]], last: object) -> Column:
    """The label of the first step that ``value`` reaches (steps from high to low); null for null."""
    out = F
    for at, label in steps:
        out = out.when(value >= at, F.lit(label))
    return out.when(value.isNotNull(), F.lit(last))


#: Lower bounds of effective temperature (K) and mass (solar) per class.
TEMPERATURE_STEPS = [(30000.0, "O"), (10000.0, "B"), (7500.0, "A"), (6000.0, "F"), (5200.0, "G"), (3700.0, "K"), (2400.0, "M")]
MASS_STEPS = [(16.0, "O"), (2.1, "B"), (1.4, "A"), (1.04, "F"), (0.85, "G"), (0.65, "K"), (0.08, "M")]


def class_from_temperature(teff: Column) -> Column:
    return ladder(F.when(teff > 0, teff), TEMPERATURE_STEPS, "L")


def class_from_mass(mass: Column, remnant: Column | None = None) -> Column:
    """A mass says nothing about the class of a remnant."""
    out = ladder(F.when(mass > 0, mass), MASS_STEPS, "L")
    return out if remnant is None else F.when(~F.coalesce(remnant, F.lit(False)), out)


def class_from_spectral_type(c: Column, kind: Column | None = None) -> Column:
    """Class from a raw spectral type and, if given, the kind of object: compact objects first, then dwarf prefixes, Wolf-Rayet stars, white dwarfs, the letter."""
    t = F.trim(c)
    kind = F.lower(F.coalesce(kind, F.lit(""))) if kind is not None else F.lit("")
    low = F.concat_ws(" ", F.lower(F.coalesce(t, F.lit(""))), kind)
    return (
        F.when(low.rlike(r"black[ _-]?hole|^bh$"), "BH").when(low.contains("magnetar"), "MAG").when(low.rlike(r"pulsar|\bpsr\b"), "PSR").when(low.rlike(r"neutron[ _-]?star|^ns$"), "NS")
        .when(t.rlike(r"^(?:esd|usd|sd|d)[OBAFGKMLTY]"), F.regexp_extract(t, r"^(?:esd|usd|sd|d)([OBAFGKMLTY])", 1)).when(t.rlike(r"^W[CNOR]") | low.rlike(r"wolf[ _-]?rayet"), "WR")
        .when(t.rlike(r"(?i)^(?:WD|D(?:$|[ABCOQXZ0-9]))") | (kind == "white_dwarf"), "WD").when(F.upper(t).rlike(r"^[OBAFGKMLTY]"), F.substring(F.upper(t), 1, 1))
    )


#: How many Earth radii and masses a Jupiter has.
JUPITER_RADIUS, JUPITER_MASS = 11.209, 317.83


def planet_size(radius_earth: Column, radius_jupiter: Column, mass_earth: Column, mass_jupiter: Column) -> Column:
    """0, 1 or 2 by the first size known: radius in Earth radii, in Jupiter radii, mass in Earth masses, in Jupiter masses."""
    radius, mass = F.coalesce(radius_earth, radius_jupiter * JUPITER_RADIUS), F.coalesce(mass_earth, mass_jupiter * JUPITER_MASS)
    return F.when(radius.isNotNull(), ladder(radius, [(6.0, 2), (2.0, 1)], 0)).otherwise(ladder(mass, [(50.0, 2), (10.0, 1)], 0))


def infrared_score(distance: Column, radius: float, snr: Column, clean: Column, colour: Column, motion: Column) -> Column:
    """Confidence of an infrared counterpart from its distance, signal, flags, colour and motion; a missing part counts nothing."""
    near = F.coalesce(F.greatest(F.lit(0.0), 1 - F.least(distance, F.lit(radius)) / max(radius, 0.001)), F.lit(0.0))
    part = lambda c, top: F.coalesce(clamp01(c / top), F.lit(0.0))
    return near * 0.46 + part(snr, 60.0) * 0.20 + F.when(clean, 1.0).otherwise(0.45) * 0.18 + part(colour, 1.2) * 0.08 + part(motion, 0.6) * 0.08


def infrared_tier(distance: Column, score: Column) -> Column:
    return F.when((distance <= 2.5) & (score >= 0.72), "high").when((distance <= 8.0) & (score >= 0.45), "medium").otherwise("low")


#: Fixed values in the three functions below: limits of size, temperature, separation, magnitude and motion.
def planet_bit(radius_earth: Column, mass_earth: Column, temperature: Column, size: Column | None = None) -> Column:
    """3 temperature by 3 size classes as one bit; size by radius, else by mass; 512 if unknown."""
    size = planet_size(radius_earth, F.lit(None).cast("double"), mass_earth, F.lit(None).cast("double")) if size is None else size
    heat = ladder(temperature, [(320.0, 2), (200.0, 1)], 0)
    return F.when(size.isNotNull() & heat.isNotNull(), F.pow(F.lit(2.0), heat * 3 + size).cast("int")).otherwise(512)


def crossmatch_score(sep_arcsec: Column, dmag: Column, dpm: Column) -> Column:
    s = F.when(sep_arcsec <= 2, 70).when(sep_arcsec <= 5, 55).when(sep_arcsec <= 15, 35).otherwise(15)
    return s + F.when(dmag <= 0.5, 20).when(dmag <= 1.5, 10).otherwise(0) + F.when(dpm <= 5, 15).when(dpm <= 20, 8).otherwise(0)


def crossmatch_tier(score: Column) -> Column:
    return ladder(score, [(80, "high"), (55, "medium"), (30, "low")], "reject")


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def weighted_score(parts: dict[str, tuple[Column, float]]) -> Column:
    total = F.lit(0.0)
    for column, weight in parts.values():
        total = total + column * weight
    return total


def rarity(prevalence: Column, weight: float, top: float = 28.0) -> Column:
    """-log10 of the prevalence times a weight, rounded half to even, at most ``top``."""
    return F.least(F.lit(top), F.bround(-F.log10(prevalence) * weight, 0))
