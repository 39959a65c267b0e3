"""Positions, keys and physics as Column expressions; no Python runs per row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.numbers import once

PC_TO_LY = 3.26156
#: Constants of the derivations.
DAYS_PER_YEAR = 365.25
EARTH_PER_SUN = 332946.0487
JUPITER_PER_SUN = 1047.3486
EARTH_TEMPERATURE = 278.5
SUN_TEMPERATURE = 5772.0


def separation_arcsec(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle separation of positions in degrees."""
    a, d, b, e = (F.radians(x) for x in (ra1, dec1, ra2, dec2))
    cosine = F.sin(d) * F.sin(e) + F.cos(d) * F.cos(e) * F.cos(a - b)
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))) * 3600


def cartesian(ra: Column, dec: Column, distance: Column) -> tuple[Column, Column, Column]:
    a, d = F.radians(ra), F.radians(dec)
    return distance * F.cos(d) * F.cos(a), distance * F.cos(d) * F.sin(a), distance * F.sin(d)


def _spread(v: Column) -> Column:
    """The 21 low bits of a long, two zero bits between each."""
    v = v.cast("long")
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def interleave(x: Column, y: Column, z: Column) -> Column:
    """Morton order of three non-negative integers of 21 bits, as a 63-bit long."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1)).bitwiseOR(F.shiftleft(_spread(z), 2))


def with_morton_key(df: DataFrame, name: str = "morton", x: str = "x", y: str = "y", z: str = "z", half: float = 1000.0) -> DataFrame:
    """Adds the 63-bit Morton key of a position within ``[-half, half]`` on each axis; fails outside."""
    top = (1 << 21) - 1
    cell = lambda v: F.least(F.lit(top), F.greatest(F.lit(0), F.round((F.col(v) + half) / (2 * half) * top))).cast("long")
    outside = (F.abs(x) > half) | (F.abs(y) > half) | (F.abs(z) > half)
    df = once(df, _cx=F.when(outside, F.raise_error(F.lit("position outside the Morton domain")).cast("long")).otherwise(cell(x)), _cy=cell(y), _cz=cell(z))
    return df.withColumn(name, interleave(F.col("_cx"), F.col("_cy"), F.col("_cz"))).drop("_cx", "_cy", "_cz")


def with_octree_cells(df: DataFrame, depths: dict[str, int], x: str = "x", y: str = "y", z: str = "z", half: float = 1024.0) -> DataFrame:
    """Adds the Morton index of the octree cell that holds a position, per named depth (21 at most); half-open cells, clamped."""
    deepest = max(depths.values())
    n = 1 << deepest
    cell = lambda v: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((F.col(v) + half) / (2 * half) * n))).cast("long")
    df = once(df, _cx=cell(x), _cy=cell(y), _cz=cell(z))
    df = once(df, _key=interleave(F.col("_cx"), F.col("_cy"), F.col("_cz"))).drop("_cx", "_cy", "_cz")
    # The cell of a lower depth is a prefix of that of the deepest.
    return df.withColumns({name: F.shiftrightunsigned("_key", 3 * (deepest - d)) for name, d in depths.items()}).drop("_key")


def tile_id(cell: Column, depth: int) -> Column:
    return F.concat(F.lit(f"d{depth}-"), F.lower(F.lpad(F.hex(cell), max(1, -(-3 * depth // 4)), "0")))


def kepler_axis(mass_solar: Column, period_days: Column) -> Column:
    """Semi-major axis in au; null unless both are positive."""
    years = period_days / DAYS_PER_YEAR
    return F.when((mass_solar > 0) & (period_days > 0), F.pow(mass_solar * years * years, F.lit(1.0 / 3.0)))


def insolation(luminosity: Column, axis: Column) -> Column:
    return F.when((luminosity > 0) & (axis > 0), luminosity / (axis * axis))


def equilibrium_temperature(s: Column) -> Column:
    return F.when(s > 0, EARTH_TEMPERATURE * F.pow(s, F.lit(0.25)))


def luminosity_from(radius: Column, temperature: Column) -> Column:
    return F.when((radius > 0) & (temperature > 0), radius * radius * F.pow(temperature / SUN_TEMPERATURE, F.lit(4.0)))


def parallax_distance_pc(parallax_mas: Column) -> Column:
    return F.when(parallax_mas > 0, 1000.0 / parallax_mas)


def half_width(low: Column, high: Column) -> Column:
    return F.abs(high - low) / 2


def is_finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < float("inf"))


def with_mixed_hash(df: DataFrame, key: str, name: str) -> DataFrame:
    """Adds the finaliser of a 64-bit mixing hash of a long, as an unsigned decimal(20,0).

    ANSI products raise on overflow, so they are taken in halves of 32 bits; each
    step is computed once per row.
    """
    low = F.lit(0xFFFFFFFF).cast("long")

    def mul(a: Column, b: Column) -> Column:
        """Low 64 bits of the product of two 32-bit numbers."""
        half = F.lit(0xFFFF).cast("long")
        small = a.bitwiseAND(half) * b
        large = F.shiftrightunsigned(a, 16) * b
        return F.shiftleft(F.shiftrightunsigned(small, 16) + large, 16).bitwiseOR(small.bitwiseAND(half))

    df = once(df, _z=F.col(key).cast("long"))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        df = once(df.withColumnRenamed("_z", "_y"), _x=F.col("_y").bitwiseXOR(F.shiftrightunsigned("_y", shift))).drop("_y")
        h, l = F.shiftrightunsigned("_x", 32), F.col("_x").bitwiseAND(low)
        fh, fl = F.lit(factor >> 32).cast("long"), F.lit(factor & 0xFFFFFFFF).cast("long")
        df = once(df, _ll=mul(l, fl), _lh=mul(l, fh).bitwiseAND(low), _hl=mul(h, fl).bitwiseAND(low))
        top = (F.col("_lh") + F.col("_hl") + F.shiftrightunsigned("_ll", 32)).bitwiseAND(low)
        df = once(df, _z=F.shiftleft(top, 32).bitwiseOR(F.col("_ll").bitwiseAND(low))).drop("_x", "_ll", "_lh", "_hl")
    df = once(df.withColumnRenamed("_z", "_y"), _z=F.col("_y").bitwiseXOR(F.shiftrightunsigned("_y", 31))).drop("_y")
    unsigned = F.col("_z").cast("decimal(20,0)")
    return df.withColumn(name, F.when(F.col("_z") < 0, unsigned + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(unsigned).cast("decimal(20,0)")).drop("_z")


#: Limits of the mass ladder.
MASS_COLUMNS = (("best", "earth"), ("best", "jupiter"), ("true", "earth"), ("true", "jupiter"), ("minimum", "earth"), ("minimum", "jupiter"))


def planet_mass_solar(masses: dict[tuple[str, str], Column]) -> Column:
    """The first mass of the ladder that is positive (best, true, minimum; in Earth, then Jupiter masses), in solar masses."""
    per = {"earth": EARTH_PER_SUN, "jupiter": JUPITER_PER_SUN}
    return F.coalesce(*[F.when(masses[k] > 0, masses[k] / per[k[1]]) for k in MASS_COLUMNS if k in masses])


def kepler_interval(mass: Column, mass_low: Column, mass_high: Column, period: Column, period_low: Column, period_high: Column) -> tuple[Column, Column, Column]:
    """Axis and its bounds; a missing bound falls back to the value."""
    low = kepler_axis(F.coalesce(mass_low, mass), F.coalesce(period_low, period))
    high = kepler_axis(F.coalesce(mass_high, mass), F.coalesce(period_high, period))
    return kepler_axis(mass, period), low, high


def insolation_interval(lum: Column, lum_low: Column, lum_high: Column, axis: Column, axis_low: Column, axis_high: Column) -> tuple[Column, Column, Column]:
    """Insolation with crossed bounds: the least light at the widest orbit, the most at the closest."""
    return insolation(lum, axis), insolation(lum_low, axis_high), insolation(lum_high, axis_low)


def luminosity_interval(radius: Column, radius_low: Column, radius_high: Column, t: Column, t_low: Column, t_high: Column) -> tuple[Column, Column, Column]:
    return luminosity_from(radius, t), luminosity_from(radius_low, t_low), luminosity_from(radius_high, t_high)


def equivalent_radius_arcmin(area_sq_deg: Column) -> Column:
    """Radius of the circle that has this area, as 120 sqrt(A / pi) (arc minutes, full axis)."""
    return F.when(area_sq_deg > 0, 120.0 * F.sqrt(area_sq_deg / math.pi))


def julian_year(julian_date: Column) -> Column:
    return 2000.0 + (julian_date - 2451545.0) / 365.25


def besselian_year(julian_date: Column) -> Column:
    return 1900.0 + (julian_date - 2415020.31352) / 365.242198781


def propagate(ra: Column, dec: Column, pm_ra: Column, pm_dec: Column, years: Column) -> tuple[Column, Column]:
    """A position moved by its proper motion (mas a year, right ascension times cos dec)."""
    return ra + pm_ra * years / 3600000 / F.cos(F.radians(dec)), dec + pm_dec * years / 3600000


#: Rotation of the mean equator and equinox of B1950 (FK4) to J2000.
B1950_TO_J2000 = (
    (0.9999256782, -0.0111820611, -0.0048579477),
    (0.0111820610, 0.9999374784, -0.0000271765),
    (0.0048579479, -0.0000271474, 0.9999881997),
)
#: The e-terms of aberration in B1950 positions.
E_TERMS = (-1.62557e-6, -0.31919e-6, -0.13843e-6)


def b1950_to_icrs(ra: Column, dec: Column) -> tuple[Column, Column]:
    """A B1950 (FK4) position in degrees as J2000, which agrees with ICRS to some hundredths of an arcsecond; proper motion is taken as zero.

    The e-terms are removed from the unit vector before it is rotated; all of it stays inside code generation.
    """
    v = cartesian(ra, dec, F.lit(1.0))
    along = v[0] * E_TERMS[0] + v[1] * E_TERMS[1] + v[2] * E_TERMS[2]
    w = [v[i] - E_TERMS[i] + along * v[i] for i in range(3)]
    x, y, z = (w[0] * r[0] + w[1] * r[1] + w[2] * r[2] for r in B1950_TO_J2000)
    return F.degrees(F.atan2(y, x)) + F.when(F.atan2(y, x) < 0, 360.0).otherwise(0.0), F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))
