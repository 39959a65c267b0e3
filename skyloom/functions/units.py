"""Unit spellings and conversions to the common unit of a quantity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A policy table (conversions, layouts, catalogs) is fixed; more rows than this are an error, never cut.
MAX_POLICY_ROWS = 20_000

#: Spellings of each unit in the normal form of ``unit_form``.
SPELLINGS: dict[str, tuple[str, ...]] = {
    # age
    "Gyr": ("gyr", "gyrs", "gyears", "gyear", "ga", "gigayear", "gigayears", "billionyears", "billionyr", "109yr", "109years", "109a", "1e9yr"),
    "Myr": ("myr", "myrs", "myears", "myear", "ma", "megayear", "megayears", "millionyears", "millionyr", "106yr", "106years", "106a", "1e6yr"),
    "yr": ("yr", "yrs", "year", "years", "a", "julianyears", "julianyear"),
    "dex_yr": ("dex(yr)", "log(yr)", "logyr", "log10(yr)", "log10yr", "[yr]", "log(age/yr)", "log(years)", "dex(years)"),
    # temperature
    "K": ("k", "kelvin", "kelvins", "degk", "°k"),
    "kK": ("kk", "kkelvin", "kilokelvin", "kilokelvins", "103k", "1000k", "103kelvin"),
    "degC": ("c", "degc", "°c", "celsius", "degreescelsius", "degcelsius"),
    "dex_K": ("dex(k)", "log(k)", "logk", "log10(k)", "log10k", "[k]", "log(teff/k)"),
    # surface gravity
    "dex_cgs": ("dex", "dex(cm/s2)", "log(cms-2)", "log10(cms-2)", "[cm/s2]", "[cms-2]", "dex(cms-2)", "log(cm/s2)", "log10(cm/s2)", "logcgs", "log(cgs)", "dex(cgs)", "[cgs]", "cgsdex"),
    "dex_si": ("dex(m/s2)", "log(ms-2)", "log10(ms-2)", "[m/s2]", "[ms-2]", "dex(ms-2)", "log(m/s2)", "log10(m/s2)"),
    "cm_s2": ("cm/s2", "cms-2", "gal", "gals", "cm/s/s", "cm/sec2"),
    "m_s2": ("m/s2", "ms-2", "m/s/s", "m/sec2"),
    # luminosity
    "solLum": ("lsun", "sollum", "solarluminosities", "solarluminosity", "lsol", "l/lsun"),
    "W": ("w", "watt", "watts"),
    "erg_s": ("erg/s", "ergs-1", "ergs/s", "erg/sec"),
    "dex_solLum": ("dex(lsun)", "log(lsun)", "loglsun", "log(l/lsun)", "log10(l/lsun)", "log10(lsun)", "[lsun]", "[sollum]", "dex(sollum)", "log(sollum)", "logl/lsun"),
    # mass
    "solMass": ("msun", "solmass", "msol", "solarmasses", "solarmass", "m/msun"),
    "jupMass": ("mj", "mjup", "jupmass", "jupitermasses", "jupitermass", "mjupiter"),
    "earthMass": ("mearth", "earthmass", "earthmasses", "me"),
    "kg": ("kg", "kilogram", "kilograms", "kgs"),
    "mMsun": ("mmsun", "milli-msun", "millimsun", "10-3msun", "msolmass", "millisolarmasses"),
    # density
    "g_cm3": ("g/cm3", "gcm-3", "g/cc", "gcc-1", "cgs"),
    "kg_m3": ("kg/m3", "kgm-3"),
    "rho_sun": ("rhosun", "solardensity", "solardensities", "ρsun"),
    # metallicity
    "dex": ("dex", "dex(sol)", "dex(sun)", "[-]", "[sun]", "[solar]", "dex(solar)"),
    "mdex": ("mdex", "millidex", "10-3dex"),
    "solar_ratio": ("solarratio", "zsun", "z/zsun", "solar", "zsolar", "timessolar", "xsolar"),
    # velocity
    "km_s": ("km/s", "kms-1", "kms", "km/sec", "kmps"),
    "m_s": ("m/s", "ms-1", "m/sec"),
    "cm_s": ("cm/s", "cms-1", "cm/sec"),
    # time
    "d": ("d", "day", "days"),
    "h": ("h", "hr", "hrs", "hour", "hours"),
    "min": ("min", "mins", "minute", "minutes"),
    "s": ("s", "sec", "secs", "second", "seconds"),
    "days": ("d", "day", "days", "earthdays", "earthday"),
    "hours": ("h", "hr", "hrs", "hour", "hours"),
    "years": ("yr", "yrs", "year", "years", "a", "julianyears", "julianyear"),
    # length
    "solRad": ("rsun", "solrad", "rsol", "solarradii", "solarradius", "r/rsun"),
    "jupRad": ("rj", "rjup", "juprad", "jupiterradii", "jupiterradius", "rjupiter"),
    "earthRad": ("rearth", "earthrad", "earthradii", "earthradius", "re"),
    "km": ("km", "kms", "kilometre", "kilometres", "kilometer", "kilometers"),
    "Mm": ("mm", "megametre", "megametres", "megameter", "megameters", "106m", "103km", "1000km"),
    "au": ("au", "astronomicalunit", "astronomicalunits"),
    "million_km": ("millionkm", "106km", "gm", "gigametre", "gigametres", "gigameter", "gigameters", "millionkilometres", "millionkilometers"),
}


def unit_form(c: Column) -> Column:
    """The normal form of a unit text: one pair of outer round brackets, blanks, dots,
    underscores and power signs dropped, symbols of bodies spelled out, lower case."""
    text = F.lower(F.translate(c, "☉⊙⊕−", "☉☉⊕-"))
    text = F.regexp_replace(text, r"[\s_.^*·]+", "")
    text = F.regexp_replace(F.regexp_replace(text, "☉", "sun"), "⊕", "earth")
    return F.regexp_replace(text, r"^\((.*)\)$", "$1")


def conversion_rows(conversions: DataFrame) -> list[dict]:
    """The rows of a conversion table, which is a fixed policy of at most ``MAX_POLICY_ROWS`` rows."""
    rows = conversions.dropDuplicates(["quantity_key", "unit_key"]).limit(MAX_POLICY_ROWS + 1).collect()
    if len(rows) > MAX_POLICY_ROWS:
        raise ValueError("the conversion table is not a bounded policy table")
    return [r.asDict() for r in rows]


def unit_lookup(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """One row per quantity and spelling: ``u_quantity, u_form, unit_key, conversion, factor, shift, is_common``.

    Its size is the fixed spellings times the policy rows, so it may be broadcast.
    """
    out: dict[tuple[str, str], tuple] = {}
    for r in sorted(rows, key=lambda r: (r["quantity_key"], r["unit_key"])):
        own = r["unit_key"].lower().replace("_", "")
        for s in (*SPELLINGS.get(r["unit_key"], ()), own):
            value = (r["unit_key"], r["conversion"], float(r["factor"]), float(r["shift"]), r["unit_key"] == r["common_unit"])
            out.setdefault((r["quantity_key"], s), value)
    schema = "u_quantity string, u_form string, unit_key string, conversion string, factor double, shift double, is_common boolean"
    return spark.createDataFrame([(*k, *v) for k, v in out.items()], schema)


def to_common(value: Column, conversion: Column, factor: Column, shift: Column) -> Column:
    """``value`` in the common unit of its quantity; null where there is no such conversion."""
    scaled = value * factor
    return (
        F.when(conversion == "linear", scaled + shift)
        .when(conversion == "log10", F.when(scaled > 0, F.log10(scaled) + shift))
        .when(conversion == "exp10", F.when(F.abs(value) < 300, F.pow(F.lit(10.0), value) * factor))
    )


def from_common(value: Column, conversion: Column, factor: Column, shift: Column) -> Column:
    """The number that states ``value`` (in the common unit) in another unit: ``to_common`` reversed."""
    return (
        F.when(conversion == "linear", (value - shift) / factor)
        .when(conversion == "log10", F.when(F.abs(value - shift) < 300, F.pow(F.lit(10.0), value - shift) / factor))
        .when(conversion == "exp10", F.when(value / factor > 0, F.log10(value / factor)))
    )
