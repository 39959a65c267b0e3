"""Quantities recorded in different units: one common unit for every stated number.

A number whose own text names a unit is read with it. The other numbers of a
source form one history per quantity, release after release, which
``changepoint.history_segments`` cuts into segments of constant level; shifts as
large as a known factor mark changes of unit, and the sequence of units that
explains levels and shifts best gives each segment its unit. An exact check
follows: where the source's field list declares a unit, that one stands.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.numbers import is_missing_text, number_value, once, real_value, stated_rest, stated_text, with_stated
from skyloom.functions.units import conversion_rows, from_common, to_common, unit_form, unit_lookup
from skyloom.operators.changepoint import Level, history_segments, time_bin
from skyloom.storage import Scratch, small_side

EVIDENCE = ("evidence_id", "source_record_id", "quantity_key", "normalized_value")
#: Days in a bin of a history.
BIN_DAYS = 1


def declared_units(dispositions: DataFrame, lookup: DataFrame) -> DataFrame:
    """``source_id, release_id, u_quantity, declared_form``: the unit each release declares per quantity.

    ``source_unit`` counts if it is a known spelling, else what the description
    gives in brackets, after ``unit`` or after ``given in``. Null keys are left out.
    """
    d = F.col("source_description")
    patterns = (r"(?i)\[units?:?\s*((?:[^\[\]]|\[[^\[\]]*\])*)\]", r"(?i)[;,]\s*units?:?\s+(.+?)\s*$", r"(?i)given in\s+(.+?)\s*$", r"\(((?:[^()]|\([^()]*\))*)\)\s*$")
    texts = [F.col("source_unit"), *[F.regexp_extract(d, p, 1) for p in patterns]]
    each = dispositions.select(
        "source_id", "release_id", F.col("source_field").alias("u_quantity"),
        F.posexplode(F.array(*[unit_form(t) for t in texts])).alias("_p", "declared_form"),
    )
    known = each.join(F.broadcast(lookup.select("u_quantity", F.col("u_form").alias("declared_form"))), ["u_quantity", "declared_form"], "left_semi")
    return known.groupBy("source_id", "release_id", "u_quantity").agg(F.min(F.struct("_p", "declared_form"))["declared_form"].alias("declared_form"))


def _conversion_table(spark, rows: list[dict]) -> DataFrame:
    """``quantity_key, unit_key, conversion, factor, shift``, one row per pair; its size is that of the policy table."""
    data = [(r["quantity_key"], r["unit_key"], r["conversion"], float(r["factor"]), float(r["shift"])) for r in rows]
    return spark.createDataFrame(data, "quantity_key string, unit_key string, conversion string, factor double, shift double")


def stated_numbers(scratch: Scratch, evidence: DataFrame, rows: list[dict], keep: tuple[str, ...] = ()) -> DataFrame:
    """The evidence rows that state a number, with the unit their own text names.

    ``evidence`` is read and its texts are parsed once; all later steps read
    the written result: ``EVIDENCE`` and ``keep``, ``number``, ``unit_key`` (null if
    the text names no known one), ``basis`` (value, unit, or declared if no text names any).
    """
    lookup = unit_lookup(evidence.sparkSession, rows)
    quantities = sorted({r["quantity_key"] for r in rows})
    columns = list(dict.fromkeys((*EVIDENCE, *keep)))
    base = evidence.where(F.col("quantity_key").isin(*quantities)).select(*columns, F.col("value_raw").alias("_value"), F.col("unit_raw").alias("_unit"))
    stated = with_stated(base, "_value", "_number", "_rest").where(F.col("_number").isNotNull())
    in_value, in_unit = ~is_missing_text(F.col("_rest")), ~is_missing_text(F.col("_unit"))
    stated = once(
        stated,
        _form=unit_form(F.when(in_value, F.col("_rest")).when(in_unit, F.col("_unit"))),
        _basis=F.when(in_value, "value").when(in_unit, "unit").otherwise("declared"),
    )
    units = F.broadcast(lookup.select(F.col("u_quantity").alias("quantity_key"), F.col("u_form").alias("_form"), F.col("unit_key").alias("_key")))
    return scratch.write(stated.join(units, ["quantity_key", "_form"], "left").select(*columns, F.col("_number").alias("number"), F.col("_key").alias("unit_key"), F.col("_basis").alias("basis")))


def silent_numbers(scratch: Scratch, stated: DataFrame, records: DataFrame) -> DataFrame:
    """The stated numbers without a unit of their own, with ``source_id, epoch`` (the release, '' for null) and ``seen_at`` of their record.

    One record per id: deliveries repeat. AQE splits a record id that holds a large share of the rows.
    """
    record = records.where(F.col("source_record_id").isNotNull()).groupBy("source_record_id").agg(
        F.min("source_id").alias("source_id"), F.coalesce(F.min("release_id"), F.lit("")).alias("epoch"), F.max("retrieved_at").alias("seen_at")
    )
    silent = stated.where(F.col("unit_key").isNull()).drop("unit_key")
    return scratch.write(silent.join(record, "source_record_id", "left").withColumn("bin", time_bin(F.col("seen_at"), BIN_DAYS)))


def unit_levels(stated: DataFrame, rows: list[dict]) -> dict[str, list[Level]]:
    """Where log10 of a quantity lies in each of its units, from the numbers whose text names their unit.

    Each such number is brought to the common unit and from there to every unit
    of its quantity, so units with an offset or a logarithm have a level too. One row per
    policy row reaches the driver.
    """
    units = F.broadcast(_conversion_table(stated.sparkSession, rows))
    common = stated.where(F.col("unit_key").isNotNull()).select("quantity_key", "number", "unit_key").join(units, ["quantity_key", "unit_key"])
    common = common.select("quantity_key", to_common(F.col("number"), F.col("conversion"), F.col("factor"), F.col("shift")).alias("common"))
    each = common.join(units, "quantity_key").select("quantity_key", "unit_key", F.abs(from_common(F.col("common"), F.col("conversion"), F.col("factor"), F.col("shift"))).alias("v"))
    level = F.when((F.col("v") > 0) & (F.col("v") < 1e300), F.log10("v"))
    linear = {(r["quantity_key"], r["unit_key"]): float(r["factor"]) for r in rows if r["conversion"] == "linear" and not r["shift"] and r["factor"] > 0}
    out: dict[str, list[Level]] = {}
    for r in each.groupBy("quantity_key", "unit_key").agg(F.avg(level).alias("mean"), F.stddev_pop(level).alias("spread")).orderBy("quantity_key", "unit_key").collect():
        if r["mean"] is not None:
            factor = linear.get((r["quantity_key"], r["unit_key"]))
            out.setdefault(r["quantity_key"], []).append(Level(r["unit_key"], r["mean"], r["spread"], None if factor is None else math.log10(factor)))
    return out


def history_bins(stated: DataFrame, silent: DataFrame, rows: list[dict]) -> DataFrame:
    """The bins of the histories of silent numbers with their segments and units (see ``history_segments``)."""
    rows_with_source = silent.where(F.col("source_id").isNotNull()).select("source_id", "quantity_key", "epoch", "seen_at", "number")
    return history_segments(rows_with_source, ["source_id", "quantity_key"], "seen_at", "number", bin_days=BIN_DAYS, epoch="epoch", units=("quantity_key", unit_levels(stated, rows)))


def _silent_units(scratch: Scratch, stated: DataFrame, silent: DataFrame, dispositions: DataFrame, rows: list[dict]) -> DataFrame:
    """The silent numbers with ``inferred`` (by their history) and ``declared`` (by the field list) unit."""
    lookup = unit_lookup(silent.sparkSession, rows)
    era = ["source_id", "quantity_key", "epoch"]
    runs = history_bins(stated, silent, rows).where("unit_key IS NOT NULL").groupBy(*era, "segment").agg(F.min("bin").alias("first"), F.max("bin").alias("last"), F.min("unit_key").alias("unit"))
    # One row per source, quantity and release with its few segments, which do not overlap.
    runs = runs.groupBy(*era).agg(F.collect_list(F.struct("first", "last", "unit")).alias("runs"))
    declared = declared_units(dispositions, lookup).select(
        "source_id", F.coalesce("release_id", F.lit("")).alias("epoch"), F.col("u_quantity").alias("quantity_key"), F.col("declared_form").alias("_form")
    )
    units = lookup.select(F.col("u_quantity").alias("quantity_key"), F.col("u_form").alias("_form"), F.col("unit_key").alias("declared"))
    declared = declared.join(F.broadcast(units), ["quantity_key", "_form"]).groupBy("source_id", "epoch", "quantity_key").agg(F.min("declared").alias("declared"))
    out = silent.join(small_side(scratch, runs), era, "left").join(small_side(scratch, declared), ["source_id", "epoch", "quantity_key"], "left")
    within = F.filter("runs", lambda r: (r["first"] <= F.col("bin")) & (F.col("bin") <= r["last"]))
    out = out.withColumn("inferred", F.get(within, F.lit(0))["unit"]).drop("runs")
    # A text of unknown spelling still speaks against the declared unit.
    return out.withColumn("declared", F.when(F.col("basis") == "declared", F.col("declared")))


def _inputs(evidence: DataFrame, records: DataFrame, conversions: DataFrame, keep: tuple[str, ...] = ()) -> tuple[Scratch, list[dict], DataFrame, DataFrame]:
    scratch = Scratch(evidence.sparkSession, "units")
    rows = conversion_rows(conversions)
    stated = stated_numbers(scratch, evidence, rows, keep)
    return scratch, rows, stated, silent_numbers(scratch, stated, records)


def resolve_units(evidence: DataFrame, records: DataFrame, dispositions: DataFrame, conversions: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Evidence rows that state a number, with its unit and its value in the common unit.

    Adds ``number``, ``unit_key``, ``unit_basis``, ``common_value``, ``verdict`` (right, wrong, missing,
    unknown). ``unit_basis``: ``value`` or ``unit``, the text that names the unit;
    ``history``, the segment of the row's history, not contradicted by the field
    list; ``declared``, the field list alone (the histories name no unit or another one).

    A row with no number in ``value_raw``, or of a quantity without
    conversions, is not part of the result; repeated rows stay repeated; a null
    ``source_record_id`` only loses history and declaration. Only the columns of
    ``EVIDENCE`` and ``keep`` are kept, so others may have any names.
    """
    scratch, rows, stated, silent = _inputs(evidence, records, conversions, keep)
    out_columns = [c for c in stated.columns if c not in ("number", "unit_key", "basis")]
    settled = _silent_units(scratch, stated, silent, dispositions, rows).select(
        *out_columns, "number", F.coalesce("declared", "inferred").alias("unit_key"),
        F.when(F.col("inferred").isNotNull() & (F.col("declared").isNull() | (F.col("declared") == F.col("inferred"))), "history").when(F.col("declared").isNotNull(), "declared").alias("unit_basis"),
    )
    known = stated.where(F.col("unit_key").isNotNull()).select(*out_columns, "number", "unit_key", F.col("basis").alias("unit_basis"))
    out = known.unionByName(settled).join(F.broadcast(_conversion_table(evidence.sparkSession, rows)), ["quantity_key", "unit_key"], "left")
    out = out.withColumn("common_value", to_common(F.col("number"), F.col("conversion"), F.col("factor"), F.col("shift")))
    return out.select(*out_columns, "number", "unit_key", "unit_basis", "common_value", _verdict(F.col("normalized_value"), F.col("common_value")).alias("verdict"))


def _verdict(delivered: Column, common: Column) -> Column:
    norm = real_value(delivered)
    return F.when(common.isNull(), "unknown").when(norm.isNull(), "missing").when(F.abs(norm - common) > 0.01 * F.abs(common), "wrong").otherwise("right")


def unit_histories(evidence: DataFrame, records: DataFrame, conversions: DataFrame) -> DataFrame:
    """The changepoint segments of each source's silent numbers and the units they speak for.

    ``source_id, quantity_key, segment, first_epoch, last_epoch, starts_at, ends_at`` (of all its
    bins), ``n_rows, level, spread, shift, unit_key`` (null if no unit fits or two fit alike),
    ``factor_log10`` (what brings a linear unit to the common one, null for others), ``margin``. Empty input gives no rows.
    """
    _, rows, stated, silent = _inputs(evidence, records, conversions)
    bins = history_bins(stated, silent, rows)
    linear = [(r["quantity_key"], r["unit_key"], math.log10(r["factor"])) for r in rows if r["conversion"] == "linear" and not r["shift"] and r["factor"] > 0]
    factors = bins.sparkSession.createDataFrame(linear or [("", "", 0.0)], "quantity_key string, unit_key string, factor_log10 double")
    keys = ["source_id", "quantity_key", "segment"]
    ends = [F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"), F.min("starts_at").alias("starts_at"), F.max("ends_at").alias("ends_at")]
    same = [F.first(c).alias(c) for c in ("segment_rows", "level", "spread", "shift", "unit_key", "margin")]
    out = bins.groupBy(*keys).agg(*ends, *same).join(F.broadcast(factors), ["quantity_key", "unit_key"], "left")
    return out.select(
        *keys, "first_epoch", "last_epoch", "starts_at", "ends_at", F.col("segment_rows").alias("n_rows"), *[F.round(c, 6).alias(c) for c in ("level", "spread", "shift")],
        "unit_key", F.round("factor_log10", 6).alias("factor_log10"), F.round("margin", 3).alias("margin"),
    )


def inference_quality(evidence: DataFrame, records: DataFrame, dispositions: DataFrame, conversions: DataFrame) -> DataFrame:
    """How often the histories, which never see a declared unit, name it.

    ``quantity_key, unit_key`` (declared), ``n_rows``, ``n_inferred`` (a unit was named), ``n_right``, over
    the silent numbers with a declared unit.
    """
    scratch, rows, stated, silent = _inputs(evidence, records, conversions)
    both = _silent_units(scratch, stated, silent, dispositions, rows).where("declared IS NOT NULL")
    return both.groupBy("quantity_key", F.col("declared").alias("unit_key")).agg(
        F.count("*").alias("n_rows"), F.count("inferred").alias("n_inferred"), F.count_if(F.col("inferred") == F.col("declared")).alias("n_right")
    )


def claim_units(cases: DataFrame, conversions: DataFrame) -> DataFrame:
    """Claims of golden cases whose number is not in its common unit: ``record_key, unit_key``.

    The unit stands in the claim's unit, else beside its value, else beside the
    same number in the source excerpt, next to the words of the predicate. Null
    or empty claim arrays, values without a number and unknown units give no row.
    """
    spark = cases.sparkSession
    rows = conversion_rows(conversions)
    lookup = unit_lookup(spark, rows)
    c = cases.select("case_id", "source_excerpt", F.explode("expected.claims").alias("c")).select(
        "case_id", "source_excerpt", F.col("c.claim_id").alias("claim_id"), F.col("c.predicate").alias("predicate"), F.col("c.value").alias("value"), F.col("c.unit").alias("unit")
    )
    c = c.where(F.col("predicate").isin(*sorted({r["quantity_key"] for r in rows})) & real_value(number_value(stated_text(F.col("value")))).isNotNull())
    words = F.regexp_replace(F.regexp_replace(F.regexp_extract("predicate", r"([^.]+)$", 1), r"_[^_]+$", ""), "_", " ")
    number = F.concat(F.lit(r"(?<![0-9.])\Q"), F.trim(stated_text(F.col("value"))), F.lit(r"\E(?![0-9])\s+"))
    unit_end = r"([^()=]+?)(?=\s+for the |\s*\(|\.(?:\s|$)|;|$)"
    near = F.concat(F.lit("(?i)"), words, F.lit(r"\s*(?:is|was|=|of|:)\s*"), number, F.lit(unit_end))
    after = F.concat(F.lit("(?i)"), number, F.lit(r"([^()=]+?)\s+for the "), words)
    alone = F.concat(F.lit("(?i)"), number, F.lit(unit_end))
    blank = F.lit("")
    said = [F.call_function("regexp_extract", F.coalesce("source_excerpt", blank), p, F.lit(1)) for p in (near, after, alone)]
    texts = F.filter(F.array(F.coalesce("unit", blank), stated_rest(F.col("value")), *said), lambda t: ~is_missing_text(t))
    form = unit_form(F.try_element_at(texts, F.lit(1)))
    units = F.broadcast(lookup.withColumnsRenamed({"u_quantity": "predicate", "u_form": "_form"}))
    found = c.withColumn("_form", form).join(units, ["predicate", "_form"]).where(~F.col("is_common"))
    return found.select(F.concat(F.coalesce("case_id", blank), F.lit("#"), F.coalesce("claim_id", blank)).alias("record_key"), "unit_key")

