"""Generic relational operators that the domain operators are composed of."""

from __future__ import annotations

import base64
import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.numbers import once
from skyloom.storage import Scratch, sized


def col_or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    """The column if the frame has it, else a typed null."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def keep_one(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in ``order`` (end it with a unique column)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def unique_keys(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value`` for keys that occur exactly once; null keys never do."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")


def unique_join(left: DataFrame, right: DataFrame, key: str, left_value: str, right_value: str) -> DataFrame:
    """Joins only the keys that occur exactly once on either side."""
    return unique_keys(left, key, left_value).join(unique_keys(right, key, right_value), key)


def waterfall(stages: list[DataFrame], key: str, *tie: Column) -> DataFrame:
    """The rows of the first stage that has a key; one shuffle for all stages."""
    ranked = reduce(lambda a, b: a.unionByName(b), [s.withColumn("stage", F.lit(i)) for i, s in enumerate(stages)])
    return keep_one(ranked, [key], F.col("stage"), *tie)


def unpivot(df: DataFrame, ids: list[str], measures: dict[str, Column], name: str = "quantity_key", value: str = "value") -> DataFrame:
    """Wide to long in one pass; null measures give no row."""
    rows = F.array(*[F.struct(F.lit(k).alias(name), v.cast("double").alias(value)) for k, v in measures.items()])
    return df.select(*ids, F.inline(rows)).where(F.col(value).isNotNull())


def pivot(df: DataFrame, ids: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """Long to wide with a fixed list of names by conditional maxima (one aggregation)."""
    return df.groupBy(*ids).agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names])


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``base`` with the same key; others are added."""
    both = base.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return keep_one(both, keys, F.desc("_new")).drop("_new")


#: Pairs of an equi join that one task lists.
PAIRS_A_TASK = 4_000_000


def or_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], left_id: str, right_id: str, task_pairs: int = PAIRS_A_TASK) -> DataFrame:
    """``a = x OR b = y`` as one equi join per alternative: ``left_id, right_id, basis`` (first that holds).

    A disjunction in one condition would become a nested-loop join. Where both ids have
    one row of keys, an alternative leaves out the pairs that an earlier one lists, so no pair
    comes twice and the pairs are never exchanged; only pairs of ids with several rows of keys are grouped.
    """
    scratch = Scratch(left.sparkSession, "or_join")
    l, l_more = _key_rows(scratch, left, left_id, [a for a, _ in pairs], "l")
    r, r_more = _key_rows(scratch, right, right_id, [b for _, b in pairs], "r")
    out = _first_pairs(scratch, l, r, len(pairs), task_pairs)
    again = [_first_pairs(scratch, l_more, x, len(pairs), task_pairs) for x in (r, r_more) if l_more is not None and x is not None]
    if r_more is not None:
        again.append(_first_pairs(scratch, l, r_more, len(pairs), task_pairs))
    if again:
        out = out.unionByName(reduce(DataFrame.unionByName, again).groupBy("l", "r").agg(F.min("basis").alias("basis")))
    return out.withColumnsRenamed({"l": left_id, "r": right_id})


def _key_rows(scratch: Scratch, df: DataFrame, key: str, columns: list[str], name: str) -> tuple[DataFrame, DataFrame | None]:
    """The ids with one different row of ``columns``, and the rows of the others (None if there are none)."""
    keys = [f"{name}{i}" for i in range(len(columns))]
    rows = df.select(F.col(key).alias(name), *[F.col(c).alias(k) for c, k in zip(columns, keys)]).where(reduce(lambda x, y: x | y, [F.col(c).isNotNull() for c in columns]))
    ends = scratch.write(rows.groupBy(name).agg(F.min(F.struct(*keys)).alias("lo"), F.max(F.struct(*keys)).alias("hi")))
    several = ends.where("NOT (lo <=> hi)").select(F.col(name).alias("_id"))
    more = None if several.isEmpty() else scratch.write(rows.join(several, F.col(name).eqNullSafe(F.col("_id")), "left_semi").distinct())
    return ends.where("lo <=> hi").select(name, "lo.*"), more


def _first_pairs(scratch: Scratch, l: DataFrame, r: DataFrame, n: int, task_pairs: int) -> DataFrame:
    """``l, r, basis`` of every row of ``l`` and row of ``r`` with an equal key, by their first equal key."""
    each = []
    for i in range(n):
        on = F.col(f"l{i}") == F.col(f"r{i}")
        earlier = [F.coalesce(F.col(f"l{j}") == F.col(f"r{j}"), F.lit(False)) for j in range(i)]
        counts = [x.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias(f"n_{c[0]}")) for x, c in ((l, f"l{i}"), (r, f"r{i}"))]
        # A key with many pairs is cut into blocks: its longer side is dealt out to them, the shorter one goes to each.
        blocks = scratch.write(counts[0].join(counts[1], on).select(
            F.col(f"l{i}").alias("_key"), (F.col("n_l") * F.col("n_r")).alias("pairs"), F.least(F.ceil(F.col("n_l") * F.col("n_r") / task_pairs), F.greatest("n_l", "n_r")).alias("_n"), (F.col("n_l") >= F.col("n_r")).alias("_left"),
        ))
        total = blocks.agg(F.sum("pairs")).first()[0] or 0
        if total <= task_pairs:
            both = l.join(r, on)
        else:
            # The partitions are stated, because adaptive execution would join them by their few bytes of input.
            # Not broadcast either: the blocks make a side larger than the planner's estimate.
            heavy, parts = sized(blocks.where("_n > 1")), -(-total // task_pairs)
            sides = []
            for x, c, dealt in ((l, f"l{i}", F.col("_left")), (r, f"r{i}", ~F.col("_left"))):
                every = F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)
                block = F.when(F.col("_n").isNull(), F.array(F.lit(0).cast("bigint"))).when(dealt, F.array(F.pmod(F.xxhash64(*x.columns), F.col("_n")))).otherwise(every)
                marked = x.where(F.col(c).isNotNull()).join(heavy, F.col(c) == F.col("_key"), "left").select(*x.columns, F.explode(block).alias(f"{c}_block"))
                sides.append(marked.repartition(parts, c, f"{c}_block"))
            both = sides[0].hint("merge").join(sides[1], on & (F.col(f"l{i}_block") == F.col(f"r{i}_block")))
        each.append(both.where(~reduce(lambda x, y: x | y, earlier, F.lit(False))).select("l", "r", F.lit(i).alias("basis")))
    return reduce(DataFrame.unionByName, each)


def neighbour_bins(df: DataFrame, **axes: Column) -> DataFrame:
    """A row per bin within one of each axis' bin: theta joins become equi joins on the bins."""
    for name, c in axes.items():
        df = df.withColumn(name, F.explode(F.sequence(c.cast("long") - 1, c.cast("long") + 1)))
    return df


def table_delta(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row: rows added, removed, changed and unchanged, and changes per field."""
    a = before.select(*keys, F.struct(*fields).alias("a"))
    b = after.select(*keys, F.struct(*fields).alias("b"))
    both = a.join(b, keys, "full")
    present = F.col("a").isNotNull() & F.col("b").isNotNull()
    differs = {f: present & ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")) for f in fields}
    anything = reduce(lambda x, y: x | y, differs.values())
    return both.agg(
        F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("removed"),
        F.count_if(anything).alias("changed"), F.count_if(present & ~anything).alias("unchanged"),
        *[F.count_if(d).alias(f"changed_{f}") for f, d in differs.items()],
    )


def fingerprint(df: DataFrame, key: Column) -> DataFrame:
    """Order-independent: count, xor, least and greatest of a 60-bit hash that any engine can compute."""
    h = F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("long")
    return df.agg(F.count("*").alias("n_rows"), F.bit_xor(h).alias("hash_xor"), F.min(h).alias("hash_min"), F.max(h).alias("hash_max"))


def table_digest(df: DataFrame) -> DataFrame:
    """``n_rows, digest`` of a table, whatever its row order and partitioning; repeated rows count.

    The 256-bit hash of each row is taken as eight words of 32 bits; the digest hashes their sums and the xor of
    the first 60 bits, which are accumulators of fixed size, combined map-side. No row hashes are collected.
    """
    text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    row = once(df, _h=F.sha2(text, 256)).select("_h")
    word = lambda i, n: F.conv(F.substring("_h", i, n), 16, 10).cast("bigint")
    # Sums of 32-bit words over up to 10**28 rows fit the decimal.
    sums = [F.coalesce(F.sum(word(8 * i + 1, 8).cast("decimal(10,0)").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias(f"s{i}") for i in range(8)]
    parts = row.agg(F.count("*").alias("n_rows"), F.coalesce(F.bit_xor(word(1, 15)), F.lit(0).cast("bigint")).alias("x"), *sums)
    return parts.select("n_rows", F.sha2(F.concat_ws("|", "x", *[f"s{i}" for i in range(8)]), 256).alias("digest"))


def exact_quantiles(scratch, df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``keys`` and one interpolated quantile per name in ``shares``; nulls and NaN have no place.

    Values are range-sorted and indexed once (``hierarchy.dense_index``), and the two rows around each
    quantile are picked by their place in the group, so no group of values meets in one task.
    """
    from skyloom.operators.hierarchy import dense_index

    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("_v"))
    placed = scratch.write(dense_index(scratch, rows, *keys, "_v", name="_g"))
    groups = placed.groupBy(*keys).agg(F.min("_g").alias("_first"), F.count("*").alias("_n"))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(q).alias("q")) for name, q in shares.items()]))
    at = groups.withColumn("_q", asked).select(*keys, F.col("_q.name").alias("_name"), "_first", ((F.col("_n") - 1) * F.col("_q.q")).alias("_at"))
    ends = at.select(*keys, "_name", "_at", "_first", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_i")).withColumn("_g", F.col("_first") + F.col("_i"))
    # Between the two places the nearer one weighs more.
    weight = 1 - F.abs(F.col("_at") - F.col("_i"))
    got = ends.select("_g", "_name", "_at", "_i").join(placed, "_g").groupBy(*keys, "_name").agg(F.sum(weight * F.col("_v")).alias("_v"))
    return got.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in shares])


def near_join(left: DataFrame, right: DataFrame, key: str, a: str, b: str, absolute: float, relative: float) -> DataFrame:
    """Pairs of equal ``key`` with ``|a - b| <= max(absolute, b * relative)``, for values that are not negative.

    Values are mapped to a scale on which the tolerance spans under two steps (linear up to where the relative
    tolerance takes over, logarithmic from there); the right side is copied to five steps and the join is an equi join.
    """
    turn = absolute / relative
    def step(x: Column) -> Column:
        return F.floor(F.when(x < turn, x / absolute).otherwise(1 / relative + F.log(F.greatest(x, F.lit(turn)) / turn) / math.log1p(relative)))
    l = left.withColumn("_s", step(F.col(a)))
    r = right.withColumn("_t", step(F.col(b))).withColumn("_s", F.explode(F.sequence(F.col("_t") - 2, F.col("_t") + 2))).drop("_t")
    return l.join(r, [key, "_s"]).where(F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(absolute), F.col(b) * relative)).drop("_s")


def encode_cursor(values: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(values, sort_keys=True).encode()).decode()


def decode_cursor(text: str) -> dict:
    return json.loads(base64.urlsafe_b64decode(text.encode()))


def keyset_page(df: DataFrame, order: list[tuple[str, bool, object]], size: int, cursor: str | None = None) -> DataFrame:
    """The page after ``cursor`` in an order of ``(column, descending, sentinel for null)``.

    The cursor becomes a lexicographic predicate that reaches the scan; the page
    is a top-k, not a sort of the table. The last column must be unique.
    """
    filled = [(F.coalesce(F.col(c), F.lit(s)), desc) for c, desc, s in order]
    if cursor:
        at = decode_cursor(cursor)
        alternatives = []
        for i, (c, desc) in enumerate(filled):
            step = (c < at[order[i][0]]) if desc else (c > at[order[i][0]])
            alternatives.append(reduce(lambda a, b: a & b, [filled[j][0] == at[order[j][0]] for j in range(i)] + [step]))
        df = df.where(reduce(lambda a, b: a | b, alternatives))
    return df.orderBy(*[c.desc() if desc else c.asc() for c, desc in filled]).limit(size)


def ordered_sum(group: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """A float sum in a fixed order, so that it is the same in every run. Groups are collected: keep them small."""
    terms = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value])
    return group.groupBy(*keys).agg(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x).alias(name))


def bounded_top(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows per key; Spark prunes map-side by the rank limit."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-null rows and percentage per column in one pass."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_present"), F.round(100.0 * F.col(c) / F.nullif(F.col("_n"), F.lit(0)), 6).alias("pct")) for c in columns])
    return counts.select(F.inline(rows))


def append_history(history: DataFrame, new: DataFrame, keys: list[str], first: str, last: str, payload: list[str]) -> DataFrame:
    """Append-only history: the first observation stays, the last advances with its payload, nothing is deleted."""
    both = history.unionByName(new)
    latest = F.max(F.struct(last, *payload))
    out = both.groupBy(*keys).agg(F.min(first).alias(first), F.max(last).alias("_last"), latest.alias("_p"))
    return out.select(*keys, first, F.col("_last").alias(last), *[F.col(f"_p.{p}").alias(p) for p in payload])


def count_differences(df: DataFrame, column: str, expected: dict[str, int]) -> DataFrame:
    """``outcome, expected, found`` for the outcomes whose count differs from the pinned one, in either direction; a null outcome is 'null'."""
    pinned = df.sparkSession.createDataFrame(sorted(expected.items()) or [("", 0)], "outcome string, expected long").where(F.lit(bool(expected)))
    found = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("null")).alias("outcome")).agg(F.count("*").alias("found"))
    both = found.join(F.broadcast(pinned), "outcome", "full")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return both.select("outcome", zero("expected"), zero("found")).where("expected <> found")


def expect_counts(df: DataFrame, column: str, expected: dict[str, int]) -> None:
    """Raises if any outcome count of ``column`` differs from the pinned one; all outcomes are compared, an example is shown."""
    bad = count_differences(df, column, expected).orderBy("outcome").head(5)
    if bad:
        raise ValueError(f"outcome counts changed: {[r.asDict() for r in bad]}")


def merge_json(old: Column, patch: Column) -> Column:
    """Keys of a flat JSON object replaced by those of another; null values of the patch remove a key."""
    kind = "map<string,string>"
    both = F.map_concat(
        F.map_filter(F.from_json(old, kind), lambda k, v: ~F.array_contains(F.coalesce(F.map_keys(F.from_json(patch, kind)), F.array().cast("array<string>")), k)),
        F.map_filter(F.from_json(patch, kind), lambda k, v: v.isNotNull()),
    )
    return F.to_json(both)


def source_delta(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """``key, change`` of a source snapshot: new, missing or changed; unchanged sources have no row."""
    both = before.select(key, F.col(digest).alias("_a")).join(after.select(key, F.col(digest).alias("_b")), key, "full")
    change = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "missing").when(F.col("_a") != F.col("_b"), "changed")
    return both.select(key, change.alias("change")).where(F.col("change").isNotNull())
