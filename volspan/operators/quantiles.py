"""Exact interpolated percentiles of groups of any size, by refining an equal-count histogram: no task holds a group's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volspan.sources.stored import stored

#: Cells of a round's histogram. Its bounds are off by a twentieth of a cell at most, so a round leaves fewer than five cells.
CELLS = 512
#: Above so many bytes of groups (keys, and 200 bytes each besides) the table of brackets isn't broadcast but joined under so many salts.
BROADCAST_BYTES, SALTS = 8 << 20, 64


def _beside(rows: DataFrame, state: DataFrame, small: bool) -> DataFrame:
    """Rows beside their group's bracket. A broadcast only below a checked size; else a group's rows are dealt over salts, and its bracket is repeated for each."""
    if small:
        return rows.join(F.broadcast(state), "_k")
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return salted.join(state.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["_k", "_salt"]).drop("_salt")


def _between(v: Column, lo: Column, hi: Column) -> Column:
    return (lo.isNull() | (v > lo)) & (hi.isNull() | (v < hi))


def _refined(rows: DataFrame, state: DataFrame, most: int, small: bool) -> DataFrame:
    """Brackets after one round: bounds from the histogram of the values inside, then exact counts of the five zones that two bounds make. The zone with the wanted rank is the next
    bracket, or the answer if it is a bound itself, so heavy ties end the search and a bound that is off only costs a round."""
    open_ = state.filter(F.col("found").isNull() & (F.col("n_in") > most))
    inside = lambda s: _beside(rows, s, small).filter(_between(F.col("_v"), F.col("lo"), F.col("hi")))
    cells = F.percentile_approx("_v", [j / CELLS for j in range(CELLS + 1)], 20 * CELLS)
    place = (F.col("k") - F.col("below")) / F.col("n_in") * CELLS
    at = lambda x: F.get("_q", F.least(F.greatest(x, F.lit(0)), F.lit(CELLS)).cast("int"))
    bounds = open_.join(inside(open_.select("_k", "lo", "hi")).groupBy("_k").agg(cells.alias("_q")), "_k")
    bounds = stored(bounds.select(*open_.columns, at(F.floor(place) - 1).alias("a"), at(F.ceil(place) + 1).alias("b")))
    v, a, b = F.col("_v"), F.col("a"), F.col("b")
    zones = {"c1": v < a, "c2": v == a, "c3": (v > a) & (v < b), "c4": (v == b) & (b > a), "c5": v > b}
    counts = inside(bounds.select("_k", "lo", "hi", "a", "b")).groupBy("_k").agg(*[F.count_if(z).alias(c) for c, z in zones.items()])
    r, c = F.col("k") - F.col("below"), [F.col(f"c{j}") for j in range(1, 6)]
    upto = [sum(c[1 : j + 1], c[0]) for j in range(5)]
    pick = lambda *x: F.when(r < upto[0], x[0]).when(r < upto[1], x[1]).when(r < upto[2], x[2]).when(r < upto[3], x[3]).otherwise(x[4])
    none, zero = F.lit(None).cast("double"), F.lit(0).cast("long")
    new = {
        "lo": pick(F.col("lo"), none, a, none, b), "hi": pick(a, none, b, none, F.col("hi")), "found": pick(none, a, none, b, none),
        "below": F.col("below") + pick(zero, zero, upto[1], zero, upto[3]), "n_in": pick(*c),
    }
    done = bounds.join(counts, "_k").select("_k", "k", "pos", *[x.alias(name) for name, x in new.items()])
    return stored(state.filter(F.col("found").isNotNull() | (F.col("n_in") <= most)).unionByName(done))


def exact_percentile(rows: DataFrame, keys: list[str], value: str, p: float, name: str = "percentile", most: int = 50_000) -> DataFrame:
    """``keys`` and ``name``: the percentile ``p`` (0 to 1) of ``value`` as a double, interpolated between neighbours like ``percentile``.

    Nulls and NaN are passed over; a group without other values has no row, so an empty table gives none. A null key is a group of its own; without ``keys`` all rows are one group. Values
    are only gathered once a bracket holds ``most`` of them at most; until then each round reads the rows twice for partial aggregates of constant size (one or two rounds in practice).
    """
    if not 0 <= p <= 1:
        raise ValueError("a percentile lies between 0 and 1")
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in keys]
    v = F.col("`" + value.replace("`", "``") + "`").cast("double")
    rows = rows.select(F.struct(*[c.alias(f"k{j}") for j, c in enumerate(quoted)] or [F.lit(0).alias("k0")]).alias("_k"), v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    pos = (F.col("n_in") - 1) * F.lit(float(p))
    none = F.lit(None).cast("double")
    state = rows.groupBy("_k").agg(F.count("*").alias("n_in")).select("_k", F.floor(pos).alias("k"), pos.alias("pos"), none.alias("lo"), none.alias("hi"), none.alias("found"), F.lit(0).cast("long").alias("below"), "n_in")
    state = stored(state)
    size = state.agg(F.sum(200 + F.coalesce(F.octet_length(F.to_json("_k")), F.lit(0)))).first()[0] or 0
    small = size <= BROADCAST_BYTES
    while state.filter(F.col("found").isNull() & (F.col("n_in") > most)).limit(1).count():
        state = _refined(rows, state, most, small)
    v, found, r = F.col("_v"), F.col("found"), F.col("k") - F.col("below")
    inside = F.when(found.isNull() & _between(v, F.col("lo"), F.col("hi")), v)
    beside = _beside(rows, state.drop("n_in"), small).groupBy("_k").agg(
        F.sort_array(F.collect_list(inside)).alias("_in"), F.min(F.when(v >= F.col("hi"), v)).alias("_after"), F.count_if(v <= found).alias("_upto"), F.min(F.when(v > found, v)).alias("_above")
    )
    first = F.coalesce(found, F.get("_in", r.cast("int")))
    second = F.when(found.isNull(), F.coalesce(F.get("_in", (r + 1).cast("int")), F.col("_after"))).otherwise(F.when(F.col("k") + 1 < F.col("_upto"), found).otherwise(F.col("_above")))
    out = state.join(beside, "_k").select("_k", "k", "pos", first.alias("_x"), second.alias("_y"))
    mixed = (F.col("k") + 1 - F.col("pos")) * F.col("_x") + (F.col("pos") - F.col("k")) * F.col("_y")
    whole = (F.col("pos") == F.col("k")) | (F.col("_x") == F.col("_y"))
    return out.select(*[F.col(f"_k.k{j}").alias(c) for j, c in enumerate(keys)], F.when(whole, F.col("_x")).otherwise(mixed).alias(name))
