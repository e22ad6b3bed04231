"""Operator 5: shards of even document counts by balanced label propagation.

A vertex is a distinct text with all its copies; it may lie in several shards, so the state is a table of pieces (vertex, shard, documents). Documents start dealt evenly by rank. In
each round a join of the links with the pieces gives every vertex the votes of its neighbours (copies vote for each other); pieces outside the vertex's best shards ask to move there.
The requests between two shards are admitted as far as they swap evenly or the target has room beside its linked documents, in order of gain, by running sums that are
taken in two levels; a piece at the quota's edge is split. Documents without links fill what room is left, so counts differ by at most one.

The driver sees only matrices of shards. A vertex above a shard's capacity keeps as many shards as it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import in_few_parts, materialize, partitions_for, two_level_rank


def running_start(df: DataFrame, group: list[str], order: list[str], weight: str, start: str) -> DataFrame:
    """Adds ``start``, the sum of ``weight`` over the group's earlier rows by ``order[0]`` (a long), then ``order``; large groups are summed in buckets of the first column's range."""
    n = partitions_for(df, 4)
    df = df.withColumn("_bucket", F.floor((F.col(order[0]).cast("double") + 2.0**63) / (2.0**64 / n)))
    sums = df.groupBy(*group, "_bucket").agg(F.sum(weight).alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    base = sums.select(*group, "_bucket", F.coalesce(before, F.lit(0)).alias("_base"))
    place = F.coalesce(F.sum(weight).over(W.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_place", place).join(base, [*group, "_bucket"]).withColumn(start, F.col("_base") + F.col("_place")).drop("_bucket", "_base", "_place")


def admit(asked: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of the documents that ask to move between two shards may: even swaps, then what the targets have room for, which departures enlarge."""
    granted = {(s, t): min(n, asked.get((t, s), 0)) for (s, t), n in asked.items()}
    room = list(room)
    for (s, t), n in sorted(asked.items(), key=lambda x: (-x[1], x[0])):
        more = min(n - granted[s, t], max(0, room[t]))
        granted[s, t] += more
        room[t] -= more
    return granted


def propagate(pieces: DataFrame, edges: DataFrame | None, capacity: list[int], rounds: int) -> DataFrame:
    """``pieces``: ``v, shard, n`` of linked vertices; ``edges``: ``v, u`` both ways, or None. Returns the pieces after at most ``rounds`` rounds; sums by shard stay within capacity."""
    k, least, n_pieces = len(capacity), max(1, min(capacity)), pieces.count()
    for k_round in range(rounds):
        votes = pieces
        if edges is not None:
            votes = votes.unionByName(edges.join(pieces.withColumnRenamed("v", "u"), "u").select("v", "shard", "n"))
        votes = votes.groupBy("v", "shard").agg(F.sum("n").alias("votes"))
        # Equal votes go by an order of the shards that changes with the round: two neighbours agree on one of their shards instead of swapping or staying apart.
        best = F.reverse(F.array_sort(F.collect_list(F.struct("votes", F.xxhash64(F.lit(k_round), "shard").alias("tie"), "shard"))))  # at most one entry per shard
        size = pieces.groupBy("v").agg(F.sum("n").alias("size"))
        homes = votes.groupBy("v").agg(best.alias("best")).join(size, "v").select("v", F.slice("best", 1, F.ceil(F.col("size") / least).cast("int")).alias("homes"))
        stays = F.exists("homes", lambda h: h["shard"] == F.col("shard"))
        home = F.element_at("homes", (F.pmod(F.xxhash64("v", "shard"), F.size("homes").cast("long")) + 1).cast("int"))
        moves = pieces.join(homes, "v").select("v", "shard", "n", F.when(stays, F.col("shard")).otherwise(home["shard"]).alias("to"), F.when(stays, 0).otherwise(home["votes"]).alias("gain"))
        order = F.shiftleft(F.lit(1024) - F.least(F.col("gain"), F.lit(1024)), 48) + F.pmod(F.xxhash64("v", "shard"), F.lit(1 << 48))
        moves = materialize(moves.withColumn("order", order), n_pieces)
        table = moves.groupBy("shard", "to").agg(F.sum("n").alias("n"), F.count("*").alias("pieces")).collect()  # a matrix of shards
        load = [sum(r["n"] for r in table if r["shard"] == s) for s in range(k)]
        granted = admit({(r["shard"], r["to"]): r["n"] for r in table if r["shard"] != r["to"]}, [c - x for c, x in zip(capacity, load, strict=True)])
        if not any(granted.values()):
            break
        quota = F.element_at(F.create_map(*[F.lit(x) for (s, t), n in granted.items() for x in (s * k + t, n)]), F.col("shard") * k + F.col("to"))
        asked = running_start(moves.filter("shard <> to"), ["shard", "to"], ["order", "v"], "n", "start")
        gone = F.greatest(F.lit(0), F.least(F.col("n"), F.coalesce(quota, F.lit(0)) - F.col("start")))
        asked = asked.withColumn("gone", gone)
        after = moves.filter("shard = to").select("v", "shard", "n")
        after = after.unionByName(asked.select("v", F.col("to").alias("shard"), F.col("gone").alias("n"))).unionByName(asked.select("v", "shard", (F.col("n") - F.col("gone")).alias("n")))
        n_pieces = sum(r["pieces"] * (1 + (r["shard"] != r["to"])) for r in table)  # at most, as each that moves may be split
        pieces = materialize(after.filter("n > 0").groupBy("v", "shard").agg(F.sum("n").alias("n")), n_pieces)
    return pieces


def shard_documents(docs: DataFrame, n_shards: int = 24, links: DataFrame | None = None, rounds: int = 8) -> DataFrame:
    """Documents in ``n_shards`` shards whose counts are at most one apart, with few links cut.

    ``docs``: ``doc_id, text``; equal texts are linked, and ``links`` (``a, b``: doc_ids) may link more. Returns one row per document: ``doc_id, size`` (UTF-8 bytes plus 8),
    ``text_crc32, law`` (``rows``), ``shard, slot`` (gapless from 0 in the shard) and ``grown_shard`` (null under this law). Null texts count as empty. Null and repeated ids are rows
    like others; links of unknown or null ids are ignored. Ties: votes go by an order of the shards of each round, places by doc_id, then the text's hashes, then the row. An empty table gives an empty one.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(F.md5(text)).alias("v"), F.monotonically_increasing_id().alias("_row"))
    order = ["doc_id", "text_crc32", "v", "_row"]  # the row's number spreads repeated ids over tasks
    rows = materialize(rows)
    n = rows.count()
    rows = materialize(two_level_rank(rows, [], order, "_rank").withColumn("shard", F.pmod("_rank", F.lit(n_shards)).cast("int")).drop("_rank"), n)
    capacity = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]  # ranks have no gaps

    pieces = materialize(rows.groupBy("v", "shard").agg(F.count("*").alias("n")), n)
    linked = pieces.groupBy("v").agg(F.sum("n").alias("n")).filter("n > 1").select("v")
    edges = None
    if links is not None:
        ids = rows.filter("doc_id is not null").select("doc_id", "v").distinct()
        pairs = links.join(ids.select(F.col("doc_id").alias("a"), F.col("v").alias("_v")), "a").join(ids.select(F.col("doc_id").alias("b"), F.col("v").alias("_u")), "b").filter("_v <> _u")
        edges = materialize(pairs.select(F.col("_v").alias("v"), F.col("_u").alias("u")).union(pairs.select("_u", "_v")).distinct())
        linked = linked.union(edges.select("v")).distinct()
    pieces = propagate(materialize(pieces.join(linked, "v", "left_semi"), n), edges, capacity, rounds)

    placed = running_start(pieces.withColumn("v_order", F.col("v")), ["shard"], ["v_order"], "n", "slot").drop("v_order")
    upto = F.sum("n").over(W.partitionBy("v").orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    parts = placed.withColumn("first", F.coalesce(upto, F.lit(0))).groupBy("v").agg(F.array_sort(F.collect_list(F.struct("first", "shard", "slot"))).alias("parts"))
    load = [0] * n_shards
    for r in pieces.groupBy("shard").agg(F.sum("n")).collect():  # one row per shard
        load[r[0]] = r[1]
    free, first = [], 0
    for s in range(n_shards):
        if capacity[s] > load[s]:
            free.append(F.struct(F.lit(first).cast("long").alias("first"), F.lit(s).alias("shard"), F.lit(load[s]).cast("long").alias("slot")))
            first += capacity[s] - load[s]
    free = F.array(*free) if free else F.array().cast("array<struct<first:bigint,shard:int,slot:bigint>>")

    dealt = rows.drop("shard").join(parts, "v", "left")
    dealt = dealt.withColumn("parts", F.coalesce("parts", free)).withColumn("own", F.when(F.col("parts") != free, F.col("v")))
    ranked = two_level_rank(dealt.withColumn("own", F.coalesce(F.col("own").cast("string"), F.lit(""))), ["own"], order, "_rank")
    part = F.element_at(F.filter("parts", lambda p: p["first"] <= F.col("_rank")), -1)
    dealt = ranked.withColumn("_p", part).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_p.shard").alias("shard"), (F.col("_p.slot") + F.col("_rank") - F.col("_p.first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    return in_few_parts(dealt, n)
