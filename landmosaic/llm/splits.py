"""Splits that keep tied records together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmosaic.runtime import durable, ranked

#: A group of more than this share of all records is placed one by one on the driver: at most 1 / HEAVY_SHARE groups.
HEAVY_SHARE = 0.001
#: Rounds after which propagation gives up; each at least doubles the reach of a label.
MAX_ROUNDS = 60


def minimum_labels(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Label each ``right`` node with the least ``right`` node tied to it over ``left`` nodes.

    ``edges`` is bipartite: (left, right) pairs without nulls. Each round every
    left node takes the least label of its right nodes and gives it to them
    and to the nodes that were their labels; then labels are replaced by their
    labels. Only left nodes with several right nodes are kept for that, since
    the others tie nothing. Every step is a map-side combined minimum and each
    round ends in the shared folder. Ends when a round changes nothing.

    Returns (right, label) for right nodes that some left node ties to another;
    all others are their own label.
    """
    e = edges.select(F.col(left).alias("l"), F.col(right).alias("r")).distinct()
    ties = e.groupBy("l").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("l")
    e = durable(e.join(ties, "l"))
    labels = durable(e.select(F.col("r").alias("node"), F.col("r").alias("label")).distinct())
    for _ in range(MAX_ROUNDS):
        of_left = e.join(labels, e["r"] == labels["node"]).groupBy("l").agg(F.min("label").alias("m"))
        of_right = e.join(of_left, "l").groupBy("r").agg(F.min("m").alias("m"))
        both = labels.join(of_right, labels["node"] == of_right["r"])
        offers = both.select(F.explode(F.array(F.struct("node", F.least("label", "m").alias("label")), F.struct(F.col("label").alias("node"), F.col("m").alias("label")))).alias("o")).select("o.*")
        hooked = offers.groupBy("node").agg(F.min("label").alias("label"))
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = hooked.join(up, "label", "left").select("node", F.least("label", F.coalesce("above", "label")).alias("new"))
        after = durable(labels.join(jumped, "node").select("node", "new", (F.col("new") != F.col("label")).alias("moved")))
        labels = after.select("node", F.col("new").alias("label"))
        if not after.where("moved").limit(1).count():
            return labels.select(F.col("node").alias(right), "label")
    raise RuntimeError("label propagation did not settle")


def tied_groups(records: DataFrame, record: str, entity: str, place: str) -> DataFrame:
    """Group records tied by equal non-null ``entity`` or ``place``, directly or in steps.

    Returns (entity, place, group) for the distinct pairs, nulls included. A
    group that holds a place is named ``s:`` and its least place; one without,
    ``b:`` and its entity. The pair (null, null) ties nothing: its group is
    null and each such record stands alone. ``record`` isn't read.
    """
    pairs = durable(records.select(F.col(entity).alias("b"), F.col(place).alias("s")).distinct())
    labels = minimum_labels(pairs.where("b IS NOT NULL AND s IS NOT NULL"), "b", "s").withColumnRenamed("label", "s_label")
    # an entity's places all have one label, so its least place tells its group
    homes = pairs.where("b IS NOT NULL AND s IS NOT NULL").groupBy("b").agg(F.min("s").alias("s"))
    homes = homes.join(labels, "s", "left").select("b", F.coalesce("s_label", "s").alias("home"))
    placed = pairs.where("s IS NOT NULL").join(labels, "s", "left").select("b", "s", F.concat(F.lit("s:"), F.coalesce("s_label", "s")).alias("group"))
    loose = pairs.where("s IS NULL AND b IS NOT NULL").join(homes, "b", "left")
    loose = loose.select("b", "s", F.when(F.col("home").isNotNull(), F.concat(F.lit("s:"), "home")).otherwise(F.concat(F.lit("b:"), "b")).alias("group"))
    nothing = pairs.where("s IS NULL AND b IS NULL").select("b", "s", F.lit(None).cast("string").alias("group"))
    return placed.unionByName(loose).unionByName(nothing).toDF(entity, place, "group")


def record_groups(records: DataFrame, record: str, entity: str, place: str) -> DataFrame:
    """(record, entity, place, group) of each distinct record; a record that is tied to nothing is a group ``r:`` and its key.

    Pairs are joined back in two steps, on the place and, for records without
    one, on the entity, both null-safe. The pair table is aggregated, so a hot
    place repeats on the record side only, which AQE may split.
    """
    slim = records.select(record, entity, place).distinct()
    groups = tied_groups(records, record, entity, place).withColumnsRenamed({entity: "_b", place: "_s"})
    by_place = groups.where("_s IS NOT NULL").groupBy("_s").agg(F.min("group").alias("_g1"))
    by_entity = groups.where("_s IS NULL AND _b IS NOT NULL").select("_b", F.col("group").alias("_g2"))
    out = slim.join(by_place, F.col(place) == F.col("_s"), "left").join(by_entity, (F.col(entity) == F.col("_b")) & F.col(place).isNull(), "left")
    own = F.concat(F.lit("r:"), F.coalesce(F.col(record).cast("string"), F.lit("")))
    return out.select(record, entity, place, F.coalesce("_g1", "_g2", own).alias("group"))


def broken_groups(records: DataFrame, splits: DataFrame, record: str, entity: str, place: str) -> DataFrame:
    """The entities of groups that hold a place and whose records now have more than one split.

    ``splits`` has (record, split); null splits say nothing. Splits are folded
    to a bit set per pair before the groups are joined. Returns (entity,
    group_place): each non-null entity with the least place of its group.
    """
    per_record = splits.where(F.col("split").isNotNull()).groupBy(record).agg(F.bit_or(F.expr("shiftleft(1, cast(split AS int))")).alias("bits"))
    per_pair = durable(records.select(record, entity, place).distinct().join(per_record, record, "left").groupBy(entity, place).agg(F.bit_or(F.coalesce("bits", F.lit(0))).alias("bits")))
    groups = tied_groups(records, record, entity, place).withColumnsRenamed({entity: "_b", place: "_s"})
    joined = durable(per_pair.join(groups, F.col(entity).eqNullSafe(F.col("_b")) & F.col(place).eqNullSafe(F.col("_s"))).where("group LIKE 's:%'").select(entity, "group", "bits"))
    broken = joined.groupBy("group").agg(F.bit_or("bits").alias("all")).where(F.expr("bit_count(all) > 1")).select("group")
    return joined.where(F.col(entity).isNotNull()).select(entity, "group").distinct().join(broken, "group").select(entity, F.expr("substring(group, 3)").alias("group_place"))


def assign_splits(grouped: DataFrame, label: str, shares: tuple[float, ...] = (0.8, 0.1, 0.1), heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """Give each group one split so that every split has its share of every label.

    ``grouped`` has one row per record with ``group`` and ``label`` (null is a
    label; there may be any number of labels). Groups with more than
    ``heavy_share`` of all records (at most 1 / heavy_share of them) are placed
    one by one, largest first, where the squared deviation from the target
    label counts grows least; there, labels with no more than ``heavy_share``
    of all records count as one label together, so that what the driver holds
    is bounded by the shares, not by the data. The rest are stratified by
    their main label and size: neighbours in that order go to the splits in a
    low-discrepancy sequence that runs on from label to label, so that rare
    labels together have the shares too, in proportion to what the heavy
    groups left open for each label. Nothing is random: equal input gives
    equal splits. Returns (group, split) with splits numbered as ``shares``.
    """
    spark = grouped.sparkSession
    mark = F.coalesce(F.col(label).cast("string"), F.lit("\0null"))
    counts = durable(grouped.groupBy("group", mark.alias("lab")).agg(F.count(F.lit(1)).alias("n")))
    totals = durable(counts.groupBy("lab").agg(F.sum("n").alias("total")))
    everything = totals.agg(F.sum("total")).first()[0] or 0
    big = F.lit(heavy_share * everything)
    sizes = durable(counts.groupBy("group").agg(F.sum("n").alias("size"), F.max_by("lab", F.struct("n", "lab")).alias("main")))
    heavy = sizes.where(F.col("size") > big).select("group")
    common = {r["lab"]: r["total"] for r in totals.where(F.col("total") > big).collect()}  # at most 1 / heavy_share
    target = common | {None: everything - sum(common.values())}
    of_heavy = durable(counts.join(F.broadcast(heavy), "group"))  # at most 1 / heavy_share groups
    kept = totals.where(F.col("total") > big).select("lab", F.col("lab").alias("common"))
    rows: dict[str, dict[str | None, int]] = {}
    for r in of_heavy.join(F.broadcast(kept), "lab", "left").groupBy("group", "common").agg(F.sum("n").alias("n")).collect():
        rows.setdefault(r["group"], {})[r["common"]] = r["n"]
    got: list[dict[str | None, int]] = [{} for _ in shares]
    placed: list[tuple[str, int]] = []
    for g, have in sorted(rows.items(), key=lambda x: (-sum(x[1].values()), x[0])):

        def cost(k: int, have: dict[str | None, int] = have) -> float:
            out = 0.0
            for lab, n in have.items():
                t = max(1e-9, shares[k] * target[lab])
                a = got[k].get(lab, 0)
                out += ((a + n - t) ** 2 - (a - t) ** 2) / t
            return out

        k = min(range(len(shares)), key=lambda k: (cost(k), k))
        for lab, n in have.items():
            got[k][lab] = got[k].get(lab, 0) + n
        placed.append((g, k))
    homes = spark.createDataFrame(placed, "group string, split int")
    # what the heavy groups hold of each label and split, and with it what is open: one row for each label
    held = of_heavy.join(F.broadcast(homes), "group").groupBy("lab").agg(*[F.sum(F.when(F.col("split") == k, F.col("n")).otherwise(0)).alias(f"held{k}") for k in range(len(shares))])
    left = [F.greatest(F.lit(0.0), F.lit(s) * F.col("total") - F.coalesce(f"held{k}", F.lit(0))) for k, s in enumerate(shares)]
    open_ = totals.join(held, "lab", "left").select(F.col("lab").alias("main"), *[x.alias(f"open{k}") for k, x in enumerate(left)])
    whole = sum((F.col(f"open{k}") for k in range(1, len(shares))), F.col("open0"))
    light = ranked(sizes.join(F.broadcast(heavy), "group", "left_anti"), ["main", "size", F.xxhash64("group"), "group"])
    light = light.join(open_, "main", "left").withColumn("at", F.expr("pmod((rank0 + 1) * 0.6180339887498949D, 1.0D)") * whole)
    pick, edge = F.lit(len(shares) - 1), None
    for k in reversed(range(len(shares) - 1)):
        edge = sum((F.col(f"open{i}") for i in range(1, k + 1)), F.col("open0"))
        pick = F.when(F.col("at") < edge, F.lit(k)).otherwise(pick)
    return light.select("group", F.when(whole > 0, pick).otherwise(0).alias("split")).unionByName(homes)
