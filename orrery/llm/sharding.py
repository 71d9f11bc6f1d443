"""Balanced sharding by label propagation. Built-in functions only.

Documents are linked when they share a key (here: equal texts). They start in the shard that a hash of the id gives.
Then, round by round, a join of each key's counts with the shard that most of its documents are in (of those with room
left) proposes moves; the room of a shard, its quota, is dealt to the proposals from the largest groups down, and the
admitted ones move; smaller groups make way for larger ones and go on as whole groups. All of this happens on rows (key, shard, count), of which a key has at most one per shard, so a key
that a third of all documents share is no longer than any other. A group larger than a shard fills one after another.
At last documents without links fill every shard up to its exact size.

Law `rows`: counts differ by one at most. Ranks come from counts of chunks and ranks inside chunks, so no task ever
holds a whole shard.

Defined results: a null text has size 1, the crc32 of the empty text and is linked to empty texts; repeated rows are
linked like equal texts; ties in ranks fall between rows that are equal in every column; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from orrery.llm.common import Stage, plain, table

ROUNDS = 8
#: Rows in a chunk of the ranking, about.
CHUNK = 50_000
UNIT = 1 << 30


def fraction(*cols: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(UNIT)) / UNIT


def ranked(rows: DataFrame, group: str, chunk: Column, order: list[str]) -> DataFrame:
    """rows with `rank`, gapless from 0 in each group: by chunk, then by order. Chunks are counted first."""
    rows = rows.withColumn("_chunk", chunk)
    counts = rows.groupBy(group, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select(group, "_chunk", before.alias("_base"))
    inside = F.row_number().over(Window.partitionBy(group, "_chunk").orderBy(*order))
    return rows.join(base, [group, "_chunk"]).withColumn("rank", F.col("_base") + inside - 1).drop("_base", "_chunk")


def lookup(values: list, at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), at + 1)


def propagate(state: DataFrame, stage: Stage, shards: int, room: list[int], rounds: int = ROUNDS) -> DataFrame:
    """state: (key, shard, n, size), size being all of the key's documents. Returns (key, shard, n) after propagation;
    room[s] bounds the linked documents in shard s, but for rounding and what hashes deal unevenly."""
    now = stage.put(state.withColumn("class", F.floor(F.log2("size")).cast("int")), "state0")
    for r in range(1, rounds + 1):
        load: dict[tuple[int, int], int] = {(x["shard"], x["class"]): x["n"] for x in now.groupBy("shard", "class").agg(F.sum("n").alias("n")).collect()}
        classes = sorted({c for _, c in load}, reverse=True)
        # Documents of larger groups come before those of smaller ones, which later make way as whole groups.
        free = {(s, c): max(0, room[s] - sum(load.get((s, k), 0) for k in classes if k >= c)) for s in range(shards) for c in classes}
        if not free:
            break
        spare = F.create_map(*(F.lit(v) for (s, c), f in free.items() for v in (s * 64 + c, f)))[F.col("shard") * 64 + F.col("class")]
        here = F.struct("n", (-F.col("shard")).alias("s"))
        target = now.groupBy("key").agg(F.max(F.when(spare > 0, here)).alias("_best"))
        target = target.select("key", (-F.col("_best.s")).alias("target"), F.col("_best.n").alias("have"))
        # A shard keeps what it has of a group unless an open one has more; ties go to the smaller shard.
        wish = now.join(target, "key").filter("target is not null and (n < have or (n = have and shard > target))")
        asked = {(x["target"], x["class"]): x["n"] for x in wish.groupBy("target", "class").agg(F.sum("n").alias("n")).collect()}
        if not asked:
            break
        admitted: dict[tuple[int, int], float] = {}
        taken = [0] * shards
        for t, c in sorted(asked, key=lambda x: (-x[1], x[0])):
            most = max(0, free[t, c] - taken[t])
            admitted[t, c] = min(1.0, most / asked[t, c])
            taken[t] += min(most, asked[t, c])
        share = F.coalesce(*(F.when((F.col("target") == t) & (F.col("class") == c), F.lit(f)) for (t, c), f in admitted.items()))
        # Small groups move whole or stay; of large ones the admitted share moves.
        whole = F.when(fraction("key", F.lit(r)) < F.col("_share"), F.col("n")).otherwise(F.lit(0))
        part = F.ceil(F.col("n") * F.col("_share"))
        moved = wish.withColumn("_share", share).withColumn("moved", F.when(F.col("_share") >= 1, F.col("n")).when(F.col("size") * shards * 16 < sum(room), whole).otherwise(part))
        moved = moved.filter("moved > 0").select("key", "shard", "target", "moved", "size", "class")
        gone = moved.select("key", "shard", (-F.col("moved")).alias("n"), "size", "class")
        come = moved.select("key", F.col("target").alias("shard"), F.col("moved").alias("n"), "size", "class")
        new = now.unionByName(gone).unionByName(come).groupBy("key", "shard").agg(F.sum("n").alias("n"), F.first("size").alias("size"), F.first("class").alias("class")).filter("n > 0")
        now = stage.put(new.select(now.columns), f"state{r}")
        stage.drop(f"state{r - 1}")
    return now


def assign(rows: DataFrame, stage: Stage, shards: int = 8, rounds: int = ROUNDS) -> DataFrame:
    """rows: doc_id, key and others -> with shard and slot. Every shard gets its exact share of the rows."""
    own = [c for c in rows.columns if c != "key"]
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    chunks = max(1, total // shards // CHUNK + 1)
    rows = rows.withColumn("start", F.pmod(F.xxhash64("doc_id", F.lit("start")), F.lit(shards)).cast("int"))
    counts = rows.groupBy("key", "start").agg(F.count(F.lit(1)).alias("n"))
    by_key = counts.groupBy("key").agg(F.sum("n").alias("size"), F.collect_list(F.struct(F.col("start").alias("shard"), "n")).alias("_at")).filter("size > 1")
    state = by_key.select("key", F.explode("_at").alias("_at"), "size").select("key", "_at.shard", "_at.n", "size")
    placed = propagate(state, stage, shards, quota, rounds)
    # For each key the shares of its documents by shard, at most one for each shard.
    deal = placed.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("at"), F.sum("n").alias("size"))
    upto = F.transform("at", lambda x, i: F.struct(x["shard"].alias("shard"), (F.aggregate(F.slice("at", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, y: a + y["n"]) / F.col("size")).alias("upto")))
    deal = deal.select("key", upto.alias("at"), F.col("size").alias("size_of"))
    met = rows.join(deal, "key", "left").withColumn("u", fraction("doc_id", F.lit("deal")))
    shard = F.get(F.filter("at", lambda x: F.col("u") < x["upto"]), F.lit(0))["shard"]
    # A group of many documents is ranked by chunks of its documents, so that it is in no task as a whole.
    met = stage.put(met.select(*own, "key", shard.alias("want"), (F.col("size_of") * shards * 16 >= total).alias("many")), "met")
    # Split groups, then others with equal keys together: what exceeds a quota is whole groups, and goes on as such.
    early = F.pmod(F.xxhash64("doc_id"), F.lit(chunks))
    late = F.pmod(F.xxhash64("key"), F.lit(chunks)) + chunks
    linked = stage.put(ranked(met.filter("want is not null"), "want", F.when(F.col("many"), early).otherwise(late), ["key", "doc_id"]), "linked")
    held = [0] * shards
    for x in linked.groupBy("want").agg(F.count(F.lit(1)).alias("n")).collect():
        held[x["want"]] = x["n"]
    over = [max(0, h - q) for h, q in zip(held, quota)]
    over_before = [sum(over[:s]) for s in range(shards)]
    fill = [min(h, q) for h, q in zip(held, quota)]
    room = [q - f for q, f in zip(quota, fill)]
    upper = [sum(room[: s + 1]) for s in range(shards)]
    stay = linked.filter(F.col("rank") < lookup(quota, F.col("want"))).select(*own, F.col("want").alias("shard"), F.col("rank").alias("slot"))
    excess = linked.filter(F.col("rank") >= lookup(quota, F.col("want"))).select(*own, (F.col("rank") - lookup(quota, F.col("want")) + lookup(over_before, F.col("want"))).alias("rank"))
    single = met.filter("want is null").select(*own, F.lit(0).alias("one"))
    single = ranked(single, "one", F.pmod(F.xxhash64("doc_id"), F.lit(chunks * shards)), ["doc_id"]).select(*own, (F.col("rank") + sum(over)).alias("rank"))
    rest = excess.unionByName(single)
    place = F.coalesce(*(F.when(F.col("rank") < u, F.lit(s)) for s, u in enumerate(upper)))
    rest = rest.withColumn("shard", place).withColumn("slot", F.col("rank") - lookup([u - m for u, m in zip(upper, room)], F.col("shard")) + lookup(fill, F.col("shard")))
    return stay.unionByName(rest.select(stay.columns))


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.col("text").cast("binary")
    return plain(docs, id_col, text_col).select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("key"))


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    stage = Stage(docs.sparkSession, "sharding")
    out = assign(stage.put(describe(docs, id_col, text_col), "rows"), stage, shards, rounds)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
