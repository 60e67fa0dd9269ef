"""Exact deduplication by deterministic block naming, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize
from .ranking import numbered

#: More distinct blocks than this that share a 64-bit hash would mean a broken hash.
MOST_TIES = 10_000


def _hash(content: Column, bits: int) -> Column:
    return F.xxhash64(content).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1).cast("long"))


def _ranked(block: Column, ties: dict, bits: int) -> Column:
    """A block's hash, and its rank among the distinct blocks with that hash (nearly always 0)."""
    rank = F.lit(0)
    if ties:
        ranks = F.create_map(*[F.lit(x) for item in ties.items() for x in item])
        rank = F.coalesce(F.try_element_at(ranks, block), F.lit(0))
    return F.struct(_hash(block, bits).alias("h"), rank.cast("int").alias("r"))


def _ties(distinct: DataFrame, bits: int) -> dict:
    """Distinct blocks (column content) that share a hash, with their rank in sorted order where it isn't 0.

    Only hashes are shuffled to find them. With 64 bits, n distinct blocks give about n * n / 2**65 ties, so what
    reaches the driver is small at any size; more than MOST_TIES raises.
    """
    hashed = distinct.withColumn("h", _hash(F.col("content"), bits))
    shared = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    n_shared = len(shared.limit(MOST_TIES + 1).collect())
    if n_shared > MOST_TIES:
        raise RuntimeError(f"over {MOST_TIES} hashes are shared by different blocks")
    if not n_shared:
        return {}
    rows = hashed.join(shared, "h", "left_semi").select("h", "content").sort("h", "content").collect()
    out, last, rank = {}, None, 0
    for row in rows:
        rank = rank + 1 if row["h"] == last else 0
        last = row["h"]
        if rank:
            out[bytes(row["content"])] = rank
    return out


def _integers(names: DataFrame) -> DataFrame:
    """The distinct rows in sorted order, each with its place as its integer name."""
    columns = names.columns
    return numbered(materialize(names.distinct(), "distinct-names"), [F.col(c).asc_nulls_first() for c in columns], "name")


def name_texts(docs: DataFrame, block_bytes: int = 4096, bits: int = 64) -> DataFrame:
    """doc_id, text_sha256, n_blocks, name: two rows have the same name (a long) exactly when their texts are equal.

    Texts are cut into blocks of block_bytes bytes. The distinct blocks are sorted, by hash and then by content among those few that share a hash, and a
    block's place in that order is its integer name. Adjacent names form pairs; the distinct pairs are sorted and named in the same way, level by
    level, until each text has one name. With its level, that is the text's identity: no two texts share it.

    Texts are shuffled once, as distinct blocks after map-side aggregation; beyond that a block is its hash and its rank among blocks of that hash. Texts of the
    same blocks are named once, so a text that fills half of all rows is one row here; later levels shuffle pairs of integers, half as many each time.
    More than MOST_TIES different blocks that share a 64-bit hash (expected: n * n / 2**65 of n blocks) raise an error rather than name anything wrongly.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    cut = docs.select(F.col("doc_id"), F.sha2(raw, 256).alias("text_sha256"), raw.alias("raw")).withColumn(
        "n_blocks", F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / block_bytes)).cast("int")
    )
    pieces = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda i: F.substring(F.col("raw"), i * block_bytes + 1, F.lit(block_bytes)))
    blocks = cut.select("doc_id", "text_sha256", "n_blocks", pieces.alias("blocks"))
    ties = _ties(blocks.select(F.explode("blocks").alias("content")).distinct(), bits)
    rows = materialize(blocks.select("doc_id", "text_sha256", "n_blocks", F.transform("blocks", lambda b: _ranked(b, ties, bits)).alias("blocks")), "block-hashes")
    texts = materialize(rows.groupBy("blocks").agg(F.count(F.lit(1)).alias("n")).select("blocks", F.monotonically_increasing_id().alias("text")), "distinct-texts")
    places = texts.select("text", F.size("blocks").alias("size"), F.posexplode("blocks").alias("pos", "block")).select("text", "size", "pos", "block.h", "block.r")
    level = materialize(places.join(_integers(places.select("h", "r")), ["h", "r"]).select("text", "size", "pos", "name"), "block-names")
    done, depth = [], 0
    while True:
        done.append(level.where("size = 1").select("text", (F.shiftleft("name", 6) + F.lit(depth)).alias("name")))
        open_ = level.where("size > 1")
        if open_.isEmpty():
            break
        side = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
        pairs = open_.groupBy("text", F.expr("pos div 2").alias("pos")).agg(side(0).alias("a"), side(1).alias("b"), F.expr("max((size + 1) div 2)").alias("size"))
        pairs = materialize(pairs, "pairs")
        named = _integers(pairs.select("a", "b")).toDF("n_a", "n_b", "name")
        level = materialize(pairs.join(named, (F.col("a") == F.col("n_a")) & F.col("b").eqNullSafe(F.col("n_b"))).select("text", "size", "pos", "name"), "pair-names")
        depth += 1
    names = done[0]
    for part in done[1:]:
        names = names.unionAll(part)
    identities = texts.join(names, "text").select(F.col("blocks").alias("own"), "name")
    return rows.join(identities, F.col("blocks") == F.col("own")).select("doc_id", "text_sha256", "n_blocks", "name")


def exact_dedup(docs: DataFrame, block_bytes: int = 4096, bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text).

    Texts are equal when their bytes are; a null text is an empty one. The largest doc_id of a group stays (a null id
    only where all are null); rows that repeat that id are all marked kept. No rows give no rows; other columns are
    ignored. Groups are counted with map-side aggregation and joined back on their name, where Spark splits hot names. See name_texts for
    the (practically impossible) case in which it raises.
    """
    named = materialize(name_texts(docs, block_bytes, bits), "named-texts")
    groups = named.groupBy("name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return named.join(groups, "name").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
