"""Operator 10: mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .anchors import ordered, unordered
from .common import WORD, cut, lookup_join


#: A prime above any shard's number of blocks, by which their order is permuted.
STRIDE = 2147483647


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[int], repeats: int) -> DataFrame:
    """(source, size) -> and rank, target: weight shares of the total, none above `repeats` times its size.

    A source is full where its share of what the fuller ones leave reaches its bound; sorted by bound a weight,
    the full ones are a prefix, so one running sum settles what repeated resharing would.
    """
    order = F.col("source").asc_nulls_last()
    ranked = sources.withColumn("source_rank", F.row_number().over(Window.orderBy(order)).cast("long"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.pmod(F.col("source_rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    before = Window.orderBy(F.col("size").cast("double") / F.col("weight"), "source_rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        ranked.withColumn("all_size", F.sum("size").over(whole))
        .withColumn("all_weight", F.sum("weight").over(whole))
        .withColumn("size_before", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("full", (F.col("all_size") - repeats * F.col("size_before")) * F.col("weight") >= repeats * F.col("size") * (F.col("all_weight") - F.col("weight_before")))
        .withColumn("full_size", F.coalesce(F.sum(F.when(F.col("full"), F.col("size"))).over(whole), F.lit(0)))
        .withColumn("full_weight", F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(whole), F.lit(0)))
    )
    share = (F.col("weight") * (F.col("all_size") - repeats * F.col("full_size"))).cast("double") / (F.col("all_weight") - F.col("full_weight")).cast("double")
    target = F.when(F.col("full"), (repeats * F.col("size")).cast("double")).otherwise(share)
    return ranked.select("source", "size", "source_rank", "all_size", target.alias("target"))


def sainte_lague(parties: DataFrame, party: Sequence[str], votes: str, seats: Column, group: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Column `seats`: how many of its group's seats each party gets by the highest quotients votes / (2k + 1).

    Every party surely gets the seats that lie some way below its rounded quota, and none that lie as far above;
    only the quotients between are ranked. That width is two and half the number of parties by its share, so all
    candidates together stay proportional to the number of parties. Ties go by `order`, then k.
    """
    whole = Window.partitionBy(*group) if group else Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = F.col(votes).cast("double")
    total, n = F.sum(v).over(whole), F.count(F.lit(1)).over(whole)
    p = parties.withColumn("__all", seats.cast("long")).withColumn("__share", F.when(total > 0, v / total).otherwise(F.lit(0.0)))
    p = p.withColumn("__width", F.lit(2) + F.ceil(F.col("__share") * n / 2)).withColumn("__near", F.floor(F.col("__share") * F.col("__all") + 0.5))
    p = p.withColumn("__low", F.greatest(F.lit(0), F.col("__near") - F.col("__width"))).withColumn("__high", F.col("__near") + F.col("__width"))
    p = p.withColumn("__sure", F.sum("__low").over(whole))
    ranked = p.select("*", F.explode(F.sequence(F.col("__low"), F.col("__high") - 1)).alias("__k"))
    quotient = v / (2 * F.col("__k") + 1).cast("double")
    ranked = ranked.withColumn("__rank", F.row_number().over((Window.partitionBy(*group) if group else Window).orderBy(quotient.desc(), *order, "__k")))
    won = (F.col("__rank") <= F.col("__all") - F.col("__sure")) & (v > 0)
    return ranked.groupBy(*group, *party).agg((F.first("__low") + F.count(F.when(won, F.lit(1)))).alias("seats"))


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int], repeats: int, block: int, shard_words: int, least_shard: int, seed: int) -> DataFrame:
    """doc_id, size, source_size, target, copies, picks: whole copies that the mix takes of a document, and the word
    ranges (lo, hi) of it that it takes once more."""
    seeded = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), seeded.alias("seeded")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("size"))
    targets = cut(source_targets(sources, weights, repeats))
    blocks = F.floor(F.first("all_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / block + 0.5)
    won = sainte_lague(targets, ["source_rank"], "target", blocks, order=["source_rank"])
    shards_of = F.greatest(F.ceil(F.col("size") / shard_words), F.least(F.lit(8), F.greatest(F.lit(1), F.ceil(F.col("size") / least_shard))))
    plan = cut(targets.join(won, "source_rank").select("source", "source_rank", F.col("size").alias("source_size"), "target", F.col("seats").alias("source_blocks"), shards_of.alias("shards")))
    rows = lookup_join(sized, plan, ["source"], F.xxhash64("doc_id"))
    nothing = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    empty = rows.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("copies"), nothing.alias("picks"))
    rows = rows.where("size > 0").withColumn("shard", F.pmod(F.conv(F.substring("seeded", 1, 8), 16, 10).cast("long"), F.col("shards")))
    shards = rows.groupBy("source_rank", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_blocks").alias("source_blocks"))
    seats = sainte_lague(shards, ["shard"], "shard_size", F.col("source_blocks"), group=["source_rank"], order=["shard"])
    quotas = shards.join(seats, ["source_rank", "shard"]).withColumn("quota", F.least(F.col("seats") * block, repeats * F.col("shard_size")))
    # block j of a shard's line of words has place (STRIDE * j + turn) mod blocks in the seeded order; the last is short
    turn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "source_rank", "shard")), 1, 8), 16, 10).cast("long")
    quotas = quotas.withColumn("blocks", F.expr(f"(shard_size + {block - 1}) div {block}")).withColumn("turn", turn).withColumn("short", F.expr(f"blocks * {block} - shard_size"))
    quotas = quotas.withColumn("short_place", F.expr(f"({STRIDE} * (blocks - 1) + turn) % blocks"))
    quotas = quotas.select(F.col("source_rank").alias("q_source"), F.col("shard").alias("q_shard"), "blocks", "turn", "short", "short_place", F.expr("quota div shard_size").alias("copies"), F.expr("quota % shard_size").alias("once"))
    laid = rows.withColumn("before", F.sum("size").over(Window.partitionBy("source_rank", "shard").orderBy("seeded", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    laid = laid.join(quotas, (F.col("source_rank") == F.col("q_source")) & (F.col("shard") == F.col("q_shard")))
    place = f"({STRIDE} * j + turn) % blocks"
    room = f"least({block}, once - ({block} * ({place}) - if({place} > short_place, short, 0)))"
    taken = f"struct(greatest(before, {block} * j) - before AS lo, least(before + size, {block} * j + {room}) - before AS hi)"
    picks = F.expr(f"filter(transform(sequence(before div {block}, (before + size - 1) div {block}), j -> {taken}), p -> p.hi > p.lo)")
    return empty.union(laid.select("doc_id", "size", "source_size", "target", "copies", F.when(F.col("once") > 0, picks).otherwise(nothing).alias("picks")))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    repeats: int = 3,
    block: int = 16,
    shard_words: int = 1 << 22,
    least_shard: int = 1 << 12,
    seed: int = 42,
) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row.

    Blocks of `block` words go to sources by Sainte-Laguë over their targets, then within each source to its
    shards (documents by seeded hash, of at most about `shard_words` words, and up to 8 of at least `least_shard`)
    over their words. A shard's documents are one line of words, cut into blocks; it takes all of them as often as its
    quota allows, and blocks in a seeded order for the rest, the last in part. Reruns give the same rows.

    Null text has size 0 and so has text of white space only; such rows take 0. A null source is one source, the
    last. A null id is an id like any other. Rows that repeat an id count each for themselves; ties of the seeded
    order go by id, then size. Texts of any length are counted whole. Other columns may have any names. No rows: none.
    With fewer words in all than half a block nothing is taken.
    """
    mixed = _mix(docs, id_col, text_col, source_col, weights, repeats, block, shard_words, least_shard, seed)
    taken = F.col("copies") * F.col("size") + F.expr("aggregate(picks, 0L, (s, p) -> s + p.hi - p.lo)")
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mix_texts(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), repeats: int = 3, block: int = 16, shard_words: int = 1 << 22, least_shard: int = 1 << 12, seed: int = 42) -> DataFrame:
    """The mix as documents: each one's text as often as it is taken whole, and once with the words of its blocks taken
    besides.

    Repeats are rows of their own under the same id; n_chars is renewed. Rows that share an id or have none are
    documents of their own.
    """
    rows = ordered(docs, keep=[c for c in docs.columns if c not in ("doc_id", "text")])
    mixed = _mix(rows.select("uid", "text", F.col("row._source").alias("source")), "uid", "text", "source", weights, repeats, block, shard_words, least_shard, seed)
    counts = mixed.where("copies > 0 OR size(picks) > 0").select(F.col("doc_id").alias("__id"), F.col("copies").alias("__copies"), F.col("picks").alias("__picks"))
    rows = rows.join(counts, F.col("uid") == F.col("__id"))
    rows = rows.withColumn("__copy", F.explode(F.expr("sequence(if(size(__picks) > 0, 0L, 1L), __copies)")))
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    # the words are bound to a variable: beside it they would be found again for every pick
    chosen = lambda ws: F.array_join(F.flatten(F.transform("__picks", lambda p: F.slice(ws, p["lo"].cast("int") + 1, (p["hi"] - p["lo"]).cast("int")))), "")
    part = F.element_at(F.transform(F.array(words), chosen), 1)
    rows = rows.withColumn("text", F.when(F.col("__copy") == 0, part).otherwise(F.col("text")))
    return unordered(rows, docs, n_chars=F.length("text").cast("long"))


QUERY = {"op10_mix_sources": lambda spark, sf_dir: mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))}

ORACLE = {
    "op10_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, 'null')) AS seeded FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank FROM src),
weighed AS (SELECT *, ((source_rank - 1) % 3) + 1 AS weight FROM ranked),
sums AS (SELECT *, sum(size) OVER () AS all_size, sum(weight) OVER () AS all_weight,
  coalesce(sum(size) OVER w, 0) AS size_before, coalesce(sum(weight) OVER w, 0) AS weight_before
  FROM weighed WINDOW w AS (ORDER BY size::DOUBLE / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fulls AS (SELECT *, (all_size - 3 * size_before) * weight >= 3 * size * (all_weight - weight_before) AS is_full FROM sums),
tot AS (SELECT *, coalesce(sum(CASE WHEN is_full THEN size END) OVER (), 0) AS full_size,
  coalesce(sum(CASE WHEN is_full THEN weight END) OVER (), 0) AS full_weight FROM fulls),
tgt AS (SELECT source, size, source_rank, all_size, CASE WHEN is_full THEN (3 * size)::DOUBLE
  ELSE (weight * (all_size - 3 * full_size))::DOUBLE / (all_weight - full_weight)::DOUBLE END AS target FROM tot),
quota AS (SELECT *, floor(all_size / 16.0::DOUBLE + 0.5)::BIGINT AS blocks, CASE WHEN sum(target) OVER () > 0 THEN target / sum(target) OVER () ELSE 0.0 END AS share, count(*) OVER () AS n FROM tgt),
near AS (SELECT *, 2 + ceil(share * n / 2)::BIGINT AS width, floor(share * blocks + 0.5)::BIGINT AS near_seats FROM quota),
bounds AS (SELECT *, greatest(0, near_seats - width) AS low, near_seats + width AS high FROM near),
sure AS (SELECT *, sum(low) OVER () AS sure_seats FROM bounds),
cand AS (SELECT *, unnest(range(low, high)) AS k FROM sure),
rnk AS (SELECT *, row_number() OVER (ORDER BY target / (2 * k + 1)::DOUBLE DESC, source_rank, k) AS r FROM cand),
won AS (SELECT source_rank, min(low) + count(*) FILTER (WHERE r <= blocks - sure_seats AND target > 0) AS seats FROM rnk GROUP BY source_rank),
plan AS (SELECT tgt.*, seats AS source_blocks, greatest(ceil(size / 4194304.0), least(8, greatest(1, ceil(size / 4096.0))))::BIGINT AS shards FROM tgt JOIN won USING (source_rank)),
found AS (SELECT s.*, p.size AS source_size, p.target, p.source_rank, p.source_blocks, ('0x' || substr(s.seeded, 1, 8))::BIGINT % p.shards AS shard
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
placed AS (SELECT * FROM found WHERE size > 0),
sh AS (SELECT source_rank, shard, sum(size)::BIGINT AS shard_size, min(source_blocks) AS source_blocks FROM placed GROUP BY ALL),
shq AS (SELECT *, shard_size::DOUBLE / sum(shard_size::DOUBLE) OVER w AS share, count(*) OVER w AS n FROM sh WINDOW w AS (PARTITION BY source_rank)),
shn AS (SELECT *, 2 + ceil(share * n / 2)::BIGINT AS width, floor(share * source_blocks + 0.5)::BIGINT AS near_seats FROM shq),
shb AS (SELECT *, greatest(0, near_seats - width) AS low, near_seats + width AS high FROM shn),
shs AS (SELECT *, sum(low) OVER (PARTITION BY source_rank) AS sure_seats FROM shb),
shc AS (SELECT *, unnest(range(low, high)) AS k FROM shs),
shr AS (SELECT *, row_number() OVER (PARTITION BY source_rank ORDER BY shard_size::DOUBLE / (2 * k + 1)::DOUBLE DESC, shard, k) AS r FROM shc),
shw AS (SELECT source_rank, shard, min(shard_size) AS shard_size, least(16 * (min(low) + count(*) FILTER (WHERE r <= source_blocks - sure_seats)), 3 * min(shard_size)) AS quota FROM shr GROUP BY source_rank, shard),
line AS (SELECT *, (shard_size + 15) // 16 AS blocks, ('0x' || substr(md5('42:' || source_rank::VARCHAR || ':' || shard::VARCHAR), 1, 8))::BIGINT AS turn FROM shw),
shp AS (SELECT *, blocks * 16 - shard_size AS short, (2147483647 * (blocks - 1) + turn) % blocks AS short_place, quota // shard_size AS copies, quota % shard_size AS once FROM line),
laid AS (SELECT p.*, (sum(size) OVER (PARTITION BY source_rank, shard ORDER BY seeded, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before_words FROM placed p),
block AS (SELECT l.*, q.*, unnest(range(before_words // 16, (before_words + size - 1) // 16 + 1)) AS j FROM laid l JOIN shp q ON l.source_rank = q.source_rank AND l.shard = q.shard),
rank AS (SELECT *, (2147483647 * j + turn) % blocks AS place FROM block),
room AS (SELECT *, least(16, once - (16 * place - CASE WHEN place > short_place THEN short ELSE 0 END)) AS room FROM rank)
SELECT doc_id, size, source_size, target, (min(copies) * size + sum(greatest(0, least(before_words + size, 16 * j + room) - greatest(before_words, 16 * j))))::BIGINT AS taken
FROM room GROUP BY doc_id, seeded, size, source_size, target, source_rank, shard, before_words
UNION ALL SELECT doc_id, size, source_size, target, 0 FROM found WHERE size = 0
"""
}
