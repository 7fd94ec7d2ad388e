"""Operator 7: best-fit packing of tokenised documents into fixed-size sequences, in bulk-synchronous sweeps."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare, word_hashes, words_by_block

LENGTH, END = 2048, 0
#: Words whose ids a worker keeps; beyond that it starts afresh, which costs time only.
CACHED_WORDS = 1_000_000
#: Pieces and slots that one task sorts and sweeps.
TASK_ROWS = 500_000


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of texts by a tokenizer that drops white space, so that a text's ids are those of its words in turn."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # threads cost more than words take; tasks fill the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def block(self, part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each word)."""
        if len(starts) == 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        keys, first, back = np.unique(word_hashes(part, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > CACHED_WORDS:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool) if len(self.keys) == 0 else self.keys[np.minimum(at, len(self.keys) - 1)] != keys
        if new.any():
            raw = part.tobytes()
            words = [raw[s:e].decode() for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            coded = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            sizes = np.array([len(c) for c in coded], np.int64)
            flat = np.fromiter(chain.from_iterable(coded), np.uint32, int(sizes.sum()))
            rows = len(self.at) - 1 + np.arange(len(coded))
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, flat])
            where = np.searchsorted(self.keys, keys[new])
            self.keys, self.rows = np.insert(self.keys, where, keys[new]), np.insert(self.rows, where, rows)
            at = np.searchsorted(self.keys, keys)
        row = self.rows[at][back]
        size = self.at[row + 1] - self.at[row]
        total = np.cumsum(size)
        source = np.repeat((self.at[row] - (total - size)).astype(np.int32), size)
        source += np.arange(int(total[-1]), dtype=np.int32)
        return self.flat[source], size


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def cut_pieces(docs: DataFrame, path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and an end id, in pieces of at most `length`."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = tokenizer(path)
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for lo, hi, part, starts, ends, first in words_by_block(batch.column(1)):
                flat, size = words.block(part, starts, ends)
                bound = np.concatenate([[0], np.cumsum(size)])[first].tolist()
                for d in range(lo, hi):
                    own = np.append(flat[bound[d - lo] : bound[d - lo + 1]], np.uint32(END)).astype("<u4")
                    for k, s in enumerate(range(0, len(own), length)):
                        piece = own[s : s + length]
                        rows.append((ids[d], k, s, len(piece), zlib.crc32(piece)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def nest(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(matched pieces, their gaps, pieces left, gaps left) as places in a list of gaps (True) and pieces by falling size.

    Every piece takes the smallest gap before it that is free: gaps open and pieces close brackets. Those of one depth
    alternate, so that sorting by depth puts each piece behind its gap.
    """
    n = len(gap)
    sums = np.cumsum(np.where(gap, 1, -1))
    low = np.minimum.accumulate(np.minimum(sums, 0))
    left = ~gap & (low < np.concatenate([[0], low[:-1]]))
    depth = sums - low + ~gap
    rows = np.flatnonzero(~left)
    rows = rows[np.argsort(depth[rows], kind="stable")]
    closing = np.flatnonzero(~gap[rows])
    pieces, gaps = rows[closing], rows[closing - 1]
    free = gap.copy()
    free[gaps] = False
    return pieces, gaps, np.flatnonzero(left), np.flatnonzero(free) if n else rows


def nest_rest(left: Sequence[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """What is left of each range in order, (range, pieces, gaps), matched over ranges: runs (range of the pieces, first
    rank, number, range of the gaps, first rank), gaps ranked from the smallest up. The latest range's gaps are the
    smallest and go first."""
    stack: list[list[int]] = []
    runs = []
    for part, pieces, gaps in left:
        rank = 0
        while pieces > rank and stack:
            at, first, n = stack[-1]
            take = min(n, pieces - rank)
            runs.append((part, rank, take, at, first))
            rank += take
            if take == n:
                stack.pop()
            else:
                stack[-1][1:] = [first + take, n - take]
        if gaps:
            stack.append([part, 0, gaps])
    return runs


_SWEPT = "state int, part int, rank long, uid long, size int, sequence long, slot int, free int"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of pieces and slots, the largest first: pairs (state 0), pieces (1) and slots (2) that are left."""
    from pyspark import TaskContext

    table = pa.Table.from_batches(list(batches))
    part = TaskContext.get().partitionId()
    if not len(table):
        return
    size, sequence, slot, free, uid = (np.asarray(table.column(c).combine_chunks()) for c in ("size", "sequence", "slot", "free", "uid"))
    pieces, gaps, alone, spare = nest(np.asarray(table.column("gap").combine_chunks()))
    spare = spare[::-1]
    for state, i, j in ((0, pieces, gaps), (1, alone, alone), (2, spare, spare)):
        n = len(i)
        for a in range(0, n, 1 << 18):
            p, g = i[a : a + (1 << 18)], j[a : a + (1 << 18)]
            m = len(p)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, state, np.int32)), pa.array(np.full(m, part, np.int32)), pa.array(np.arange(a, a + m)), pa.array(uid[p]), pa.array(size[p]), pa.array(sequence[g]), pa.array(slot[g]), pa.array(free[g])],
                ["state", "part", "rank", "uid", "size", "sequence", "slot", "free"],
            )


def best_fit(pieces: DataFrame, length: int = LENGTH, task_rows: int = TASK_ROWS) -> DataFrame:
    """(uid, sequence_id, offset) of pieces (uid, size), by rounds of bulk-synchronous best fit.

    A round opens sequences for the pieces that are larger than any gap, as many as their tokens fill; cuts each gap
    into slots that hold the largest piece left; and sorts pieces and slots into ranges by falling size. A sweep over
    each range gives every piece its successor among the slots, the smallest free one that holds it. What is left of
    the ranges is matched over them by rank, for which the driver sees two counts a range. Then the gaps are updated,
    and rounds repeat until no piece is left; the driver sees how many pieces and gaps there are of each size. The largest piece of a round is always placed, and slots of the largest
    size are at least half filled where they are, so that rounds are about as many as the halvings of a sequence.
    """
    spark = pieces.sparkSession
    gaps, opened = spark.range(0).select(F.col("id").alias("sequence"), F.lit(length).alias("free")), 0
    out = pieces.select("uid", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).limit(0)
    before = F.coalesce(F.sum("size").over(Window.partitionBy("sequence").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    while True:
        kinds = pieces.select(F.lit(False).alias("gap"), "size").union(gaps.select(F.lit(True), "free")).groupBy("gap", "size").count().collect()
        want, have = ({r["size"]: r["count"] for r in kinds if r["gap"] == g} for g in (False, True))
        if not want:
            return out
        n, low, high, top = sum(want.values()), min(want), max(want), max(have, default=0)
        new = -(-sum(size * m for size, m in want.items() if size > top) // length)
        if new:
            gaps = gaps.union(spark.range(opened, opened + new).select("id", F.lit(length)))
            opened += new
        room = new + sum(m for free, m in have.items() if free >= low)
        each = F.greatest(F.lit(1), F.least(F.expr(f"free div {high}"), F.lit(-(-2 * n // room)))).cast("int")
        usable = gaps.where(F.col("free") >= low).withColumn("k", each)
        slots = usable.select(F.lit(True).alias("gap"), F.expr("cast(free div k as int)").alias("size"), F.lit(0).cast("long").alias("uid"), "sequence", F.explode(F.expr("sequence(0, k - 1)")).alias("slot"), "free")
        asked = pieces.select(F.lit(False).alias("gap"), "size", "uid", F.lit(0).cast("long").alias("sequence"), F.lit(0).alias("slot"), F.lit(0).alias("free"))
        order = [F.col("size").desc(), F.col("gap").desc(), F.col("sequence"), F.col("slot"), F.col("uid")]
        ranges = -(-(n + min(room * (length // high), 2 * n + room)) // task_rows)
        swept = cut(slots.union(asked).repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(_sweep, _SWEPT))
        alone = swept.where("state = 1").select("part", "rank", "uid", "size")
        pairs = swept.where("state = 0").select("uid", "size", "sequence", "slot", "free")
        left = swept.where("state > 0").groupBy("part").agg(F.count_if(F.col("state") == 1), F.count_if(F.col("state") == 2)).orderBy("part").collect() if ranges > 1 else []
        if runs := nest_rest([tuple(r) for r in left]):
            met = F.broadcast(spark.createDataFrame(runs, "part int, first long, n long, gap_part int, gap_first long"))
            alone = alone.join(met, (alone.part == met.part) & (alone["rank"] >= met["first"]) & (alone["rank"] < met["first"] + met["n"]), "left")
            alone = alone.select("uid", "size", "gap_part", (F.col("gap_first") + F.col("rank") - F.col("first")).alias("gap_rank"))
            spare = swept.where("state = 2").select(F.col("part").alias("gap_part"), F.col("rank").alias("gap_rank"), "sequence", "slot", "free")
            pairs = pairs.union(alone.where("gap_part IS NOT NULL").join(spare, ["gap_part", "gap_rank"]).select("uid", "size", "sequence", "slot", "free"))
            alone = alone.where("gap_part IS NULL")
        gaps = cut(gaps.union(pairs.select("sequence", -F.col("size"))).groupBy("sequence").agg(F.sum("free").cast("int").alias("free")).where("free > 0"))
        pieces = alone.select("uid", "size")
        out = out.union(pairs.select("uid", F.col("sequence").alias("sequence_id"), (F.lit(length) - F.col("free") + before).cast("long").alias("offset")))


def pack(pieces: DataFrame, length: int = LENGTH, task_rows: int = TASK_ROWS) -> DataFrame:
    """The pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    pieces = cut(pieces.withColumn("uid", F.monotonically_increasing_id()))
    placed = best_fit(pieces.select("uid", F.col("length").cast("int").alias("size")), length, task_rows)
    return pieces.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Tokenise all documents, cut those of over `length` tokens, and pack the pieces.

    Null and empty texts are the end id alone. Null ids and rows that repeat an id are packed, a piece row each; other
    columns of docs don't matter. Of equal pieces any may come first. One document's arrays are held at a time, about 60
    times its bytes. No rows: none.
    """
    return pack(cut_pieces(docs, path or vocabulary_path(), length), length)


QUERY = {"op7_pack_documents": lambda spark, sf_dir: pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))}
ORACLE: dict[str, str] = {}
