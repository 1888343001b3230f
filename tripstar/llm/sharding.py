"""Sharding by histogram sort: shards of near equal bytes, cut at exact places of one global key order.

The order is (text hash, doc_id), so equal texts lie side by side. Splitters are found by refining probes: each
round counts the exact bytes and rows between candidate key boundaries with one partial aggregation, and only the
cell that holds a wanted boundary is probed more finely in the next round, until the boundary is within the
tolerance or the cell holds one key. Then the rows are exchanged once, to the piece of the order they lie in.

The hash is probed 16 bits a round. A cell that is one text only (a hot group of copies) is probed on by doc_id,
so a group that holds a third of the rows is cut exactly like any other stretch of the order. The driver sees the
probe counts alone: 65,536 cells in the first round and 4,096 in each refined cell, of which there are at most as
many as splitters.

Null text: empty. Null doc_id: ordered before the others. Repeated doc_ids: rows of one doc_id and one text have
one key; they are never cut apart by a splitter and get consecutive slots. Empty table: no rows.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripstar.llm.base import written

#: A shard may differ from the ideal size by this share of it (or by one text, where that is larger).
TOLERANCE = 0.001
#: Rows of the exchanged narrow table in one piece of a shard: bounds what one task sorts.
PIECE_ROWS = 4_000_000
FIRST_BITS, NEXT_BITS = 16, 12


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the two halves of the order: hi (text hash as 64 unsigned bits, shown as
    long) and lo (doc_id shifted to unsigned order)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("hi"),
        _low_half().alias("lo"))


def _low_half() -> Column:
    """doc_id shifted to unsigned order; null sorts first, so it takes the lowest key."""
    return F.coalesce(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-2 ** 63)), F.lit(0))


def _prefix(bits: int) -> Column:
    """The first ``bits`` bits of the 128-bit key, as two longs (the second 0 while bits <= 64)."""
    if bits <= 64:
        return F.struct(F.shiftrightunsigned("hi", 64 - bits).alias("h"), F.lit(0).cast("long").alias("l"))
    return F.struct(F.col("hi").alias("h"), F.shiftrightunsigned("lo", 128 - bits).alias("l"))


def _counts(keys: DataFrame, bits: int, cells: list[int] | None, upto: int) -> dict[int, list[tuple[int, int, int]]]:
    """Exact (prefix, bytes, rows) of the non-empty cells of ``upto`` bits, under each cell of ``bits`` bits."""
    near = keys
    if cells is not None:
        spark = keys.sparkSession
        rows = [_signed(c, bits) for c in cells]
        want = spark.createDataFrame(rows, "h long, l long")  # at most one row a splitter
        near = (keys.withColumn("p", _prefix(bits))
                .join(F.broadcast(want), (F.col("p.h") == F.col("h")) & (F.col("p.l") == F.col("l")), "left_semi"))
    got = (near.groupBy(_prefix(upto).alias("p")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
           .select("p.h", "p.l", "bytes", "n").collect())
    out: dict[int, list] = {}
    for h, l, size, n in got:
        p = _unsigned(h, l, upto)
        out.setdefault(p >> (upto - bits), []).append((p, size, n))
    return {k: sorted(v) for k, v in out.items()}


def _unsigned(h: int, l: int, bits: int) -> int:
    if bits <= 64:
        return h & (2 ** 64 - 1)
    return ((h & (2 ** 64 - 1)) << (bits - 64)) | (l & (2 ** 64 - 1))


def _signed(p: int, bits: int) -> tuple[int, int]:
    h, l = (p, 0) if bits <= 64 else (p >> (bits - 64), p & (2 ** (bits - 64) - 1))
    return tuple(x - 2 ** 64 if x >= 2 ** 63 else x for x in (h, l))


def splitters(keys: DataFrame, targets: list[float], tolerance: float) -> list[tuple[int, int, int]]:
    """For each wanted number of bytes before it, a splitter (128-bit key, exact bytes before, exact rows before)."""
    open_ = {0: (0, 0, list(range(len(targets))))}   # cell prefix → bytes before, rows before, its targets
    found: dict[int, tuple[int, int, int]] = {}
    bits = 0
    while open_:
        upto = bits + FIRST_BITS if bits == 0 else min(bits + NEXT_BITS, 128)
        counts = _counts(keys, bits, None if bits == 0 else list(open_), upto)
        later: dict[int, tuple[int, int, list]] = {}
        for cell, (size, n, wanted) in open_.items():
            starts = []
            for p, b, r in counts[cell]:
                starts.append((p, size, n))
                size, n = size + b, n + r
            ends = [s[1] for s in starts[1:]] + [size]
            for i in wanted:
                j = min(bisect_left(ends, targets[i]), len(starts) - 1)   # the child cell that holds the target
                p, before, rows = starts[j]
                nearest = (p << (128 - upto), before, rows)
                if ends[j] - targets[i] < targets[i] - before:
                    nearest = ((p + 1) << (128 - upto), ends[j], starts[j + 1][2] if j + 1 < len(starts) else n)
                if abs(nearest[1] - targets[i]) <= tolerance or upto == 128:
                    found[i] = nearest
                else:
                    later.setdefault(p, (before, rows, []))[2].append(i)
        open_, bits = later, upto
    return [found[i] for i in range(len(targets))]


def _flip(c: Column) -> Column:
    """Unsigned order as signed order."""
    return c.bitwiseXOR(F.lit(-2 ** 63))


def plan(keys: DataFrame, shards: int, tolerance: float, piece_rows: int) -> tuple[list[tuple[int, int, int]], int]:
    """(first key, bytes before, rows before) of every piece, and the number of pieces in a shard."""
    total, n = keys.agg(F.sum("size"), F.count("*")).first()
    per = max(1, -(-(n or 0) // (shards * piece_rows)))
    ideal = (total or 0) / (shards * per)
    cuts = splitters(keys, [ideal * i for i in range(1, shards * per)], tolerance * ideal) if n else []
    return [(0, 0, 0)] + sorted(cuts), per


def placed(rows: DataFrame, cuts: list[tuple[int, int, int]], hi: str, lo: str, piece: str) -> DataFrame:
    """The rows and the number of the piece that their key (columns hi, lo) lies in."""
    # cells of the first 16 bits → number of the piece that a cell begins in, and the splitters inside the cell
    inside: dict[int, list[int]] = {}
    for k, (key, _, _) in enumerate(cuts):
        if k and key < 2 ** 128:
            inside.setdefault(key >> (128 - FIRST_BITS), []).append(k)
    table, n = [], 0
    for cell in range(2 ** FIRST_BITS):
        own = inside.get(cell, [])
        table.append((cell, n, [_signed(cuts[k][0], 128) for k in own]))
        n += len(own)
    # 65,536 cells and one entry a splitter: a bounded table
    cells = F.broadcast(rows.sparkSession.createDataFrame(
        table, "__cell long, __first int, __cuts array<struct<h:long,l:long>>"))

    def at_or_after(c: Column) -> Column:
        return (_flip(c["h"]) < _flip(F.col(hi))) | ((c["h"] == F.col(hi)) & (_flip(c["l"]) <= _flip(F.col(lo))))

    return (rows.join(cells, F.shiftrightunsigned(hi, 64 - FIRST_BITS) == F.col("__cell"))
            .withColumn(piece, F.col("__first") + F.size(F.filter("__cuts", at_or_after)))
            .drop("__cell", "__first", "__cuts"))


def histogram_shards(docs: DataFrame, shards: int = 24, tolerance: float = TOLERANCE,
                     piece_rows: int = PIECE_ROWS) -> DataFrame:
    """docs(doc_id, text, ...) → doc_id, size, text_crc32, shard, slot.

    Slots are gapless from 0 in each shard, in key order. Every shard is cut into pieces of about ``piece_rows``
    rows by splitters of the same kind, whose exact row counts give the first slot of each piece, so no task ever
    sorts a whole shard."""
    # The text is read once; the probes run over about 40 bytes a row.
    keys = written(keyed(docs), "shard-keys")
    cuts, per = plan(keys, shards, tolerance, piece_rows)
    starts = docs.sparkSession.createDataFrame([(i, c[2] - cuts[i - i % per][2]) for i, c in enumerate(cuts)],
                                               "piece int, first_slot long")    # one row a piece
    w = Window.partitionBy("piece").orderBy(_flip(F.col("hi")), _flip(F.col("lo")), "size")
    return (placed(keys, cuts, "hi", "lo", "piece").withColumn("rank", F.row_number().over(w) - 1)
            .join(F.broadcast(starts), "piece")
            .select("doc_id", "size", "text_crc32", F.expr(f"int(piece div {per})").alias("shard"),
                    (F.col("rank") + F.col("first_slot")).cast("long").alias("slot")))


def write_shards(docs: DataFrame, path: str, shards: int = 24, tolerance: float = TOLERANCE,
                 piece_rows: int = PIECE_ROWS) -> str:
    """Write the documents (all columns) as ``path/shard=N/`` files in key order, and return the name of the shard
    column (``shard``, with underscores behind it while the documents have a column of that name).

    The texts move once, each to the piece of the order that its key lies in; a piece is written by one task."""
    cuts, per = plan(written(keyed(docs), "shard-keys"), shards, tolerance, piece_rows)
    name = "shard"
    while name in docs.columns:
        name += "_"
    full = docs.withColumns({"__hi": F.xxhash64(F.coalesce("text", F.lit(""))), "__lo": _low_half()})
    (placed(full, cuts, "__hi", "__lo", "__piece").withColumn(name, F.expr(f"int(__piece div {per})"))
     .repartition("__piece").sortWithinPartitions(name, _flip(F.col("__hi")), _flip(F.col("__lo")))
     .drop("__hi", "__lo", "__piece").write.partitionBy(name).parquet(path))
    return name
