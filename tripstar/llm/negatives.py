"""Hard-negative mining by a secondary sort: pair scores packed into (anchor, descending score, id) keys.

The anchors are a stated query set. They are taken in blocks of :data:`ANCHORS` rows, each broadcast in turn, and every
vector meets each block in tiles of a matrix product (floor(256 x) of every component, so scores are whole numbers).
A task holds, per anchor of the block, no more than the pairs that can still count:

1. the best same-label pairs of its rows (an anchor's first positives are among its tasks' first ones);
2. once the positives are known, the best different-label pairs of its rows inside each positive's window of scores.

Both kinds of pairs become keys of bytes whose order is anchor, score descending, positives first, id ascending;
``repartitionAndSortWithinPartitions`` deals them out by anchor and sorts them within the partitions. A streaming
iterator then reads each partition once: a positive opens its window, a negative goes to every open window that it
fits and that isn't full, and the next anchor's key closes them all. It holds the open windows of one anchor,
never an anchor's pairs. All positives that matter come before their negatives, since a window ends at 0.95 of the
positive's score (and at equal scores positives sort first).

Left out: rows with a null label or vector, or with a null, NaN or infinite component. A null id: never an anchor;
sorted after all other ids. An anchor's pairs are with rows of other ids; rows that repeat an id are rows of their own,
and repeated anchors give their rows each. Vectors of unlike length have no score and are no pair. Scores are exact;
one beyond 64 bits is taken as the nearest 64-bit number. Empty tables give an empty table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstar.llm.base import map_arrow, written

#: Rows of the query set broadcast at a time; components of their vectors, at most; rows and anchors of a tile.
ANCHORS, COMPONENTS, TILE, TILE_ANCHORS = 16_384, 4 << 20, 4_096, 512
#: Keys of a partition of the secondary sort, on average.
PARTITION_KEYS = 500_000
#: Positives of an anchor; negatives of a positive; a window's least and greatest share of the positive's score, in 100ths.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95

_BIAS = 1 << 63
_KEY = struct.Struct(">QQQBBQQ")
_ANCHOR_BYTES = 16


def pack(anchor: int, number: int, score: int, negative: bool, other: int | None, row: int = 0) -> bytes:
    """A key in byte order: anchor (id, number), score descending, positives first, id ascending (null last), row."""
    return _KEY.pack(anchor + _BIAS, number, _BIAS - 1 - score, negative, other is None,
                     0 if other is None else other + _BIAS, row)


def unpack(key: bytes) -> tuple[int, int, int, bool, int | None]:
    anchor, number, score, negative, null, other, _ = _KEY.unpack(key)
    return anchor - _BIAS, number, _BIAS - 1 - score, bool(negative), None if null else other - _BIAS


def opened(keys: Iterator[bytes]) -> Iterator[tuple]:
    """Sorted keys → (anchor, positive, rank, negative, positive's score, negative's score). What is held: the
    windows (positive, its score, negatives so far) of the anchor being read."""
    now, windows = None, []
    for key in keys:
        anchor, number, score, negative, other = unpack(key)
        if now != (anchor, number):
            now, windows = (anchor, number), []
        if not negative:
            if len(windows) < POSITIVES:
                windows.append([other, score, 0])
            continue
        for w in windows:
            if w[2] < NEGATIVES and LOW * w[1] <= 100 * score <= HIGH * w[1]:
                w[2] += 1
                yield anchor, w[0], w[2], other, w[1], score


def first_positives(keys: Iterator[bytes]) -> Iterator[bytes]:
    """Sorted keys of positives → the first ones of each anchor."""
    now, seen = None, 0
    for key in keys:
        now, seen = key[:_ANCHOR_BYTES], 0 if now != key[:_ANCHOR_BYTES] else seen + 1
        if seen < POSITIVES:
            yield key


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and components (as doubles) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    label = F.expr("case when vec_id % 7 = 0 then (label + 1L) % 10 else cast(label as long) end")
    return (vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
            .select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), x.alias("x")))


def _scores(a, b):
    """Exact inner products: doubles where no sum can pass 2^53, else whole numbers without a bound."""
    import numpy as np

    if not a.size or not b.size or a.shape[1] * np.abs(a).max() * np.abs(b).max() < 2.0 ** 53:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(v) for v in row] for row in m], object) for m in (a, b)]
    return np.clip(whole[0] @ whole[1].T, -_BIAS, _BIAS - 1).astype(np.int64)


def _tiles(batches: Iterator[pa.RecordBatch], block: list[tuple]) -> Iterator[tuple]:
    """(places of anchors, places of rows, ids, null ids, labels, scores) of every anchor with every row, in tiles of
    vectors of like length. A row's place is its own in the whole table."""
    import numpy as np
    import pyarrow.compute as pc

    place = TaskContext.get().partitionId() << 40
    anchor_sizes = np.array([len(v) for *_, v in block])
    for batch in batches:
        ids = pc.fill_null(batch.column("vec_id"), 0).to_numpy(zero_copy_only=False)
        null = batch.column("vec_id").is_null().to_numpy(zero_copy_only=False)
        labels = batch.column("label").to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(batch.column("x")).to_numpy(zero_copy_only=False)
        for size in np.intersect1d(sizes, anchor_sizes).tolist():
            at, mine = np.flatnonzero(sizes == size), np.flatnonzero(anchor_sizes == size)
            anchors = np.stack([block[i][3] for i in mine])
            for r in range(0, len(at), TILE):
                rows = at[r:r + TILE]
                x = batch.column("x").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
                vectors = np.floor(256 * x.reshape(len(rows), size))
                for a in range(0, len(mine), TILE_ANCHORS):
                    own = slice(a, a + TILE_ANCHORS)
                    yield mine[own], place + rows, ids[rows], null[rows], labels[rows], _scores(anchors[own], vectors)
        place += batch.num_rows


class _Best:
    """The first ``most`` of the pairs offered to a list: (-score, null id, id, row), in key order."""

    def __init__(self, most: int):
        self.most, self.pairs = most, []

    def offer(self, fits, scores, ids, null, rows) -> None:
        import numpy as np

        if len(self.pairs) == self.most:
            fits = fits & (scores >= -self.pairs[-1][0])
        at = np.flatnonzero(fits)
        if len(at) > self.most:   # the greatest scores and all that tie with the last of them
            own = scores[at]
            at = at[own >= np.partition(own, len(own) - self.most)[len(own) - self.most]]
        if len(at):
            new = zip((-scores[at]).tolist(), null[at].tolist(), ids[at].tolist(), rows[at].tolist())
            self.pairs = sorted([*self.pairs, *new])[:self.most]


def _pairs(rows: DataFrame, block: list[tuple], windows: dict[int, list[int]] | None, name: str) -> DataFrame:
    """Each task's pairs that can still count, as packed keys, written: same-label pairs, or (given the positives'
    scores by anchor number) different-label pairs inside the windows."""
    shared = rows.sparkSession.sparkContext.broadcast((block, windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, windows = shared.value
        best = [[_Best(POSITIVES)] if windows is None else [_Best(NEGATIVES) for _ in windows.get(b[0], ())]
                for b in block]
        for mine, place, ids, null, labels, scores in _tiles(batches, block):
            for k, i in enumerate(mine.tolist()):
                number, anchor, label, _ = block[i]
                other = null | (ids != anchor)
                if windows is None:
                    best[i][0].offer(other & (labels == label), scores[k], ids, null, place)
                    continue
                for b, s in zip(best[i], windows.get(number, ())):
                    # The bounds as whole numbers: ceil(LOW s / 100) and floor(HIGH s / 100).
                    fits = other & (labels != label) & (scores[k] >= -(-LOW * s // 100)) & (scores[k] <= HIGH * s // 100)
                    b.offer(fits, scores[k], ids, null, place)
        keys = [pack(anchor, number, -s, windows is not None, None if nothing else d, row)
                for (number, anchor, *_), own in zip(block, best)
                for s, nothing, d, row in sorted({p for b in own for p in b.pairs})]
        for k in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k:k + (1 << 16)], pa.binary())], names=["key"])

    out = written(map_arrow(rows, run, "key binary"), name)
    shared.unpersist()
    return out


def _sorted_keys(keys: DataFrame):
    """The keys dealt out by anchor and sorted within each partition."""
    sc = keys.sparkSession.sparkContext
    n = max(sc.defaultParallelism, keys.count() // PARTITION_KEYS + 1)
    return keys.rdd.map(lambda r: (bytes(r.key), None)).repartitionAndSortWithinPartitions(
        n, partitionFunc=lambda k: zlib.crc32(k[:_ANCHOR_BYTES])).keys()


def hard_negatives(vectors: DataFrame, anchors: str = "vec_id % 50 = 0") -> DataFrame:
    """vectors(vec_id, embedding, label) → anchor_id, positive_id, rank, negative_id, positive_score, negative_score
    of every anchor: the first negatives inside the window of each of its first positives."""
    import numpy as np

    spark, rows = vectors.sparkSession, usable(vectors)
    queries = written(rows.filter(anchors).withColumn("number", F.monotonically_increasing_id()), "anchors")
    total = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("x")), F.lit(0)).alias("x")).first()
    blocks = max(-(-total.n // ANCHORS), -(-total.x // COMPONENTS))
    keys = spark.createDataFrame([], "key binary")
    for k in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("number"), F.lit(blocks)) == k).collect()
        block = [(r.number, r.vec_id, r.label, np.floor(256 * np.array(r.x, dtype=float))) for r in own]
        same = _sorted_keys(_pairs(rows, block, None, "positives")).mapPartitions(first_positives)
        positives = written(same.map(lambda k: (bytearray(k),)).toDF("key binary"), "positives")
        windows: dict[int, list[int]] = {}
        for r in positives.collect():     # at most POSITIVES an anchor of the block
            _, number, score, *_ = unpack(bytes(r.key))
            windows.setdefault(number, []).append(score)
        keys = keys.unionAll(positives).unionAll(_pairs(rows, block, windows, "negatives"))
    found = _sorted_keys(keys).mapPartitions(opened)
    return found.toDF("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
                      "negative_score long")


#: The same in DuckDB SQL, every anchor against every row.
ORACLE_SQL = f"""
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS s
         FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 50 = 0),
positive AS (SELECT * FROM pair WHERE same
             QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= {POSITIVES}),
negative AS (SELECT p.a, p.b AS positive, n.b AS negative, p.s AS ps, n.s AS ns,
                    row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS rank
             FROM positive p JOIN pair n ON n.a = p.a AND NOT n.same
             WHERE {LOW} * p.s <= 100 * n.s AND 100 * n.s <= {HIGH} * p.s)
SELECT a AS anchor_id, positive AS positive_id, rank::INTEGER AS rank, negative AS negative_id,
       ps AS positive_score, ns AS negative_score
FROM negative WHERE rank <= {NEGATIVES}
"""
