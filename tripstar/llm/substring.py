"""Substring dedup: words covered by a window of 20 words that also starts earlier are removed.

Two passes and an exact grouping:

1. *Sketch.* Every window is represented by its minimizer, the least of the hashes of its eleven runs of ten words;
   equal windows have equal minimizers at distinct places, so the number of places where a minimizer value is
   selected is never below the count of any window it stands for. Each partition counts the selected places in a
   count-min sketch (two rows, counters that stop at 2); partition sketches are merged in blocks of 2^20 cells.
   About one place in six is selected, so the sketch carries a sixth of the load that counting windows would.
2. *Exact.* A second pass sends on only windows whose cells all reach 2 in the merged sketch, with a 128-bit hash
   of the word sequence. Within a slice of documents equal windows are combined first: only the earliest goes to
   the shuffle, the others are marked at once. So a passage that a third of all documents share costs one row a
   slice, not one a document. The exchange by window hash finds the earliest start of each window.

Marks are then gathered per document and the kept words written. The sketch overestimates, so nothing repeated is
lost; what it lets through for nothing is dropped by the exact grouping. Its size follows the input up to
:data:`MAX_BITS` (64 MB a row): beyond that it passes on more windows, with the same results.

A document is a doc_id with a text, known by the id and hashes of the text (128 bits of them where the id is null).
Null text: no words. Null doc_id: before all others, by these hashes. Rows of equal id and equal text count as one
document: the same start in both is not earlier, and marks hold for both. Rows that repeat an id with another text are
documents of their own, in the order of the hashes. Texts of under 20 words keep everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripstar.llm.base import map_arrow, ship_package, spark_schema, text_slices, texts, written

#: Words of a window; words of the runs among which a window's minimizer is chosen.
WINDOW, RUN = 20, 10
#: Sketch: rows, cells of a merged block (2^), and the least and most cells of a row (2^).
ROWS, BLOCK, MIN_BITS, MAX_BITS = 2, 20, 20, 29
#: Cells wanted for each selected place, and UTF-8 bytes of text for one selected place, at a guess.
LOAD, BYTES_PER_PLACE = 4, 32
#: Partition sketches merged by one task at a time.
FAN_IN = 256
_M1, _M2, _M3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_FLUSH = 2_000_000


def _poly(x, n: int, mult: int):
    """Rolling polynomial hash of every run of ``n`` values (length len(x) - n + 1), by doubling."""
    import numpy as np

    power = lambda e: np.uint64(pow(mult, e, 1 << 64))
    have, size, out, done = x, 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            if n & size:   # the run so far, followed by one of ``size`` values
                out = have if out is None else out[:max(0, len(have) - done)] * power(size) + have[done:]
                done += size
            if done == n:
                return out
            have = have[:-size] * power(size) + have[size:] if len(have) > size else have[:0]
            size *= 2


def _sliding(x, n: int, op):
    """Minimum or maximum of every run of ``n`` values."""
    size, have = 1, x
    while size * 2 <= n:
        have = op(have[:-size], have[size:]) if len(have) > size else have[:0]
        size *= 2
    rest = n - size
    return op(have[:len(have) - rest], have[rest:]) if rest else have


class Slice:
    """The words of some texts one after another, with the hashes of their windows."""

    def __init__(self, batch: list[bytes]):
        import numpy as np
        from xxhash import xxh3_128_digest

        lists = [t.split() for t in batch]
        self.counts = np.array([len(w) for w in lists], dtype=np.int64)
        self.ends = np.cumsum(self.counts)
        lanes = np.frombuffer(b"".join([xxh3_128_digest(x) for w in lists for x in w]), dtype="<u8").reshape(-1, 2)
        del lists
        self.a, self.b = np.ascontiguousarray(lanes[:, 0]), np.ascontiguousarray(lanes[:, 1])
        n = len(self.a)
        #: how many words follow in the same document, the word itself included
        left = np.repeat(self.ends, self.counts) - np.arange(n)
        self.valid = left[:max(0, n - WINDOW + 1)] >= WINDOW
        if n < WINDOW:
            self.run = self.least = np.empty(0, np.uint64)
            return
        run = _poly(self.a, RUN, _M1)
        with np.errstate(over="ignore"):
            run = (run ^ (run >> np.uint64(31))) * np.uint64(_M2)
            run ^= run >> np.uint64(29)
        self.run = run
        self.least = _sliding(run, WINDOW - RUN + 1, np.minimum)   # one a window

    def selected(self):
        """Minimizer values, once for each place that is the minimum of a window covering it."""
        import numpy as np

        if not len(self.least):
            return self.least
        pad = np.zeros(WINDOW - RUN, dtype=np.uint64)
        reach = np.concatenate([pad, np.where(self.valid, self.least, np.uint64(0)), pad])
        most = _sliding(reach, WINDOW - RUN + 1, np.maximum)       # over the windows that cover the place
        # a place no valid window covers has most = 0; a run hash of 0 there only adds to the estimate
        return self.run[(self.run == most)]

    def windows(self, at):
        """128-bit hashes of the windows that start at ``at``."""
        return _poly(self.a, WINDOW, _M3)[at], _poly(self.b, WINDOW, _M1)[at]


def cells(values, row: int, bits: int):
    """The cell of each minimizer value in one row of the sketch."""
    import numpy as np

    with np.errstate(over="ignore"):
        mixed = values * np.uint64((_M2, _M3)[row])
        mixed ^= mixed >> np.uint64(32)
        mixed = mixed * np.uint64(_M1)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _pack(bits) -> bytes:
    import numpy as np
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.packbits(bits).tobytes())


def _unpack(data: bytes):
    import numpy as np
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)


def _partial(values, bits: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """A partition's sketch: (row, block, cells counted once or more, cells counted twice or more)."""
    import numpy as np

    width = 1 << BLOCK
    for row in range(ROWS):
        cell, n = np.unique(cells(values, row, bits), return_counts=True)
        block = cell >> BLOCK
        edges = np.flatnonzero(np.diff(block, prepend=-1))
        for lo, hi in zip(edges, [*edges[1:], len(cell)]):
            once, twice = np.zeros(width, dtype=bool), np.zeros(width, dtype=bool)
            inside = cell[lo:hi] & (width - 1)
            once[inside] = True
            twice[inside[n[lo:hi] > 1]] = True
            yield row, int(block[lo]), _pack(once), _pack(twice)


_SKETCH = "row int, block int, part int, once binary, twice binary"


def partition_sketches(docs: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part, held, size = TaskContext.get().partitionId(), [], 0

        def flush() -> pa.RecordBatch:
            rows = list(_partial(np.concatenate(held), bits))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                 pa.array([part] * len(rows), pa.int32()), pa.array([r[2] for r in rows], pa.binary()),
                 pa.array([r[3] for r in rows], pa.binary())], names=["row", "block", "part", "once", "twice"])

        for batch in batches:
            for piece in _pieces(batch):
                values = Slice(texts(piece)).selected()
                held.append(values)
                size += len(values)
                if size > _FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return map_arrow(docs.select("text"), run, _SKETCH)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of half the usual size: the hashes of a slice take some thirty bytes a word."""
    for part in text_slices(batch):
        half = part.num_rows // 2
        yield part.slice(0, half) if half else part
        if half:
            yield part.slice(half)


def _merge(table: pa.Table) -> pa.Table:
    """Counters that stop at 2, added: twice if twice in one or once in two."""
    once = twice = None
    for o, t in zip(table.column("once").to_pylist(), table.column("twice").to_pylist()):
        o, t = _unpack(o), _unpack(t)
        once, twice = (o, t) if once is None else (once | o, twice | t | (once & o))
    import zstandard
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return pa.table({"row": table.column("row")[:1], "block": table.column("block")[:1],
                     "part": table.column("part")[:1], "once": [squeeze(once.tobytes())],
                     "twice": [squeeze(twice.tobytes())]},
                    schema=pa.schema([("row", pa.int32()), ("block", pa.int32()), ("part", pa.int32()),
                                      ("once", pa.binary()), ("twice", pa.binary())]))


def merged_sketch(docs: DataFrame, bits: int) -> list[bytes]:
    """For each row of the sketch the compressed bitmap of cells that reach 2: at most 2^bits / 8 bytes a row."""
    import numpy as np
    import zstandard

    ship_package(docs.sparkSession)
    sketch = partition_sketches(docs, bits)
    parts = docs.rdd.getNumPartitions()
    while True:
        parts = -(-parts // FAN_IN)
        sketch = (sketch.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
                  .groupBy("row", "block", "part").applyInArrow(_merge, _SKETCH))
        if parts <= 1:
            break
    out = [np.zeros((1 << bits) // 8, dtype=np.uint8) for _ in range(ROWS)]
    for r in sketch.select("row", "block", "twice").collect():
        at = r.block << (BLOCK - 3)
        out[r.row][at:at + (1 << (BLOCK - 3))] = np.frombuffer(
            zstandard.ZstdDecompressor().decompress(bytes(r.twice)), dtype=np.uint8)
    return [zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for x in out]


def sketch_bits(docs: DataFrame) -> int:
    """Cells of a sketch row, as a power of two, for the bytes of text there are."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MAX_BITS, max(MIN_BITS, (size * LOAD // BYTES_PER_PLACE).bit_length()))


def repeated(piece: Slice, sketch: list, bits: int):
    """Starts of the windows whose cells reach 2 in every row of the sketch."""
    import numpy as np

    at = np.flatnonzero(piece.valid)
    for row in range(ROWS):
        cell = cells(piece.least[at], row, bits)
        at = at[(sketch[row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1]
    return at


def candidates(docs: DataFrame, sketch: list[bytes], bits: int) -> DataFrame:
    """docs(named, d, t, text) → h1, h2, named, d, t, pos, n, known: the earliest start of each candidate window in
    its slice (known false), and runs of n starts that are later than another in the slice (known true)."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        rows = [_unpack(x) for x in shared.value]
        for batch in batches:
            for part in _pieces(batch):
                piece = Slice(texts(part))
                at = repeated(piece, rows, bits)
                if not len(at):
                    continue
                h1, h2 = piece.windows(at)
                doc = np.searchsorted(piece.ends, at, side="right")
                pos = at - (piece.ends - piece.counts)[doc]
                keys = [part.column(c).to_numpy(zero_copy_only=False) for c in ("named", "d", "t")]
                place, differs = np.lexsort(keys[::-1]), np.zeros(part.num_rows, dtype=np.int64)
                for k in keys:
                    differs[1:] |= k[place][1:] != k[place][:-1]
                number = np.empty(part.num_rows, dtype=np.int64)      # of the row's document, in order
                number[place] = np.cumsum(differs)
                d = number[doc]
                order = np.lexsort((pos, d, h2, h1))
                h1, h2, d, pos, doc = h1[order], h2[order], d[order], pos[order], doc[order]
                new = np.ones(len(h1), dtype=bool)
                new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                head = np.flatnonzero(new)[np.cumsum(new) - 1]
                later = (d > d[head]) | (pos > pos[head])
                # equal (d, pos): the same document twice in the slice, known once is enough
                late = np.lexsort((pos[later], d[later]))
                ld, lp, row = d[later][late], pos[later][late], doc[later][late]
                start = np.ones(len(ld), dtype=bool)
                start[1:] = (ld[1:] != ld[:-1]) | (lp[1:] > lp[:-1] + 1)
                first = np.flatnonzero(start)
                runs = (lp[np.append(first[1:], len(lp)) - 1] - lp[first] + 1) if len(first) else lp[:0]
                k = len(first)
                row = np.concatenate([doc[new], row[first]])
                named, ids, t = (x[row] for x in keys)
                with np.errstate(over="ignore"):   # marks only need to be spread evenly
                    spread = (t[len(t) - k:].view(np.uint64) * np.uint64(_M1)) ^ (lp[first].astype(np.uint64) * np.uint64(_M2))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([h1[new], spread]).view(np.int64)),
                     pa.array(np.concatenate([h2[new], spread]).view(np.int64)),
                     pa.array(named), pa.array(ids), pa.array(t),
                     pa.array(np.concatenate([pos[new], lp[first]]).astype(np.int32)),
                     pa.array(np.concatenate([np.ones(int(new.sum()), np.int64), runs]).astype(np.int32)),
                     pa.array(np.concatenate([np.zeros(int(new.sum()), bool), np.ones(k, bool)]))],
                    names=["h1", "h2", "named", "d", "t", "pos", "n", "known"])

    return map_arrow(docs, run, "h1 long, h2 long, named boolean, d long, t long, pos int, n int, known boolean")


def marks(docs: DataFrame) -> DataFrame:
    """docs(named, d, t, text) → named, d, t, marks array<long>: runs of n windows from word pos on that start earlier too, each as
    pos · 2^32 + n (a quarter of the bytes that an array of structs would shuffle)."""
    bits = sketch_bits(docs)
    found = candidates(docs, merged_sketch(docs, bits), bits)
    place = Window.partitionBy("known", "h1", "h2").orderBy("named", "d", "t", "pos")
    return (found.withColumn("place", F.rank().over(place)).filter("known OR place > 1")
            .groupBy("named", "d", "t").agg(F.collect_set(F.shiftleft(F.col("pos").cast("long"), 32) + F.col("n")).alias("marks")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) → doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    keyed = docs.select(doc_id.alias("doc_id"), doc_id.isNotNull().alias("named"),
                        F.coalesce(doc_id, F.xxhash64(text)).alias("d"), F.xxhash64(F.lit("text"), text).alias("t"), "text")
    key = ["named", "d", "t"]
    marked = keyed.join(marks(keyed.select(*key, "text")), key, "left").select("doc_id", "text", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for part in text_slices(batch):
                total, gone, kept = [], [], []
                marks_ = part.column("marks")
                for i, text in enumerate(texts(part)):
                    w = text.split()
                    total.append(len(w))
                    if not marks_[i].is_valid:
                        gone.append(0)
                        kept.append(b" ".join(w).decode(errors="replace"))
                        continue
                    mark = marks_[i].values.to_numpy()
                    pos, n = mark >> 32, mark & 0xFFFFFFFF
                    step = np.zeros(len(w) + 1, dtype=np.int64)
                    np.add.at(step, np.minimum(pos, len(w)), 1)
                    np.add.at(step, np.minimum(pos + n + WINDOW - 1, len(w)), -1)
                    stay = np.cumsum(step)[:-1] == 0
                    gone.append(int(len(w) - stay.sum()))
                    kept.append(b" ".join([x for x, s in zip(w, stay.tolist()) if s]).decode(errors="replace"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                     pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return map_arrow(marked, run, f"{spark_schema(keyed, ['doc_id'])}, n_words long, n_removed long, kept string")


