"""SimHash near-duplicates by Golay-code fuzzy hashing.

Each document gets a 64-bit fingerprint of its word shingles. The fingerprint is cut into three segments (22, 21
and 21 bits, zero-padded to 23), and a segment is decoded with the perfect binary Golay code (23, 12, 7) to the
index of its nearest codeword and, where that is three bits away, to the five codewords at four bits. Two segments
that differ in one bit at most always share an index: if v decodes to c then u is within 4 bits of c.

Pigeonhole: 3 differing bits over three segments are (3,0,0), (2,1,0) in some order, or (1,1,1). So two linked
fingerprints have either one equal segment i and another segment j with at most one error, found by the key
(segment i exactly, index of segment j), or one error in every segment, found by the three indices together. Those
keys hold 33 to 36 bits, so at billions of distinct fingerprints a bucket holds few that are not near. For each
pair one side offers all its nearby indices and the other its nearest one only, which by the sharing rule above is
enough: 71 rows a distinct fingerprint on average.

The candidate join verifies the bit distance inside the join condition, and each linked pair is emitted by just one
of its keys, so no pair comes out that is not a link. Equal fingerprints are one class from the start, whatever
number of documents has them. Links of classes become components by distributed star contractions.

Null text: empty. A text without words has the fingerprint zero and links like any other. A null doc_id can't
represent a class; such a row takes the component of its class, null if no row of it has an id. Repeated rows stay
repeated. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripstar.llm.base import map_arrow, text_slices, texts, written
from tripstar.llm.components import connected_components

#: Contract values: words of a shingle, seed of XXH64, differing bits of a link.
SHINGLE, SEED, MAX_BITS = 3, 42, 3
#: Bits of the three segments, from the lowest.
SEGMENTS = (22, 21, 21)
#: Generator polynomial of the (23, 12, 7) Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 16


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of a UTF-8 text: bit set when set in over half of the shingles' hashes."""
    import numpy as np
    from xxhash import xxh64_intdigest

    w = text.translate(_LOWER).split()
    if not w:
        return 0
    if len(w) < SHINGLE:
        return xxh64_intdigest(b" ".join(w), SEED)
    total, ones = len(w) - SHINGLE + 1, np.zeros(64, dtype=np.int64)
    for at in range(0, total, _CHUNK):   # bounded memory for very long texts
        part = w[at:at + _CHUNK + SHINGLE - 1]
        h = np.fromiter((xxh64_intdigest(b" ".join(s), SEED) for s in zip(part, part[1:], part[2:])),
                        dtype="<u8", count=len(part) - SHINGLE + 1)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) → doc_id, fp (the 64 bits as a long)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for part in text_slices(batch):
                fp = np.array([fingerprint(t) for t in texts(part)], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def _remainder(v: int) -> int:
    """The 11-bit syndrome of a 23-bit word: its remainder by the generator polynomial."""
    for bit in range(22, 10, -1):
        if v >> bit & 1:
            v ^= GOLAY << (bit - 11)
    return v


@cache
def _golay():
    """(syndromes of the low 12 bits, of the high 11 bits, error patterns by syndrome: 2048 × 6, -1 where none)."""
    import numpy as np

    low = np.array([_remainder(v) for v in range(1 << 12)], dtype=np.int64)
    high = np.array([_remainder(v << 12) for v in range(1 << 11)], dtype=np.int64)
    near: list[list[int]] = [[] for _ in range(1 << 11)]
    single = [_remainder(1 << b) for b in range(23)]
    for weight in range(5):     # weights 0 to 3: the nearest codeword; 4: the five at four bits
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= single[b]
            near[s].append(sum(1 << b for b in bits))
    errors = np.full((1 << 11, 6), -1, dtype=np.int64)
    for s, patterns in enumerate(near):
        errors[s, :len(patterns)] = patterns
    return low, high, errors


def codewords(segment):
    """Array of 23-bit words → (n, 6) codeword indices, the nearest first; -1 where there is none."""
    import numpy as np

    low, high, errors = _golay()
    e = errors[low[segment & 0xFFF] ^ high[segment >> 12]]
    return np.where(e < 0, -1, (segment[:, None] ^ e) >> 11)


_PAIRS = [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]
_ALL = len(_PAIRS)


def fuzzy_keys(fp, wide: bool):
    """Array of fingerprints (uint64) → (row numbers, keys). ``wide``: the side that offers all nearby indices."""
    import numpy as np

    fp = fp.astype(np.uint64)
    seg, at = [], 0
    for bits in SEGMENTS:
        seg.append(((fp >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64))
        at += bits
    near = [codewords(s) for s in seg]
    first = [x[:, :1] for x in near]
    rows, keys = [], []

    def offer(key, valid) -> None:
        r = np.broadcast_to(np.arange(len(fp)).reshape((-1,) + (1,) * (key.ndim - 1)), key.shape)
        rows.append(r[valid])
        keys.append(key[valid])

    for code, (i, j) in enumerate(_PAIRS):
        own = near[j] if wide else first[j]
        offer((code << 40) | (seg[i][:, None] << 12) | own, own >= 0)
    a, b, c = (near[0], near[1], first[2]) if wide else (first[0], first[1], near[2])
    a, b, c = a[:, :, None, None], b[:, None, :, None], c[:, None, None, :]
    valid = (a >= 0) & (b >= 0) & (c >= 0)
    offer((_ALL << 40) | (a << 24) | (b << 12) | c, valid)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(classes: DataFrame, wide: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows, keys = fuzzy_keys(part.column("fp").to_numpy().view("uint64"), wide)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), part.column("fp").take(take), part.column("rep").take(take)],
                    names=["key", "fp", "rep"])

    return map_arrow(classes, run, "key long, fp long, rep long")


def _canonical(diff) -> F.Column:
    """The one key kind that emits a linked pair, from its differing bits."""
    masks, at = [], 0
    for bits in SEGMENTS:
        m = ((1 << bits) - 1) << at
        masks.append(m - (1 << 64) if m >= 1 << 63 else m)
        at += bits
    e = [F.bit_count(diff.bitwiseAND(F.lit(m))) for m in masks]
    out = F.lit(_ALL)
    for i in (2, 1, 0):
        j, k = [x for x in range(3) if x != i]
        out = F.when(e[i] == 0, F.when(e[j] <= 1, _PAIRS.index((i, j))).otherwise(_PAIRS.index((i, k)))).otherwise(out)
    return out


def class_links(classes: DataFrame) -> DataFrame:
    """classes(fp, rep) → a, b: every pair of representatives whose fingerprints differ in 1 to MAX_BITS bits."""
    left = _keyed(classes, True).select("key", F.col("fp").alias("fa"), F.col("rep").alias("a"))
    right = _keyed(classes, False).select("key", F.col("fp").alias("fb"), F.col("rep").alias("b"))
    diff = F.col("fa").bitwiseXOR(F.col("fb"))
    near = ((left["key"] == right["key"]) & (F.col("fa") < F.col("fb")) & (F.bit_count(diff) <= MAX_BITS)
            & (F.shiftright(left["key"], 40) == _canonical(diff)))
    return left.join(right, near).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) → doc_id, fp, component_id (the smallest doc_id reachable by links, itself included)."""
    fps = written(fingerprints(docs), "fingerprints")
    classes = written(fps.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    comp = connected_components(class_links(classes))
    member = written(classes.join(comp, classes["rep"] == comp["node"], "left")
                     .select("fp", F.coalesce("component", "rep").alias("component_id")), "members")
    return fps.join(member, "fp", "left").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The document of smallest doc_id of each group, all columns; rows that repeat that doc_id stay one.

    Documents without a doc_id can't be told apart from their copies by id and stay."""
    groups = written(near_duplicates(docs.select("doc_id", "text")), "groups")
    keep = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("__keep")).distinct()
    kept = docs.join(keep, docs["doc_id"].cast("long") == keep["__keep"], "left_semi")
    once = kept.withColumn("__n", F.row_number().over(
        Window.partitionBy("doc_id").orderBy(F.length("text").desc_nulls_last(), F.col("text")))).filter("__n = 1")
    return once.drop("__n").unionAll(docs.filter("doc_id IS NULL"))
