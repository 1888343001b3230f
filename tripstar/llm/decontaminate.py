"""Benchmark decontamination: Wu-Manber multi-pattern search over word sequences.

Every window of ten words of a benchmark item is a test string (an item of fewer words is one string). The symbols
are words; a block is two neighbouring words. For each block the shift table tells how far the search may jump
without missing a test string; only at blocks that can end a string (shift 0) the bucket of that suffix is looked
up and its strings are compared word by word with the document. Strings of another length than ten have their own
tables, as Wu-Manber's jump is bounded by the shortest string.

The test strings are a stated, bounded table: they travel to the workers as one broadcast if the benchmark is at
most :data:`PASS_BYTES` of text, and are searched for in several passes of that size beyond it (items dealt into
passes by hash of their id, results united per document), so memory is bounded whatever the benchmark's size.

Null text: no words. Benchmark items without words can't occur. Repeated items or ids count once.
Documents are scanned whole; within a slice all documents advance together, one numpy step per jump.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstar.llm.base import map_arrow, spark_schema, text_slices, texts

#: Words of a window.
WINDOW = 10
#: UTF-8 bytes of benchmark text searched for in one pass.
PASS_BYTES = 16 << 20
#: Long documents advance as several spans of this many words, which overlap by a string's length.
SPAN = 1024

# Separators are the ASCII characters other than digits and letters; A-Z become a-z.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32)
              for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text: runs of digits, a-z and characters beyond ASCII."""
    return text.translate(_FOLD).split()


class WuManber:
    """Shift, bucket and string tables for strings of one length ``m`` (rows of ``strings``: word numbers)."""

    def __init__(self, strings, bits: int = 16):
        import numpy as np

        self.m = strings.shape[1]
        self.block = min(2, self.m)
        self.bits = bits
        self.strings = strings
        far = self.m - self.block + 1
        self.shift = np.full(1 << bits, far, dtype=np.int64)
        for end in range(self.block - 1, self.m):
            np.minimum.at(self.shift, self._hash(strings, end), self.m - 1 - end)
        # suffix buckets: strings sorted by the hash of their last block
        last = self._hash(strings, self.m - 1)
        self.order = np.argsort(last, kind="stable")
        self.bucket_start = np.searchsorted(last[self.order], np.arange((1 << bits) + 1))

    def _hash(self, rows, end: int):
        h = rows[:, end].astype("uint64") * 0x9E3779B97F4A7C15
        if self.block == 2:
            h = (h ^ rows[:, end - 1].astype("uint64")) * 0xC2B2AE3D27D4EB4F
        return (h >> (64 - self.bits)).astype("int64")

    def _hash_at(self, ids, at):
        h = ids[at].astype("uint64") * 0x9E3779B97F4A7C15
        if self.block == 2:
            h = (h ^ ids[at - 1].astype("uint64")) * 0xC2B2AE3D27D4EB4F
        return (h >> (64 - self.bits)).astype("int64")

    def search(self, ids, starts, ends):
        """ids: the documents' words, one after another; starts/ends: spans. → (string numbers, first positions)."""
        import numpy as np

        found_s, found_at = [], []
        at = starts + self.m - 1       # a cursor per span: the end of the possible occurrence
        live = at < ends
        at, ends = at[live], ends[live]
        while len(at):
            h = self._hash_at(ids, at)
            jump = self.shift[h]
            stop = np.flatnonzero(jump == 0)
            if len(stop):
                n = self.bucket_start[h[stop] + 1] - self.bucket_start[h[stop]]
                pos = np.repeat(at[stop], n) - (self.m - 1)
                first = np.repeat(self.bucket_start[h[stop]], n)
                s = self.order[first + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)]
                for k in range(self.m):            # direct comparison, word by word
                    same = ids[pos + k] == self.strings[s, k]
                    pos, s = pos[same], s[same]
                    if not len(s):
                        break
                found_s.append(s)
                found_at.append(pos)
            at = at + np.maximum(jump, 1)
            live = at < ends
            at, ends = at[live], ends[live]
        if not found_s:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(found_s), np.concatenate(found_at)


class Searcher:
    """All test strings of some items: word numbers, one WuManber per string length, the items of each string."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        import numpy as np

        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            w = words(text)
            if w:
                n = min(window, len(w))
                for i in range(len(w) - n + 1):
                    owners[tuple(w[i:i + n])].add(item)
        vocabulary = sorted({w for s in owners for w in s})
        self.number = {w: i + 1 for i, w in enumerate(vocabulary)}   # 0: a word of no test string
        self.tables: list[tuple[WuManber, list[set[str]]]] = []
        for n in sorted({len(s) for s in owners}):
            strings = sorted(s for s in owners if len(s) == n)
            rows = np.array([[self.number[w] for w in s] for s in strings], dtype=np.int32)
            self.tables.append((WuManber(rows), [owners[s] for s in strings]))

    def scan(self, batch: list[bytes]):
        """Per text: number of words, hit spans [(first word, words)] and the items that occur."""
        import numpy as np

        get = self.number.get
        lists = [words(t) for t in batch]
        counts = np.array([len(w) for w in lists], dtype=np.int64)
        ends = np.cumsum(counts)
        ids = np.fromiter((get(x, 0) for w in lists for x in w), dtype=np.int32, count=int(counts.sum()))
        spans: list[list[tuple[int, int]]] = [[] for _ in batch]
        items: list[set[str]] = [set() for _ in batch]
        for table, owner in self.tables:
            pieces = [(s, min(s + SPAN + table.m - 1, int(e))) for s0, e in zip(ends - counts, ends)
                      for s in range(int(s0), int(e), SPAN)]
            if not pieces:
                continue
            starts, stops = (np.array(x, dtype=np.int64) for x in zip(*pieces))
            found, at = table.search(ids, starts, stops)
            docs = np.searchsorted(ends, at, side="right")
            for s, p, d in zip(found.tolist(), at.tolist(), docs.tolist()):
                spans[d].append((p - int(ends[d] - counts[d]), table.m))
                items[d] |= owner[s]
        return counts.tolist(), spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (first, length) united into disjoint ones [(first, end)]."""
    out: list[tuple[int, int]] = []
    for a, n in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], a + n))
        else:
            out.append((a, a + n))
    return out


def _passes(benchmark: DataFrame) -> int:
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // PASS_BYTES))


#: Columns of the passes, beside those that are kept.
_TEXT, _N, _HITS, _ITEMS = "__dc_text", "__dc_words", "__dc_hits", "__dc_items"


def _one_pass(docs: DataFrame, items: list[tuple[str, bytes]], keep: list[str], window: int) -> DataFrame:
    """Add the occurrences of these items' windows to the hits and items of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    hit_type = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(shared.value, window)
        for batch in batches:
            for part in text_slices(batch, _TEXT):
                counts, spans, found = search.scan(texts(part, _TEXT))
                hits = [[{"first": a, "end": e} for a, e in
                         merged(s + [(x["first"], x["end"] - x["first"]) for x in old])]
                        for s, old in zip(spans, part.column(_HITS).to_pylist())]
                ids = [sorted(x.union(old)) for x, old in zip(found, part.column(_ITEMS).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in [*keep, _TEXT]), pa.array(counts, pa.int64()),
                     pa.array(hits, hit_type), pa.array(ids, pa.list_(pa.string()))],
                    names=[*keep, _TEXT, _N, _HITS, _ITEMS])

    return map_arrow(docs, run, spark_schema(docs, [*keep, _TEXT, _N, _HITS, _ITEMS]))


def _marked(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int) -> DataFrame:
    """The keep columns, the text and what was found in it, under internal names."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                             F.col("text").cast("binary").alias("text")).filter("text IS NOT NULL")
    n = _passes(benchmark)
    out = docs.select(*keep, F.col("text").alias(_TEXT), F.lit(0).cast("long").alias(_N),
                      F.expr("cast(array() as array<struct<first:int,end:int>>)").alias(_HITS),
                      F.expr("cast(array() as array<string>)").alias(_ITEMS))
    for k in range(n):   # each pass holds PASS_BYTES of the benchmark; the rows flow through all of them in one task
        own = items if n == 1 else items.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == k)
        out = _one_pass(out, [(r.item, bytes(r.text)) for r in own.collect()], keep, window)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text) → doc_id, n_words, hits (disjoint word spans [first, end) inside occurrences), items
    (sorted ids, as strings, of the items with an occurring window)."""
    out = _marked(docs, benchmark, ["doc_id"], window)
    return out.select("doc_id", F.col(_N).alias("n_words"), F.col(_HITS).alias("hits"), F.col(_ITEMS).alias("items"))


def removed(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents (all columns) in which no benchmark window occurs."""
    out = _marked(docs, benchmark, [c for c in docs.columns if c != "text"], window)
    return (out.filter(F.size(_ITEMS) == 0)
            .select(*(F.col(_TEXT).alias("text") if c == "text" else F.col(c) for c in docs.columns)))
