"""Byte-level BPE encoding and decoding with DuckDB recursive queries, one database per Python worker.

Spark deals out the documents; in a task, each slice of texts is cut into words by the vocabulary's pattern and
the *distinct* words that are not whole tokens go through one recursive query: token-position rows are joined with
the merge table, each word contracts its leftmost pair of least rank, and the recursion ends when no word has a
pair left. Decoding joins (document, position, id) rows with the vocabulary and aggregates the pieces in order.

The vocabulary is read once on the driver from the path given and broadcast: a rank file is a fixed table (50,256
entries, under 1 MB), it never grows with the data. A task keeps the ids of words it has met (at most
:data:`CACHE_WORDS`; beyond that the memory starts afresh, results are the same), and gives back its database and
this memory when it ends, so idle workers hold neither.

Memory follows neither a text's nor a word's length: decoding goes by ranges of ids, whatever document they belong to, and
a recursive query, which keeps every state of its words, takes words up to a sum of squared lengths.

Null text: empty. Empty text: no ids. Words of over :data:`LONG_WORD` bytes (runs without any break) take the same
contractions from a heap, because a recursion of one merge a round over a 100 KB word would copy it 100,000 times.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstar.llm.base import map_arrow, spark_schema, text_slices

#: Words of a very long text encoded at once.
PART_WORDS = 200_000
#: Words remembered by a task; bytes from which a word is contracted by a heap; bytes of text in one slice; ids
#: decoded by one query; squared bytes of the words of one recursive query; its memory.
CACHE_WORDS, LONG_WORD, SLICE, DECODE_IDS, SQUARES, MEMORY = 400_000, 256, 2 << 20, 400_000, 16 << 20, "160MB"

CONTRACT = """
WITH RECURSIVE state(word, toks) AS (
    SELECT word, toks FROM words
    UNION ALL
    SELECT s.word, s.toks[:best.pos - 1] || [best.merged] || s.toks[best.pos + 2:]
    FROM state s JOIN (
        SELECT word, min(rank::BIGINT * 4294967296 + pos) AS least,
               (least >> 32)::INTEGER AS merged, (least & 4294967295)::INTEGER AS pos
        FROM (SELECT word, toks, unnest(range(1, len(toks))) AS pos FROM state)
        JOIN merges ON l = toks[pos] AND r = toks[pos + 1]
        GROUP BY word) best ON s.word = best.word
)
SELECT word, arg_min(toks, len(toks)) AS toks FROM state GROUP BY word ORDER BY word
"""

DECODE = """
SELECT doc, string_agg(piece, '' ORDER BY pos) AS chars FROM tokens JOIN vocab USING (id) GROUP BY doc
"""


class Vocabulary:
    """Ranks, pattern and the merge table of one rank file, kept by a worker process: a fixed size."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import numpy as np
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.first = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        self.merges = {"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()),
                       "rank": pa.array(rank, pa.int32())}
        # A token's bytes as a string of the characters 0 to 255, which ordered aggregation can join.
        self.pieces = {"id": pa.array(list(ranks.values()), pa.int32()),
                       "piece": pa.array([t.decode("latin-1") for t in ranks], pa.string())}


class Coder:
    """A task's DuckDB tables of a vocabulary and the words it has met."""

    def __init__(self, vocabulary: Vocabulary):
        import duckdb

        self.ranks, self.pattern, self.first = vocabulary.ranks, vocabulary.pattern, vocabulary.first
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self._table("merges", vocabulary.merges)
        self._table("vocab", vocabulary.pieces)
        self.known: dict[str, bytes] = {}   # word → its ids as 32-bit integers

    def close(self) -> None:
        self.con.close()
        self.known = {}

    def _table(self, name: str, columns: dict) -> None:
        self.con.register("incoming", pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def contract(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (as 32-bit integers in bytes), by recursive queries over batches."""
        import numpy as np

        ends, out, at = np.cumsum([len(w) ** 2 for w in words]), [], 0
        while at < len(words):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + SQUARES, side="right")))
            out += self._contract(words[at:stop])
            at = stop
        return out

    def _contract(self, words: list[bytes]) -> list[bytes]:
        import numpy as np

        offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int32)
        toks = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        self.con.register("words", pa.table({
            "word": pa.array(np.arange(len(words), dtype=np.int32)),
            "toks": pa.ListArray.from_arrays(pa.array(offsets), pa.array(toks))}))
        got = self.con.sql(CONTRACT).to_arrow_table().column("toks").combine_chunks()
        self.con.unregister("words")
        ends, ids = (got.offsets.to_numpy() * 4).tolist(), got.values.to_numpy().tobytes()
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def contract_long(self, word: bytes) -> list[int]:
        """The same contractions of one long word, the next pair taken from a heap of (rank, position)."""
        ids = [int(self.first[b]) for b in word]
        parts = [word[i:i + 1] for i in range(len(word))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (r := self.ranks.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        for i in range(len(parts)):
            offer(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else len(parts)
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue   # one of the two has been merged meanwhile
            parts[i], ids[i], parts[j], after[i] = a + b, r, None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [t for t, p in zip(ids, parts) if p is not None]

    def learn(self, words: set[str]) -> None:
        """Put the ids of all these words into ``known``."""
        todo, plain = [], []
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known = {}
        for w in words:
            if w in self.known:
                continue
            b = w.encode()
            if (whole := self.ranks.get(b)) is not None:
                self.known[w] = whole.to_bytes(4, "little")
            elif len(b) > LONG_WORD:
                self.known[w] = array("i", self.contract_long(b)).tobytes()
            else:
                todo.append(b), plain.append(w)
        if todo:
            self.known.update(zip(plain, self.contract(todo)))

    def encode(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text. A text of more than a slice is cut into words and encoded part by part."""
        import numpy as np

        long = [len(t) > SLICE for t in texts]
        cut = [None if far else self.pattern.findall(t) for t, far in zip(texts, long)]
        words: set[str] = set()
        for c in cut:
            words.update(c or ())
        self.learn(words)
        known = self.known.__getitem__
        ids = [b"".join(map(known, c)) if c is not None else b"" for c in cut]
        for i, far in enumerate(long):
            if far:
                ids[i] = b"".join(self._parts(texts[i]))
        ends = np.cumsum([0] + [len(x) // 4 for x in ids])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))

    def _parts(self, text: str) -> Iterator[bytes]:
        matches = self.pattern.finditer(text)
        while words := [m.group() for m in islice(matches, PART_WORDS)]:
            self.learn(set(words))
            yield b"".join(map(self.known.__getitem__, words))

    def decode(self, ids: pa.ListArray) -> list[bytes]:
        """The bytes of each list of ids (null: none)."""
        import numpy as np

        lengths = pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
        flat, out = ids.flatten().cast(pa.int32()), [[] for _ in range(len(ids))]
        for at in range(0, len(doc), DECODE_IDS):
            own = doc[at:at + DECODE_IDS]
            self.con.register("tokens", pa.table({"doc": own, "pos": np.arange(len(own), dtype=np.int32),
                                                  "id": flat.slice(at, DECODE_IDS)}))
            for d, chars in self.con.execute(DECODE).fetchall():
                out[d].append(chars.encode("latin-1"))
            self.con.unregister("tokens")
        return [b"".join(x) for x in out]


def read_ranks(path: str) -> bytes:
    """The rank file, read where the driver runs (a vocabulary of fixed size)."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


_VOCABULARIES: dict[int, Vocabulary] = {}


@contextmanager
def _coder(data: bytes, pattern: str) -> Iterator[Coder]:
    """A task's Coder; the vocabulary itself is read once a worker process."""
    key = hash((data, pattern))
    if key not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[key] = Vocabulary(parse_ranks(data), pattern)
    coder = Coder(_VOCABULARIES[key])
    try:
        yield coder
    finally:
        coder.close()


def _ids(batch: pa.RecordBatch, coder: Coder) -> Iterator[tuple[pa.RecordBatch, pa.ListArray]]:
    for part in text_slices(batch, "_text", SLICE):
        yield part, coder.encode([t or "" for t in part.column("_text").to_pylist()])


def encode(docs: DataFrame, ranks: bytes, pattern: str, keep: list[str], column: str = "text") -> DataFrame:
    """The ``keep`` columns and ``ids`` array<int>: the tokens of the whole text, without special tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _coder(shared.value, pattern) as coder:
            for batch in batches:
                for part, ids in _ids(batch, coder):
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), ids], names=[*keep, "ids"])

    return map_arrow(docs.select(*keep, docs[column].alias("_text")), run,
                     f"{spark_schema(docs, keep)}, ids array<int>")


def decode(tokens: DataFrame, ranks: bytes, pattern: str, keep: list[str]) -> DataFrame:
    """The ``keep`` columns, ``ids`` and ``decoded`` binary: the bytes that the ids stand for (null ids: none)."""
    shared = tokens.sparkSession.sparkContext.broadcast(ranks)
    columns = [*keep, "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _coder(shared.value, pattern) as coder:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(
                    coder.decode(batch.column("ids")), pa.binary())], names=[*columns, "decoded"])

    return map_arrow(tokens.select(*columns), run, f"{spark_schema(tokens, columns)}, decoded binary")


def encode_decode(docs: DataFrame, ranks: bytes, pattern: str, keep: list[str], column: str = "text") -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass of one worker: keep columns, ids and decoded."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _coder(shared.value, pattern) as coder:
            for batch in batches:
                for part, ids in _ids(batch, coder):
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in keep), ids, pa.array(coder.decode(ids), pa.binary())],
                        names=[*keep, "ids", "decoded"])

    return map_arrow(docs.select(*keep, docs[column].alias("_text")), run,
                     f"{spark_schema(docs, keep)}, ids array<int>, decoded binary")


def default_ranks() -> tuple[bytes, str]:
    """The public 50k byte-level vocabulary and the pattern that goes with it."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, ids and decoded for every whole text, with the public vocabulary."""
    ranks, pattern = default_ranks()
    return encode_decode(docs, ranks, pattern, ["doc_id"])


def checked_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids and lossless: whether the ids decode to the very bytes of the text."""
    ranks, pattern = default_ranks()
    keep = ["doc_id", "sha"]
    hashed = docs.withColumn("sha", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    out = encode_decode(hashed, ranks, pattern, keep)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                      (F.sha2("decoded", 256) == F.col("sha")).alias("lossless"))
