"""Phrase collocations by SETM: sorted occurrence relations, merge-joined by piece and adjacent position.

The relation of length k holds an occurrence a row: (piece, position, group), a group being a phrase of k words of
one language. It is written to the shared folder in *blocks* of a few MB of text of one language, sorted by piece
and position; pieces lie one after the other with an empty place between, so one number says both, and two places
that follow each other are adjacent positions of one piece. A pass over length k

1. merge-joins the relation with itself: occurrences at adjacent places, two groups of k words that overlap in all
   but one word, are an occurrence of the group (left, right) of k + 1 words;
2. group-counts: a block's distinct groups are dealt into buckets by group, exchanged once as a row a block and bucket
   (arrays of the parts and the counts) and summed over the blocks; the rows of groups counted often enough are
   written, in which a group is a number (its parts, a pair of numbers, stand on one row);
3. semi-joins: the frequent groups go back to the blocks that hold them, the other occurrences are dropped, and what
   is left is written as the relation of length k + 1. Relations are written in buckets by block, so they are never
   exchanged themselves.

Every part of a frequent phrase is frequent itself, so a candidate's cuts need no more than the counts of these
tables; and a candidate inside a longer one with nearly its count also lies in one that is longer by one word and
counted at least as often, so only those neighbours are compared.

All exchanges are of counted groups, never of one phrase's occurrences: a hot phrase is an entry a block. The shuffle
files of a pass are removed when its table is written. Nothing is
broadcast, since the frequent groups have no bound. Blocks are bounded in bytes whatever the document (a piece is never cut; one without any break is a block of its own size).

Null text: no words. Null language: ``und``. Texts without words, and an empty table, give no rows. Repeated rows
count as often as they occur. Extra columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripstar.llm.base import drop_written, map_arrow, texts, written, written_buckets
from tripstar.session import conf_scope

#: Occurrences a candidate needs; most words of a candidate; share (of 100) at which a longer candidate stands for it.
MIN_COUNT, MAX_WORDS, ABSORB = 30, 4, 80
#: Numbers of groups are exchanged as ints below this, else as longs.
INTS = 1 << 31
#: Shuffle files of a written table go when it is written, not when the driver collects garbage.
_CLEANUP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: UTF-8 bytes of text in a block; bytes a task holds in blocks that are not full yet; bytes made into words at once.
BLOCK, PENDING, CHUNK = 2 << 20, 8 << 20, 1 << 20

_STOP = b"."
# A-Z become a-z; the characters that end a piece become one of them, which then stands as a word between blanks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else _STOP[0] if c in b".,;:!?\x0a\x0b\x0c\x0d" else c for c in range(256))


def chunks(text: bytes, size: int | None = None) -> Iterator[bytes]:
    """A folded text in parts of about ``size`` bytes, cut after the end of a piece, else at a blank."""
    size, start = size or CHUNK, 0
    while start < len(text):
        stop = start + size
        if stop < len(text):
            cut = max(text.rfind(_STOP, start, stop), text.rfind(b" ", start, stop), text.rfind(b"\t", start, stop))
            if cut < start:   # one word of more than size bytes
                cut = min((x for x in (text.find(s, stop) for s in (_STOP, b" ", b"\t")) if x >= 0), default=len(text))
            stop = cut + 1
        yield text[start:stop]
        start = stop


class _Growing:
    """The relation of one language while it grows: word numbers in order, 0 where a piece ends."""

    def __init__(self):
        self.numbers = defaultdict(count().__next__)
        self.numbers[_STOP]
        self.parts, self.size = [], 0

    def add(self, text: bytes) -> None:
        import numpy as np

        for part in chunks(text.translate(_FOLD)):
            words = part.replace(_STOP, b" . ").split()
            self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.parts.append(np.zeros(1, np.int32))
        self.size += len(text)

    def row(self, block: int, lang: str) -> dict:
        import numpy as np

        stream = np.concatenate(self.parts)
        at = np.flatnonzero(stream)
        words = list(self.numbers)[1:]
        groups = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(
            np.bincount(stream[at] - 1, minlength=len(words)), pa.int32())], fields=list(_GROUP))
        return {"block": block, "lang": lang, "total": len(at), "step": _steps(at), "grp": stream[at] - 1,
                "groups": groups}


def _steps(at):
    """Places as distances from the one before: mostly ones, which compress to nothing."""
    import numpy as np

    return np.diff(at, prepend=0).astype(np.int32)


_INTS = pa.list_(pa.int32())
_GROUP = pa.struct([("phrase", pa.binary()), ("n", pa.int32())])
_FIRST = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("total", pa.int64()), ("step", _INTS),
                    ("grp", _INTS), ("groups", pa.list_(_GROUP))])
_NAMES = {pa.int64(): "long", pa.string(): "string", _INTS: "array<int>", pa.list_(pa.int64()): "array<long>",
          pa.list_(_GROUP): "array<struct<phrase:binary,n:int>>"}


def _kept(kind: str) -> pa.Schema:
    """A relation's blocks with the numbers of their groups, which are of that kind."""
    return pa.schema([("block", pa.int64()), ("step", _INTS), ("grp", _INTS),
                      ("ids", pa.list_(pa.int32() if kind == "int" else pa.int64()))])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_NAMES[f.type]}" for f in schema)


def _row(values: dict, schema: pa.Schema) -> pa.RecordBatch:
    """One row: a block. Arrays become lists."""
    def column(f):
        v = values[f.name]
        if not pa.types.is_list(f.type):
            return pa.array([v], f.type)
        v = v if isinstance(v, pa.Array) else pa.array(v, f.type.value_type)
        return pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)

    return pa.RecordBatch.from_arrays([column(f) for f in schema], schema=schema)


def occurrences(docs: DataFrame) -> DataFrame:
    """docs(text, lang) → the relation of single words, a row a block."""
    block, pending = BLOCK, PENDING

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = count(TaskContext.get().partitionId() << 32)
        open_: dict[str, _Growing] = defaultdict(_Growing)

        def close(lang):
            return _row(open_.pop(lang).row(next(numbers), lang), _FIRST)

        for batch in batches:
            for i in range(batch.num_rows):
                lang, text = batch.column("lang")[i].as_py(), texts(batch.slice(i, 1))[0]
                if not text:
                    continue
                open_[lang].add(text)
                if open_[lang].size >= block:
                    yield close(lang)
                elif sum(x.size for x in open_.values()) >= pending:
                    yield close(max(open_, key=lambda k: open_[k].size))
        for lang in list(open_):
            yield close(lang)

    return map_arrow(docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text"), run, _ddl(_FIRST))


def _bucket(left, right, parts: int):
    """The bucket of each group (left, right), the same in every block."""
    import numpy as np

    h = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64)
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(parts)).astype(np.int32)


def merge_join(step, grp, ids, parts: int):
    """A block of the relation of length k → its occurrences of length k + 1, adjacent places of one piece: places,
    own group numbers, and the distinct groups as (bucket, l, r, count). A group's number is its rank in that order."""
    import numpy as np

    follows, many = step[1:] == 1, max(len(ids), 1)
    pair = grp[:-1][follows].astype(np.int64) * many + grp[1:][follows]
    groups, own, n = np.unique(pair, return_inverse=True, return_counts=True)
    left, right = ids[groups // many], ids[groups % many]
    bucket = _bucket(left, right, parts)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return (np.cumsum(step, dtype=np.int64)[:-1][follows], rank[own],
            (bucket[order], left[order], right[order], n[order].astype(np.int32)))


def joined_groups(kept: DataFrame, parts: int, kind: str) -> DataFrame:
    """The groups of :func:`merge_join`, a row a block and bucket: bucket, block, number of the first, and the parts
    and counts as arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for i in range(batch.num_rows):
                step, grp, ids = (batch.column(c)[i].values.to_numpy() for c in ("step", "grp", "ids"))
                bucket, *arrays = merge_join(step, grp, ids, parts)[2]
                first = np.flatnonzero(np.diff(bucket, prepend=-1)).astype(np.int32)
                ends = pa.array(np.append(first, np.int32(len(bucket))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[first]), pa.array(np.full(len(first), batch.column("block")[i].as_py(), np.int64)),
                     pa.array(first), *[pa.ListArray.from_arrays(ends, pa.array(x)) for x in arrays]],
                    names=["bucket", "block", "first", "l", "r", "n"])

    return map_arrow(kept, run, f"bucket int, block long, first int, l array<{kind}>, r array<{kind}>, n array<int>")


def _dealt(packed: DataFrame, parts: int) -> DataFrame:
    """Groups of blocks, exchanged by bucket → a row a block and group: bucket, block, gid, l, r, n."""
    i = F.col("i")
    return packed.repartitionById(parts, F.col("bucket")).select(
        "bucket", "block", "first", "r", "n", F.posexplode("l").alias("i", "left")).select(
        "bucket", "block", (F.col("first") + i).alias("gid"), F.col("left").cast("long").alias("l"),
        F.col("r")[i].cast("long").alias("r"), F.col("n")[i].alias("n"))


def semi_join(relation: DataFrame, frequent: DataFrame) -> DataFrame:
    """The occurrences whose group is frequent. ``frequent``: (block, gid, id), a row a block and group it holds.
    A relation with a column ``buckets`` is merge-joined first: the groups are those of so many buckets."""
    # two lists, filled side by side: a list of pairs takes three times the bytes on its way
    own = frequent.groupBy("block").agg(F.collect_list("gid").alias("gid"), F.collect_list("id").alias("id"))
    joined = "buckets" in relation.columns
    held = ["ids", "buckets"] if joined else []
    both = relation.select("block", "step", "grp", *held).join(own.hint("merge"), "block")
    kept = _kept("int" if frequent.schema["id"].dataType.simpleString() == "int" else "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for i in range(batch.num_rows):
                step, grp, gid, ids = (batch.column(c)[i].values.to_numpy() for c in ("step", "grp", "gid", "id"))
                if joined:
                    at, grp, _ = merge_join(step, grp, batch.column("ids")[i].values.to_numpy(),
                                            batch.column("buckets")[i].as_py())
                else:
                    at = np.cumsum(step, dtype=np.int64)
                order = np.argsort(ids)   # parts that ascend take fewer bytes on their way
                number = np.full(max(int(grp.max(initial=-1)), int(gid.max(initial=-1))) + 1, -1, np.int32)
                number[gid[order]] = np.arange(len(gid))
                new = number[grp]
                stays = new >= 0
                yield _row({"block": batch.column("block")[i].as_py(), "step": _steps(at[stays]), "grp": new[stays],
                            "ids": ids[order]}, kept)

    return map_arrow(both, run, _ddl(kept))


def _placed(dealt: DataFrame, keys: list[str], least: int, parts: int, name: str) -> tuple[DataFrame, str]:
    """Groups of blocks, dealt by bucket → the frequent ones, still a row a block, with the group's number: (block, gid,
    id), and on one row of each group its keys and count; and the kind of the numbers. One exchange of the groups
    serves the count and the semi-join; a key has no more rows than there are blocks. The numbers are near dense: the
    group's rank in its bucket and the bucket."""
    own = Window.partitionBy(*keys, "bucket")
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy(*keys)).cast("long")
    rows = dealt.withColumn("row", F.monotonically_increasing_id()).select(
        "block", "bucket", "gid", *keys, "row", F.sum("n").over(own).alias("n"), F.min("row").over(own).alias("one"))
    one = F.col("row") == F.col("one")
    out = written(rows.filter(F.col("n") >= least).withColumn("id", (rank - 1) * parts + F.col("bucket")).select(
        "block", "gid", "id", *[F.when(one, F.col(c)).alias(c) for c in (*keys, "n")]), name)
    return out, "int" if (out.agg(F.max("id")).first()[0] or 0) < INTS else "long"


def _numbered(dealt: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Groups of blocks, dealt by bucket → the frequent groups, with their counts and a number of their own."""
    return dealt.groupBy(*keys, "bucket").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).withColumn(
        "id", F.monotonically_increasing_id())


def mined(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """docs(text, lang) → (words a language (lang, n), tables of frequent phrases of 1, 2, … words).

    A table's row: id, lang, phrase and last word (UTF-8 bytes), n, the counts of the phrase's first 1, 2, … words
    (``pre``) and last 1, 2, … words (``suf``), itself included, and the ids ``l`` and ``r`` of the phrases without
    its last and without its first word (null for single words)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with conf_scope(spark, _CLEANUP):
        return _passes(docs, min_count, max_words, parts)


def _passes(docs: DataFrame, min_count: int, max_words: int, parts: int) -> tuple[DataFrame, list[DataFrame]]:
    now = written_buckets(occurrences(docs), "block", parts, "occurrences")
    totals = written(now.groupBy("lang").agg(F.sum("total").alias("n")), "words")
    dealt = now.select("block", "lang", F.posexplode("groups").alias("gid", "g")).select(
        "block", "lang", "gid", "g.phrase", "g.n",
        F.pmod(F.hash("lang", "g.phrase"), F.lit(parts)).alias("bucket")).repartitionById(parts, F.col("bucket"))
    one = F.array(F.col("n"))
    placed, kind = _placed(dealt, ["lang", "phrase"], min_count, parts, "placed1")
    table = written(placed.filter(F.col("n").isNotNull()).select(
        "id", "lang", "phrase", F.col("phrase").alias("last"), "n", one.alias("pre"), one.alias("suf"),
        F.lit(None).cast("long").alias("l"), F.lit(None).cast("long").alias("r")), "phrases1")
    tables, relation = [table], now
    with conf_scope(docs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1"}):   # a row is a block
        for k in range(2, max_words + 1):
            kept = written_buckets(semi_join(relation, placed.select("block", "gid", F.col("id").cast(kind).alias("id"))),
                                   "block", parts, f"relation{k - 1}")
            drop_written(now)
            drop_written(placed)
            now, relation = kept, kept.withColumn("buckets", F.lit(parts))
            dealt = _dealt(joined_groups(kept, parts, kind), parts)
            if k < max_words:
                placed, kind = _placed(dealt, ["l", "r"], min_count, parts, f"placed{k}")
                found = placed.filter(F.col("n").isNotNull())
            else:      # nothing follows: the counts are enough
                found = _numbered(dealt, ["l", "r"], min_count)
            left = table.select(F.col("id").alias("l"), "lang", F.col("phrase").alias("head"), "pre")
            right = table.select(F.col("id").alias("r"), "last", "suf")
            table = written(found.select("id", "l", "r", "n").join(left, "l").join(right, "r").select(
                "id", "lang", F.concat("head", F.lit(b" "), "last").alias("phrase"), "last", "n",
                F.concat("pre", F.array("n")).alias("pre"), F.concat("suf", F.array("n")).alias("suf"), "l", "r"),
                f"phrases{k}")
            tables.append(table)
    drop_written(now)
    return totals, tables


#: The cut of the lowest score (the earliest of equal ones), as (score, words before the cut, l, r). The product may
#: pass 64 bits: decimals, divided as whole numbers.
_CUT = """array_min(transform(sequence(1, size(pre) - 1), k -> struct(
    (cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)))
        div (cast(element_at(pre, k) as decimal(20,0)) + cast(element_at(suf, size(suf) - k) as decimal(20,0))) as score,
    k as k, element_at(pre, k) as l, element_at(suf, size(suf) - k) as r)))"""


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> DataFrame:
    """docs(text, lang) → lang, phrase, a, l, r, n, score: the candidates that no longer one stands for."""
    totals, tables = mined(docs, min_count, max_words)
    out = None
    for own, longer in zip(tables[1:], [*tables[2:], None]):
        rows = own
        if longer is not None:
            for side in ("l", "r"):
                most = longer.groupBy(F.col(side).alias("id")).agg(F.max("n").alias(f"over_{side}"))
                rows = rows.join(most, "id", "left")
            over = F.greatest("over_l", "over_r").cast("decimal(20,0)")
            rows = rows.filter(over.isNull() | (over * 100 < F.col("n").cast("decimal(20,0)") * ABSORB))
        rows = rows.select("lang", F.col("phrase").cast("string").alias("phrase"), F.col("n").alias("a"), "pre", "suf")
        out = rows if out is None else out.unionAll(rows)
    cut = out.withColumn("cut", F.expr(_CUT))
    return cut.join(totals, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def ranked(found: DataFrame, first: int) -> DataFrame:
    """Each language's first phrases by score, count and phrase, with their rank from 1."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)


def oracle_sql(first: int) -> str:
    """The same rows in DuckDB SQL, counting every run of one to four words."""
    def runs(k):
        return (f"SELECT lang, {k} AS k, array_to_string(ws[i:i + {k - 1}], ' ') AS p "
                f"FROM (SELECT lang, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM piece WHERE len(ws) >= {k})")

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH piece AS (
    SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
                                            '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
f AS (SELECT lang, k, p, count(*) AS a FROM ({' UNION ALL '.join(runs(k) for k in range(1, MAX_WORDS + 1))})
      GROUP BY lang, k, p HAVING count(*) >= {MIN_COUNT}),
words AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM piece GROUP BY lang),
cuts AS (
    SELECT c.lang, c.k, c.p, c.a, cut, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a + r.a) AS score
    FROM (SELECT *, string_split(p, ' ') AS ws, unnest(range(1, k)) AS cut FROM f WHERE k > 1) c
    JOIN f l ON l.lang = c.lang AND l.p = array_to_string(ws[1:cut], ' ')
    JOIN f r ON r.lang = c.lang AND r.p = array_to_string(ws[cut + 1:], ' ')),
least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
inside AS (
    SELECT DISTINCT lang, array_to_string(ws[i:i + n - 1], ' ') AS p, a AS over FROM (
        SELECT lang, ws, n, a, unnest(range(1, k - n + 2)) AS i FROM (
            SELECT lang, k, a, string_split(p, ' ') AS ws, unnest(range(2, k)) AS n FROM f WHERE k > 2))),
left_out AS (SELECT DISTINCT lang, p FROM inside JOIN f USING (lang, p) WHERE 100 * over >= {ABSORB} * a),
ranks AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(p)) AS rank
          FROM least ANTI JOIN left_out USING (lang, p))
SELECT lang, rank::BIGINT AS rank, p AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n,
       score::BIGINT AS score
FROM ranks JOIN words USING (lang) WHERE rank <= {first}
"""
