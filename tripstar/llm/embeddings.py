"""Embedding near-duplicates by sorted projection passes.

Every pass hashes each vector, less the mean of its label's unit vectors, with its own random hyperplanes, orders the
vectors of a label lexicographically by the concatenated bits and compares each with its next :data:`WINDOW`
neighbours in that order; the exact cosine in double precision decides. Verified pairs of all passes are united to
components.

The number of passes follows what is measured in each label, not its size alone: a pair lies in one window if it
shares more bits than the rows at window distance do, so the prefixes these share, and the angle at which a pair right
at the threshold is seen from the label's mean, give the chance to miss it. A label gets passes until the mean of that
chance over a sample of its vectors is :data:`MISS` at most. Every label, of whatever size, goes through the first
:data:`AT_ONCE` passes; a label none of whose vectors has a neighbour beyond the window has then had all its pairs
compared. Where the passes still to come, by what was measured, would shuffle more vectors than all pairs of the label
in tiles (vectors that no hyperplane tells apart), the tiles are compared instead, and nothing is missed. A vector
whose whole window links with it has found its group and is not waited for.

The window bounds what one pass compares, not what is found: vectors of one component are then compared with each
other in tiles of about :data:`TILE` rows, and only counts come out, so ``n_links`` holds every link inside a
component however dense it is. Equal vectors of one label are one class from the start (a hot vector is one row
afterwards); a pass emits a spanning forest of the links it has verified, at most one row a vector.

Vectors link with nothing if the label is null, or the vector is null, zero, or holds a null or a non-finite
component; vectors of different lengths don't link. A vector with a null vec_id links like any other; as it has no id
to give, its component_id is the smallest vec_id it reaches, null if it reaches none, and kept is false. Rows that
repeat a vec_id are vectors of their own for n_links and one node for components. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstar.llm.base import map_arrow, ship_package, written
from tripstar.llm.components import connected_components

#: Contract value: least cosine of a link.
COSINE = 0.93
#: Neighbours compared with in a pass; mean chance to miss a pair at the threshold in all passes; rows of a tile.
WINDOW, MISS, TILE = 64, 0.005, 1024
#: Random bits of a pass (more than any order needs to tell apart); passes run in one job.
BITS, AT_ONCE = 62, 8
#: Vectors of a label, at least, whose chance to be missed is measured; unit of the sums that give a label's mean
#: (whole numbers, so that the mean doesn't depend on the order of the rows).
SAMPLE, UNIT = 2000, 1 << 24


def _digests(df: DataFrame) -> DataFrame:
    """vec_id, label, embedding, h1, h2: 128 bits of (label, vector); null h1 where the vector can't link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh3_128_digest

        for batch in batches:
            h1, h2 = [], []
            labels = batch.column("label").to_pylist()
            vectors = batch.column("embedding")
            for i in range(batch.num_rows):
                v = vectors[i].values
                x = None
                if labels[i] is not None and v is not None and len(v) and not v.null_count:
                    x = v.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0   # -0.0 is 0.0
                    if not (np.isfinite(x).all() and x.any()):
                        x = None
                if x is None:
                    h1.append(None), h2.append(None)
                else:
                    a, b = np.frombuffer(xxh3_128_digest(x.tobytes()), dtype="<i8").tolist()
                    h1.append(a), h2.append(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("embedding"),
                 pa.array(h1, pa.int64()), pa.array(h2, pa.int64())],
                names=["vec_id", "label", "embedding", "h1", "h2"])

    return map_arrow(df, run, "vec_id long, label long, embedding array<double>, h1 long, h2 long")


def _unit(vectors):
    import numpy as np

    x = np.array(vectors, dtype=np.float64)
    # by a power of two, which is exact: squares of very large or small components stay within the doubles
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _middles(classes: DataFrame) -> DataFrame:
    """classes(label, dim, vec) → label, dim, size, mid: the number and the mean of the unit vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        sums: dict[tuple[int, int], list] = {}

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in sums], pa.int64()), pa.array([k[1] for k in sums], pa.int32()),
                 pa.array([v[0] for v in sums.values()], pa.int64()),
                 pa.array([v[1] for v in sums.values()], pa.list_(pa.int64()))], names=["label", "dim", "n", "total"])

        for batch in batches:
            vectors, labels = batch.column("vec").to_pylist(), batch.column("label").to_numpy()
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                x = np.rint(_unit([vectors[i] for i in own]) * UNIT).astype(np.int64)
                names, at, n = np.unique(labels[own], return_inverse=True, return_counts=True)
                total = np.zeros((len(names), int(d)), dtype=np.int64)
                np.add.at(total, at, x)
                for name, k, t in zip(names.tolist(), n.tolist(), total):
                    have = sums.setdefault((name, int(d)), [0, 0])
                    have[0], have[1] = have[0] + k, have[1] + t
            if sum(k[1] for k in sums) > 1_000_000:
                yield flush()
                sums.clear()
        if sums:
            yield flush()

    parts = map_arrow(classes.select("label", "dim", "vec"), run, "label long, dim int, n long, total array<long>")
    each = (parts.select("label", "dim", "n", F.posexplode("total").alias("pos", "x")).groupBy("label", "dim", "pos")
            .agg(F.sum("n").alias("n"), F.sum("x").alias("x")))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("x") / F.col("n") / UNIT).alias("m")))),
                       lambda c: c["m"])
    return each.groupBy("label", "dim").agg(F.max("n").alias("size"), mean.alias("mid"))


def _projected(placed: DataFrame, first: int, last: int) -> DataFrame:
    """Each class once for every pass: pass, label, dim, key (the pass's bits of the vector less the mid), rep, vec,
    agree (of the sample: the chance that a vector at the threshold has the same bit, else -1), wide (the label is
    larger than a window)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        planes: dict[tuple[int, int], object] = {}
        for batch in batches:
            vectors, mids = batch.column("vec").to_pylist(), batch.column("mid").to_pylist()
            dims = batch.column("dim").to_numpy()
            groups, agree = {}, np.zeros(len(vectors))
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                x = _unit([vectors[i] for i in own]) - np.array([mids[i] for i in own], dtype=np.float64)
                groups[int(d)] = own, x
                far = np.maximum((x * x).sum(axis=1), 1e-12)
                agree[own] = 1 - np.arccos(np.clip(1 - (1 - COSINE) / far, -1, 1)) / np.pi
            agree = np.where(batch.column("probe").to_numpy(zero_copy_only=False), agree, -1.0)
            for p in range(first, last):
                key = np.zeros(len(vectors), dtype=np.int64)
                for d, (own, x) in groups.items():
                    if (p, d) not in planes:
                        planes[p, d] = np.random.default_rng([p, d]).standard_normal((d, BITS))
                    sign = x @ planes[p, d] > 0
                    key[own] = sign.astype(np.int64) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(vectors), p, np.int32)), batch.column("label"), pa.array(dims),
                     pa.array(key), batch.column("rep"), batch.column("vec"), pa.array(agree), batch.column("wide")],
                    names=["pass", "label", "dim", "key", "rep", "vec", "agree", "wide"])

    wide = (F.col("size") > WINDOW + 1).alias("wide")
    return map_arrow(placed.select("label", "dim", "rep", "vec", "mid", "probe", wide), run,
                     "pass int, label long, dim int, key long, rep long, vec array<double>, agree double, wide boolean")


def _forest(pairs) -> list[tuple[int, int]]:
    """Those of the pairs that join two sets not joined before."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _compare(rep, x, window: int, old: int = 0):
    """Links among rows in order; row pairs that both lie before ``old`` were compared earlier."""
    import numpy as np

    found = []
    for off in range(1, min(window, len(rep) - 1) + 1):
        lo = max(0, old - off)
        near = np.einsum("ij,ij->i", x[lo:len(x) - off], x[lo + off:]) >= COSINE
        at = np.flatnonzero(near) + lo
        found.extend(zip(rep[at].tolist(), rep[at + off].tolist()))
    return _forest(found)


def _missed(run: pa.Table, window: int, old: int):
    """rep and lost of the sampled rows that have a row at window distance, if that row isn't before ``old``: the
    logarithm of the chance that a row at the threshold lies outside the window, or 1 where the whole window links."""
    import numpy as np

    lo, n = max(0, old - window), run.num_rows
    agree = run.column("agree").to_numpy()
    at = lo + np.flatnonzero(agree[lo:max(lo, n - window)] >= 0)
    key = run.column("key").to_numpy()
    shared = BITS - np.frexp((key[at] ^ key[at + window]).astype(np.float64))[1]
    lost = np.log1p(-np.minimum(agree[at] ** (shared + 1.0), 1 - 1e-12))
    if len(at):
        vec = run.column("vec")
        x, y = (_unit(vec.take(pa.array(i)).to_pylist()) for i in (at, at + window))
        lost[np.einsum("ij,ij->i", x, y) >= COSINE] = 1.0
    return run.column("rep").to_numpy()[at], lost


_OUT = ("a long, b long, edge int, side int, at int, pass int, label long, dim int, key long, rep long, "
        "vec array<double>, agree double, lost double")


def _window_links(ordered: DataFrame) -> DataFrame:
    """Links between neighbours inside each sorted partition, the chances to miss one (lost), and the partition's
    first and last WINDOW rows (with the number of the boundary they lie at), which the neighbouring partition's rows
    still have to meet."""
    names = ["pass", "label", "dim", "key", "rep", "vec", "agree"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("edge", pa.int32()), ("side", pa.int32()),
                            ("at", pa.int32()), ("pass", pa.int32()), ("label", pa.int64()), ("dim", pa.int32()),
                            ("key", pa.int64()), ("rep", pa.int64()), ("vec", pa.list_(pa.float64())),
                            ("agree", pa.float64()), ("lost", pa.float64())])

        def rows(table: pa.Table, edge: int, side: int) -> pa.RecordBatch:
            n, null = table.num_rows, pa.nulls(table.num_rows, pa.int64())
            cols = [null, null, pa.array([edge] * n, pa.int32()), pa.array([side] * n, pa.int32()),
                    pa.array(range(n), pa.int32())]
            cols += [table.column(c).combine_chunks().cast(schema.field(c).type) for c in names]
            cols.append(pa.nulls(n, pa.float64()))
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        tail, head = None, None
        for batch in batches:
            new = pa.Table.from_batches([batch.select(names)])
            head = new.slice(0, WINDOW) if head is None else (
                pa.concat_tables([head, new.slice(0, WINDOW - head.num_rows)]) if head.num_rows < WINDOW else head)
            all_ = new if tail is None else pa.concat_tables([tail, new])
            old = all_.num_rows - new.num_rows
            for lo, hi in _runs(all_):
                if hi <= old or hi - lo < 2:
                    continue
                run_ = all_.slice(lo, hi - lo)
                links = _compare(run_.column("rep").to_numpy(), _unit(run_.column("vec").to_pylist()), WINDOW,
                                 max(0, old - lo))
                if links:
                    n = len(links)
                    cols = [pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())]
                    cols += [pa.nulls(n, f.type) for f in list(schema)[2:]]
                    yield pa.RecordBatch.from_arrays(cols, schema=schema)
                rep, lost = _missed(run_, WINDOW, max(0, old - lo))
                if len(rep):
                    own = {"label": run_.column("label")[:1], "dim": run_.column("dim")[:1]}
                    own = {c: pa.array(v.to_pylist() * len(rep), schema.field(c).type) for c, v in own.items()}
                    own |= {"rep": pa.array(rep), "lost": pa.array(lost)}
                    yield pa.RecordBatch.from_arrays([own.get(f.name, pa.nulls(len(rep), f.type)) for f in schema],
                                                     schema=schema)
            tail = all_.slice(max(0, all_.num_rows - WINDOW)).combine_chunks()
        if head is not None:
            yield rows(head, part, 1)
            yield rows(tail, part + 1, 0)

    return map_arrow(ordered, run, _OUT)


def _runs(table: pa.Table) -> list[tuple[int, int]]:
    """Stretches of equal (pass, label, dim)."""
    import numpy as np

    cols = [table.column(c).to_numpy() for c in ("pass", "label", "dim")]
    change = np.zeros(table.num_rows, dtype=bool)
    change[:1] = True
    for c in cols:
        change[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(change).tolist()
    return list(zip(at, [*at[1:], table.num_rows]))


def _across(table: pa.Table) -> pa.Table:
    """Links across one boundary: the last rows of a partition with the first of the next."""
    table = table.sort_by([("side", "ascending"), ("at", "ascending")])
    out = []
    for lo, hi in _runs(table):
        run = table.slice(lo, hi - lo)
        side = run.column("side").to_numpy()
        old = int((side == 0).sum())
        if 0 < old < len(side):
            out += _compare(run.column("rep").to_numpy(), _unit(run.column("vec").to_pylist()), WINDOW, old)
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


def _tile_links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The links of one tile pair, as a forest."""
    import numpy as np

    i, j = key[2].as_py(), key[3].as_py()
    tile, rep = table.column("tile").to_numpy(), table.column("rep").to_numpy()
    x = _unit(table.column("vec").to_pylist())
    left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
    found = []
    for lo in range(0, len(left), 128):
        own = left[lo:lo + 128]
        a, b = np.nonzero(x[own] @ x[right].T >= COSINE - 1e-9)
        a, b = own[a], right[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        near = np.einsum("ij,ij->i", x[a], x[b]) >= COSINE
        found = _forest(found + list(zip(rep[a[near]].tolist(), rep[b[near]].tolist())))
    return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})


def _tiles(members: DataFrame) -> DataFrame:
    """members(rep, tiles) → each row once for every tile pair (i, j) of its own tile with another."""
    return (members.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            .withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other")))


def _links(placed: DataFrame, middles: DataFrame) -> DataFrame:
    """placed(label, dim, rep, vec, mid, probe, size) → a, b: links that join the same vectors as all links do."""
    left = middles.filter(F.col("size") > 1).select("label", "dim", "size")
    whole, out, measured, done = left.limit(0), [], [], 0
    while left.limit(1).count():
        # a label that fits a window is not cut by a partition boundary: all its rows have the key 0 for the exchange
        ordered = (_projected(placed.join(left.select("label", "dim"), ["label", "dim"], "left_semi"),
                              done, done + AT_ONCE)
                   .repartitionByRange("pass", "label", "dim", *[F.when(F.col("wide"), F.col(c)).otherwise(F.lit(0)) for c in ("key", "rep")])
                   .sortWithinPartitions("pass", "label", "dim", "key", "rep"))
        found = written(_window_links(ordered), "pass-links")
        out += [found.filter("a IS NOT NULL").select("a", "b"),
                found.filter("edge IS NOT NULL").groupBy("edge").applyInArrow(_across, "a long, b long")]
        measured.append(found.filter("lost IS NOT NULL").select("label", "dim", "rep", "lost"))
        done += AT_ONCE
        each = reduce(DataFrame.unionAll, measured).groupBy("label", "dim", "rep").agg(
            F.when(F.max("lost") <= 0, F.avg("lost")).alias("rate"))
        need = each.groupBy("label", "dim").agg(F.count("*").alias("seen"), F.avg(F.exp(F.col("rate") * done)).alias("missed"),
                                                (F.log(F.lit(MISS)) / F.avg("rate")).alias("need"))
        # a label that fits a window has no row at window distance: nothing to measure, all pairs compared
        still = written(left.select("label", "dim", "size").join(need, ["label", "dim"], "left")
                        .filter((F.col("missed") > MISS) | (F.col("seen").isNull() & (F.col("size") > WINDOW + 1))),
                        "open-labels")
        # copies of a vector still to be shuffled: one a pass, or one a tile (need is null where nothing could be measured)
        tiles = F.coalesce(F.col("need") - done, F.lit(float("inf"))) * TILE >= F.col("size")
        whole = whole.unionAll(still.filter(tiles).select("label", "dim", "size"))
        left = still.filter(~tiles).select("label", "dim", "size")
    members = (placed.select("label", "dim", "rep", "vec").join(whole, ["label", "dim"])
               .withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int")))
    out.append(_tiles(members).groupBy("label", "dim", "i", "j").applyInArrow(_tile_links, "a long, b long"))
    return reduce(DataFrame.unionAll, out)


def _tile_counts(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For each row of one tile pair: the number of vectors of the other rows that it links with."""
    import numpy as np

    i, j = key[1].as_py(), key[2].as_py()
    tile, n = table.column("tile").to_numpy(), table.column("n").to_numpy()
    x, rep = _unit(table.column("vec").to_pylist()), table.column("rep").to_numpy()
    left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
    near = np.einsum("ij,kj->ik", x[left], x[right]) >= COSINE
    if i == j:
        np.fill_diagonal(near, False)
        reps, links = rep[left], near @ n[right]
    else:
        reps, links = np.concatenate([rep[left], rep[right]]), np.concatenate([near @ n[right], near.T @ n[left]])
    return pa.table({"rep": pa.array(reps, pa.int64()), "links": pa.array(links, pa.int64())})


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, embedding, label) → vec_id, n_links, component_id, kept."""
    ship_package(vectors.sparkSession)
    rows = _digests(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                                   F.col("embedding").cast("array<double>").alias("embedding")))
    rows = written(rows, "vectors")
    # equal digests are equal vectors but for the kind of a zero, so any of them will do; rep numbers the classes, since
    # a vec_id may be null or stand for several vectors
    classes = written(rows.filter("h1 IS NOT NULL").groupBy("label", "h1", "h2").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("embedding").alias("vec"))
        .withColumn("rep", F.monotonically_increasing_id()), "classes")
    sized = classes.select("label", F.size("vec").alias("dim"), "rep", "vec", "h1")
    middles = written(_middles(sized), "middles")
    probe = F.pmod(F.xxhash64(F.lit("probe"), "h1"), F.greatest(F.lit(1), F.floor(F.col("size") / SAMPLE))) == 0
    placed = sized.join(middles, ["label", "dim"]).select("label", "dim", "rep", "vec", "mid", probe.alias("probe"), "size")
    comp = written(connected_components(_links(placed, middles)), "components")

    member = (classes.join(comp, classes["rep"] == comp["node"])
              .select("component", "rep", "n", "vec"))
    sizes = comp.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    counts = written(_tiles(member.join(sizes, "component")).groupBy("component", "i", "j").applyInArrow(_tile_counts, "rep long, links long")
                     .groupBy("rep").agg(F.sum("links").alias("links")), "counts")
    # for components a vec_id is one node, however many vectors it stands for
    shared = classes.groupBy("least").agg(F.min("rep").alias("b"), F.count("*").alias("m")).filter("least IS NOT NULL AND m > 1")
    one = written(classes.join(shared, "least").select(F.col("rep").alias("a"), "b"), "same-ids")
    if not one.isEmpty():
        comp = written(connected_components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(one)), "components")
    of = classes.drop("vec").join(comp, classes["rep"] == comp["node"], "left").drop("node")
    named = of.filter("component IS NOT NULL").groupBy(F.col("component").alias("named")).agg(F.min("least").alias("name"))
    info = written(of.join(counts, "rep", "left").join(named, F.col("component") == F.col("named"), "left")
                   .select("label", "h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                           F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("name")).alias("component")),
                   "classes").withColumn("linked", F.lit(True))
    return (rows.select("vec_id", "label", "h1", "h2").join(info, ["label", "h1", "h2"], "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("linked"), F.col("component")).otherwise(F.col("vec_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
