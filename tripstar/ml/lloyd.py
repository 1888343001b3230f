"""K-Means by Lloyd's rounds on whole numbers, so that a fit has one result.

Features are longs (coordinates in millionths of a degree, standard scores in ten-thousandths), sums are exact, and a
centre is its points' mean rounded half up. Nothing depends on partitions, on the order of rows or on a random
generator: two engines that run the same rounds reach the same centres, and a fit can be checked value by value.

A round is one scan of the points with partial aggregation: k rows a task are shuffled and k rows reach the driver,
however many points there are. The first centres are drawn one after the other with a chance in proportion to weight x
squared distance to the centres drawn so far; the draw is the least -ln(u) / chance, with u the md5 of the point and
the number of the draw, so it takes a top-1 a draw and no random generator. A point belongs to its nearest centre, of
several the first; a centre without points stays where it is. Rounds end at the fixpoint (the means of the centres'
points are the centres) or after ``rounds``. Fewer distinct points than k: as many centres as points. No points: no
centres. Points are distinct rows with a weight (:func:`collapsed`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of a fit at most.
ROUNDS = 20
Centre = tuple[int, ...]


def whole(value: Column, unit: int) -> Column:
    """The value in whole units, rounded half up."""
    return F.floor(value * F.lit(float(unit)) + F.lit(0.5)).cast("long")


def collapsed(points: DataFrame, features: list[str]) -> DataFrame:
    """The distinct points and the number of rows of each (weight)."""
    return points.groupBy(*features).agg(F.count(F.lit(1)).alias("weight"))


def _distances(features: list[str], centres: list[Centre]) -> Column:
    """Array of (squared distance, number) of the centres."""
    def far(centre: Centre) -> Column:
        parts = [(F.col(f) - F.lit(x)) * (F.col(f) - F.lit(x)) for f, x in zip(features, centre)]
        return sum(parts[1:], parts[0])

    return F.array(*[F.struct(far(c).alias("d"), F.lit(i).alias("c")) for i, c in enumerate(centres)])


def nearest(features: list[str], centres: list[Centre]) -> Column:
    """Number of the nearest centre: one expression, no join."""
    return F.array_min(_distances(features, centres))["c"]


def first_centres(points: DataFrame, features: list[str], k: int, weight: str = "weight") -> list[Centre]:
    centres: list[Centre] = []
    while len(centres) < k:
        name = F.md5(F.concat_ws(":", F.lit(str(len(centres))), *[F.col(f).cast("string") for f in features]))
        u = (F.conv(F.substring(name, 1, 8), 16, 10).cast("double") + F.lit(1.0)) / F.lit(float(2 ** 32))
        chance = F.col(weight).cast("double")
        if centres:
            chance = chance * F.array_min(_distances(features, centres))["d"].cast("double")
        draw = (points.select(*features, u.alias("__u"), chance.alias("__chance")).filter("__chance > 0")
                .orderBy(-F.ln("__u") / F.col("__chance"), *features).limit(1).select(*features).collect())
        if not draw:
            break
        centres.append(tuple(draw[0]))
    return centres


def moved(points: DataFrame, features: list[str], centres: list[Centre], weight: str) -> list[Centre]:
    """The centres after one round."""
    sums = [F.sum((F.col(f) * F.col(weight)).cast("decimal(38,0)")).alias(f) for f in features]
    rows = (points.groupBy(nearest(features, centres).alias("c"))
            .agg(F.sum(F.col(weight)).alias("n"), *sums).collect())      # k rows
    out = list(centres)
    for r in rows:
        out[r["c"]] = tuple((2 * int(r[f]) + r["n"]) // (2 * r["n"]) for f in features)
    return out


def fit(points: DataFrame, features: list[str], k: int, rounds: int = ROUNDS, weight: str = "weight") -> list[Centre]:
    """points(features long…, weight long) → the centres, in the order of the first ones."""
    centres = first_centres(points, features, k, weight)
    for _ in range(rounds if centres else 0):
        after = moved(points, features, centres, weight)
        if after == centres:
            break
        centres = after
    return centres
