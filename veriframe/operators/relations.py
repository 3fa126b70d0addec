"""Relations of three windows: a target that is an arithmetic combination of two sources, in neighbouring blocks.

Of three blocks that follow each other in a layout each may be the target. The three travel as one row, and their windows meet in
a Python worker by their directions (triples.py), so no window or pair of windows is shuffled; a relation is then verified. Long
blocks travel once for each part of the work, which grows with the square of their length.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .findings import keep_maximal
from .triples import RELATIONS, keep_largest, search

BAND = 64  # positions of windows that are compared in one group


def window_triples(b: DataFrame, key: str, layout: list[str], shortest: int = 3, longest: int = 6, rel: float = 1e-6, share: int = 80) -> DataFrame:
    """a, b, t, pa, pb, pt, length, relation, constant: the first relation that holds of six direct ones (constant 1), eight scaled and two weighted ones.

    Blocks of any length take part; the pairs of windows of longer ones than share values are dealt by share positions of the first.
    """
    if share < 1:
        raise ValueError("a share has one position at least")
    order = Window.partitionBy(*layout).orderBy(key)
    block = F.struct(F.col(key).alias("key"), F.col("vals").cast("array<double>").alias("vals"))
    three = b.select(block.alias("x"), F.lead(block).over(order).alias("y"), F.lead(block, 2).over(order).alias("z")).where("x.key is not null and y.key is not null and z.key is not null")
    kind = b.schema[key].dataType.simpleString()
    parts = F.ceil(F.greatest(F.lit(1), *[F.size(f"{x}.vals") for x in "xyz"]) / share).cast("int")
    three = three.select(*[F.col(f"{x}.{c}").alias(f"{c}_{x}") for c in ("key", "vals") for x in "xyz"], F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    three = three.repartition(int(b.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work: else a few tasks, or a large layout's one, do it all
    rows = three.mapInArrow(lambda batches: search(batches, shortest, longest, rel, share), f"a {kind}, b {kind}, t {kind}, pa int, pb int, pt int, length int, rank int, constant double")
    names = F.create_map(*[F.lit(x) for pair in RELATIONS.items() for x in pair])
    return rows.select("a", "b", "t", "pa", "pb", "pt", "length", names[F.col("rank")].alias("relation"), F.round("constant", 12).alias("constant"))


def maximal_triples(found: DataFrame) -> DataFrame:
    """Without those whose cells all lie in a longer one of the same blocks, relation and constant.

    A row is judged in the bands of positions where its windows begin; it is also sent to those where they end, which hold what may lie in it.
    """
    starts, bands = ["pa", "pb", "pt"], ["__pa", "__pb", "__pt"]
    rows = found.withColumn("__c", F.round("constant", 6))
    for p, k in zip(starts, bands, strict=True):
        band = lambda x: F.floor(x / BAND).cast("int")
        rows = rows.withColumn(k, F.explode(F.sequence(band(F.col(p)), band(F.col(p) + F.col("length") - 1))))
    own = reduce(and_, [F.col(k) == F.floor(F.col(p) / BAND) for p, k in zip(starts, bands, strict=True)])
    same = Window.partitionBy("a", "b", "t", "relation", "__c", *bands).orderBy(F.desc("length"), *starts)
    rows = rows.withColumns({"__own": own, "__first": F.row_number().over(same) == 1})
    front = ["a", "b", "t", "relation"]
    found = found.select(*front, *[c for c in found.columns if c not in front])
    return rows.select(*found.columns, "__own", "__first").mapInArrow(lambda batches: keep_largest(batches, starts), found.schema)


def maximal_windows(found: DataFrame) -> DataFrame:
    """The same of window_relations' rows."""
    spots = lambda p, k: F.transform(F.sequence(F.col(p), F.col(p) + F.col("length") - 1), lambda x: x * 2 + k)
    rows = found.withColumn("__spots", F.concat(spots("pa", 0), spots("pb", 1))).withColumns({"__c": F.round("constant", 6), "__o": F.coalesce(F.round("offset", 6), F.lit(0.0))})
    return keep_maximal(rows, ["a", "b", "relation", "__c", "__o"], "__spots", [F.desc("length"), "pa", "pb"]).drop("__spots", "__c", "__o")
