"""Boxes on pages: overlap pairs by grid cells, components by label propagation.

Boxes that lie alike on one page are one class: classes meet in cells, members only
where pairs of boxes are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PLACE = ("page", "x0", "y0", "x1", "y1")
#: Members of a class travel in chunks of about so many.
CHUNK = 512


def _solid(df: DataFrame) -> DataFrame:
    """Boxes that can overlap anything: named, placed, of some area."""
    return df.filter("id IS NOT NULL AND page IS NOT NULL AND x0 < x1 AND y0 < y1")


def class_pairs(df: DataFrame, least: float, cell: int) -> DataFrame:
    """(page, a_x0 .. a_y1, a_n, b_x0 .. b_y1, b_n, iou) of classes whose overlap over union reaches ``least``, each two once and a class with itself.

    Classes go to the cells they touch; a pair is kept in the cell of its overlap's corner.
    """
    classes = _solid(df).groupBy(*_PLACE).agg(F.count("*").alias("n"))
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    placed = classes.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))
    left, right = (placed.select("page", "cx", "cy", *[F.col(n).alias(f"{p}_{n}") for n in (*_PLACE[1:], "n")]) for p in "ab")
    box = lambda p: F.struct(*[F.col(f"{p}_{n}") for n in _PLACE[1:]])
    both = left.join(right, ["page", "cx", "cy"]).filter(box("a") <= box("b"))
    x0, y0 = F.greatest("a_x0", "b_x0"), F.greatest("a_y0", "b_y0")
    w, h = F.least("a_x1", "b_x1") - x0, F.least("a_y1", "b_y1") - y0
    once = both.filter((F.col("cx") == F.floor(x0 / cell)) & (F.col("cy") == F.floor(y0 / cell)) & (w > 0) & (h > 0))
    area = lambda p: (F.col(f"{p}_x1") - F.col(f"{p}_x0")) * (F.col(f"{p}_y1") - F.col(f"{p}_y0"))
    shared = (w * h).cast("double")
    return once.withColumn("iou", shared / (area("a") + area("b") - shared)).filter(F.col("iou") >= least).drop("cx", "cy")


def iou_pairs(df: DataFrame, least: float, cell: int, iou: Column | None = None) -> DataFrame:
    """(a, b, iou) with a < b of boxes (id, page, x0, y0, x1, y1) of one page whose overlap over union reaches ``least``.

    ``iou`` is what is reported of the column of that name, computed once for each pair
    of classes.  Members are dealt into chunks, so that a task holds two chunks of ids at
    a time however large a class is; every pair is written, and none is made in vain but
    inside a chunk.
    """
    alike = class_pairs(df, least, cell).withColumn("iou", F.col("iou") if iou is None else iou)
    alike = alike.select("page", *[F.struct(*[F.col(f"{p}_{n}") for n in _PLACE[1:]]).alias(p) for p in "ab"], F.col("a_n").alias("an"), F.col("b_n").alias("bn"), "iou")
    chunks = lambda n: F.ceil(F.col(n) / CHUNK)
    dealt = alike.select("page", "a", "b", "iou", "bn", F.explode(F.sequence(F.lit(0).cast("long"), chunks("an") - 1)).alias("i"))
    dealt = dealt.select("page", "a", "b", "iou", "i", F.explode(F.sequence(F.when(F.col("a") == F.col("b"), F.col("i")).otherwise(F.lit(0).cast("long")), chunks("bn") - 1)).alias("j"))
    rows = _solid(df).select("page", F.struct(*_PLACE[1:]).alias("box"), "id")
    sizes = rows.groupBy("page", "box").agg(F.count("*").alias("n"))
    held = rows.join(sizes, ["page", "box"]).withColumn("chunk", F.pmod(F.xxhash64("id"), chunks("n")))
    held = held.groupBy("page", "box", "chunk").agg(F.collect_list("id").alias("ids"))
    side = lambda p, k: held.select("page", F.col("box").alias(p), F.col("chunk").alias(k), F.col("ids").alias(f"{p}_ids"))
    met = dealt.join(side("a", "i"), ["page", "a", "i"]).join(side("b", "j"), ["page", "b", "j"])
    # What a task makes is not seen from the bytes it reads, so small partitions are not joined.
    spark = df.sparkSession
    met = met.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    own = (F.col("a") == F.col("b")) & (F.col("i") == F.col("j"))
    each = met.select("iou", own.alias("own"), F.explode("a_ids").alias("x"), "b_ids").select("iou", "own", "x", F.explode("b_ids").alias("y"))
    each = each.filter((F.col("x") < F.col("y")) | (~F.col("own") & (F.col("x") > F.col("y"))))
    return each.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "iou")


def box_components(df: DataFrame, least: float, cell: int) -> DataFrame:
    """(node, component) of boxes that overlap another by ``least``, without their pairs.

    A class is named by its least id; classes that overlap are linked, and so are those
    that share an id (an id may occur more than once).  ``least`` is at most 1, so that
    boxes of one class are linked.
    """
    rows = _solid(df)
    alike = class_pairs(df, least, cell)
    heads = rows.groupBy(*_PLACE).agg(F.min("id").alias("m"), F.max("id").alias("top"))
    end = lambda p: heads.select("page", *[F.col(n).alias(f"{p}_{n}") for n in _PLACE[1:]], F.col("m").alias(f"{p}_m"), F.col("top").alias(f"{p}_top"))
    linked = alike.join(end("a"), ["page", *[f"a_{n}" for n in _PLACE[1:]]]).join(end("b"), ["page", *[f"b_{n}" for n in _PLACE[1:]]])
    # A class of one id is linked to itself by no pair.
    linked = linked.filter((F.col("a_m") != F.col("b_m")) | (F.col("a_top") != F.col("b_m")) | (F.col("a_m") != F.col("b_top")))
    seats = rows.join(heads, list(_PLACE)).groupBy("id").agg(F.min("m").alias("m"), F.collect_set("m").alias("ms"))
    shared = seats.select(F.col("m").alias("a_m"), F.explode("ms").alias("b_m")).filter("a_m <> b_m")
    # Loops keep classes that meet no other.
    labels = components(linked.select("a_m", "b_m").unionByName(shared), "a_m", "b_m")
    return seats.join(labels.withColumnRenamed("node", "m"), "m").select(F.col("id").alias("node"), "component")


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node reachable; labels take the least of their neighbours and of their label's label until none changes."""
    spark = pairs.sparkSession
    edges = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(pairs.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct()
    if spark.sparkContext.getCheckpointDir() is None:
        import tempfile

        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp())  # a local master, as in tests
    edges = edges.checkpoint()
    labels = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")).checkpoint()
    while True:
        near = edges.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("c").alias("n"))
        jump = labels.select(F.col("u").alias("c"), F.col("c").alias("j"))
        moved = labels.join(near, "u").join(jump, "c").select("u", F.least("c", "n", "j").alias("c")).checkpoint()
        stable = moved.join(labels, ["u", "c"], "left_anti").isEmpty()
        labels = moved
        if stable:
            break
    return labels.select(F.col("u").alias("node"), F.col("c").alias("component"))
