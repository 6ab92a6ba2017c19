"""The queries of the library itself and their SQL, for ``__spark_entry__``.

Every query reads the given tables; distances are ranked unrounded and rounded
to six places in the output.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoscan import tables as T
from orthoscan.functions import names as N
from orthoscan.functions import vectors as V
from orthoscan.operators import box_join, boxes, cells, enrich, features, ingest, knn, knn_join, ranks
from orthoscan.plans import pruned, report
from orthoscan.sources import files, snapshots, vector_files
from orthoscan.sources.scratch import scratch_path
from orthoscan.streaming import ingest as streaming

QUERY_2D = (250_000.0, 9_500.0)
QUERY_PART = (25.0, 1_000.0)
KD_DEPTH, LEAF_SIZE = 3, 48
BASIS = features.fixed_projection(64, 5)
WEIGHTS = features.unit_weights(64)

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _rounded(found: DataFrame, *more: str) -> DataFrame:
    return found.select(*more, "record_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


def _first_vector(spark: SparkSession, sf_dir: str, dims: int | None = None) -> list[float]:
    row = ingest.lookup(T.embeddings(spark, sf_dir, dims), 0).select("features").first()
    return list(row[0]) if row else [0.0] * (dims or 64)


def _square(a: str, b: str, n: int) -> str:
    return " + ".join(f"power({a}[{i}]::DOUBLE - {b}[{i}]::DOUBLE, 2)" for i in range(1, n + 1))


def _knn_sql(dims: int, k: int) -> str:
    return f"""
SELECT vec_id AS record_id, round(d, 6) AS distance, row_number() OVER (ORDER BY d, vec_id) AS rank
FROM (SELECT e.vec_id, sqrt({_square("e.embedding", "q.embedding", dims)}) AS d FROM embeddings e, embeddings q WHERE q.vec_id = 0)
ORDER BY d, vec_id LIMIT {k}"""


ORDERS = "SELECT o_orderkey AS record_id, o_totalprice::FLOAT AS x, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::FLOAT AS y FROM orders"
PARTS = "SELECT p_partkey AS record_id, p_size::FLOAT AS x, p_retailprice::FLOAT AS y, p_brand, p_type FROM part"


def _point_sql(points: str, q: tuple[float, float], k: int) -> str:
    return f"""
SELECT record_id, round(d, 6) AS distance, row_number() OVER (ORDER BY d, record_id) AS rank
FROM (SELECT record_id, sqrt(power(x::DOUBLE - {q[0]}, 2) + power(y::DOUBLE - {q[1]}, 2)) AS d FROM ({points}))
ORDER BY d, record_id LIMIT {k}"""


# Nearest neighbours


@_query(_knn_sql(64, 10))
def knn_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(knn.knn(T.embeddings(spark, sf_dir), _first_vector(spark, sf_dir), 10))


@_query(_knn_sql(5, 10))
def knn_kd(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = T.embeddings(spark, sf_dir, 5)
    index = pruned.write_index(cells.kd_cells(points, 5, 5), 5)
    return _rounded(pruned.pruned_knn(index, _first_vector(spark, sf_dir, 5), 10)[0])


@_query(_knn_sql(5, 10))
def knn_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = T.embeddings(spark, sf_dir, 5)
    index = pruned.write_index(cells.str_leaves(points, LEAF_SIZE, 5), 5)
    return _rounded(pruned.pruned_knn(index, _first_vector(spark, sf_dir, 5), 10)[0])


def _batch_sql(k: int, self_too: bool) -> str:
    return f"""
SELECT qid, rank, record_id, round(d, 6) AS distance
FROM (SELECT q.vec_id AS qid, e.vec_id AS record_id, d.d, row_number() OVER (PARTITION BY q.vec_id ORDER BY d.d, e.vec_id) AS rank
      FROM embeddings q, embeddings e, LATERAL (SELECT sqrt({_square("e.embedding", "q.embedding", 64)}) AS d) d
      WHERE q.vec_id % 20 = 0{"" if self_too else " AND q.vec_id <> e.vec_id"})
WHERE rank <= {k}"""


def _batch(spark: SparkSession, sf_dir: str, exclude_self: bool) -> DataFrame:
    points = T.embeddings(spark, sf_dir)
    asked = points.where("record_id % 20 = 0").select(F.col("record_id").alias("qid"), "features")
    return _rounded(knn_join.knn_join(points, asked, 5, exclude_self), "qid")


@_query(_batch_sql(5, True))
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir, False)


@_query(_batch_sql(5, False))
def knn_batch_excl_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir, True)


@_query(_point_sql(ORDERS, QUERY_2D, 10))
def knn_2d_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(knn.knn(T.order_points(spark, sf_dir), QUERY_2D, 10))


@_query(_point_sql(ORDERS, QUERY_2D, 10))
def knn_2d_orders_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = pruned.write_index(cells.kd_cells(T.order_points(spark, sf_dir), 6, 2), 2)
    return _rounded(pruned.pruned_knn(index, QUERY_2D, 10)[0])


@_query("SELECT s_suppkey AS record_id, round(abs(s_acctbal::FLOAT::DOUBLE - 5000), 6) AS distance, row_number() OVER (ORDER BY abs(s_acctbal::FLOAT::DOUBLE - 5000), s_suppkey) AS rank FROM supplier")
def knn_k_gt_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = T.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("record_id"), F.array(F.col("s_acctbal").cast("float")).alias("features"))
    return _rounded(knn.knn(points, [5000.0], 1_000_000))


@_query(f"""
SELECT record_id, round(d, 6) AS distance, row_number() OVER (ORDER BY d, record_id) AS rank
FROM (SELECT record_id, sqrt(power(x::DOUBLE - 25, 2)) AS d FROM ({PARTS})) ORDER BY d, record_id LIMIT 50""")
def knn_ties_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = T.part_points(spark, sf_dir).select("record_id", V.truncate(F.col("features"), 1).alias("features"))
    return _rounded(knn.knn(points, QUERY_PART[:1], 50))


@_query(" UNION ALL ".join(f"SELECT {d}::INT AS dims, * FROM ({_knn_sql(d, 5)})" for d in features.DIMS))
def knn_by_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pruned.by_dims(T.embeddings(spark, sf_dir), _first_vector(spark, sf_dir), 5, features.DIMS), "dims")


@_query(" UNION ALL ".join(f"SELECT '{m}' AS method, {d}::INT AS dims, * FROM ({_knn_sql(d, 5)})" for m in ("linear", "kd", "rtree") for d in (2, 5)))
def knn_by_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a scan, by a stored index that is opened again, and by a method without an index for two dimensions."""
    points = T.embeddings(spark, sf_dir)
    prefix = lambda d: points.select("record_id", V.truncate(F.col("features"), d).alias("features"))
    kd = {d: pruned.open_index(spark, pruned.write_index(cells.kd_cells(prefix(d), 4, d), d).path) for d in (2, 5)}
    rtree = {5: pruned.write_index(cells.str_leaves(prefix(5), LEAF_SIZE, 5), 5)}
    return _rounded(pruned.by_methods(points, {"kd": kd, "rtree": rtree}, _first_vector(spark, sf_dir), 5, (2, 5)), "method", "dims")


@_query()
def knn_cells_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells an index over the orders has, and how many a search reads."""
    index = pruned.write_index(cells.kd_cells(T.order_points(spark, sf_dir), 6, 2), 2)
    stats = pruned.pruned_knn(index, QUERY_2D, 10)[1]
    return spark.createDataFrame([(stats["cells_total"], stats["cells_scanned"])], "cells_total long, cells_scanned long")


@_query(f"""
SELECT record_id, round(d, 6) AS distance, row_number() OVER (ORDER BY d, record_id) AS rank, x, y
FROM (SELECT *, sqrt(power(x::DOUBLE - {QUERY_2D[0]}, 2) + power(y::DOUBLE - {QUERY_2D[1]}, 2)) AS d FROM ({ORDERS})) ORDER BY d, record_id LIMIT 10""")
def knn_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results' own coordinates beside their ranks."""
    found = knn.knn(T.order_points(spark, sf_dir), QUERY_2D, 10)
    return _rounded(found.withColumns({"x": F.col("features")[0], "y": F.col("features")[1]}), "x", "y")


@_query("SELECT vec_id AS record_id, (" + " AND ".join(f"embedding[{i}] BETWEEN -0.1 AND 0.1" for i in range(1, 5)) + ") AS inside, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS length FROM embeddings")
def point_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a vector's first four elements lie in a box, and the vector's length."""
    lo, hi = (F.array(*[F.lit(x).cast("float")] * 4) for x in (-0.1, 0.1))
    return T.embeddings(spark, sf_dir).select("record_id", V.contains(lo, hi, V.truncate(F.col("features"), 4)).alias("inside"), F.round(V.norm(F.col("features")), 6).alias("length"))


@_query("SELECT p_partkey AS record_id, p_size::FLOAT::DOUBLE AS a, p_retailprice::FLOAT::DOUBLE AS b, round((p_size::FLOAT::DOUBLE * "
        + " + p_retailprice::FLOAT::DOUBLE * ".join(map(repr, features.unit_weights(2, 42))) + ")::FLOAT::DOUBLE, 2) AS filled FROM part")
def select_with_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three named columns one is missing; a projection of the others takes its place."""
    chosen = features.select_features(T.read(spark, sf_dir, "part"), ("p_size", "no_such_column", "p_retailprice"))
    at = lambda i: F.col("features")[i].cast("double")
    return chosen.select(F.col("p_partkey").alias("record_id"), at(0).alias("a"), at(1).alias("b"), F.round(at(2), 2).alias("filled"))


@_query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.class_counts(T.embeddings(spark, sf_dir), "label")


@_query(_point_sql(ORDERS, QUERY_2D, 10))
def knn_with_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the orders arrives after the index was built and is found all the same."""
    points = T.order_points(spark, sf_dir)
    index = pruned.write_index(cells.kd_cells(points.where("record_id % 3 <> 0"), 4, 2), 2)
    return _rounded(pruned.pruned_knn(pruned.append(index, points.where("record_id % 3 = 0")), QUERY_2D, 10)[0])


@_query(f"""
WITH p AS MATERIALIZED (SELECT record_id, x::DOUBLE AS x, y::DOUBLE AS y FROM ({ORDERS})),
d AS (SELECT q.record_id AS qid, p.record_id, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS d FROM p q, p WHERE q.record_id % 20 = 0),
n AS (SELECT qid, unnest(arg_min({{'record_id': record_id, 'd': d}}, {{'d': d, 'record_id': record_id}}, 3)) AS e FROM d GROUP BY qid)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY e.d, e.record_id) AS rank, e.record_id AS record_id, round(e.d, 6) AS distance FROM n""")
def knn_join_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest orders of each order whose key is divisible by 20, by price and day."""
    points = T.order_points(spark, sf_dir)
    asked = points.where("record_id % 20 = 0").select(F.col("record_id").alias("qid"), "features")
    return _rounded(knn_join.knn_join(points, asked, 3), "qid")


# Boxes


@_query("SELECT o_orderkey AS record_id FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 AND o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def range_box_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.read(spark, sf_dir, "orders").where(F.col("o_orderdate").cast("date").between("1996-01-01", "1996-12-31"))
    return boxes.range_search(rows, ["o_totalprice"], [100_000.0], [200_000.0]).select(F.col("o_orderkey").alias("record_id"))


@_query("SELECT vec_id AS record_id FROM embeddings WHERE embedding[1] BETWEEN -0.1 AND 0.1 AND embedding[2] BETWEEN -0.1 AND 0.15 AND embedding[3] BETWEEN -0.2 AND 0.1")
def range_box_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = pruned.write_index(cells.kd_cells(T.embeddings(spark, sf_dir, 3), 4, 3), 3)
    return pruned.pruned_range(index, [-0.1, -0.1, -0.2], [0.1, 0.15, 0.1]).select("record_id")




@_query(f"""
WITH b AS (SELECT p_brand || '/' || g AS id, min(x) AS lo0, min(y) AS lo1, max(x) AS hi0, max(y) AS hi1
           FROM (SELECT *, record_id // 500 AS g FROM ({PARTS})) GROUP BY p_brand, g)
SELECT a.id AS left_id, c.id AS right_id FROM b a, b c
WHERE a.lo0 <= c.hi0 AND a.hi0 >= c.lo0 AND a.lo1 <= c.hi1 AND a.hi1 >= c.lo1 AND a.id < c.id""")
def box_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.concat_ws("/", "p_brand", F.floor(F.col("record_id") / 500).cast("string"))
    found = boxes.bounding_boxes(T.part_points(spark, sf_dir).withColumn("id", group), "id", 2)
    return box_join.overlap_pairs(found)


LABEL_BOXES = "SELECT label, " + ", ".join(f"min(embedding[{i}]) AS lo{i}, max(embedding[{i}]) AS hi{i}" for i in (1, 2, 3)) + ", count(*) AS n FROM embeddings GROUP BY label"
_VOLUME = " * ".join(f"(hi{i}::DOUBLE - lo{i}::DOUBLE)" for i in (1, 2, 3))


def _label_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.bounding_boxes(T.embeddings(spark, sf_dir, 3), "label", 3)


@_query("SELECT label, axis, round(min(x)::DOUBLE, 6) AS lo, round(max(x)::DOUBLE, 6) AS hi, count(*) AS n FROM (SELECT label, (unnest(range(64)))::INT AS axis, unnest(embedding) AS x FROM embeddings) GROUP BY label, axis")
def mbr_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boxes.bounding_boxes(T.embeddings(spark, sf_dir), "label", 64)
    axes = found.select("label", "n", F.posexplode(F.arrays_zip("lo", "hi")).alias("axis", "e"))
    return axes.select("label", "axis", F.round(F.col("e.lo").cast("double"), 6).alias("lo"), F.round(F.col("e.hi").cast("double"), 6).alias("hi"), "n")


@_query(f"SELECT label, round({_VOLUME}, 6) AS volume FROM ({LABEL_BOXES})")
def mbr_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _label_boxes(spark, sf_dir).select("label", F.round(V.volume(F.col("lo"), F.col("hi")), 6).alias("volume"))


_GROWN = " * ".join(f"(greatest(b.hi{i}, e.embedding[{i}])::DOUBLE - least(b.lo{i}, e.embedding[{i}])::DOUBLE)" for i in (1, 2, 3))
_OWN = " * ".join(f"(b.hi{i}::DOUBLE - b.lo{i}::DOUBLE)" for i in (1, 2, 3))


@_query(f"SELECT e.vec_id AS record_id, b.label, round({_GROWN} - {_OWN}, 6) AS growth FROM embeddings e JOIN ({LABEL_BOXES}) b ON b.label = (e.label + 1) % 10")
def mbr_enlargement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the next label's box would grow by each vector."""
    points = T.embeddings(spark, sf_dir, 3).select("record_id", "features", ((F.col("label") + 1) % 10).alias("label"))
    p = F.col("features")
    return points.join(_label_boxes(spark, sf_dir), "label").select("record_id", "label", F.round(V.enlargement(F.col("lo"), F.col("hi"), p, p), 6).alias("growth"))


@_query("SELECT e.vec_id AS record_id, b.label, round(sqrt(" + " + ".join(f"power(e.embedding[{i}]::DOUBLE - least(greatest(e.embedding[{i}]::DOUBLE, b.lo{i}::DOUBLE), b.hi{i}::DOUBLE), 2)" for i in (1, 2, 3)) + f"), 6) AS mindist FROM embeddings e, ({LABEL_BOXES}) b WHERE e.vec_id % 20 = 0")
def mindist_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = T.embeddings(spark, sf_dir, 3).where("record_id % 20 = 0").select("record_id", "features")
    zones = _label_boxes(spark, sf_dir).agg(F.collect_list(F.struct("label", "lo", "hi")).alias("zones"))  # a row a label
    each = asked.select("record_id", "features", F.inline(zones.scalar()))
    return each.select("record_id", "label", F.round(F.sqrt(V.min_squared_distance(F.col("lo"), F.col("hi"), F.col("features"))), 6).alias("mindist"))


_PAIR = " * ".join(f"(greatest(a.hi{i}, b.hi{i})::DOUBLE - least(a.lo{i}, b.lo{i})::DOUBLE)" for i in (1, 2, 3))


@_query(f"""
WITH v AS (SELECT *, {_VOLUME} AS vol FROM ({LABEL_BOXES}))
SELECT 0 AS parent, a.label AS a, b.label AS b, round({_PAIR} - a.vol - b.vol, 6) AS waste
FROM v a JOIN v b ON a.label < b.label ORDER BY {_PAIR} - a.vol - b.vol DESC, a.label, b.label LIMIT 1""")
def dead_space_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boxes.seed_pairs(_label_boxes(spark, sf_dir).select(F.lit(0).alias("parent"), F.col("label").alias("node"), "lo", "hi"), "parent")
    return found.withColumn("waste", F.round("waste", 6))


@_query(f"""
WITH v AS (SELECT *, {_VOLUME} AS vol FROM (SELECT label, {", ".join(f"min(embedding[{i}]) AS lo{i}, max(embedding[{i}]) AS hi{i}" for i in (1, 2, 3))} FROM embeddings WHERE vec_id % 2 = 0 GROUP BY label))
SELECT record_id, node FROM (
  SELECT e.vec_id AS record_id, b.label AS node, row_number() OVER (PARTITION BY e.vec_id ORDER BY {_GROWN} - b.vol, b.vol, b.label) AS r
  FROM embeddings e, v b WHERE e.vec_id % 2 = 1) WHERE r = 1""")
def choose_leaf_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with odd ids arrive; the labels' boxes of the even ones are the leaves."""
    points = T.embeddings(spark, sf_dir, 3)
    leaves = boxes.bounding_boxes(points.where("record_id % 2 = 0"), "label", 3).withColumnRenamed("label", "node")
    return boxes.choose_leaf(points.where("record_id % 2 = 1"), leaves)


@_query("SELECT label, (list_position(s, list_max(s)) - 1)::INT AS axis FROM (SELECT label, [" + ", ".join(f"var_pop(embedding[{i}]::DOUBLE)" for i in range(1, 65)) + "] AS s FROM embeddings GROUP BY label)")
def split_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.widest_variance_axis(T.embeddings(spark, sf_dir), "label", 64)


# Cells


def _kd_sql(depth: int) -> str:
    sql = f"SELECT *, 0 AS cell FROM ({ORDERS})"
    for level in range(depth):
        sql = f"""SELECT record_id, x, y, cell * 2 + CASE WHEN r > n // 2 THEN 1 ELSE 0 END AS cell
FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY {"xy"[level % 2]}, record_id) AS r, count(*) OVER (PARTITION BY cell) AS n FROM ({sql}))"""
    return sql


@_query(f"SELECT record_id, cell::INT AS cell FROM ({_kd_sql(KD_DEPTH)})")
def kd_cells_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.kd_cells_exact(T.order_points(spark, sf_dir), KD_DEPTH, 2).select("record_id", F.col("cell").cast("int").alias("cell"))


@_query(f"SELECT cell::INT AS cell, count(*) AS n, min(x)::DOUBLE AS lo0, min(y)::DOUBLE AS lo1, max(x)::DOUBLE AS hi0, max(y)::DOUBLE AS hi1 FROM ({_kd_sql(KD_DEPTH)}) GROUP BY cell")
def zone_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = cells.zone_map(cells.kd_cells_exact(T.order_points(spark, sf_dir), KD_DEPTH, 2), 2)
    return zones.select(F.col("cell").cast("int").alias("cell"), "n", *[F.col(c)[i].cast("double").alias(f"{c}{i}") for c in ("lo", "hi") for i in (0, 1)])


_STR = f"""
WITH p AS ({PARTS}), k AS (SELECT ceil(count(*) / {LEAF_SIZE}) AS leaves FROM p),
s AS (SELECT ceil(sqrt(leaves) - 1e-9) AS s0, ceil(leaves / ceil(sqrt(leaves) - 1e-9)) AS s1 FROM k),
a AS (SELECT p.*, floor((row_number() OVER (ORDER BY x, record_id) - 1) * s0 / count(*) OVER ()) AS slab, s1 FROM p, s),
b AS (SELECT *, (slab * s1 + floor((row_number() OVER (PARTITION BY slab ORDER BY y, record_id) - 1) * s1 / count(*) OVER (PARTITION BY slab)))::BIGINT AS cell FROM a)"""


@_query(_STR + " SELECT record_id, cell FROM b")
def str_pack_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.str_leaves(T.part_points(spark, sf_dir), LEAF_SIZE, 2).select("record_id", F.col("cell").cast("long").alias("cell"))


@_query(_STR + """, RECURSIVE_TOP AS (SELECT max(cell) AS m FROM b)
SELECT (1 + CASE WHEN m = 0 THEN 0 WHEN m < 8 THEN 1 WHEN m < 64 THEN 2 WHEN m < 512 THEN 3 WHEN m < 4096 THEN 4 WHEN m < 32768 THEN 5 ELSE 6 END)::INT AS height FROM RECURSIVE_TOP""")
def tree_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels above the packed leaves of the parts, eight nodes to a parent."""
    zones = cells.zone_map(cells.str_leaves(T.part_points(spark, sf_dir), LEAF_SIZE, 2), 2)
    return cells.tree_height(zones, 8, 2)


@_query("""
SELECT d::INT AS dims, count(*) AS records, floor(4092 / (4 * d))::INT AS per_page, ceil(count(*) / floor(4092 / (4 * d)))::BIGINT AS pages,
       floor(4088 / (8 * d + 4))::INT AS capacity, greatest(1, floor(floor(4088 / (8 * d + 4)) * 2 / 5))::INT AS minimum
FROM embeddings, (VALUES (2), (5), (10), (20), (30)) AS t(d) WHERE len(embedding) >= d GROUP BY d""")
def node_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and tree nodes that the vectors, cut to each number of dimensions, would take."""
    d = F.col("dims")
    wide = T.embeddings(spark, sf_dir).select(F.explode(F.filter(F.array(*[F.lit(x) for x in features.DIMS]), lambda x: x <= F.size("features"))).alias("dims"))
    counts = wide.groupBy("dims").agg(F.count("*").alias("records"))
    return counts.select("dims", "records", N.records_per_page(d).alias("per_page"), F.ceil(F.col("records") / N.records_per_page(d)).alias("pages"), N.node_capacity(d).alias("capacity"), N.node_minimum(d).alias("minimum"))


@_query("SELECT vec_id AS record_id, (vec_id // 15 + 1)::BIGINT AS page, (vec_id % 15)::BIGINT AS slot FROM embeddings")
def page_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = F.size("features")
    return T.embeddings(spark, sf_dir).select("record_id", N.page_of(F.col("record_id"), dims).alias("page"), N.slot_of(F.col("record_id"), dims).alias("slot"))


# Features


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.select_features(T.read(spark, sf_dir, "lineitem"), _NUMERIC)


@_query(" UNION ALL ".join(f"SELECT {i} AS axis, round(avg({c}::FLOAT::DOUBLE), 6) AS mean, round(stddev_pop({c}::FLOAT::DOUBLE) + 1e-9, 6) AS std FROM lineitem" for i, c in enumerate(_NUMERIC)))
def feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_stats(_line_points(spark, sf_dir), len(_NUMERIC)).select("axis", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@_query("SELECT vec_id AS record_id, " + ", ".join(f"round((embedding[{i}]::DOUBLE - avg(embedding[{i}]::DOUBLE) OVER ()) / (stddev_pop(embedding[{i}]::DOUBLE) OVER () + 1e-9), 6) AS z{i}" for i in range(1, 65)) + " FROM embeddings")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = T.embeddings(spark, sf_dir)
    scaled = features.standardise(points, *features.stats_arrays(points, 64))
    return scaled.select("record_id", *[F.round(F.col("features")[i], 6).alias(f"z{i + 1}") for i in range(64)])


@_query(" UNION ALL ".join(f"SELECT vec_id AS record_id, {d}::INT AS dims, round(list_sum(list_transform(embedding[1:{d}], lambda x: x::DOUBLE)), 6) AS total FROM embeddings" for d in features.DIMS))
def slice_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = T.embeddings(spark, sf_dir)
    each = points.select("record_id", "features", F.explode(F.array(*[F.lit(d) for d in features.DIMS])).alias("dims"))
    return each.select("record_id", "dims", F.round(F.aggregate(F.slice("features", F.lit(1), F.col("dims")), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def _dot_sql(weights: list[float]) -> str:
    return " + ".join(f"embedding[{i}]::DOUBLE * ({w!r})" for i, w in enumerate(weights, start=1))


@_query(f"SELECT vec_id AS record_id, round({_dot_sql(WEIGHTS)}, 6) AS projected FROM embeddings")
def random_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.random_projection(T.embeddings(spark, sf_dir), WEIGHTS).select("record_id", F.round("projected", 6).alias("projected"))


@_query("SELECT vec_id AS record_id, " + ", ".join(f"round({_dot_sql(row)}, 5) AS p{i}" for i, row in enumerate(BASIS)) + " FROM embeddings")
def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A given model applied to the vectors; its mean is 0 and its std 1."""
    model = features.Projection([0.0] * 64, [1.0] * 64, BASIS)
    scaled = features.standardise(T.embeddings(spark, sf_dir), model.mean, model.std)
    return scaled.select("record_id", *[F.round(V.dot(F.col("features"), row), 5).alias(f"p{i}") for i, row in enumerate(model.components)])


@_query()
def pca_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors in five principal components of their own; signs are fixed by the largest loading."""
    points = T.embeddings(spark, sf_dir)
    found = features.fit_projection(points, 64, 5).apply(points)
    return found.select("record_id", *[F.round(F.col("features")[i].cast("double"), 3).alias(f"p{i}") for i in range(5)])


@_query("""
WITH n AS (SELECT count(*) AS n FROM embeddings)
SELECT c * n + vec_id AS record_id, vec_id AS original, label FROM embeddings, n, range(3) AS t(c) WHERE c * n + vec_id < (5 * n) // 2""")
def augment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = T.embeddings(spark, sf_dir, 3)
    n = points.count()
    return features.augment(points, 5 * n // 2, 3).select("record_id", F.pmod("record_id", F.lit(n)).alias("original"), "label")


# Metadata


@_query("""
WITH n AS (SELECT count(*) AS n FROM supplier), m AS (SELECT s_suppkey AS pos, replace(s_name, '#', '.') || '.' || (s_suppkey % 7) || '.wav' AS filename FROM supplier)
SELECT o_orderkey AS record_id, filename, split_part(filename, '.', 1) AS genre FROM orders, n LEFT JOIN m ON m.pos = o_orderkey % n""")
def enrich_modulo(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = T.read(spark, sf_dir, "supplier")
    name = F.concat(F.replace("s_name", F.lit("#"), F.lit(".")), F.lit("."), (F.col("s_suppkey") % 7).cast("string"), F.lit(".wav"))
    results = T.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"))
    return enrich.audio(results, sup.select(F.col("s_suppkey").alias("pos"), name.alias("filename")), sup.count()).select("record_id", "filename", "genre")


@_query("""
WITH m AS (SELECT page_id AS pos, page_id * 3 AS record_id, url AS filepath, CASE WHEN page_id % 5 = 0 THEN NULL ELSE 'page ' || page_id END AS label FROM pages), n AS (SELECT count(*) AS n FROM m)
SELECT c.c_custkey AS record_id, CASE WHEN e.record_id IS NOT NULL THEN e.filepath ELSE o.filepath END AS filepath,
       CASE WHEN e.record_id IS NOT NULL THEN e.label ELSE o.label END AS label
FROM customer c CROSS JOIN n LEFT JOIN m e ON e.record_id = c.c_custkey LEFT JOIN m o ON o.pos = c.c_custkey % n""")
def enrich_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = T.read(spark, sf_dir, "pages")
    label = F.when(F.col("page_id") % 5 != 0, F.concat(F.lit("page "), F.col("page_id").cast("string")))
    meta = pages.select(F.col("page_id").alias("pos"), (F.col("page_id") * 3).alias("record_id"), F.col("url").alias("filepath"), label.alias("label"))
    return enrich.by_id_or_position(T.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id")), meta, pages.count())


_AUDIO_NAME = "replace(p_name, ' ', '.') || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.' || (p_partkey % 10) ELSE '.x' END || '.wav'"


@_query(f"""
WITH t AS (SELECT p_partkey AS record_id, {_AUDIO_NAME} AS f, regexp_replace({_AUDIO_NAME}, '\\.wav$', '') AS b FROM part),
u AS (SELECT *, string_split(b, '.') AS s FROM t)
SELECT record_id, '/audio/' || split_part(f, '.', 1) || '/' || CASE WHEN len(s) = 3 THEN s[1] || '.' || s[2] || '.wav' || CASE WHEN try_cast(s[3] AS INT) IS NOT NULL
       THEN '#t=' || (try_cast(s[3] AS INT) * 3) || ',' || (try_cast(s[3] AS INT) * 3 + 3) ELSE '' END ELSE b || '.wav' END AS url FROM u""")
def audio_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = T.read(spark, sf_dir, "part")
    tail = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("."), (F.col("p_partkey") % 10).cast("string"))).otherwise(".x")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), tail, F.lit(".wav"))
    return part.select(F.col("p_partkey").alias("record_id"), N.audio_url(name).alias("url"))


@_query("""
SELECT page_id, CASE WHEN starts_with(url, 'http://') AND NOT contains(url, '..') THEN '/images/' || substr(url, 8) END AS url FROM pages""")
def image_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.replace("url", F.lit("http://"), F.lit("media/pages/"))
    path = F.when(F.col("page_id") % 2 == 0, F.replace(path, F.lit("/"), F.lit("\\"))).otherwise(path)
    return T.read(spark, sf_dir, "pages").select("page_id", N.image_url(path, "media/pages").alias("url"))


@_query("SELECT p_partkey AS record_id, replace(regexp_replace('n' || p_partkey || '-' || replace(p_name, ' ', '_'), '^[^-]*-', ''), '_', ' ') AS label, regexp_matches(trim(' ' || p_size || CASE WHEN p_size % 2 = 0 THEN 'x' ELSE '' END), '^[0-9]+$') AS valid FROM part")
def label_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("n"), F.col("p_partkey").cast("string"), F.lit("-"), F.replace("p_name", F.lit(" "), F.lit("_")))
    text = F.concat(F.lit(" "), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, "x").otherwise(""))
    return T.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id"), N.clean_label(raw).alias("label"), N.valid_record_text(text).alias("valid"))


@_query("SELECT p_brand, p_name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS r FROM part) WHERE r <= 10")
def top_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.top_per_group(T.read(spark, sf_dir, "part").select("p_brand", "p_name", "p_partkey"), "p_brand", ["p_name", "p_partkey"], 10)


@_query("SELECT row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS record_id, p_partkey FROM part")
def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.dense_ids(T.read(spark, sf_dir, "part").select("p_name", "p_partkey"), ["p_name", "p_partkey"]).select("record_id", "p_partkey")


# Reports


_TIMES = """
WITH t AS (SELECT l_linenumber::INT AS dims, floor(max(l_quantity) * 10)::BIGINT AS kd, floor(max(l_extendedprice) / 10)::BIGINT AS lin,
                  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE floor(avg(l_quantity) * 10)::BIGINT END AS rt FROM lineitem GROUP BY l_linenumber)"""


@_query(_TIMES + """
SELECT dims, kd AS kd_time_us, rt AS rt_time_us, lin AS linear_time_us,
       CASE WHEN kd > 0 THEN round(lin / kd, 2) ELSE 0 END AS kd_speedup, CASE WHEN rt > 0 THEN round(lin / rt, 2) ELSE 0 END AS rt_speedup,
       CASE WHEN nullif(kd, 0) = m THEN 'KD-tree' WHEN nullif(rt, 0) = m THEN 'R-tree' WHEN nullif(lin, 0) = m THEN 'linear' END AS winner,
       CASE WHEN rt IS NULL THEN 'index_not_built' END AS error
FROM (SELECT *, least(nullif(kd, 0), nullif(rt, 0), nullif(lin, 0)) AS m FROM t)""")
def search_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over timings taken from the line items, so that it has a SQL counterpart."""
    t = T.read(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("dims")).agg(
        F.floor(F.max("l_quantity") * 10).alias("kd"), F.floor(F.max("l_extendedprice") / 10).alias("lin"), F.floor(F.avg("l_quantity") * 10).alias("avg"))
    rt = t.select("dims", F.when(F.col("dims") % 3 != 0, F.col("avg")).alias("time_us"), F.when(F.col("dims") % 3 == 0, "index_not_built").alias("error"))
    kd = t.select("dims", F.col("kd").alias("time_us"), F.lit(None).cast("string").alias("error"))
    return report.compare(kd, rt, t.select("dims", F.col("lin").alias("time_us")))


@_query("SELECT p_partkey AS record_id, CASE WHEN kd = m THEN 'KD-tree' WHEN rt = m THEN 'R-tree' WHEN lin = m THEN 'linear' END AS winner FROM (SELECT p_partkey, nullif(p_size % 7, 0) AS kd, nullif(p_partkey % 5, 0) AS rt, nullif((p_size + p_partkey) % 4, 0) AS lin, least(nullif(p_size % 7, 0), nullif(p_partkey % 5, 0), nullif((p_size + p_partkey) % 4, 0)) AS m FROM part)")
def winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    return T.read(spark, sf_dir, "part").select(key.alias("record_id"), N.winner(size % 7, key % 5, (size + key) % 4).alias("winner"))


@_query("SELECT vec_id AS record_id, label FROM embeddings WHERE vec_id IN (3, 141, 59, 2653)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.lookup_many(T.embeddings(spark, sf_dir), [3, 141, 59, 2653]).select("record_id", "label")


@_query("SELECT 'embeddings' AS name, count(*) AS records FROM embeddings UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'pages', count(*) FROM pages")
def record_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.status(spark, {n: T.read(spark, sf_dir, n) for n in ("embeddings", "orders", "pages")})


# Sources, sinks and streams


def _roundtrip_sql(digits: int = 6) -> str:
    return f"SELECT vec_id AS record_id, len(embedding)::INT AS dims, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), {digits}) AS total FROM embeddings"


def _totals(points: DataFrame) -> DataFrame:
    return points.select("record_id", F.size("features").alias("dims"), F.round(F.aggregate("features", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@_query(_roundtrip_sql())
def paged_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "paged")
    vector_files.write_paged(T.embeddings(spark, sf_dir), path)
    return _totals(vector_files.read_paged(spark, path, 64))


@_query(_roundtrip_sql())
def bin_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "bin")
    vector_files.write_bin(T.embeddings(spark, sf_dir), path)
    return _totals(vector_files.read_bin(spark, path))


@_query("SELECT p_partkey, p_name, p_brand FROM part")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    files.write_csv(T.read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), path)
    return files.first_existing(spark, [path + "-none", path], "p_partkey long, p_name string, p_brand string")


@_query("SELECT vec_id AS record_id, round((embedding[1]::DOUBLE - avg(embedding[1]::DOUBLE) OVER ()) / (stddev_pop(embedding[1]::DOUBLE) OVER () + 1e-9), 5) AS p0 FROM embeddings")
def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model written as JSON, read again and applied."""
    points = T.embeddings(spark, sf_dir, 3)
    path = scratch_path(spark, "model")
    mean, std = features.stats_arrays(points, 3)
    files.write_model(spark, features.Projection(mean, std, [[1.0, 0.0, 0.0]]), [1], path)
    found = files.read_model(spark, path)
    scaled = features.standardise(points, found.mean, found.std)
    return scaled.select("record_id", F.round(V.dot(F.col("features"), found.components[0]), 5).alias("p0"))


@_query(_roundtrip_sql())
def streaming_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = T.embeddings(spark, sf_dir)
    folder = scratch_path(spark, "stream-in")
    source.select("record_id", "features").write.parquet(folder)
    out = scratch_path(spark, "stream-out")
    stream = spark.readStream.schema(source.select("record_id", "features").schema).parquet(folder)
    streaming.stream_points(stream, 64, out, os.path.join(scratch_path(spark, "stream-state"))).awaitTermination()
    return _totals(streaming.stored_points(spark, out))


@_query(f"""
WITH v AS (SELECT *, {_VOLUME} AS vol FROM (SELECT label, {", ".join(f"min(embedding[{i}]) AS lo{i}, max(embedding[{i}]) AS hi{i}" for i in (1, 2, 3))} FROM embeddings WHERE vec_id % 2 = 0 GROUP BY label))
SELECT record_id, node FROM (
  SELECT e.vec_id AS record_id, b.label AS node, row_number() OVER (PARTITION BY e.vec_id ORDER BY {_GROWN} - b.vol, b.vol, b.label) AS r
  FROM embeddings e, v b) WHERE r = 1""")
def streaming_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors arrive as a stream and get the node, of the even ones' label boxes, that grows least."""
    source = T.embeddings(spark, sf_dir, 3)
    leaves = boxes.bounding_boxes(source.where("record_id % 2 = 0"), "label", 3).withColumnRenamed("label", "node")
    folder, out = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    source.select("record_id", "features").write.parquet(folder)
    stream = spark.readStream.schema(source.select("record_id", "features").schema).parquet(folder)
    streaming.stream_points(stream, 3, out, scratch_path(spark, "stream-state"), leaves).awaitTermination()
    return streaming.stored_points(spark, out).select("record_id", "node")


@_query(f"SELECT record_id, floor(x)::BIGINT AS x FROM ({ORDERS})")
def append_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends of a table whose keys are already dense give them back as ids."""
    points = T.order_points(spark, sf_dir).withColumnRenamed("record_id", "key")
    path = scratch_path(spark, "append")
    half = points.count() // 2
    for part in (points.where(F.col("key") < half), points.where(F.col("key") >= half)):
        ingest.append(spark, path, part, ["key"])
    return spark.read.parquet(path).select("record_id", F.floor(F.col("features")[0]).alias("x"))


@_query("""
WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS record_id FROM embeddings WHERE vec_id % 2 = 0),
b AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 + (SELECT count(*) FROM a) AS record_id FROM embeddings WHERE vec_id % 2 <> 0)
SELECT 1 AS generation, * FROM a UNION ALL SELECT 2 AS generation, * FROM a UNION ALL SELECT 2 AS generation, * FROM b""")
def snapshot_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in two commits, the second one tried twice, read as of both generations."""
    path, rows = scratch_path(spark, "snapshots"), T.read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("features"))
    snapshots.append(spark, path, rows.where("vec_id % 2 = 0"), ["vec_id"], "even")
    for _ in range(2):
        snapshots.append(spark, path, rows.where("vec_id % 2 <> 0"), ["vec_id"], "odd")
    read = [snapshots.read(spark, path, g).select(F.lit(g).alias("generation"), "vec_id", "record_id") for g in (1, 2)]
    return read[0].unionByName(read[1])
