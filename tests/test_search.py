"""Searches: hand-made cases, and pruned searches against full scans."""

import os

import numpy as np
import pytest

from orthoscan.operators import box_join, boxes, cells, ingest, knn, knn_join, ranks
from orthoscan.plans import pruned, report

GOLDEN = [(0, [0.0, 0.0]), (1, [3.0, 4.0]), (2, [0.0, 5.0]), (3, [5.0, 0.0]), (4, [6.0, 8.0]), (5, [0.0, 0.0])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "record_id long, features array<float>")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pairs(df):
    return [(r.record_id, round(r.distance, 6)) for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize(("k", "want"), [(3, [0, 5, 1]), (5, [0, 5, 1, 2, 3]), (99, [0, 5, 1, 2, 3, 4]), (0, []), (-1, [])])
def test_golden(spark, k, want):
    points = frame(spark, GOLDEN)
    assert [i for i, _ in pairs(knn.knn(points, [0.0, 0.0], k))] == want
    queries = spark.createDataFrame([(7, [0.0, 0.0])], "qid long, features array<float>")
    assert [i for i, _ in pairs(knn_join.knn_join(points, queries, k))] == want


def test_wrong_length_and_empty(spark):
    with pytest.raises(ValueError):
        knn.knn(frame(spark, GOLDEN), [0.0, 0.0, 0.0], 3)
    assert knn.knn(frame(spark, []), [0.0], 3).count() == 0
    assert knn_join.knn_join(frame(spark, GOLDEN), spark.createDataFrame([], "qid long, features array<float>"), 3).count() == 0


def test_boxes(spark):
    points = frame(spark, GOLDEN)
    found = lambda lo, hi: sorted(r.record_id for r in boxes.range_search_points(points, lo, hi).collect())
    assert (found([0, 0], [3, 5]), found([3, 4], [3, 4]), found([3, 4], [0, 0])) == ([0, 1, 2, 5], [1], [])


@pytest.mark.parametrize("seed", range(4))
def test_pruned_is_linear(spark, seed):
    rng = np.random.Generator(np.random.PCG64(seed))
    dims = int(rng.integers(1, 6))
    values = np.round(rng.normal(size=(400, dims)) * 3) if seed % 2 else rng.normal(size=(400, dims))
    points = frame(spark, [(i, row.tolist()) for i, row in enumerate(values)]).repartition(3)
    celled = cells.kd_cells(points, 4, dims) if seed < 2 else cells.str_leaves(points, 30, dims)
    index = pruned.write_index(celled, dims)
    zones = {r.cell: r for r in index.zones().collect()}
    for r in index.points().collect():
        z = zones[r.cell]
        assert all(a <= x <= b for a, x, b in zip(z.lo, r.features, z.hi, strict=True))
    assert sum(z.n for z in zones.values()) == 400
    for k in (1, 7, 500):
        query = (rng.normal(size=dims) * 4).tolist()
        got, stats = pruned.pruned_knn(index, query, k)
        assert pairs(got) == pairs(knn.knn(points, query, k))
        assert stats["cells_scanned"] <= stats["cells_total"]
    lo, hi = [-1.0] * dims, [2.0] * dims
    ids = lambda df: sorted(r.record_id for r in df.collect())
    assert ids(pruned.pruned_range(index, lo, hi)) == ids(boxes.range_search_points(points, lo, hi))


def test_appended_points_are_found(spark):
    index = pruned.write_index(cells.kd_cells(frame(spark, GOLDEN), 1, 2), 2)
    index = pruned.append(index, frame(spark, [(9, [0.1, 0.0])]))
    assert [i for i, _ in pairs(pruned.pruned_knn(index, [0.1, 0.0], 1)[0])] == [9]


def test_many_leaves_lie_in_few_folders(spark):
    rng = np.random.Generator(np.random.PCG64(5))
    points = frame(spark, [(i, x.tolist()) for i, x in enumerate(np.round(rng.normal(size=(2000, 5)), 1))]).repartition(3)
    index = pruned.write_index(cells.str_leaves(points, 2, 5), 5)
    assert index.zones().count() == index.points().select("cell").distinct().count() > 900
    assert len([f for f in os.listdir(f"{index.path}/points") if "=" in f]) <= 256
    assert index.zones().join(index.points().select("part", "cell"), ["part", "cell"]).count() == 2000
    for k in (3, 20):
        got, stats = pruned.pruned_knn(index, [0.1] * 5, k)
        assert stats["cells_scanned"] < stats["cells_total"] and "dynamicpruning" in plan(got)
        assert pairs(got) == pairs(knn.knn(points, [0.1] * 5, k))


def test_methods_agree_over_many_leaves(spark):
    rng = np.random.Generator(np.random.PCG64(6))
    points = frame(spark, [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(1500, 6)))]).repartition(3)
    prefix = lambda d: points.selectExpr("record_id", f"slice(features, 1, {d}) AS features")
    rtree = {d: pruned.write_index(cells.str_leaves(prefix(d), 2, d), d) for d in (2, 5)}
    assert all(i.zones().count() > 700 and len([f for f in os.listdir(f"{i.path}/points") if "=" in f]) <= 256 for i in rtree.values())
    got = pruned.by_methods(points, {"kd": {5: pruned.write_index(cells.kd_cells(prefix(5), 4, 5), 5)}, "rtree": rtree}, [0.2] * 6, 4, (2, 5)).collect()
    rows = lambda m, d: sorted((r["rank"], r.record_id, r.distance) for r in got if (r.method, r.dims) == (m, d))
    for d in (2, 5):
        assert len(rows("linear", d)) == 4 and rows("kd", d) == rows("rtree", d) == rows("linear", d)


def test_cells_are_not_written_out_where_they_are_joined(spark):
    """Cuts of five levels are found by joins over cells; their search, written out, would multiply with each level."""
    points = frame(spark, [(i, [float(i % 7), float(i % 5)]) for i in range(50)])
    levels = [cells.Cuts(0, 6, np.arange(1.0, 6.0)), cells.Cuts(1, 5, np.tile(np.arange(4.0), 6))]
    celled = cells.assign(points, levels)
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(celled.where("cell = 7")) < 2 * size(celled)
    want = {i: 5 * sum(i % 7 > x for x in range(1, 6)) + sum(i % 5 > x for x in range(4)) for i in range(50)}
    assert {r.record_id: r.cell for r in celled.join(spark.range(30).selectExpr("id AS cell"), "cell").collect()} == want


def test_media_search_with_and_without_an_index(spark, tmp_path):
    from orthoscan.operators import enrich

    points = spark.range(60).selectExpr("id AS record_id", "array(cast(id % 7 AS float), cast(id % 11 AS float), cast(id AS float)) AS features")
    assert pruned.open_index(spark, str(tmp_path / "none")) is None
    prefix = points.selectExpr("record_id", "slice(features, 1, 2) AS features")
    path = pruned.write_index(cells.kd_cells(prefix, 2, 2), 2, str(tmp_path / "index")).path
    index = pruned.open_index(spark, path)
    assert index.dims == 2
    meta = spark.range(60).selectExpr("id AS pos", "concat('blues.', id, '.wav') AS filename")
    got = pruned.media_search(points, {"kd": {2: index}}, [3.0, 4.0, 5.0], 4, (2, 3, 9), lambda df: enrich.audio(df, meta, 60))
    rows = {(r["method"], r["dims"]): r for r in got.collect()}
    assert set(rows) == {(m, d) for m in ("linear", "kd") for d in (2, 3, 9)}
    for d in (2, 3):
        assert rows["kd", d].neighbors == rows["linear", d].neighbors and len(rows["kd", d].neighbors) == 4 and rows["kd", d].error is None
        assert all(n.genre == "blues" and n.filename == f"blues.{n.record_id}.wav" for n in rows["kd", d].neighbors)
    assert rows["kd", 9].error and not rows["kd", 9].neighbors


def test_exact_cells_halve_and_leaves_hold(spark):
    points = frame(spark, [(i, [float(i % 3), 1.0]) for i in range(101)])
    sizes = sorted(r["count"] for r in cells.kd_cells_exact(points, 3, 2).groupBy("cell").count().collect())
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 1
    assert max(r["count"] for r in cells.str_leaves(points, 10, 2).groupBy("cell").count().collect()) <= 11
    zones = cells.zone_map(cells.str_leaves(points, 10, 2), 2)
    tops = cells.levels(zones, 4, 2).collect()
    assert [r.n for r in tops if r.level == max(t.level for t in tops)] == [101]


@pytest.mark.parametrize("kind", ["random", "ties"])
def test_exact_cells_and_leaves_by_refined_histograms(spark, monkeypatch, kind):
    """Few bins and rows at a time, and cuts in tables instead of on the driver, change nothing."""
    rng = np.random.Generator(np.random.PCG64(2))
    v = {"random": rng.normal(size=(300, 2)) * [1, 1e6], "ties": rng.integers(0, 4, (300, 2)) // [1, 4]}[kind].astype(np.float32)
    ids = rng.permutation(10_000)[:300] * (1 << 40)
    points = frame(spark, [(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)]).repartition(3)

    def plain(levels, up):
        cell = np.zeros(300, dtype=int)
        for axis, slabs in levels:
            out = cell * slabs
            for c in np.unique(cell):
                own = np.flatnonzero(cell == c)
                order = own[np.lexsort((ids[own], v[own, axis]))]
                cut = [j * len(own) // slabs if not up else -(-j * len(own) // slabs) for j in range(1, slabs)]
                out[order] += np.searchsorted(cut, np.arange(len(own)), side="right")
            cell = out
        return {int(i): int(c) for i, c in zip(ids, cell, strict=True)}

    found = lambda df: {r.record_id: r.cell for r in df.collect()}
    for bins, rows, depth in ((1 << 14, 1 << 16, 3), (8, 20, 2)):
        monkeypatch.setattr(cells, "BINS", bins)
        monkeypatch.setattr(cells, "FEW_ROWS", rows)
        assert found(cells.kd_cells_exact(points, depth, 2)) == plain([(0, 2), (1, 2), (0, 2)][:depth], False)
    slabs = [(0, 6), (1, 5)]  # 30 leaves of 10
    assert found(cells.str_leaves(points, 10, 2)) == plain(slabs, True)
    monkeypatch.setattr(cells, "DRIVER_CUTS", 0)
    monkeypatch.setattr(cells, "BINS", 64)
    for few in (64, 1):
        monkeypatch.setattr(cells, "FEW_CUTS", few)
        assert found(cells.str_leaves(points, 10, 2)) == plain(slabs, True)
    assert cells.kd_cells_exact(points.limit(0), 3, 2).count() == 0 and cells.str_leaves(points.limit(0), 5, 2).count() == 0


def test_no_point_moves_while_cells_are_found(spark):
    points = frame(spark, [(i, [float(i * 7 % 31), float(i % 5)]) for i in range(200)])
    celled = cells.kd_cells_exact(points, 8, 2)
    assert "Exchange" not in plan(celled) and "Join" not in plan(celled)
    assert {r["count"] for r in celled.groupBy("cell").count().collect()} == {1}  # 512 cells, 200 of them with a point


def plain_join(points, queries, k, exclude_self=False):
    out = set()
    for qid, q in queries:
        d = sorted((float(np.sqrt(((np.float32(x).astype(float) - np.float32(q).astype(float)) ** 2).sum())), i) for i, x in points if not (exclude_self and i == qid))
        out |= {(qid, n + 1, i, round(far, 9)) for n, (far, i) in enumerate(d[:k])}
    return out


@pytest.mark.parametrize(("dims", "kind", "exclude_self"), [(2, "hot", True), (5, "clusters", False), (40, "random", False)])
def test_knn_join_is_brute_force(spark, monkeypatch, dims, kind, exclude_self):
    rng = np.random.Generator(np.random.PCG64(dims))
    v = rng.normal(size=(500, dims)).astype(np.float32)
    if kind == "hot":
        v[:200] = v[0]  # one cell that holds many equal points, and most queries
    if kind == "clusters":
        v += rng.integers(0, 3, (500, 1)) * 100
    points = [(i, x.tolist()) for i, x in enumerate(v)]
    queries = [(i, x) for i, x in points[::9]] + [(1000 + i, (x * 3).tolist()) for i, x in enumerate(v[:20])]
    df, asked = frame(spark, points).repartition(4), spark.createDataFrame(queries, "qid long, features array<float>").repartition(3)
    for unit, crowd in ((1 << 15, 7), (40, 5)):
        monkeypatch.setattr(knn_join, "UNIT_POINTS", unit)
        monkeypatch.setattr(knn_join, "UNIT_QUERIES", crowd)
        got = {(r.qid, r["rank"], r.record_id, round(r.distance, 9)) for r in knn_join.knn_join(df, asked, 6, exclude_self).collect()}
        assert got == plain_join(points, queries, 6, exclude_self)
    assert knn_join.knn_join(df, asked, 700).count() == 500 * len(queries)
    assert knn_join.knn_join(df, asked.limit(0), 3).count() == knn_join.knn_join(df, asked, 0).count() == 0


def test_knn_join_leaves_far_units_out(spark, monkeypatch):
    """Most queries search a few units: the visits after the first are far fewer than queries times units."""
    monkeypatch.setattr(knn_join, "UNIT_POINTS", 100)
    rng = np.random.Generator(np.random.PCG64(1))
    points = frame(spark, [(i, x.tolist()) for i, x in enumerate(rng.random((4000, 2)))])
    kept, seen = knn_join.stored, {}
    monkeypatch.setattr(knn_join, "stored", lambda df, name: seen.setdefault(name, kept(df, name)))
    asked = points.where("record_id % 20 = 0").selectExpr("record_id AS qid", "features")
    assert knn_join.knn_join(points, asked, 3).count() == 600
    units = seen["knn-blocks"].count()
    assert units >= 32 and seen["knn-visits"].count() < 200 * units / 10


def test_prefixes_in_one_scan(spark):
    rng = np.random.Generator(np.random.PCG64(7))
    v = np.round(rng.normal(size=(300, 8)), 1).astype(np.float32)
    points = frame(spark, [(i, x.tolist()) for i, x in enumerate(v)] + [(900, [0.0, 0.0, 0.0])]).repartition(4)
    query = [0.1] * 8
    got = knn.knn_prefixes(points, query, 7, (2, 5, 8, 2))
    for d in (2, 5, 8):
        prefix = points.where(f"size(features) >= {d}").selectExpr("record_id", f"slice(features, 1, {d}) AS features")
        want = [(r.record_id, r.distance) for r in knn.knn(prefix, query[:d], 7).orderBy("rank").collect()]
        assert [(r.record_id, r.distance) for r in got.where(f"dims = {d}").orderBy("rank").collect()] == want
    assert knn.knn_prefixes(points, query, 0, (2,)).count() == 0 and knn.knn_prefixes(points.limit(0), query, 3, (2,)).count() == 0
    with pytest.raises(ValueError):
        knn.knn_prefixes(points, query, 3, (9,))


def test_ranks(spark):
    df = spark.createDataFrame([(i * 7 % 50, i % 3) for i in range(50)], "v long, g long").repartition(5)
    assert sorted((r.v, r["rank"]) for r in ranks.global_rank(df, ["v"]).collect()) == [(i, i) for i in range(50)]
    got = ranks.rank_within(df, "g", ["v"]).collect()
    for g in range(3):
        own = sorted((r.v, r["rank"]) for r in got if r.g == g)
        assert [n for _, n in own] == list(range(len(own)))


@pytest.mark.parametrize(("dims", "crowd", "tile"), [(2, 4096, 64), (3, 10, 2), (5, 20, 4)])
def test_overlap_join_is_brute_force(spark, monkeypatch, dims, crowd, tile):
    """Boxes of many sizes, points, infinite edges and everything; crowded tiles are split."""
    monkeypatch.setattr(box_join, "CROWD", crowd)
    monkeypatch.setattr(box_join, "TILE_BOXES", tile)
    rng = np.random.Generator(np.random.PCG64(dims))
    lo = (rng.random((120, dims)) * 20 - 10).astype(np.float32)
    hi = lo + (10.0 ** rng.integers(-3, 2, (120, 1)) * rng.random((120, dims))).astype(np.float32)
    hi[:10] = lo[:10]
    lo[10:14], hi[12:16] = -np.inf, np.inf
    lo[16, 0], hi[17, dims - 1] = -np.inf, np.inf
    lo[20:50], hi[20:50] = 1.0, 1.5  # a crowd
    lo[18], hi[18] = 3.0, 2.0  # inverted
    hi[19, dims - 1] = np.nan
    hi[60] = lo[61]  # touches
    rows = [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(lo, hi, strict=True))]
    schema = "id long, lo array<float>, hi array<float>"
    left, right = spark.createDataFrame([*rows[:80], (500, None, [1.0] * dims)], schema), spark.createDataFrame(rows[40:] + rows[:20], schema)
    ok = (lo <= hi).all(axis=1)
    hit = lambda i, j: ok[i] and ok[j] and (lo[i] <= hi[j]).all() and (hi[i] >= lo[j]).all()
    want = sorted((i, j) for i in range(80) for j in [*range(40, 120), *range(20)] if hit(i, j))
    assert len(want) > 300
    assert sorted((r.left_id, r.right_id) for r in box_join.overlap_join(left, right).collect()) == want
    assert box_join.overlap_join(left, right.limit(0)).count() == 0
    one = spark.createDataFrame([(1, [-np.inf] * dims, [np.inf] * dims)], schema)
    assert box_join.overlap_join(one, one).count() == 1


@pytest.mark.parametrize(("dims", "crowd", "tile", "pairs"), [(2, 4096, 64, 1 << 27), (2, 10, 2, 300), (3, 20, 4, 1 << 27), (70, 15, 4, 500)])
def test_overlap_pairs_is_brute_force(spark, monkeypatch, dims, crowd, tile, pairs):
    """Each pair of one table comes once, in order, however its tiles are split and shared out."""
    for name, value in (("CROWD", crowd), ("TILE_BOXES", tile), ("TASK_PAIRS", pairs)):
        monkeypatch.setattr(box_join, name, value)
    rng = np.random.Generator(np.random.PCG64(dims))
    lo = (rng.random((110, dims)) * 20 - 10).astype(np.float32)
    hi = lo + (10.0 ** rng.integers(-2, 2, (110, 1)) * rng.random((110, dims))).astype(np.float32)
    lo[10:14], hi[12:16] = -np.inf, np.inf
    lo[20:60], hi[20:60] = 1.0, 1.5  # a crowd
    lo[18], hi[18] = 3.0, 2.0  # inverted
    hi[70] = lo[71]  # touches
    names = [f"b{i % 100}" for i in range(110)]  # ten names twice
    rows = [(n, a.tolist(), b.tolist()) for n, a, b in zip(names, lo, hi, strict=True)]
    ok = (lo <= hi).all(axis=1)
    want = sorted((names[i], names[j]) for i in range(110) for j in range(110) if names[i] < names[j] and ok[i] and ok[j] and (lo[i] <= hi[j]).all() and (hi[i] >= lo[j]).all())
    boxes_ = spark.createDataFrame([*rows, ("none", None, [1.0] * dims), (None, [1.0] * dims, [1.5] * dims)], "id string, lo array<float>, hi array<float>")
    assert sorted((r.left_id, r.right_id) for r in box_join.overlap_pairs(boxes_).collect()) == want
    assert box_join.overlap_pairs(boxes_.limit(0)).count() == 0


def test_wide_boxes_are_posted_once_and_compared_in_generated_code(spark):
    wide = spark.range(200).selectExpr("id", "array(cast(id % 7 AS float), cast(id % 5 AS float)) AS lo", "array(cast(50 + id % 3 AS float), cast(40 AS float)) AS hi")
    wide = box_join._proper(wide)
    grid = box_join._Grid(wide)
    levels = sorted(r[0] for r in wide.select(grid.level().alias("l")).distinct().collect())
    assert box_join._posted(wide, grid, levels, "left").count() == 200
    found = box_join.overlap_join(wide, wide)
    assert "lambda" not in plan(found).split("Join", 1)[1].split("\n")[0]
    assert found.count() == 200 * 200


def test_report_keeps_other_dims(spark):
    index = pruned.write_index(cells.kd_cells(frame(spark, GOLDEN), 1, 2), 2)
    rows = {r.dims: r for r in report.search_report({2: (index, None), 5: (index, index)}, [0.0, 0.0], 3).collect()}
    assert rows[2].kd_time_us > 0 and rows[2].error == "index_not_built"
    assert rows[5].kd_time_us > 0  # a shorter query fits the two dimensions


def test_append_and_lookup(spark, tmp_path):
    path = str(tmp_path / "table")
    for k in range(2):
        ingest.append(spark, path, spark.createDataFrame([(10 * k + i, [float(i)]) for i in range(3)], "key long, features array<float>"), ["key"])
    assert sorted(r.record_id for r in spark.read.parquet(path).collect()) == list(range(6))
    assert ingest.lookup(spark.read.parquet(path), 99).count() == 0


def test_plans(spark, sf):
    from orthoscan import tables

    assert "TakeOrderedAndProject" in plan(knn.knn(tables.order_points(spark, sf), [1.0, 2.0], 5))
    ranged = boxes.range_search(tables.read(spark, sf, "orders"), ["o_totalprice"], [1.0], [2.0]).select("o_orderkey")
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThanOrEqual" in plan(ranged) and "o_orderpriority" not in plan(ranged)
    index = pruned.write_index(cells.kd_cells(tables.order_points(spark, sf), 5, 2), 2)
    found, stats = pruned.pruned_knn(index, [250_000.0, 9_500.0], 5)
    assert stats["cells_scanned"] < stats["cells_total"] and "dynamicpruning" in plan(found)
    by_dims = plan(pruned.by_dims(tables.embeddings(spark, sf), [0.1] * 64, 5, (2, 5, 10, 20, 30)))
    assert by_dims.count("FileScan") == 1 and "WindowGroupLimit" in by_dims
    assert "WindowGroupLimit" in plan(ranks.top_per_group(tables.read(spark, sf, "part"), "p_brand", ["p_partkey"], 3))
