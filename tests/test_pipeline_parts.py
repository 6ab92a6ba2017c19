"""Features, metadata, files and streams."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthoscan.operators import enrich, features, ingest
from orthoscan.sources import files, generate, vector_files
from orthoscan.streaming import ingest as streaming


def frame(spark, values):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(values)], "record_id long, features array<float>")


def vectors(df):
    return np.array([r.features for r in df.orderBy("record_id").collect()])


def test_select_features_fills_in(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "b double, a double")
    row = features.select_features(df, ["a", "missing", "b"]).first()
    assert row.features[:2] == [2.0, 1.0] and len(row.features) == 3


def test_augment(spark):
    points = frame(spark, [[i, 2 * i] for i in range(7)])
    out = features.augment(points, 17, 2)
    assert sorted(r.record_id for r in out.collect()) == list(range(17))
    got = vectors(out)
    assert np.array_equal(got[:7], vectors(points)) and np.abs(got[7:14] - got[:7]).max() < 1
    assert features.augment(points, 3, 2).count() == 3


def test_projection_is_pca(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    model = features.fit_projection(frame(spark, x), 4, 2)
    z = (np.float32(x).astype(float) - np.float32(x).astype(float).mean(0)) / (np.float32(x).astype(float).std(0) + 1e-9)
    _, _, v = np.linalg.svd(z, full_matrices=False)
    v = v[:2] * np.sign(v[np.arange(2), np.abs(v[:2]).argmax(1)])[:, None]
    assert np.allclose(model.components, v, atol=1e-6)
    assert np.allclose(vectors(model.apply(frame(spark, x))), z @ v.T, atol=1e-4)


def test_enrichment(spark):
    results = spark.createDataFrame([(12,), (3,), (40,)], "record_id long")
    meta = spark.createDataFrame([(i, f"jazz.{i}.wav") for i in range(10)], "pos long, filename string")
    assert {r.record_id: r.filename for r in enrich.by_position(results, meta, 10).collect()} == {12: "jazz.2.wav", 3: "jazz.3.wav", 40: "jazz.0.wav"}
    assert all(r.filename is None for r in enrich.by_position(results, meta.where("false"), 0).collect())
    images = spark.createDataFrame([(0, 3, "old", "a"), (1, 3, "new", None), (2, 9, "c", "c")], "pos long, record_id long, filepath string, label string")
    got = {r.record_id: (r.filepath, r.label) for r in enrich.by_id_or_position(results, images, 3).collect()}
    assert got == {3: ("new", None), 12: ("old", "a"), 40: ("new", None)}


@pytest.mark.parametrize("dims", [1, 2, 30])
def test_vector_files(spark, tmp_path, dims):
    x = np.random.Generator(np.random.PCG64(dims)).normal(size=(1500, dims)).astype(np.float32)
    points = frame(spark, x)
    for write, read, name in ((vector_files.write_paged, lambda p: vector_files.read_paged(spark, p, dims), "p"), (vector_files.write_bin, lambda p: vector_files.read_bin(spark, p), "b")):
        write(points, str(tmp_path / name))
        back = read(str(tmp_path / name))
        assert np.array_equal(vectors(back).astype(np.float32), x)
    # single files with known layouts
    single = tmp_path / "one.dat"
    per = (4096 - 4) // (4 * dims)
    pages = [struct.pack("<i", len(x[k : k + per])) + x[k : k + per].tobytes() for k in range(0, len(x), per)]
    single.write_bytes(struct.pack("<ii", len(x), 1 + len(pages)).ljust(4096, b"\0") + b"".join(p.ljust(4096, b"\0") for p in pages))
    assert np.array_equal(vectors(vector_files.read_paged(spark, str(single), dims)).astype(np.float32), x)
    assert single.read_bytes() == vector_files.paged_bytes(x)


@pytest.mark.parametrize("layout", ["paged_vectors", "bin_vectors"])
def test_failed_writes_leave_nothing(spark, tmp_path, layout):
    read = {"paged_vectors": lambda p: vector_files.read_paged(spark, p, 3), "bin_vectors": lambda p: vector_files.read_bin(spark, p)}[layout]
    path = str(tmp_path / layout)
    vector_files.register(spark)
    rows = spark.range(4000).selectExpr("id AS record_id", "array(float(id), float(id % 7), 1f) AS features").repartitionByRange(4, "record_id").sortWithinPartitions("record_id")
    bad = rows.selectExpr("record_id", "CASE WHEN record_id = 3990 THEN array(float(raise_error('no'))) ELSE features END AS features")
    for broken in (bad, rows.where("record_id <> 3990")):  # a task that fails, and one whose ids have a gap
        with pytest.raises(Exception, match="no|aren't"):
            broken.write.format(layout).mode("append").save(path)
        assert not list((tmp_path / layout).glob("*.vec")) and read(path).count() == 0
    rows.write.format(layout).mode("append").save(path)
    assert len(list((tmp_path / layout).glob("*.vec"))) == 4
    with pytest.raises(Exception, match="there already"):
        rows.write.format(layout).mode("append").save(path)
    assert np.array_equal(vectors(read(path))[:, 0], np.arange(4000)) and len(list((tmp_path / layout).glob("*.vec"))) == 4


def test_tables_and_models(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    files.write_csv(spark.createDataFrame([("a", "b")], files.AUDIO_SCHEMA), path)
    assert files.first_existing(spark, [str(tmp_path / "no"), path], files.AUDIO_SCHEMA).collect() == [("a", "b")]
    assert files.first_existing(spark, [str(tmp_path / "no")], files.AUDIO_SCHEMA).count() == 0
    model = features.Projection([1.0], [2.0], [[3.0]])
    files.write_model(spark, model, [1], str(tmp_path / "m"))
    assert files.read_model(spark, str(tmp_path / "m")) == model
    assert files.parse_model(json.dumps({"mean": [1.0], "std": [2.0], "components": [[3.0]]})) == model


def test_media(spark, tmp_path):
    for c in ("n1-cat", "n2-dog"):
        (tmp_path / c).mkdir()
        for i in range(3):
            (tmp_path / c / f"{i}.jpg").write_bytes(bytes([i, i + 1]))
    (tmp_path / "n1-cat" / "notes.txt").write_text("x")
    found = files.media_files(spark, str(tmp_path), per_class=2)
    assert sorted((r["class"], r.path[-5:]) for r in found.collect()) == [("n1-cat", "0.jpg"), ("n1-cat", "1.jpg"), ("n2-dog", "0.jpg"), ("n2-dog", "1.jpg")]
    out = files.extract_features(found, lambda contents: [list(c) if c[0] else None for c in contents], 2)
    assert sorted(r.features for r in out.collect()) == [[0.0, 0.0], [0.0, 0.0], [1.0, 2.0], [1.0, 2.0]]


def test_generators(spark):
    a = vectors(generate.uniform_points(spark, 500))
    assert np.array_equal(a, vectors(generate.uniform_points(spark, 500).repartition(7))) and a.min() >= 0 and a.max() < 1000 and 400 < a.mean() < 600
    b = generate.sample_audio(spark)
    assert b.count() == 1000 and b.where("class = record_id % 10").count() == 1000
    spread = b.groupBy("class").agg(F.stddev_pop(F.col("features")[0]).alias("s")).collect()
    assert all(0.3 < r.s < 0.7 for r in spread)
    assert len(vectors(generate.sample_images(spark))[0]) == 30


def test_stream(spark, tmp_path):
    points = frame(spark, [[0, 0], [1, 1], [9, 9], [float("nan"), 1]])
    points.write.parquet(str(tmp_path / "in"))
    leaves = spark.createDataFrame([(0, [0.0, 0.0], [2.0, 2.0]), (1, [8.0, 8.0], [10.0, 10.0])], "node int, lo array<float>, hi array<float>")
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    streaming.stream_points(stream, 2, str(tmp_path / "out"), str(tmp_path / "state"), leaves).awaitTermination()
    assert sorted((r.record_id, r.node) for r in streaming.stored_points(spark, str(tmp_path / "out")).collect()) == [(0, 0), (1, 0), (2, 1)]


def test_stream_keeps_repeated_ids_and_rejects(spark, tmp_path):
    rows = [(7, [0.0, 0.0]), (7, [9.0, 9.0]), (8, [1.0]), (8, None), (9, [float("inf"), 1.0])]
    points = spark.createDataFrame(rows, "record_id long, features array<float>")
    points.write.parquet(str(tmp_path / "in"))
    leaves = spark.createDataFrame([(0, [0.0, 0.0], [2.0, 2.0]), (1, [8.0, 8.0], [10.0, 10.0])], "node int, lo array<float>, hi array<float>")
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    streaming.stream_points(stream, 2, str(tmp_path / "out"), str(tmp_path / "state"), leaves).awaitTermination()
    assert sorted((r.record_id, r.node) for r in streaming.stored_points(spark, str(tmp_path / "out")).collect()) == [(7, 0), (7, 1)]
    assert sorted(r.record_id for r in spark.read.parquet(streaming.rejected_path(str(tmp_path / "out"))).collect()) == [8, 8, 9]


def test_names_of_generated_media(spark):
    audio = generate.audio_names(generate.sample_audio(spark, 12), [f"g{i}" for i in range(10)])
    assert [(r.filename, r.genre) for r in audio.orderBy("pos").collect()][9:11] == [("g9.00009.wav", "g9"), ("g0.00010.wav", "g0")]
    images = generate.image_paths(generate.sample_images(spark, 16), ["cat", "dog"])
    assert images.orderBy("pos").collect()[3].filepath == "dog/dog_3.jpg" and images.count() == 16


def test_valid_results(spark):
    from orthoscan.plans import report

    rows = [(1, [1, 2], None), (2, [], None), (3, [1], "failed"), (4, None, None)]
    found = report.valid_results(spark.createDataFrame(rows, "id int, neighbors array<int>, error string"))
    assert [r.id for r in found.collect()] == [1]


def test_reject_invalid(spark):
    ok, bad = ingest.reject_invalid(frame(spark, [[1, 2], [1], [float("inf"), 0]]), 2)
    assert (ok.count(), bad.count()) == (1, 2)
