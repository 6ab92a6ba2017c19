"""The pipeline's stages one by one, each on what the one before kept."""

from unittest import mock

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F

from orthoscan.llm import common, decontaminate, packing
from orthoscan.llm.common import id_remainder, stored
from tests.llm.test_similar import kept as kept_by_pairs


def test_stages(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    columns = df.columns
    before, tables = df, []
    for name, stage in corpus_pipeline.STAGES:
        df = stored(stage(spark, df, sf), f"test-{name}")
        tables.append((name, before, df))
        before = df
    by = {name: (a, b) for name, a, b in tables}
    assert list(by) == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    assert all(b.columns == columns for name, _, b in tables[:-1])

    a, b = by["quality"]
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(id_remainder(F.col("doc_id"), 4) != 2)
    kept = {r.doc_id for r in b.collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert len(good & kept) >= 0.97 * len(good) and len(bad & kept) <= 0.05 * len(bad)

    a, b = by["line_dedup"]
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    rows, held = {r.doc_id: r.text for r in a.collect()}, {}
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    for i, text in rows.items():
        for line in text.split("\n"):
            held.setdefault(key(line), set()).add(i)
    want = {i: "\n".join(x for x in t.split("\n") if not (len(key(x)) >= 40 and len(held[key(x)]) >= 5 and max(held[key(x)]) != i)) for i, t in rows.items()}
    assert {r.doc_id: r.text for r in b.collect()} == want
    assert all(r.n_chars == len(r.text) for r in b.collect())

    a, b = by["near_dedup"]
    assert {r.doc_id for r in b.collect()} == kept_by_pairs([(r.doc_id, r.text) for r in a.collect()])

    a, b = by["decontamination"]
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in a.collect() if any(t in r.text for t in bench)}
    kept = {r.doc_id for r in b.collect()}
    assert not leaks & kept and len(kept) >= a.count() - len(leaks) - 1

    a, b = by["packing"]
    assert {r.doc_id for r in b.collect()} == {r.doc_id for r in a.collect()}
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).drop("sequence_id", "offset").collect()) == sorted(tuple(r) for r in b.drop("sequence_id", "offset").collect())
    assert corpus_pipeline.ORACLE_SQL is None


def test_idle_workers_hold_no_memory_of_a_stage():
    """What a stage keeps goes with its task, and its pages go back to the system."""
    before = pa.default_memory_pool().bytes_allocated()
    batch = pa.record_batch({"doc_id": pa.array(range(3), pa.int64()), "text": ["a b", None, "c" * 99]})

    def work(batches):
        kept = [pa.array(range(100_000))]
        yield from (b.slice(0, len(kept)) for b in batches)

    calls = []
    released = lambda: calls.append(1)
    with mock.patch.object(common, "pa", mock.Mock(default_memory_pool=lambda: mock.Mock(release_unused=released), system_memory_pool=lambda: mock.Mock(release_unused=released))):
        assert [len(b) for b in common.freed(work)(iter([batch]))] == [1] and len(calls) == 2
    assert pa.default_memory_pool().bytes_allocated() - before < 100_000
    assert not hasattr(packing, "_encoders")  # 150,000 stems stayed in every worker that had packed


def test_workers_give_memory_back_between_batches():
    """A packing task kept what earlier batches had used until its end, and took 2 MB of text at a time."""
    batch = pa.record_batch({"doc_id": pa.array(range(3), pa.int64()), "text": ["a b", None, "c" * 99]})
    with mock.patch.object(common, "_give_back") as back:
        assert [b.num_rows for b in common.giving_back(iter([batch] * 3))] == [3] * 3 and back.call_count == 3
    assert packing._SLICE <= 1 << 19


def test_decontamination_sends_few_rows_at_a_time(spark, sf):
    """Its documents went to Python 10,000 at a time."""
    seen = []
    windows = decontaminate.template_windows

    def watched(*args, **kwargs):
        seen.append(int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
        return windows(*args, **kwargs)

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").limit(20) for t in ("documents", "benchmark"))
    with mock.patch.object(decontaminate, "template_windows", watched):
        decontaminate.contaminated(docs, items)
    assert len(seen) == 3 and max(seen) <= 1000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
