"""Near dedup of the pipeline against brute-force Jaccard pairs."""

from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest

from orthoscan.llm import similar
from tests.llm.test_text_operators import BLANKS, docs, texts, words


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept(rows):
    """Ids that stay, by comparing all pairs."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)):
            x, y = find(i), find(j)
            root[y] = x
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return {min((i for i in g if i is not None), default=None) for g in groups.values()}


@pytest.mark.parametrize(("small", "partners"), [(32, 2), (2, 2), (1, 0)])
def test_near_dedup_links_every_similar_pair(spark, monkeypatch, small, partners):
    monkeypatch.setattr(similar, "SMALL_ENTRY", small)
    monkeypatch.setattr(similar, "PARTNERS", partners)
    rng = np.random.Generator(np.random.PCG64(3))
    rows = [(i, t) for i, t in BLANKS]
    long = texts(200, 8)
    for k in range(40):
        text = " ".join(long[5 * k : 5 * k + 5])
        rows.append((100 * k + 10, text))
        for n in range(1, 5):
            w = text.split(" ")
            for at in rng.integers(0, len(w), 2 * n - 1):
                w[at] = f"new{k}x{n}"
            rows.append((100 * k + 10 + n, " ".join(w) + " tail" * (n % 2)))
    df = docs(spark, rows)
    out = similar.near_dedup(df)
    want = kept(rows)
    assert out.columns == df.columns and 60 < len(want) < 190
    assert sorted(map(repr, (r.doc_id for r in out.collect()))) == sorted(repr(i) for i, _ in rows if i in want)
    assert similar.near_dedup(docs(spark, [])).count() == 0


def test_stage_keeps_one_of_similar_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = corpus_pipeline.near_duplicate_stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert {r.doc_id for r in out.collect()} == kept(rows)


def test_sketches_never_differ_in_more_bits_than_sets():
    rng = np.random.Generator(np.random.PCG64(5))
    for n in (1, 2, 250, 257, 300, 2000):
        base = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        for edits in (0, 1, n // 8, n):
            other = np.unique(np.concatenate([base[: len(base) - edits], rng.integers(-(2**63), 2**63 - 1, edits // 2)]))
            size = min(len(similar.sketch(base)), len(similar.sketch(other)))
            x, y = (similar.folded(similar.sketch(v), size).view(np.uint64) for v in (base, other))
            assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(base, other))


@pytest.mark.parametrize("frequent", [0, 0.5])
def test_similar_sets_share_the_guaranteed_positional_bytes(frequent):
    """The stage's index holds SimHash bytes by position; sets at the limit of similarity share the tally, whatever their sizes."""
    rng = np.random.Generator(np.random.PCG64(8))
    new = lambda n: rng.integers(-(2**63), 2**63 - 1, n)
    for n in [*range(1, 140), 255, 256, 257, 319, 320, 321, 511, 513, 639, 640, 1000, 5000]:
        for gone, more in ((0, n // 4), (n // 5, 0), (n // 9, n // 9), (n // 10, n // 10)):
            base = np.unique(new(n))
            other = np.unique(np.concatenate([rng.permutation(base)[: n - gone], new(more)]))
            common = len(np.intersect1d(base, other))
            if 9 * common < 4 * (len(base) + len(other)):
                continue
            late = np.sort(rng.permutation(base)[: int(n * frequent)])
            x, y = similar.positional_entries([base, other], late)
            assert len(np.intersect1d(x, y)) >= 1 + min(len(base), len(other)) // similar.TALLY
            assert len(x) <= 0.6 * n + 4


def test_a_position_holds_the_majority_bits_of_its_shingles():
    """One position's bytes don't depend on the others, and are a SimHash of what falls there."""
    rng = np.random.Generator(np.random.PCG64(9))
    base = np.unique(rng.integers(-(2**63), 2**63 - 1, 100))
    at = (base.view(np.uint64) >> np.uint64(32)).astype(np.int64) & 127
    want = set()
    for p in sorted(set(at.tolist())):
        held = base[at == p].view(np.uint64)
        bits = [2 * sum(int(h) >> b & 1 for h in held) > len(held) for b in range(64)]
        place = ((128 << 32 | p) * 0x9E3779B97F4A7C15) % 2**64
        value = sum(1 << b for b, on in enumerate(bits) if on) ^ place ^ place >> 32
        want.add(value - (1 << 64) if value >= 1 << 63 else value)
    found = similar.positional_entries([base[:0], base, base[:1]], base[:0])
    assert len(found[0]) == 0 and found[2].tolist() == base[:1].tolist()
    assert set(found[1].tolist()) <= want and len(found[1]) == (100 + 125) // 9 + 6


def crowd(count, shared, own):
    """Texts of two families that share a passage; in a family any two have a similarity of 0.8 or more."""
    passage = [f"p{i}" for i in range(shared)]
    return [(f * 1000 + k, " ".join([*passage, *(f"f{f}w{i}" for i in range(own)), f"x{k}"])) for f in range(2) for k in range(count)]


@pytest.mark.parametrize("partners", [2, 0])
def test_large_entries_of_several_components(spark, monkeypatch, partners):
    monkeypatch.setattr(similar, "SMALL_ENTRY", 4)
    monkeypatch.setattr(similar, "PARTNERS", partners)
    rows = crowd(12, 60, 8) + crowd(12, 60, 5) + [(5000 + k, " ".join(f"s{k}v{i}" for i in range(30)) + " " + " ".join(f"p{i}" for i in range(60))) for k in range(20)]
    rows = [(n, t) for n, (_, t) in enumerate(rows)]
    out = similar.near_dedup(docs(spark, rows))
    assert {r.doc_id for r in out.collect()} == kept(rows)


def test_frequent_shingles_leave_the_prefixes(spark, monkeypatch):
    """Texts that share a passage and little else have no candidates, and similar ones among them are still found."""
    passage = [f"p{i}" for i in range(60)]
    rows = [(k, " ".join([*passage, *(f"u{k}v{i}" for i in range(60))])) for k in range(200)]
    rows += [(500 + k, " ".join([*passage, *(f"u{k}v{i}" for i in range(57)), "x", "y", "z"])) for k in range(3)]
    df = docs(spark, rows).select("doc_id", "text")
    frequent = similar.frequent_shingles(df)
    want = {h for h in similar.shingle_set(" ".join(passage)).tolist()}
    assert want <= set(frequent.tolist()) and len(frequent) < 70
    assert similar.prefix_of(np.array([1, 2, 3, 4, 5, 6]), np.array([1, 3, 9])).tolist() == [2, 4]
    entries = similar.prefixes(df).selectExpr("explode(prefix) AS e").groupBy("e").count()
    assert entries.agg({"count": "max"}).first()[0] <= 4
    assert {r.doc_id for r in similar.near_dedup(docs(spark, rows)).collect()} == kept(rows) == set(range(200))


def test_counts_keep_what_is_frequent(monkeypatch):
    monkeypatch.setattr(similar, "HELD", 40)
    rng = np.random.Generator(np.random.PCG64(1))
    found, counts, seen = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), {}
    for _ in range(50):
        own = np.append(rng.integers(100, 10**6, 30), [7, 8, 9])
        for x in own.tolist():
            seen[x] = seen.get(x, 0) + 1
        found, counts = similar._added(np.concatenate([found, own]), np.concatenate([counts, np.ones(len(own), dtype=np.int64)]))
        assert len(found) <= 40
    assert {7, 8, 9} <= set(found.tolist())
    assert all(seen[x] - 50 * 33 / 41 <= c <= seen[x] for x, c in zip(found.tolist(), counts.tolist(), strict=True))
