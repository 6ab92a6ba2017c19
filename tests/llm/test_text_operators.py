"""Each text operator against a brute-force version, and on nulls, blanks, ties, repeats, empty tables and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from orthoscan.llm import chat_format, components, decontaminate, exact_dedup, language_id, line_dedup, packing, quality, secret_scan, simhash, suffix_lm
from orthoscan.llm.registry import oracle_sql, queries
from tests.conftest import same_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = {"digest": "x", "id": "y", "text_key": "z", "row": 1, "fp": 2, "_id": 3, "word": "w", "n": 4, "bucket": 5, "stats": 6, "rules": "r", "part": 7, "size": 8, "hash": 9}
A = {c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
BLANKS = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "\n\n"), (4, "\n\n"), (5, "É x"), (5, "other text of five")]


def low(text):
    return "".join(A.get(c, c) for c in text or "")


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", low(text)) if w]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def docs(spark, rows, clash=True):
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
    return df.withColumns({c: F.lit(v) for c, v in CLASHES.items()}) if clash else df


def texts(n, seed=1):
    rng = np.random.Generator(np.random.PCG64(seed))
    vocabulary = ["".join(rng.choice(list("abcdeéñ"), size=rng.integers(1, 7))) for _ in range(150)]
    return [" ".join(rng.choice(vocabulary, size=rng.integers(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, sf, duck, name):
    same_rows(queries()[name](spark, sf), duck, oracle_sql()[name])


# Exact dedup


def test_exact_dedup(spark):
    rows = BLANKS + [(100 + i, t if i % 2 else t.upper()) for i, t in enumerate(["aa b"] * 50 + ["É", "é"] + texts(300) + texts(100))]
    got = sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs(spark, rows)).collect())
    groups = defaultdict(list)
    for i, t in rows:
        groups[sha(low(t))].append(i)
    best = {k: max((i for i in v if i is not None), default=None) for k, v in groups.items()}
    want = sorted((i or -1, best[sha(low(t))], len(groups[sha(low(t))]), i == best[sha(low(t))], sha(low(t))) for i, t in rows)
    assert got == want
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    assert [r.kept for r in exact_dedup.exact_dedup(docs(spark, [(None, "a")])).collect()] == [True]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 5000])
def test_perfect_hash_is_minimal(n):
    keys = np.frombuffer(b"".join(hashlib.sha256(bytes(str(i), "ascii")).digest() for i in range(n)), dtype=np.uint8).reshape(n, 32)
    seed, moves, slots = exact_dedup.build_slots(keys)
    assert sorted(slots.tolist()) == list(range(n))
    assert np.array_equal(exact_dedup.slot_of(keys, n, seed, moves), slots)


# Line dedup


def test_line_dedup(spark):
    long = "a line that is long enough to count as one of them "
    common = [long + c for c in "xyz"]
    rows = BLANKS + [(10 + i, "\n".join(["top", common[0], "  " + common[0].upper() + "\t", f"own {i}"] + ([common[1]] if i < 4 else []) + ([common[2]] if i % 2 else []))) for i in range(12)]
    rows += [(10, common[0]), (10, common[0]), (None, common[2])]
    held, last = defaultdict(set), {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[low(line.strip(" \t\n\x0b\x0c\r"))].add(-1 if i is None else i)
    for k, v in held.items():
        last[k] = max(v)
    def kept(i, t):
        keys = [low(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")]
        gone = [len(k) >= 40 and len(held[k]) >= 5 and (-1 if i is None else i) != last[k] for k in keys]
        return "\n".join(x for x, g in zip((t or "").split("\n"), gone, strict=True) if not g), len(gone), sum(gone)
    want = sorted((i or -1, *kept(i, t)) for i, t in rows)
    out = line_dedup.line_dedup(docs(spark, rows))
    assert sorted((r.doc_id or -1, r.text or "", r._n_lines, r._n_dropped) for r in out.collect()) == want
    assert out.columns[:-2] == docs(spark, []).columns and {r._id for r in out.collect()} == {3}
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0


def test_line_dedup_of_a_run_over_many_partitions(spark, monkeypatch):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small ranges are put together
    try:
        long = "a line that is long enough to count as one of them "
        rows = [(i, "\n".join([long, long + str(i % 97), f"{long} own {i}", long])) for i in range(600)] + [(None, long)]
        hashes = line_dedup.sorted_lines(line_dedup.line_hashes(docs(spark, rows)).repartition(3)).collect()
        parts = defaultdict(set)
        for r in hashes:
            parts[bytes(r.hash)].add(r.part)
        assert len(hashes) == 2401 and max(map(len, parts.values())) > 1
        places = defaultdict(set)
        for r in hashes:
            places[bytes(r.hash), r.id].add(r.part)
        assert all(len(p) == 1 for p in places.values())
        got = {r.doc_id: r.text for r in line_dedup.line_dedup(docs(spark, rows)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    last = {n: max(i for i in range(600) if i % 97 == n) for n in range(97)}
    assert got[None] == "" and all(got[i] == "\n".join([long] * (i == 599) + [long + str(i % 97)] * (last[i % 97] == i) + [f"{long} own {i}"] + [long] * (i == 599)) for i in range(600))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_dedup_streams_the_ranged_sort(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan is what runs
    try:
        plan = plan_of(line_dedup.first_occurrences(line_dedup.line_hashes(docs(spark, [(1, "x" * 50), (2, "x" * 50)]))))
        assert plan.count("Exchange") == 1 and "rangepartitioning(hash" in plan and plan.count("Sort [") == 1 and "Window [" in plan
        assert plan.index("Window [") < plan.index("Sort [") < plan.index("Exchange")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_line_dedup_shuffles_only_texts_that_may_lose_lines(spark):
    line = "a line that is long enough to count as one of them"
    rows = [(i, line) for i in range(6)] + [(10 + i, f"{line} of {i}" + " word" * 20000) for i in range(30)]
    df = docs(spark, rows)
    bitmaps = line_dedup.keep_bitmaps(df)
    keyed = line_dedup._sieved(df.select(F.struct("*").alias("row"), line_dedup._id(), line_dedup._text_key()), bitmaps)
    assert {r.id: r.maybe for r in keyed.collect()} == {i: i < 5 for i, _ in rows}
    got = {r.doc_id: (r.text, r._n_dropped) for r in line_dedup.line_dedup(df).collect()}
    assert got == {i: ("", 1) if i < 5 else (t, 0) for i, t in rows}


def test_line_dedup_replaces_its_own_columns(spark):
    df = docs(spark, [(1, "x"), (2, None)]).withColumns({"_n_lines": F.lit("a"), "_N_dropped": F.lit("b"), "n_lines": F.lit("c"), "a.b": F.lit("d")})
    out = line_dedup.line_dedup(df)
    assert out.columns == [*[c for c in df.columns if c.lower() not in ("_n_lines", "_n_dropped")], "_n_lines", "_n_dropped"]
    assert sorted((r.doc_id, r._n_lines, r._n_dropped, r.n_lines, r["a.b"]) for r in out.collect()) == [(1, 1, 0, "c", "d"), (2, 1, 0, "c", "d")]
    import corpus_pipeline

    assert corpus_pipeline.line_stage(spark, df, "").columns == df.columns


# SimHash


def fingerprint(text):
    w = words(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps, bits=3):
    root = list(range(len(fps)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= bits and find(i) != find(j):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_near_duplicates(spark):
    base = texts(60, 4)
    rows = BLANKS + [(100 + i, t) for i, t in enumerate(base + [t + " tail" for t in base] + base[:5])]
    fps = [fingerprint(t) for _, t in rows]
    groups = defaultdict(list)
    for k, r in enumerate(linked(fps)):
        groups[r].append(k)
    want = []
    for members in groups.values():
        least = min((rows[k][0] for k in members if rows[k][0] is not None), default=None)
        want += [(rows[k][0] or -1, f"{fps[k]:016x}", least) for k in members]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in got) == sorted(want)
    kept = simhash.near_dedup(docs(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in got}
    assert kept.columns == docs(spark, []).columns
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize(("small", "forest"), [(32, 8192), (2, 8192), (2, 6), (1, 1)])
def test_links_at_every_entry_size(spark, monkeypatch, small, forest):
    monkeypatch.setattr(simhash, "SMALL_ENTRY", small)
    monkeypatch.setattr(simhash, "FOREST_ENTRY", forest)
    rng = np.random.Generator(np.random.PCG64(2))
    fps = [int(x) for x in rng.integers(0, 1 << 64, 25, dtype=np.uint64)]
    for f in fps[:6]:
        for _ in range(6):
            for b in rng.choice(64, 3, replace=False):
                f ^= 1 << int(b)
            fps.append(f)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.link_pairs(spark.createDataFrame([(f,) for f in signed], "fp long"))
    found = {r.node: r.root for r in components.connected_components(links).collect()}
    groups = defaultdict(set)
    for f, r in zip(signed, linked(fps), strict=True):
        groups[r].add(f)
    for members in groups.values():
        assert len({found.get(f, f) for f in members}) == 1 and {found.get(f, f) for f in members} == {min(members)}


def test_positions_cover_every_pair():
    for family, least in ((simhash.QUADRUPLES, simhash.MIN_COUNT), (simhash.QUINTUPLES, 1)):
        assert all(sum(set(p) <= set(shared) for p in family) >= least for shared in combinations(range(8), 5))
        assert all(sum(set(p) <= set(shared) for p in family) < max(least, 2) for shared in combinations(range(8), 4))


def test_the_count_drops_pairs_before_they_are_verified(spark, monkeypatch):
    rng = np.random.Generator(np.random.PCG64(4))
    fps = []
    for f in rng.integers(0, 1 << 63, 40).tolist():
        near = f ^ 0x0000_0001_0100_0001  # three bits in three bytes
        far = f ^ 0x0101_0101_0000_0000  # four bits in four bytes
        fps += [f, near, far]
    posted = simhash.postings(spark.createDataFrame([(f,) for f in fps], "fp long"), simhash.QUADRUPLES)
    counted = {(r.a, r.b) for r in simhash.counted_pairs(posted).collect()}
    monkeypatch.setattr(simhash, "MIN_COUNT", 1)
    every = {(r.a, r.b) for r in simhash.counted_pairs(posted).collect()}
    links = {p for p in every if (p[0] ^ p[1]).bit_count() <= 3}
    assert len(every) == 80 and len(counted) == 40 and counted == links


def test_components(spark):
    rng = np.random.Generator(np.random.PCG64(0))
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 150, (90, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    root = {}
    for a, b in edges:
        for x in (a, b):
            root.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in root.items() if k not in alone}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# Language


def test_language_id(spark):
    rng = np.random.Generator(np.random.PCG64(8))
    stock = {"aa": "tion ing the and of er".split(), "bb": "eau oui le de ré ment".split(), "cc": "ung heit der die sch".split()}
    make = lambda lang, n: " ".join("".join(rng.choice(stock[lang], 2)) for _ in range(n))
    rows = [(i, make(lang, int(rng.integers(3, 40))), lang) for i in range(240) for lang in [("aa", "bb", "cc")[i % 3]]]
    mixed = [(1000, make("aa", 30) + " " + make("bb", 10), "cc"), (1005, None, "aa"), (1010, "12 34 !!", "bb"), (1015, "", None), (None, make("cc", 9), None), (3, make("bb", 20), None)]
    df = spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string").withColumn("share", F.lit(1)).withColumn("turn", F.lit(2))
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(df, F.col("doc_id") < 200).collect()]
    assert len(got) == len(rows) + len(mixed) and all(0 <= s <= 1 for _, _, s in got)
    by_id = defaultdict(list)
    for i, lang, _ in got:
        by_id[i].append(lang)
    assert sum(by_id[i] == [lang] for i, _, lang in rows if i >= 200) >= 39
    assert (by_id[1000], by_id[1005], by_id[1010], by_id[1015], by_id[None]) == (["aa"], ["und"], ["und"], ["und"], ["cc"])
    assert {r.lang_pred for r in language_id.identify(df, F.lit(False)).collect()} == {"und"}
    assert language_id.identify(df.where("false"), F.lit(True)).count() == 0


def test_forward_backward_by_enumeration():
    rng = np.random.Generator(np.random.PCG64(6))
    n, lengths = 3, np.array([4, 1, 3])
    scores, move, start = rng.normal(size=(8, n)), rng.normal(size=(n, n)), rng.normal(size=n)
    begins = np.cumsum(lengths) - lengths
    posterior, expected = language_id.forward_backward(scores, begins, lengths, move, start)
    want, pairs = np.zeros((8, n)), np.zeros((n, n))
    for b, m in zip(begins, lengths, strict=True):
        paths = np.array(np.meshgrid(*[range(n)] * m)).reshape(m, -1).T
        weight = np.exp([start[p[0]] + sum(scores[b + i, y] for i, y in enumerate(p)) + sum(move[x, y] for x, y in zip(p, p[1:], strict=False)) for p in paths])
        weight /= weight.sum()
        for p, w in zip(paths, weight, strict=True):
            for i, y in enumerate(p):
                want[b + i, y] += w
            for x, y in zip(p, p[1:], strict=False):
                pairs[x, y] += w
    assert np.allclose(posterior, want) and np.allclose(expected, pairs)


@pytest.mark.parametrize("piece", [1, 2, 3, 7])
def test_forward_backward_in_pieces(monkeypatch, piece):
    rng = np.random.Generator(np.random.PCG64(7))
    n, lengths = 4, np.array([5, 1, 40, 7, 14, 3])
    scores, move, start = 2 * rng.normal(size=(lengths.sum(), n)), rng.normal(size=(n, n)), rng.normal(size=n)
    begins = np.cumsum(lengths) - lengths
    want = language_id.forward_backward(scores, begins, lengths, move, start)
    monkeypatch.setattr(language_id, "PIECE_WORDS", piece)
    got = language_id.forward_backward(scores, begins, lengths, move, start)
    assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1])


def test_long_texts_cost_what_short_ones_do():
    import time

    field = language_id.LanguageField(["aa", "bb", "cc", "dd"], {})
    field.weights = np.random.Generator(np.random.PCG64(1)).normal(size=field.weights.shape)
    some = "one two three four " * 250
    field.label([some])
    took = []
    for batch in ([some] * 1000, [some * 1000]):
        began = time.perf_counter()
        field.label(batch)
        took.append(time.perf_counter() - began)
    assert took[1] < 3 * took[0]


def test_letters_and_word_labels():
    assert not any(map(language_id.has_letter, ["½ ²", "①", "12 _ 3", "", "٣"])) and all(map(language_id.has_letter, ["½ a", "é", "中", "ª"]))
    field = language_id.LanguageField(["aa", "bb"], {b"x": 1, b"y": 2})
    field.lexicon_weights[1:] = 3 * np.eye(2)
    field.transitions = np.eye(2)
    assert field.label(["½ ²", "x x x", None, "y"])[0] == ["und", "aa", "und", "bb"]
    assert field.label_words("x x x y Y y") == [(b"x", "aa")] * 3 + [(b"y", "bb")] * 3 and field.label_words("½") == []


# Quality


def test_quality_held_out(spark, sf):
    rows = queries()["op4_quality_classifier"](spark, sf.replace("0.001", "0.01")).where("held_out").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(sf.replace("0.001", "0.01") + "/labels.parquet").collect()}
    marked = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.doc_id in labels]
    assert np.mean([p == y for _, p, y in marked]) > 0.93


def test_quality_edges(spark):
    rows = BLANKS + [(20 + i, t + (" ***" * 40 if i % 2 else "")) for i, t in enumerate(texts(80))]
    labels = spark.createDataFrame([(20 + i, 1 - i % 2, "x") for i in range(80)] + [(20, 1, "x"), (21, None, "x"), (None, 1, "x")], "doc_id long, quality int, stats string")
    df = docs(spark, rows)
    got = quality.quality_scores(df, labels, F.col("doc_id") < 60).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all((r.score >= 0.7) == (r.doc_id % 2 == 0) for r in got if (r.doc_id or 0) >= 60)
    assert {r.score for r in quality.quality_scores(df, labels.where("false"), F.lit(True)).collect()} == {0.5}
    kept = quality.keep_good(df, labels, F.col("doc_id") < 60)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect() if (r.doc_id or 0) >= 60} == set(range(60, 100, 2))
    assert quality.quality_scores(docs(spark, []), labels, F.lit(True)).count() == 0


def test_quality_keeps_all_without_labels(spark):
    df = docs(spark, BLANKS + [(10, "A clean text of some words."), (11, "!!!! |||| ####")])
    empty = spark.createDataFrame([], "doc_id long, quality int")
    other = spark.createDataFrame([(777, 1), (778, 0)], "doc_id long, quality int")
    for labels in (empty, other):
        assert quality.keep_good(df, labels, F.lit(True)).count() == df.count()


def test_isotonic():
    fit = quality.isotonic(np.arange(5), np.array([0.1, 0.5, 0.3, 0.9, 0.8]), np.array([1.0, 1, 3, 1, 1]))
    assert np.allclose(fit, [0.1, 0.35, 0.35, 0.85, 0.85])


# Packing


def test_a_packing_worker_keeps_few_stems():
    """Texts of ever new words don't fill a worker's memory, and ids stay the tokenizer's."""
    encoder = packing.WordEncoder(packing.tokenizer_path())
    letters = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(5))
    for begin in range(0, 400_000, 50_000):
        text = " ".join(letters(n) for n in range(begin, begin + 50_000))
        ids, lengths = encoder.encode(pa.array([text]))
        assert len(encoder.number) <= 250_000
    assert ids.tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, packing.END_ID] and lengths.tolist() == [len(ids)]


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    rows = BLANKS + [(50 + i, t) for i, t in enumerate(texts(150) + [" ".join(texts(30)), "Don't STOP: we'll <|endoftext|>go... ½ Σς áé"])]
    out = packing.pack(docs(spark, rows), capacity=64).collect()
    want = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i or -1, n, at, len(ids[at : at + 64]), zlib.crc32(np.array(ids[at : at + 64], dtype="<u4").tobytes())) for n, at in enumerate(range(0, len(ids), 64))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 64
    assert len(sequences) <= -(-sum(w[3] for w in want) // 64) + 1
    assert packing.pack(docs(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_every_piece(seed):
    rng = np.random.Generator(np.random.PCG64(seed))
    histogram = Counter(int(x) for x in rng.integers(1, 101, 300))
    histogram[100] += 7
    used, n = Counter(), 0
    for lengths, times in packing.plan_packing(histogram, 100):
        assert sum(lengths) <= 100
        n += times
        for x in lengths:
            used[x] += times
    room = []  # plain best-fit decreasing
    for x in sorted(histogram.elements(), reverse=True):
        fit = min((k for k, free in enumerate(room) if free >= x), key=room.__getitem__, default=None)
        if fit is None:
            room.append(100 - x)
        else:
            room[fit] -= x
    assert used == histogram and n <= len(room)


@pytest.mark.parametrize("seed", range(100))
def test_complements_are_exact(seed):
    rng = np.random.Generator(np.random.PCG64(seed))
    counts = np.zeros(61, dtype=np.int64)
    for x in rng.integers(1 + 3 * (seed % 2), 40, rng.integers(3, 14)):
        counts[x] += 1
    index = packing.Complements(counts)
    have = [x for x in range(61) for _ in range(counts[x])]
    for gap in range(1, 61):
        found = index.exact(gap)
        there = any(sum(c) == gap for k in (1, 2, 3) for c in combinations(have, k))
        assert (found is not None) == there and (found is None or (sum(found) == gap and not Counter(found) - Counter(have)))


def test_complements_try_every_pair():
    counts = np.zeros(51, dtype=np.int64)
    counts[[4, 5, 6, 13, 15, 22, 26, 34]] = 1
    assert sorted(packing.Complements(counts).exact(50)) == [13, 15, 22]


def test_word_ids_are_the_tokenizers_own():
    import pyarrow as pa

    encoder = packing.WordEncoder(packing.tokenizer_path())
    rng = np.random.Generator(np.random.PCG64(9))
    signs = list("abcxyzABÉéßÿŸñ'İΣσçÇ×÷µªº½²①…—.,!?<|>&%$ \n\t\x1c0123ÅKſﬁ\u0301\u200b\xa0\u3000世") + ["<|endoftext|>", "'s", "'LL", " the "]
    odd = ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(2000)] + [None, "", " ", "a<|endoftext|>.", "word " * 30_000]
    for _ in range(2):  # the second time from what was kept
        ids, lengths = encoder.encode(pa.array(odd))
        want = [[*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for t in odd]
        assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


# Language model


def test_words_of_slices():
    import pyarrow as pa
    from orthoscan.llm.common import text_slices

    batch = pa.RecordBatch.from_arrays([pa.array([None, "", " ", *texts(400), "A\tb\x1cÉ \n"])], ["text"])
    for part in text_slices(batch, 0, 900):
        rows = part.column(0).to_pylist()
        assert suffix_lm._words(part.column(0)).to_pylist() == [words(t) for t in rows]
        tallies = Counter()
        for keys, n in suffix_lm._tallies(suffix_lm._words(part.column(0)), np.ones(len(rows))):
            tallies.update(dict(zip((int(k >> 8).to_bytes(7, "big") for k in keys.tolist()), n.tolist(), strict=True)))
        streams = [b"\n" * 6 + " ".join(words(t)).encode() + b"\n" for t in rows]
        assert tallies == Counter(s[i - 6 : i + 1] for s in streams for i in range(6, len(s)))


def test_suffix_lm_looks_each_gram_up_once(monkeypatch):
    import pyarrow as pa

    rows = [(i, t) for i, t in enumerate(["the same words again", "the same words again", "other words", "", None])]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], ["doc_id", "text"])
    streams = [b"\n" * 6 + " ".join(words(t)).encode() + b"\n" for _, t in rows]
    grams = [Counter(int.from_bytes(s[i - 6 : i + 1], "big") for i in range(6, len(s))) for s in streams]
    heavy = np.array(sorted({g for own in grams for g in own})[::2], dtype=np.uint64)
    logs = -np.arange(1, len(heavy) + 1, dtype=np.float32)
    known, asked, search = {b"words": 0.5, b"same": 0.25, b"\n": 1.0}, [], np.searchsorted
    monkeypatch.setattr(suffix_lm.np, "searchsorted", lambda a, v, *more, **named: asked.append(len(v)) or search(a, v, *more, **named))
    out = suffix_lm._scored(batch, 7, (pa.array(list(known), pa.large_binary()), np.array(list(known.values()))), heavy, logs)
    assert asked == [len({g for own in grams for g in own})]
    by = dict(zip(heavy.tolist(), logs.tolist(), strict=True))
    for r, own, (_, t) in zip(out.to_pylist(), grams, rows, strict=True):
        seen = [w.encode() for w in words(t)]
        assert np.isclose(r["score"], sum(n * by.get(g, 0) for g, n in own.items()))
        assert dict(zip(r["grams"], r["grams_times"], strict=True)) == {g: n for g, n in own.items() if g not in by}
        assert (r["n_tokens"], r["hits"]) == (len(seen) + 1, 1 + sum(w in known for w in seen))
        assert np.isclose(r["base"], 1 + sum(known.get(w, 0) for w in seen))
        assert Counter(dict(zip(r["words"], r["words_times"], strict=True))) == Counter(w for w in seen if w not in known)


def test_suffix_lm_base_and_counts(spark):
    rows = BLANKS + [(10 + i, t) for i, t in enumerate(texts(120, 3))]
    got = suffix_lm.score_texts(docs(spark, rows), F.col("doc_id") % 3 != 0).collect()
    seen = Counter(w for i, t in rows if i is not None and i % 3 for w in [*words(t), "\n"])
    total, distinct = sum(seen.values()), len(seen)
    want = sorted((i or -1, len(words(t)) + 1, sum(seen[w] > 0 for w in [*words(t), "\n"]), total, round(sum(np.log10((seen[w] + 1) / (total + distinct + 1)) for w in [*words(t), "\n"]), 6)) for i, t in rows)
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert suffix_lm.score_texts(docs(spark, []), F.lit(True)).count() == 0
    assert all(r.base_score == 0 for r in suffix_lm.score_texts(docs(spark, rows), F.lit(False)).collect())


def test_suffix_lm_knows_a_rare_end(spark, monkeypatch):
    monkeypatch.setattr(suffix_lm, "HEAVY_WORDS", 2)
    r = suffix_lm.score_texts(docs(spark, [(1, "a " * 10)]), F.lit(True)).first()
    assert (r.n_tokens, r.n_known) == (11, 11)
    assert np.isclose(r.base_score, 10 * np.log10(11) + np.log10(2) - 11 * np.log10(14))


@pytest.mark.parametrize(("heavy", "part"), [(10_000_000, 1 << 24), (40, 500), (1, 10_000)])
def test_suffix_tree_by_brute_force(spark, monkeypatch, heavy, part):
    monkeypatch.setattr(suffix_lm, "HEAVY_GRAMS", heavy)
    monkeypatch.setattr(suffix_lm, "PART_SYMBOLS", part)
    depth, prior, bits, least = suffix_lm.DEPTH, 5.0, 0.05, 4
    rows = BLANKS + [(10 + i, t) for i, t in enumerate(texts(60, 5))] + [(90, "unseen Zs ½ " * 50), (None, "no id")]
    stream = lambda t: b"\n" * depth + " ".join(words(t)).encode() + b"\n"
    counts = [Counter() for _ in range(depth + 1)]
    for i, t in rows:
        if i is not None and i % 3:
            s = stream(t)
            for k in range(depth + 1):
                counts[k].update(s[at - k : at + 1] for at in range(depth, len(s)))
    total = [Counter() for _ in range(depth + 1)]
    for k in range(1, depth + 1):
        for g, n in counts[k].items():
            total[k][g[:-1]] += n
    retained = {}
    def prob(context, symbol):
        while context and not retained.get(context):
            context = context[1:]
        if not context:
            return (counts[0][symbol] + 1) / (sum(counts[0].values()) + 256)
        return (counts[len(context)][context + symbol] + prior * prob(context[1:], symbol)) / (total[len(context)][context] + prior)
    for k in range(1, depth + 1):
        following = defaultdict(list)
        for g, n in counts[k].items():
            following[g[:-1]].append((g[-1:], n))
        for context, after in following.items():
            m = total[k][context]
            retained[context] = m >= least and sum(n / m * np.log2(n / m / prob(context[1:], x)) for x, n in after) >= bits
    assert sum(retained.values()) > 100
    for context in [b"", *[c for c, r in retained.items() if r][::50]]:
        assert abs(sum(prob(context, bytes([x])) for x in range(256)) - 1) < 1e-9
    want = sorted((i or -1, round(sum(np.log10(prob(s[at - depth : at], s[at : at + 1])) for at in range(depth, len(s))), 3)) for i, t in rows for s in [stream(t)])
    got = suffix_lm.score_texts(docs(spark, rows), F.col("doc_id") % 3 != 0, min_count=least, min_divergence=bits, prior=prior).collect()
    assert np.allclose(sorted((r.doc_id or -1, r.score) for r in got), want, rtol=1e-5, atol=2e-3)


def test_gram_sums_hold_few_grams_at_a_time(monkeypatch):
    """Not what 64 rows of a batch have, whatever their sizes; the sums are those of all texts."""
    import pyarrow as pa

    class Tasks:
        """In a DataFrame's place: the functions that its tasks run."""

        def __init__(self):
            self.work = []

        def mapInArrow(self, work, _):  # noqa: N802
            self.work.append(work)
            return self

        def repartition(self, *_):
            return self

    monkeypatch.setattr(suffix_lm, "_HELD_GRAMS", 300)
    monkeypatch.setattr(suffix_lm, "_SHARE", 200, raising=False)
    count, merge = suffix_lm.gram_counts(tasks := Tasks(), 1) and tasks.work
    rows = [("one two three four five six " * (i % 3 + 1), i % 4 > 0) for i in range(200)]
    blobs = [b for i in range(0, len(rows), 2) for b in count(iter([pa.RecordBatch.from_pylist([{"text": t, "training": own} for t, own in rows[i : i + 2]])]))]
    batch = pa.Table.from_batches(blobs).combine_chunks().to_batches()[0]
    sizes, plain = [], suffix_lm._Sums.merge
    monkeypatch.setattr(suffix_lm._Sums, "merge", lambda sums: sizes.append(sums.size) or plain(sums))
    out = list(merge(iter([batch])))
    want, own = Counter(), Counter()
    for t, training in rows:
        s = b"\n" * 6 + t.strip().encode() + b"\n"
        grams = [int.from_bytes(s[i - 6 : i + 1], "big") for i in range(6, len(s))]
        want.update(grams)
        own.update(grams if training else [])
    got = {g: (n, everywhere) for b in out for row in b.to_pylist() for g, n, everywhere in zip(*(suffix_lm._unpacked(row[c], row["size"]).tolist() for c in ("grams", "n", "everywhere")), strict=True)}
    assert got == {g: (own[g], n) for g, n in want.items()}
    assert len(batch) == 100 and max(sizes) <= 2 * max(300, len(want)) + 200


def test_suffix_lm_of_a_very_long_text(spark):
    row = (1, "one two three four five " * 40_000)
    got = suffix_lm.score_texts(docs(spark, [row, (2, "one two")]), F.lit(True)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known) for r in got) == [(1, 200_001, 200_001), (2, 3, 3)]


# Secrets


def test_trigram_queries():
    q = secret_scan.trigram_query
    assert q("[0-9a-f]+") is None and q("a?b") is None
    assert q("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert set(q("(abc|xyzw)d")) == {frozenset({"abc", "bcd"}), frozenset({"xyz", "yzw", "zwd"})}
    for rule in secret_scan.RULES:
        for text in ("password = 'abcdef12'", 'api_key:"abcdefgh"', "ApiKey=12345678", "AKIA" + "A" * 20, "-----BEGIN RSA PRIVATE KEY-----", "eyJab.cd.ef", "ghp_" + "a" * 40, "xoxb-" + "1" * 20):
            if (clauses := q(rule.regex)) is not None and re.search(rule.regex, text):
                assert any(c <= secret_scan.trigrams(text.lower()) for c in clauses)


def test_secret_spans(spark):
    tail = "0123456789abcdef0123456789abcdef"
    rows = BLANKS + [(20, f"é🙂 Password = \"hunter22x\" secret=token:abcdefgh {tail} AKIA{'Z' * 16} AKIA12 token=abc"), (20, tail), (None, "passwd:" + "q" * 6), (21, "x" * 5000 + " api-key api_key=AKIA" + "B" * 30)]
    got = sorted((r.doc_id or -1, tuple((s.kind, s.start, s.end) for s in r.spans)) for r in secret_scan.secret_spans(docs(spark, rows)).collect())
    def spans(text):
        out = []
        for n, r in enumerate(secret_scan.RULES):
            out += [(n, m.start(), m.end()) for m in re.finditer(r.regex, text or "") if len(m[r.group]) >= r.least]
        return tuple(sorted(out, key=lambda s: (s[1], s[0])))
    assert got == sorted((i or -1, spans(t)) for i, t in rows)
    assert any(s for _, s in got) and secret_scan.secret_spans(docs(spark, [])).count() == 0


def test_secret_spans_of_very_many_matches(spark):
    one = "token=abc123xyz é "
    for n in (0, 1, 2, 3, 5, 16, 17, 100_000):
        r = secret_scan.secret_spans(docs(spark, [(1, one * n)])).first()
        assert [(s.start, s.end) for s in r.spans] == [(len(one) * k, len(one) * k + 15) for k in range(n)]


def test_trigram_queries_of_other_syntax():
    q = secret_scan.trigram_query
    assert q("(?i)abc") is None and q("(?=abc)x") is None and q("x.y") is None
    assert q("ab{2,3}cd") == [frozenset({"abb", "bbc", "bcd"})] and q("a{2}b{3,}cde") == [frozenset({"cde"})] and q("a[^b]cde") == [frozenset({"cde"})]
    assert q("(?:foo|bar)?bazz") == [frozenset({"azz", "baz"})] and q(r"x\.yzw\d+") == [frozenset({".yz", "x.y", "yzw"})]
    assert set(q("abc|def")) == {frozenset({"abc"}), frozenset({"def"})}


# Chats


def test_chat_format(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\s>[\\INST][\\\\/INST]", "", None, "a\nb", "<<s>>[[INST]]", "é🙂"]
    rows = [(1, n, ("user", "assistant")[n % 2], t) for n, t in enumerate(nasty)] + [(2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (3, 0, "sys%0A\n[INST]", "y"), (None, None, None, None), (4, 0, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"nth": F.lit(1), "formatted": F.lit("f"), "end": F.lit(3)})
    out = chat_format.format_chats(df)
    turns = defaultdict(list)
    for c, n, role, t in rows:
        turns[c].append((-1 if n is None else n, role or "", t or ""))
    whole = {r.conv_id: r.formatted for r in out.collect()}
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.examples(out)).collect()}
    each = defaultdict(list)
    for r in chat_format.examples(out).collect():
        assert whole[r.conv_id].startswith(r.text)
        each[r.conv_id].append((r.nth, len(r.text), r.text[r.loss_start : r.loss_start + r.loss_chars], r.last))
    for c, own in turns.items():
        own.sort()
        assert [(t.role, t.text) for t in back[c].turns] == [x[1:] for x in own]
        assert not re.search(r"\[/?INST\]|</?s>", "".join(re.split(r"\[/?INST\]|</?s>", whole[c])))
        want = [x[2] for x in own if x[1] == "assistant"] + ([""] if own[-1][1] != "assistant" else [])
        assert list(back[c].masked) == want and len(each[c]) == len(want)
        assert back[c].formatted_chars == sum(n for _, n, _, _ in each[c]) and max(each[c])[1] == len(whole[c])
        assert [last for *_, last in sorted(each[c])] == [False] * (len(want) - 1) + [True]
    assert chat_format.format_chats(df.where("false")).count() == 0


# Decontamination


def test_decontamination(spark):
    item = "Anna Smith buys 12 apples and 7 ripe pears at the old market before her brother walks 5 km home. Later Anna Smith sells 3 of them"
    other = item.replace("Anna Smith", "Tom").replace("12", "1,450").replace("7 ", "88 ").replace("5 km", "9.5 miles").replace("3 of", "41 of")
    scores = "in that game the reds made {} goals while all the blues made {} goals too"
    bench = spark.createDataFrame([(1, item), (2, "one two three four five six"), (3, None), (4, "a b"), (1, item), (5, scores.format(4, 4))], "item_id long, text string").withColumn("hash", F.lit(1))
    filler = " ".join(texts(3))
    rows = BLANKS + [(20, f"{filler} {item} {filler}"), (21, f"{filler}\n{other}"), (22, item.lower().replace(" ", "  ")), (23, filler), (24, "zero one two three four five six seven"), (24, filler), (25, scores.format(6, 7)), (27, scores.format(6, 6)), (None, item), (26, other), (26, other)]
    df = docs(spark, rows)
    got = {(r.id, r.item_id): r for r in decontaminate.contaminated(df, bench).collect()}
    nul = decontaminate.NO_ID
    assert set(got) == {(20, 1), (21, 1), (22, 1), (24, 2), (nul, 1), (26, 1), (27, 5)}  # 25 fills one slot in two ways
    assert got[20, 1].share == 1 and got[21, 1].sort == "template"
    kept = decontaminate.decontaminate(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == sorted([0, *(i for i, _ in BLANKS if i), 23, 24, 25])
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0 and decontaminate.contaminated(df, bench.where("false")).count() == 0


def test_decontamination_new_values_may_coincide(spark):
    item = "a farmer has {} red apples and {} green pears in the barn and sells {} plums to every guest at the gate"
    bench = spark.createDataFrame([(1, item.format(3, 5, 9))], "item_id long, text string")
    df = docs(spark, [(1, item.format(4, 4, 7)), (2, item.format(6, 6, 6)), (3, item.format(1, 2, 8)), (4, " ".join(texts(3)))])
    assert sorted(r.id for r in decontaminate.contaminated(df, bench).collect()) == [1, 2, 3]
    twice = spark.createDataFrame([(1, item.format(3, 3, 9))], "item_id long, text string")
    assert sorted(r.id for r in decontaminate.contaminated(df, twice).collect()) == [1, 2]  # 3 fills one slot in two ways


def test_decontamination_of_items_without_windows_and_of_long_quotes(spark):
    sums, long = "What is 12 + 7 x 3?", " ".join(f"red {n} or {n * 7}" for n in range(10, 22))
    rng = np.random.Generator(np.random.PCG64(2))
    passage = [f"w{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}" for a, b, c in rng.integers(0, 26, (500, 3))]
    bench = spark.createDataFrame([(1, sums), (2, long), (3, " ".join(passage)), (4, "a 1 b 2")], "item_id long, text string")
    filler = " ".join(texts(3))
    quote = lambda n: f"{filler} {' '.join(passage[200 : 200 + n])} {filler}"
    rows = [(1, f"{filler} what is 12 + 7 x 3 {filler}"), (2, f"{filler} {long}"), (3, quote(80)), (4, quote(50)), (5, quote(49)), (6, "What is 12 + 8 x 3?"), (7, long.replace("105", "106")), (8, f"{filler} a 1 b 2"), (9, filler)]
    got = {(r.id, r.item_id): r for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 3)}
    assert got[1, 1].share == got[2, 2].share == 1 and got[3, 3].n_windows == 73 and got[3, 3].share < decontaminate.MIN_SHARE
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs(spark, rows), bench).collect()) == [5, 6, 7, 8, 9]


def test_decontamination_shuffled_agrees(spark, sf, monkeypatch):
    query = queries()["op10_template_decontamination"]
    want = sorted(tuple(r) for r in query(spark, sf).collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert sorted(tuple(r) for r in query(spark, sf).collect()) == want and want
    d, b = (spark.read.parquet(f"{sf}/{n}.parquet").collect() for n in ("documents", "benchmark"))
    assert {(x.doc_id, y.item_id) for x in d for y in b if y.text in x.text} <= {(r[0], r[1]) for r in want}


def sequences(text):
    """(sort, [(code, value or None)]) of a text, token by token, without arrays."""
    kinds, before = [], None
    for word in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode()):
        code = bytes(b + 32 if 65 <= b <= 90 else b for b in word)
        if any(48 <= b <= 57 for b in word):
            kind = "number"
        elif before == "number" and code.decode("utf-8", "replace") in decontaminate.UNITS:
            kind = "unit"
        elif 65 <= word[0] <= 90 or (word[0] == 0xC3 and len(word) > 1 and 0x80 <= word[1] <= 0x9E):
            kind = "name"
        else:
            kind = None
        kinds.append((code, kind))
        before = kind
    for sort, replaced in ((0, ("number", "unit")), (1, ("number", "unit", "name")), (2, ())):
        out, last = [], None
        for code, kind in kinds:
            kind = kind if kind in replaced else None
            if kind and kind == last:
                out[-1] = (kind, tuple(sorted((*out[-1][1], code))))
            else:
                out.append((kind, (code,)) if kind else ((code,), None))
            last = kind
        yield sort, out


def windows_of(seq, size):
    return {i: seq[i : i + size] for i in range(len(seq) - size + 1) if sum(v is None for _, v in seq[i : i + size]) >= decontaminate.MIN_LITERAL}


def shape(window):
    """What is compared of a window: words, and the types of placeholders."""
    return tuple(c for c, _ in window)


def held_items(texts, items):
    """{(id, item_id): (n_windows, share)} by comparing every item with every line of every text."""
    found, seqs, indexes = {}, [(i, dict(sequences(text))) for i, text in texts], {}
    for item, words in items:
        own = {sort: windows_of(seq, min(len(seq), decontaminate.WINDOW)) for sort, seq in sequences(words)}
        if own[0] or own[1]:
            own.pop(2)
        for sort, asked in own.items():
            if not asked:
                continue
            size = len(next(iter(asked.values())))
            if (sort, size) not in indexes:
                index = indexes[sort, size] = defaultdict(list)
                for n, (_, seq) in enumerate(seqs):
                    for at, w in windows_of(seq[sort], size).items():
                        index[shape(w)].append((n, at, w))
            by_text = defaultdict(lambda: defaultdict(list))
            for p, w in asked.items():
                for n, at, mine in indexes[sort, size].get(shape(w), ()):
                    by_text[n][at - p].append((p, w, mine))
            for n_text, lines in by_text.items():
                i = seqs[n_text][0]
                for line in lines.values():
                    pairs = {(a[1], b[1]) for _, w, mine in line for a, b in zip(w, mine, strict=True) if a[1]}
                    even = len({a for a, _ in pairs}) == len(pairs)
                    n, run, begin, end = len(line) if even else 0, 0, -1, -1
                    counted = sorted(p for p, w, mine in line if even or w == mine)
                    for p in counted:
                        begin, end = (begin if p <= end else p), p + size
                        run = max(run, end - begin)
                    if run >= decontaminate.MIN_RUN:
                        n = max(n, len(counted))
                    share = n / len(asked)
                    if n and share >= (1 if sort == 2 else decontaminate.MIN_SHARE) or sort != 2 and run >= decontaminate.MIN_RUN:
                        found[i, item] = max(found.get((i, item), (0, 0)), (share, n))
    return found


def test_decontamination_agrees_with_comparing_all(spark, sf):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rng = random.Random(5)
    words = "the a boat of river and under with stone many light walks 12 7.5 kg Anna Otto Bern 300 km green".split()
    items += [(10_000 + i, " ".join(rng.choices(words, k=rng.choice((4, 6, 9, 30, 90, 400))))) for i in range(40)]
    made = [t for i, t in items if i >= 10_000]
    for i in range(120):
        a, b = rng.sample(made, 2)
        a, b = a.split(), b.split()
        cut, long = rng.randrange(len(a)), rng.randrange(5, 80)
        text = [*b[: rng.randrange(20)], *a[cut : cut + long], *rng.choices(words, k=10)]
        rows.append((10**6 + i, " ".join(str(rng.randrange(50)) if w == "12" and rng.random() < 0.5 else w for w in text)))
    few = [(i, t) for i, t in rows if len(t) < 40_000]
    got = {(r.id, r.item_id): (r.share, r.n_windows) for r in decontaminate.contaminated(docs(spark, few), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == held_items(few, items) and sum(i >= 10**6 for i, _ in got) > 30


def test_decontamination_does_not_pair_what_shares_a_stock_phrase(spark):
    stock = " ".join(f"stock{j}x".replace("0", "o").translate(str.maketrans("123456789", "abcdefghi")) for j in range(40))
    own = lambda kind, i, n: " ".join(kind + "".join(chr(97 + int(c)) for c in f"{i:03d}{j:03d}") for j in range(n))
    items = spark.createDataFrame([(i, f"{own('i', i, 120)} {stock} {own('k', i, 120)}") for i in range(300)], "item_id long, text string")
    df = docs(spark, [(i, f"{own('d', i, 30)} {stock} {own('e', i, 30)}") for i in range(300)])
    sizes = [(decontaminate.LITERAL, decontaminate.WINDOW)]
    asked = decontaminate._item_windows(items, sizes, True)
    runs = decontaminate._item_windows(items, [(decontaminate.LITERAL, decontaminate.MIN_RUN)], False)
    held = decontaminate.template_windows(decontaminate._rows(df, "doc_id"), sizes).join(asked.select("hash").distinct(), "hash", "left_semi")
    assert held.count() == 300 * 33
    assert decontaminate.candidate_lines(asked, runs, held, decontaminate.MIN_SHARE).count() == 0
    assert decontaminate.contaminated(df, items).count() == 0
