"""Suffix arrays and the removal of repeated strings against plain versions."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from orthoscan.llm import suffix_array, suffix_dedup
from tests.conftest import same_rows


def common(b, i, j):
    k = 0
    while max(i, j) + k < len(b) and b[i + k] == b[j + k]:
        k += 1
    return k


@pytest.mark.parametrize("buckets", [512, 3])
def test_suffix_arrays_and_prefixes_equal_sorting(monkeypatch, buckets):
    monkeypatch.setattr(suffix_array, "BUCKETS", buckets)
    rng = np.random.Generator(np.random.PCG64(2))
    for trial in range(400):
        d = rng.integers(0, rng.integers(1, 7), rng.integers(0, 70)).astype(np.uint8)
        d = np.tile(d[:5], 9) if trial % 4 == 0 else d + np.uint8(249) if trial % 5 == 0 else d
        b = bytes(d)
        sa = suffix_array.suffix_array(d)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        want = np.zeros(len(b), dtype=int)
        for x, y in zip(sa, sa[1:], strict=False):
            want[y] = common(b, x, y)
        assert suffix_array.common_prefixes(d, sa).tolist() == want.tolist()


def test_runs_hold_every_window_once(monkeypatch):
    """With the anchor that the window alone determines, however the texts are cut up."""
    monkeypatch.setattr(suffix_dedup, "LENGTH", 12)
    monkeypatch.setattr(suffix_dedup, "ANCHOR", 4)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 17)
    rng = np.random.Generator(np.random.PCG64(3))
    sizes = [0, 5, 12, 11, 90, 0, 13, 40, 12]
    data = rng.integers(97, 100, sum(sizes)).astype(np.uint8)
    ends = np.cumsum(sizes)
    windows = {int(i) for a, b in zip(ends - sizes, ends, strict=True) for i in range(a, b - 11)}
    seen, anchor_of = [], {}
    for piece, lo, inside in suffix_dedup._pieces(data, ends):
        for start, n, anchor, key in zip(*suffix_dedup.runs_of(piece, inside), strict=True):
            for i in range(start, start + n):
                seen.append(i + lo)
                own = bytes(piece[i : i + 12])
                assert anchor_of.setdefault(own, (start + anchor - i, key)) == (start + anchor - i, key)
    assert sorted(seen) == sorted(windows)


def plain(texts, length=400):
    texts = [(t or "").encode() for t in texts]
    held = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if held[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        out.append((len(t), bytes(np.frombuffer(t, dtype=np.uint8)[~gone]), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))))
    return out


def words(rng, n):
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, k)) for k in rng.integers(2, 9, n))


def corpus():
    rng = np.random.Generator(np.random.PCG64(9))
    passages = [words(rng, 90), words(rng, 72), "é" * 230, "ab" * 260]
    texts = [None, "", "x", "y" * 399, "z" * 400, "w" * 401, words(rng, 300), words(rng, 6000)]
    texts += [words(rng, 20) + passages[0] + words(rng, 30) for _ in range(25)]  # a crowd around one passage
    texts += [passages[1] + words(rng, 9), words(rng, 9) + passages[1], words(rng, 40) + passages[1][3:-3]]
    texts += [passages[2] + "a", "b" + passages[2], words(rng, 5) + passages[3] + words(rng, 80) + passages[3]]
    texts += [texts[6]] * 12 + [texts[6][:700] + "!" + texts[6][700:]]
    long = words(rng, 500)
    texts += [long[:1000], long[601:1700], long[1301:], long[:k] + "#" + long[k + 1 :] if (k := 900) else ""]
    return texts


@pytest.mark.parametrize("crowd", [512, 4, 1])
def test_repeated_strings_go_and_nothing_else(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "SHARDS", 3)
    texts = corpus()
    rows = [(n % 40 if n % 11 else None, t, "o", b"k", 3) for n, t in enumerate(texts)]
    out = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string, owner string, kept binary, start int").repartition(4))
    got = Counter((r.row.doc_id, r.row.text, r.row.owner, r.n_bytes, bytes(r.kept), tuple((s.start, s.end) for s in r.spans)) for r in out.collect())
    want = Counter((r[0], r[1], "o", n, kept, tuple(spans)) for r, (n, kept, spans) in zip(rows, plain(texts), strict=True))
    assert got == want
    assert sum(len(s) for *_, s in want) > 40


def test_suffix_arrays_hold_only_what_may_repeat(monkeypatch):
    """Blocks that are nowhere else, and all but one of equal ones, stay out; the windows found are those of a plain version."""
    rng = np.random.Generator(np.random.PCG64(6))
    base = words(rng, 1500).encode()
    texts = [base] + [base[:k] + b"#" + base[k + 1 :] for k in (300, 2500, 2600, 6001)] + [base[3000:4200] + words(rng, 100).encode()]
    rows = []
    for n, text in enumerate(texts):
        data = np.frombuffer(text, dtype=np.uint8)
        for s, w, a, key in zip(*suffix_dedup.runs_of(data, np.array([len(data)])), strict=True):
            rows.append({"owner": bytes([n]), "start": int(s), "windows": int(w), "anchor": int(a), "copies": 1, "bytes": text[s : s + w + 399], "key": int(key)})
    kinds = {(r["key"], r["bytes"]): r for r in rows}
    several = Counter(key for key, _ in kinds)
    rows = [r for (key, _), r in kinds.items() if several[key] > 1]
    sizes, array = [], suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda text: sizes.append(len(text)) or array(text))
    got = suffix_dedup._shard_repeats(pa.Table.from_pylist(rows)).to_pylist()
    held = Counter(r["bytes"][i : i + 400] for r in rows for i in range(r["windows"]))
    want = {(r["owner"], r["start"] + i) for r in rows for i in range(r["windows"]) if held[r["bytes"][i : i + 400]] > 1}
    assert {(r["owner"], r["start"] + i) for r in got for i in range(r["windows"])} == want and want
    assert sum(sizes) < 0.75 * sum(len(r["bytes"]) for r in rows)


def test_no_rows_and_no_repeats(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    rng = np.random.Generator(np.random.PCG64(5))
    one = spark.createDataFrame([(1, words(rng, 400)), (None, None)], "doc_id long, text string")
    assert {(r.row.doc_id, r.n_bytes == len(r.kept), len(r.spans)) for r in suffix_dedup.suffix_dedup(one).collect()} == {(1, True, 0), (None, True, 0)}


def test_op12_equals_sql_and_a_plain_version(spark, sf, duck):
    out = suffix_dedup.op12_suffix_dedup(spark, sf)
    same_rows(out, duck, suffix_dedup.OP12_SQL)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r.doc_id: (n, sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest()) for r, (n, kept, spans) in zip(docs, plain([r.text for r in docs]), strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()} == want
