"""Texts of 20,000 words and conversations of many turns, against brute force: nothing is read in part."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthoscan.llm import chat_format, decontaminate, exact_dedup, packing, simhash
from tests.llm.test_text_operators import docs, fingerprint, held_items, linked, low, sha, texts

LENGTH = 20_000


@pytest.fixture(scope="module")
def rows():
    """Long texts, with copies that differ in their last word only, and in capitals only."""
    long = [" ".join(texts(LENGTH // 25, seed)) for seed in (11, 12)]
    assert all(len(t.split()) > LENGTH for t in long)
    return [(i, t) for i, t in enumerate([*long, long[0] + " end", long[0].translate({ord(c): ord(c) - 32 for c in "abcde"}), long[1][:-1], "short", None], 1)]


def test_near_duplicates(spark, rows):
    fps = [fingerprint(t) for _, t in rows]
    want = sorted((i, f"{fp:016x}", rows[root][0]) for (i, _), fp, root in zip(rows, fps, linked(fps), strict=True))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(spark, rows)).collect()) == want


def test_exact_dedup(spark, rows):
    keys = [sha(low(t)) for _, t in rows]
    last, size = {k: i for (i, _), k in zip(rows, keys, strict=True)}, Counter(keys)
    want = sorted((i, last[k], size[k], k) for (i, _), k in zip(rows, keys, strict=True))
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_dedup(docs(spark, rows)).collect()) == want and max(size.values()) > 1


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    tokenizer, want = Tokenizer.from_file(packing.tokenizer_path()), []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, n, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], dtype="<u4").tobytes())) for n, at in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.pack(docs(spark, rows)).collect()) == sorted(want)


def test_decontamination(spark, rows):
    words = rows[0][1].split()
    items = [(1, " ".join(words[-30:])), (2, " ".join(words[10_000:10_040])), (3, " ".join(texts(1, 77))), (4, " ".join(texts(40, 78)) + " " + " ".join(words[500:560]))]
    got = {(r.id, r.item_id): (r.share, r.n_windows) for r in decontaminate.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == held_items([(i, t or "") for i, t in rows], items) and {(1, 1), (1, 2), (1, 4), (3, 2)} <= set(got)


def test_chat_of_many_turns(spark):
    turns = [(1, n, ("user", "assistant")[n % 2], f"turn {n} </s>[INST]" + " word" * (n % 7)) for n in range(120)] + [(2, 0, "assistant", " ".join(["w"] * LENGTH))]
    out = chat_format.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    examples = chat_format.examples(out)
    assert {r.conv_id: r.n for r in examples.groupBy("conv_id").agg(F.count("*").alias("n")).collect()} == {1: 60, 2: 1}
    said, loss = defaultdict(list), defaultdict(list)
    for c, _, role, t in turns:
        said[c].append((role, t))
        loss[c] += [t] if role == "assistant" else []
    got = {r.conv_id: ([tuple(t) for t in r.turns], list(r.masked)) for r in chat_format.read_back(examples).collect()}
    assert got == {c: (said[c], loss[c]) for c in said}
