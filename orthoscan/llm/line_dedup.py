"""Line dedup: lines that many documents repeat stay in the last one only.

Lines become 128-bit hashes.  They are range-partitioned by hash and document
and sorted by hash, document (last first) and position within a partition, so
a hash that a third of all lines have is a run over many partitions and no
task's burden.  A window over that order streams each partition and marks the
first occurrence of a hash in a document; it needs no exchange and no sort
beside the ranged one.  First occurrences are counted per hash and partition,
the few rows of a hash are combined, and what comes back to the runs is the
document whose line stays, the first one of all.  There is one path, whatever
the size of a run.

What comes out is a compressed keep bitmap per document, as runs of kept
lines; text is only cut when a bitmap is applied, and only texts that may have
one are shuffled to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orthoscan.llm.common import SPACES, ascii_lower, stored, table

#: A line counts from this many code points on, and is dropped if so many documents hold it.
MIN_CHARS, MIN_DOCS = 40, 5
#: Stands for a null doc_id, which sorts before all others.
NO_ID = -(1 << 63)
#: Bits that tell texts without a keep bitmap before they are shuffled: 1024 rows of 4 kB.
SIEVE_BITS = 1 << 25


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id")


def _text_key() -> Column:
    """Tells rows apart that share a doc_id; equal texts have equal bitmaps."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key")


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n")


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row per line of at least ``min_chars``: id, text_key, pos, hash (16 bytes)."""
    trimmed = F.btrim(F.col("line"), F.lit(SPACES))
    lines = docs.select(_id(), _text_key(), F.posexplode(_lines()).alias("pos", "line")).withColumn("line", trimmed)
    return lines.where(F.char_length("line") >= min_chars).select("id", "text_key", "pos", F.unhex(F.md5(ascii_lower(F.col("line")))).alias("hash"))


def first_occurrences(hashes: DataFrame) -> DataFrame:
    """``hashes`` by ranges of hash and document, last document first, with ``first``: a document's first line of a hash.

    ``behind`` is the document's place in that order, ascending.  A document's
    lines of one hash are in one range, so the window needs no other exchange.
    """
    ranged = hashes.withColumn("behind", F.bitwise_not("id")).repartitionByRange("hash", "behind").sortWithinPartitions("hash", "behind", "pos")
    return ranged.withColumn("first", F.row_number().over(Window.partitionBy("hash", "behind").orderBy("pos")) == 1)


def sorted_lines(hashes: DataFrame) -> DataFrame:
    """``first_occurrences``, written, with ``part``: the range's number."""
    return stored(first_occurrences(hashes).withColumn("part", F.spark_partition_id()), "line-sorted")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Bitmaps of the documents that lose lines: id, text_key, n_dropped, keep_runs, tail_from.

    ``keep_runs`` are the runs of kept lines before the last dropped line, as
    (start, len) from 0; all lines from ``tail_from`` on are kept.  Documents
    without a row keep every line.
    """
    rows = sorted_lines(stored(line_hashes(docs, min_chars), "line-hashes"))
    runs = stored(rows.where("first").groupBy("hash", "part").agg(F.count("*").alias("docs"), F.min("behind").alias("ahead")), "line-runs")
    repeated = runs.groupBy("hash").agg(F.sum("docs").alias("docs"), F.min("ahead").alias("ahead")).where(F.col("docs") >= min_docs).select("hash", "ahead")
    decided = stored(runs.select("hash", "part").join(stored(repeated, "line-repeated"), "hash"), "line-decided")  # as many rows of a hash as partitions hold it
    gone = rows.join(decided, ["hash", "part"]).where(F.col("behind") > F.col("ahead")).groupBy("id", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    before = lambda p, i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("gone"), i - 1) + 1)
    runs = F.transform("gone", lambda p, i: F.struct(before(p, i).alias("start"), (p - before(p, i)).alias("len")))
    return gone.select("id", "text_key", F.size("gone").cast("long").alias("n_dropped"), F.filter(runs, lambda r: r["len"] > 0).alias("keep_runs"), (F.element_at("gone", -1) + 1).alias("tail_from"))


def _bit() -> Column:
    """A document's bit of the sieve, from 1."""
    return F.pmod(F.xxhash64("id", "text_key"), F.lit(SIEVE_BITS)) + 1


def _sieved(keyed: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``keyed`` with ``maybe``: false for documents that have no bitmap for sure."""
    sieve = bitmaps.groupBy(F.bitmap_bucket_number(_bit()).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(_bit())).alias("bits"))
    rows = keyed.withColumn("bit", _bit()).join(F.broadcast(sieve), F.bitmap_bucket_number("bit") == F.col("bucket"), "left")
    octet = F.conv(F.hex(F.expr("substring(bits, int(bitmap_bit_position(bit) div 8) + 1, 1)")), 16, 10).cast("int").alias("octet")
    rows = rows.select(*keyed.columns, octet, (F.bitmap_bit_position("bit") % 8).cast("int").alias("at"))
    return rows.select(*keyed.columns, F.coalesce(F.expr("shiftright(octet, at) & 1") == 1, F.lit(False)).alias("maybe"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """row (a struct of all columns of ``docs``, with the kept lines as text), n_lines and n_dropped (long)."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # out of the way of the names used here
    keyed = _sieved(docs.select(row, _id(), _text_key()), bitmaps)
    held = bitmaps.select("id", "text_key", F.struct("n_dropped", "keep_runs", "tail_from").alias("bitmap"))
    whole = keyed.where(~F.col("maybe")).withColumn("bitmap", F.lit(None).cast(held.schema["bitmap"].dataType))
    rows = keyed.where("maybe").join(held, ["id", "text_key"], "left").unionByName(whole)
    lines = F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n")
    slices = F.transform("bitmap.keep_runs", lambda r: F.slice(lines, r["start"] + 1, r["len"]))
    kept = F.concat(F.flatten(slices), F.slice(lines, F.col("bitmap.tail_from") + 1, F.size(lines)))
    text = F.when(F.col("bitmap").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return rows.select(F.col("row").withField("text", text).alias("row"), F.size(lines).cast("long").alias("n_lines"), F.coalesce("bitmap.n_dropped", F.lit(0).cast("long")).alias("n_dropped"))


def dedup_rows(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """As ``line_dedup``, with the columns of ``docs`` in the struct ``row``, beside n_lines and n_dropped."""
    return apply_bitmaps(docs, stored(keep_bitmaps(docs, min_chars, min_docs), "line-bitmaps"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` without the repeated lines, plus _n_lines and _n_dropped.

    Lines are split at \\n; a null or empty text is one empty line, and a null
    text stays null.  A line's key is the line stripped of [\\x20\\x09-\\x0D]
    with A-Z lower-cased.  Keys of ``min_chars`` code points held by
    ``min_docs`` different doc_ids lose all lines except those of the largest
    doc_id.  Rows that share a doc_id are one document in that count, and each
    keeps its own row; a null doc_id is one document below all others.  All
    other columns pass through, whatever their names; columns _n_lines and
    _n_dropped of ``docs`` are replaced.  An empty table gives no row.
    """
    new = {"_n_lines": F.col("n_lines"), "_n_dropped": F.col("n_dropped")}
    passed = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in new]
    return dedup_rows(docs, min_chars, min_docs).select(*passed, *[v.alias(c) for c, v in new.items()])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP2_SQL = """
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM s),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last_id AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
