"""Column builders for names, labels, media addresses and page arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE_BYTES = 4096
#: Seconds of audio in a numbered segment.
SEGMENT_SECONDS = 3


def genre(filename: Column) -> Column:
    """The text before the first dot; "unknown" for an empty name."""
    return F.when(F.coalesce(filename, F.lit("")) == "", "unknown").otherwise(F.split_part(filename, F.lit("."), F.lit(1)))


def audio_url(filename: Column) -> Column:
    """/audio/genre/name.wav, with #t=from,to for the numbered segment of a three-part name.

    A segment that isn't a whole number, and names with other numbers of
    parts, give an address without fragment.
    """
    bare = F.regexp_replace(filename, r"\.wav$", "")
    parts = F.split(bare, r"\.")
    segment = F.get(parts, 2).try_cast("int")
    whole = F.concat(F.lit("/audio/"), genre(filename), F.lit("/"), F.concat_ws(".", F.slice(parts, 1, 2)), F.lit(".wav"))
    start = segment * SEGMENT_SECONDS
    cut = F.concat(whole, F.lit("#t="), start.cast("string"), F.lit(","), (start + SEGMENT_SECONDS).cast("string"))
    plain = F.concat(F.lit("/audio/"), genre(filename), F.lit("/"), bare, F.lit(".wav"))
    return F.when(F.size(parts) == 3, F.coalesce(cut, whole)).otherwise(plain)


def image_url(path: Column, root: str) -> Column:
    """/images/ and the path below ``root``, with forward slashes; null outside of it."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    below = F.lit(root.rstrip("/") + "/")
    return F.when(F.startswith(clean, below) & ~F.contains(clean, F.lit("..")), F.concat(F.lit("/images/"), F.substr(clean, F.length(below) + 1)))


def clean_label(label: Column) -> Column:
    """What follows the first dash, with spaces for underscores."""
    return F.replace(F.regexp_replace(label, "^[^-]*-", ""), F.lit("_"), F.lit(" "))


def valid_record_text(text: Column) -> Column:
    """A record id written as text: digits only, white space around allowed."""
    return F.rlike(F.trim(text), F.lit("^[0-9]+$"))


def speedup(linear_us: Column, index_us: Column) -> Column:
    """linear / index to two places; 0 where the index took no time."""
    return F.when(index_us > 0, F.round(linear_us / index_us, 2)).otherwise(F.lit(0.0))


def winner(kd_us: Column, rt_us: Column, linear_us: Column) -> Column:
    """The fastest method; on ties KD-tree, then R-tree, then linear.  Null and 0 don't count."""
    named = [(F.when(c > 0, c), n) for c, n in ((kd_us, "KD-tree"), (rt_us, "R-tree"), (linear_us, "linear"))]
    best = F.least(*[c for c, _ in named])
    out = F.lit(None).cast("string")
    for c, n in reversed(named):
        out = F.when(c == best, n).otherwise(out)
    return out


def records_per_page(dims: Column) -> Column:
    return F.floor((F.lit(PAGE_BYTES) - 4) / (dims * 4)).cast("int")


def page_of(record_id: Column, dims: Column) -> Column:
    """Pages count from 1; page 0 is the header."""
    return (F.floor(record_id / records_per_page(dims)) + 1).cast("long")


def slot_of(record_id: Column, dims: Column) -> Column:
    return (record_id % records_per_page(dims)).cast("long")


def node_capacity(dims: Column) -> Column:
    """Entries of a tree node that fits a page."""
    return F.floor((F.lit(PAGE_BYTES) - 8) / (8 * dims + 4)).cast("int")


def node_minimum(dims: Column) -> Column:
    """Two fifths of the capacity, one at least."""
    return F.greatest(F.lit(1), F.floor(node_capacity(dims) * 2 / 5).cast("int"))
