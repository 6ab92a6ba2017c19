"""Tables of vectors that grow by commits: no append is seen in part, lost or made twice.

A table is a folder of parts, one an append, and a folder of commits, one small
JSON file a generation.  An append writes its part under a name of its own,
with ids from 0, and then claims the next generation: a file that can be made
once only.  The commit says which id the part begins with, so a writer that
was overtaken claims the generation after it without writing its rows again.
Readers take the parts that are committed, as of any generation.

A claim is a rename that doesn't overwrite.  It is atomic on HDFS and on stores
with conditional renames; a local disk checks and renames in two steps.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoscan.operators.ranks import dense_ids

#: What a commit holds; ``rows`` ids from ``first_id`` on are those of ``part``.
COMMIT = "generation long, part string, first_id long, rows long, token string"
#: Claims that are tried before an append gives up; each lost one is another writer's commit.
TRIES = 100


def commits(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """The table's commits, as COMMIT, up to a generation; none where there is no table."""
    try:
        found = spark.read.schema(COMMIT).json(f"{path}/commits")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = spark.createDataFrame([], COMMIT)
    return found if generation is None else found.where(F.col("generation") <= generation)


def _claim(spark: SparkSession, path: str, commit: dict) -> bool:
    """Make the commit's file, or say that its generation is taken."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    conf = spark._jsc.hadoopConfiguration()
    files = folder.getFileSystem(conf)
    files.mkdirs(folder)
    draft = jvm.org.apache.hadoop.fs.Path(folder, f"_{uuid.uuid4().hex}")  # readers skip such names
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(commit).encode()))
    out.close()
    to = jvm.org.apache.hadoop.fs.Path(folder, f"{commit['generation']:019d}.json")
    keep = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(folder).toUri(), conf)
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(to), keep)
    except Exception as e:
        if "FileAlreadyExistsException" not in str(e):
            raise
        files.delete(draft, False)
        return False
    return True


def _made(spark: SparkSession, path: str, token: str | None) -> int | None:
    """The generation that an append with this token has made."""
    if token is None:
        return None
    row = commits(spark, path).where(F.col("token") == token).select("generation").first()
    return row[0] if row else None


def append(spark: SparkSession, path: str, rows: DataFrame, order: list[str], token: str | None = None) -> int:
    """Append ``rows`` with ids that go on after the last one, in the given order; returns the generation.

    All columns are kept but record_id, which is the table's.  An append whose
    ``token`` is committed already does nothing and returns that generation, so
    one that may have failed can be tried again.  A part that was never
    committed is never read.  An empty append is a generation too.
    """
    done = _made(spark, path, token)
    if done is not None:
        return done
    part = f"p-{uuid.uuid4().hex}"
    folder = f"{path}/data/part={part}"
    dense_ids(rows.drop("record_id"), order).withColumnRenamed("record_id", "nth").write.parquet(folder)
    n = spark.read.parquet(folder).count()  # from the footers
    for _ in range(TRIES):
        done = _made(spark, path, token)
        if done is not None:
            return done
        last = commits(spark, path).agg(F.max("generation"), F.max(F.col("first_id") + F.col("rows"))).first()
        commit = {"generation": (last[0] or 0) + 1, "part": part, "first_id": last[1] or 0, "rows": n, "token": token}
        if _claim(spark, path, commit):
            return commit["generation"]
    raise RuntimeError(f"other writers took {TRIES} generations of {path}; {folder} is not committed")


def read(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """record_id and the other columns of all rows committed up to ``generation``, or up to now.

    The commits, a row an append, are joined with the parts they name; Spark
    prunes the others from the scan.
    """
    held = commits(spark, path, generation).select(F.col("part").alias("_part"), "first_id")
    rows = spark.read.parquet(f"{path}/data")
    columns = [c for c in rows.columns if c not in ("nth", "part")]
    return rows.join(F.broadcast(held), rows["part"] == held["_part"]).select((F.col("first_id") + F.col("nth")).alias("record_id"), *[F.col(f"`{c}`") for c in columns])


def lookup(spark: SparkSession, path: str, record_id: int, generation: int | None = None) -> DataFrame:
    """The row with this id, or none: the commits name its part, and the id's place in it reaches the scan."""
    found = commits(spark, path, generation).where((F.col("first_id") <= record_id) & (record_id < F.col("first_id") + F.col("rows"))).first()  # one at most
    if found is None:
        return read(spark, path, generation).where("false")
    part = spark.read.parquet(f"{path}/data/part={found['part']}").where(F.col("nth") == record_id - found["first_id"])
    return part.select(F.lit(record_id).cast("long").alias("record_id"), *[F.col(f"`{c}`") for c in part.columns if c != "nth"])
