"""What the operators share: tables, words, and cutting lineage in the folder the cluster shares."""

from __future__ import annotations

import ctypes
import gc
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the class of white space that separates words, for Java's regular expressions.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none. Runs in the JVM."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


class Columns:
    """A caller's columns under names of our own, given0, given1, … by position, so that no name of theirs
    can clash with one that an operator works with. Those named like an output, in any case of letters,
    are left out of `back`."""

    def __init__(self, docs: DataFrame, outputs: list[str] | tuple[str, ...] = ()):
        self.names = docs.columns
        self.rows = docs.toDF(*[f"given{i}" for i in range(len(self.names))])
        replaced = {o.lower() for o in outputs}
        self.kept = [i for i, n in enumerate(self.names) if n.lower() not in replaced]

    def __getitem__(self, name: str) -> str:
        """Where the caller's column of this name is now; one that differs only in its case if none is named just so."""
        exact = [i for i, n in enumerate(self.names) if n == name] or [i for i, n in enumerate(self.names) if n.lower() == name.lower()]
        if len(exact) != 1:
            raise ValueError(f"the input needs one column {name}, not {len(exact)}")
        return f"given{exact[0]}"

    def back(self, rows: DataFrame, added: Mapping[str, Column] = {}, replaced: Mapping[str, Column] = {}) -> DataFrame:  # noqa: B006
        """rows with the caller's columns under their names again, some of them replaced, and the added ones behind them."""
        at = {self[n]: c for n, c in replaced.items()}
        given = [at.get(f"given{i}", F.col(f"given{i}")).alias(f"given{i}") for i in self.kept]
        return rows.select(*given, *added.values()).toDF(*[self.names[i] for i in self.kept], *added)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, on one machine, as in tests, a temporary one;
    on a cluster that is an error, as its machines don't see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='kinweave-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/kinweave/{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete what is under a path, wherever Spark can write."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete all that the operators of this application keep in the shared folder. Results are lazy and
    read from there, so call this when they have been written or are no longer wanted."""
    delete(spark, own_dir(spark))


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished steps now: it does so when the driver collects garbage, which a
    driver that does little else may put off for half an hour."""
    gc.collect()
    spark._jvm.System.gc()


def give_back() -> None:
    """Hand the memory that this process has freed back to the machine. A Python worker goes on to the tasks of other
    steps, and would keep what the largest of its tasks needed."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def lean(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """run, a function for mapInArrow, with its memory handed back when a task ends."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def cut(df: DataFrame) -> DataFrame:
    """Compute the rows once and keep them in the shared folder, so that a lost executor loses nothing."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def append(df: DataFrame, schema: str, make: Callable[[], Callable[[list], list]], column: str = "text", rows: int = 512) -> DataFrame:
    """df with columns of a DDL schema added, computed in Python from one column a few rows at a time.

    make() runs once in each task and returns a function from a list of values to one list or Arrow
    array for each added column. Input columns that are named like an added one are replaced; others
    keep their values, whatever their names.
    """
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    added = T.StructType.fromDDL(schema)
    given = Columns(df, added.names)
    at = given[column]
    out = T.StructType([*given.rows.schema.fields, *added.fields])
    types = [f.type for f in to_arrow_schema(added)]

    def run(batches):
        apply = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                piece = batch.slice(start, rows)
                new = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(apply(piece.column(at).to_pylist()), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*piece.columns, *new], names=[*piece.schema.names, *added.names])

    return given.back(given.rows.mapInArrow(lean(run), out), {n: F.col(n) for n in added.names})


def cut_table(df: DataFrame) -> DataFrame:
    """As `cut`, but kept as Parquet, which is smaller than a checkpoint for many narrow rows."""
    return df.sparkSession.read.schema(df.schema).parquet(cut_files(df))


def cut_files(df: DataFrame) -> str:
    """Writes the rows as Parquet and gives the folder, for tasks that go through all of it by themselves."""
    path = f"{own_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def join_hot(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int, most: int = 10_000) -> DataFrame:
    """rows with their facts, one row of facts for each key, which says in `count` how many of the `total`
    rows the key has; a key may have any part of them.

    Keys with over total / most rows are fewer than `most`, so their facts are broadcast and their rows stay
    where they are; the other rows meet their facts by key.
    """
    hot = F.col(count) > max(64, total // most)
    stay = facts.where(hot).withColumn("is_hot", F.lit(True))
    marked = rows.join(F.broadcast(stay), key, "left")
    rest = marked.where("is_hot is null").select(*rows.columns).join(facts.where(~hot), key)
    return marked.where("is_hot").drop("is_hot").unionByName(rest)


def join_salted(rows: DataFrame, facts: DataFrame, key: str, counts: DataFrame, total: int, spread: list[str], how: str = "inner", salts: int = 64, most: int = 10_000) -> DataFrame:
    """As `join_hot`, where facts are too large to be broadcast: counts are (key, n), and the rows of keys with
    over total / most rows are dealt to `salts` places by their columns `spread`, where copies of the facts are."""
    hot = F.broadcast(counts.where(F.col("n") > max(64, total // most)).select(key, F.lit(True).alias("hot")))
    salted = rows.join(hot, key, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(0)).drop("hot")
    places = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copied = facts.join(hot, key, "left").withColumn("salt", F.explode(places)).drop("hot")
    return salted.join(copied.hint("merge"), [key, "salt"], how).drop("salt")


#: Files whose names `placed` sends to all executors, some hundred bytes each.
MOST_FILES = 1 << 20


def stored(rows: DataFrame) -> DataFrame:
    """rows with a column row, a number that holds whatever the splits of a job, as they are written down first."""
    return placed(cut_table(rows))


def placed(rows: DataFrame) -> DataFrame:
    """As `stored`, but for a table of Parquet files as it was read, or some rows and columns of it, nothing is
    written: row is the file's number by name and the row's place in the file. Other rows are stored."""
    try:
        marked = rows.withColumns({"row_path": F.col("_metadata.file_path"), "row_at": F.col("_metadata.row_index")})
    except AnalysisException:
        return stored(rows)
    # This job reads no column of the files. inputFiles() wouldn't do: it writes some paths in another way.
    names = sorted(r.row_path for r in marked.select("row_path").distinct().limit(MOST_FILES + 1).collect())
    if len(names) > MOST_FILES:
        raise ValueError(f"rows of more than {MOST_FILES} files can't be told apart by place; compact them, or use stored")
    files = rows.sparkSession.createDataFrame(list(enumerate(names)), "row_file bigint, row_path string")
    # A file's number and path for each file are all that is broadcast.
    found = marked.join(F.broadcast(files), "row_path").withColumn("row", F.shiftleft("row_file", 40) + F.col("row_at"))
    return found.select("row", *rows.columns)


#: Rows of a file whose findings are kept together.
TOGETHER = 13  # as a power of two; a task holds the findings of so many


class Beside:
    """What was found out about rows, from a folder of `beside`, a part at a time; a part is what was found out
    about 8,192 rows of a file that stand together."""

    def __init__(self, uri: str):
        self.uri, self.part, self.table = uri, None, {}

    def of(self, row: int) -> dict:
        """The columns of a row's findings, by lo; nothing if there are none."""
        if row >> TOGETHER != self.part:
            from pyarrow import fs, parquet

            self.part = row >> TOGETHER
            system, path = fs.FileSystem.from_uri(f"{self.uri}/part={self.part}")
            self.table = {}
            if system.get_file_info(path).type != fs.FileType.NotFound:
                t = parquet.read_table(path, filesystem=system, partitioning=None)
                for c in t.column_names:  # a column at a time, so that the findings are not held twice
                    self.table[c], t = t.column(c).to_numpy(), t.drop_columns([c])
                of, lo = self.table["row"], self.table["lo"]
                if ((of[1:] < of[:-1]) | (of[1:] == of[:-1]) & (lo[1:] < lo[:-1])).any():  # they come from several files
                    order = np.lexsort((lo, of))
                    for c in self.table:
                        self.table[c] = self.table[c][order]
        if not self.table:
            return {}
        a, b = self.table["row"].searchsorted([row, row + 1])
        return {c: x[a:b] for c, x in self.table.items()} if b > a else {}


def beside(rows: DataFrame) -> str:
    """Writes rows (row, lo, …) down for tasks that read the texts again: texts never move to meet them."""
    uri = f"{own_dir(rows.sparkSession)}/beside/{uuid.uuid4().hex}"
    laid = rows.withColumn("part", F.shiftright("row", TOGETHER)).repartition("part")
    # The writer sorts by part anyway; sorted further, a part needs no sorting where it is read.
    laid.sortWithinPartitions("part", "row", "lo").write.partitionBy("part").parquet(uri)
    return uri


def by_range(rows: DataFrame, finish, schema: str) -> DataFrame:
    """One row finish(range, blocks), as a dict, for each range of rows (range, block).

    finish gets the blocks as an iterator, so that it can fold them without holding all of them.
    """

    def run(batches):
        import pyarrow as pa

        def pairs():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("range", "block")), strict=True)

        for r, group in itertools.groupby(pairs(), key=lambda x: x[0]):
            yield pa.RecordBatch.from_pylist([finish(r, (b for _, b in group))])

    return rows.repartition("range").sortWithinPartitions("range").mapInArrow(run, schema)
