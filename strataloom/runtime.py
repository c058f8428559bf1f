"""Session helpers: reading tables, cutting lineage, mapping Arrow batches.

Lineage is cut only with ``checkpoint()`` into the shared folder that the
session names in ``spark.checkpoint.dir``; a folder of our own is used only
where that setting is absent in a local session, as in tests.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that a Python worker turns into one outgoing Arrow batch.
BATCH_ROWS = 4096


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers of the application, once; they need no path to it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    here = Path(__file__).resolve().parent
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="strataloom-")) / "strataloom"), "zip", here.parent, here.name)
    context.addPyFile(archive)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One input table; a single file and a folder of parts read alike."""
    ship(spark)
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints, taken from the session.

    Only a session on one machine may leave it unset, as tests do; elsewhere a folder of one machine would be lost with it, so that is refused.
    """
    jsc = spark.sparkContext._jsc.sc()
    held = jsc.getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="strataloom-ckpt-"))
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and return a frame that reads it back."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def map_records(
    df: DataFrame,
    schema: str | T.StructType,
    make: Callable[[], Callable[[tuple], Iterable[tuple]]],
    barrier_rows: int = BATCH_ROWS,
) -> DataFrame:
    """Apply a record-wise generator to ``df`` in Arrow batches.

    ``make`` runs once in each task and returns the function that turns one
    input tuple into output tuples, so automata and tokenizers are built once.
    Output leaves in batches of at most ``barrier_rows`` rows: memory doesn't
    depend on the size of a partition.
    """
    out = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        act = make()
        held: list[tuple] = []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for record in zip(*columns):
                held.extend(act(record))
                if len(held) >= barrier_rows:
                    yield as_batch(held, arrow)
                    held = []
        if held:
            yield as_batch(held, arrow)

    return df.mapInArrow(run, out)


def spread(scan: DataFrame) -> DataFrame:
    """A scan whose files give fewer parts than half the cores, spread over all cores; others stay as they are.

    A file of one row group can't be split, and a heavy pass over it would run in one task. Only for plain scans: asking for
    the number of parts runs no job there.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() * 2 <= cores else scan


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Tuples to one record batch of ``schema``."""
    columns = zip(*rows) if rows else ([] for _ in schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, schema)], schema=schema)
