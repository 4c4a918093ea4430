"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def _set_checkpoint_dir(spark: SparkSession) -> None:
    """Take the shared folder that the cluster names in ``spark.checkpoint.dir``. Only where that
    setting is absent, as in tests on one machine, take a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))


def checkpointed(frame: DataFrame) -> DataFrame:
    """Compute ``frame`` once and keep its rows in the shared checkpoint folder."""
    _set_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared checkpoint folder that nothing has been written to."""
    _set_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` as Parquet to a new folder below the shared checkpoint folder; reread it."""
    path = new_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this module named, where it is: on a cluster in the shared store."""
    if path.startswith(f"{spark.sparkContext.getCheckpointDir()}/"):
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def own_exchange(*columns: Column | str) -> Column:
    """A join key that no grouping of the same columns has been dealt by.

    The join then gets a shuffle of its own on both sides, and adaptive execution can split a hot
    key of it; a shuffle left over from a grouping can't be split.
    """
    return F.struct(*columns)


def add_columns(
    frame: DataFrame,
    source: str,
    results: str,
    prepare: Callable[[], Callable[[list[str]], Sequence[list]]],
    drop_source: bool = False,
) -> DataFrame:
    """Add columns computed from the text in ``source`` (null counts as empty), row by row.

    ``results`` is their schema, ``prepare`` makes the function from texts to one list per result
    in each task. All other columns pass through as they are; those with the names of results are
    replaced. Results leave in small batches, so that few of them are held at a time.
    """
    fields = StructType.fromDDL(results).fields
    replaced = {field.name.lower() for field in fields} | ({source.lower()} if drop_source else set())
    kept = [c for c in frame.columns if c.lower() not in replaced]
    schema = StructType([*frame.select(*kept).schema.fields, *fields])
    types = to_arrow_schema(StructType(fields)).types
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = prepare()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [text or "" for text in part.column(len(kept)).to_pylist()]
                made = [pa.array(values, kind) for values, kind in zip(compute(texts), types)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *made], names)

    return frame.select(*kept, F.col(source).alias("")).mapInArrow(run, schema)
