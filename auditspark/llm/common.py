"""Small shared pieces: reading the tables, columns every operator needs, Arrow mapping."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.session import ensure_checkpoint_dir, ship_package

#: Fixed by the contracts: words are runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """*df* written as Parquet beside the checkpoints and read again: cuts lineage like a checkpoint, in less room."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def lower_ascii(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str,
                setup: Callable[[], object] | None = None) -> DataFrame:
    """Apply *fn* to every Arrow batch of *df*; *setup* runs once per task and is passed on as a second argument."""
    ship_package(df.sparkSession)

    def run(batches):
        state = (setup(),) if setup else ()
        for batch in batches:
            if batch.num_rows:
                out = fn(batch, *state)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
