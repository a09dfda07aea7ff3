"""Words, keys and durable intermediate tables shared by the document operators.

A document is a row of (doc_id, text, ...). Rows with the same doc_id and the same text are one
document to every operator: they get the same result. Nothing here reads row positions, so
results do not depend on how Spark splits or orders the input.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Array of the maximal runs of non-space characters; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def n_words(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.size(words(text)).cast("long")


def doc_keys(id_col: Column, text: Column) -> list[Column]:
    """A 128-bit identity of a document, (id, text), never null."""
    return [F.xxhash64(F.lit(1), id_col, text), F.xxhash64(F.lit(2), text, id_col)]


def text_key(text: Column, name: str) -> list[Column]:
    """Two 64-bit hashes of a text, never null: a 128-bit identity of the text."""
    return [F.xxhash64(F.lit(1), text).alias(f"{name}1"), F.xxhash64(text, F.lit(2)).alias(f"{name}2")]


def uniform(*parts) -> Column:
    """A draw in [0, 1) fixed by the values of ``parts``."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)) / F.lit(float(1 << 53))


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, named by ``spark.checkpoint.dir``.

    One is made only where none is named and Spark runs in one process.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="riskframe-checkpoint-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors without computing ``df`` again, and
    the planner knows its size. The table stays until the folder is cleaned.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_groups(parts: Iterator[pd.DataFrame], keys: list[str], rows: int) -> Iterator[pd.DataFrame]:
    """Batches ordered by ``keys`` put together to frames of at least ``rows`` rows that end with a group."""
    held: list[pd.DataFrame] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= rows:
            every = pd.concat(held, ignore_index=True)
            same = np.ones(len(every), bool)
            for k in keys:
                same &= (every[k] == every[k].iloc[-1]).to_numpy()
            cut = int(np.argmax(same))  # the last group may go on
            held, size = [every.iloc[cut:]], len(every) - cut
            if cut:
                yield every.iloc[:cut].reset_index(drop=True)
    if size:
        yield pd.concat(held, ignore_index=True)


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not have, made from the wanted ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
