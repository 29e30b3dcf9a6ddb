"""Stored tables that change in one step.

Rows lie in folders below `_rows`, one per part (a year, a region of space) or one for all.
`_states` holds numbered files, each a list of the folders that make up the table. A change writes
its rows beside the others and then renames one new state into place. The rename fails where
another writer has taken the number, so readers see the state before or the one after, a write
that fails changes nothing, and a table may be read, merged and written again under one path.

Folders that no state needs any more are deleted by `clean`, never by a write.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, replace
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROWS, STATES, WHOLE = "_rows", "_states", "whole"


class ChangedMeanwhile(RuntimeError):
    """Another writer has changed the table since its state was read."""


@dataclass(frozen=True)
class State:
    """What a table consists of: its number, schema and folder by part."""

    number: int
    schema: str
    folders: dict[str, str]


def _part_name(value) -> str:
    """How Spark names the folder of a part."""
    return "__HIVE_DEFAULT_PARTITION__" if value in (None, "") else str(value)


def hadoop_path(spark: SparkSession, *names: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(names))


def file_system(spark: SparkSession, path: str):
    return hadoop_path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    files, place = file_system(spark, folder), hadoop_path(spark, folder)
    if not files.exists(place):
        return []
    return [entry.getPath().getName() for entry in files.listStatus(place)]


def _read(spark: SparkSession, path: str) -> str:
    stream = file_system(spark, path).open(hadoop_path(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def current(spark: SparkSession, path: str) -> State | None:
    """The table's latest state; None where there is no table."""
    numbers = [int(x) for x in _names(spark, f"{path}/{STATES}") if x.isdigit()]
    if not numbers:
        return None
    return State(max(numbers), **json.loads(_read(spark, f"{path}/{STATES}/{max(numbers):012d}")))


def _switch(spark: SparkSession, path: str, state: State) -> None:
    """Make the state the latest one by a rename that fails where its number is taken."""
    text = json.dumps({"schema": state.schema, "folders": state.folders})
    draft = f"{path}/{STATES}/.{uuid.uuid4().hex}"
    stream = file_system(spark, path).create(hadoop_path(spark, draft))
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    place = hadoop_path(spark, f"{path}/{STATES}/{state.number:012d}")
    draft_path = hadoop_path(spark, draft)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        draft_path.toUri(), spark._jsc.hadoopConfiguration()
    )
    option = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    try:
        context.rename(draft_path, place, spark._sc._gateway.new_array(option, 0))
    except Py4JJavaError as failed:
        context.delete(draft_path, False)
        if "FileAlreadyExistsException" in str(failed.java_exception.getClass().getName()):
            raise ChangedMeanwhile(path) from None
        raise


def _write_beside(frame: DataFrame, path: str, part: Column | None, order: tuple[str, ...],
                  ) -> dict[str, str]:
    """Write the rows to folders that no state names yet; the folder of each part.

    With `order` files are split by range and sorted, so that a part that holds much of the rows
    takes several files, each with a narrow range for pruning.
    """
    spark, folder = frame.sparkSession, f"{ROWS}/{uuid.uuid4().hex}"
    keys = (*(("_part",) if part is not None else ()), *order)
    rows = frame if part is None else frame.withColumn("_part", part)
    if order:
        rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    if part is None:
        rows.write.parquet(f"{path}/{folder}")
        return {WHOLE: folder}
    rows.write.partitionBy("_part").parquet(f"{path}/{folder}")
    names = [x for x in _names(spark, f"{path}/{folder}") if x.startswith("_part=")]
    return {unquote(x.removeprefix("_part=")): f"{folder}/{x}" for x in names}


def refresh(frame: DataFrame, path: str, part: Column | None = None, order: tuple[str, ...] = (),
            ) -> None:
    """Replace the whole table. `part` cuts it, so that parts can be replaced later."""
    spark = frame.sparkSession
    before = current(spark, path)
    folders = _write_beside(frame, path, part, order)
    number = before.number + 1 if before else 1
    _switch(spark, path, State(number, frame.schema.json(), folders))


def replace_parts(frame: DataFrame, path: str, part: Column, touched: Iterable, since: State,
                  order: tuple[str, ...] = ()) -> None:
    """Replace the touched parts by the frame's rows; other parts keep their folders.

    `since` is the state the frame was made from: a table changed after it is not overwritten. A
    touched part without rows is gone.
    """
    folders = _write_beside(frame, path, part, order)
    names = set(map(_part_name, touched))
    if not folders.keys() <= names:
        raise ValueError(f"rows of parts that are not replaced: {sorted(folders.keys() - names)}")
    kept = {name: folder for name, folder in since.folders.items() if name not in names}
    state = replace(since, number=since.number + 1, folders=kept | folders)
    _switch(frame.sparkSession, path, state)


def append(frame: DataFrame, path: str, since: State | None) -> None:
    """Add rows as a part of their own, if the table is still in the state they were made from."""
    folder = _write_beside(frame, path, None, ())[WHOLE]
    known = since.folders if since else {}
    number = since.number + 1 if since else 1
    state = State(number, frame.schema.json(), known | {folder.rsplit("/", 1)[1]: folder})
    _switch(frame.sparkSession, path, state)


def read(spark: SparkSession, path: str, state: State, parts: Iterable | None = None) -> DataFrame:
    """The rows of a state, or of some of its parts; parts it lacks have no rows."""
    schema = StructType.fromJson(json.loads(state.schema))
    names = state.folders if parts is None else set(map(_part_name, parts))
    folders = [f"{path}/{folder}" for name, folder in state.folders.items() if name in names]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def clean(spark: SparkSession, path: str) -> None:
    """Delete earlier states and the folders only they need. No reader may still use them."""
    latest = current(spark, path)
    if latest is None:
        return
    files = file_system(spark, path)
    for name in _names(spark, f"{path}/{STATES}"):
        if name.isdigit() and int(name) < latest.number:
            files.delete(hadoop_path(spark, path, STATES, name), False)
    used = set(latest.folders.values())
    for batch in _names(spark, f"{path}/{ROWS}"):
        folder = f"{ROWS}/{batch}"
        if folder in used:
            continue
        inner = [f"{folder}/{x}" for x in _names(spark, f"{path}/{folder}")]
        if not used.intersection(inner):
            files.delete(hadoop_path(spark, path, folder), True)
            continue
        for place in inner:
            if place not in used and "=" in place:
                files.delete(hadoop_path(spark, path, place), True)
