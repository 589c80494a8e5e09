"""Files of any size, read where tasks run."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Bytes of a file that are in memory at a time.
PIECE = 1 << 20


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path in it."""
    local = re.fullmatch(r"(?:file:/*(?=/))?(/.*)", path)
    return (fs.LocalFileSystem(), local.group(1)) if local else fs.FileSystem.from_uri(quote(path, safe=":/?&=@%"))


def sha256_of(path: str | None) -> str:
    if path is None:
        return "missing"
    folder, name = open_folder(path)
    if folder.get_file_info(name).type != fs.FileType.File:
        return "missing"
    digest = hashlib.sha256()
    with folder.open_input_stream(name) as stream:
        while piece := stream.read(PIECE):
            digest.update(piece)
    return digest.hexdigest()


def with_file_hash(rows: DataFrame, path_col: str, name: str = "sha256") -> DataFrame:
    """Add the SHA-256 of the file that each row names, empty files included; "missing" where there is none or no path.

    Files are read in pieces where the tasks run and are never a value of a row, so they may be of
    any size. A path that many rows name should come once.
    """
    base = rows.drop(name)
    at = base.columns.index(path_col)
    schema = StructType([*base.schema.fields, StructField(name, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = pa.array([sha256_of(p) for p in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, digests], names=schema.names)

    return base.mapInArrow(run, schema)


def file_fingerprints(spark: SparkSession, path: str, recursive: bool = True, tasks: int | None = None) -> DataFrame:
    """``(path, length, sha256)`` of the files under ``path`` (S14), dealt to ``tasks`` tasks, by default as many as shuffles have.

    Spark lists the files and leaves out empty ones; ``with_file_hash`` knows those too.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length")
    return with_file_hash(files.repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))), "path")


def write_texts(rows: DataFrame, root: str, name: str, order: str, text: str) -> None:
    """Write the ``text`` of all rows with one ``name`` as lines of one file under ``root``, in ``order``, where tasks run.

    A file is written under another name, which Spark does not list, and then renamed, so a repeated task replaces
    what it wrote before. All files lie in one folder: nothing is committed or listed file by file on the driver.
    """
    folder, top = open_folder(root)
    folder.create_dir(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = open_folder(root)
        own, current, stream = f"{base}/_{uuid.uuid4().hex}", None, None
        for batch in batches:
            for file, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if stream is None or file != current:
                    if stream is not None:
                        stream.close()
                        target.move(own, f"{base}/{current}")
                    current, stream = file, target.open_output_stream(own)
                stream.write(f"{line}\n".encode())
        if stream is not None:
            stream.close()
            target.move(own, f"{base}/{current}")
            yield pa.RecordBatch.from_arrays([pa.array([True])], names=["done"])

    sorted_rows = rows.select(F.col(name).cast("string").alias("__f"), F.coalesce(text, F.lit("")).alias("__t"), order).repartition("__f")
    sorted_rows.sortWithinPartitions("__f", order).select("__f", "__t").mapInArrow(run, "done boolean").write.format("noop").mode("overwrite").save()
