"""The shared folder for what an operator must write: checkpoints and files that other executors read."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession

from kinweave.sources.tables import keep, new_dir, shared_dir

__all__ = ["documents", "keep", "new_dir", "put_bytes", "shared_dir"]


def put_bytes(uri: str, name: str, content: bytes, attempt: str) -> None:
    """Writes a file under its final name in one step, so that a repeated or lost task leaves no half of it."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    part = f"{path}/_part-{attempt}-{name}"
    with system.open_output_stream(part) as out:
        out.write(content)
    with contextlib.suppress(OSError):
        if system.get_file_info(f"{path}/{name}").type == fs.FileType.File:
            system.delete_file(f"{path}/{name}")
    system.move(part, f"{path}/{name}")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))
