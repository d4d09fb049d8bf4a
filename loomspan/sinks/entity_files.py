"""A sink for one file a row: ``df.write.format("entity_files").mode("append").save(path)``.

Rows are (file, text).  Every write is a version of its own, a folder below ``path``, which all its
tasks write to; the commit makes it the current one by creating an empty pointer file
(:mod:`loomspan.sinks.versions`), an abort deletes it.  So readers see all files of a write or
none of them, and no list of files passes through the driver.  A file is written under another name
and renamed; a task that runs again writes the same files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .versions import POINTERS

NAME = "entity_files"


@dataclass
class Written(WriterCommitMessage):
    """What a task has written."""

    files: int
    bytes: int


class EntityWriter(DataSourceArrowWriter):
    """Writes the files of one version."""

    def __init__(self, path: str, columns: list[str]):
        import uuid

        self.path, self.columns, self.version = path.rstrip("/"), columns, f"v-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(f"{self.path}/{self.version}")
        store.create_dir(root, recursive=True)
        files = size = 0
        for batch in iterator:
            file, text = (batch.column(self.columns.index(c)) for c in ("file", "text"))
            for at in range(0, batch.num_rows, 400):
                for name, body in zip(file.slice(at, 400).to_pylist(), text.slice(at, 400).to_pylist(), strict=True):
                    if not name or "/" in name or name.startswith(("_", ".")):
                        raise ValueError(f"{name!r} is no file name")
                    data, part = (body or "").encode("utf-8"), f"{root}/_{uuid.uuid4().hex}"
                    with store.open_output_stream(part, compression=None) as out:
                        out.write(data)
                    store.move(part, f"{root}/{name}")
                    files, size = files + 1, size + len(data)
        return Written(files, size)

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        pointers = f"{root}/{POINTERS}"
        store.create_dir(f"{root}/{self.version}", recursive=True)  # a write without rows has files too: none
        store.create_dir(pointers, recursive=True)
        found = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(pointers)))
        number = int(found[-1].split(".", 1)[0]) + 1 if found else 1
        store.open_output_stream(f"{pointers}/{number:012d}.{self.version}", compression=None).close()

    def abort(self, messages) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(f"{self.path}/{self.version}")
        if store.get_file_info(root).type != fs.FileType.NotFound:
            store.delete_dir(root)


class EntityFiles(DataSource):
    """The sink ``entity_files``; columns ``file`` and ``text``, strings."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> EntityWriter:
        columns = [f.name for f in schema.fields]
        if not {"file", "text"} <= set(columns):
            raise ValueError(f"{NAME} needs the columns file and text")
        return EntityWriter(self.options["path"], columns)


def register(spark: SparkSession) -> None:
    """Make the sink known to the session."""
    spark.dataSource.register(EntityFiles)
