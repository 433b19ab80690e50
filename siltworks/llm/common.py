"""What the operators of this subpackage share: tables in the shared folder, files of workers, fresh names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..tables import materialise, shared_path, shared_root  # noqa: F401


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has (columns differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def open_fs(uri: str):
    """pyarrow's file system and the path in it; file, hdfs, s3 and gs are known to pyarrow."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Published:
    """A file that appears under its name when it is complete. A task that runs again, or twice at once,
    writes the same bytes under a temporary name of its own and moves them into place."""

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.sink = self.fs.open_output_stream(self.part, compression=None)

    def __enter__(self):
        return self

    def __exit__(self, kind, *_):
        self.sink.close()
        if kind is None:
            self.fs.move(self.part, self.path)
        else:
            self.fs.delete_file(self.part)
