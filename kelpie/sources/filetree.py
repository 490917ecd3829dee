"""A sink of one file a row: format "file_tree", for rows of (path, content).

Tasks write below `_staging` of the target, each attempt in a folder of its own; what a failed or speculative attempt
leaves is never named. The commit of a batch writes a journal of what is to be moved, then moves it: from the journal on
a batch is done, and finish() completes moves that a dying driver left. Two rows of one path, paths that lead outside
the target and, unless it is to be overwritten, paths that exist are refused, and nothing of the batch appears.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from kelpie.sources.watched import _open

STAGING = "_staging"


@dataclass
class _Staged(WriterCommitMessage):
    """Where an attempt wrote, and the paths."""

    folder: str
    paths: list


def _inside(path):
    clean = posixpath.normpath(path or "")
    if clean.startswith(("/", "..", STAGING)) or clean in ("", "."):
        raise ValueError(f"not a path below the target: {path!r}")
    return clean


class _Writer(DataSourceWriter):
    def __init__(self, root, overwrite, replace):
        self.root, self.overwrite, self.replace, self.batch = root, overwrite, replace, uuid.uuid4().hex

    def write(self, iterator):
        system, root = _open(self.root)
        folder, paths = f"{root}/{STAGING}/{self.batch}/{uuid.uuid4().hex}", set()
        for row in iterator:
            path = _inside(row["path"])
            if path in paths:
                raise ValueError(f"two rows of one path: {path}")
            paths.add(path)
            system.create_dir(posixpath.dirname(f"{folder}/{path}"), recursive=True)
            with system.open_output_stream(f"{folder}/{path}") as f:
                f.write((row["content"] or "").encode())
        return _Staged(folder, sorted(paths))

    def commit(self, messages):
        from pyarrow import fs

        system, root = _open(self.root)
        moves = [(f"{m.folder}/{p}", f"{root}/{p}") for m in messages if m is not None for p in m.paths]
        seen = set()
        for _, to in moves:
            if to in seen:
                self.abort(messages)
                raise ValueError(f"two rows of one path: {to}")
            seen.add(to)
            if not self.replace and not self.overwrite and system.get_file_info(to).type != fs.FileType.NotFound:
                self.abort(messages)
                raise ValueError(f"path exists: {to}")
        system.create_dir(f"{root}/{STAGING}/{self.batch}", recursive=True)
        part = f"{root}/{STAGING}/{self.batch}/journal"
        with system.open_output_stream(f"{part}.part") as f:
            f.write(json.dumps(moves).encode())
        system.move(f"{part}.part", part)
        finish(self.root)

    def abort(self, messages):
        from pyarrow import fs

        system, root = _open(self.root)
        at = f"{root}/{STAGING}/{self.batch}"
        if system.get_file_info(at).type != fs.FileType.NotFound:
            system.delete_dir(at)


def finish(root):
    """Complete the moves of every batch that has a journal; run it before reading where a driver may have died."""
    from pyarrow import fs

    system, base = _open(root)
    for info in system.get_file_info(fs.FileSelector(f"{base}/{STAGING}", allow_not_found=True)):
        if system.get_file_info(f"{info.path}/journal").type == fs.FileType.NotFound:
            continue
        with system.open_input_stream(f"{info.path}/journal") as f:
            moves = json.loads(f.read())
        for at, to in moves:
            if system.get_file_info(at).type != fs.FileType.NotFound:
                system.create_dir(posixpath.dirname(to), recursive=True)
                system.move(at, to)
        system.delete_dir(info.path)


class FileTree(DataSource):
    @classmethod
    def name(cls):
        return "file_tree"

    def schema(self):
        return "path string, content string"

    def writer(self, schema, overwrite):
        if not {"path", "content"} <= set(schema.names):
            raise ValueError("rows need a path and a content")
        return _Writer(self.options["path"], overwrite, self.options.get("replace", "false") == "true")


def write_files(files, root, replace=False):
    """Write rows (path, content) as files below root: all of them or none. replace: files that exist are replaced, else refused."""
    spark = files.sparkSession
    spark.dataSource.register(FileTree)
    finish(root)
    # rows of one path meet in one task, which refuses the second
    rows = files.select("path", "content").repartition("path")
    rows.write.format("file_tree").option("replace", str(replace).lower()).mode("append").save(root)
