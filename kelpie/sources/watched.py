"""A stream of files that are new or have changed, by content: format "changed_files".

Spark's own file source sees new names only. Here an offset says of every file when it was changed and what its content
hashes to; a file is read again when both differ. Options: path (a folder, local or any URI that Arrow's file systems
open), pattern (of names, *.ics by default). Register once a session: spark.dataSource.register(ChangedFiles).
"""

from __future__ import annotations

import fnmatch
import hashlib
import json

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


def _open(path):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _File(InputPartition):
    def __init__(self, path, changed, sha):
        self.path, self.changed, self.sha = path, changed, sha


class _Reader(DataSourceStreamReader):
    def __init__(self, path, pattern):
        self.path, self.pattern, self.known = path, pattern, {}

    def initialOffset(self):
        return {"files": "{}"}

    def latestOffset(self):
        """{path: [ns, sha256]} of all files; only those whose time has changed are hashed. Grows with the number of files."""
        from pyarrow import fs

        system, root = _open(self.path)
        found = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type != fs.FileType.File or not fnmatch.fnmatch(info.base_name, self.pattern) or info.base_name.startswith((".", "_")):
                continue
            before = self.known.get(info.path)
            if before and before[0] == info.mtime_ns:
                found[info.path] = before
            else:
                with system.open_input_stream(info.path) as f:
                    found[info.path] = [info.mtime_ns, hashlib.sha256(f.read()).hexdigest()]
        self.known = found
        return {"files": json.dumps(found, sort_keys=True)}

    def partitions(self, start, end):
        old, new = json.loads(start["files"]), json.loads(end["files"])
        self.known = self.known or new
        return [_File(p, t, sha) for p, (t, sha) in new.items() if p not in old or old[p][1] != sha]

    def read(self, partition):
        """(path, content, sha, changed): the content as it is now; if it changed since, the next offset names it again."""
        import datetime

        system, _ = _open(self.path)
        with system.open_input_stream(partition.path) as f:
            raw = f.read()
        yield partition.path, raw.decode("utf-8", "replace"), partition.sha, datetime.datetime.fromtimestamp(partition.changed / 1e9)

    def commit(self, end):
        pass


class ChangedFiles(DataSource):
    @classmethod
    def name(cls):
        return "changed_files"

    def schema(self):
        return "path string, content string, sha string, changed timestamp"

    def streamReader(self, schema):
        return _Reader(self.options["path"], self.options.get("pattern", "*.ics"))


def changed_files(spark, path, pattern="*.ics"):
    """(path, content, sha, changed) of files below path, whenever their content is new; restarts from the checkpoint."""
    spark.dataSource.register(ChangedFiles)
    return spark.readStream.format("changed_files").option("path", path).option("pattern", pattern).load()
