"""Which files of a table are in use: numbered lists, of which the last one counts.

A writer puts new files beside the old ones, then writes the next list. Lists are never changed, and a number is taken by one writer
only: the file is finished under another name and renamed, which fails if the name is there. So readers see a whole state, a
writer that died leaves nothing but files no list names, and of two writers that began from one state the second is told to begin again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer was first."""


class Manifest:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path, self._jvm = path, spark._jvm
        hadoop = self._jvm.org.apache.hadoop.fs
        self._folder = hadoop.Path(f"{path}/manifest")
        conf = spark._jsc.hadoopConfiguration()
        self._files = self._folder.getFileSystem(conf)
        self._context = hadoop.FileContext.getFileContext(self._folder.toUri(), conf)
        self._none = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def numbers(self) -> list[int]:
        """Numbers of the lists there are: a handful after ``vacuum``."""
        if not self._files.exists(self._folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def load(self, number: int) -> dict:
        stream = self._files.open(self._at(f"manifest/{number:012d}.json"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def read(self) -> tuple[int, dict]:
        """The last number and its content; (0, {}) for a new table."""
        last = max(self.numbers(), default=0)
        return last, self.load(last) if last else {}

    def commit(self, number: int, content: dict) -> None:
        """Make ``content`` the state after list ``number``."""
        own = self._at(f"manifest/{uuid.uuid4().hex}.tmp")
        stream = self._files.create(own, False)
        stream.write(json.dumps(content).encode())
        stream.close()
        try:
            self._context.rename(own, self._at(f"manifest/{number + 1:012d}.json"), self._none)
        except Exception as error:
            self._files.delete(own, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"list {number + 1} of {self.path} is there already") from None
            raise

    def drop(self, name: str) -> None:
        """Delete a folder or file of the table."""
        self._files.delete(self._at(name), True)

    def forget(self, keep: int) -> list[dict]:
        """Delete all lists but the last ``keep``, and return what the deleted ones held."""
        old = self.numbers()[:-keep]
        held = [self.load(n) for n in old]
        for n in old:
            self.drop(f"manifest/{n:012d}.json")
        return held
