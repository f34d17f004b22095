"""A folder whose numbered entries are created once, by one writer each.

What an entry names is written before the entry is; it becomes visible as a whole
when the entry is created. The entry is complete at that moment, and creating it
fails if another writer took the number.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession


class Log:
    """Entries `path/log/<n>`, from 1 on without a gap."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs("log").mkdirs(self._at("log"))

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self, name: str):
        return self._at(name).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def entries(self, after: int = 0) -> list[tuple[int, dict]]:
        """The log entries after number `after`, in order."""
        listed = self._fs("log").listStatus(self._at("log"))
        numbers = sorted(int(s.getPath().getName()) for s in listed if s.getPath().getName().isdigit())
        return [(n, json.loads(self._read(f"log/{n:020d}"))) for n in numbers if n > after]

    def _read(self, name: str) -> str:
        stream = self._fs(name).open(self._at(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def claim(self, number: int, content: dict) -> bool:
        """Create entry `number`, complete at once; False if it is there already."""
        name, target = f"log/.{uuid.uuid4().hex}", f"log/{number:020d}"
        out = self._fs(name).create(self._at(name), False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        place = urlparse(self.path)
        if place.scheme in ("", "file"):
            # a local rename replaces its target; a link does not
            try:
                os.link(f"{place.path}/{name}", f"{place.path}/{target}")
            except FileExistsError:
                return False
            finally:
                self._fs(name).delete(self._at(name), False)
            return True
        if self._fs(target).exists(self._at(target)) or not self._fs(name).rename(self._at(name), self._at(target)):
            self._fs(name).delete(self._at(name), False)
            return False
        return True
