"""Files in whatever store Spark's paths lead to: the executors' and the driver's alike."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession


class SharedFiles:
    """Lists, reads, writes, copies and packs files through Hadoop's file systems; contents stay in the JVM."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def at(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.conf), where

    def exists(self, path: str) -> bool:
        fs, where = self.at(path)
        return fs.exists(where)

    def folders(self, root: str) -> list[str]:
        """The names of the folders in a folder, in order; none of one that isn't there."""
        fs, where = self.at(root)
        return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()) if fs.exists(where) else []

    def files(self, root: str) -> list[tuple[str, int]]:
        """(name below root, bytes) of all files below a folder, in order, without check sums."""
        fs, where = self.at(root)
        if not fs.exists(where):
            return []
        start, found = len(fs.makeQualified(where).toUri().getPath().rstrip("/")) + 1, []
        listing = fs.listFiles(where, True)
        while listing.hasNext():
            status = listing.next()
            name = status.getPath().toUri().getPath()[start:]
            if not name.endswith(".crc"):
                found.append((name, status.getLen()))
        return sorted(found)

    def read_text(self, path: str) -> str:
        fs, where = self.at(path)
        stream = fs.open(where)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def read_bytes(self, path: str) -> bytes:
        fs, where = self.at(path)
        stream = fs.open(where)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write_bytes(self, path: str, content: bytes) -> None:
        fs, where = self.at(path)
        stream = fs.create(where, True)
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        self.write_bytes(path, text.encode())

    def delete(self, path: str) -> None:
        fs, where = self.at(path)
        fs.delete(where, True)

    def copy(self, source: str, target: str) -> None:
        """A file or folder, with all below it, to a place where nothing is yet."""
        (a, from_), (b, to) = self.at(source), self.at(target)
        b.mkdirs(to.getParent())
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(a, from_, b, to, False, self.conf)

    def pack(self, target: str, entries: Iterable[tuple[str, str]], texts: dict[str, str] | None = None) -> None:
        """An archive of (name, path) and of texts by name."""
        fs, where = self.at(target)
        archive = self.jvm.java.util.zip.ZipOutputStream(fs.create(where, True))
        try:
            for name, path in entries:
                from_fs, from_ = self.at(path)
                archive.putNextEntry(self.jvm.java.util.zip.ZipEntry(name))
                stream = from_fs.open(from_)
                self.jvm.org.apache.commons.io.IOUtils.copy(stream, archive)
                stream.close()
                archive.closeEntry()
            for name, text in (texts or {}).items():
                archive.putNextEntry(self.jvm.java.util.zip.ZipEntry(name))
                archive.write(bytearray(text.encode()))
                archive.closeEntry()
        finally:
            archive.close()

    def _entries(self, path: str, visit: Callable) -> None:
        fs, where = self.at(path)
        archive = self.jvm.java.util.zip.ZipInputStream(fs.open(where))
        try:
            entry = archive.getNextEntry()
            while entry is not None:
                visit(entry.getName(), archive)
                entry = archive.getNextEntry()
        finally:
            archive.close()

    def packed(self, path: str) -> list[str]:
        """The names in an archive."""
        names: list[str] = []
        self._entries(path, lambda name, _: names.append(name))
        return names

    def packed_text(self, path: str, wanted: str) -> str | None:
        """One text of an archive."""
        found: list[str] = []
        self._entries(
            path, lambda name, stream: found.append(
                bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
            ) if name == wanted else None
        )
        return found[0] if found else None

    def unpack(self, path: str, root: str, wanted: Callable[[str], bool]) -> list[str]:
        """The wanted files of an archive below root; names that lead elsewhere are left out."""
        done: list[str] = []

        def visit(name: str, stream) -> None:
            if name.startswith("/") or ".." in name.split("/") or name.endswith("/") or not wanted(name):
                return
            fs, where = self.at(f"{root}/{name}")
            out = fs.create(where, True)
            self.jvm.org.apache.commons.io.IOUtils.copy(stream, out)
            out.close()
            done.append(name)

        self._entries(path, visit)
        return done
