"""Downloaded source archives (``<paper id>.tar.gz``) as a table.

``paper_archives`` is a data source with partitions of its own: the driver
walks the folder and adds up sizes by class (a hash of the path), classes are
dealt over partitions by size, and each task walks the folder too and streams
the archives of its classes member by member.  However many archives there are,
the driver holds ``CLASSES`` sums and no name.  Nothing is
unpacked to disk, so no member can be written outside a folder; members whose
path would leave theirs, links, and archives that cannot be read become rows
that say so.  Folders are named by path or URI (``pyarrow.fs``: local, HDFS,
S3, ...) and have to be reachable from all executors.
"""

from __future__ import annotations

import os
import posixpath
import tarfile
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SUFFIX = ".tar.gz"
#: Members that are read; others are passed over in the stream.
SUFFIXES = ".tex,_tex,.bib"
SCHEMA = "paper_id string, rel_path string, content binary, error string"
#: Classes into which archives fall by a hash of their path.
CLASSES = 1 << 16


class Archives(InputPartition):
    """The archives of some classes; so many stood there when they were dealt."""

    def __init__(self, classes: list[int], count: int) -> None:
        self.classes, self.count = classes, count


def class_of(path: str) -> int:
    return zlib.crc32(os.fsencode(path)) % CLASSES


def listed(files, base: str, sized: bool) -> Iterator[tuple[str, int]]:
    """(path, size) of the archives under ``base``; the size is 0 unless
    ``sized``.  A local folder is read entry by entry, of another store one
    folder's entries are held at a time."""
    from pyarrow import fs
    local, folders = isinstance(files, fs.LocalFileSystem), [base]
    while folders:
        folder = folders.pop()
        if local:
            with os.scandir(folder) as entries:
                for e in entries:
                    if e.is_dir():
                        folders.append(e.path)
                    elif e.name.endswith(SUFFIX) and e.is_file():
                        yield e.path, e.stat().st_size if sized else 0
        else:
            for f in files.get_file_info(fs.FileSelector(folder)):
                if f.type == fs.FileType.Directory:
                    folders.append(f.path)
                elif f.is_file and f.path.endswith(SUFFIX):
                    yield f.path, f.size or 0


def dealt[T](sizes: list[tuple[int, T]], parts: int) -> list[list[T]]:
    """Items in ``parts`` lists of nearly equal size, the largest first into
    the list that holds least."""
    import heapq
    heap = [(0, k) for k in range(parts)]
    out: list[list[T]] = [[] for _ in range(parts)]
    for size, path in sorted(sizes, reverse=True):
        held, k = heapq.heappop(heap)
        out[k].append(path)
        heapq.heappush(heap, (held + size, k))
    return [p for p in out if p]


def inside(name: str) -> str | None:
    """The member's path in its folder, None if it would leave it."""
    path = posixpath.normpath(name.replace("\\", "/"))
    return None if path.startswith(("/", "../")) or path in ("..", ".") or ":" in path.split("/")[0] else path


def members(paper_id: str, stream, suffixes: tuple[str, ...]) -> Iterator[tuple]:
    """Rows of one archive, read once from front to back.  What was read before
    an archive breaks stays; the break is a row of its own."""
    try:
        with tarfile.open(fileobj=stream, mode="r|gz") as tar:
            for m in tar:
                if m.isdir():
                    continue
                path = inside(m.name)
                if path is None:
                    yield paper_id, m.name, None, "path leaves the folder"
                elif not m.isfile():
                    yield paper_id, path, None, "not a regular file"
                elif path.endswith(suffixes):
                    yield paper_id, path, tar.extractfile(m).read(), None
    except (tarfile.TarError, EOFError, OSError, zlib.error) as e:
        yield paper_id, None, None, f"broken archive: {type(e).__name__}"


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.parts = int(options.get("partitions", "64"))
        self.suffixes = tuple(options.get("suffixes", SUFFIXES).split(","))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs
        files, base = fs.FileSystem.from_uri(self.root)
        sizes, counts = [0] * CLASSES, [0] * CLASSES
        for path, size in listed(files, base, sized=True):
            k = class_of(path)
            sizes[k] += size
            counts[k] += 1
        held = dealt([(sizes[k], k) for k in range(CLASSES) if counts[k]], self.parts)
        # an empty folder still needs one partition
        return [Archives(p, sum(counts[k] for k in p)) for p in held] or [Archives([], 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs
        files, base = fs.FileSystem.from_uri(self.root)
        mine, left = set(partition.classes), partition.count
        for path, _ in listed(files, base, sized=False) if mine else ():
            if class_of(path) not in mine:
                continue
            left -= 1
            name = path.rsplit("/", 1)[-1][:-len(SUFFIX)]
            with files.open_input_stream(path, compression=None) as stream:
                yield from members(name, stream, self.suffixes)
        if left > 0:
            raise FileNotFoundError(f"{left} archives went from {self.root} while it was read")


class PaperArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paper_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, root: str, partitions: int | None = None, suffixes: str = SUFFIXES) -> DataFrame:
    """(paper_id, rel_path, content, error) of all archives under ``root``:
    one row for each member that ends in one of ``suffixes``, with its bytes;
    rows with ``error`` name what was refused or could not be read."""
    spark.dataSource.register(PaperArchives)
    parts = partitions or max(1, 2 * spark.sparkContext.defaultParallelism)
    return spark.read.format("paper_archives").option("partitions", parts).option("suffixes", suffixes).load(root)


def archive_files(archives: DataFrame) -> DataFrame:
    """(paper_id, rel_path, content) as text, as the folder scan gives them:
    UTF-8 with undecodable bytes dropped, without error rows."""
    from .files import decoded
    return archives.filter("error is null").select("paper_id", "rel_path", decoded(F.col("content")).alias("content"))
