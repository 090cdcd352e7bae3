"""A folder of files as a Spark data source: empty files too, byte ranges in place of whole files, limits at the listing.

The driver lists until there are folders enough to share out; what lies below those is listed by tasks. Files are dealt
out in stretches, and a task reads only the beginning and the end of each, as many bytes as were asked for. Limits of
size, name and extension apply to the listing, before a file is opened. They are options: filters that Spark pushes into a Python source
stay with it for later queries on the same DataFrame.
"""

import fnmatch
import posixpath
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

SHORT_NAME = "file_folder"
SCHEMA = "path string, dir string, name string, ext string, size long, mtime timestamp, head binary, tail binary, reason string"
DEALT_FILES = 500  # of a stretch
DEALT_BYTES = 1 << 26  # that a stretch's heads and tails may have
FOLDERS = 256  # that the driver lists down to
BATCH = 100  # files of a batch


def extension_of(name: str) -> str:
    """As formats.extension(), in lower case: what follows the last dot that has something before it."""
    base, dot, ext = name.rpartition(".")
    return ext.lower() if dot and base and ext else ""


class Stretch(ds.InputPartition):
    """Files [(path, size, mtime)] of one task, or a folder that it lists itself."""

    def __init__(self, files: list[tuple], folder: str | None = None):
        self.files, self.folder = files, folder


class FolderReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri = options["path"]
        self.head, self.tail = int(options.get("head", 0)), int(options.get("tail", 0))
        self.recursive, self.hidden = options.get("recursive", "true").lower() == "true", options.get("hidden", "false").lower() == "true"
        self.least, self.most = int(options.get("least_size", 0)), int(options.get("most_size", 1 << 62))
        self.glob, self.exts = options.get("glob", "*"), {x for x in options.get("exts", "").lower().split(",") if x}

    def _takes(self, path: str, size: int) -> bool:
        name = posixpath.basename(path)
        return self.least <= size <= self.most and fnmatch.fnmatchcase(name, self.glob) and (not self.exts or extension_of(name) in self.exts)

    def _system(self) -> tuple[fs.FileSystem, str, str]:
        """The file system, the folder's path in it, and what stands before paths in what is returned."""
        system, path = fs.FileSystem.from_uri(self.uri) if "://" in self.uri or self.uri.startswith("file:") else (fs.LocalFileSystem(), posixpath.abspath(self.uri))
        if self.uri.startswith("file:"):
            return system, path, "file:"
        at = self.uri.find(path)
        return system, path, self.uri[:at] if "://" in self.uri and at > 0 else ""

    def _listed(self, system: fs.FileSystem, folder: str, recursive: bool) -> tuple[list[tuple], list[str]]:
        """(path, size, mtime) of the files that are wanted, and the folders, of one folder or all below it."""
        files, folders = [], []
        for x in system.get_file_info(fs.FileSelector(folder, recursive=recursive)):
            below = x.path[len(folder) :].strip("/").split("/")
            if not self.hidden and any(p.startswith(("_", ".")) for p in below):
                continue
            if x.type == fs.FileType.Directory:
                folders.append(x.path)
            elif x.type == fs.FileType.File and self._takes(x.path, x.size):
                files.append((x.path, x.size, x.mtime))
        return files, folders

    def partitions(self) -> Sequence[ds.InputPartition]:
        system, path, _ = self._system()
        files, folders = self._listed(system, path, False)
        while self.recursive and folders and len(folders) < FOLDERS:
            below, deeper = [], []
            for f in folders:
                more, inner = self._listed(system, f, False)
                below += more
                deeper += inner
            files += below
            folders = deeper
        out, held, size = [], [], 0
        for f in files:
            cost = min(f[1], self.head + self.tail)
            if held and (len(held) >= DEALT_FILES or size + cost > DEALT_BYTES):
                out.append(Stretch(held))
                held, size = [], 0
            held.append(f)
            size += cost
        if held or not (out or folders):
            out.append(Stretch(held))
        return out + ([Stretch([], f) for f in folders] if self.recursive else [])

    def _ends(self, system: fs.FileSystem, path: str, size: int) -> tuple[bytes | None, bytes | None, str | None]:
        if not self.head and not self.tail:
            return None, None, None
        try:
            with system.open_input_file(path) as f:
                head = f.read_at(min(self.head, size), 0)
                return head, f.read_at(min(self.tail, size), max(0, size - self.tail)) if self.tail else b"", None
        except OSError as e:
            return None, None, str(e)

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        system, _, before = self._system()
        files = partition.files if partition.folder is None else self._listed(system, partition.folder, True)[0]
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.binary(), pa.binary(), pa.string())
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for k in range(0, len(files), BATCH):
            rows = []
            for path, size, mtime in files[k : k + BATCH]:
                name = posixpath.basename(path)
                rows.append((before + path, before + posixpath.dirname(path), name, extension_of(name), size, mtime, *self._ends(system, path, size)))
            yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


class FolderSource(ds.DataSource):
    """spark.read.format("file_folder").load(path); options: head and tail (bytes of each file to read, 0), recursive (true),
    hidden (false: files and folders whose names begin with _ or . are passed over), least_size, most_size, glob (of names), exts."""

    @classmethod
    def name(cls) -> str:
        return SHORT_NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))


def arrow_reads(path: str) -> bool:
    """Whether Arrow has the file system of a path; tasks read byte ranges only there."""
    try:
        if "://" in path or path.startswith("file:"):
            fs.FileSystem.from_uri(path)
        return True
    except (pa.ArrowException, OSError):
        return False


def folder(spark: SparkSession, path: str, head: int = 0, tail: int = 0, recursive: bool = True, hidden: bool = False, least_size: int = 0, most_size: int = 1 << 62, glob: str = "*", exts: Sequence[str] = ()) -> DataFrame:
    """(path, dir, name, ext, size, mtime, head, tail, reason) of the files of a folder; a file that can't be opened has
    null head and tail, and a reason. Without head and tail no file is opened; nor is one beyond the limits, which leave it out."""
    spark.dataSource.register(FolderSource)
    options = {"head": head, "tail": tail, "recursive": str(recursive).lower(), "hidden": str(hidden).lower(), "least_size": least_size, "most_size": most_size, "glob": glob, "exts": ",".join(exts)}
    return spark.read.format(SHORT_NAME).options(**options).load(path)
