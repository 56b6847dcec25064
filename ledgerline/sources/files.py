"""Small file operations on any Hadoop file system: markers, moves and deletes of single paths."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def touch(spark: SparkSession, path: str) -> None:
    """An empty marker file."""
    p, fs = _path(spark, path)
    fs.create(p, True).close()


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, source, target: str) -> str | None:
    """Move a file to ``target``, or to target~1, target~2, ... if that name is taken.  Returns the name it has now, or
    None if it could not be moved.  ``source`` is a path or a file URI as Spark reports it."""
    jvm = spark._jvm
    src = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(source))
    p, fs = _path(spark, target)
    fs.mkdirs(p.getParent())
    name, no = target, 0
    while fs.exists(p):
        no += 1
        name = f"{target}~{no}"
        p, fs = _path(spark, name)
    return name if fs.rename(src, p) else None


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder to ``target``; one that is there goes."""
    src, _ = _path(spark, source)
    p, fs = _path(spark, target)
    fs.delete(p, True)
    fs.mkdirs(p.getParent())
    if not fs.rename(src, p):
        raise OSError(f"{source} could not be moved to {target}")


def make_folder(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.mkdirs(p)


def state(spark: SparkSession, uri: str) -> tuple[int, int] | None:
    """(modification time in ms, length) of a file that can be opened; None if there is none.  Raises what opening
    it raises."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    fs.open(p).close()
    status = fs.getFileStatus(p)
    return status.getModificationTime(), status.getLen()


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it does not exist."""
    p, fs = _path(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def create_new(spark: SparkSession, path: str, taken: str = "") -> None:
    """An empty file that must not exist yet; nor may another name beginning with ``taken``."""
    p, fs = _path(spark, path)
    own = taken.rpartition("/")[2]
    if own and any(n.startswith(own) for n in names(spark, path.rpartition("/")[0])):
        raise FileExistsError(path)
    fs.create(p, False).close()
