"""Small files on any Hadoop file system, by the session's own configuration."""

from __future__ import annotations


def _at(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def delete(spark, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)


def names(spark, path: str) -> list[str]:
    p, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def size(spark, path: str) -> int:
    p, fs = _at(spark, path)
    return fs.getFileStatus(p).getLen()


def move(spark, path: str, to: str) -> None:
    p, fs = _at(spark, path)
    target, _ = _at(spark, to)
    fs.mkdirs(target.getParent())
    if not fs.rename(p, target):
        raise OSError(f"cannot rename {path} to {to}")


def read_text(spark, path: str) -> str | None:
    p, fs = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark, path: str, text: str, *, new: bool = False) -> None:
    """Write beside and rename over; ``new``: fail if the file is there."""
    p, fs = _at(spark, path)
    if new:
        out = fs.create(p, False)
        out.write(bytearray(text.encode()))
        out.close()
        return
    beside, _ = _at(spark, path + ".new")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(beside, p):
        raise OSError(f"cannot rename to {path}")
