"""Small driver-side reads and listings through Hadoop file systems, local or remote."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession


def filesystem(spark: SparkSession, path: str):
    """Hadoop file system of a path, and the path as its object."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.exists(p)


def is_dir(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def names(spark: SparkSession, directory: str) -> list[str]:
    """Names of the files in a directory, sorted."""
    fs, p = filesystem(spark, directory)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isFile())


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; the target's parent is made if it is missing."""
    fs, p = filesystem(spark, source)
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    fs.mkdirs(to.getParent())
    if not fs.rename(p, to):
        raise OSError(f"{source} could not be moved to {target}")


def delete(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def concat(spark: SparkSession, sources: list[str], target: str) -> None:
    """Write files one behind the other into a new one, streamed by the JVM of the driver; gzipped ones stay valid gzip."""
    fs, p = filesystem(spark, target)
    jvm = spark.sparkContext._jvm
    out = fs.create(p, True)
    try:
        for source in sources:
            stream = fs.open(jvm.org.apache.hadoop.fs.Path(source))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            finally:
                stream.close()
    finally:
        out.close()


def uri(spark: SparkSession, path: str) -> str:
    """The form in which ``_metadata.file_path`` reports a file."""
    fs, p = filesystem(spark, path)
    text = fs.makeQualified(p).toUri().toString()
    return "file:/" + text[len("file:///") :] if text.startswith("file:///") else text


def lines(spark: SparkSession, path: str) -> Iterator[str]:
    """Lines of a plain or compressed text file, read as far as asked for."""
    fs, p = filesystem(spark, path)
    jvm = spark.sparkContext._jvm
    stream = fs.open(p)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration()).getCodec(p)
        plain = codec.createInputStream(stream) if codec is not None else stream
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8"))
        while (line := reader.readLine()) is not None:
            yield line
    finally:
        stream.close()
