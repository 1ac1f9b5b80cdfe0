"""Small control files in the folder of a table, by the cluster's own file system."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _file(spark: SparkSession, path: str):
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()), name


def exists(spark: SparkSession, path: str) -> bool:
    files, name = _file(spark, path)
    return files.exists(name)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder, sorted; none if there is no such folder."""
    files, name = _file(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(name)) if files.exists(name) else []


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file of ASCII text unless there is one of that name already."""
    from py4j.protocol import Py4JJavaError

    files, name = _file(spark, path)
    try:
        out = files.create(name, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in str(error.java_exception) or "already exists" in str(error.java_exception):
            return False
        raise
    out.writeBytes(text)
    out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path, wholetext=True).first()
    return row[0] if row else ""


def delete(spark: SparkSession, path: str) -> None:
    files, name = _file(spark, path)
    files.delete(name, True)
