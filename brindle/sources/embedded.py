"""A small read-only database that every JVM of the cluster opens for itself."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

DRIVER = "org.apache.derby.jdbc.EmbeddedDriver"


def database(spark: SparkSession, *statements: str) -> str:
    """The JDBC URL of a Derby database made by ``statements``, once for a session's context.

    Derby lets one JVM open a writable database, and one in memory is seen by its JVM alone.  So the driver makes
    it in a folder of its own, closes it and adds it to the session as a jar, which Spark brings to each executor; from
    a jar any number of JVMs may read.
    """
    made = spark.sparkContext.__dict__.setdefault("_brindle_databases", {})
    if statements not in made:
        made[statements] = _packed(spark, statements)
    jar, name = made[statements]
    # also where the jar is known: the thread that asks for the schema needs its class loader
    spark.sql(f"ADD JAR '{jar}'")
    return f"jdbc:derby:classpath:{name}"


def _packed(spark: SparkSession, statements: tuple[str, ...]) -> tuple[str, str]:
    folder = os.path.realpath(tempfile.mkdtemp(prefix="brindle-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = f"db{uuid.uuid4().hex[:10]}"
    at = f"{folder}/{name}"
    manager = spark._jvm.java.sql.DriverManager
    spark._jvm.java.lang.Class.forName(DRIVER)
    conn = manager.getConnection(f"jdbc:derby:{at};create=true")
    try:
        st = conn.createStatement()
        for s in statements:
            st.execute(s)
        st.close()
    finally:
        conn.close()
    try:
        manager.getConnection(f"jdbc:derby:{at};shutdown=true")
    except Py4JJavaError as e:  # a database that has closed says so by an error
        if e.java_exception.getSQLState() != "08006":
            raise
    jar = f"{folder}/{name}.jar"
    with zipfile.ZipFile(jar, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(at):
            for f in sorted(files):
                z.write(f"{d}/{f}", os.path.relpath(f"{d}/{f}", folder))
    shutil.rmtree(at)
    return jar, name
