"""What the operators of this subpackage share: table access, the shared folder, names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits on the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent (tests, a laptop) a temporary folder is set once for the session.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quillgrid.shared.dir", None)
    if not where:
        where = tempfile.mkdtemp(prefix="quillgrid-")
        spark.conf.set("quillgrid.shared.dir", where)
    return where


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken, name, n = {c.lower() for c in df.columns}, f"__{stem}", 0
    while name.lower() in taken:
        n += 1
        name = f"__{stem}{n}"
    return name


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def utf8(array) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string array."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    return array.cast(kind).to_pylist()


def arrow_function(kind: str):
    """A function of Arrow arrays as a column function that is evaluated once for each row.

    The type is read where a column is made, on the driver: modules are imported on executors, too.
    """

    def wrap(f):
        def column(*columns: Column) -> Column:
            return F.arrow_udf(f, kind).asNondeterministic()(*columns)

        column.__doc__ = f.__doc__
        return column

    return wrap
