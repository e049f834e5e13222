"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Maker = Callable[[], Callable[[list[str]], list[list]]]


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers, once per application.

    Workers unpickle the operators' functions by module name and need not have the package installed.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    target = os.path.join(tempfile.mkdtemp(prefix="presswork-code-"), f"{package.name}.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def in_steps(batch: pa.RecordBatch, rows: int | None) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``rows`` rows."""
    step = rows or max(1, batch.num_rows)
    for at in range(0, max(1, batch.num_rows), step):
        yield batch.slice(at, step)


def append_from_text(df: DataFrame, text: str, added: str, make: Maker, drop_text: bool = False,
                     rows: int | None = None) -> DataFrame:
    """Append columns computed from whole texts; the other columns of ``df`` pass through as they are.

    ``make()`` runs once in each task and returns a function from a list of texts to one list of
    values per column of the DDL string ``added``. A null text is handed over as an empty one.
    Columns of ``df`` that bear an added name give way, and with ``drop_text`` the text stays behind. No shuffle; an Arrow batch is bounded by
    rows and by bytes, results are held for ``rows`` of it at once where given, and a text is never cut.
    """
    ship_code(df.sparkSession)
    new = T.StructType.fromDDL(added)
    df = df.select([quoted(c) for c in df.columns if c == text or c not in new.names])
    keep = [i for i, c in enumerate(df.columns) if c not in new.names and not (drop_text and c == text)]
    schema = T.StructType([*(df.schema.fields[i] for i in keep), *new.fields])
    arrow = to_arrow_schema(schema)
    new_arrow = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in (b for whole in batches for b in in_steps(whole, rows)):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            made = [pa.array(v, f.type) for v, f in zip(work(texts), new_arrow, strict=True)]
            kept = [batch.column(i).cast(arrow.field(n).type) for n, i in enumerate(keep)]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=schema.names)

    return df.mapInArrow(run, schema)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def filter_rows(docs: DataFrame, keep: Callable[[DataFrame, dict[str, str]], DataFrame]) -> DataFrame:
    """Rows that ``keep`` leaves, with exactly the columns of ``docs``.

    ``keep`` gets the rows under names that cannot clash with a column an operator adds, and a map
    from the names of ``docs`` to those.
    """
    names = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    left = keep(docs.select([quoted(c).alias(n) for c, n in names.items()]), names)
    return left.select([F.col(n).alias(c) for c, n in names.items()])


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
