"""What the corpus operators share: words, null handling, source keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def whole(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: str | Column) -> Column:
    """The maximal runs of ``[^\\x20\\x09-\\x0D]`` in a text; none for null or empty.

    The other separators are turned to spaces first: splitting at one plain character is several times faster than at
    a pattern.
    """
    plain = whole(text)
    for c in SPACE_CHARS[1:]:
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def source_key(source: str | Column) -> Column:
    """A key without nulls that sorts as the sources do by code point, null last."""
    source = F.col(source) if isinstance(source, str) else source
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


#: Texts have kilobytes: so many rows in a batch to a Python worker, where the session holds on to Spark's own number.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> SparkSession:
    """Set batches of ``BATCH_ROWS`` instead of Spark's 10000 rows: a tenth of the memory in Python and in the JVM's buffers.

    For applications (queries, the pipeline); the operators work with any setting.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(BATCH_ROWS))
    return spark


#: Tasks work on so many bytes of text at a time; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20


def arrow_slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in slices whose column ``text`` (strings or lists) holds about ``size`` bytes at most."""
    for batch in batches:
        column = batch.column(text)
        many = pa.types.is_list(column.type) or pa.types.is_large_list(column.type)
        lengths = pc.fill_null(pc.multiply(pc.list_value_length(column), 4) if many else pc.binary_length(column), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > size:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n + 8
        if len(lengths) > start:
            yield batch.slice(start)


def with_made_columns(
    docs: DataFrame, text: str, kinds: dict[str, str], tool: Callable, made: Callable[..., dict], without: tuple[str, ...] = (), also: tuple[str, ...] = ()
) -> DataFrame:
    """``docs`` with the columns ``kinds`` (name to type) that ``made(tool(), texts)`` gives for a slice of ``text`` at a time.

    Columns of these names, and those in ``without``, are left out of ``docs``. Other columns pass through as they are.
    ``made`` is given the columns in ``also`` too, as lists after the texts.
    """
    kept = [f for f in docs.schema.fields if f.name not in kinds and f.name not in without]
    names = [f.name for f in kept]
    read = dict.fromkeys([*names, text, *also])
    base = docs.select(*[F.col(f"`{c}`") for c in read])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{k}` {v}" for k, v in kinds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tool()
        for rows in arrow_slices(batches, text):
            new = made(held, *(rows.column(c).to_pylist() for c in (text, *also)))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), *(new[k] for k in kinds)], names=[*names, *kinds])

    return base.mapInArrow(run, schema)


#: Entries of each half of a worker's store of words, and their characters at most: some 40 MB when both are full.
REMEMBERED, REMEMBERED_CHARS = 80_000, 32


class Remembered(dict):
    """Remembers results of a function of short texts. When it is full, only what is asked for again stays."""

    def __init__(self, made: Callable):
        self.made, self.old = made, {}

    def __missing__(self, key: str):
        if len(key) > REMEMBERED_CHARS:
            return self.made(key)
        value = self.old.get(key)
        if value is None:
            value = self.made(key)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
