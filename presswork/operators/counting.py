"""Counts of keys most of which are rare: a task sends its counts in packed blocks, not a row for each key."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from presswork.session import ship_code

HASH_BITS = 36  # of a hash; keys that share them are counted as one, so counts by hash are never too low
HELD_HASHES = 1 << 21  # of a task before they are packed
HELD_ROWS = 1 << 19


def _parts(df: DataFrame) -> int:
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers byte by byte, the lowest bytes of all first: the upper bytes, mostly zero, take no room."""
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _stretches(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of the runs of equal values."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]).tolist()
    for begin, end in zip(edges, edges[1:]):
        if end > begin:
            yield int(part[begin]), begin, end


def frequent_hashes(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterable[np.ndarray]], min_count: int) -> DataFrame:
    """``_h``: the lower ``HASH_BITS`` bits of the hashes that ``hashes_of`` gives ``min_count`` times over all batches of ``df``.

    Of its sorted hashes a task sends the steps from one to the next, some two bytes each.
    """
    ship_code(df.sparkSession)
    parts, mask = _parts(df), np.uint64((1 << HASH_BITS) - 1)
    width = -(-(1 << HASH_BITS) // parts)

    def blocks(held: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(held), return_counts=True)
        n, rows = np.minimum(n, min_count), []
        for part, begin, end in _stretches((values // np.uint64(width)).astype(np.int64)):
            rows.append((part, end - begin, packed(np.diff(values[begin:end], prepend=np.uint64(0))), packed(n[begin:end])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)

    kinds = pa.schema([("part", pa.int32()), ("rows", pa.int32()), ("steps", pa.binary()), ("n", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for hashes in (h for batch in batches for h in hashes_of(batch)):
            held.append(hashes & mask)
            size += len(hashes)
            if size >= HELD_HASHES:
                yield blocks(held)
                held, size = [], 0
        if size:
            yield blocks(held)
        held.clear()
        pa.default_memory_pool().release_unused()  # the worker goes on to other stages

    def meet(group: pa.Table) -> pa.Table:
        sizes = group["rows"].to_pylist()
        values = np.concatenate([np.cumsum(unpacked(b, n), dtype=np.uint64) for b, n in zip(group["steps"].to_pylist(), sizes)])
        counts = np.concatenate([unpacked(b, n) for b, n in zip(group["n"].to_pylist(), sizes)])
        order = np.argsort(values, kind="stable")
        values = values[order]
        first = np.flatnonzero(np.diff(values, prepend=~values[:1]))
        often = values[first][np.add.reduceat(counts[order], first) >= min_count]
        return pa.table({"_h": pa.array(often.astype(np.int64))})

    sent = df.mapInArrow(send, "part int, rows int, steps binary, n binary")
    return sent.groupBy("part").applyInArrow(meet, "_h long")


def _strings_packed(strings: pa.Array) -> tuple[bytes, bytes]:
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset:strings.offset + len(strings) + 1]
    present = strings.is_valid().to_numpy(zero_copy_only=False)
    data = strings.buffers()[2]
    text = data[int(ends[0]):int(ends[-1])] if data is not None else b""
    return packed(np.where(present, np.diff(ends) + 1, 0)), pa.compress(text, "zstd", asbytes=True)


def _strings_unpacked(lengths: bytes, text: bytes, n: int) -> pa.Array:
    marks = unpacked(lengths, n).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(np.maximum(marks - 1, 0))]).astype(np.int32)
    text = pa.decompress(text, int(ends[-1]), "zstd") if ends[-1] else pa.py_buffer(b"")
    strings = pa.StringArray.from_buffers(n, pa.py_buffer(ends), text)
    return strings if marks.all() else pc.if_else(pa.array(marks > 0), strings, pa.scalar(None, pa.string()))


def counted(df: DataFrame, columns: list[str], rows_of: Callable[[pa.RecordBatch], Iterable[pa.Table]]) -> DataFrame:
    """Exact counts ``(*columns, n)`` of the rows of strings in the tables that ``rows_of`` makes of the batches of ``df``.

    ``rows_of`` adds a column ``_h``, a hash of the others. A task adds up the rows it has before it sends them, by hash, in blocks of
    compressed strings; the blocks of one range of hashes meet in one task.
    """
    ship_code(df.sparkSession)
    parts = _parts(df)
    fields = [f"{c}_{kind}" for c in range(len(columns)) for kind in ("lengths", "text")]
    kinds = pa.schema([("part", pa.int32()), ("rows", pa.int32()), ("n", pa.binary()), *((f, pa.binary()) for f in fields)])

    def added_up(tables: list[pa.Table], keys: list[str]) -> pa.Table:
        whole = pa.concat_tables(tables)
        return whole.group_by(keys, use_threads=False).aggregate([("n", "sum")]).rename_columns([*keys, "n"])

    def blocks(table: pa.Table) -> pa.RecordBatch:
        part = (table["_h"].to_numpy().view(np.uint64) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        table, part, rows = table.take(pa.array(order)).combine_chunks(), part[order], []
        strings, n = [table[c].chunk(0) for c in columns], table["n"].to_numpy()
        for own, begin, end in _stretches(part):
            made = [x for s in strings for x in _strings_packed(s.slice(begin, end - begin))]
            rows.append((own, end - begin, packed(n[begin:end]), *made))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, least, keys = [], 0, HELD_ROWS, [*columns, "_h"]
        for rows in (t for batch in batches for t in rows_of(batch)):
            held.append(rows.append_column("n", pa.array(np.ones(rows.num_rows, np.int64))))
            size += rows.num_rows
            if size >= least:
                held = [added_up(held, keys)]
                size = held[0].num_rows
                if size >= HELD_ROWS:
                    yield blocks(held[0])
                    held, size = [], 0
                least = size + HELD_ROWS
        if size:
            yield blocks(added_up(held, keys))
        held.clear()
        pa.default_memory_pool().release_unused()

    def meet(group: pa.Table) -> pa.Table:
        tables = []
        for row in group.to_pylist():
            strings = [_strings_unpacked(row[f"{i}_lengths"], row[f"{i}_text"], row["rows"]) for i in range(len(columns))]
            tables.append(pa.table([*strings, pa.array(unpacked(row["n"], row["rows"]).astype(np.int64))], names=[*columns, "n"]))
        return added_up(tables, columns)

    sent = df.mapInArrow(send, "part int, rows int, n binary, " + ", ".join(f"{f} binary" for f in fields))
    return sent.groupBy("part").applyInArrow(meet, ", ".join(f"{c} string" for c in columns) + ", n long")
