"""CSV with quoted line breaks, read in as many tasks as plain text.

Whether a byte range begins inside a quoted field depends on all that is before it, but only through one bit: the parity
of the quote characters (a doubled quote changes nothing). So every range is first read for its parity, a prefix scan over
a file's ranges gives each its starting state, and then all ranges are cut into records at once. A record that crosses
ranges leaves one fragment in each of them; fragments, at most two a range, are put together by their order in the file.
Each record is then parsed by the engine's own CSV expression.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evolens.session import materialise

WHOLE, HEAD, TAIL, THROUGH = range(4)  # of a record: all of it, its end, its beginning, neither
_RANGE = ["_file", "_start"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the byte range they begin in; inside a range they keep their order."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.make_valid_utf8("value").alias("_line")
    )


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def _crossed(lines: DataFrame) -> DataFrame:
    """The byte ranges that begin or end inside a quoted field, and whether they begin there."""
    ranges = lines.groupBy(*_RANGE).agg((F.sum(_quotes(F.col("_line"))) % 2).alias("_odd"))
    upto = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, 0)
    states = ranges.withColumn("_upto", F.sum("_odd").over(upto))
    inside = (F.col("_upto") - F.col("_odd")) % 2 == 1
    return states.where(inside | (F.col("_upto") % 2 == 1)).select(*_RANGE, inside.alias("_inside"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and fragments of each byte range."""
    # The range; whether a record began in it; the one not ended yet; whether the file's first record is still to come.
    current, started, open_text, fresh = None, False, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start = (batch.column(c) for c in ("_file", "_start"))
        begins = batch.column("_inside")
        keys = np.stack([pc.dictionary_encode(file).indices.to_numpy(), start.to_numpy()])
        edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for low, high in zip(edges, edges[1:]):
            key = (file[low].as_py(), start[low].as_py())
            if key != current:
                if current is not None and open_text is not None:
                    yield _pieces(current, [TAIL if started else THROUGH], [open_text], fresh)
                current, started, open_text, fresh = key, False, None, key[1] == 0
                inside = bool(begins[low].as_py())
            else:
                inside = open_text is not None
            lines = batch.column("_line").slice(low, high - low)
            odd = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False) % 2
            if not inside and not odd.any():  # every line is a record
                yield _pieces(current, WHOLE, lines, fresh)
                fresh = fresh and not pc.any(_filled(lines)).as_py()
                open_text, started = None, True
                continue
            within = (np.cumsum(odd) + inside) % 2 == 1  # inside quotes after each line
            ends = np.flatnonzero(~within) + 1
            if not len(ends):
                rest = "\n".join(lines.to_pylist())
                open_text, started = (rest, started or not inside) if open_text is None else (f"{open_text}\n{rest}", started)
                continue
            offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
            texts = pc.binary_join(pa.ListArray.from_arrays(offsets, lines), "\n").to_pylist()
            kinds = [WHOLE] * len(ends)
            if inside:
                if open_text is not None:
                    texts[0] = f"{open_text}\n{texts[0]}"
                kinds[0] = WHOLE if started else HEAD
            yield _pieces(current, kinds, texts, fresh)
            fresh = fresh and not any(x.strip("\r") for x in texts)
            left = lines.slice(int(ends[-1])).to_pylist()
            open_text, started = ("\n".join(left), True) if left else (None, True)
    if current is not None and open_text is not None:
        yield _pieces(current, [TAIL if started else THROUGH], [open_text], fresh)


def _filled(texts: pa.Array) -> pa.Array:
    return pc.greater(pc.binary_length(pc.utf8_trim(texts, "\r")), 0)


def _pieces(key: tuple[str, int], kinds: int | list[int], texts: pa.Array | list[str], fresh: bool) -> pa.RecordBatch:
    """fresh: the first of them that is not blank is the file's first record, or begins it. kinds: of each, or of all."""
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    n = len(texts)
    first = np.zeros(n, dtype=bool)
    if fresh:
        first[np.flatnonzero(_filled(texts).to_numpy(zero_copy_only=False))[:1]] = True
    columns = [pa.repeat(pa.scalar(key[0], pa.string()), n), pa.repeat(pa.scalar(key[1], pa.int64()), n), pa.array(np.full(n, kinds, np.int8)), texts, pa.array(first)]
    return pa.RecordBatch.from_arrays(columns, [*_RANGE, "_kind", "_text", "_first"])


def records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """_text of every record but each file's first one, if that is a header; empty lines are left out."""
    lines = _lines(spark, path)
    # One row at most for every byte range, and only for those that a quoted field crosses.
    crossed = materialise(_crossed(lines))
    marked = lines.join(F.broadcast(crossed), _RANGE, "left")
    pieces = marked.mapInArrow(_cut, "_file string, _start bigint, _kind tinyint, _text string, _first boolean")
    whole = pieces.where(F.col("_kind") == WHOLE)
    # A range's end of an earlier record comes before its own beginning of a later one.
    begins = (F.col("_kind") == TAIL).cast("int")
    order = Window.partitionBy("_file").orderBy("_start", begins).rowsBetween(Window.unboundedPreceding, 0)
    parts = pieces.where(F.col("_kind") != WHOLE).withColumn("_number", F.sum(begins).over(order))
    in_order = F.array_sort(F.collect_list(F.struct("_start", "_text")))
    joined = parts.groupBy("_file", "_number").agg(F.array_join(F.transform(in_order, lambda p: p["_text"]), "\n").alias("_text"), F.max("_first").alias("_first"))
    both = whole.select("_text", "_first")
    if not crossed.isEmpty():  # else every record lies in one range, and files are cut once
        both = both.unionByName(joined.select("_text", "_first"))
    found = both.select(F.regexp_replace("_text", r"\r\z", "").alias("_text"), "_first").where("_text <> ''")
    return found.where(~F.col("_first")).drop("_first") if header else found.drop("_first")


def parse(found: DataFrame, schema: str, options: dict[str, str]) -> DataFrame:
    return found.select(F.from_csv("_text", schema, options).alias("_row")).select("_row.*")
