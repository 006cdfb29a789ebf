"""CSV records with line breaks inside quotes, read from splits of any size.

A split that begins inside a quoted field cannot see that by itself. A first
pass sums the quote parity of every split; a running sum over the splits of
a file then tells each one whether it begins inside quotes. The second pass
cuts every split into records. A record that crosses the end of a split
leaves pieces (at most two a split), which are joined in file order.

Quotes within quoted fields are doubled (RFC 4180), and a field that holds a
quote is quoted; other quotes would shift the parity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: splits whose begin state is sent to the tasks (24 bytes each): 2 million are 256 TB at 128 MB a split
MAX_BLOCKS = 2_000_000
_RECORDS = "name string, record string, header boolean, file bigint, owner bigint, part bigint, whole boolean"


def _runs(batches: Iterator[pa.RecordBatch]):
    """(batch piece, block, file, start, name, parity per line) for the lines of one split at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch["block"].to_numpy()
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        odd = pc.count_substring(batch["value"], '"').to_numpy(zero_copy_only=False).astype(np.int64) & 1
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield (batch["value"].slice(a, b - a), int(block[a]), batch["file"][a].as_py(), batch["start"][a].as_py(),
                   batch["name"][a].as_py(), odd[a:b])


def _parities(batches):
    """One row per split: file, start, block and the parity of its quotes; whether a record begins in it
    if it begins inside quotes."""
    now, closes = None, False
    for _, block, file, start, _, odd in _runs(batches):
        if now is None or now[0] != block:
            if now is not None:
                yield _fact(now, closes)
            now, closes = [block, file, start, 0, 0], False
        after = (now[3] + np.cumsum(odd)) & 1
        # a record begins behind a line that ends the quoted state; the split's last line has none behind it
        closes = closes or bool(now[4] and now[3]) or bool(after[:-1].any())
        now[3], now[4] = int(after[-1]), now[4] + len(odd)
    if now is not None:
        yield _fact(now, closes)


def _fact(now, closes):
    return pa.RecordBatch.from_pydict({"block": pa.array([now[0]], pa.int64()), "file": pa.array([now[1]], pa.int64()),
                                       "start": pa.array([now[2]], pa.int64()), "parity": pa.array([now[3]], pa.int32()),
                                       "closes": pa.array([closes])})


def _stitcher(shipped):
    """Splits -> records and pieces of records, given every split's state."""

    def run(batches):
        blocks, inside_at, owners = shipped.value
        now, held, held_odd, own, owner, first = None, [], 0, True, 0, False
        out = {c: [] for c in ("name", "record", "header", "file", "owner", "part", "whole")}

        def add(text, whole):
            for c, v in zip(out, (now[3], text, first, now[1], owner, now[2], whole)):
                out[c].append(v)

        def flush():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(out["name"], pa.string()), pa.array(out["record"], pa.string()), pa.array(out["header"], pa.bool_()),
                 *(pa.array(out[c], pa.int64()) for c in ("file", "owner", "part")), pa.array(out["whole"], pa.bool_())],
                list(out))
            for c in out.values():
                c.clear()
            return batch

        for lines, block, file, start, name, odd in _runs(batches):
            if now is None or now[0] != block:
                if held:
                    add("\n".join(held), False)
                now, held = (block, file, start, name), []
                at = int(np.searchsorted(blocks, block))
                if at == len(blocks) or blocks[at] != block:
                    raise ValueError("the files or their splits changed since the table was opened; read it again")
                held_odd = int(inside_at[at])
                own, first = not held_odd, start == 0
                owner = start if own else int(owners[at])
            after = (held_odd + np.cumsum(odd)) & 1
            for text, inside in zip(lines.to_pylist(), after.tolist()):
                held.append(text)
                if not inside:
                    add("\n".join(held) if len(held) > 1 else held[0], own)
                    first = first and len(held) == 1 and not text.strip("\r")  # blank lines may stand above the header
                    held, own, owner = [], True, start
            held_odd = int(after[-1])
            if out["record"]:
                yield flush()
        if held:
            add("\n".join(held), False)
        if out["record"]:
            yield flush()

    return run


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(name, record)``: the records of every file under ``path`` as text, headers left out.

    One cheap pass runs at once (the splits' quote parities); where records
    cross splits, those are joined and written to the session's shared
    folder. A record is held whole by one task, nothing larger is.
    """
    place = ("_metadata.file_path", "_metadata.file_block_start", "_metadata.file_block_length")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.xxhash64(*place).alias("block"), F.xxhash64(place[0]).alias("file"), F.col(place[1]).alias("start"),
        F.col("_metadata.file_name").alias("name"))
    facts = lines.mapInArrow(_parities, "block bigint, file bigint, start bigint, parity int, closes boolean")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # splits of one file
    inside = F.pmod(F.coalesce(F.sum("parity").over(before), F.lit(0)), F.lit(2))
    state = facts.withColumn("inside", inside)
    begins = (F.col("inside") == 0) | F.col("closes")
    owner = F.last(F.when(begins, F.col("start")), ignorenulls=True).over(before)
    ends = F.pmod(F.col("inside") + F.col("parity"), F.lit(2)).cast("int").alias("ends")
    state = state.select("block", F.col("inside").cast("int").alias("inside"), ends, F.coalesce(owner, F.lit(0)).alias("owner"))
    table = state.limit(MAX_BLOCKS + 1).toArrow()
    if table.num_rows > MAX_BLOCKS:
        raise ValueError(f"more than {MAX_BLOCKS} splits: raise spark.sql.files.maxPartitionBytes")
    at = np.argsort(table["block"].to_numpy())
    shipped = spark.sparkContext.broadcast((table["block"].to_numpy()[at], table["inside"].to_numpy()[at], table["owner"].to_numpy()[at]))
    cut = lines.mapInArrow(_stitcher(shipped), _RECORDS)
    whole = cut.where("whole and not header").select("name", "record")
    if not table["inside"].to_numpy().any():
        if not table["ends"].to_numpy().any():
            return whole
        # only a file's last, unclosed record is a piece
        return cut.where("not header").select("name", "record")
    ensure_checkpoint_dir(spark)
    pieces = cut.where("not whole").groupBy("file", "owner").agg(
        F.first("name").alias("name"), F.max("header").alias("header"),
        F.sort_array(F.collect_list(F.struct("part", "record"))).alias("p"))
    joined = pieces.where("not header").select("name", F.array_join("p.record", "\n").alias("record"))
    return whole.unionByName(joined.checkpoint())


def read_csv(spark: SparkSession, path: str, file: str) -> DataFrame:
    """The rows of CSV files with a header each, all columns as strings, with the file's name as column ``file``.

    Blank lines between records are skipped; a record with more or fewer
    fields than the header fails the job.
    """
    header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    names = [c.rstrip("\r") for c in header]
    schema = ", ".join(f"`{c.replace('`', '``')}` STRING" for c in names)
    text = F.regexp_replace("record", r"\r\z", "")
    rows = csv_records(spark, path).select(F.col("name"), text.alias("record")).where("record <> ''")
    row = F.from_csv("record", schema, {"mode": "FAILFAST", "escape": '"', "multiLine": "true"})
    return rows.select(row.alias("r"), F.col("name").alias(file)).select("r.*", file)
