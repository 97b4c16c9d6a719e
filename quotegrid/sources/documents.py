"""Single JSON documents of any size, read by byte ranges.

A catalogue comes as one document (``{"shows": [...], ...}``), often as one line,
so nothing cuts it for Spark. Here the text reader cuts it after closing braces,
wherever they stand: Spark's own file splits do, so a document is read by as many
tasks as it has blocks. Each block says what it does to the nesting depth if it
starts inside a string and if it doesn't; put together in order, these give every
block its real start; then each block cuts out the members of a list that begin
in it, and the few that reach over a block's end are put together by a shuffle.

What the driver holds is a few rows for each block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import stage

c = F.col
CUT = "}"
_NAME = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')
#: Bytes before a list in which its name is looked for.
NAME_BYTES = 1024
PIECES = "file string, start long, name string, i long, whole boolean, body string"
#: Numbers of pieces that are no member's beginning: what goes on from the block before, and what a block says of its end.
TAIL, END = -1, -2


def brackets(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Where brackets stand outside strings, what each does to the depth, and
    whether the end is inside a string. ``inside``: whether the beginning is."""
    quotes = np.flatnonzero(data == 34)
    slashes = data == 92
    if slashes.any():
        plain = np.maximum.accumulate(np.where(slashes, -1, np.arange(len(data))))
        before = np.where(quotes > 0, plain[quotes - 1], -1)
        quotes = quotes[(quotes - before) % 2 == 1]  # after an even number of backslashes
    at = np.flatnonzero((data == 123) | (data == 125) | (data == 91) | (data == 93))
    at = at[(np.searchsorted(quotes, at) + inside) % 2 == 0]
    return at, np.where((data[at] == 123) | (data[at] == 91), 1, -1), bool((len(quotes) + inside) % 2)


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes, bool]]:
    """(block, text, last) of each batch's rows; the delimiter is put back, but for blanks at a file's end."""
    held: tuple[tuple[str, int], list[bytes], bool] | None = None
    for batch in batches:
        rows = zip(batch.column("value").to_pylist(), batch.column("file").to_pylist(), batch.column("start").to_pylist(), batch.column("ends").to_pylist())
        for value, file, start, ends in rows:
            if held and held[0] != (file, start):
                yield _closed(held, True)
                held = None
            if held is None:
                held = (file, start), [], ends
            held[1].append(value.encode())
        if held and len(held[1]) > 1:  # the last row waits: it may end its file
            yield held[0], b"".join(x + b"}" for x in held[1][:-1]), False
            held = held[0], held[1][-1:], held[2]
    if held:
        yield _closed(held, True)


def _closed(held, last: bool) -> tuple[tuple[str, int], bytes, bool]:
    block, texts, ends = held
    out = b"".join(x + b"}" for x in texts[:-1])
    return block, out if ends and not texts[-1].strip() else out + texts[-1] + b"}", last


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and either beginning: how the depth changes, and whether it ends in a string."""
    state = None
    for block, text, last in _fragments(batches):
        if state is None:
            state = [[0, False], [0, True]]
        data = np.frombuffer(text, np.uint8)
        for s in state:
            _, deltas, s[1] = brackets(data, s[1])
            s[0] += int(deltas.sum())
        if last:
            row = [*block, *state[0], *state[1]]
            state = None
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["file", "start", "depth0", "inside0", "depth1", "inside1"])


def _pieces(starts: dict[tuple[str, int], tuple[int, bool]], field: str, at: int):
    """Cuts blocks, whose beginnings are known, into members of lists at depth ``at``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, out = None, []
        for key, text, last in _fragments(batches):
            if block != key:
                block, (depth, inside) = key, starts[key]
                name, i, held, opened = None, 0, [], depth > at  # name: null while it is that of the block before
                begun = None
            data = np.frombuffer(text, np.uint8)
            place, deltas, inside = brackets(data, inside)
            after = depth + np.cumsum(deltas)
            depth = int(after[-1]) if len(after) else depth
            begin = 0
            up = deltas > 0
            events = np.flatnonzero((up & ((after == at) | (after == at + 1))) | (~up & ((after == at) | (after == at - 1))))
            for p, d, a in zip(place[events].tolist(), up[events].tolist(), after[events].tolist()):
                if d and a == at + 1:
                    begin, opened, begun, held = p, True, i, []
                    i += 1
                elif not d and a == at:
                    if name is None or name == field:
                        body = b"".join((*held, text[begin : p + 1])).decode()
                        out.append((*key, name, TAIL if begun is None else begun, begun is not None, body))
                    opened, held, begun = False, [], None
                elif d:
                    found = _NAME.search(text[max(0, p - NAME_BYTES) : p])
                    name, i = found[1].decode() if found and text[p : p + 1] == b"[" else "", 0
                else:
                    name, i = "", 0
            if opened:
                held.append(text[begin:])
            if last:
                if opened and (name is None or name == field):
                    out.append((*key, name, TAIL if begun is None else begun, False, b"".join(held).decode()))
                out.append((*key, name, END, opened, "" if begun is None else str(begun)))
                block = None
            if len(out) >= 4096 or last:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string()))], ["file", "start", "name", "i", "whole", "body"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string()))], ["file", "start", "name", "i", "whole", "body"])

    return rows


def read_members(spark: SparkSession, path: str, field: str = "shows", at: int = 2) -> DataFrame:
    """(pos, body) of the objects in a document's list ``field``, in its order:
    place and JSON text. The document is a file, or a folder whose files stand on
    end by name. at: the depth of the list (2: inside the outermost object). A
    field that is missing, or isn't a list, gives no rows; members that are no
    objects or lists aren't counted.
    """
    read = spark.read.option("lineSep", CUT).text(path)
    m = "_metadata.file_"
    lines = read.select("value", c(f"{m}path").alias("file"), c(f"{m}block_start").alias("start"), (c(f"{m}block_start") + c(f"{m}block_length") >= c(f"{m}size")).alias("ends"))
    blocks = sorted(tuple(r) for r in lines.mapInArrow(_summaries, "file string, start long, depth0 long, inside0 boolean, depth1 long, inside1 boolean").collect())
    starts, depth, inside = {}, 0, False
    for file, start, *ends in blocks:
        starts[file, start] = depth, inside
        more, inside = ends[2:] if inside else ends[:2]
        depth += more
    pieces = stage(lines.mapInArrow(_pieces(starts, field, at), PIECES))
    place = spark.createDataFrame(_places(blocks, pieces, field), "file string, start long, name string, n long, base long, tail long")
    known = pieces.where(c("i") != END).join(F.broadcast(place), (pieces["file"] == place["file"]) & (pieces["start"] == place["start"]) & pieces["name"].eqNullSafe(place["name"]))
    pos = F.when(c("i") == TAIL, c("tail")).otherwise(c("base") + c("i"))
    found = known.select(pos.alias("pos"), "n", "whole", "body").where("pos is not null")
    cut = found.where("not whole").groupBy("pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "body"))), lambda x: x["body"]), "").alias("body"))
    return found.where("whole").select("pos", "body").unionByName(cut)


def _places(blocks: list[tuple], pieces: DataFrame, field: str) -> list[tuple]:
    """For each block and list name of its pieces: the block's number, how many
    members of ``field`` come before, and the member that goes on from before. Null places are other lists'."""
    ends, counts = {}, {}
    for r in pieces.groupBy("file", "start", "name", (c("i") == END).alias("end")).agg(F.max("i").alias("i"), F.max("whole").alias("whole"), F.max("body").alias("body")).collect() if blocks else ():
        if r["end"]:
            ends[r.file, r.start] = r.name, r.whole, r.body
        else:
            counts[r.file, r.start, r.name] = max(r.i + 1, 0)
    out, total, current, open_one = [], 0, "", None
    for n, (file, start, *_) in enumerate(blocks):
        name, opened, begun = ends[file, start]
        own = current == field
        inherited = total if own else None
        out.append((file, start, None, n, inherited, open_one))
        if own:
            total += counts.get((file, start, None), 0)
        named = None
        if (file, start, field) in counts:
            named = total
            out.append((file, start, field, n, named, None))
            total += counts[file, start, field]
        current = name if name is not None else current
        if not opened or current != field:
            open_one = None
        elif begun:
            open_one = (inherited if name is None else named) + int(begun)
    return out


def write_document(rows: DataFrame, path: str, order: str, field: str = "shows") -> None:
    """One document ``{field: [null, ...]}`` of all rows as JSON objects, sorted, by
    as many tasks as Spark likes: a folder whose files stand on end by name."""
    body = F.to_json(F.struct(*[x for x in rows.columns if x != order]))
    each = rows.select(c(order), F.lit(1).alias("kind"), F.concat(F.lit(","), body).alias("value"))
    schema = each.schema[order].dataType
    head = rows.sparkSession.range(1).select(F.lit(None).cast(schema).alias(order), F.lit(0).alias("kind"), F.lit(f'{{"{field}":[null').alias("value"))  # so every file ends with a brace
    last = head.select(order, F.lit(2).alias("kind"), F.lit('],"written":{}}').alias("value"))
    each.unionByName(head).unionByName(last).repartitionByRange("kind", order).sortWithinPartitions("kind", order).select("value").write.text(path)
