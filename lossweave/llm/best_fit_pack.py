"""Token ids packed into fixed rows by best-fit-decreasing with a segment tree.

Texts become token ids; documents longer than a row are split into full rows and
a remainder, which lose nothing.  Remainders are placed from the longest down,
each into the row whose free room fits it best, over the whole table: equal
lengths are placed together, so the driver needs the counts of at most ``row``
lengths and places them with a segment tree over capacities, whatever the number
of documents.  A remainder finds its row by its rank among those of its length.
Rows carry the packed ids, the cumulative lengths of their segments and
positions that start again at each segment; ``write`` puts them into files.

Ranks follow (length, document id, ids), so the rows do not depend on how the
input lies in files or partitions.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from lossweave.llm import textkernels as K
from lossweave.llm.staging import drop, stage

#: Ids in a row; rows in a written file.
ROW, FILE_ROWS = 4096, 16_384

SCHEMA = "row_id long, ids binary, positions binary, cu_seqlens array<int>, docs array<long>, pieces array<int>, n_tokens int"


class SegmentTree:
    """Ranges of open rows by their free room; finds the least room that is enough in O(log capacity)."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, first: int, rows: int) -> None:
        """Open ``rows`` rows from number ``first`` on; rows without room stay closed."""
        if not room or not rows:
            return
        self.ranges[room].append((first, rows))
        i = self.leaves + room
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int, int] | None:
        """(room, first, rows) of the fullest rows that still have ``need``, which leave the tree."""
        i, count = self.leaves + need, self.count
        while not count[i]:
            while i & 1:
                i >>= 1
            if i <= 1:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return room, *self.ranges[room].pop()


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Places counts[n] pieces of each length n (at most ``capacity``); (moves, number of rows).

    A move (length, first, count, each, row, offset) puts the pieces of a length
    ranked first..first+count-1 into consecutive rows from ``row`` on, ``each``
    to a row, from ``offset``.  That is best fit decreasing piece by piece: of
    equal pieces, as many go into one row as have room, for it stays the fullest.
    """
    tree, moves, rows = SegmentTree(capacity), [], 0
    for need in np.flatnonzero(counts)[::-1].tolist():
        rank, left = 0, int(counts[need])
        while left:
            found = tree.take(need)
            if found is None:
                many = -(-left // (capacity // need))
                found = (capacity, rows, many)
                rows += many
            room, first, many = found
            each = room // need
            for take, used in ((each, min(many, left // each)), (left % each, 1)):
                if used and take and left >= take and many:
                    moves.append((need, rank, take * used, take, first, capacity - room))
                    tree.put(room - take * need, first, used)
                    rank, left, first, many = rank + take * used, left - take * used, first + used, many - used
            tree.put(room, first, many)
    return np.array(moves, np.int64).reshape(-1, 6), rows


def byte_ids(texts: list[str]) -> list[np.ndarray]:
    """UTF-8 bytes as ids 0..255."""
    return [np.frombuffer(t.encode(), np.uint8).astype(np.uint16) for t in texts]


# Fixed value: how byte-level vocabularies of this kind split a text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def rank_file_ids(path: str, pattern: str = PIECES):
    """Encoder over a byte-level rank file ('token-in-base64 rank' lines): uint16, or uint32 if a rank is above 65,535.

    The driver reads the file, a few hundred kilobytes, and sends it with the
    task; each Python worker builds its tables once.  Such ids lose nothing:
    the tokens' bytes, joined, are the text's.
    """
    with open(path, "rb") as f:
        raw = f.read()
    held: list = []

    def encode(texts: list[str]) -> list[np.ndarray]:
        if not held:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
            held.append(np.uint16 if max(ranks.values()) < 1 << 16 else np.uint32)
            held.append(tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
        return [held[1].encode_to_numpy(t, disallowed_special=()).astype(held[0]) for t in texts]

    return encode


def _encode(encode):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x.itemsize for x in ids], pa.int32()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                    ["doc", "width", "n", "ids"])

    return run


def _number(row: int):
    """Numbers a task's sorted documents, and gives each the full rows before it."""

    def run(batches):
        from pyspark import TaskContext

        task, at, full = TaskContext.get(), 0, 0
        task = task.partitionId() if task else 0
        for batch in batches:
            whole = batch.column(2).to_numpy() // row
            before = full + np.cumsum(whole) - whole
            number = np.arange(at, at + batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.full(batch.num_rows, task, np.int64)), pa.array(number), pa.array(before)], ["doc", "width", "n", "ids", "task", "at", "full"])
            at, full = at + batch.num_rows, full + int(whole.sum())

    return run


_KINDS = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32()]
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _whole(row: int, tasks: np.ndarray, firsts: np.ndarray):
    """The full rows of long documents."""

    def run(batches):
        place = np.arange(row, dtype=np.uint16).tobytes()
        for batch in batches:
            for doc, width, n, ids, task, _, full in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                number, size = int(firsts[np.searchsorted(tasks, task)]) + full, row * width
                for a in range(0, n // row, 1024):
                    pieces = range(a, min(n // row, a + 1024))
                    k = len(pieces)
                    columns = ([number + p for p in pieces], [ids[p * size : (p + 1) * size] for p in pieces], [place] * k, [[0, row]] * k, [[doc]] * k, [[p] for p in pieces], [row] * k)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], _NAMES)

    return run


def _placed(row: int, runs: np.ndarray, moves: np.ndarray, full: int):
    """Remainders with their row and offset. ``runs`` (task, length, first number, first rank) is sorted, as is ``moves`` by length and rank."""

    def run(batches):
        order = np.lexsort((moves[:, 1], moves[:, 0]))
        m = moves[order]
        key = m[:, 0] << 44 | m[:, 1]
        of = runs[:, 0] * row + runs[:, 1]
        for batch in batches:
            n, task, at = (batch.column(i).to_numpy() for i in (2, 4, 5))
            size = n % row
            r = runs[np.searchsorted(of, task * row + size)]
            rank = r[:, 3] + at - r[:, 2]
            x = m[np.searchsorted(key, size << 44 | rank, "right") - 1]
            inner = rank - x[:, 1]
            ids = [b[-int(k) * w :] for b, k, w in zip(batch.column(3).to_pylist(), size, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full + x[:, 4] + inner // x[:, 3]), pa.array((x[:, 5] + inner % x[:, 3] * size).astype(np.int32)), batch.column(0), pa.array((n // row).astype(np.int32)), batch.column(1), pa.array(ids, pa.binary())],
                ["row_id", "offset", "doc", "piece", "width", "ids"])

    return run


def _assembled(row: int):
    """Rows from their remainders, which come sorted by row and offset."""

    def run(batches):
        out: list[list] = [[] for _ in _NAMES]
        held: list[tuple] = []

        def close():
            width = held[0][4]
            size = [len(h[5]) // width for h in held]
            cu = np.cumsum([0, *size])
            ids = b"".join(h[5] for h in held)
            place = np.zeros(row, np.uint16)
            place[: cu[-1]] = np.concatenate([np.arange(n, dtype=np.uint16) for n in size])
            row_of = (held[0][0], ids + bytes(row * width - len(ids)), place.tobytes(), cu.tolist(), [h[2] for h in held], [h[3] for h in held], int(cu[-1]))
            for c, v in zip(out, row_of, strict=True):
                c.append(v)
            held.clear()

        def batch_of():
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _KINDS, strict=True)], _NAMES)
            for c in out:
                c.clear()
            return made

        for batch in batches:
            for piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != piece[0]:
                    close()
                    if len(out[0]) == 512:
                        yield batch_of()
                held.append(piece)
        if held:
            close()
        if out[0]:
            yield batch_of()

    return run


def pack(docs: DataFrame, doc: str = "doc_id", text: str = "text", row: int = ROW, encode=byte_ids) -> DataFrame:
    """One row per packed sequence: ids and positions (``row`` each, zeros after n_tokens; little-endian uint16, ids in the encoder's type),
    cumulative segment lengths, and for each segment its document and the piece's number in it.

    Rows are numbered from 0: the full rows of long documents, then the packed
    ones.  Neither rows nor numbers depend on the partitions of docs.  Null and
    empty texts have no tokens and appear in no row.  Repeated rows and null ids
    are packed like others.  An empty table gives no rows; extra columns are
    ignored.  ``row`` is at most 65536.

    The driver holds the counts of the runs of one length in one task, at most
    tasks + ``row`` of them, and the moves that place them.
    """
    if not 1 <= row <= 65_536:
        raise ValueError("row must be in 1..65536")
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = docs.select(F.col(f"`{doc}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    ids = stage(d.mapInArrow(_encode(encode), "doc long, width int, n long, ids binary").where("n > 0").withColumn("tie", F.monotonically_increasing_id()), "ids")
    # Equal rows differ by their tie alone: they may stand for each other, and a range may be cut between them.
    order = [F.col("n") % row, "doc", F.xxhash64("ids"), "tie"]
    ordered = stage(ids.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("tie").mapInArrow(_number(row), "doc long, width int, n long, ids binary, task long, at long, full long"), "ordered")
    drop(ids)
    runs = ordered.groupBy("task", (F.col("n") % row).alias("size")).agg(F.count("*").alias("rows"), F.min("at").alias("first"), F.sum(F.expr(f"n div {row}")).alias("full")).orderBy("task", "size").toArrow()
    task, size, rows, first, full = (runs[c].to_numpy().astype(np.int64) for c in ("task", "size", "rows", "first", "full"))
    counts = np.zeros(row, np.int64)
    np.add.at(counts, size, rows)
    counts[0] = 0
    moves, _ = best_fit_decreasing(counts, row)
    rank = np.zeros(len(size), np.int64)
    by = np.lexsort((task, size))
    rank[by] = np.cumsum(rows[by]) - rows[by]
    starts = np.concatenate([[0], np.cumsum(np.bincount(size, weights=rows, minlength=row))])[:-1].astype(np.int64)
    rank -= starts[size]
    tasks, at = np.unique(task, return_inverse=True)
    fulls = np.bincount(at, weights=full, minlength=len(tasks)).astype(np.int64)
    firsts = np.cumsum(fulls) - fulls
    whole = ordered.where(F.col("n") >= row).mapInArrow(_whole(row, tasks, firsts), SCHEMA)
    table = np.stack([task, size, first, rank], axis=1)
    rest = ordered.where(F.col("n") % row > 0).mapInArrow(_placed(row, table, moves, int(full.sum())), "row_id long, offset int, doc long, piece int, width int, ids binary")
    packed = rest.repartition(parts, "row_id").sortWithinPartitions("row_id", "offset").mapInArrow(_assembled(row), SCHEMA)
    return whole.unionByName(packed)


#: What is known of a written file: its name without ending, its rows, ids in a row and bytes of an id.
INDEX = "name string, rows long, row int, width int"


def _files(path: str, limit: int):
    """Writes a task's rows to files of at most ``limit`` rows; gives their index."""

    def run(batches):
        place, root = fs.FileSystem.from_uri(path)
        place.create_dir(root, recursive=True)
        for batch in _cut(batches, limit):
            name, rows, entries, shape = uuid.uuid4().hex, 0, 0, None
            with ExitStack() as close:
                out = {k: close.enter_context(place.open_output_stream(f"{root}/{name}.{k}")) for k in ("ids", "positions", "cu", "cu_at", "row")}
                for part in batch:
                    (ids, off), (positions, upto), cu = K.utf8(part.column(1)), K.utf8(part.column(2)), part.column(3)
                    sizes = np.unique(np.stack([np.diff(off), np.diff(upto)], 1), axis=0).tolist()
                    shape = shape or sizes[0]
                    if sizes != [shape]:
                        raise ValueError("rows of different sizes cannot share a matrix")
                    counts = cu.value_lengths().to_numpy()
                    out["ids"].write(ids.tobytes())
                    out["positions"].write(positions.tobytes())
                    out["cu"].write(cu.flatten().to_numpy().astype("<i4").tobytes())
                    out["cu_at"].write((entries + np.cumsum(counts) - counts).astype("<i8").tobytes())
                    out["row"].write(part.column(0).to_numpy().astype("<i8").tobytes())
                    rows, entries = rows + part.num_rows, entries + int(counts.sum())
                out["cu_at"].write(np.array([entries], "<i8").tobytes())
            row = shape[1] // 2
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows], pa.int64()), pa.array([row], pa.int32()), pa.array([shape[0] // row], pa.int32())], ["name", "rows", "row", "width"])

    return run


def _cut(batches, limit: int):
    """Batches dealt into runs of ``limit`` rows, as iterators that are to be used up in order."""
    left = (b for b in batches if b.num_rows)
    held: list[pa.RecordBatch] = []

    def some():
        room = limit
        while room:
            b = held.pop() if held else next(left, None)
            if b is None:
                return
            if b.num_rows > room:
                held.append(b.slice(room))
                b = b.slice(0, room)
            room -= b.num_rows
            yield b

    while True:
        if not held:
            b = next(left, None)
            if b is None:
                return
            held.append(b)
        yield some()


def write(rows: DataFrame, path: str, file_rows: int = FILE_ROWS) -> DataFrame:
    """Packed rows as matrices in raw little-endian files under ``path``; returns their index, kept as ``path``/index.

    A file ``name`` has the parts ``.ids`` (rows x row numbers of ``width``
    bytes), ``.positions`` (rows x row uint16), ``.cu`` (int32: the cumulative
    segment lengths of its rows one after another), ``.cu_at`` (int64: where each
    row's begin there, and their number) and ``.row`` (int64 row ids).

    ``path`` is a location that Spark and pyarrow's file systems both know and
    that all executors share.  Rows move nowhere; a task holds one batch.  Each
    attempt of a task writes files of its own, and only those of attempts that
    succeeded are in the index: others are left over and may be deleted.  An
    existing index is an error.  An empty table gives an empty index; rows of
    different sizes fail.
    """
    if "://" not in path and not path.startswith("/"):
        raise ValueError("path must be absolute or have a scheme")
    spark = rows.sparkSession
    rows.select("row_id", "ids", "positions", "cu_seqlens").mapInArrow(_files(path, file_rows), INDEX).write.parquet(f"{path}/index")
    return spark.read.schema(INDEX).parquet(f"{path}/index")
