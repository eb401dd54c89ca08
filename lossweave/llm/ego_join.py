"""Near-duplicate vectors by epsilon grid order join.

Unit vectors are turned to principal axes and laid on a grid of cell width
epsilon, the distance that the cosine threshold allows.  Sorted by their cells
on the leading axes, they form a sequence that is cut into blocks with bounding
boxes.  Intervals of blocks, then blocks, then halves of blocks are joined only
where their boxes are near enough; what is provably distant is never compared.
The axes are fitted on a bounded sample and steer only what can be skipped: the
result does not depend on them.

Equal vectors are one class from the start.  A pair of intervals is one group of
work: it gets each of its blocks once, for all block pairs between the two, and
sends a row per vector that it links, not per link.  Boxes have one coordinate
more than the grid, the length of what the leading axes leave out of a vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lossweave.llm.graph import components, forest
from lossweave.llm.staging import drop, stage

#: Leading axes of the grid, vectors of a block, of a leaf of the recursion, and of the axes' sample.
AXES, BLOCK, LEAF, SAMPLE = 6, 512, 128, 4096
#: Blocks of an interval at most, and their bytes; intervals whose boxes one task compares with all others.
INTERVAL, INTERVAL_BYTES, TOGETHER = 64, 16_000_000, 256
#: Coordinates of a box: the axes, and the length of the rest.
BOX = AXES + 1


def _axes(sample: list[list[float]]) -> dict[int, np.ndarray]:
    """Principal axes by dimension, from sampled vectors."""
    by: dict[int, list] = {}
    for v in sample:
        by.setdefault(len(v), []).append(v)
    out = {}
    for d, rows in by.items():
        x = np.array(rows, np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        _, vectors = np.linalg.eigh(np.cov(x.T, bias=True) if len(x) > 1 and d > 1 else np.eye(d))
        out[d] = np.ascontiguousarray(vectors[:, ::-1][:, :AXES])
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)
    x = x / top
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _project(u: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Coordinates on the leading axes and the length of what they leave out; no two rows are nearer than these are."""
    d = u.shape[1]
    c = u @ axes[d] if d in axes else u[:, :AXES]
    rest = np.sqrt(np.maximum(0.0, 1.0 - (c * c).sum(1, keepdims=True)))
    return np.hstack([np.pad(c, ((0, 0), (0, AXES - c.shape[1]))), rest])


def _by_dimension(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the vectors of each length."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    first = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, flat[first[at][:, None] + np.arange(d)]


def _lay(axes: dict[int, np.ndarray], eps: float):
    """Adds the cell key (big-endian, so that it sorts as the grid order) to classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [b""] * batch.num_rows
            for at, x in _by_dimension(batch.column(3)):
                cells = np.floor(_project(_unit(x.astype(np.float64)), axes)[:, :AXES] / eps).astype(np.int64)
                raw = (cells + 32768).astype(">u2").tobytes()
                for k, i in enumerate(at.tolist()):
                    keys[i] = raw[2 * AXES * k : 2 * AXES * (k + 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], ["label", "rep", "copies", "vector", "cell"])

    return run


_BLOCK = "label long, dim int, task long, number long, n int, lo array<double>, hi array<double>, blob binary"


def _cut(axes: dict[int, np.ndarray], kind):
    """Blocks of a task's sorted sequence, each of one label and dimension; vectors keep their ``kind`` of number."""

    def run(batches):
        from pyspark import TaskContext

        task, number = TaskContext.get(), 0
        task = task.partitionId() if task else 0
        held: list[tuple] = []  # (reps, copies, vectors) of the last label and dimension
        last = None

        def emit(size: int):
            nonlocal number, held
            reps, copies, x = (np.concatenate([h[k] for h in held]) for k in range(3))
            held = [(reps[size:], copies[size:], x[size:])]
            reps, copies, x = reps[:size], copies[:size], x[:size]
            c = _project(_unit(x.astype(np.float64)), axes)
            number += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary())
            row = (last[0], last[1], task, number - 1, len(reps), c.min(0).tolist(), c.max(0).tolist(), reps.tobytes() + copies.tobytes() + x.astype(kind).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], [f.split()[0] for f in _BLOCK.split(", ")])

        def count():
            return sum(len(h[0]) for h in held)

        for batch in batches:
            label, reps, copies = (batch.column(i).to_numpy().astype(np.int64) for i in range(3))
            for at, x in sorted(_by_dimension(batch.column(3)), key=lambda p: p[0][0]):
                edge = np.flatnonzero(np.append(True, label[at][1:] != label[at][:-1]))
                for a, b in zip(edge, np.append(edge[1:], len(at)), strict=True):
                    key, some = (int(label[at[a]]), x.shape[1]), at[a:b]
                    if key != last and count():
                        yield emit(count())
                    if key != last:
                        held, last = [], key
                    held.append((reps[some], copies[some], x[a:b]))
                    while count() >= BLOCK:
                        yield emit(BLOCK)
        if count():
            yield emit(count())

    return run


def _far(lo1, hi1, lo2, hi2) -> float:
    gap = np.maximum(0, np.maximum(lo2 - hi1, lo1 - hi2))
    return float((gap * gap).sum())


def links(x: np.ndarray, y: np.ndarray | None, cx: np.ndarray, cy: np.ndarray, cosine: float, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows whose cosine in double precision reaches the threshold; y None: pairs within x, once each."""
    self_join = y is None
    y, cy = (x, cx) if self_join else (y, cy)
    ux, uy = _unit(x), _unit(y)
    out_i, out_j, todo, limit = [], [], [(0, len(x), 0, len(y))], _limit(eps)
    while todo:
        a, b, c, d = todo.pop()
        if self_join and a >= d:
            continue
        if _far(cx[a:b].min(0), cx[a:b].max(0), cy[c:d].min(0), cy[c:d].max(0)) > limit:
            continue
        if b - a > LEAF or d - c > LEAF:
            if b - a >= d - c:
                m = (a + b) // 2
                todo += [(a, m, c, d), (m, b, c, d)]
            else:
                m = (c + d) // 2
                todo += [(a, b, c, m), (a, b, m, d)]
            continue
        cos = ux[a:b] @ uy[c:d].T
        i, j = np.nonzero(cos >= cosine - 1e-9)
        close = np.abs(cos[i, j] - cosine) < 1e-9
        i, j = i + a, j + c
        if close.any():  # on the edge: the quotient itself decides
            p, q = x[i[close]], y[j[close]]
            sure = (p * q).sum(1) / (np.sqrt((p * p).sum(1)) * np.sqrt((q * q).sum(1))) >= cosine
            keep = np.ones(len(i), bool)
            keep[np.flatnonzero(close)[~sure]] = False
            i, j = i[keep], j[keep]
        if self_join:
            i, j = i[i < j], j[i < j]
        out_i.append(i)
        out_j.append(j)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, int), np.zeros(0, int))


_LINKED = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _join(axes: dict[int, np.ndarray], cosine: float, eps: float, kind):
    """(rep, links, root) for each class that a pair of intervals links: copies it is linked to, smallest class it is joined with."""

    def opened(blob: bytes, n: int):
        x = np.frombuffer(blob, kind, offset=16 * n).astype(np.float64).reshape(n, -1)
        return np.frombuffer(blob, np.int64, n), np.frombuffer(blob, np.int64, n, 8 * n), x, _project(_unit(x), axes)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("second", "ascending"), ("task", "ascending"), ("number", "ascending")])
        second, n, blob = table["second"].to_pylist(), table["n"].to_pylist(), table["blob"]
        lo, hi = (np.array(table[c].to_pylist()) for c in ("lo", "hi"))
        of = [i for i, s in enumerate(second) if not s]
        with_ = [i for i, s in enumerate(second) if s] or of
        mine = {i: opened(blob[i].as_py(), n[i]) for i in of}
        base = np.cumsum([0, *n])
        reps = np.zeros(base[-1], np.int64)
        links_of = np.zeros(base[-1], np.int64)
        his, los = [], []
        for j in with_:  # one block of the other interval at a time
            r2, c2, y, cy = mine[j] if j in mine else opened(blob[j].as_py(), n[j])
            reps[base[j] : base[j + 1]] = r2
            for i in of:
                if with_ is of and i > j or _far(lo[i], hi[i], lo[j], hi[j]) > _limit(eps):
                    continue
                r1, c1, x, cx = mine[i]
                reps[base[i] : base[i + 1]] = r1
                a, b = links(x, None if i == j else y, cx, None if i == j else cy, cosine, eps)
                if len(a):
                    np.add.at(links_of, base[i] + a, c2[b])
                    np.add.at(links_of, base[j] + b, c1[a])
                    h, l = forest(r1[a], r2[b])
                    his.append(h)
                    los.append(l)
        at = np.flatnonzero(links_of)
        if not len(at):
            return _LINKED.empty_table()
        nodes, root = reps[at], reps[at].copy()
        h, l = forest(np.concatenate(his), np.concatenate(los))
        order = np.argsort(h)
        place = np.minimum(np.searchsorted(h[order], nodes), len(h) - 1)
        moved = h[order][place] == nodes
        root[moved] = l[order][place][moved]
        return pa.Table.from_arrays([pa.array(nodes), pa.array(links_of[at]), pa.array(root)], schema=_LINKED)

    return run


def _limit(eps: float) -> float:
    return eps * eps * (1 + 1e-6) + 1e-12


def _keyed(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """v with keys of its vectors, and (label, keys, rep, copies, vector) of each distinct one.

    Vectors are grouped by value.  The keys stand for them afterwards, once it is
    seen that no two of one label share theirs; else other keys are tried.
    """
    for seed in range(8):
        keyed = v.withColumns({"k1": F.xxhash64(F.lit(2 * seed), "vector"), "k2": F.xxhash64(F.lit(2 * seed + 1), "vector")})
        classes = stage(keyed.where("ok").groupBy("label", "k1", "k2", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
        if classes.groupBy("label", "k1", "k2").count().where("count > 1").isEmpty():
            return keyed, classes
    raise RuntimeError("different vectors share their 128-bit keys under every seed")


def near_duplicates(vectors: DataFrame, vec: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.93) -> DataFrame:
    """(vec, n_links, component_id, kept) per vector row.

    Vectors of one label and one length are linked if their cosine, in double
    precision from the numbers as given, is at least ``cosine``.  Null labels,
    null vectors, vectors without a component, zero vectors and those with a
    null, NaN or infinite component link with nothing.  Rows without an id link
    with nothing and are kept.  Repeated rows count as vectors of their own.
    Empty tables give no rows; extra columns are ignored.
    """
    spark = vectors.sparkSession
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-9
    single = vectors.schema[embedding].dataType.simpleString() == "array<float>"
    kind, number = (np.float32, "float") if single else (np.float64, "double")
    v = vectors.select(F.col(f"`{vec}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{embedding}`").cast(f"array<{number}>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.withColumn("ok", F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0), F.lit(False)))
    v, classes = _keyed(v)
    axes = _axes([r[0] for r in classes.select("vector", F.xxhash64("rep").alias("h")).orderBy("h").limit(SAMPLE).select("vector").collect()])
    laid = classes.select("label", "rep", "copies", "vector").mapInArrow(_lay(axes, eps), f"label long, rep long, copies long, vector array<{number}>, cell binary")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["label", F.size("vector"), "cell", "rep"]
    ordered = laid.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = stage(ordered.mapInArrow(_cut(axes, kind), _BLOCK), "blocks")
    per = F.greatest(F.lit(1), F.least(F.lit(INTERVAL), F.expr(f"{INTERVAL_BYTES} div ({BLOCK} * dim * {np.dtype(kind).itemsize})")))
    meta = blocks.select("label", "dim", "task", "number", "lo", "hi", F.struct("task", F.floor(F.col("number") / per).alias("at")).alias("run"))
    box = [F.min(F.col("lo")[i]).alias(f"l{i}") for i in range(BOX)] + [F.max(F.col("hi")[i]).alias(f"h{i}") for i in range(BOX)]
    runs = meta.groupBy("label", "dim", "run").agg(*box)
    runs = stage(runs.select("label", "dim", "run", F.array(*[f"l{i}" for i in range(BOX)]).alias("lo"), F.array(*[f"h{i}" for i in range(BOX)]).alias("hi")), "runs")

    def near(a, b):
        gap = sum((F.greatest(F.lit(0.0), F.col(f"{b}.lo")[i] - F.col(f"{a}.hi")[i], F.col(f"{a}.lo")[i] - F.col(f"{b}.hi")[i]) ** 2 for i in range(BOX)), F.lit(0.0))
        return gap <= _limit(eps)

    group = lambda a, b: (F.col(f"{a}.label") == F.col(f"{b}.label")) & (F.col(f"{a}.dim") == F.col(f"{b}.dim"))
    # A label's intervals are dealt to as many tasks as they need, each of which sees the boxes of all of them.
    shares = -(-runs.count() // TOGETHER)
    dealt = runs.withColumn("share", F.pmod(F.xxhash64("run"), F.lit(max(1, shares)))).alias("a")
    seen = runs.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, shares) - 1).cast("long")))).alias("b")
    wide = dealt.join(seen, group("a", "b") & (F.col("a.share") == F.col("b.share")) & (F.col("a.run") <= F.col("b.run")) & near("a", "b"))
    wide = wide.select("a.label", "a.dim", F.col("a.run").alias("run"), F.col("b.run").alias("with"))
    left = wide.join(meta, ["label", "dim", "run"]).select("label", "dim", "run", "with", "task", "number", "lo", "hi").alias("a")
    right = meta.withColumnRenamed("run", "with").alias("b")
    at = F.struct(F.col("a.task"), F.col("a.number")) <= F.struct(F.col("b.task"), F.col("b.number"))
    pairs = left.join(right, group("a", "b") & (F.col("a.with") == F.col("b.with")) & at & near("a", "b"))
    # What a pair of intervals needs: each block once.
    ends = F.explode(F.array(F.struct(F.col("a.task"), F.col("a.number"), F.lit(False).alias("second")), F.struct(F.col("b.task"), F.col("b.number"), (F.col("a.run") != F.col("b.with")).alias("second"))))
    needs = pairs.select(F.col("a.run").alias("run"), F.col("b.with").alias("with"), ends.alias("e")).select("run", "with", "e.*").distinct()
    both = stage(needs, "needs").join(blocks.select("task", "number", "n", "lo", "hi", "blob"), ["task", "number"])
    found = both.groupBy("run", "with").applyInArrow(_join(axes, cosine, eps, kind), "rep long, links long, root long")
    found = stage(found, "links")
    drop(blocks, runs)
    comp = components(found.where("rep <> root"), "rep", "root")
    info = classes.select("label", "k1", "k2", "rep", "copies").join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
    info = info.where("copies > 1 or links is not null").select("label", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component"), F.lit(True).alias("is"))
    out = v.select("id", "label", "k1", "k2", "ok").join(info.withColumnRenamed("is", "ok"), ["label", "k1", "k2", "ok"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(vec), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
