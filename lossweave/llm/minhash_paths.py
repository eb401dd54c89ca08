"""Near-duplicate documents by chosen-path set similarity join over minwise tokens.

Documents with one and the same shingle set are one class from the start, so a
group of exact copies costs one row.  Each class carries a vector of minwise
tokens.  In several independent trees, classes branch into nodes by the tokens
at coordinates that the node's own path chooses (1 / similarity branches on
average, so two similar classes keep meeting); a node that is small enough is
compared exhaustively, a larger one branches again.  The deeper nodes lie, the
more trees the classes of large nodes get.  Nodes that stay large down to the
last level are cut into blocks, which are compared within.  What that leaves in
different components is compared across blocks: those of one component never
meet each other, so that work follows what is unresolved, not a node's square.

Candidates are confirmed on full shingle sets.  First each class is confirmed
against its most similar partner in the node.  Where these links leave
candidates in different components, the classes concerned bring their sets to
the node, which compares them all and sends a forest of the links it finds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lossweave.llm import textkernels as K
from lossweave.llm.graph import components, forest
from lossweave.llm.staging import drop, fresh, stage

#: Minwise tokens of a class, least independent trees, largest node that is compared as one, and levels.
TOKENS, TREES, NODE, LEVELS = 64, 16, 2048, 12
#: Probability with which a pair of just the similarity asked for meets in a node of some tree, at any depth.
RECALL = 0.999
#: Agreeing tokens from which a pair is confirmed: 4.5 standard deviations below the threshold's mean.
SLACK = 4.5

_ODD = K.mix(np.arange(TOKENS, dtype=np.uint64), 11) | np.uint64(1)
_SIGNED = "doc long, n long, k1 long, k2 long, sig binary"


def signer(shingle: int):
    """Maps (doc, text) to set size, two sums over mixed shingle hashes that identify the set, and minwise tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.utf8(batch.column(1))
            for i, j in K.slices(off, 3_000_000):
                h, first = K.shingle_sets(K.LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i], shingle)
                n = np.diff(first)
                some = np.flatnonzero(n)
                at = first[:-1][some]
                keys = np.zeros((2, len(n)), np.uint64)
                sig = np.zeros((len(n), TOKENS), np.uint32)
                if len(some):
                    for r in (0, 1):
                        keys[r, some] = np.add.reduceat(K.mix(h, 3 + r), at)
                    for r in range(TOKENS):
                        sig[some, r] = np.minimum.reduceat(h * _ODD[r], at).astype(np.uint32)
                raw = pa.py_buffer(sig.tobytes())
                bounds = pa.py_buffer((np.arange(len(n) + 1, dtype=np.int32) * (4 * TOKENS)).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), pa.Array.from_buffers(pa.binary(), len(n), [None, bounds, raw])],
                    ["doc", "n", "k1", "k2", "sig"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]].view(np.uint32).reshape(len(column), TOKENS)


def _children(path: np.ndarray, sig: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) of each branch a row takes: one coordinate, or two as often as the similarity asks for."""
    rows = np.arange(len(path))
    choice = K.mix(path, 21)
    twice = (K.mix(path, 22) >> np.uint64(40)).astype(np.float64) / 2.0**24 < 1 / similarity - 1
    c1 = (choice % np.uint64(TOKENS)).astype(np.int64)
    c2 = (c1 + 1 + ((choice >> np.uint64(32)) % np.uint64(TOKENS - 1)).astype(np.int64)) % TOKENS
    out = []
    for c, of in ((c1, rows), (c2, rows[twice])):
        token = sig[of, c[of]].astype(np.uint64) | (c[of].astype(np.uint64) << np.uint64(32))
        out.append((of, K.mix(path[of] ^ K.mix(token, 23), 24)))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _least(similarity: float) -> int:
    return int(np.floor(TOKENS * similarity - SLACK * np.sqrt(TOKENS * similarity * (1 - similarity))))


def trees_for(depth: int, similarity: float, trees: int = TREES) -> int:
    """Trees, ``trees`` at least, in which a pair of this similarity meets ``depth`` branchings down with probability RECALL.

    A pair agrees in a binomial number of its tokens; given that, a tree is a
    branching process that dies out at a known rate.
    """
    twice, apart = min(1.0, 1 / similarity - 1), []
    for k in range(max(1, _least(similarity)), TOKENS + 1):
        gone = 0.0
        for _ in range(depth):
            y = 1 - k / TOKENS * (1 - gone)
            gone = y * (1 - twice + twice * y)
        apart.append((comb(TOKENS, k) * similarity**k * (1 - similarity) ** (TOKENS - k), gone))
    while sum(w * gone**trees for w, gone in apart) > 1 - RECALL:
        trees += 1
    return trees


def _roots(similarity: float, trees: range):
    def run(batches):
        for batch in batches:
            sig = _matrix(batch.column(1))
            if not len(sig):
                continue
            rep = batch.column(0).to_numpy()
            for tree in trees:
                of, path = _children(np.full(len(sig), K.mix(np.array([tree], np.uint64), 25)[0]), sig, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(rep[of])], ["path", "rep"])

    return run


def _branches(similarity: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                of, path = _children(batch.column(0).to_numpy().view(np.uint64), _matrix(batch.column(3)), similarity)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), *[batch.column(i).take(pa.array(of)) for i in (1, 2, 3)]], ["path", "rep", "n", "sig"])

    return run


def _by_node(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Whole nodes of rows that come sorted by path, about ``rows`` at a time."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows < rows:
            continue
        path = held["path"].to_numpy()
        before = np.flatnonzero(path != path[-1])
        if len(before):  # the last node may go on in the next batch
            yield held.slice(0, int(before[-1]) + 1).combine_chunks()
            held = held.slice(int(before[-1]) + 1)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _pairs(similarity: int, whole: bool):
    """Candidates of rows that come sorted by node: each row's best earlier partner as (a, b).

    whole: instead, the rows that have a candidate in another component, as (path, rep, n, comp).  Their path
    is a hash of the node's rows so marked: nodes of several trees that mark the same rows are one.
    """
    least = _least(similarity / 100)

    def of(path, block, rep, n, sig, comp, mark):
        new = np.ones(len(path), bool)
        new[1:] = path[1:] != path[:-1]
        ends = np.append(np.flatnonzero(new)[1:], len(path))[np.cumsum(new) - 1]
        counts = ends - np.arange(len(path)) - 1
        total = np.concatenate([[0], np.cumsum(counts)])
        partner, score = np.full(len(path), -1), np.zeros(len(path), np.int64)
        v = 0
        while v < len(path):
            u, v = v, max(v + 1, int(np.searchsorted(total, total[v] + 100_000, "right")) - 1)
            i = np.repeat(np.arange(u, v), counts[u:v])
            j = i + 1 + K.ranges(counts[u:v])
            ok = (100 * np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])) & (rep[i] != rep[j]) & (comp[i] != comp[j])
            ok &= (block[i] != block[j]) | (block[i] == 0)
            i, j = i[ok], j[ok]
            same = np.zeros(len(i), np.int64)
            for s in range(0, len(i), 50_000):
                same[s : s + 50_000] = (sig[i[s : s + 50_000]] == sig[j[s : s + 50_000]]).sum(1)
            ok = same >= least
            i, j, same = i[ok], j[ok], same[ok]
            if whole:
                mark[i] = mark[j] = True
                continue
            if len(j):
                order = np.lexsort((-same, j))
                j, i = j[order], i[order]
                first = np.ones(len(j), bool)
                first[1:] = j[1:] != j[:-1]
                i, j = i[first], j[first]
                better = same[order][first] > score[j]
                partner[j[better]], score[j[better]] = i[better], same[order][first][better]
        j = np.flatnonzero(partner >= 0)
        if len(j):
            yield np.minimum(rep[partner[j]], rep[j]), np.maximum(rep[partner[j]], rep[j])

    def run(batches):
        for t in _by_node(batches, 4096):
            path, block, rep, n, comp = (t[c].to_numpy() for c in ("path", "block", "rep", "n", "comp"))
            mark = np.zeros(len(path), bool)
            for a, b in of(path, block, rep, n, _matrix(t["sig"].chunk(0)), comp, mark):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            if mark.any():
                path, rep, n, comp = path[mark], rep[mark], n[mark], comp[mark]
                head = np.append(True, path[1:] != path[:-1])
                key = K.mix(np.add.reduceat(K.mix(rep.view(np.uint64), 26), np.flatnonzero(head)), 27).view(np.int64)[np.cumsum(head) - 1]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, rep, n, comp)], ["path", "rep", "n", "comp"])

    return run


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairs' intersections, by products of incidence matrices over the shingles that two sets or more hold."""
    m = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    common = np.bincount(column)[column] > 1
    owner, column = owner[common], column[common]
    out = np.zeros((m, m), np.float32)  # exact up to 2**24 shingles
    if not len(column):
        return out
    column = np.cumsum(np.diff(column, prepend=column[0]) != 0)
    width = min(int(column[-1]) + 1, max(256, 2_000_000 // m))
    for a in range(0, int(column[-1]) + 1, width):
        s = slice(*np.searchsorted(column, (a, a + width)))
        incidence = np.zeros((m, width), np.float32)
        incidence[owner[s], column[s] - a] = 1
        out += incidence @ incidence.T
    return out


def _exhaust(similarity: int):
    """Links between different components of a node, as a forest."""

    def run(batches):
        for t in _by_node(batches, 256):
            path, rep, n, comp = (t[c].to_numpy() for c in ("path", "rep", "n", "comp"))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["set"].chunk(0)]
            edge = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
            for u, v in zip(edge, np.append(edge[1:], len(path)), strict=True):
                if v - u < 2:
                    continue
                both = _shared(sets[u:v])
                size = n[u:v].astype(np.float64)
                ok = (100 * both.astype(np.float64) >= similarity * (size[:, None] + size[None, :] - both)) & (comp[u:v, None] != comp[None, u:v])
                i, j = np.nonzero(np.triu(ok, 1))
                if len(i):
                    hi, lo = forest(rep[u:v][i], rep[u:v][j])
                    yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], ["a", "b"])

    return run


def _sets(shingle: int, bits: np.ndarray):
    """Full shingle sets of the documents whose bit is set."""
    mask = np.uint64(64 * len(bits) - 1)

    def run(batches):
        for batch in batches:
            h = batch.column(2).to_numpy().view(np.uint64) & mask
            at = np.flatnonzero((bits[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1))
            if not len(at):
                continue
            batch = batch.take(pa.array(at))
            data, off = K.utf8(batch.column(1))
            for i, j in K.slices(off, 3_000_000):
                s, first = K.shingle_sets(K.LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i], shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array([s[first[x] : first[x + 1]].tobytes() for x in range(j - i)], pa.binary())], ["rep", "set"])

    return run


def _confirm(similarity: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ok = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * shared >= similarity * (len(both) - shared)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    return run


def _full_sets(docs: DataFrame, reps: DataFrame, shingle: int) -> DataFrame:
    """(rep, set) of the named documents, staged.

    A bit table of at most 8 MB (2**26 bits, whatever the corpus) keeps most
    other documents from being cut into shingles again; joins on rep are exact.
    """
    n = reps.count()
    size = 1 << min(26, max(16, (16 * n).bit_length()))
    h = F.xxhash64("rep")
    words = reps.groupBy(F.shiftrightunsigned(h.bitwiseAND(size - 1), 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(xxhash64(rep) & 63 as int))")).alias("v"))
    bits = np.zeros(size // 64, np.uint64)
    table = words.toArrow()
    bits[table["w"].to_numpy()] = table["v"].to_numpy().view(np.uint64)
    return stage(docs.withColumn("h", F.xxhash64("doc")).mapInArrow(_sets(shingle, bits), "rep long, set binary"), "sets")


def _confirmed(docs: DataFrame, pairs: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    sets = _full_sets(docs, pairs.select("a").union(pairs.select("b")).toDF("rep").distinct(), shingle)
    left = pairs.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("sa")), "a")
    both = left.join(sets.select(F.col("rep").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb")
    links = stage(both.mapInArrow(_confirm(similarity), "a long, b long"), "links")
    drop(sets)
    return links


def _with_component(rows: DataFrame, comp: DataFrame) -> DataFrame:
    return rows.join(comp, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "rep")).drop("node", "component")


def _unresolved(heap: DataFrame, half: int) -> DataFrame:
    """Rows of large nodes for all pairs of blocks that may hold a link between components: (path, block, rep, n, sig, comp).

    A component of ``half`` rows or more has blocks of its own, all others share
    blocks.  Shared blocks meet all blocks of their node, a large component's meet
    those of other large components; a row is copied as often as its block meets
    one.  Two blocks of one component do not meet.
    """
    sizes = heap.groupBy("path", "comp").agg(F.count("*").alias("rows"))
    shared = sizes.where(F.col("rows") < half).groupBy("path").agg(F.sum("rows").alias("shared"))
    rows = heap.join(sizes, ["path", "comp"]).join(shared, "path", "left").withColumn("large", F.col("rows") >= half)
    number = F.when(F.col("large"), F.pmod(F.xxhash64("rep"), F.ceil(F.col("rows") / half))).otherwise(F.pmod(F.xxhash64("comp"), F.ceil(F.col("shared") / half)))
    rows = rows.withColumn("at", F.struct("large", F.when(F.col("large"), F.col("comp")).alias("of"), number.alias("number")))
    blocks = rows.select("path", "at").distinct()
    mixed, own = blocks.where("not at.large").withColumnRenamed("at", "a"), blocks.where("at.large")
    meet = mixed.join(blocks.withColumnRenamed("at", "b"), "path").where("b.large or a.number <= b.number").select("path", "a", "b")
    large = own.select("path", F.col("at.of").alias("of")).distinct()
    two = large.withColumnRenamed("of", "one").join(large.withColumnRenamed("of", "other"), "path").where("one < other")
    side = lambda name, to: own.select("path", F.col("at.of").alias(name), F.col("at").alias(to))
    meet = meet.union(two.join(side("one", "a"), ["path", "one"]).join(side("other", "b"), ["path", "other"]).select("path", "a", "b"))
    name, same = F.xxhash64("path", "a", "b"), F.col("a") == F.col("b")
    ends = F.when(same, F.array(F.struct(F.col("a").alias("at"), F.lit(0).alias("block")))).otherwise(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("block")), F.struct(F.col("b").alias("at"), F.lit(2).alias("block"))))
    asked = meet.select("path", name.alias("meeting"), F.explode(ends).alias("e")).select("path", "meeting", "e.at", "e.block")
    return rows.select("path", "at", "rep", "n", "sig", "comp").join(asked, ["path", "at"]).select(F.col("meeting").alias("path"), "block", "rep", "n", "sig", "comp")


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = 5, similarity: int = 80, trees: int = TREES, node: int = NODE, levels: int = LEVELS) -> DataFrame:
    """(doc, n_shingles, component_id, kept) per document row.

    Words are [^ASCII white space]+ after lower-casing A-Z; a document's set has
    its distinct shingles, or its whole sequence if it has fewer words.  Sets are
    linked if 100 * intersection >= similarity * union.  Null, empty and wordless
    texts have no set, link with nothing and are kept.  A row without an id is
    left unlinked and kept; rows with one id are one document.  Repeated rows
    each get a row.  An empty table gives none.  Extra columns are ignored.
    """
    d = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    signed = stage(d.mapInArrow(signer(shingle), _SIGNED), "signed")
    classes = stage(signed.where("n > 0 and doc is not null").groupBy("k1", "k2", "n").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig")), "classes")
    p = similarity / 100
    parts, heaps, some, heavy, done, want = [], [], classes, None, 0, trees_for(1, p, trees)
    spent: list[DataFrame] = []  # staged tables that nothing reads once the components are known
    half = max(1, node // 2)
    while done < want:
        # Light rows first: most paths hold one class and go before tokens are attached.
        light = stage(some.select("rep", "sig").mapInArrow(_roots(p, range(done, want)), "path long, rep long").distinct(), "paths")
        sizes = light.groupBy("path").count().where("count > 1")
        spent.append(light)
        rows = light.join(sizes, "path").join(some.select("rep", "n", "sig"), "rep").select("path", "rep", "n", "sig", F.col("count").alias("size"))
        for level in range(levels):
            rows = stage(rows, "nodes")
            spent.append(rows)
            parts.append(rows.where(F.col("size") <= node).select("path", F.lit(0).alias("block"), "rep", "n", "sig"))
            large = rows.where(F.col("size") > node).select("path", "rep", "n", "sig")
            if large.isEmpty():
                break
            if done == 0 and level == 0:
                heavy = large
            if level == levels - 1:
                heaps.append(rows.where(F.col("size") > node).select("path", "rep", "n", "sig", "size"))
                break
            child = stage(large.mapInArrow(_branches(p), "path long, rep long, n long, sig binary").dropDuplicates(["path", "rep"]), "children")
            spent.append(child)
            rows = child.join(child.groupBy("path").count().where("count > 1"), "path").select("path", "rep", "n", "sig", F.col("count").alias("size"))
        done, want = want, trees_for(level + 1, p, want)
        if done < want and some is classes:  # only classes of nodes that branched can have parted this deep
            some = stage(classes.join(heavy.select("rep").distinct(), "rep", "left_semi"), "heavy")
            spent.append(some)
    nodes, heap = reduce(DataFrame.union, parts), reduce(DataFrame.union, heaps) if heaps else None
    own = F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / half))

    def candidates(comp: DataFrame | None) -> DataFrame:
        if comp is None:
            n = nodes if heap is None else nodes.union(heap.select(F.xxhash64("path", own), F.lit(0), "rep", "n", "sig"))
            n = n.withColumn("comp", F.col("rep"))
        else:
            n = _with_component(nodes, comp)
            n = n if heap is None else n.unionByName(_unresolved(stage(_with_component(heap, comp), "heaps"), half))
        n = n.select("path", "block", "rep", "n", "sig", "comp").repartition("path").sortWithinPartitions("path")
        return n.mapInArrow(_pairs(similarity, comp is not None), "a long, b long" if comp is None else "path long, rep long, n long, comp long")

    links = _confirmed(d, stage(candidates(None).distinct(), "pairs"), shingle, similarity)
    comp = stage(components(links, "a", "b"), "components")
    rest = stage(candidates(comp).dropDuplicates(["path", "rep"]), "rest")
    if not rest.isEmpty():
        sets = _full_sets(d, rest.select("rep").distinct(), shingle)
        whole = rest.join(sets, "rep").select("path", "rep", "n", "comp", "set").repartition("path").sortWithinPartitions("path")
        more = stage(whole.mapInArrow(_exhaust(similarity), "a long, b long"), "links")
        drop(sets)
        if not more.isEmpty():
            comp = stage(components(links.union(more), "a", "b"), "components")
        spent.append(more)
    drop(*spent, links, rest)
    moved = classes.join(comp, F.col("rep") == F.col("node"), "left").where("copies > 1 or component is not null")
    moved = moved.select("k1", "k2", "n", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc", "n", "k1", "k2").join(moved, ["k1", "k2", "n"], "left")
    component = F.when(F.col("doc").isNull() | (F.col("n") == 0), F.col("doc")).otherwise(F.coalesce("component", "doc"))
    return out.select(F.col("doc").alias(doc), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one document of each group, the one with the smallest id; all columns kept.

    Rows without an id, and texts without words, are kept; rows of one id stay or go together.
    """
    gone, = fresh(docs, "gone")
    out = near_duplicates(docs, doc, text, **options).where("not kept").select(F.col(f"`{doc}`").alias(gone)).distinct()
    return docs.join(out, F.col(f"`{doc}`") == F.col(gone), "left_anti")
