"""Exact repeated-window removal by super-k-mer partitioning.

A k-mer is a window of 13 words.  Consecutive windows whose minimiser (the
smallest hash of three adjacent words) is the same travel together as one
packed string to the minimiser's bucket, so every occurrence of a window meets
there while neighbouring windows share their words on the way.  In the bucket,
windows are sorted by hash, compared byte by byte, and get the smallest id of a
document in which they start.

Buckets are as many as the text asks for.  A minimiser of very many windows
would fill one bucket by itself: such ones are found by counts in a sample of
documents, and their windows go to buckets by a longer minimiser.  The sample
steers only where windows meet, never what is found.

Documents are read in slices of a few megabytes, of more in a very large corpus.  Equal super-k-mers of a slice
are merged before they travel, so a passage that a third of all documents share
sends one row per slice, not per document.  Only windows that start in an
earlier document are answered, to the slice, which marks its own occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lossweave.llm import textkernels as K
from lossweave.llm.staging import repeatable, stage

#: Words of a window, adjacent words of a minimiser and of the longer one, bytes of text of a slice and of a bucket.
WINDOW, MINIMISER, LONGER, SLICE, BUCKET = 13, 3, 8, 4_000_000, 8_000_000
#: Slices that a corpus has before they grow, and the largest slice: a passage that all slices hold sends one row from each to its bucket.
SLICES, LARGEST = 500_000, 32_000_000
#: Share of documents in which minimisers are counted, and bytes of super-k-mers from which on one is split.
#: At these, one that is just split is seen about 3,500 times in the sample, whatever the corpus.
SHARE, HOT = 1 / 500, 32_000_000

_BLOB = pa.schema([("bucket", pa.int64()), ("slice", pa.int64()), ("blob", pa.binary())])
_ANSWER = pa.schema([("slice", pa.int64()), ("bucket", pa.int64()), ("item", pa.binary()), ("shift", pa.binary()), ("least", pa.binary())])
_TEXT = pa.schema([("slice", pa.int64()), ("doc", pa.binary()), ("nulls", pa.binary()), ("blob", pa.binary()), ("off", pa.binary())])
_OUT = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

#: Compression of packed words on their way.
LEVEL = 6


def _open(blob: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, size, codec="zstd", asbytes=True), np.uint8)


def _framed(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed binary, with their sizes in front."""
    raw = b"".join(a.tobytes() for a in arrays)
    return np.array([len(arrays), *[a.nbytes for a in arrays]], np.int64).tobytes() + pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def _unframed(blob: bytes, kinds: tuple) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes = np.frombuffer(blob, np.int64, n, 8)
    raw, out, at = _open(blob[8 * (n + 1) :], int(sizes.sum())), [], 0
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(raw[at : at + size].view(kind))
        at += size
    return out


def _least(hashes: np.ndarray, at: np.ndarray, size: int, window: int) -> np.ndarray:
    """The smallest hash of ``size`` adjacent words in each window."""
    low = hashes[at]
    for s in range(1, window - size + 1):
        np.minimum(low, hashes[at + s], out=low)
    return low


def _cut(data: np.ndarray, off: np.ndarray, buckets: int, window: int, hot: np.ndarray | None = None):
    """Super-k-mers of a slice: (document, first word, number of windows, bucket), with the slice's words.

    Windows whose minimiser is among the ``hot`` ones (sorted) go by their longer minimiser.
    """
    starts, ends, first = K.words(data, off)
    value = K.slice_hashes(data, starts, ends)
    count = np.diff(first)
    windows = np.maximum(count - window + 1, 0)
    at = np.repeat(first[:-1], windows) + K.ranges(windows)
    doc = np.repeat(np.arange(len(count)), windows)
    if not len(at):
        zero = np.zeros(0, np.int64)
        return starts, ends, first, value, zero, zero, zero, zero
    low = _least(K.window_hashes(value, min(MINIMISER, window)), at, min(MINIMISER, window), window)
    if hot is not None and len(hot):
        many = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, low), len(hot) - 1)] == low)
        longer = min(LONGER, window)
        low[many] = K.mix(_least(K.window_hashes(value, longer), at[many], longer, window), 32)
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    return starts, ends, first, value, doc[head], at[head], np.diff(np.append(head, len(at))), (K.mix(low[head], 31) % np.uint64(buckets)).astype(np.int64)


def _merged(data, starts, ends, value, word, size, bucket, window):
    """Distinct super-k-mers of a slice in (bucket, hash) order: their first occurrence, and each occurrence's index.

    Equal hashes are compared byte by byte (word by word, so different white
    space does not matter); unequal ones under one hash stay apart.
    """
    n = size + window - 1
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(K.mix(value, 5) * K._powers(len(value) + 1)[0][: len(value)], out=total[1:])
    h = K.mix((total[word + n] - total[word]) * K._powers(len(value) + 1)[1][word] + n.astype(np.uint64), 6)
    order = np.lexsort((word, h, bucket))
    s_h, s_b, s_w, s_n = h[order], bucket[order], word[order], n[order]
    twin = np.zeros(len(order), bool)
    twin[1:] = (s_h[1:] == s_h[:-1]) & (s_b[1:] == s_b[:-1]) & (s_n[1:] == s_n[:-1])
    at = np.flatnonzero(twin)
    if len(at):
        counts = s_n[at]
        inner = K.ranges(counts)
        x, y = np.repeat(s_w[at], counts) + inner, np.repeat(s_w[at - 1], counts) + inner
        same = K.equal_slices(data, starts[x], ends[x], starts[y], ends[y])
        twin[at] = np.logical_and.reduceat(same, np.cumsum(counts) - counts)
    index = np.cumsum(~twin) - 1
    item = np.empty(len(order), np.int64)
    item[order] = index
    return order[~twin], item


def _slices(batches: Iterator[pa.RecordBatch], size: int = SLICE):
    """(slice id, document ids, null ids, bytes, offsets); the id is a hash of all it holds."""
    for batch in _gathered(batches, size):
        data, off = K.utf8(batch.column(1))
        doc = batch.column(0).combine_chunks().cast(pa.int64())
        nulls = np.array(doc.is_null())
        doc = doc.fill_null(np.iinfo(np.int64).max).to_numpy()
        for i, j in K.slices(off, size):
            d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
            seal = hashlib.blake2b(doc[i:j].tobytes() + o.tobytes(), digest_size=8)
            seal.update(d)
            yield int.from_bytes(seal.digest(), "little", signed=True), doc[i:j], nulls[i:j], d, o


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Batches, put together until they hold a slice."""
    held, weight = [], 0
    for batch in batches:
        held.append(batch)
        weight += batch.column(1).nbytes
        if weight >= size:
            yield pa.Table.from_batches(held)
            held, weight = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _common(window: int, least: int):
    """Minimisers of the sampled texts of a task with their windows; rare ones of a task are left out."""

    def run(batches):
        seen, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            data, off = K.utf8(batch.column(0))
            for i, j in K.slices(off, SLICE):
                starts, ends, first = K.words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                windows = np.maximum(np.diff(first) - window + 1, 0)
                at = np.repeat(first[:-1], windows) + K.ranges(windows)
                if not len(at):
                    continue
                value = K.slice_hashes(data[off[i] : off[j]], starts, ends)
                low, n = np.unique(_least(K.window_hashes(value, min(MINIMISER, window)), at, min(MINIMISER, window), window), return_counts=True)
                seen, where = np.unique(np.concatenate([seen, low]), return_inverse=True)
                times = np.bincount(where, weights=np.concatenate([times, n])).astype(np.int64)
        kept = times >= least
        yield pa.RecordBatch.from_arrays([pa.array(seen[kept].view(np.int64)), pa.array(times[kept])], ["minimiser", "n"])

    return run


def _hot(d: DataFrame, window: int, size: int) -> np.ndarray:
    """Minimisers expected to fill more than HOT bytes, sorted: at most 3 * size / HOT of them, as super-k-mers take 3 times the text."""
    every = 18  # bytes that a window adds to its bucket, about
    need = max(2, int(HOT / every * SHARE))
    if size * 3 < HOT:
        return np.zeros(0, np.uint64)  # no minimiser can reach it
    some = d.where(F.pmod(F.xxhash64("text"), F.lit(round(1 / SHARE))) == 0).select("text")
    found = some.mapInArrow(_common(window, 2), "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n")).where(F.col("n") >= need)
    return np.sort(found.select("minimiser").toArrow()["minimiser"].to_numpy().view(np.uint64))


def _send(buckets: int, window: int, slice_: int, hot):
    def run(batches):
        for name, doc, _, data, off in _slices(batches, slice_):
            starts, ends, _, value, d, word, size, bucket = _cut(data, off, buckets, window, hot.value)
            if not len(d):
                continue
            pick, item = _merged(data, starts, ends, value, word, size, bucket, window)
            least = np.full(len(pick), np.iinfo(np.int64).max)
            most = np.full(len(pick), np.iinfo(np.int64).min)
            np.minimum.at(least, item, doc[d])
            np.maximum.at(most, item, doc[d])
            # Each as its words, one space between, a line break after it.
            n = size[pick] + window - 1
            w = np.repeat(word[pick], n) + K.ranges(n)
            lengths = ends[w] - starts[w] + 1
            text = K.take_slices(data, starts[w], ends[w] + 1) if int(ends[-1]) < len(data) else K.take_slices(np.append(data, np.uint8(32)), starts[w], ends[w] + 1)
            text[np.cumsum(lengths) - 1] = 32
            stops = np.cumsum(lengths)[np.cumsum(n) - 1]
            text[stops - 1] = 10
            cut = np.flatnonzero(np.diff(bucket[pick])) + 1
            froms, tos = np.append(0, cut), np.append(cut, len(pick))
            begin = np.append(0, stops)
            rows = [(int(bucket[pick[a]]), name, _framed(text[begin[a] : begin[b]], least[a:b], most[a:b], level=LEVEL)) for a, b in zip(froms, tos, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _BLOB.types, strict=True)], schema=_BLOB)

    return run


def _judge(window: int):
    """One bucket: the smallest document of each window, answered where a super-k-mer has a larger one."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_unframed(x.as_py(), (np.uint8, np.int64, np.int64)) for x in table["blob"]]
        data = np.concatenate([p[0] for p in parts])
        least, most = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        owner = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])
        item = np.concatenate([np.arange(len(p[1])) for p in parts])
        stops = np.flatnonzero(data == 10) + 1
        starts, ends, first = K.words(data, np.append(0, stops))
        value = K.slice_hashes(data, starts, ends)
        windows = np.diff(first) - window + 1
        at = np.repeat(first[:-1], windows) + K.ranges(windows)
        mine = np.repeat(np.arange(len(least)), windows)
        h = K.window_hashes(value, window)[at]
        order = np.lexsort((least[mine], h)) if len(parts) > 1 else np.argsort(h, kind="stable")
        at, mine, h = at[order], mine[order], h[order]
        twin = np.zeros(len(at), bool)
        twin[1:] = h[1:] == h[:-1]
        low = np.minimum.reduceat(least[mine], np.flatnonzero(~twin))[np.cumsum(~twin) - 1]
        hit = np.flatnonzero(low < most[mine])
        head = np.flatnonzero(~twin)[np.cumsum(~twin) - 1]
        same = K.equal_slices(data, starts[at[head[hit]]], ends[at[head[hit]] + window - 1], starts[at[hit]], ends[at[hit] + window - 1])
        if not same.all():  # different windows under one hash: judge those by their bytes
            for g in np.unique(head[hit[~same]]):
                members = np.flatnonzero(head == g)
                by: dict[bytes, int] = {}
                key = [data[starts[at[x]] : ends[at[x] + window - 1]].tobytes() for x in members]
                for k, x in zip(key, members, strict=True):
                    by[k] = min(by.get(k, np.iinfo(np.int64).max), int(least[mine[x]]))
                low[members] = [by[k] for k in key]
            hit = np.flatnonzero(low < most[mine])
        x = mine[hit]
        shift = (at[hit] - first[x]).astype(np.int32)
        by_owner = np.argsort(owner[x], kind="stable")
        hit, x, shift = hit[by_owner], x[by_owner], shift[by_owner]
        bounds = np.searchsorted(owner[x], np.arange(len(parts) + 1))
        names, bucket = table["slice"].to_pylist(), table["bucket"][0].as_py()
        rows = [(names[o], bucket, item[x[a:b]].astype(np.int32).tobytes(), shift[a:b].tobytes(), low[hit[a:b]].tobytes()) for o, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
        if not rows:
            return _ANSWER.empty_table()
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ANSWER.types, strict=True)], schema=_ANSWER)

    return run


def _texts(size: int = SLICE, level: int = LEVEL):
    """The slices themselves, compressed at the level."""

    def run(batches):
        codec = pa.Codec("zstd", compression_level=level)
        for name, doc, nulls, data, off in _slices(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((name, doc.tobytes(), nulls.tobytes(), codec.compress(data.tobytes(), asbytes=True), off.tobytes()), _TEXT.types, strict=True)], schema=_TEXT)

    return run


def _mark(buckets: int, window: int, hashed: bool, hot):
    """One slice with its answers: which words go, and what is left."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            raise RuntimeError("documents changed between two reads")
        out = []
        for row in texts.to_pylist():  # repeated slices hold the same documents, with the same answers
            doc, nulls, off = np.frombuffer(row["doc"], np.int64), np.frombuffer(row["nulls"], bool), np.frombuffer(row["off"], np.int64)
            data = _open(row["blob"], int(off[-1]))
            starts, ends, first, value, d, word, size, bucket = _cut(data, off, buckets, window, hot.value)
            gone = np.zeros(len(starts) + 1, np.int64)
            if len(d) and answers.num_rows:
                pick, item = _merged(data, starts, ends, value, word, size, bucket, window)
                mine = bucket[pick]
                by_item = np.argsort(item, kind="stable")
                reach = np.searchsorted(item[by_item], np.arange(len(pick) + 1))
                got, shift, low = [], [], []
                for b, i, s, l in zip(answers["bucket"].to_pylist(), answers["item"].to_pylist(), answers["shift"].to_pylist(), answers["least"].to_pylist(), strict=True):
                    got.append(np.frombuffer(i, np.int32) + np.searchsorted(mine, b))
                    shift.append(np.frombuffer(s, np.int32))
                    low.append(np.frombuffer(l, np.int64))
                got, shift, low = np.concatenate(got), np.concatenate(shift), np.concatenate(low)
                times = reach[got + 1] - reach[got]
                where = by_item[np.repeat(reach[got], times) + K.ranges(times)]
                at, late = word[where] + np.repeat(shift, times), doc[d[where]] > np.repeat(low, times)
                np.add.at(gone, at[late], 1)
                np.add.at(gone, at[late] + window, -1)
            kept = np.cumsum(gone)[:-1] == 0
            n = np.diff(first)
            left = np.add.reduceat(np.append(kept, False).astype(np.int64), first[:-1]) * (n > 0) if len(n) else n
            w = np.flatnonzero(kept)
            joined = K.take_slices(np.append(data, np.uint8(32)), starts[w], ends[w] + 1)
            lengths = ends[w] - starts[w] + 1
            joined[np.cumsum(lengths) - 1] = 32
            upto = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(left))]
            raw = joined.tobytes()
            texts_left = [raw[a : max(a, b - 1)] for a, b in zip(upto[:-1], upto[1:], strict=True)]
            shown = [hashlib.sha256(x).hexdigest() for x in texts_left] if hashed else pa.array(texts_left, pa.binary()).cast(pa.string())
            out.append(pa.Table.from_arrays([pa.array(doc, mask=nulls), pa.array(n.astype(np.int64)), pa.array((n - left).astype(np.int64)), pa.array(shown, pa.string())], schema=_OUT))
        return pa.concat_tables(out)

    return run


def remove_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", window: int = WINDOW, hashed: bool = False) -> DataFrame:
    """(doc, n_words, n_removed, kept) per document row; kept has the words that stay, one space between.

    Words are [^ASCII white space]+, unchanged.  A word goes if a window that
    covers it also starts in a document with a smaller id; windows are judged on
    the input.  hashed: kept is the sha-256 of that text in lower-case hex.
    Null and empty texts have no words.  Rows without an id come after all
    others.  Repeated rows, or rows with one id, do not count as smaller than
    each other, and each get a row.  Empty tables give no rows; extra columns
    are ignored.
    """
    d = repeatable(docs.select(F.col(f"`{doc}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text")), "documents")
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, slice_ = max(8, -(-3 * size // BUCKET)), max(SLICE, min(LARGEST, size // SLICES))
    hot = docs.sparkSession.sparkContext.broadcast(_hot(d, window, size))
    sent = d.mapInArrow(_send(buckets, window, slice_, hot), "bucket long, slice long, blob binary")
    answers = stage(sent.groupBy("bucket").applyInArrow(_judge(window), "slice long, bucket long, item binary, shift binary, least binary"), "answers")
    texts = d.mapInArrow(_texts(slice_), "slice long, doc binary, nulls binary, blob binary, off binary")
    out = texts.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_mark(buckets, window, hashed, hot), "doc long, n_words long, n_removed long, kept string")
    return out.select(F.col("doc").alias(doc), "n_words", "n_removed", "kept")
