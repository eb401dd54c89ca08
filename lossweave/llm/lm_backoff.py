"""Stupid-backoff scores by joining documents' n-grams to hash-partitioned count tables.

Each slice of documents sends its distinct n-grams of every order, with their
counts, as sorted 64-bit fingerprints to the partitions of the count table.
There equal fingerprints are summed, and each slice gets the corpus counts of
its n-grams back, joins them to its exploded n-grams and sums per document.  A
frequent n-gram costs a row's entry per slice, not per occurrence.

Counts cover all documents; a document is scored by what the others hold (its
own occurrences are taken off), else it would never back off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lossweave.llm import textkernels as K
from lossweave.llm.length_buckets import word_lengths
from lossweave.llm.staging import repeatable
from lossweave.llm.superkmer import _framed, _open, _slices, _texts, _unframed

#: Longest n-gram, factor of each backing off, and distinct n-grams of a count partition (about).
ORDER, ALPHA, PARTITION = 3, 0.4, 1_000_000
#: Bytes of text of a slice (larger ones repeat fewer n-grams) and the compression of slices on their way.
SLICE, LEVEL = 10_000_000, 9

_ASKED = pa.schema([("part", pa.int32()), ("slice", pa.int64()), ("blob", pa.binary())])
_OUT = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("log10_score", pa.float64()), ("n_backoff", pa.int64())])


def _grams(data: np.ndarray, off: np.ndarray, order: int):
    """First word of each document, and per order the fingerprints at their first words' positions (0 elsewhere unused)."""
    starts, ends, first = K.words(data, off)
    value = K.slice_hashes(data, starts, ends)
    count = np.diff(first)
    places, prints = [], []
    for n in range(1, order + 1):
        some = np.maximum(count - n + 1, 0)
        at = np.repeat(first[:-1], some) + K.ranges(some)
        places.append(at)
        h = K.mix(value, 100) if n == 1 else K.window_hashes(value, n)
        prints.append(h[at] if len(at) else np.zeros(0, np.uint64))
    return first, count, places, prints


def _planes(x: np.ndarray) -> np.ndarray:
    """Bytes of equal weight side by side, which is where sorted gaps and small counts compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).ravel()


def _unplaned(x: np.ndarray, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(x.reshape(size, -1).T).ravel().view(kind)


def _ask(bits: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, _, data, off in _slices(batches, SLICE):
            found = [np.unique(x, return_counts=True) for x in _grams(data, off, order)[3]]
            distinct, counts = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(distinct):
                continue
            at = np.argsort(distinct, kind="stable")
            distinct, counts = distinct[at], counts[at]
            part = (distinct >> np.uint64(64 - bits)).astype(np.int64)
            edge = np.searchsorted(part, np.arange((1 << bits) + 1))
            rows = []
            for p in np.flatnonzero(np.diff(edge)):
                s = slice(edge[p], edge[p + 1])
                gaps = np.diff(distinct[s], prepend=np.uint64(int(p) << (64 - bits)))
                rows.append((int(p), name, _framed(_planes(gaps), _planes(counts[s].astype(np.uint32)))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ASKED.types, strict=True)], schema=_ASKED)

    return run


def _answer(bits: int):
    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        prints, counts = [], []
        for x in table["blob"]:
            g, c = _unframed(x.as_py(), (np.uint8, np.uint8))
            prints.append(np.cumsum(_unplaned(g, np.uint64)) + np.uint64(part << (64 - bits)))
            counts.append(_unplaned(c, np.uint32))
        edge = np.cumsum([0, *map(len, prints)])
        _, at = np.unique(np.concatenate(prints), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts))[at].astype(np.uint64)
        blobs = [_framed(_planes(total[a:b])) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return pa.Table.from_arrays([pa.array([part] * len(blobs), pa.int32()), table["slice"], pa.array(blobs, pa.binary())], schema=_ASKED)

    return run


def _score(bits: int, order: int, alpha: float, tokens: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            raise RuntimeError("documents changed between two reads")
        out = []
        by_part = np.argsort(answers["part"].to_numpy(), kind="stable") if answers.num_rows else []
        for k, row in enumerate(texts.to_pylist()):
            doc, nulls, off = np.frombuffer(row["doc"], np.int64), np.frombuffer(row["nulls"], bool), np.frombuffer(row["off"], np.int64)
            first, count, places, prints = _grams(_open(row["blob"], int(off[-1])), off, order)
            total_words = int(count.sum())
            # A slice that comes more than once is answered once for each.
            parts = answers["part"].to_numpy() if answers.num_rows else np.zeros(0)
            mine = [i for x, i in enumerate(by_part) if not (x and parts[by_part[x - 1]] == parts[i])]
            counts = np.concatenate([_unplaned(_unframed(answers["blob"][int(i)].as_py(), (np.uint8,))[0], np.uint64) for i in mine]) if mine else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(count)), count)
            found = [np.unique(x, return_inverse=True) for x in prints]
            edge = np.cumsum([0, *(len(x) for x, _ in found)])
            total = np.zeros(edge[-1], np.int64)
            total[np.argsort(np.concatenate([x for x, _ in found]), kind="stable")] = counts
            # Corpus counts without the document's own.
            left = []
            for n, (p, (distinct, at)) in enumerate(zip(places, found, strict=True)):
                _, group, own = np.unique(owner[p] * max(1, len(distinct)) + at, return_inverse=True, return_counts=True)
                r = np.zeros(total_words, np.int64)
                r[p] = total[edge[n] : edge[n + 1]][at] - own[group]
                left.append(r)
            here = np.arange(total_words) - np.repeat(first[:-1], count)
            best = (left[0] + 1) / (tokens - count[owner] + 1).astype(np.float64)
            backed = np.minimum(here, order - 1)
            factor = backed.astype(np.float64)
            for n in range(2, order + 1):
                i = np.flatnonzero(here >= n - 1)
                seen = i[left[n - 1][i - n + 1] > 0]
                best[seen] = left[n - 1][seen - n + 1] / left[n - 2][seen - n + 1]
                backed[seen] = np.minimum(here[seen], order - 1) - (n - 1)
                factor[seen] = backed[seen]
            logs = np.log10(best) + factor * np.log10(alpha)
            score = np.bincount(owner, weights=logs, minlength=len(count))
            steps = np.bincount(owner, weights=backed, minlength=len(count)).astype(np.int64)
            out.append(pa.Table.from_arrays([pa.array(doc, mask=nulls), pa.array(count.astype(np.int64)), pa.array(score), pa.array(steps)], schema=_OUT))
        return pa.concat_tables(out)

    return run


def score(docs: DataFrame, doc: str = "doc_id", text: str = "text", order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """(doc, n_words, log10_score, n_backoff) per document row.

    Words are [^ASCII white space]+.  A word is scored by its longest n-gram
    (``order`` at most, within the document) that the other rows hold:
    count(n-gram) / count(its context), times ``alpha`` for each order given up;
    down at single words it is (count + 1) / (words of the other rows + 1).
    ``log10_score`` is the sum over the document's words, 0 without words (null
    or empty text); n_backoff counts the orders given up.  Repeated rows are
    documents of their own and see each other.  Empty tables give no rows;
    extra columns are ignored.  Counts are held by 64-bit fingerprint.
    """
    d = repeatable(docs.select(F.col(f"`{doc}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text")), "documents")
    tokens = word_lengths(d, "doc", "text").agg(F.sum("n")).first()[0] or 0
    bits = max(2, (order * tokens // PARTITION).bit_length())
    asked = d.mapInArrow(_ask(bits, order), "part int, slice long, blob binary")
    answers = asked.groupBy("part").applyInArrow(_answer(bits), "part int, slice long, blob binary")
    texts = d.mapInArrow(_texts(SLICE, LEVEL), "slice long, doc binary, nulls binary, blob binary, off binary")
    out = texts.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_score(bits, order, alpha, tokens), "doc long, n_words long, log10_score double, n_backoff long")
    return out.withColumnRenamed("doc", doc)


__all__ = ["score"]
