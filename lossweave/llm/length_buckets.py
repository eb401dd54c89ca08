"""Packing by optimal length buckets.

Dynamic programming over the global histogram of lengths chooses the bucket
boundaries that minimise padding; inside each bucket, batches hold as many
documents as the token budget allows at the bucket's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lossweave.llm import textkernels as K
from lossweave.llm.staging import drop, stage

#: Buckets, and tokens of a batch with its padding.
BUCKETS, BUDGET = 16, 65_536


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding (ties: the smaller split).

    Costs are exact integers.  A bucket that ends at length L over documents
    i..j costs L * (C[j] - C[i]); for growing L the best split moves along the
    lower hull of the lines -C[i] * L + best[i], so each layer takes linear time.
    """
    n = len(lengths)
    if not n:
        return []
    total = [0]
    for c in counts:
        total.append(total[-1] + int(c))
    best = [0] + [None] * n
    back: list[list[int]] = []
    for k in range(min(buckets, n)):
        now, source, hull, head = [None] * (n + 1), [0] * (n + 1), [], 0
        for j in range(k + 1, n + 1):
            i = j - 1
            if best[i] is not None:
                line = (-total[i], best[i], i)
                while len(hull) - head >= 2 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
            length = int(lengths[j - 1])
            while head + 1 < len(hull) and hull[head + 1][0] * length + hull[head + 1][1] < hull[head][0] * length + hull[head][1]:
                head += 1
            if head < len(hull):
                now[j], source[j] = length * total[j] + hull[head][0] * length + hull[head][1], hull[head][2]
        back.append(source)
        best = now
    out, j = [], n
    for source in reversed(back):
        out.append(int(lengths[j - 1]))
        j = source[j]
    return sorted(set(out))


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = K.utf8(batch.column(1))
        n = np.zeros(batch.num_rows, np.int64)
        for i, j in K.slices(off, 4_000_000):
            n[i:j] = np.diff(K.words(data[off[i] : off[j]], off[i : j + 1] - off[i])[2])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], ["doc", "n"])


def word_lengths(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n): ASCII-white-space words of each text; none for null."""
    return docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(_lengths, "doc long, n long")


def pack(lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(doc, n, bucket, bound, batch, slot, padding) for each row of (doc, n), and its ``row`` if lengths has one.

    ``bound`` is the bucket's length.  Batches are numbered within their bucket
    in the order of doc (null ids first) and hold max(1, budget // bound) rows;
    the last one of a bucket may hold fewer.  A document longer than the budget
    is a batch of its own.  Documents without tokens go to the first bucket.
    Repeated rows each take a slot.  An empty table gives no rows.

    The driver holds the histogram, one entry for each distinct length.  d of
    them need texts of d * (d - 1) / 2 words together, so there are at most about
    sqrt(2 * words), 100,000 for 5e9 words, whatever the longest text.
    """
    spark = lengths.sparkSession
    carried = ["row"] if "row" in lengths.columns else []
    lens = lengths.select("doc", F.coalesce("n", F.lit(0)).cast("long").alias("n"), *carried)
    # Rows that carry their texts are not written twice: their lengths are counted again.
    lens = lens if carried else stage(lens, "lengths")
    rows = lens.groupBy("n").count().orderBy("n").toArrow()
    bounds = boundaries(rows["n"].to_pylist(), rows["count"].to_pylist(), buckets)
    table = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array(F.lit(0).cast("long"))
    bucket = F.size(F.filter(table, lambda b: b < F.col("n")))
    placed = lens.withColumn("bucket", bucket.cast("int")).withColumn("bound", F.element_at(table, F.col("bucket") + 1))
    # Ranks without one task per bucket: a range sort, then each task's rows shifted by what stands before them.
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["bucket", "doc", "n", *(F.xxhash64(c) for c in carried)]
    ordered = stage(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ordered")
    drop(lens)
    part = F.shiftright("at", 33).alias("part")
    runs = ordered.groupBy("bucket", part).agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    before = "sum(rows) over (partition by bucket order by part rows between unbounded preceding and 1 preceding)"
    runs = runs.select("bucket", "part", "first", F.coalesce(F.expr(before), F.lit(0)).alias("before"))
    # In the sort's order a bucket's tasks follow each other: at most tasks + buckets runs, so they are broadcast.
    out = ordered.withColumn("part", part).join(F.broadcast(runs), ["bucket", "part"])
    rank, room = F.col("at") - F.col("first") + F.col("before"), F.greatest(F.lit(1), F.expr(f"{int(budget)} div greatest(bound, 1)"))
    return out.select("doc", "n", F.col("bucket").cast("long").alias("bucket"), "bound", F.floor(rank / room).cast("long").alias("batch"), F.pmod(rank, room).cast("long").alias("slot"), (F.col("bound") - F.col("n")).alias("padding"), *carried)


#: What ``places`` adds to a document.
PLACE = ("n_tokens", "bucket", "bound", "batch", "slot", "padding")


def places(docs: DataFrame, doc: str = "doc_id", text: str = "text", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """docs, texts and all, with each document's place (PLACE) as ``pack`` gives it.

    Null and empty texts have no tokens and stand in the first bucket; repeated
    rows each take a slot; columns of docs named as a place's give way.  An empty
    table gives no rows.
    """
    words = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc}`").cast("long").alias("doc"), words.cast("long").alias("n"))
    out = pack(rows, buckets, budget).withColumnRenamed("n", "n_tokens")
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in PLACE], *PLACE)
