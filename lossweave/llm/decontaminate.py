"""Benchmark decontamination: test n-grams as a broadcast hash set, probed by every document word.

Only DataFrame and SQL functions run here.  Each distinct benchmark window gets
one anchor, its longest word; the anchors form the hash set.  A document is cut
into words and exploded inside one codegen stage, each word probes the anchors,
and a hit is verified by comparing the whole window at the anchor's offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lossweave.functions.ranking import bound
from lossweave.llm.folds import before
from lossweave.llm.staging import fresh

WINDOW = 13
#: Windows of all test items, and characters of them and their items' ids, up to which their set is broadcast; larger sets are joined by shuffle.
BROADCAST_WINDOWS, BROADCAST_CHARS = 500_000, 64_000_000

_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _pieces(text: Column) -> Column:
    return F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _SMALL), _SEPARATORS)


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; none for null."""
    return F.filter(_pieces(text), lambda w: w != "")


def test_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(anchor, shift, n, gram, items): each distinct test window once, with all items that hold it.

    An item of fewer words than a window, but some, is one window; without words it has none.
    """
    w = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    w = w.select("item", "w", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("at"))
    w = w.select("item", F.slice("w", F.col("at"), F.col("n")).alias("g"), "n")
    w = w.groupBy(F.array_join("g", " ").alias("gram")).agg(F.first("g").alias("g"), F.first("n").alias("n"), F.collect_set("item").alias("items"))
    best = F.array_max(F.transform("g", lambda x: F.struct(F.length(x).alias("l"), x.alias("x")))).getField("x")
    return w.select(best.alias("anchor"), (F.array_position("g", best) - 1).cast("int").alias("shift"), "n", "gram", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", bench_text: str = "text", window: int = WINDOW, share: int = 20) -> DataFrame:
    """Per document row: doc, n_words, hits [(start, n)] in words, items (sorted), n_hit, n_items, contaminated.

    A document word inside any occurrence of a test window is hit; a document is
    contaminated if ``share * n_hit >= n_words`` and n_hit > 0.  Null or empty
    texts have no words and no hits.  Repeated rows each get a row.  Rows with
    one id but other texts are judged separately.  Empty tables give no rows,
    an empty benchmark no hits.  Extra columns are ignored.
    """
    grams = test_windows(benchmark, item, bench_text, window)
    held = F.length("gram") + F.length(F.array_join("items", " "))
    n_grams, chars = grams.agg(F.count("*"), F.coalesce(F.sum(held), F.lit(0))).first()
    small = n_grams <= BROADCAST_WINDOWS and chars <= BROADCAST_CHARS
    entry = F.struct("shift", "n", "gram", "items")
    anchors = grams.groupBy("anchor").agg(F.collect_list(entry).alias("entries"))
    d = docs.select(F.col(doc).alias("doc"), F.xxhash64(F.col(text)).alias("key"), F.length(text).alias("len"), _pieces(F.col(text)).alias("w"))
    # Splitting leaves an empty piece before a leading and after a trailing separator.
    lead = (F.element_at("w", 1) == "").cast("int")
    d = d.withColumns({"lead": lead, "n_words": F.greatest(F.lit(0), F.size("w") - lead - (F.element_at("w", -1) == "").cast("int"))})

    def verified(frame: DataFrame) -> DataFrame:
        inside = lambda e: F.array_join(F.slice(F.col("w"), F.greatest(F.lit(1), F.col("pos") - e["shift"] + 1), e["n"]), " ") == e["gram"]
        found = F.filter("entries", lambda e: (F.col("pos") >= e["shift"]) & inside(e))
        return frame.withColumn("found", F.transform(found, lambda e: F.struct((F.col("pos") - e["shift"] - F.col("lead")).alias("start"), e["n"].alias("n"), e["items"].alias("items"))))

    each = ["doc", "key", "len", "n_words"]
    if small:
        out = d.select("*", F.posexplode("w").alias("pos", "word")).join(F.broadcast(anchors), F.col("word") == F.col("anchor"), "left")
        out = out.where((F.col("pos") == 0) | F.col("entries").isNotNull())
        out = verified(out).select(*each, (F.col("pos") == 0).alias("first"), F.coalesce("found", F.array()).alias("found"))
    else:
        hit = d.select(*each, F.posexplode("w").alias("pos", "word")).join(anchors, F.col("word") == F.col("anchor"))
        hit = hit.groupBy(*[F.col(c).alias(f"h_{c}") for c in each], "pos").agg(F.first("entries").alias("entries"))
        whole = d.dropDuplicates(each)
        out = verified(hit.join(whole, [F.col(f"h_{c}").eqNullSafe(F.col(c)) for c in each])).select(*each, F.lit(False).alias("first"), "found")
        out = out.union(d.select(*each, F.lit(True), F.array().cast(out.schema["found"].dataType)))
    # No filter on "found": it would be evaluated in the codegen'd probe, which would copy w for every word.
    spot = F.collect_set(F.when(F.size("found") > 0, F.col("found")))
    out = out.groupBy(*each).agg(F.sum(F.col("first").cast("int")).alias("copies"), F.flatten(spot).alias("found"))
    out = out.withColumns({
        "hits": F.array_sort(F.array_distinct(F.transform("found", lambda x: F.struct(x["start"], x["n"])))),
        "items": F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda x: x["items"])))),
    })
    covered = F.aggregate("hits", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
                          lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(s["to"], x["start"]))).cast("long").alias("n"), F.greatest(s["to"], (x["start"] + x["n"]).cast("long")).alias("to")))
    out = out.withColumn("n_hit", covered["n"])
    out = out.select(F.col("doc").alias(doc), "key", F.col("n_words").cast("long").alias("n_words"), "hits", "items", "n_hit", F.size("items").cast("long").alias("n_items"),
                     ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return out.drop("_copy")


def _found(docs: DataFrame, benchmark: DataFrame, doc: str, text: str, where: str, columns: list[str], **names) -> tuple[DataFrame, list[str], Column]:
    """Documents of ``contamination`` once each under names that docs lacks, those names, and the condition that joins them."""
    new = fresh(docs, "found_doc", "found_key", *(f"found_{c}" for c in columns))
    found = contamination(docs, benchmark, doc, text, **names).where(where).select(F.col(f"`{doc}`").alias(new[0]), F.col("key").alias(new[1]), *[F.col(c).alias(n) for c, n in zip(columns, new[2:], strict=True)])
    on = F.col(f"`{doc}`").eqNullSafe(F.col(new[0])) & (F.xxhash64(F.col(f"`{text}`")) == F.col(new[1]))
    return found.dropDuplicates(new[:2]), new, on


def remove_documents(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """docs without the contaminated ones; all columns kept, null and empty texts too."""
    found, _, on = _found(docs, benchmark, doc, text, "contaminated", [], **names)
    return docs.join(found, on, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """docs with every hit word cut out of the text; all that stands between the words stays, and all columns.

    Hits come in order of start; one that starts before the furthest end so far
    goes on with the stretch before it.  Words are then taken stretch by stretch.
    """
    found, new, on = _found(docs, benchmark, doc, text, "n_hit > 0", ["hits"], **names)
    plain = F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
    t, hits = F.col(f"`{text}`"), F.col(new[2])
    end = lambda x: (x["start"] + x["n"]).cast("int")

    def stretches(line):
        """(from, start): where the stretch before ended, where this one starts; at last the end of them all."""
        reach = before(F.transform(line, end), lambda a, x: F.greatest(a, x), F.lit(0))
        placed = bound(lambda r: F.transform(line, lambda x, i: F.struct(F.get(r, i).alias("from"), x["start"].cast("int").alias("start"))), reach)
        last = F.array_max(F.transform(line, end))
        return F.concat(F.filter(placed, lambda x: x["start"] >= x["from"]), F.array(F.struct(last.alias("from"), F.lit(None).cast("int").alias("start"))))

    def cut(pieces, line):
        n = F.size(pieces)
        kept = lambda h: F.transform(F.slice(pieces, h["from"] + 1, F.coalesce(h["start"], n) - h["from"]), lambda p: F.concat(p["gap"], F.coalesce(p["word"], F.lit(""))))
        gone = lambda h, i: F.when(h["start"].isNotNull(), F.transform(F.slice(pieces, h["start"] + 1, F.get(line, i + 1)["from"] - h["start"]), lambda p: p["gap"])).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.flatten(F.transform(line, lambda h, i: F.concat(kept(h), gone(h, i)))), "")

    pieces = F.zip_with(F.split(t, plain), F.regexp_extract_all(t, plain, F.lit(0)), lambda g, w: F.struct(g.alias("gap"), w.alias("word")))
    return docs.join(found, on, "left").withColumn(text, F.when(hits.isNull(), t).otherwise(bound(cut, pieces, stretches(hits)))).drop(*new)
