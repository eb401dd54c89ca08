"""Language identification: script ranges, then Viterbi over per-word scores.

A word's script (from its UTF-8 lead bytes) leaves only the languages whose
training text uses it.  Each word is scored for those by its letter n-grams, and
Viterbi with a switching penalty labels the spans of a text, which may mix
languages.  A text gets the label that covers most of its letters.

The classifier is fitted on a bounded sample of labelled rows; prediction reads
the whole text and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lossweave.llm import textkernels as K

#: Labelled rows drawn for each language (expected; drawn by a hash of the id), size of each n-gram table (2**bits rows).
SAMPLE, BITS = 1500, 16
#: Languages learned at most: those with most labelled rows. A table takes a megabyte a language on the driver and in each task.
LANGUAGES = 256
#: Cost of changing the language between two words, in nats; share of a language's words that makes a script its own.
SWITCH, OWN_SCRIPT = 14.0, 0.002
#: Bytes of text whose documents are labelled together, and whose n-grams are held at once.
SLICE, PART = 2_000_000, 300_000

# Bytes that end a word: ASCII but letters (texts come lower-cased). All of a longer character's bytes are inside.
_GAP = np.ones(256, bool)
_GAP[97:123] = False
_GAP[65:91] = False
_GAP[128:] = False
# Script class by UTF-8 lead byte; continuation bytes say nothing.
SCRIPTS = ["latin", "greek", "cyrillic", "armenian_hebrew", "arabic", "indic_thai", "other_bmp", "cjk", "astral"]
_SCRIPT = np.zeros(256, np.uint8)
_SCRIPT[0xCD:0xD0] = 1
_SCRIPT[0xD0:0xD4] = 2
_SCRIPT[0xD4:0xD8] = 3
_SCRIPT[0xD8:0xE0] = 4
_SCRIPT[0xE0] = 5
_SCRIPT[0xE1] = 6
_SCRIPT[0xE3:0xF0] = 7
_SCRIPT[0xF0:] = 8


def held_out(doc: Column) -> Column:
    """Whether a document belongs to the part that is never learned from."""
    return F.crc32(doc.cast("string").cast("binary")) % 3 == 1


def _grams(data: np.ndarray, off: np.ndarray):
    """Word starts in the letters' own order, n-gram indices of each letter byte, words per document, script of each word.

    A space is put behind each document, so that none sees its neighbour's letters.
    """
    data, off = np.insert(data, off[1:], 32), off + np.arange(len(off))
    starts, ends, first = K.words(data, off, _GAP)
    gap = _GAP[data]
    clean = np.where(gap, np.uint8(32), data).astype(np.uint64)
    pad = np.full(len(clean) + 3, 32, np.uint64)
    pad[1:-2] = clean
    at = np.flatnonzero(~gap)
    a, b, c, d = pad[at], pad[at + 1], pad[at + 2], pad[at + 3]
    d = np.where(c == 32, np.uint64(32), d)
    three = (a << np.uint64(16)) | (b << np.uint64(8)) | c
    odd = np.uint64(0x9E3779B97F4A7C15)
    g3 = ((three * odd) >> np.uint64(64 - BITS)).astype(np.int64)
    g4 = ((((three << np.uint64(8)) | d) * odd) >> np.uint64(64 - BITS)).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(ends - starts)[:-1]]) if len(starts) else starts
    script = np.maximum.reduceat(_SCRIPT[data[at]], begin) if len(starts) else np.zeros(0, np.uint8)
    return begin, g3, g4, np.diff(first), script, ends - starts


def _lowered(texts: pa.Array) -> pa.Array:
    """Texts in lower case, a null as an empty one; bytes that are no UTF-8 are replaced."""
    if not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    try:
        return pc.utf8_lower(texts.fill_null(""))
    except pa.ArrowInvalid:
        return pa.array([(b or b"").decode(errors="replace").lower() for b in texts.cast(pa.binary()).to_pylist()], pa.string())


def _count(languages: list[str]):
    """n-gram and script counts of a task's sampled texts: (language, table, index, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, number = 1 << BITS, {x: k for k, x in enumerate(languages)}
        total = np.zeros((len(languages), 2 * size + len(SCRIPTS)), np.int64)
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(1).to_pylist()])
            for k in np.unique(lang):
                data, off = K.utf8(_lowered(batch.column(0).filter(pa.array(lang == k))))
                for i, j in K.slices(off, PART):
                    _, g3, g4, _, script, _ = _grams(data[off[i] : off[j]], off[i : j + 1] - off[i])
                    total[k, :size] += np.bincount(g3, minlength=size)
                    total[k, size : 2 * size] += np.bincount(g4, minlength=size)
                    total[k, 2 * size :] += np.bincount(script, minlength=len(SCRIPTS))
        k, at = np.nonzero(total)
        for i in range(0, len(k), 100_000):
            s = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(k[s].astype(np.int32)), pa.array(at[s].astype(np.int32)), pa.array(total[k[s], at[s]])], ["k", "at", "n"])

    return run


def fit(docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, languages: int = LANGUAGES) -> dict:
    """Tables of a classifier for the languages of the labelled rows that are not held out.

    At most about ``sample`` rows of each language are read, drawn by a hash of
    the id; the driver gets sums over n-gram tables of fixed size.  Of more than
    ``languages`` distinct labels, as a column of free text may hold, those with
    most rows are learned (of equal ones, the first by name).
    """
    known = docs.where(~held_out(F.col(doc)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    most = known.groupBy(lang).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), lang).limit(languages)
    sizes = {r[0]: r[1] for r in most.collect()}
    learned = sorted(sizes)
    if not learned:
        return {"languages": []}
    # Null, and so not chosen, for what is not learned.
    share = F.create_map(*[F.lit(x) for k in learned for x in (k, min(1.0, sample / sizes[k]))])
    draw = F.pmod(F.xxhash64(F.col(doc).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(draw < share[F.col(lang)]).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    rows = chosen.mapInArrow(_count(learned), "k int, at int, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).toArrow()
    size = 1 << BITS
    total = np.zeros((len(learned), 2 * size + len(SCRIPTS)))
    total[rows["k"].to_numpy(), rows["at"].to_numpy()] = rows["n"].to_numpy()
    tables = []
    for a in (0, size):
        c = total[:, a : a + size]
        p = np.log((c + 0.5) / (c.sum(1, keepdims=True) + 0.5 * size))
        tables.append(np.ascontiguousarray((p - p.mean(0)).T.astype(np.float32)))
    script = total[:, 2 * size :]
    own = script / np.maximum(1, script.sum(1, keepdims=True)) >= OWN_SCRIPT
    own[:, ~own.any(0)] = True  # a script that no language knows rules none out
    return {"languages": learned, "g3": tables[0], "g4": tables[1], "own": np.where(own.T, 0, -1e6).astype(np.float32)}


def viterbi(score: np.ndarray, counts: np.ndarray, switch: float) -> np.ndarray:
    """Best label of each word under a cost for each change; all documents advance together."""
    states = score.shape[1]
    label = np.zeros(len(score), np.int16)
    if states == 1 or not len(score):
        return label
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    longest = int(counts[order[0]])
    active = np.searchsorted(-counts[order], -np.arange(longest), "left")
    change = np.zeros(score.shape, bool)  # whether the best way into a state is from another
    source = np.zeros(len(score), np.int16)
    v = score[first[: active[0]]].copy()
    for t in range(1, longest):
        n = active[t]
        v = v[:n]
        at = first[:n] + t
        best = v.argmax(1)
        jump = v.max(1)[:, None] - np.float32(switch)
        moved = jump > v
        change[at], source[at] = moved, best
        v = np.maximum(v, jump, out=v)
        v += score[at]
        rest = active[t + 1] if t + 1 < longest else 0
        if rest < n:  # documents that end here
            label[at[rest:n]] = v[rest:n].argmax(1)
    one = slice(active[1] if longest > 1 else 0, active[0])
    label[first[one]] = score[first[one]].argmax(1)
    for t in range(longest - 1, 0, -1):
        at = first[: active[t]] + t
        now = label[at]
        label[at - 1] = np.where(change[at, now], source[at], now)
    return label


def _scores(m: dict, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of each word by language, words of each document, bytes of each word."""
    begin, g3, g4, counts, script, size = _grams(data, off)
    score = np.empty((len(begin), len(m["languages"])), np.float32)
    edge = np.append(begin, len(g3))
    for a in range(0, len(begin), 20_000):
        b = min(len(begin), a + 20_000)
        s = slice(edge[a], edge[b])
        score[a:b] = np.add.reduceat(m["g3"][g3[s]] + m["g4"][g4[s]], begin[a:b] - edge[a], axis=0)
    return score + m["own"][script], counts, size


def _runs(label: np.ndarray, counts: np.ndarray, names: np.ndarray) -> list[list[dict]]:
    """Per document, its runs of words with one label."""
    first = np.cumsum(counts) - counts
    new = np.ones(len(label), bool)
    new[1:] = label[1:] != label[:-1]
    new[first[counts > 0]] = True
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(label)))
    owner = np.repeat(np.arange(len(counts)), counts)[at]
    out: list[list[dict]] = [[] for _ in counts]
    for d, a, n, k in zip(owner.tolist(), (at - first[owner]).tolist(), size.tolist(), label[at].tolist(), strict=True):
        out[d].append({"start": a, "n": n, "lang": names[k]})
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64()), ("lang", pa.string())]))


def _judged(m: dict, texts: pa.Array, switch: float, spans: bool) -> tuple[np.ndarray, np.ndarray, list[list[dict]]]:
    """Language and its share of the letters of each text, and on request its runs."""
    names = np.array(m["languages"], object)
    lang, share = np.full(len(texts), "und", object), np.zeros(len(texts))
    runs: list[list[dict]] = [[] for _ in range(len(texts) if spans else 0)]
    low = _lowered(texts)
    letters = pc.match_substring_regex(low, r"\pL").to_numpy(zero_copy_only=False)
    data, off = K.utf8(low)
    if not len(names) or not len(data):
        return lang, share, runs
    parts = [_scores(m, data[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in K.slices(off, PART)]
    score, counts, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    if not len(score):
        return lang, share, runs
    label = viterbi(score, counts, switch)
    owner = np.repeat(np.arange(len(texts)), counts)
    mass = np.bincount(owner * len(names) + label, weights=size, minlength=len(texts) * len(names)).reshape(len(texts), -1)
    some = letters & (counts > 0)
    lang[some] = names[mass.argmax(1)[some]]
    share[some] = (mass.max(1) / np.maximum(1, mass.sum(1)))[some]
    if spans:
        runs = [x if known else [] for x, known in zip(_runs(label, counts, names), some.tolist(), strict=True)]
    return lang, share, runs


def _predict(model, switch: float, spans: bool, text: int | None = None, least: float | None = None):
    """Rows of (doc, text) to (doc, language, share), slice by slice.

    ``text`` is the place of the text within doc, a struct, where doc comes
    alone.  With ``least``, only doc comes back, of texts of a known language
    that has this share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        # A word has a score for each language, so many languages take shorter slices.
        limit = SLICE * 8 // max(8, len(m["languages"]))
        for batch in batches:
            texts = batch.column(1) if text is None else pc.struct_field(batch.column(0), [text])
            size = pc.binary_length(texts if pa.types.is_string(texts.type) else texts.cast(pa.string())).fill_null(0).to_numpy()
            for i, j in K.slices(np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), limit):
                rows = batch.column(0).slice(i, j - i)
                lang, share, runs = _judged(m, texts.slice(i, j - i), switch, spans)
                if least is not None:
                    keep = pa.array((lang != "und") & (share >= least))
                    yield pa.RecordBatch.from_arrays([rows.filter(keep)], ["doc"])
                    continue
                columns = [rows, pa.array(lang, pa.string()), pa.array(share), *([pa.array(runs, _SPANS)] if spans else [])]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "lang_pred", "score", "spans"][: len(columns)])

    return run


def _within(docs: DataFrame, text: str) -> tuple[Column, int]:
    """A row as one struct, and the place of the text in it."""
    names = docs.columns if text in docs.columns else [c.lower() for c in docs.columns]
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), names.index(text if text in docs.columns else text.lower())


def identify(docs: DataFrame, model: dict, doc: str = "doc_id", text: str = "text", switch: float = SWITCH, spans: bool = False) -> DataFrame:
    """(doc, lang_pred, score) per document row; score is the label's share of the letters, in bytes.

    ``spans`` adds the runs of words of one language as (start, n, lang), in
    words of letters.  ``und`` with score 0 and no spans for a null text, one
    without a letter, or a model without languages.  A document's result depends
    on its own text only.  Repeated rows each get a row; other columns are
    ignored.  Empty tables give no rows.
    """
    d = docs.select(F.col(doc).alias("doc"), F.col(text).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc].dataType.simpleString()
    more = ", spans array<struct<start: long, n: long, lang: string>>" if spans else ""
    return d.mapInArrow(_predict(shared, switch, spans), f"doc {kind}, lang_pred string, score double{more}").withColumnRenamed("doc", doc)


def label(docs: DataFrame, model: dict, text: str = "text", switch: float = SWITCH, lang: str = "_lang", score: str = "_lang_score") -> DataFrame:
    """docs with ``lang`` and ``score`` at the end; columns of docs of these names give way."""
    row, at = _within(docs, text)
    d = docs.select(row)
    out = d.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), switch, False, at), f"doc {d.schema['doc'].dataType.simpleString()}, lang_pred string, score double")
    kept = [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in (lang, score)]
    return out.select(*kept, F.col("lang_pred").alias(lang), F.col("score").alias(score))


def prevailing(docs: DataFrame, model: dict, share: float, text: str = "text", switch: float = SWITCH) -> DataFrame:
    """docs, all columns as they are, whose language is known and covers at least ``share`` of the letters."""
    row, at = _within(docs, text)
    d = docs.select(row)
    out = d.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), switch, False, at, share), d.schema)
    return out.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
