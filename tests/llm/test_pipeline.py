"""The pipeline against a plain version of each stage on its own input."""

import itertools
import random
import re

import corpus_pipeline
from lossweave.llm.pii import KINDS
from tests.llm.test_operators import WORD, base_spans, brute_contamination, groups, lower


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    kinds = {"en": "the of and to in is that with for on this".split(), "de": "der die und ist nicht ein zu mit auf den".split()}
    docs = []
    for i in range(80):
        k = rng.choice(list(kinds))
        docs.append((i, " ".join(rng.choices(kinds[k], k=rng.randint(15, 60))), k, "s", 0))
    docs += [(100, docs[4][1], "en", "s", 0), (101, docs[5][1] + " x", "de", "s", 0), (102, "12 34", "en", "s", 0), (103, None, "en", "s", 0), (104, docs[7][1] + " a.b@c.de", "en", "s", 0), (105, "the of a1 a2 a3 a4 a5 a6 a7 a8 a9 a10 a11 a12 a13", "en", "s", 0), (106, "mail the a.b@c.de of and to in is that 1.2.3.4", "en", "s", 0)]
    bench = [(1, "a1 a2 a3 a4 a5 a6 a7 a8 a9 a10 a11 a12 a13")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    apply = dict(corpus_pipeline.STAGES)
    assert list(apply) == ["language", "near_duplicates", "contamination", "personal_data", "packing"]

    one = apply["language"](spark, d, str(tmp_path))
    rows = {r.doc_id: r.text for r in one.collect()}
    assert one.columns == d.columns and set(rows) == {r[0] for r in docs} - {102, 103}
    two = apply["near_duplicates"](spark, one, str(tmp_path))
    sets = {}
    for i, t in rows.items():
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    kept = {i for i, r in groups(sets, links).items() if r == i}
    assert {r.doc_id for r in two.collect()} == kept and two.columns == d.columns
    three = apply["contamination"](spark, two, str(tmp_path))
    clean = {w[0] for w in brute_contamination([(i, rows[i]) for i in kept], bench, 13) if not w[4]}
    assert {r.doc_id for r in three.collect()} == clean and 105 not in clean
    four = apply["personal_data"](spark, three, str(tmp_path))
    for r in four.collect():
        want = rows[r.doc_id]
        for k, a, b in sorted(base_spans(want), key=lambda s: -s[1]):
            want = want[:a] + f"<{k}>" + want[b:]
        assert r.text == want
    five = apply["packing"](spark, four, str(tmp_path)).collect()
    assert {(r.doc_id, r.text, r.n_tokens) for r in five} == {(r.doc_id, r.text, len(WORD.findall(r.text))) for r in four.collect()}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, five))
    assert KINDS and re


def test_stages_on_odd_tables(spark, tmp_path):
    """Each stage alone on nulls, empty and very long texts, repeated rows, clashing names, and no rows at all."""
    extra = ["lang_pred", "score", "doc", "n", "key", "rep", "row", "_lang", "_gone", "_bad", "_pii", "spans", "bucket", "bound", "found_doc", "component_id"]
    long = " ".join(f"the word{i}" for i in range(20_000)) + " a.b@c.de" * 500
    rows = [(1, "the of and to in is that with", "en"), (1, "the of and to in is that with", "en"), (2, None, "en"), (3, "", None), (4, " \n", "en"), (5, long, "en"), (None, "of the and to in", "en"), (6, long, None), (6, long, None), (7, "a1 a2 a3 the of and", None), (8, "mail the a.b@c.de of and", "en")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    d = spark.createDataFrame([(*r, "s", 0, *extra) for r in rows], schema)
    spark.createDataFrame([(1, "a1 a2 a3"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {
        "language": [r[:2] for r in rows if r[1] and r[1].strip()],
        "near_duplicates": [r[:2] for r in rows if r[0] not in (6,)],
        "contamination": [r[:2] for r in rows if r[0] != 7],
        "personal_data": [(r[0], r[1] and r[1].replace("a.b@c.de", "<email>")) for r in rows],
        "packing": [r[:2] for r in rows]}
    for name, apply in corpus_pipeline.STAGES:
        out = apply(spark, d, str(tmp_path))
        lost = {"bucket", "bound"} if name == "packing" else set()
        assert out.columns[: len(d.columns) - len(lost)] == [c for c in d.columns if c not in lost], name
        got = out.collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(want[name], key=repr), name
        assert all(r[c] == c for r in got for c in extra if c not in lost)
        assert apply(spark, d.limit(0), str(tmp_path)).count() == 0
