"""Added spans against a plain estimate of the votes, long lists of matches, and clashing columns."""

import math
import random
import re
from collections import Counter, defaultdict

from lossweave.llm import pii
from tests.llm.test_operators import base_spans, luhn

SOFT_PHONE = re.compile(r"(?<![0-9+.(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
SOFT_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(](?i:at)[\])] ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[(](?i:dot)[\])] ?)[A-Za-z0-9-]{1,63}){1,8}")


def found(t, spans):
    """(kind, start, end, value, before) of one pattern's spans in order."""
    out, at = [], 0
    for kind, a, b in spans:
        out.append((kind, a, b, t[a:b], t[max(at - pii.CONTEXT, 0) : a][-pii.CONTEXT :]))
        at = a
    return out


def spans_of(t):
    """All candidates of a text as (kind, start, end, value, before, base)."""
    by = {k: found(t, [s for s in base_spans(t) if s[0] == k]) for k in ("email", "ip", "phone")}
    sets = [re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t), re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t), re.finditer(r"[0-9]([\x20-]?[0-9])+", t), re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t), SOFT_PHONE.finditer(t), SOFT_EMAIL.finditer(t)]
    kinds = ["email", "ip", "card", "phone", "phone", "email"]
    out = []
    for n, (kind, matches) in enumerate(zip(kinds, sets)):
        before = 0
        for m in matches:
            a, b = m.span()
            said = t[max(before, a - pii.CONTEXT) : a]
            before = a
            d = re.sub("[^0-9]", "", m[0])
            if kind == "card" and n == 2:
                if 16 <= len(d) <= 19:
                    out.append((kind, a, b, m[0], said, luhn(d)))
            elif n > 3 or (kind, a, b) in {x[:3] for x in by[kind]}:
                out.append((kind, a, b, m[0], said, n < 4))
    sure = [x for x in out if x[5]]
    return sure + [x for x in out if not x[5] and not any(x[1] < y[2] and y[1] < x[2] for y in sure)]


def seen(x):
    """Votes and features of a candidate."""
    kind, _, _, value, before, base = x
    d = re.sub("[^0-9]", "", value)
    near = {k: re.search(rf"(?i)(?<![^\W\d_])({w})[\W\d_]{{0,6}}$", before) is not None for k, w in pii.CONTEXT_WORDS.items()}
    pattern = {"card": int(base), "phone": 1 if 8 <= len(d) <= 15 else -1, "email": 1 if base else -1, "ip": 1}[kind]
    known = {"email": int(re.split("[^A-Za-z0-9]+", value)[-1].lower() in pii.TOP_DOMAINS), "card": int(d[:2] in pii.ISSUER_PREFIXES),
             "ip": int(value.split(".")[0] not in pii.RESERVED_NETWORKS), "phone": 1 if value.startswith("+") else -1}[kind]
    context = 1 if near[kind] else 0 if any(near[k] for k in near if k not in (kind, "ip")) else -1
    n = len(d)
    digits = "few" if n < 8 else "some" if n < 13 else "many" if n < 16 else "most"
    shape = "plus" if value.startswith("+") else "at" if "@" in value else "brackets" if re.search(r"[()\[\]]", value) else "split" if re.search("[ -]", value) else "plain"
    lead = "start" if not before else "label" if re.search("[:=#] ?$", before) else "space" if before[-1].isspace() else "other"
    return {"pattern": pattern, "gazetteer": known, "context": context, "digits": digits, "shape": shape, "before": lead}


def plain_added(texts):
    """Spans of each text that stay, by expectation-maximisation and naive Bayes over every candidate one by one."""
    all_ = [(i, x, seen(x)) for i, t in texts for x in spans_of(t)]
    kept = defaultdict(list)
    for k in pii.KINDS:
        of = [(i, x, v) for i, x, v in all_ if x[0] == k]
        right, share, true = dict.fromkeys(pii.LABELERS, 0.8), pii.PRIOR, []
        for _ in range(pii.PASSES):
            true = []
            for _, _, v in of:
                yes, no = math.log(share), math.log(1 - share)
                for a in pii.LABELERS:
                    if v[a] >= 0:
                        yes += math.log(right[a] if v[a] else 1 - right[a])
                        no += math.log(1 - right[a] if v[a] else right[a])
                true.append(1 / (1 + math.exp(min(50, max(-50, no - yes)))))
            share = min(0.99, max(0.01, (1 + sum(true)) / (2 + len(of))))
            for a in pii.LABELERS:
                voted = [(p if v[a] else 1 - p) for p, (_, _, v) in zip(true, of) if v[a] >= 0]
                right[a] = min(0.99, max(0.55, (4 + sum(voted)) / (5 + len(voted))))
        pos, neg = sum(true), sum(1 - p for p in true)
        for i, x, v in of:
            score = math.log((pos + 1) / (neg + 1))
            for f in v:
                values = {w[f] for _, _, w in of}
                p = sum(t for t, (_, _, w) in zip(true, of) if w[f] == v[f])
                n = sum(1 - t for t, (_, _, w) in zip(true, of) if w[f] == v[f])
                score += math.log((p + 1) / (pos + len(values) + 1)) - math.log((n + 1) / (neg + len(values) + 1))
            if x[5] or score > 0:
                kept[i].append(f"{k}:{x[1]}:{x[2]}")
    return kept


def test_added_spans_equal_the_plain_estimate(spark):
    rng = random.Random(41)
    bits = ["a.b@c.de", "x@y.zz", "1.2.3.4", "0.9.9.9", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "9999 1111 1111 1112", "+1 (415) 555-2671", "+12", "tel: 415 555 2671", "(415) 555-2671", "word 415.555.2671", "id 123-456-7890", "me [at] site [dot] org", "mail you(at)host.xx", "card: 4111 1111 1111 1119", "phone 4111 1111 1111 1118", "call", "host 7.7.7.7", "é日"]
    texts = [(i, rng.choice([" ", ", ", "; "]).join(rng.choices(bits, k=rng.randint(0, 8)))) for i in range(300)]
    want = plain_added(texts)
    got = {r.doc_id: r.spans.split(",") if r.spans else [] for r in pii.digest(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert any(len(set(want[i])) > len(base_spans(t)) for i, t in texts)
    for i, t in texts:
        assert Counter(got[i]) == Counter(want[i]), t


def test_many_matches_in_one_text(spark):
    """20,000 addresses and as many loose numbers in one text, cut out at their places."""
    text = ", ".join(f"é{i}@example.org, call 415 555 {1000 + i % 9000}" for i in range(20_000))
    d = spark.createDataFrame([(1, text), (2, "x 1.2.3.4 y")], "doc_id long, text string")
    r = {x.doc_id: x for x in pii.digest(d).collect()}[1]
    spans = [s.split(":") for s in r.spans.split(",")]
    assert r.n_email == 20_000 and [(int(a), int(b)) for k, a, b in spans if k == "email"] == [(a, b) for k, a, b in base_spans(text) if k == "email"]
    want = re.sub(r"[0-9]+@example\.org", "<email>", text)
    if len(spans) == 40_000:
        want = re.sub(r"415 555 [0-9]{4}", "<phone>", want)
    assert [x.text for x in pii.redact(d).orderBy("doc_id").collect()] == [want, "x <ip> y"]


def test_clashing_columns_stay(spark):
    names = ["digit", "emails", "ips", "cards", "phones", "more", "spans", "_spans", "_digit", "v0"]
    d = spark.createDataFrame([(1, "a.b@c.de", *names), (2, None, *names), (2, "", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = pii.redact(d)
    assert out.columns == d.columns and sorted((r.text or "", r.digit, r["_spans"]) for r in out.collect()) == [("", "digit", "_spans"), ("", "digit", "_spans"), ("<email>", "digit", "_spans")]
    assert pii.detect(d).columns == [c for c in d.columns if c != "spans"] + ["spans"] or "spans" in pii.detect(d).columns
    assert pii.redact(d, model={"weights": {"x": 0.0}}).count() == 3 and pii.redact(d.limit(0)).count() == 0
