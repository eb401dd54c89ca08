"""Personal data spans by weak supervision, in DataFrame functions only.

Candidates are the base patterns of four kinds plus looser shapes of them.
Three labelers vote on each candidate: the pattern's own validity test, a
gazetteer and the words before it.  Candidates are counted by their votes and
features, a table whose size is bounded by the labelers and not by the corpus;
expectation-maximisation over it estimates the labelers' reliabilities, and its
posteriors train the final classifier (naive Bayes on the span's features),
which decides on the loose candidates.  Base spans always stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from lossweave.functions.ranking import bound
from lossweave.llm.folds import before, chunks
from lossweave.llm.staging import fresh, stage

KINDS = ("email", "ip", "card", "phone")
#: Code points before a span that the context labeler and classifier read.
CONTEXT = 40

# Patterns of the base kinds. Possessive and guarded so that each
# run of characters is scanned once; what they match is the plain pattern's.
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = f"(?:\\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
IP_VALID = "^(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(\\.|$)){4}"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
# A separator that does not stand between two digits ends a card number.
CARD_BREAK = "(?<![0-9])[\\x20-]|[\\x20-](?![0-9])"
CARD = "[0-9][0-9\\x20-]*[0-9]"
# Looser shapes, decided by the classifier.
LOOSE_PHONE = "(?<![0-9+.(-])\\(?[0-9]{3}\\)?[\\x20.-][0-9]{3}[\\x20.-][0-9]{4}(?![0-9])"
LOOSE_EMAIL = "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\\x20?[\\[(](?i:at)[\\])]\\x20?[A-Za-z0-9-]{1,63}(?:(?:\\.|\\x20?[\\[(](?i:dot)[\\])]\\x20?)[A-Za-z0-9-]{1,63}){1,8}"

# The gazetteer and the context words.
TOP_DOMAINS = ["com", "org", "net", "edu", "gov", "io", "co", "de", "fr", "es", "uk", "eu", "info", "biz", "ch", "at", "it", "nl", "us"]
ISSUER_PREFIXES = ["34", "35", "36", "37", "40", "41", "42", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "60", "62", "64", "65"]
RESERVED_NETWORKS = ["0", "127", "255"]
CONTEXT_WORDS = {
    "email": "mail|e-mail|email|contact|write|adresse|correo|courriel|kontakt",
    "ip": "ip|host|server|address|addr|login|client|adresse",
    "card": "card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|telephone|call|fax|mobile|cell|telefon|anruf|appel|llamar",
}


_SPAN = "array<struct<kind:string,start:int,end:int,value:string,before:string,base:boolean>>"
#: Spans of a chunk of a long and of a short piece of text.
CUTS = (16_384, 128)


def _found(text: Column, pattern: str, kind: str, base: bool) -> Column:
    """Array of (kind, start, end, value, before, base) for every match, positions in code points.

    ``before`` is the last CONTEXT code points of the match before and what stands between.
    """
    def run(between, matches):
        taken = F.transform(matches, lambda m, i: F.char_length(F.get(between, i)) + F.char_length(m))
        # A card's breaks are marked in its text; they are read as spaces again.
        said = lambda i: F.translate(F.right(F.concat(F.right(F.coalesce(F.get(matches, i - 1), F.lit("")), F.lit(CONTEXT)), F.right(F.get(between, i), F.lit(CONTEXT))), F.lit(CONTEXT)), "\u0001", " ")

        def one(m, i, at):
            start = at + F.char_length(F.get(between, i))
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.char_length(m)).alias("end"), m.alias("value"), said(i).alias("before"), F.lit(base).alias("base"))

        return bound(lambda at: F.transform(matches, lambda m, i: one(m, i, F.get(at, i))), before(taken, lambda a, x: a + x, F.lit(0)))

    return bound(run, F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _free(sure: Column, unsure: Column) -> Column:
    """The unsure spans that overlap no sure one.

    In order of start, one overlaps if a sure span before it ends behind its
    start, or one after it starts before its end.
    """
    low, high = -1, 2**31 - 1
    keyed = lambda spans, sure: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(sure).alias("sure"), x.alias("x")))

    def run(line):
        back = F.reverse(line)
        ends = before(F.transform(line, lambda e: F.when(e["sure"], e["x"]["end"]).otherwise(low)), lambda a, x: F.greatest(a, x), F.lit(low))
        starts = before(F.transform(back, lambda e: F.when(e["sure"], e["start"]).otherwise(high)), lambda a, x: F.least(a, x), F.lit(high))
        marked = bound(lambda a, b: F.transform(line, lambda e, i: F.struct(e["x"].alias("x"), (~e["sure"] & (F.get(a, i) <= e["start"]) & (F.get(b, i) >= e["x"]["end"])).alias("ok"))), ends, F.reverse(starts))
        return F.transform(F.filter(marked, lambda e: e["ok"]), lambda e: e["x"])

    return bound(run, F.array_sort(F.concat(keyed(sure, True), keyed(unsure, False))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    d = F.reverse(_digits(value))
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.substring(d, i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)), F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))
    return total % 10 == 0


def candidates(docs: DataFrame, text: str = "text", into: str = "_spans") -> DataFrame:
    """docs with an array of candidate spans; null and empty texts have none.  A column ``into`` of docs gives way."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    empty = F.array().cast(_SPAN)
    some = lambda test, then: F.when(test, then).otherwise(empty)
    digit, emails, ips, cards, phones, more = names = fresh(docs, "digit", "emails", "ips", "cards", "phones", "more")
    digits = F.col(digit)
    email = some(F.contains(t, F.lit("@")), _found(t, EMAIL, "email", True))
    ip = some(digits & t.rlike("[0-9]\\.[0-9]"), F.filter(_found(t, IP, "ip", True), lambda x: x["value"].rlike(IP_VALID)))
    marked = F.regexp_replace(t, CARD_BREAK, "\u0001")
    card = F.filter(_found(marked, CARD, "card", True), lambda x: F.length(_digits(x["value"])).between(16, 19))
    card = some(digits & t.rlike("[0-9](?:[\\x20-]?[0-9]){15}"), F.transform(card, lambda x: x.withField("base", _luhn(x["value"]))))
    phone = some(digits & F.contains(t, F.lit("+")), F.filter(_found(t, PHONE, "phone", True), lambda x: F.length(_digits(x["value"])).between(8, 15)))
    loose = some(digits & t.rlike(LOOSE_PHONE), _found(t, LOOSE_PHONE, "phone", False))
    spelt = some(t.rlike("(?i)[\\[(]at[\\])]"), _found(t, LOOSE_EMAIL, "email", False))
    out = docs.withColumn(digit, t.rlike("[0-9]"))
    out = out.withColumns({emails: email, ips: ip, cards: card, phones: phone, more: F.concat(loose, spelt)})
    sure = F.concat(emails, ips, F.filter(cards, lambda x: x["base"]), phones)
    unsure = F.concat(F.filter(cards, lambda x: ~x["base"]), more)
    both = bound(lambda s, u: F.when(F.size(u) == 0, s).when(F.size(s) == 0, u).otherwise(F.concat(s, _free(s, u))), sure, unsure)
    return out.withColumn(into, both).drop(*(n for n in names if n != into))


def _votes(x: Column) -> dict[str, Column]:
    """Votes of the labelers on one span: 1 for, 0 against, -1 no opinion."""
    kind, value, n = x["kind"], x["value"], F.length(_digits(x["value"]))
    is_ = lambda k: kind == k
    pattern = F.when(is_("card"), F.when(x["base"], 1).otherwise(0)).when(is_("phone"), F.when(n.between(8, 15), 1).otherwise(-1)).when(is_("email"), F.when(x["base"], 1).otherwise(-1)).otherwise(1)
    known = F.when(is_("email"), F.lower(F.element_at(F.split(value, "[^A-Za-z0-9]+"), -1)).isin(TOP_DOMAINS).cast("int"))
    known = known.when(is_("card"), F.substring(_digits(value), 1, 2).isin(ISSUER_PREFIXES).cast("int"))
    known = known.when(is_("ip"), (~F.element_at(F.split(value, "\\."), 1).isin(RESERVED_NETWORKS)).cast("int"))
    known = known.when(is_("phone"), F.when(F.startswith(value, F.lit("+")), 1).otherwise(-1)).otherwise(-1)
    near = lambda k: x["before"].rlike(f"(?i)(?<![\\p{{L}}])({CONTEXT_WORDS[k]})[^\\p{{L}}]{{0,6}}$")
    context = F.lit(-1)
    for k in KINDS:
        context = F.when(is_(k), F.when(near(k), 1).otherwise(-1)).otherwise(context)
    other = F.lit(False)
    for k in KINDS:
        other = other | ((~is_(k)) & near(k) & (F.lit(k) != "ip"))
    return {"pattern": pattern, "gazetteer": known, "context": F.when((context == -1) & other, 0).otherwise(context)}


def _features(x: Column) -> dict[str, Column]:
    """What the final classifier sees of a span, each in a few values."""
    n = F.length(_digits(x["value"]))
    return {
        "digits": F.when(n < 8, "few").when(n < 13, "some").when(n < 16, "many").otherwise("most"),
        "shape": F.when(F.startswith(x["value"], F.lit("+")), "plus").when(F.contains(x["value"], F.lit("@")), "at").when(x["value"].rlike("[()\\[\\]]"), "brackets").when(x["value"].rlike("[\\x20-]"), "split").otherwise("plain"),
        "before": F.when(x["before"] == "", "start").when(x["before"].rlike("[:=#]\\x20?$"), "label").when(x["before"].rlike("\\s$"), "space").otherwise("other"),
    }


LABELERS = ("pattern", "gazetteer", "context")
FEATURES = ("digits", "shape", "before")
#: Passes of expectation-maximisation, and the share of true spans assumed before any is seen.
PASSES, PRIOR = 25, 0.5


def fit(spans: DataFrame, into: str = "_spans") -> dict:
    """Labeler reliabilities and classifier weights from all candidates of the corpus.

    What reaches the driver is one row per combination of kind, votes and
    features: at most 4 * 27 * 80 rows, whatever the corpus.  Without candidates
    the model keeps its priors.
    """
    one = spans.select(F.explode(into).alias("x"))
    x = F.col("x")
    one = one.select(x["kind"].alias("kind"), *[v.cast("int").alias(k) for k, v in _votes(x).items()], *[v.alias(f"f_{k}") for k, v in _features(x).items()])
    rows = [r.asDict() for r in one.groupBy(*one.columns).count().collect()]
    right = {k: {a: 0.8 for a in LABELERS} for k in KINDS}  # P(vote agrees with the truth)
    share = dict.fromkeys(KINDS, PRIOR)
    rows = sorted(rows, key=lambda r: tuple(str(v) for v in r.values()))
    for _ in range(PASSES):
        for r in rows:
            k, yes, no = r["kind"], math.log(share[r["kind"]]), math.log(1 - share[r["kind"]])
            for a in LABELERS:
                if r[a] >= 0:
                    p = right[k][a]
                    yes += math.log(p if r[a] == 1 else 1 - p)
                    no += math.log(1 - p if r[a] == 1 else p)
            r["true"] = 1 / (1 + math.exp(min(50, max(-50, no - yes))))
        for k in KINDS:
            of = [r for r in rows if r["kind"] == k]
            n = sum(r["count"] for r in of)
            share[k] = min(0.99, max(0.01, (1 + sum(r["count"] * r["true"] for r in of)) / (2 + n)))
            for a in LABELERS:
                seen = [r for r in of if r[a] >= 0]
                agree = sum(r["count"] * (r["true"] if r[a] == 1 else 1 - r["true"]) for r in seen)
                right[k][a] = min(0.99, max(0.55, (4 + agree) / (5 + sum(r["count"] for r in seen))))
    weights: dict[str, float] = {}
    for k in KINDS:
        of = [r for r in rows if r["kind"] == k]
        pos = sum(r["count"] * r["true"] for r in of)
        neg = sum(r["count"] * (1 - r["true"]) for r in of)
        weights[f"{k}|bias"] = math.log((pos + 1) / (neg + 1))
        for f in (*LABELERS, *(f"f_{f}" for f in FEATURES)):
            values = {r[f] for r in of}
            for v in sorted(values, key=str):
                p = sum(r["count"] * r["true"] for r in of if r[f] == v)
                n = sum(r["count"] * (1 - r["true"]) for r in of if r[f] == v)
                weights[f"{k}|{f}|{v}"] = math.log((p + 1) / (pos + len(values) + 1)) - math.log((n + 1) / (neg + len(values) + 1))
    return {"reliability": right, "share": share, "weights": weights}


def resolve(spans: DataFrame, model: dict, into: str = "_spans", threshold: float = 0.0) -> DataFrame:
    """Keep base spans and the loose ones that the classifier takes; ordered by kind as listed, then start."""
    w = F.create_map(*[F.lit(v) for kv in model["weights"].items() for v in kv])

    def taken(x):
        score = F.coalesce(w[F.concat(x["kind"], F.lit("|bias"))], F.lit(-1.0))
        for f, v in [*_votes(x).items(), *((f"f_{k}", v) for k, v in _features(x).items())]:
            score = score + F.coalesce(w[F.concat(x["kind"], F.lit(f"|{f}|"), v.cast("string"))], F.lit(0.0))
        return x["base"] | (score > threshold)

    order = F.array(*map(F.lit, KINDS))
    keyed = F.transform(F.filter(into, taken), lambda x: F.struct(F.array_position(order, x["kind"]).alias("o"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["base"].alias("base")))
    return spans.withColumn(into, F.array_sort(keyed))


def detect(docs: DataFrame, text: str = "text", model: dict | None = None, into: str = "spans") -> DataFrame:
    """docs plus ``into``: array of (o, start, end, kind, base) in code points, end exclusive.

    Every row keeps its own result, repeated rows included; null or empty text
    has an empty array; other columns pass through, but one named ``into`` gives
    way.  Time follows the text and its matches, not their square.  An empty
    table gives no rows.
    """
    if model is None:
        model = fit(candidates(docs.select(text), text))
    return resolve(candidates(docs, text, into), model, into)


def _cut(text: Column, heads: Column, base: Column, sizes: tuple) -> Column:
    """For each head (from, start, kind), the text from ``from`` to its start and the kind in angle brackets.

    Reaching a position takes a pass over the string, so pieces are cut from larger pieces.
    """
    if not sizes:
        return F.transform(heads, lambda h: F.concat(F.substring(text, h["from"] - base + 1, h["start"] - h["from"]), F.lit("<"), h["kind"], F.lit(">")))

    def piece(part):
        first, last = F.get(part, F.lit(0))["from"], F.element_at(part, -1)["start"]
        return bound(lambda inner, at: _cut(inner, part, at, sizes[1:]), F.substring(text, first - base + 1, last - first), first)

    return F.flatten(F.transform(chunks(heads, sizes[0]), lambda part: piece(part)))


def redact(docs: DataFrame, text: str = "text", model: dict | None = None) -> DataFrame:
    """docs with each span replaced by its kind in angle brackets; all columns kept, no rows dropped.

    Overlapping spans (an address inside a number, say) are one, of the kind that
    starts first.  Null and empty texts stay as they are; repeated rows each keep
    theirs.  Without a model, the candidates are found once and staged with the
    documents, and the model is fitted on them.
    """
    spans, = fresh(docs, "spans")
    if model is None:
        found = stage(candidates(docs, text, spans), "candidates")
        out = resolve(found, fit(found, spans), spans)
    else:
        out = detect(docs, text, model, spans)

    def cut(t, line):
        reach = before(F.transform(line, lambda x: x["end"]), lambda a, x: F.greatest(a, x), F.lit(0))
        placed = bound(lambda r: F.transform(line, lambda x, i: F.struct(F.get(r, i).alias("from"), x["start"].alias("start"), x["kind"].alias("kind"))), reach)
        end = F.array_max(F.transform(line, lambda x: x["end"]))
        heads = F.filter(placed, lambda x: x["start"] >= x["from"])
        return bound(lambda h, e: F.concat(F.array_join(_cut(t, h, F.lit(0), CUTS), ""), F.substring(t, e + 1, F.char_length(t))), heads, end)

    flat = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["end"].alias("end"), x["kind"].alias("kind"))))
    shown = F.when(F.size(spans) > 0, bound(cut, F.col(f"`{text}`"), flat)).otherwise(F.col(f"`{text}`"))
    return out.withColumn(text, shown).drop(spans)


def digest(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and digests per document row; the candidates are found once and staged without the texts."""
    named = docs.select(F.col(f"`{doc}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = stage(candidates(named).drop("text"), "spans")
    out = resolve(found, fit(found))
    base = F.filter("_spans", lambda x: x["base"])
    of = lambda k: lambda x: x["kind"] == k
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select(
        "doc_id", *[F.size(F.filter(base, of(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(said(base), 256).alias("base_sha256"), said(F.col("_spans")).alias("spans"))


__all__ = ["candidates", "detect", "digest", "fit", "redact", "resolve"]
