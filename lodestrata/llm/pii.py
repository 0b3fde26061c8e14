"""Personal data in texts by weak supervision, in DataFrame functions only.

Spans of four base kinds (email, ip, card, phone) follow fixed patterns and tests and are always
reported. Besides, wider patterns propose candidates of further kinds (secret, idnum, name,
hidden_email). Labelers vote on every candidate, base spans included: a format rule, a gazetteer
of cue and known words, the words before the span, and the make-up of its characters; each says
yes, no or nothing. Expectation-maximisation over the counts of vote patterns (at most 81,
whatever the corpus) estimates how reliable each labeler is and how likely each pattern marks
personal data. These probabilities are the soft labels of the final span classifier, a naive
Bayes model over a span's kind, length, neighbours and digits, which decides on the candidates.

Patterns are written so that matching takes time in proportion to a text: a run of characters
is entered at its start only, and never given back.

Defined cases: a null text counts as empty; very long texts are searched whole; other columns,
whatever their names, aren't read; without candidates the model has its start values;
rows that agree in id are treated one by one; a null id is kept; an empty table gives an empty
table. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise, text_or_empty

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "idnum", "name", "hidden_email")
KINDS = BASE + ADDED

_LOCAL = r"A-Za-z0-9._%+-"
#: Leftmost non-overlapping matches of the contract's patterns. A possessive run that starts where
#: no such character stands before it (or where the last match ended) is the leftmost.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole runs of digits with at most one separator between two, of the lengths that can be valid
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+(?:={1,2}+(?![A-Za-z0-9_/+=-]))?+",
    "idnum": r"(?<![0-9A-Za-z+.-])[0-9](?:[ ()./-]{0,2}[0-9]){6,}+(?![A-Za-z])",
    "name": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? \p{Lu}[\p{L}'-]++(?: \p{Lu}[\p{L}'-]++)?",
    "hidden_email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]++)++",
}
#: A cheap test that a text must pass before the pattern is tried.
_HINT = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){13}"),
    "phone": lambda t: t.contains("+"),
    "secret": lambda t: t.rlike(r"[A-Za-z0-9_/+-]{16}"),
    "idnum": lambda t: t.rlike(r"[0-9](?:[ ()./-]{0,2}[0-9]){6}"),
    "name": lambda t: t.rlike(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señora?)\.? \p{Lu}"),
    "hidden_email": lambda t: t.rlike(r"[\[(](?:at|AT)[\])]"),
}
_FOUND = "array<struct<start:int,end:int,m:string,prev:string,next:string>>"
_BEFORE = 40


_BLOCK = 256


def find_spans(text: Column, pattern: str, hint) -> Column:
    """Matches with start, end, and the text just before and after.

    The pieces between matches and the matches take turns, so running lengths give the offsets;
    they are summed by blocks, so that a text with very many matches doesn't take time with
    their square.
    """
    none = F.array().cast(_FOUND)
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def placed(p, m, lengths, before):
        def span(match, i):
            piece = F.get(p, i)
            block = F.floor(i / _BLOCK).cast("int")
            start = F.get(before, block) + total(F.slice(lengths, block * _BLOCK + 1, i % _BLOCK)) + F.length(piece)
            return F.struct(start.alias("start"), (start + F.length(match)).alias("end"), match.alias("m"), F.right(piece, F.lit(_BEFORE)).alias("prev"), F.left(F.get(p, i + 1), F.lit(2)).alias("next"))

        return F.transform(m, span)

    def summed(p, m, lengths):
        last = F.floor(F.size(lengths) / _BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK))))
        return let(blocks, lambda x: let(F.transform(x, lambda _, b: total(F.slice(x, F.lit(1), b))), lambda before: placed(p, m, lengths, before)))

    def matched(p, m):
        lengths = F.zip_with(F.slice(p, F.lit(1), F.size(m)), m, lambda a, b: F.length(a) + F.length(b))
        return F.when(F.size(m) == 0, none).otherwise(let(lengths, lambda x: summed(p, m, x)))

    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(hint(text), let(pieces, lambda p: let(matches, lambda m: matched(p, m)))).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    turned = F.split(F.reverse(digits), "")
    value = lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) % 10 + F.floor(x.cast("int") / 5).cast("int"))
    return F.aggregate(F.transform(F.filter(turned, lambda x: x != ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def _valid(kind: str):
    if kind == "ip":
        return lambda s: s["m"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return lambda s: F.when(F.length(_digits(s["m"])).between(14, 19), luhn(_digits(s["m"]))).otherwise(F.lit(False))
    if kind == "phone":
        return lambda s: F.length(_digits(s["m"])).between(10, 15)
    if kind == "secret":
        return lambda s: s["m"].rlike("^(?:AKIA|ASIA)[0-9A-Z]{16}$") | (s["m"].rlike("[0-9]") & s["m"].rlike("[A-Za-z]"))
    if kind == "idnum":
        return lambda s: F.length(_digits(s["m"])).between(7, 18)
    return lambda s: F.lit(True)


# Gazetteers of cue words, domains and prefixes.
CUES = {
    "email": "mail|email|e-mail|contact|courriel|correo|write",
    "ip": "ip|host|server|address|addr|login|client",
    "card": "card|visa|mastercard|amex|karte|carte|tarjeta|payment|credit",
    "phone": "tel|phone|call|mobile|fax|telefon|handy|whatsapp",
    "secret": "token|key|secret|password|passwd|pwd|api|bearer|auth|credential",
    "idnum": "ssn|passport|id|tax|account|iban|tel|phone|call|license|dni|nif|insurance",
    "name": "dear|by|from|author|contact|signed|sincerely",
    "hidden_email": "mail|email|e-mail|contact|courriel|correo|write",
}
AGAINST = "version|figure|fig|page|isbn|issn|order|chapter|section|vol|build|sha|commit|md5|doi|http|https|www"
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|de|fr|es|uk|io|info|eu)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^\+(?:1|7|2[07]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"^(?:gh[opsu]_|sk-|xox[abp]-|AKIA|ASIA|AIza|eyJ|[0-9a-f]{16,}$|[0-9A-F]{32,}$)",
    "idnum": r"^(?:0|[1-9][0-9]{2}[- ][0-9]{2}[- ][0-9]{4}$)",
    "name": r"^(?:Mrs?|Dr|Prof|Herr|Frau|Señora?)\b",
    "hidden_email": r"(?:com|org|net|edu|gov|de|fr|es|uk|io|info|eu)$",
}
FORMAT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",
    "ip": r"^[1-9][0-9]{0,2}(?:\.[0-9]{1,3}){3}$",
    "card": r"^(?:[0-9]{4}[ -]?){3}[0-9]{2,7}$",
    "phone": r"^\+[0-9]{1,3}[ (.-]",
    "secret": r"^(?:[0-9a-f]{16,}|[0-9A-F]{16,}|(?:AKIA|ASIA)[0-9A-Z]{16}|(?=[^A-Z]*+[A-Z])(?=[^a-z]*+[a-z])(?=[^0-9]*+[0-9]).{24,})$",
    "idnum": r"^(?:[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}|\(?0[0-9]{1,4}\)?[ /-].*)$",
    "name": r"^\p{L}+\.? \p{Lu}\p{Ll}+",
    "hidden_email": r"(?:\.|[\[(](?:dot|DOT)[\])])",
}
LABELERS = ("format", "gazetteer", "context", "makeup")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, s: Column) -> Column:
    m, prev = s["m"], F.lower(s["prev"])
    yes = prev.rlike(rf"(?:^|[^\p{{L}}])(?:{CUES[kind]})[^\p{{L}}]{{0,6}}(?:\p{{L}}+[^\p{{L}}]{{0,3}})?$")
    no = prev.rlike(rf"(?:^|[^\p{{L}}])(?:{AGAINST})[^\p{{L}}]{{0,3}}$")
    varied = F.size(F.array_distinct(F.split(m, "")))
    if kind in ("name", "hidden_email"):
        makeup = _vote(F.length(m).between(6, 40), F.length(m) > 80)
    elif kind == "secret":
        makeup = _vote((varied >= 9) & m.rlike("[0-9A-Z][^0-9]+[0-9A-Z]"), varied < 7)
    else:
        makeup = _vote(varied >= 5, varied < 4)
    none = F.lit(False)
    return F.array(_vote(m.rlike(FORMAT[kind]), none if kind in BASE else ~m.rlike(FORMAT[kind])), _vote(m.rlike(GAZETTEER[kind]), none), _vote(yes, no), makeup)


def _character(c: Column) -> Column:
    return F.when(c == "", "end").when(c.rlike(r"^[\x20\x09-\x0D]"), "space").when(c.rlike(r"^\p{L}"), "letter").when(c.rlike("^[0-9]"), "digit").when(c.rlike("^[\"'=:(\\[<]"), "opening").otherwise("other")


def _traits(kind: str, s: Column) -> Column:
    m = s["m"]
    share = F.round(5 * F.length(_digits(m)) / F.greatest(F.length(m), F.lit(1))).cast("string")
    return F.array(F.lit(f"kind={kind}"), F.concat(F.lit("length="), F.floor(F.log2(F.length(m))).cast("string")), F.concat(F.lit("before="), _character(F.right(s["prev"], F.lit(1)))), F.concat(F.lit("after="), _character(F.left(s["next"], F.lit(1)))), F.concat(F.lit("digits="), share))


def _overlaps(s: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id and ``spans``: every base span and candidate with its votes and traits."""
    texts = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    found = texts.select("_id", *[F.filter(find_spans(F.col("_text"), PATTERNS[k], _HINT[k]), _valid(k)).alias(k) for k in KINDS])
    base = F.concat(*[F.col(k) for k in BASE])
    free = found.select("_id", *BASE, *[F.filter(k, lambda s: ~_overlaps(s, base)).alias(k) for k in ADDED])
    free = free.withColumn("idnum", F.filter("idnum", lambda s: ~_overlaps(s, F.col("secret"))))

    def labelled(order: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), _votes(kind, s).alias("votes"), _traits(kind, s).alias("traits")))

    return free.select("_id", F.array_sort(F.concat(*[labelled(n, k) for n, k in enumerate(KINDS)])).alias("spans"))


# ---------------------------------------------------------------- expectation-maximisation

ROUNDS, SMOOTH = 25, 1.0
#: The start values count as so large a share of all candidates in every round: labelers are better
#: than chance, so a corpus in which nearly every candidate is personal data doesn't turn them round.
HELD = 0.05
_START_YES = [0.10, 0.30, 0.60]
_START_NO = [0.50, 0.40, 0.10]


def _posterior(state: Column, votes: Column) -> Column:
    def side(name: str, prior: Column) -> Column:
        terms = [F.log(F.get(state[name], F.lit(3 * j + 1) + F.get(votes, F.lit(j)))) for j in range(len(LABELERS))]
        return F.log(prior) + sum(terms[1:], terms[0])

    return 1 / (1 + F.exp(side("no", 1 - state["prior"]) - side("yes", state["prior"])))


def reliabilities(patterns: DataFrame) -> DataFrame:
    """One row: prior, ``yes`` and ``no`` (three probabilities for each labeler), and the patterns' posteriors.

    ``patterns``: votes and n, a row to a pattern. All of EM is a fold over a bounded array.
    """
    rows = patterns.agg(F.array_sort(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("rows"))
    start = F.struct(F.lit(0.5).alias("prior"), F.array(*[F.lit(x) for _ in LABELERS for x in _START_YES]).alias("yes"), F.array(*[F.lit(x) for _ in LABELERS for x in _START_NO]).alias("no"))
    zero = F.lit(0.0)
    total = lambda xs, f: F.aggregate(xs, zero, lambda a, x: a + f(x))
    held = HELD * total(F.col("rows"), lambda x: x["n"])

    def step(state, _):
        judged = F.transform(F.col("rows"), lambda r: F.struct(r["votes"].alias("votes"), (r["n"] * _posterior(state, r["votes"])).alias("q"), r["n"].alias("n")))

        def better(j):
            yes, no = total(j, lambda x: x["q"]), total(j, lambda x: x["n"] - x["q"])
            part = lambda f, k: total(j, lambda x: F.when(F.get(x["votes"], F.lit(k // 3)) == k % 3 - 1, f(x)).otherwise(0.0))
            return F.struct(
                ((yes + SMOOTH) / (yes + no + 2 * SMOOTH)).alias("prior"),
                F.array(*[(part(lambda x: x["q"], k) + SMOOTH + held * _START_YES[k % 3]) / (yes + 3 * SMOOTH + held) for k in range(3 * len(LABELERS))]).alias("yes"),
                F.array(*[(part(lambda x: x["n"] - x["q"], k) + SMOOTH + held * _START_NO[k % 3]) / (no + 3 * SMOOTH + held) for k in range(3 * len(LABELERS))]).alias("no"),
            )

        return let(judged, better)

    fitted = rows.select("rows", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step).alias("model"))
    return fitted.select("model", F.transform("rows", lambda r: F.struct(r["votes"].alias("votes"), _posterior(F.col("model"), r["votes"]).alias("p"))).alias("posteriors"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col and ``spans`` (start, end, kind, base), in order of start, then kind."""
    rows = materialise(candidates(docs, id_col, text_col), "spans")
    single = rows.select(F.explode("spans").alias("s")).select("s.*")
    fitted = materialise(reliabilities(single.groupBy("votes").agg(F.count("*").alias("n"))), "model")
    known = {tuple(x["votes"]): x["p"] for r in fitted.collect() for x in r["posteriors"]}  # at most 81 patterns
    p = F.lit(0.5)
    for votes, value in sorted(known.items()):
        p = F.when(F.col("votes") == F.array(*[F.lit(v) for v in votes]), F.lit(float(value))).otherwise(p)
    soft = single.select(p.alias("p"), F.explode(F.concat(F.col("traits"), F.array(F.lit("all")))).alias("trait"))
    sums = {r["trait"]: (r["yes"], r["no"]) for r in soft.groupBy("trait").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()}  # some dozens of traits
    yes, no = sums.pop("all", (0.0, 0.0))

    def weight(trait: str) -> float:
        import math

        a, b = sums[trait]
        return math.log((a + SMOOTH) / (yes + 8 * SMOOTH)) - math.log((b + SMOOTH) / (no + 8 * SMOOTH))

    import math

    prior = math.log((yes + SMOOTH) / (no + SMOOTH))
    weights = F.create_map(*[F.lit(x) for t in sorted(sums) for x in (t, weight(t))]) if sums else F.create_map().cast("map<string,double>")
    odds = lambda s: F.aggregate(s["traits"], F.lit(prior), lambda a, t: a + F.coalesce(F.try_element_at(weights, t), F.lit(0.0)))
    taken = F.filter("spans", lambda s: (s["order"] < len(BASE)) | (odds(s) > 0))
    return rows.select(F.col("_id").alias(id_col), F.transform(taken, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), (s["order"] < len(BASE)).alias("base"))).alias("spans"))


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, counts of the base kinds, base_sha256 and spans as text."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: lambda s: s["base"] & (s["kind"] == kind)
    counts = [F.size(F.filter("spans", of(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(id_col, *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
