"""Text functions as column expressions: normalising, tokens, shingles, intents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a token of a text and of a label.
TOKEN = r"[a-z0-9]+(?:-[a-z0-9]+)*"
LABEL_TOKEN = r"[A-Za-z0-9][A-Za-z0-9._'\-/%]*"

# Word lists of the question analysis.
STOPWORDS = "a an and are as at be by can do does for from has have how i in is it its many much must of on or our that the their there these this to was we what when where which who why will with you your".split()
SUBTOPIC_STOP = "design summarise summarize explain describe outline give provide complete entire whole overview workflow process steps list extract group all every".split()
ENGLISH_FUNCTION_WORDS = "a an the is are was were be do does did how what which who when where why many much of for to in on at and or not can must should would will have has get gets there their my our i we you if than then with from".split()
COMMON_CAPITALISED = "I HR IT Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December".split()
ENUMERATION_STOP = "a all an and any are as at available be by can complete different do does each every everything exist exists for from full get give has have how in is it kind kinds list many me my of on or our please provide show some tell that the there these they this those to type types us we what which with you your".split()
NUMERIC_CUES = ["score", "scores", "scored", "marks", "mark", "grade", "grades", "how much", "how many", "amount", "rate", "rates", "days", "highest", "lowest", "total", "count", "maximum", "minimum", "max", "min", "top", "above", "below", "over", "under"]
MULTI_ANSWER_CUES = ["all", "every", "each", "list", "lists", "compare", "comparison", "why", "explain", "summarize", "summarise", "summary", "breakdown", "overview", "tell me about", "describe"]
MAX_CUES = ["highest", "greatest", "largest", "most", "top", "maximum", "max"]
MIN_CUES = ["lowest", "smallest", "least", "minimum", "min"]
ABOVE_CUES = ["above", "over", "more than", "greater than", "at least", "exceeds"]
BELOW_CUES = ["below", "under", "less than", "fewer than", "at most"]
# Patterns that mark the kind of a question, in the order they are tried.
INTENT_PATTERNS = {
    "cross_document": r"\b(across (?:all|our|the) (?:documents|policies|handbooks)|conflict\w*|inconsisten\w*|reconcile|both (?:documents|policies))\b",
    "exhaustive": r"\b(all|every|each|list|enumerate|complete list|full list|group all|how many (?:different|types|kinds)|what are the)\b",
    "comparison": r"\b(compar\w*|differ\w*|versus|vs\.?|between .+ and |more than|less than|higher than|lower than|instead of|as opposed to|relative to)\b",
    "synthesis": r"\b(summar\w+|overview|explain everything|explain the (?:entire|whole)|design a (?:complete )?workflow|brief me|what do i need to know|across (?:all|the) (?:docs|documents|policies))\b",
    "procedural": r"\b(how do i|how does one|how to|steps|procedure|process for|walk me through|what is the process|in order to)\b",
    "multi_hop": r"\b(therefore|because of|given that|based on (?:its|their)|which means|as a result of)\b",
}
FORCE_EXHAUSTIVE = r"\b(all|every|each|everything|list|enumerate|complete list|full list|group all)\b"
ARTIFACT_WIDE = r"\b(guide|playbook|checklist|manual|sop|onboarding|policy|journey|timeline)\b"
RARE_TOKEN = r"(?i)\b(?:[A-Z]{1,4}-\d{1,4}|[A-Z]{2,}[-\s]?\d{2,4}|Tier\s?\d|P\d|TLS\s?\d(?:\.\d)?|AES-?\d{3}|SOC\s?\d)\b"
META_QUESTION = r"\b(what did i (?:ask|say)|what was my (?:last |previous |first |earlier )?question|what did you (?:say|tell me|answer|respond)|what have we (?:talked about|discussed|been discussing)|(?:summarize|recap) (?:this|our|the) conversation|remind me what i asked|what questions (?:have i|did i) ask)\b"
# The small synonym map of column names.
SYNONYMS = {
    "marks": ["score", "grade", "result"], "mark": ["score", "grade"], "score": ["marks", "grade", "result"], "scores": ["marks", "grade"],
    "grade": ["score", "marks"], "result": ["score", "marks"], "pay": ["salary", "compensation"], "salary": ["pay", "compensation"],
    "dept": ["department"], "deadline": ["due date", "due"], "due": ["deadline"], "meaning": ["description", "definition"],
    "action": ["required action", "remedy", "fix"], "cost": ["price", "amount", "rate"], "price": ["cost", "amount", "rate"], "limit": ["threshold", "maximum"],
}


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def normalise_label(text: Column) -> Column:
    """Brackets to spaces, spaces squeezed, edge punctuation cut (letters and digits of any script stay), lower case."""
    return F.lower(F.regexp_replace(squeeze(F.regexp_replace(text, r"[()\[\]{}\n]", " ")), r"^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$", ""))


def normalise_item(text: Column) -> Column:
    """Section number dropped, spaces squeezed, lower case."""
    return F.lower(squeeze(F.regexp_replace(text, r"^\s*\d+(?:\.\d+)*[.)]?\s+", "")))


def normalise_context(text: Column) -> Column:
    return F.lower(squeeze(text))


def bm25_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def word_count_tokens(text: Column) -> Column:
    """How many tokens a text has, by words and single marks: the engine's stand-in for a model's tokenizer."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]"), F.lit(0)))


def let(value: Column, body) -> Column:
    """``body(x)`` with ``value`` computed once and bound to x, not spelt out wherever x stands."""
    return F.transform(F.array(value), body)[0]


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words joined by spaces; a shorter text is one run, an empty one none."""

    def of(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        return F.when(F.size(w) > 0, grams).otherwise(F.array().cast("array<string>"))

    return let(words, of)


def shingles(text: Column, n: int = 8) -> Column:
    return F.array_distinct(ngrams(F.filter(F.split(normalise_context(text), " "), lambda w: w != ""), n))


def first_cue(question: Column, cues: list[str]) -> Column:
    """The first of ``cues`` that stands in the question as whole words, or the empty text."""
    text = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(F.lower(question), "[^a-z0-9 ]+", " "), r"\s+", " "), F.lit(" "))

    def found(t):
        out = F.lit("")
        for cue in reversed(cues):
            out = F.when(t.contains(f" {cue} "), F.lit(cue)).otherwise(out)
        return out

    # bound once, not spelt out for every cue
    return F.transform(F.array(text), found)[0]


def intent(question: Column) -> Column:
    """The kind of question by its first matching pattern, null if none matches."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(INTENT_PATTERNS.items()):
        out = F.when(question.rlike(f"(?i){pattern}"), F.lit(name)).otherwise(out)
    return out


def looks_english(question: Column) -> Column:
    tokens = F.regexp_extract_all(F.lower(question), F.lit("[a-z']+"), F.lit(0))
    return (F.size(tokens) < 4) | F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in ENGLISH_FUNCTION_WORDS]))


def mentions_entity(question: Column, own_names: list[str] | None = None) -> Column:
    """A capitalised run that neither opens the question nor is a common one; ``own_names``: of the house itself, common too."""
    runs = F.regexp_extract_all(question, F.lit(r"\b[A-Z][a-zA-Z]{2,}(?:\s+[A-Z][a-zA-Z]{2,})*\b"), F.lit(0))
    opening = F.regexp_replace(F.get(F.split(strip(question), r"\s+"), F.lit(0)), r"^[?,.]+|[?,.]+$", "")
    return F.exists(runs, lambda r: (F.get(F.split(r, r"\s+"), F.lit(0)) != opening) & ~r.isin([*COMMON_CAPITALISED, *(own_names or [])]))


def looks_simple(question: Column) -> Column:
    marks = F.length(question) - F.length(F.replace(question, F.lit("?"), F.lit("")))
    return (F.length(question) <= 140) & (marks <= 1) & ~F.lower(question).contains(" and ") & ~mentions_entity(question) & looks_english(question) & intent(question).isNull()


def query_type(question: Column, exhaustive_trigger: bool = False, artifact_expansion: bool = False) -> Column:
    """The kind of question, a plain lookup where no pattern says otherwise, with the optional overrides."""
    base = F.coalesce(intent(question), F.lit("fact_lookup"))
    plain = base.isin("fact_lookup", "procedural")
    out = base
    if artifact_expansion:
        out = F.when(plain & question.rlike(f"(?i){ARTIFACT_WIDE}"), F.lit("synthesis")).otherwise(out)
    if exhaustive_trigger:
        out = F.when(plain & question.rlike(f"(?i){FORCE_EXHAUSTIVE}"), F.lit("exhaustive")).otherwise(out)
    return out


def is_meta_question(question: Column) -> Column:
    return question.rlike(f"(?i){META_QUESTION}")


def keywords(question: Column) -> Column:
    """Identifier-like tokens as written, then content words in lower case, first occurrences only."""
    rare = F.regexp_extract_all(question, F.lit(RARE_TOKEN), F.lit(0))
    words = F.filter(F.transform(F.regexp_extract_all(question, F.lit(r"[A-Za-z][A-Za-z0-9'-]+"), F.lit(0)), F.lower), lambda w: ~w.isin(STOPWORDS) & (F.length(w) > 2))
    return _first_in_any_case(F.concat(rare, words))


def _first_in_any_case(values: Column) -> Column:
    """The strings of an array without those that differ from an earlier one in case only."""

    def firsts(v: Column, low: Column) -> Column:
        return F.filter(F.transform(v, lambda w, i: F.when(F.array_position(low, F.get(low, i)) == i + 1, w)), lambda w: w.isNotNull())

    return let(values, lambda v: let(F.transform(v, F.lower), lambda low: firsts(v, low)))


def subject_terms(question: Column, limit: int = 6) -> Column:
    words = F.regexp_extract_all(question, F.lit(r"[A-Za-z][A-Za-z0-9'-]+"), F.lit(0))
    good = F.filter(words, lambda w: ~F.lower(w).isin(STOPWORDS + SUBTOPIC_STOP) & (F.length(w) > 2))
    return F.array_join(F.slice(good, 1, limit), " ")


def singular(word: Column) -> Column:
    w = F.lower(word)
    ending = lambda *xs: F.greatest(*[w.endswith(x) for x in xs]) if len(xs) > 1 else w.endswith(xs[0])
    return (
        F.when(ending("ies") & (F.length(w) > 4), F.concat(F.left(w, F.length(w) - 3), F.lit("y")))
        .when(ending("sses", "ches", "shes"), F.left(w, F.length(w) - 2))
        .when(ending("s") & ~w.endswith("ss"), F.left(w, F.length(w) - 1))
        .otherwise(w)
    )


def word_match(term: Column, text: Column) -> Column:
    """Every word of ``term`` stands in ``text`` as a word, perhaps with a plural ending."""
    words = F.split(normalise_item(term), " ")
    hay = normalise_item(text)
    has = lambda w: F.regexp_like(hay, F.concat(F.lit(r"\b"), F.regexp_replace(w, r"([^A-Za-z0-9_ ])", r"\\$1"), F.lit(r"(?:s|es|ies)?\b")))
    return (hay != "") & F.forall(words, has)


def is_heading(text: Column) -> Column:
    """Short line that opens with a section number, or is in title or upper case without a closing mark."""
    words = F.split(strip(text), r"\s+")
    n = F.size(words)
    upper = text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{Ll}")
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    numbered = text.rlike(r"^\d+(?:\.\d+)*\.?\s+\S.{0,80}$")
    fits = (F.length(text) > 0) & (F.length(text) <= 90) & ~text.contains("\n")
    plain = ~text.rlike(r"[.:;,]$") & ~text.rlike(r"\bP[1-4]\b.*\d+-\s*$") & n.between(1, 12) & (upper | (capital >= F.greatest(F.lit(2), n - 1)))
    return fits & F.when(numbered, ~text.endswith(".") | (n <= 6)).otherwise(plain)


def snippet(text: Column, limit: int = 260) -> Column:
    """At most ``limit`` characters, cut at a space."""
    flat = squeeze(text)
    head = F.left(flat, F.lit(limit))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(head, r"\s+\S*$", ""), F.lit("…")))


def citation_label(source: Column, path: Column, page: Column, page_end: Column) -> Column:
    pages = F.when(page_end > page, F.concat(F.lit("pp. "), page.cast("string"), F.lit("–"), page_end.cast("string"))).otherwise(F.concat(F.lit("p. "), page.cast("string")))
    return F.concat_ws(", ", source, F.nullif(path, F.lit("")), pages)


def clean_text(text: Column) -> Column:
    """Line ends unified, words rejoined across hyphenated breaks, bare page numbers dropped, blank runs squeezed."""
    out = F.regexp_replace(text, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"(\p{Ll})-\n(\p{Ll})", "$1$2")
    out = F.regexp_replace(out, r"(\p{Ll})- (\p{Ll})", "$1$2")
    out = F.regexp_replace(out, r"(?m)^\s*\d{1,4}\s*$\n?", "")
    # a line that ends in no closing mark and is followed by one in lower case was wrapped
    out = F.regexp_replace(out, r"([^.:;!?\n])\n(?=\p{Ll})", "$1 ")
    return strip(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def breadcrumb(parts: Column) -> Column:
    """The parts joined by ' > ', without blanks and without repeats in any case."""
    return F.array_join(_first_in_any_case(F.filter(parts, lambda p: strip(p) != "")), " > ")


def clean_labels(labels: Column, most: int, longest: int = 120) -> Column:
    """The first ``most`` labels of an array: spaces squeezed, edge marks cut, repeats in any case left out, cut to ``longest``.

    A label beyond ``longest`` is held against none, as only what it is cut to is kept.
    """
    bare = F.transform(F.filter(labels, lambda x: x.isNotNull()), lambda x: F.regexp_replace(squeeze(x), r"^[ .;,]+|[ .;,]+$", ""))

    def firsts(v: Column, low: Column) -> Column:
        kept = F.transform(v, lambda x, i: F.when((F.length(x) > longest) | (F.array_position(low, F.get(low, i)) == i + 1), F.substring(x, 1, longest)))
        return F.slice(F.filter(kept, lambda x: x.isNotNull()), 1, most)

    return let(F.filter(bare, lambda x: x != ""), lambda v: let(F.transform(v, F.lower), lambda low: firsts(v, low)))


def is_refusal(text: Column) -> Column:
    """Whether an answer, freed of markdown and quotes, is the fixed refusal."""
    bare = F.lower(F.regexp_replace(text, r"[*_`>#\"'“”‘’]|^\s*[-+]\s+", ""))
    return squeeze(bare).rlike(r"^i don.?t know based on the available documents\.?$")
