"""Secret scans with built-in functions only.

Three kinds are found by pattern (``assign``, ``access``, ``hex``). The fourth, ``entropy``, slides a window over each
candidate string, keeps the counts of its characters by adding one and taking one away, and marks the stretch from
the first to the last window whose Shannon entropy reaches the bound of the candidate's character class. Entropies
are summed as whole numbers of millionths, so they do not depend on the order of steps. Candidates that read like words and
numbers, and those of an allow-list, are dropped.

Spans count code points, the end is exclusive. Defined results: a null text is empty and has no spans; repeated rows are
scanned each; a string that is both a pattern's and of high entropy has a span of each kind.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecast_duel.llm.common import unused

# The patterns of known kinds, in the order of their listing, and the least length of what they find.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA and more, 18 characters at least: shorter runs hold no longer match
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Classes of candidates, the first that matches counts, and the least entropy in bits of a window. At least 95 % of random
#: windows of 20 characters of a class reach its bound.
CLASSES = (
    ("hex", r"^[0-9a-fA-F]+$", 3.0), ("lower", r"^[0-9a-z]+$", 3.5), ("upper", r"^[0-9A-Z]+$", 3.45),
    ("letters", r"^[A-Za-z]+$", 3.65), ("mixed", r"", 3.75))
#: A candidate with a digit must hold one of these borders: words and numbers joined by signs have none.
BORDER = r"[a-z][A-Z0-9]|[0-9][A-Za-z]|[A-Z][0-9]|[A-Z][A-Z][a-z]"
#: A candidate of letters alone must hold small letters and this: names in camel case do not.
UNLIKE_WORDS = r"[A-Z][A-Z]"
#: Candidates that match are never marked: repeated or counted-up fillers.
ALLOWED = (r"(?i)(example|sample|dummy|placeholder|xxxx)", r"(?i)0123456789|abcdefghij")

#: c * log2(c) in millionths for a character that a window holds c times.
TERMS = [0] + [round(c * log2(c) * 1e6) for c in range(1, WINDOW + 1)]

SPAN = "array<struct<start:int,kind:int,end:int>>"


def located(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as structs of start and string; a text without one is not split."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    walked = F.aggregate(
        F.arrays_zip(between.alias("gap"), matches.alias("hit")),
        F.struct(F.lit(0).alias("at"), F.lit(None).cast("array<struct<start:int,hit:string>>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.char_length(x["gap"]) + F.coalesce(F.char_length(x["hit"]), F.lit(0))).alias("at"),
            F.when(x["hit"].isNull(), a["out"]).otherwise(F.concat(
                F.coalesce(a["out"], F.array().cast("array<struct<start:int,hit:string>>")),
                F.array(F.struct((a["at"] + F.char_length(x["gap"])).alias("start"), x["hit"].alias("hit"))),
            )).alias("out")),
        lambda a: a["out"],
    )
    return F.when(F.size(matches) > 0, walked).otherwise(F.array().cast("array<struct<start:int,hit:string>>"))


def as_spans(found: Column, kind: str) -> Column:
    number = KINDS.index(kind)
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), F.lit(number).alias("kind"), (m["start"] + F.char_length(m["hit"])).alias("end")))


def sliding(hit: Column, least: Column, window: int = WINDOW) -> Column:
    """Start of the first window and end of the last one whose entropy reaches ``least`` bits; null if none does.

    The state holds the count of every letter of the alphabet and the sum of c * log2(c) over them.
    """
    terms = F.array(*(F.lit(t).cast("long") for t in TERMS))
    codes = F.transform(F.split(hit, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    # A window's entropy is log2(window) minus the sum over its letters divided by the window.
    most = F.floor((F.lit(log2(window)) - least) * F.lit(window * 1e6)).cast("long")

    def step(a: Column, x: Column) -> Column:
        out = F.when(x["i"] >= window, F.get(a["codes"], x["i"] - window)).otherwise(F.lit(0))
        came = F.get(a["counts"], x["code"])
        less = F.when(out == x["code"], came).otherwise(came + 1)
        gone = F.get(a["counts"], out)
        total = a["sum"] + F.when(out == x["code"], F.lit(0).cast("long")).otherwise(
            F.get(terms, less) - F.get(terms, came)
            + F.when(out > 0, F.get(terms, gone - 1) - F.get(terms, gone)).otherwise(F.lit(0).cast("long")))
        counts = F.transform(a["counts"], lambda c, i: c + F.when(i == x["code"], 1).otherwise(0) - F.when((i == out) & (out > 0), 1).otherwise(0))
        high = (x["i"] >= window - 1) & (total <= most)
        return F.struct(
            a["codes"].alias("codes"), counts.alias("counts"), total.alias("sum"),
            F.when(high & a["first"].isNull(), x["i"] - window + 1).otherwise(a["first"]).alias("first"),
            F.when(high, x["i"] + 1).otherwise(a["last"]).alias("last"))

    start = F.struct(
        codes.alias("codes"), F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0).cast("long").alias("sum"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    steps = F.transform(codes, lambda c, i: F.struct(i.alias("i"), c.alias("code")))
    return F.aggregate(steps, start, step, lambda a: F.when(a["first"].isNotNull(), F.struct(a["first"].alias("first"), a["last"].alias("last"))))


def likely(hit: Column) -> Column:
    """Whether a candidate is scored at all."""
    digits = hit.rlike("[0-9]") & hit.rlike(BORDER)
    letters = hit.rlike("^[A-Za-z]+$") & hit.rlike("[a-z]") & hit.rlike(UNLIKE_WORDS)
    return (digits | letters) & ~hit.rlike("|".join(f"(?:{p})" for p in ALLOWED))


def least_entropy(hit: Column) -> Column:
    bound = F.when(hit.rlike(CLASSES[0][1]), CLASSES[0][2])
    for _, pattern, bits in CLASSES[1:-1]:
        bound = bound.when(hit.rlike(pattern), bits)
    return bound.otherwise(CLASSES[-1][2])


def entropy_spans(text: Column) -> Column:
    candidates = F.filter(located(text, CANDIDATE), lambda m: likely(m["hit"]))
    marked = F.transform(candidates, lambda m: F.struct(
        m["start"].alias("start"),
        sliding(m["hit"], least_entropy(m["hit"])).alias("at")))
    return F.transform(F.filter(marked, lambda m: m["at"].isNotNull()), lambda m: F.struct(
        (m["start"] + m["at"]["first"]).alias("start"), F.lit(KINDS.index("entropy")).alias("kind"), (m["start"] + m["at"]["last"]).alias("end")))


def spans_by_kind(text: Column) -> dict[str, Column]:
    assign = F.filter(located(text, ASSIGN), lambda m: F.char_length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= ASSIGN_LEAST)
    return {
        "assign": as_spans(assign, "assign"), "access": as_spans(located(text, ACCESS), "access"),
        "hex": as_spans(located(text, HEX), "hex"), "entropy": entropy_spans(text)}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text (empty for null), n_assign, n_access, n_hex, n_entropy, and all spans (start, kind, end) by start and kind."""
    source = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = source.select(id_col, "_text", *(c.alias(f"_{k}") for k, c in spans_by_kind(F.col("_text")).items()))
    return found.select(
        id_col, F.col("_text").alias("text"), *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.array_sort(F.concat(*(f"_{k}" for k in KINDS))).cast(SPAN).alias("spans"))


def without_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its texts replaced by a mark; a null text stays null."""
    spans = F.array_sort(F.concat(*spans_by_kind(F.col(text_col)).values())).cast(SPAN)
    name = unused("_spans", docs.columns)
    marked = docs.withColumn(name, F.when(F.col(text_col).isNotNull(), spans))
    return marked.withColumn(text_col, F.when(F.col(name).isNotNull(), redacted(F.col(text_col), F.col(name), mark))).drop(name)


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] != KINDS.index("entropy"))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span, overlapping ones as one, replaced by a mark."""
    done = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.struct(
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)))
            .otherwise(a["out"]).alias("out"),
            F.greatest(a["at"], s["end"]).alias("at")),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)
