"""Secret scan with Spark expressions only: fixed patterns, and sliding-window entropy.

*Base* spans come from three patterns. *Entropy* spans come from candidate strings (runs of
one character class): a window slides over each candidate, its Shannon entropy follows from
counts that are kept from window to window, one taken out and one put in, and windows at or above
the threshold of the class are merged into spans. A window has to hold a letter and a digit.
Candidates that match the allow-list (UUIDs, integrity hashes, placeholders) add no entropy
spans; base spans are never suppressed.

A text is scanned whole, in the row it is in: no shuffle, no Python. Long candidates are cut
into blocks that overlap by a window less one, and matches are placed by chunks, so the work stays
linear in the text also where matches are many.

Defined cases: a null or empty text has no spans; positions are code points, the end is
exclusive; rows are kept as they are (repeated ids are repeated in the result); other
columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base patterns: values fixed by the contract of the scan. A run of a class is maximal, so a
# minimum inside the pattern equals dropping short matches; assignments are dropped afterwards,
# because a short one hides what it overlaps.
ASSIGN = (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]+)")
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Class name -> (candidate pattern, window, least entropy in bits per character).
CLASSES = {
    "entropy_hex": (r"[0-9A-Fa-f]{24,}", 24, 3.0),
    "entropy_base64": (r"[0-9A-Za-z+/_=-]{32,}", 32, 4.2),
}
#: The characters of all classes by their number, from 1: digits, letters, others.
_ALPHABET = string.digits + string.ascii_letters + "+/_=-"
_DIGITS, _LETTERS = len(string.digits), len(string.digits + string.ascii_letters)
#: Candidates that look random and are no secrets.
ALLOW_LIST = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^sha(?:256|384|512)-",
    r"(?i:example|placeholder|changeme|xxxxxx|123456789|abcdefghijkl)",
)
_BLOCK = 1024
_CHUNK = 128
_NO_SPANS = "array<struct<start:bigint,end:bigint>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chunks(items: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of each stretch of ``_CHUNK`` items."""
    return _let(items, lambda own: F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.size(own) - 1) / _CHUNK), F.lit(0)).cast("int")),
        lambda n: body(F.slice(own, n * _CHUNK + 1, F.lit(_CHUNK)))))


def _located(text: Column, pattern: str) -> Column:
    """``(start, end, found, value)`` of every match; value is group 2 of assignments."""
    group = 2 if pattern == ASSIGN else 0
    zipped = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
        F.split(text, pattern).alias("gap"))
    matched = F.filter(zipped, lambda x: x["found"].isNotNull())
    kind = "array<struct<start:bigint,end:bigint,found:string,value:string>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("spans"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.char_length(x["gap"])
        end = begin + F.char_length(x["found"])
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(F.struct(
            begin.alias("start"), end.alias("end"), x["found"].alias("found"),
            x["value"].alias("value")))).alias("spans"))

    def shifted(chunks: Column, offsets: Column) -> Column:
        return F.flatten(F.transform(chunks, lambda c, n: F.transform(c["spans"], lambda s: F.struct(
            (s["start"] + F.get(offsets, n)).alias("start"), (s["end"] + F.get(offsets, n)).alias("end"),
            s["found"].alias("found"), s["value"].alias("value")))))

    # an array that grows by one is copied each time, so matches are placed by chunks, and chunks by
    # their lengths
    spans = _let(_chunks(matched, lambda part: F.aggregate(part, start, step)), lambda chunks: _let(
        F.aggregate(chunks, F.array(F.lit(0).cast("long")),
                    lambda at, c: F.concat(at, F.array(F.element_at(at, -1) + c["at"]))),
        lambda offsets: shifted(chunks, offsets)))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(kind))


def _tagged(spans: Column, kind: str, order: int) -> Column:
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"),
        F.lit(kind).alias("kind")))


def _n_log_n(n: Column) -> Column:
    return n * F.log2(F.greatest(n, F.lit(1)))


def _counted(counts: Column, code: Column, by: int) -> Column:
    """The counts with that of one character moved; ``code`` 0 is no character."""
    here = F.greatest(code, F.lit(1))
    return F.when(code > 0, F.concat(
        F.slice(counts, F.lit(1), here - 1), F.array(F.get(counts, here - 1) + by),
        F.slice(counts, here + 1, F.lit(len(_ALPHABET))))).otherwise(counts)


def _is(code: Column, first: int, last: int) -> Column:
    return ((code > first) & (code <= last)).cast("int")


def entropy_spans(candidate: Column, window: int, least: float) -> Column:
    """Merged windows of ``candidate`` whose entropy is at least ``least``.

    With counts n of the characters, entropy is log2(w) - sum(n log2 n) / w. The counts are kept: a
    step takes the character that leaves out of them and puts the one that enters in, and changes the
    sum by the terms of these two.
    """
    start = F.struct(
        F.lit(0).alias("i"), F.array_repeat(F.lit(0), len(_ALPHABET)).alias("counts"),
        F.lit(0).alias("digits"), F.lit(0).alias("letters"), F.lit(0.0).alias("sum"),
        F.lit(-1).cast("long").alias("begin"), F.lit(-1).cast("long").alias("end"),
        F.array().cast(_NO_SPANS).alias("spans"))

    def moved(state: Column, entering: Column, leaving: Column) -> Column:
        """The state of the window one character on, its spans as they were."""
        def entered(counts: Column) -> Column:
            n_in = F.get(counts, entering - 1)
            n_out = F.coalesce(F.get(state["counts"], leaving - 1), F.lit(1))
            return F.struct(
                (state["i"] + 1).alias("i"), _counted(counts, entering, 1).alias("counts"),
                (state["digits"] + _is(entering, 0, _DIGITS) - _is(leaving, 0, _DIGITS)).alias("digits"),
                (state["letters"] + _is(entering, _DIGITS, _LETTERS)
                 - _is(leaving, _DIGITS, _LETTERS)).alias("letters"),
                (state["sum"] + (_n_log_n(n_in + 1) - _n_log_n(n_in))
                 - (_n_log_n(n_out) - _n_log_n(n_out - 1))).alias("sum"))

        return _let(_counted(state["counts"], leaving, -1), entered)

    def step(state: Column, now: Column) -> Column:
        high = ((now["i"] >= window) & (now["digits"] > 0) & (now["letters"] > 0)
                & (F.round(F.log2(F.lit(window)) - now["sum"] / window, 9) >= least))
        begin = (now["i"] - window).cast("long")
        apart = high & (state["begin"] >= 0) & (begin > state["end"])
        closed = F.array(F.struct(state["begin"].alias("start"), state["end"].alias("end")))
        return F.struct(
            *(now[n].alias(n) for n in ("i", "counts", "digits", "letters", "sum")),
            F.when(high & ((state["begin"] < 0) | apart), begin).otherwise(state["begin"]).alias("begin"),
            F.when(high, now["i"].cast("long")).otherwise(state["end"]).alias("end"),
            F.when(apart, F.concat(state["spans"], closed)).otherwise(state["spans"]).alias("spans"))

    def slid(codes: Column) -> Column:
        def next_one(state: Column, code: Column) -> Column:
            leaving = F.coalesce(F.get(codes, state["i"] - window), F.lit(0))
            return _let(moved(state, code, leaving), lambda now: step(state, now))

        return F.aggregate(codes, start, next_one, lambda state: F.when(
            state["begin"] >= 0, F.concat(state["spans"], F.array(F.struct(
                state["begin"].alias("start"), state["end"].alias("end"))))).otherwise(state["spans"]))

    codes = F.transform(F.sequence(F.lit(1), F.char_length(candidate)), lambda i: F.position(
        F.substr(candidate, i, F.lit(1)), F.lit(_ALPHABET)))
    return _let(codes, slid)


def _merged(spans: Column) -> Column:
    """Spans with overlapping and touching ones joined. A span that starts later also ends later, as
    all are unions of windows of one length; so each is compared with its neighbours only."""
    def joined(own: Column) -> Column:
        first = F.filter(own, lambda s, n: (n == 0) | (s["start"] > F.get(own, n - 1)["end"]))
        last = F.filter(own, lambda s, n: (n == F.size(own) - 1) | (F.get(own, n + 1)["start"] > s["end"]))
        return F.arrays_zip(F.transform(first, lambda s: s["start"]).alias("start"),
                            F.transform(last, lambda s: s["end"]).alias("end"))

    return _let(F.array_sort(spans), joined)


def _entropy(text: Column, pattern: str, window: int, least: float,
             allow_list: tuple[str, ...]) -> Column:
    allowed = "|".join(f"(?:{x})" for x in allow_list) or "(?!)"
    candidates = F.filter(_located(text, pattern), lambda c: ~c["found"].rlike(allowed)
                          & c["found"].rlike("[0-9]") & c["found"].rlike("[A-Za-z]"))

    def blocks(c: Column) -> Column:
        last = F.floor((F.char_length(c["found"]) - 1) / _BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.struct(
            (c["start"] + F.greatest(b * _BLOCK - window + 1, F.lit(0))).alias("start"),
            F.substr(c["found"], F.greatest(b * _BLOCK - window + 2, F.lit(1)),
                     F.least(b * _BLOCK, F.lit(window - 1)) + _BLOCK).alias("found")))

    found = F.flatten(F.transform(F.flatten(F.transform(candidates, blocks)), lambda c: F.transform(
        entropy_spans(c["found"], window, least), lambda s: F.struct(
            (c["start"] + s["start"]).alias("start"), (c["start"] + s["end"]).alias("end")))))
    return F.when(text.rlike(pattern), _merged(found)).otherwise(F.array().cast(_NO_SPANS))


def scan_secrets(docs: DataFrame, allow_list: tuple[str, ...] = ALLOW_LIST) -> DataFrame:
    """``doc_id``, ``base`` and ``spans``: arrays of ``(start, order, end, kind)`` by start,
    then kind; ``spans`` holds the base and the entropy spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id", text.alias("text"),
        F.filter(_located(text, ASSIGN), lambda m: F.char_length(m["value"]) >= ASSIGN_LEAST)
         .alias("assign"),
        _located(text, ACCESS).alias("access"), _located(text, HEX).alias("hex"))
    fixed = F.array_sort(F.concat(*(_tagged(F.col(k), k, n) for n, k in
                                    enumerate(("assign", "access", "hex")))))
    added = [_tagged(_entropy(F.col("text"), *how, allow_list), kind, 3 + n)
             for n, (kind, how) in enumerate(CLASSES.items())]
    return base.select("doc_id", fixed.alias("base"),
                       F.concat(*added).alias("added")).select(
        "doc_id", "base", F.array_sort(F.concat("base", "added")).alias("spans"))


def _written(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_digest(found: DataFrame) -> DataFrame:
    def of(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"),
                        of("hex").alias("n_hex"), F.sha2(_written("base"), 256).alias("base_sha256"),
                        _written("spans").alias("spans"))
