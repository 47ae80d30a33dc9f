"""Line dedup by a deletion-neighbourhood join, within one edit.

A line goes when an earlier line (by ``doc_id``, then place in the text) equals it or is one
insertion, deletion or substitution of a character away. Lines are judged on the input, so the
result does not depend on the order of work.

1. *Equal lines* fold into one: the earliest place of each distinct line, by an aggregation that
   combines on the map side, so a line that makes up a third of all rows costs one row a task.
2. *Half and block keys.* One edit leaves the first or the last half of a line intact, and all but
   one block of sixteen characters. Lines that share neither with another line have no
   neighbour; only the others go on. Both filters lose no pair. Lines of up to ``SHORT`` characters,
   of which too little is left for either key to tell them apart, all go on, with all their blocks.
3. *Deletion neighbourhood.* Each remaining line emits, as hashed keys, the line itself and all
   variants with one character deleted; a variant also carries the place of the deletion. Lines
   with an equal variant *and* place differ by one substitution at most, all with each other, so
   the earliest of them stands for all: no pairs within the group. A line that equals a variant of
   another differs from it by one insertion; there is one such line a key, as equal lines are
   folded. Every pair within one edit meets in one of the two ways.
4. The edit distance of each line to the line it met is verified on the texts, and where an
   earlier one is near, the line goes.

Defined cases: null and empty texts have no lines to compare; lines without a word are never
compared and stay, all others are compared at any length; a text that lost all its compared lines
may be left with blank ones or none; rows with an equal ``doc_id`` are told apart
by their text, and equal rows all stay or lose the same lines; a row with a null ``doc_id``
comes after all others; other columns are kept by ``dedup_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemart.llm.common import cut, packed

#: Every line with a word is compared, from one character on.
LEAST_CHARS = 1
#: Lines of up to so many characters skip the half and block keys.
SHORT = 20
_WORD = "[^\\x20\\x09-\\x0D]"
#: Lengths of halves are multiples of this, so that nearly all lines have one on each side.
_HALF_STEP = 8
_BLOCK = 16


def _half(n: Column) -> Column:
    return F.floor(n / 2 / _HALF_STEP).cast("int") * _HALF_STEP


def half_keys(line: Column) -> Column:
    """Hashes of the first and the last half, for this length and for one character less: of two
    lines one edit apart, the longer has the halves of the shorter among its own."""
    n = F.char_length(line)

    def both(h: Column) -> Column:
        return F.array(F.xxhash64(F.lit("first"), h, F.substr(line, F.lit(1), h)),
                       F.xxhash64(F.lit("last"), h, F.substr(line, n - h + 1, h)))
    return F.array_distinct(F.concat(both(_half(n)), both(_half(n - 1))))


def _last_block(n: Column) -> Column:
    return F.floor((n - 1) / _BLOCK).cast("int")


def block_keys(line: Column) -> Column:
    """(key, block): hashes of the line without one block, in the length of the line and, for the
    longer of two, one character less; what follows the block is counted from the end."""
    n = F.char_length(line)

    def without(shorter: Column, k: Column) -> Column:
        rest = F.greatest(shorter - (k + 1) * _BLOCK, F.lit(0))
        return F.struct(F.xxhash64(shorter, k, F.substr(line, F.lit(1), k * _BLOCK),
                                   F.substr(line, n - rest + 1, rest)).alias("key"), k.alias("block"))

    return F.flatten(F.transform(F.sequence(F.lit(0), _last_block(n)),
                                 lambda k: F.array(without(n, k), without(n - 1, k))))


def variant_keys(line: Column, blocks: Column) -> Column:
    """(key, kind): the line itself (``w``) and its variants with one character of the named blocks
    deleted (the longer of two lines has one character more there), each once with the place
    (``p``, to meet substitutions) and once without (``d``, to meet the line that equals it)."""
    def entry(kind: str, *parts: Column) -> Column:
        return F.struct(F.xxhash64(*parts).alias("key"), F.lit(kind).alias("kind"))

    def deleted(i: Column) -> Column:
        rest = F.concat(F.substr(line, F.lit(1), i - 1), F.substr(line, i + 1))
        return F.array(entry("p", F.lit("place"), i, rest), entry("d", F.lit("line"), rest))

    places = F.array_distinct(F.flatten(F.transform(blocks, lambda k: F.sequence(
        k * _BLOCK + 1, F.least((k + 1) * _BLOCK + 1, F.char_length(line))))))
    return F.array_append(F.flatten(F.transform(places, deleted)), entry("w", F.lit("line"), line))


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents, packed, with a key of the row: ``row_doc`` orders (null last), ``row_tag``, 128 bits of
    hashes, tells rows with an equal id apart by their text."""
    text = F.coalesce("text", F.lit(""))
    return packed(docs).select(
        "_row", "text", F.coalesce(F.col("_row.doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("row_doc"),
        F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("tag"), text).alias("b")).alias("row_tag"),
        F.split(text, "\n").alias("row_lines"))


def _sharing(each: DataFrame) -> DataFrame:
    """The rows (h1, h2, key, ...) with a key that another line has as well."""
    shared = (each.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b"))
              .where("a < b").select("key"))
    return each.join(shared, "key", "left_semi")


def _near_pairs(lines: DataFrame) -> DataFrame:
    """Hashes of the earlier (a1, a2) and the later line (b1, b2) that met in the deletion neighbourhood."""
    keys = cut(lines.select(F.struct("place", "h1", "h2").alias("member"),
                            F.inline(variant_keys(F.col("line"), F.col("blocks")))), "line-variants")

    def least(kind: str) -> Column:
        return F.min(F.when(F.col("kind") == kind, F.col("member")))

    shared = (keys.groupBy("key").agg(F.count("*").alias("n"), least("p").alias("earliest"),
                                      least("w").alias("whole")).where("n > 1").drop("n"))
    met = keys.where("kind <> 'w'").join(shared, "key").select(
        "member", F.when(F.col("kind") == "p", F.col("earliest")).otherwise(F.col("whole")).alias("other"))
    a, b = F.least("other", "member"), F.greatest("other", "member")
    return met.where((F.col("other.h1") != F.col("member.h1")) | (F.col("other.h2") != F.col("member.h2"))).select(
        a["h1"].alias("a1"), a["h2"].alias("a2"), b["h1"].alias("b1"), b["h2"].alias("b2")).distinct()


def removed_lines(keyed: DataFrame) -> DataFrame:
    """``row_doc``, ``row_tag`` and the places of the lines that go."""
    lines = keyed.select("row_doc", "row_tag", F.posexplode("row_lines").alias("at", "line")).where(
        (F.char_length("line") >= LEAST_CHARS) & F.col("line").rlike(_WORD))
    n = F.char_length("line")
    # a line of SHORT characters goes on in any case, and is there to be met by one of SHORT + 1
    placed = cut(lines.select(
        F.struct("row_doc", "row_tag", "at").alias("place"), F.xxhash64("line").alias("h1"),
        F.hash(F.lit("line"), "line").alias("h2"), (n <= SHORT).alias("short"),
        F.when(n >= SHORT, half_keys(F.col("line"))).alias("halves")),
        "line-places")
    first = placed.groupBy("h1", "h2").agg(F.min("place").alias("first"))

    # texts of the short lines and of those that share a half, from their earliest place
    line = ["h1", "h2"]
    halves = _sharing(placed.select(*line, F.explode("halves").alias("key")))
    going = halves.select(*line).unionByName(placed.where("short").select(*line)).distinct()
    wanted = (first.join(going, line, "left_semi")
              .groupBy(F.col("first.row_doc").alias("row_doc"), F.col("first.row_tag").alias("row_tag"))
              .agg(F.collect_list(F.struct(F.col("first.at").alias("at"), *line)).alias("wanted")))
    some = (keyed.select("row_doc", "row_tag", "row_lines").join(wanted, ["row_doc", "row_tag"])
            .select("row_doc", "row_tag", F.inline(F.transform("wanted", lambda w: F.struct(
                w["at"].alias("at"), w["h1"].alias("h1"), w["h2"].alias("h2"),
                F.get("row_lines", w["at"]).alias("line"))))))
    some = cut(some.select(F.struct("row_doc", "row_tag", "at").alias("place"), *line, "line")
               .dropDuplicates(line), "line-halves")
    blocks = _sharing(cut(some.where(n >= SHORT).select(*line, F.inline(block_keys(F.col("line")))),
                          "line-block-keys"))
    longer = some.where(n > SHORT).join(
        blocks.groupBy(*line).agg(F.collect_set("block").alias("blocks")), line)
    close = cut(some.where(n <= SHORT).withColumn("blocks", F.sequence(
        F.lit(0), _last_block(n))).unionByName(longer), "line-blocks")

    def texts_of(x: str) -> DataFrame:
        return close.select(F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"), F.col("line").alias(f"line_{x}"))

    near = (_near_pairs(close).join(texts_of("a"), ["a1", "a2"]).join(texts_of("b"), ["b1", "b2"])
            .where(F.levenshtein("line_a", "line_b", 1).between(0, 1))
            .select(F.col("b1").alias("h1"), F.col("b2").alias("h2")).distinct().withColumn("near", F.lit(True)))
    judged = first.join(near, line, "left")
    return (placed.select("place", *line).join(judged, line)
            .where(F.col("near") | (F.col("place") > F.col("first")))
            .groupBy("place.row_doc", "place.row_tag").agg(F.collect_set("place.at").alias("row_gone")))


def dedup_rows(docs: DataFrame) -> DataFrame:
    """``_row`` (the other columns of ``docs``), ``text`` without the lines that go, ``n_lines`` before
    and ``n_removed``."""
    keyed = _keyed(docs)
    gone = removed_lines(keyed)
    joined = keyed.join(gone, ["row_doc", "row_tag"], "left")
    stays = F.array_except(F.sequence(F.lit(0), F.size("row_lines") - 1), "row_gone")
    kept = F.array_join(F.transform(stays, lambda i: F.get("row_lines", i)), "\n")
    return joined.select(
        "_row", F.when(F.col("row_gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.size("row_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("row_gone"), F.lit(0)).cast("long").alias("n_removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` but those named as the results, with the lines that go taken out of
    ``text``, and two more: ``n_lines`` before and ``n_removed``."""
    found = dedup_rows(docs)
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return found.select(*(F.col("_row")[c].alias(c) for c in others), "text", "n_lines", "n_removed")
