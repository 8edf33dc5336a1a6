"""Fingerprints of documents as sums of wide vectors hashed from the pieces of their paragraphs.

A text falls into pieces: paragraphs and sentences, in parts of about ``PIECE`` characters. SHA-256 makes of each piece a
vector of 240 numbers 0 or 1, and a fingerprint is the sum of the vectors of all pieces, each number modulo 2**14, with the
count of the pieces before them. So the order of the pieces does not matter, equal multisets of pieces have equal
fingerprints, and pieces are inserted and deleted by adding and subtracting their vectors, without the rest of the text.

Twice a sum less the count is a sum of numbers 1 or -1. The cosine of two such vectors therefore estimates that of the two
multisets of pieces, with a deviation of about 1/16 for texts that share nothing: that is the likeness. It is exact within
the modulus, which a piece repeated more than 8,192 times leaves; equality of fingerprints is not touched by that.

Four numbers stand in one word, 15 bits apart: 14 for the number and one that takes the carry of an addition and is cleared.
All of it is SQL functions on columns.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentrace.llm.common import let, with_ids, with_text

#: Characters after which a piece ends with the word, where no sentence or paragraph ends before.
PIECE = 48
#: Numbers in a word, bits from one to the next, bits of a number, words that one digest gives for each bit shift.
LANES, SPACING, BITS, PARTS = 4, 15, 14, 4
#: Ranges of documents for each shuffle partition; each one's neighbours are found in one task.
RANGES = 4

_SPACE, _END = r" \t\n\x0B\f\r", r"\n.!?;:|"
_PIECES = f"[^{_END}]{{1,{PIECE}}}[^{_END}{_SPACE}]{{0,{PIECE}}}[{_END}]*[{_SPACE}]*|[{_END}]+[{_SPACE}]*"
_ONES = sum(1 << (SPACING * i) for i in range(LANES))
_MASK, _CARRY = _ONES * ((1 << BITS) - 1), _ONES << BITS


def pieces(text: Column) -> Column:
    """The text in pieces, which joined give it again; where they end depends on nothing that stands after them."""
    return F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0))


def summed(items: Column) -> Column:
    """The vector of an array of pieces: their count, then 60 words of four numbers each."""

    def of(digests: Column) -> Column:
        def words(part: int) -> Column:
            bits = F.transform(digests, lambda d: F.conv(F.substring(d, 1 + 15 * part, 15), 16, 10).cast("long"))
            ones = lambda shift: lambda a, x: (a + F.call_function("shiftright", x, shift).bitwiseAND(F.lit(_ONES))).bitwiseAND(F.lit(_MASK))
            return let(bits, lambda b: F.transform(F.sequence(F.lit(0), F.lit(SPACING - 1)), lambda s: F.aggregate(b, F.lit(0).cast("long"), ones(s))))

        count = F.array(F.size(digests).cast("long").bitwiseAND(F.lit((1 << BITS) - 1)))
        return F.concat(count, *(words(p) for p in range(PARTS)))

    return let(F.transform(items, lambda p: F.sha2(p.cast("binary"), 256)), of)


def fingerprint(text: Column) -> Column:
    """The vector of a text; null counts as empty, and an empty text has the vector of zeros."""
    return summed(pieces(F.coalesce(text, F.lit(""))))


def inserted(a: Column, b: Column) -> Column:
    """The vector of all pieces of two vectors."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(_MASK)))


def deleted(a: Column, b: Column) -> Column:
    """The vector of the pieces of ``a`` without those of ``b``."""
    return F.zip_with(a, b, lambda x, y: (x + (F.lit(_CARRY) - y)).bitwiseAND(F.lit(_MASK)))


def printed(v: Column) -> Column:
    """A vector as a string: the words in hexadecimal, joined."""
    return F.array_join(F.transform(v, lambda x: F.lpad(F.lower(F.hex(x)), 15, "0")), "")


def signs(v: Column) -> Column:
    """The sums of 1 and -1 that a vector stands for, read modulo 2**14 about zero."""
    half, low = 1 << (BITS - 1), (1 << BITS) - 1
    lanes = lambda w: F.array(*(F.call_function("shiftright", w, F.lit(SPACING * i)).bitwiseAND(F.lit(low)) for i in range(LANES)))
    signed = lambda n: lambda c: F.pmod(c * 2 - n + half, F.lit(1 << BITS)) - half
    return let(v[0], lambda n: F.transform(F.flatten(F.transform(F.slice(v, 2, SPACING * PARTS), lanes)), signed(n)))


def product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: the cosine of the sums behind two vectors, 0 where it is negative; 1 for equal vectors, 0 if just one is of zeros."""

    def of(pair: Column) -> Column:
        # either product fits a word, their product does not where both texts repeat a piece thousands of times
        size = F.sqrt(product(pair["x"], pair["x"]).cast("double") * product(pair["y"], pair["y"]).cast("double"))
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(product(pair["x"], pair["y"]).cast("double"), size), F.lit(0.0))))

    return F.when(a == b, 1.0).otherwise(let(F.struct(signs(a).alias("x"), signs(b).alias("y")), of))


def edited_text(text: Column, after: Column) -> Column:
    """A text whose last third of code points is replaced by the first as many of ``after``, or all if it has fewer."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(after, F.lit(1), third))


def edited_vector(text: Column, vector: Column, edited: Column) -> Column:
    """The vector of ``edited_text`` from that of the text: the changed pieces are deleted, those in their place inserted.

    All pieces that end before the change stay but the last, which may go on into it.
    """
    head = F.substring(text, F.lit(1), F.length(text) - F.floor(F.length(text) / 3).cast("int"))

    def of(s: Column) -> Column:
        same = F.slice(s["all"], F.lit(1), s["same"])
        gone = F.slice(s["all"], s["same"] + 1, F.size(s["all"]))
        come = pieces(F.substring(edited, F.length(F.array_join(same, "")) + 1, F.length(edited)))
        return inserted(deleted(vector, summed(gone)), summed(come))

    return let(F.struct(pieces(text).alias("all"), F.greatest(F.lit(0), F.size(pieces(head)) - 1).alias("same")), of)


def _range(bounds: list[int]) -> Column:
    """How many of the bounds lie below doc_id: first among every so many bounds, then among those between."""
    if not bounds:
        return F.lit(0)
    step = isqrt(len(bounds)) + 1
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    lasts = F.lit([g[-1] for g in groups])
    count = lambda some: F.size(F.filter(some, lambda b: b < F.col("doc_id")))
    within = lambda g: g * step + count(F.get(F.lit(bounds_of(groups, step)), g))
    return let(count(lasts), lambda g: F.when(g < len(groups), within(g)).otherwise(len(bounds)))


def bounds_of(groups: list[list[int]], step: int) -> list[list[int]]:
    """Groups of one size; what is missing in the last counts as above every id."""
    return [g + [(1 << 63) - 1] * (step - len(g)) for g in groups]


def with_next(rows: DataFrame, what: list[str]) -> DataFrame:
    """Rows (doc_id, text, ...) with ``next``, a struct of ``what`` of the next row by falling doc_id; the first row follows the last.

    The ids are split into ranges of about equal size, as many as ``RANGES`` for each shuffle partition, and each range holds
    a guest too: the first row of the range after it. So texts travel once, and the driver sees only one id a range. Rows
    that share an id stand in order of their texts, all in one range, which a task streams through with Spark's spilling.
    """
    spark = rows.sparkSession
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("b")).first()["b"]
    place = _range(sorted(set(found or [])))
    firsts = sorted(rows.select("doc_id", place.alias("range")).groupBy("range").agg(F.max("doc_id").alias("doc_id")).collect(), key=lambda r: -r["range"])
    if not firsts:
        return rows.withColumn("next", F.struct(*what)).where("false")
    follows = list(zip(firsts, firsts[1:] + firsts[:1], strict=True))
    hosts = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(g["doc_id"]).cast("long").alias("doc_id"), F.lit(r["range"]).alias("range")) for r, g in follows))))
    guests = rows.join(F.broadcast(hosts), "doc_id").withColumn("guest", F.lit(True))
    both = rows.withColumns({"range": place, "guest": F.lit(False)}).unionByName(guests)
    order = Window.partitionBy("range").orderBy("guest", F.desc("doc_id"), "text")
    return both.withColumn("next", F.lead(F.struct(*what)).over(order)).where("not guest").drop("range", "guest")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited, vector, edited_vector, near_edited, near_next): one row for each row of ``docs``.

    A null text is empty, a null id stands after all others, and rows that share an id stand in order of their texts. A text
    that the edit leaves as it is has likeness 1. A table of one row follows itself, an empty one gives no rows; columns other
    than doc_id and text are not read.
    """
    rows = with_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = with_next(rows.withColumn("vector", fingerprint(F.col("text"))), ["text", "vector"])
    out = out.withColumn("edited", edited_text(F.col("text"), F.col("next")["text"]))
    out = out.select("doc_id", F.length("text").cast("long").alias("n_chars"), "edited", "vector", F.col("next")["vector"].alias("after"), edited_vector(F.col("text"), F.col("vector"), F.col("edited")).alias("edited_vector"))
    near = {"near_edited": likeness(F.col("vector"), F.col("edited_vector")), "near_next": likeness(F.col("vector"), F.col("after"))}
    return with_ids(out.withColumns(near).drop("after"))
