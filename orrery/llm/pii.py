"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score. Built-in functions only.

The places of matches come from the text split at the pattern: the pieces between matches are added up in blocks, so
the work stays near the number of matches. Patterns are possessive and start only where a run of their characters
starts (or the last match ended), which gives the same leftmost matches as the plain forms in linear time and constant
stack on texts of any length. The context of a span is the end of the piece before it and the start of the one after.

Kinds: email, ip (parts to 255), card (13 to 19 digits, Luhn), phone (+, 9 to 15 digits), and iban (mod 97).

Defined results: a null or empty text has no spans; each row is judged by itself; spans of one kind never overlap, those
of different kinds may; positions count code points from 0, the end is exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orrery.llm.common import plain, table

#: Lengths added up at a time.
BLOCK = 64
BEFORE, AFTER = 40, 24
SPAN = "array<struct<kind:string,start:long,end:long,text:string,score:double>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def offsets(numbers: Column) -> Column:
    """For each number the sum of those before it, in time near their count."""

    def with_blocks(n: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / BLOCK).cast("int")), lambda b: total(F.slice(n, b * BLOCK + 1, BLOCK)))
        return let(blocks, lambda sums: let(F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b))), lambda base: F.transform(n, lambda _, i: F.get(base, F.floor(i / BLOCK).cast("int")) + total(F.slice(n, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)))))

    return let(numbers, with_blocks)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    def add(d: Column) -> Column:
        def one(acc: Column, i: Column) -> Column:
            v = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
            twice = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
            return acc + F.when(i % 2 == 1, twice).otherwise(v)

        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), one) % 10 == 0

    return let(digits(text), add)


def mod97(text: Column) -> Column:
    def rest(t: Column) -> Column:
        moved = F.concat(F.substring(t, 5, 64), F.substring(t, 1, 4))

        def one(acc: Column, c: Column) -> Column:
            v = F.ascii(c)
            return F.when(v < 65, acc * 10 + v - 48).otherwise(acc * 100 + v - 55) % 97

        return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(one(a, c))) == 1

    return let(F.replace(text, F.lit(" "), F.lit("")), rest)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: Callable[[Column], Column]
    prior: float
    context: str


# The patterns, the words that make a kind likelier nearby, and the scores without them.
KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 0.8, r"mail|contact|write|kontakt|correo|courriel"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$"), 0.6, r"\bip\b|address|host|server|adresse|client"),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])", luhn, 0.7, r"card|visa|master|credit|debit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(digits(m)).between(9, 15), 0.6, r"phone|tel|call|mobile|fax|handy|portable"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", mod97, 0.8, r"iban|bank|account|konto|compte|cuenta"),
]
BASE = ("email", "ip", "card", "phone")
BONUS = 0.15


def spans_of(text: Column, kind: Kind) -> Column:
    """All confirmed spans of a kind, by start."""

    def place(found: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            lengths = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))

            def shape(at: Column) -> Column:
                def one(m: Column, i: Column) -> Column:
                    gap, after = F.get(gaps, i), F.get(gaps, i + 1)
                    start = F.get(at, i) + F.length(gap)
                    near = F.lower(F.concat(F.right(gap, F.lit(BEFORE)), F.lit(" "), F.left(after, F.lit(AFTER)))).rlike(kind.context)
                    return F.struct(F.lit(kind.name).alias("kind"), start.cast("long").alias("start"), (start + F.length(m)).cast("long").alias("end"), m.alias("text"), (F.lit(kind.prior) + F.when(near, BONUS).otherwise(0.0)).alias("score"))

                return F.transform(found, one)

            return let(offsets(lengths), shape)

        return let(F.split(text, kind.pattern, -1), with_gaps)

    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    placed = let(matches, lambda m: F.when(F.size(m) > 0, place(m)).otherwise(F.array().cast(SPAN)))
    return F.filter(placed, lambda s: kind.valid(s["text"]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end, text, score) for every row, by kind, then start."""
    rows = plain(docs, id_col, text_col)
    return rows.select("doc_id", F.concat(*(spans_of(F.col("text"), k) for k in KINDS)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text with every match that is confirmed put as its kind in angle brackets, kind after kind."""
    rows = plain(docs, id_col, text_col)
    text = F.col("text")
    for k in KINDS:
        text = let(text, masking(k))
    return rows.select("doc_id", text.alias("text"))


def masking(kind: Kind) -> Callable[[Column], Column]:
    def mask(text: Column) -> Column:
        def weave(found: Column) -> Column:
            def parts(gaps: Column) -> Column:
                shown = F.transform(found, lambda m, i: F.concat(F.get(gaps, i), F.when(kind.valid(m), F.lit(f"<{kind.name}>")).otherwise(m)))
                return F.array_join(F.concat(shown, F.array(F.get(gaps, F.size(found)))), "")

            return let(F.split(text, kind.pattern, -1), parts)

        return let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, weave(m)).otherwise(text))

    return mask


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    counts = [count_of(k) for k in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    best = F.aggregate("spans", F.lit(0.0), lambda a, s: F.greatest(a, s["score"]))
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), best.alias("top_score"))
