"""Text expressions: builders of Columns that stay inside the JVM. Offsets are code points unless they say bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ALNUM = r"[\p{L}\p{N}]"
GLOBAL_SHINGLE = 12


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def schema_with(df: DataFrame, more: str) -> StructType:
    """The schema of ``df`` and, after it, of the columns in ``more``."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def normalize(text: Column) -> Column:
    """White space runs become one space; trimmed; lower-cased."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def tokens(text: Column) -> Column:
    """Lower-cased tokens between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def raw_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def finditer(text: Column, pattern: str) -> Column:
    """Array of (start, value) of all matches of a pattern without groups; starts count from 0.

    The pieces between matches and the matches alternate, so a match starts where all before it end.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def body(both: Column) -> Column:
        fold = F.aggregate(
            F.arrays_zip(both["p"], both["m"]),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,value:string>>").alias("out")),
            lambda s, x: F.struct((s["at"] + F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"), F.when(x["m"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct((s["at"] + F.length(x["p"])).alias("start"), x["m"].alias("value"))))).alias("out")),
        )
        return fold["out"]

    return F.when(F.size(found) > 0, let(F.struct(pieces.alias("p"), found.alias("m")), body)).otherwise(F.array().cast("array<struct<start:int,value:string>>"))


def shingles(normalized: Column, k: int = GLOBAL_SHINGLE) -> Column:
    """Distinct character k-grams; a shorter text is one shingle, an empty text none."""
    n = F.length(normalized)
    starts = F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)))
    # Slices of a character array: a substring would walk the text from its beginning each time.
    grams = F.array_distinct(let(F.split(normalized, ""), lambda c: F.transform(starts, lambda i: F.array_join(F.slice(c, i, F.lit(k)), ""))))
    return F.when(n == 0, F.array().cast("array<string>")).when(n < k, F.array(normalized)).otherwise(grams)


def token_match(haystack: Column, needle: Column) -> Column:
    """Some occurrence of the needle whose alphanumeric ends are not continued by alphanumeric neighbours."""
    quoted = F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    before = F.when(needle.rlike(f"^{ALNUM}"), F.lit(f"(?<!{ALNUM})")).otherwise(F.lit(""))
    after = F.when(needle.rlike(f"{ALNUM}$"), F.lit(f"(?!{ALNUM})")).otherwise(F.lit(""))
    return F.regexp_like(haystack, F.concat(before, quoted, after))


def member(haystack: Column, shingle: Column) -> Column:
    """Shingles of the full global length match anywhere, shorter ones at token boundaries."""
    return F.when(F.length(shingle) >= GLOBAL_SHINGLE, F.contains(haystack, shingle)).otherwise(token_match(haystack, shingle))


def coverage(shingle_array: Column, haystack: Column) -> Column:
    """Share of the shingles found in the haystack; 1.0 for none."""
    n = F.size(shingle_array)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.size(F.filter(shingle_array, lambda s: member(haystack, s))) / n)


def byte_offset(text: Column, chars: Column) -> Column:
    """The UTF-8 byte offset of a code point offset."""
    return F.octet_length(F.substring(text, F.lit(1), chars))


# Characters that optical recognition confuses, and ligatures with their letters.
OCR_FROM, OCR_TO = "01|5", "olls"
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl"}


def canonicalize(text: Column) -> Column:
    """Lower case, one space for white space, trimmed, recognition confusions folded, ligatures spelled out."""
    return _folded(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _folded(text: Column) -> Column:
    out = F.translate(F.lower(text), OCR_FROM, OCR_TO)
    for a, b in LIGATURES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def canonical_map(text: Column) -> Column:
    """For each canonical character the offset of its source character (white space: of the run's first)."""
    lead = F.length(F.regexp_extract(text, r"^\s*", 0))
    last = F.length(F.regexp_replace(text, r"\s+$", ""))
    blank = lambda c: F.coalesce(c.rlike(r"^\s$"), F.lit(False))
    none = F.array().cast("array<int>")

    def body(x: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            outside = (i < x["lead"]) | (i >= x["last"]) | (c == "")
            return F.when(outside | (blank(c) & blank(F.get(x["chars"], i - 1))), none).when(c.isin(*LIGATURES), F.array(i, i)).otherwise(F.array(i))

        return F.flatten(F.transform(x["chars"], one))

    return let(F.struct(F.split(text, "").alias("chars"), lead.alias("lead"), last.alias("last")), body)


def source_offset(text: Column, canonical: Column, at: Column) -> Column:
    """The element ``at`` of ``canonical_map`` without that array: the words before it, and their gaps, have known lengths."""
    body = F.regexp_replace(text, r"^\s+", "")
    before = F.substring(canonical, F.lit(1), at)
    words = F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))  # whole words before it
    parts = F.struct(F.split(body, r"\s+").alias("words"), F.regexp_extract_all(body, F.lit(r"\s+"), F.lit(0)).alias("gaps"), words.alias("n"), F.length(F.substring_index(before, " ", -1)).alias("k"))
    length = lambda a, n: F.length(F.array_join(F.slice(a, F.lit(1), n), ""))

    def within(x: Column) -> Column:
        word = F.get(x["words"], x["n"])
        each = F.flatten(F.transform(F.split(word, ""), lambda c, i: F.array_repeat(i, F.length(_folded(c)))))
        # Only ligatures and a few letters change their length; the character after a word is its gap's first.
        return F.when(F.length(_folded(word)) == F.length(word), x["k"]).otherwise(F.coalesce(F.get(each, x["k"]), F.length(word)))

    return F.length(text) - F.length(body) + let(parts, lambda x: length(x["words"], x["n"]) + length(x["gaps"], x["n"]) + within(x))


def occurrences(text: Column, part: Column) -> Column:
    """Occurrences that don't overlap; 0 for an empty part."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")).otherwise(0)


def redact(text: Column, spans: Column, mask: str) -> Column:
    """The text with every (start, stop) span replaced, from the right so that offsets stay true."""
    order = F.reverse(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))))
    return F.aggregate(order, text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.lit(mask), F.substring(t, s["stop"] + 1, F.length(t))))


def four_token_chunks(text: Column, n: int = 4) -> Column:
    """Consecutive spans of n tokens; a text without tokens is one chunk as it is."""

    def body(t: Column) -> Column:
        return F.when(F.size(t) == 0, F.array(text)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1)), F.lit(n)), lambda i: F.array_join(F.slice(t, i, n), " ")))

    return let(raw_tokens(text), body)


def jaccard(a: Column, b: Column) -> Column:
    """Token overlap: 1.0 if neither has tokens, 0.0 if one has none."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    none, one = (F.size(x) == 0) & (F.size(y) == 0), (F.size(x) == 0) | (F.size(y) == 0)
    return F.when(none, 1.0).when(one, 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def context_words(text: Column, start: Column, stop: Column, window: int) -> Column:
    """Up to ``window`` words on each side of a span, lower-cased."""
    pick = lambda t: F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0))
    if window <= 0:
        return F.array().cast("array<string>")
    before = let(pick(F.substring(text, F.lit(1), start)), lambda a: F.slice(a, F.greatest(F.size(a) - window + 1, F.lit(1)), F.lit(window)))
    return F.concat(before, F.slice(pick(F.substring(text, stop + 1, F.length(text))), 1, window))


def interleave(a: Column, b: Column) -> Column:
    """a1, b1, a2, b2 ... to the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.flatten(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.array(x, y)))


def collapse_gaps(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, " {2,}", " "))


def lines(text: Column) -> Column:
    """Lines that are not blank."""
    return F.filter(F.split(text, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")


CELL = r"\t|\s{2,}|\s*\|\s*"


def cells(line: Column) -> Column:
    return F.filter(F.split(line, CELL), lambda c: c != "")
