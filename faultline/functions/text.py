"""Text expressions: whitespace clean-up, chunking, token estimates. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.schemas import CHUNK_CHARACTERS

# Fixed value: the code points of the ECMAScript white space (its trim() and `\s`).
SPACE_POINTS = (
    9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
)
SPACE = "[" + "".join(rf"\x{{{point:X}}}" for point in SPACE_POINTS) + "]"
# What opens a section, where a sentence ends, what a word is.
SECTION_BREAK = rf"\n(?=#{{1,3}}{SPACE}|[A-Z][A-Za-z0-9 /-]{{2,}}:)"
SENTENCE_BREAK = rf"(?<=[.!?]){SPACE}+"
WORD = r"[\p{L}\p{N}_'-]+"
CHARACTERS_PER_TOKEN = 4
TOKENS_PER_MESSAGE = 4


def trim(text: Column) -> Column:
    """Looks at the ends only, unlike a pattern, which scans the whole text."""
    return F.btrim(text, F.lit("".join(map(chr, SPACE_POINTS))))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, as the chunk size and token estimate count it."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def normalize_text(text: Column) -> Column:
    """Trim every line and drop the empty ones."""
    lines = F.transform(F.split(text, "\n", -1), trim)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def split_sections(normalized: Column) -> Column:
    """Cut in front of headings; no section for an empty text.

    Parts of a normalized text have no space at their ends.
    """
    return F.filter(F.split(normalized, SECTION_BREAK, -1), lambda part: part != "")


def pack_sentences(section: Column, limit: int = CHUNK_CHARACTERS) -> Column:
    """Pieces of a section of at most ``limit`` units, cut between sentences.

    A section within the limit stays whole, a longer single sentence too.
    """
    sentences = F.transform(
        F.split(section, SENTENCE_BREAK, -1),
        lambda s: F.struct(s.alias("text"), utf16_length(s).alias("size")),
    )
    start = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit("").alias("open"),
        F.lit(0).alias("size"),
    )

    def add(state: Column, sentence: Column) -> Column:
        empty = state["size"] == 0
        grown = state["size"] + 1 + sentence["size"]
        full = ~empty & (grown > limit)
        fresh = empty | full
        return F.struct(
            F.when(full, F.array_append(state["done"], state["open"]))
            .otherwise(state["done"])
            .alias("done"),
            F.when(fresh, sentence["text"])
            .otherwise(F.concat(state["open"], F.lit(" "), sentence["text"]))
            .alias("open"),
            F.when(fresh, sentence["size"]).otherwise(grown).alias("size"),
        )

    def finish(state: Column) -> Column:
        return F.when(
            state["size"] > 0, F.array_append(state["done"], state["open"])
        ).otherwise(state["done"])

    return F.when(utf16_length(section) <= limit, F.array(section)).otherwise(
        F.aggregate(sentences, start, add, finish)
    )


def chunk_text(body: Column, limit: int = CHUNK_CHARACTERS) -> Column:
    """All chunks of a text in order; an empty array for a blank text."""
    sections = split_sections(normalize_text(body))
    return F.flatten(F.transform(sections, lambda s: pack_sentences(s, limit)))


def estimate_tokens(text: Column) -> Column:
    """0 for blank text, else the larger of the word count and size / 4."""
    clean = trim(text)
    words = F.regexp_count(clean, F.lit(WORD))
    by_size = F.ceil(utf16_length(clean) / CHARACTERS_PER_TOKEN)
    return (
        F.when(clean == "", F.lit(0))
        .otherwise(F.greatest(F.lit(1), words, by_size))
        .cast("long")
    )
