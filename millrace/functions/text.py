"""Text functions: tokens, slugs, normal forms, sentences, spans, fingerprints."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions.batches import by_pieces

#: The default tokenizer: runs of letters and digits, lower-cased.
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def truncated(text: Column, most: int) -> Column:
    """The text up to its token number `most`, by the default tokenizer."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), rf"^(?s)(?:[^\p{{L}}\p{{N}}]*[\p{{L}}\p{{N}}]+){{0,{most}}}", 0)


def scanned(chars: Column, pages: Column, least: int = 100) -> Column:
    """Whether a document has so few letters a page that it must be pictures of text; without pages it isn't."""
    return F.coalesce((pages > 0) & (chars < pages * least), F.lit(False))


def slug(name: Column, fallback: str = "kb", most: int = 200) -> Column:
    made = F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)
    return F.when(F.coalesce(made, F.lit("")) == "", F.lit(fallback)).otherwise(made)


@by_pieces(StringType())
def nfkc(texts: list) -> list:
    return [None if t is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t)).strip() for t in texts]


def embed_key(model: str, text: Column) -> Column:
    """The cache key of a text's embedding under a model."""
    return F.sha2(F.concat(F.lit(model), F.lit("\0"), nfkc(text)), 256)


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *parts), 256)


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?。！？；])\s*"), lambda s: F.trim(s) != "")


def highlights(text: Column, terms: list[str]) -> Column:
    """Spans (start, end in code points) of the first place of each term, in the terms' order; terms that aren't there have none."""
    low = F.lower(text)
    spans = [F.struct(F.lit(t).alias("term"), (F.instr(low, t.lower()) - 1).cast("int").alias("start"), (F.instr(low, t.lower()) - 1 + len(t)).cast("int").alias("end")) for t in terms]
    return F.filter(F.array(*spans), lambda s: s["start"] >= 0)


def overlap(text: Column, terms: list[str]) -> Column:
    """The share of terms that stand somewhere in the text."""
    low = F.lower(text)
    return sum([F.contains(low, F.lit(t.lower())).cast("int") for t in terms], F.lit(0)) / F.lit(float(max(1, len(terms))))


def has_all(words: Column, terms: list[str]) -> Column:
    out = F.lit(True)
    for t in terms:
        out = out & F.array_contains(words, t.lower())
    return out
