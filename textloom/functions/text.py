"""Text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space by Unicode, as a character class body that Java, RE2 and Python read alike.
SPACE = "\\x09-\\x0D\\x1C-\\x20\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Tokens, terms and sentences.
LEXICAL = r"[\p{L}\p{N}_]+"
TERM = r"[\p{L}\p{N}_]{2,}"
TOKEN = f"[^{SPACE}]+"
PIECE = f"[{SPACE}]*[^{SPACE}]+"
#: The same for the JVM, where printable ASCII is told by one comparison.
FAST_TOKEN = f"[!-~[^{SPACE}]]+"
FAST_PIECE = f"[{SPACE}]*[!-~[^{SPACE}]]+"
SENTENCE_PIECE = f"(?sd)[{SPACE}]*[^{SPACE}].*?(?:[.!?](?=[{SPACE}]|$)|$)"
SENTENCE = f"(?sd)[^{SPACE}].*?(?:[.!?](?=[{SPACE}]|$)|$)"


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lexical_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(LEXICAL), F.lit(0))


def terms(text: Column) -> Column:
    """Lexical tokens of two or more characters: the terms of sparse retrieval."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def pieces(text: Column) -> Column:
    """White-space tokens, each with the white space before it: their concatenation is the text's."""
    return F.regexp_extract_all(text, F.lit(FAST_PIECE), F.lit(0))


def tokens(text: Column) -> Column:
    """White-space tokens."""
    return F.regexp_extract_all(text, F.lit(FAST_TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+", "")


def sentence_pieces(text: Column) -> Column:
    """Sentences, each with the white space before it."""
    return F.regexp_extract_all(text, F.lit(SENTENCE_PIECE), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences end at . ! or ? before white space, or at the end of the text."""
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def squeeze(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), f"[{SPACE}]+", " "), r"^ | $", "")


def bucket(token: Column, dim: int) -> Column:
    """Native hash bucket of a token: 60 bits of its md5, modulo ``dim``."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 15), 16, 10).cast("bigint"), F.lit(dim)).cast("int")


def bag_dot(a: Column, b: Column) -> Column:
    """Dot product of the count vectors of two arrays of buckets."""
    times = lambda bag, x: F.size(F.filter(bag, lambda y: y == x)).cast("long")
    return F.aggregate(F.array_intersect(a, b), F.lit(0).cast("long"), lambda s, x: s + times(a, x) * times(b, x))


def bag_norm(a: Column) -> Column:
    return F.sqrt(bag_dot(a, a))


def bag_cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine of two bags of those norms; 0 if one is empty."""
    return F.when((norm_a == 0) | (norm_b == 0), F.lit(0.0)).otherwise(bag_dot(a, b) / (norm_a * norm_b))


def representation(title: Column, text: Column, strategy: str, lead: int) -> Column:
    """Text that stands for a document: its title, its lead, or both."""
    head = F.when(F.trim(title) != "", F.trim(title))
    body = F.when(text.substr(1, lead) != "", text.substr(1, lead))
    return {"title_plus_lead": F.concat_ws(" ", head, body), "title_only": F.coalesce(head, F.lit("")), "lead_only": F.coalesce(body, F.lit(""))}[strategy]
