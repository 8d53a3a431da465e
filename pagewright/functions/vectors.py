"""Vector expressions and the deterministic stand-in embedding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Buckets of the hashed bag of words.
DIM = 64


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product, accumulated in double precision."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def unit(vector: Column) -> Column:
    """The vector at length 1; a zero vector is left as it is.

    The length is bound once by a transform over a one-element array, not worked out for each element.
    """
    scaled = lambda n: F.transform(doubles(vector), lambda x: F.when(n > 0, x / n).otherwise(x))
    return F.transform(F.array(norm(vector)), scaled)[0]


def cosine(a: Column, b: Column, lengths: Column | None = None) -> Column:
    """Cosine similarity; 0 with a zero vector.  ``lengths``: the product of both norms, where it is known."""
    lengths = norm(a) * norm(b) if lengths is None else lengths
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(0.0)


def hashed_words(text: Column, dim: int = DIM) -> Column:
    """Counts of lower-cased words by bucket: a deterministic stand-in for a neural embedding.

    A bucket's count is the distance between the places of two marks, one a bucket, sorted
    among the words' buckets; one pass finds all marks.  Words are odd numbers there, marks even ones.
    """
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0)
    # the last digits of the first eight say the number modulo a power of 16, and so modulo what divides it
    digits = next((n for n in range(1, 8) if 16**n % dim == 0), 8)
    bucket = lambda w: F.pmod(F.conv(F.substring(F.md5(w), 9 - digits, digits), 16, 10).cast("long"), F.lit(dim))
    marks = F.sequence(F.lit(0).cast("long"), F.lit(2 * dim).cast("long"), F.lit(2).cast("long"))
    marked = F.array_sort(F.concat(F.transform(tokens, lambda w: bucket(w) * 2 + 1), marks))
    places = F.filter(F.transform(marked, lambda x, i: F.when(x % 2 == 0, i)), lambda i: i.isNotNull())
    counts = lambda held: F.zip_with(F.slice(held, 2, dim), F.slice(held, 1, dim), lambda high, low: (high - low - 1).cast("double"))
    return F.when(text.isNotNull(), F.transform(F.array(places), counts)[0])
