"""Scalar functions as column expressions: text, time, vectors, levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(text: Column) -> Column:
    """Unicode white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_token(text: Column) -> Column:
    """letters and digits in lower case, null if there are none."""
    return F.nullif(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")), F.lit(""))


def edit_limit(a: Column, b: Column) -> Column:
    """how many edits tokens may differ by: 0, 1 or 2 for up to 4, 7 and more characters of the shorter."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n <= 4, 0).when(n <= 7, 1).otherwise(2)


def tokens_match(a: Column, b: Column) -> Column:
    """within the limit of edits; a bounded distance stops early."""
    limit = edit_limit(a, b)
    return F.when(limit == 0, a == b).when(limit == 1, F.levenshtein(a, b, 1) >= 0).otherwise(F.levenshtein(a, b, 2) >= 0)


def name_key(name: Column) -> Column:
    """the canonical key of a name."""
    return F.lower(clean_text(name))


def format_timestamp(ms: Column) -> Column:
    """hh:mm:ss.mmm."""
    part = lambda by, mod: F.expr("1") * F.floor(ms / by) % mod
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), part(60000, 60), part(1000, 60), ms % 1000)


def parse_time(text: Column) -> Column:
    """seconds, M:SS or H:MM:SS, with fractions, in ms; null if malformed."""
    parts = F.split(text, ":")
    n = F.size(parts)
    number = lambda i: F.get(parts, F.lit(i)).try_cast("decimal(20,6)")
    seconds = F.when(n == 1, number(0)).when(n == 2, number(0) * 60 + number(1)).when(n == 3, number(0) * 3600 + number(1) * 60 + number(2))
    fine = text.rlike(r"^\d+(\.\d+)?$") | text.rlike(r"^\d+:[0-5]\d(\.\d+)?$") | text.rlike(r"^\d+:[0-5]\d:[0-5]\d(\.\d+)?$")
    return F.when(fine, F.floor(seconds * 1000)).cast("bigint")


def samples_to_ms(samples: Column) -> Column:
    """at 16 kHz, truncated."""
    return F.floor(samples / 16)


def to_10ms(ms: Column) -> Column:
    """F23."""
    return F.floor((ms + 5) / 10) * 10


def dot(a: Column, b: Column) -> Column:
    """the inner product of equally long vectors in double; null if lengths differ or are 0."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), product)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """to length 1; null for a zero or non-finite vector."""
    n = norm(v)
    return F.when((n > 0) & ~F.isnan(n) & (n < float("inf")), F.transform(v, lambda x: x.cast("double") / n))


def is_unit(v: Column, dimension: int) -> Column:
    """Of the dimension, and of a squared norm within 0.001 of 1."""
    return (F.size(v) == dimension) & (F.abs(F.pow(norm(v), F.lit(2)) - 1) <= 1e-3)


def rms_dbfs(samples: Column) -> Column:
    """20 log10 of the root mean square; null for silence."""
    square = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return 20 * F.log10(F.nullif(F.sqrt(square / F.size(samples)), F.lit(0.0)))


def quantize(sample: Column) -> Column:
    """a sample as a saturated 16-bit integer."""
    return F.least(F.greatest(F.round(sample * 32768), F.lit(-32768)), F.lit(32767)).cast("int")


def powerset_mask(scores: Column) -> Column:
    """the first best of seven classes as a mask of three speakers."""
    best = F.array_position(scores, F.array_max(scores)).cast("int")
    return F.element_at(F.array(*[F.lit(x) for x in (0, 1, 2, 4, 3, 5, 6)]), best)


def echo_flag(text: Column) -> Column:
    """a boolean as it is, any other string as true, null as false."""
    return F.coalesce(text.try_cast("boolean"), text.isNotNull())


def upper_median(values: Column) -> Column:
    """Element n / 2 of the sorted values."""
    s = F.sort_array(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def floor_quantile(values: Column, q: float) -> Column:
    """Element floor(n q) of the finite values, the last at most."""
    s = F.sort_array(F.filter(values, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return F.get(s, F.least(F.floor(F.size(s) * F.lit(q)), F.size(s) - 1).cast("int"))


def rounded_quantile(values: Column, q: float) -> Column:
    """Element round((n - 1) q)."""
    s = F.sort_array(values)
    return F.get(s, F.floor((F.size(s) - 1) * F.lit(q) + 0.5).cast("int"))


def display_norm(peaks: Column) -> Column:
    """Element n * 995 / 1000 of the peaks, 0.02 at least."""
    s = F.sort_array(peaks)
    return F.greatest(F.get(s, F.least(F.floor(F.size(s) * 995 / 1000), F.size(s) - 1).cast("int")), F.lit(0.02))
