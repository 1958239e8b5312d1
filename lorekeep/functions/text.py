"""Column expressions over text: whitespace, tokens, names, numbers, markup and times.

Whitespace is Unicode's unless said otherwise; lengths and offsets named ``bytes`` count UTF-8 bytes. Everything here is
a built-in expression, so it stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words the scoring rules leave out, words that negate, and opposite predicates.
STOPWORDS = "a an the i we my our is are was were be been am for of to in on at and or it this that per with".split()
NEGATORS = "not never no stopped quit dropped".split()
ANTONYMS = (
    ("enabled", "disabled"), ("enable", "disable"), ("on", "off"), ("always", "never"), ("prefer", "avoid"),
    ("love", "hate"), ("start", "stop"), ("increase", "decrease"), ("public", "private"), ("allow", "forbid"),
)
# Roles kept as they are, and other names for two of them.
ROLES = ("system", "user", "assistant", "tool", "function", "other")
ROLE_NAMES = {"human": "user", "ai": "assistant", "model": "assistant", "bot": "assistant"}
# Markup entities, in the order they are decoded.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+\z", "")


def tidy(c: Column | str) -> Column:
    """FN-03: runs of whitespace become one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def non_blank(c: Column | str) -> Column:
    """The trimmed text, null where nothing is left."""
    return F.nullif(trimmed(c), F.lit(""))


def sha256_hex(c: Column | str) -> Column:
    """FN-01."""
    return F.sha2(col(c), 256)


def normalize_statement(c: Column | str) -> Column:
    """FN-02: lower-cased, tidied, without sentence marks at the end."""
    return F.regexp_replace(tidy(F.lower(col(c))), r"[.,;:!?]+\z", "")


def clean(c: Column | str) -> Column:
    """FN-04: tidied, without one leading article."""
    return F.regexp_replace(tidy(c), r"(?i)^(a|an|the) ", "")


def tokens(c: Column | str) -> Column:
    """FN-06: lower-cased runs of letters, numbers, $ and dots, in order."""
    return F.filter(F.split(F.lower(col(c)), r"[^\p{IsAlphabetic}\p{N}$.]+"), lambda t: t != "")


def content_tokens(c: Column | str) -> Column:
    """FN-07: tokens without stopwords and negation."""
    out = F.array(*[F.lit(w) for w in (*STOPWORDS, *NEGATORS, "longer", "anymore")])
    return F.filter(tokens(c), lambda t: ~F.array_contains(out, t))


def jaccard(a: Column, b: Column) -> Column:
    """FN-08: shared share of two arrays taken as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def is_negated(c: Column | str) -> Column:
    """FN-09."""
    low = F.lower(col(c))
    return low.contains("no longer") | low.contains("anymore") | low.contains("n't ") | F.arrays_overlap(tokens(c), F.array(*[F.lit(w) for w in NEGATORS]))


def normalize_unit(c: Column | str) -> Column:
    """FN-10."""
    unit = tidy(F.lower(col(c)))
    return F.when(unit.isin("dollars", "usd", "bucks"), F.lit("$")).otherwise(unit)


def parse_number(c: Column | str) -> Column:
    """FN-11: null where it is no number."""
    return F.regexp_replace(F.regexp_replace(col(c), "^[$€£]+", ""), ",", "").try_cast("double")


def windows_disjoint(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """FN-12: one validity window ends before the other begins, as far as the bounds are known."""
    first = a_from.isNotNull() & a_to.isNotNull() & b_from.isNotNull() & (a_to <= b_from)
    second = a_from.isNotNull() & b_from.isNotNull() & b_to.isNotNull() & (b_to <= a_from)
    return F.coalesce(first, F.lit(False)) | F.coalesce(second, F.lit(False))


def normalize_name(c: Column | str) -> Column:
    """FN-13."""
    return tidy(F.lower(col(c)))


def trigrams(c: Column | str) -> Column:
    """FN-14: distinct character trigrams, with two blanks before and one after."""
    padded = F.concat(F.lit("  "), col(c), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def prefix_ratio(a: Column, b: Column) -> Column:
    """FN-16: length ratio where the shorter (in bytes) begins the longer, else 0."""
    shorter = F.octet_length(a) <= F.octet_length(b)
    begins = F.when(shorter, b.startswith(a)).otherwise(a.startswith(b))
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), 0.0).when(begins, ratio).otherwise(0.0)


def name_similarity(a: Column, b: Column, parts: tuple[Column, Column, Column, Column] | None = None) -> Column:
    """FN-17 of two names that normalize_name() has been applied to: the strongest of tokens, trigrams and prefix.

    parts: tokens of a and b and trigrams of a and b, where they are known already.
    """
    ta, tb, ga, gb = parts or (tokens(a), tokens(b), trigrams(a), trigrams(b))
    best = F.greatest(jaccard(ta, tb), jaccard(ga, gb), prefix_ratio(a, b))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(best)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """FN-19: null for a null, zero or differently long vector."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (length > 0), dot(a, b) / length)


def strip_html(c: Column | str) -> Column:
    """FN-20: tags dropped (each end of a tag is a blank), six entities decoded in order, tidied."""
    out = F.regexp_replace(F.regexp_replace(col(c), r"<[^>]*(>|\z)", "$1"), ">", " ")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return tidy(out)


def truncate_bytes(c: Column | str, most: int) -> Column:
    """FN-21: at most so many UTF-8 bytes, cut between characters, with an ellipsis where cut."""
    raw = F.encode(col(c), "UTF-8")
    # A cut is between characters where the byte after it does not continue one (10xxxxxx).
    cut = F.lit(most - 3)
    for back in (2, 1, 0):
        after = F.conv(F.hex(F.substring(raw, most - back + 1, 1)), 16, 10).cast("int")
        cut = F.when((after < 128) | (after >= 192), F.lit(most - back)).otherwise(cut)
    kept = F.decode(F.substring(raw, F.lit(1), cut), "UTF-8")
    return F.when(F.octet_length(col(c)) <= most, col(c)).otherwise(F.concat(kept, F.lit("…")))


def normalize_role(c: Column | str) -> Column:
    """FN-22: null and unknown roles are 'other'."""
    out = F.when(col(c).isin(*ROLES[:-1]), col(c))
    for name, role in ROLE_NAMES.items():
        out = out.when(col(c) == name, F.lit(role))
    return out.otherwise(F.lit("other"))


def from_epoch_seconds(c: Column) -> Column:
    """FN-23."""
    return F.timestamp_micros(F.floor(c.cast("double") * 1_000_000).cast("bigint"))


def from_epoch_millis(c: Column) -> Column:
    return F.timestamp_micros(F.floor(c.cast("double") * 1_000).cast("bigint"))


def rfc3339(c: Column) -> Column:
    """FN-24: null unless it is a full date, time and offset."""
    full = c.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    return F.when(full, F.try_to_timestamp(F.upper(c)))


def heading(c: Column | str) -> Column:
    """FN-25: the text of a markdown heading, null for other lines."""
    return F.when(col(c).rlike(r"(?U)^\s*#{1,6} "), trimmed(F.regexp_extract(col(c), r"(?Us)^\s*#{1,6} (.*)", 1)))


def unwrap_hard_lines(c: Column | str) -> Column:
    """FN-27: lines of a paragraph joined by spaces; paragraphs stay apart."""
    paragraphs = F.transform(F.split(col(c), r"\n\n"), lambda p: F.array_join(F.filter(F.transform(F.split(p, r"\r?\n"), trimmed), lambda x: x != ""), " "))
    return F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n\n")


def sentence_pieces(c: Column | str) -> Column:
    """FN-05 as pieces that join to the text: each ends after a . ! ? before ASCII whitespace or the end, or is the rest
    of a line, or a line feed alone. Offsets of a piece are sums of the pieces before it."""
    return F.regexp_extract_all(col(c), F.lit(r"[^\n]*?[.!?](?=[ \t\n\f\r]|\z)|[^\n]+|\n"), F.lit(0))


def bytes_before(pieces: Column, position: Column) -> Column:
    """UTF-8 bytes of the pieces before the one at a position from 0."""
    return F.octet_length(F.array_join(F.slice(pieces, F.lit(1), position), ""))


def uuid_of(*parts: Column | str) -> Column:
    """A deterministic id in uuid form from natural key parts; a null part differs from an empty one."""
    key = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), p.cast("string") if isinstance(p, Column) else F.lit(p)), F.lit("~")) for p in parts])
    h = F.sha2(key, 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
