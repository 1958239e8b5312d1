"""Personal data by patterns, and by contexts that are bootstrapped from what the patterns find.

Base detectors are regular expressions with checks (emails, IP addresses, cards, phone numbers), as leftmost
non-overlapping matches per kind. They, and secrets of a shape that nothing else has (32 and more hexadecimal digits, spans
of kind ``secret``), seed the contextual method:

1. Every identifier-like token (a run of non-blanks with a digit or @) and every seed is an instance, and the two words
   before it, with what stands between, are its lexical pattern. Tokens that overlap a base match are not instances of
   their own.
2. In each of ROUNDS rounds the patterns that stand before at least SUPPORT distinct known values of a kind are candidates
   of that kind: seeds are known, and so are tokens whose confidence for the kind has come to CONFIDENCE, so what one
   pattern finds induces further patterns. Patterns and instances form a bipartite graph. A pattern's confidence is the
   mean confidence of its distinct instances, and an unknown instance's is that at least one of its patterns is right
   (1 - product of 1 - confidence); seeds keep 1, and instances start at 0.
3. Tokens after a pattern of at least CONFIDENCE, whose own confidence is as high, are new spans of kind ``context``.

Offsets are code points, ends exclusive. DataFrame functions only. Only texts with a digit or @ are worked on further;
their matches become rows (one for each match), so a text with many matches is never held as nested arrays that grow
quadratically. The regular expressions are written so that they never recurse nor rescan: each takes linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, free_name, quoted, written

KINDS = ("email", "ip", "card", "phone")
SECRET, CONTEXT = "secret", "context"
#: A token that is a secret by its shape, whatever marks stand around it.
SECRET_REGEX = r"^[^\p{L}\p{N}]*+(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,}+[^\p{L}\p{N}]*$"
SUPPORT, CONFIDENCE, ROUNDS = 3, 0.6, 3
#: In words of more code points than this, what stands before a base match counts from the last match of its kind.
LONG_WORD = 4096

_LOCAL, _HOST = r"A-Za-z0-9._%+-", r"A-Za-z0-9-"
#: Linear-time forms of the detectors: each starts only where a leftmost match can start, and loops over one class.
REGEX = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_HOST}]++(?=\.[{_HOST}])[{_HOST}.]*?(?![{_HOST}]|\.[{_HOST}])",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]*?(?![0-9]|[\x20-][0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "token": r"(?<![^\s])[^\s0-9@]*+[0-9@][^\s]*+",
}
#: The last two words and the blanks after them; linear, as it starts only where a word does.
TWO_WORDS = r"(?<!\S)(\S++\s++\S++\s*+)\z"


def luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    small = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    return (
        F.when(kind == "ip", small)
        .when(kind == "card", F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", F.length(digits).between(10, 15))
        .otherwise(True)
    )


def _matches(kind: str) -> Column:
    """array<struct<kind, at, gap, match, left>>: each match, the count of characters since the one before, and their last
    two words (all of them if fewer)."""
    quick = F.col("text").contains("@") if kind == "email" else F.col("text").contains("+") if kind == "phone" else F.lit(True)
    found = F.when(quick, F.regexp_extract_all("text", F.lit(REGEX[kind]), F.lit(0))).otherwise(F.array().cast("array<string>"))
    between = F.when(quick, F.split("text", REGEX[kind])).otherwise(F.array().cast("array<string>"))
    two = lambda gap: F.regexp_extract(gap, TWO_WORDS, 1)
    left = lambda gap: F.when(two(gap) != "", F.concat(F.lit(" "), two(gap))).otherwise(gap)
    pairs = F.arrays_zip(found.alias("match"), between.alias("gap"))
    rows = F.transform(pairs, lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), F.length(p["gap"]).alias("gap"), p["match"].alias("match"), left(p["gap"]).alias("left")))
    return F.filter(rows, lambda r: r["match"].isNotNull())


def pattern_of(left: Column) -> Column:
    """The last two words before a match, lower-cased, with the blanks between made one space; '' without two words."""
    return F.regexp_replace(F.lower(F.regexp_extract(left, TWO_WORDS, 1)), r"\s+", " ")


def candidates(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").rlike("[0-9@]"))


def occurrences(texts: DataFrame) -> DataFrame:
    """(doc_id, th, kind, start, end, value, pattern): valid base matches, secrets, and tokens that overlap no base match.

    texts has distinct (doc_id, text); th is the text's hash.
    """
    dealt = texts.select("doc_id", F.xxhash64("text").alias("th"), "text").dropDuplicates(["doc_id", "th"])
    found = dealt.select("doc_id", "th", F.explode(F.concat(*[_matches(k) for k in REGEX])).alias("m")).select("doc_id", "th", "m.*")
    run = Window.partitionBy("doc_id", "th", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(run)).withColumn("start", F.col("end") - F.length("match"))
    base = F.col("kind") != "token"
    # Tokens are whole words, so two tokens and the gaps after them hold the two words before the next one. A base match
    # starts within a token: what stands before it is what stands before the token, and the token's own beginning.
    before = Window.partitionBy("doc_id", "th", "kind").orderBy("at")
    ago = lambda c, n: F.coalesce(F.lag(c, n).over(before), F.lit(""))
    found = found.withColumn("_before", F.when(~base, F.concat(ago("match", 2), ago("left", 1), ago("match", 1), F.col("left"))))
    head = F.when(F.length("match") <= LONG_WORD, F.col("match"))
    word = F.last(F.when(~base, F.struct("start", F.col("_before").alias("before"), head.alias("head"))), ignorenulls=True)
    found = found.withColumn("_word", word.over(Window.partitionBy("doc_id", "th").orderBy("start", base).rowsBetween(Window.unboundedPreceding, 0)))
    inner = F.coalesce(F.substring(F.col("_word.head"), F.lit(1), (F.col("start") - F.col("_word.start")).cast("int")), F.right("left", F.least(F.lit(LONG_WORD), F.col("start") - F.col("_word.start")).cast("int")))
    found = found.withColumn("pattern", pattern_of(F.when(base, F.concat(F.col("_word.before"), inner)).otherwise(F.col("_before")))).drop("left", "_before", "_word")
    found = found.where(passes(F.col("kind"), F.col("match")))
    ahead = Window.partitionBy("doc_id", "th").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy("doc_id", "th").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("_reached", F.max(F.when(base, F.col("end"))).over(ahead)).withColumn("_next", F.min(F.when(base, F.col("start"))).over(behind))
    free = F.coalesce(F.col("_reached") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("_next") >= F.col("end"), F.lit(True))
    secret = ~base & F.col("match").rlike(SECRET_REGEX)
    found = found.where(base | free | secret)
    lead = F.when(base, 0).otherwise(F.length(F.regexp_extract("match", r"^([^\p{L}\p{N}@+]*)", 1)))
    trail = F.when(base, 0).otherwise(F.length(F.regexp_extract("match", r"([^\p{L}\p{N}]*)$", 1)))
    value = F.when(base, F.col("match")).otherwise(F.regexp_extract("match", r"^[^\p{L}\p{N}@+]*(.*?)[^\p{L}\p{N}]*$", 1))
    kind = F.when(secret, F.lit(SECRET)).otherwise(F.col("kind"))
    out = found.select("doc_id", "th", kind.alias("kind"), (F.col("start") + lead).alias("start"), (F.col("end") - trail).alias("end"), value.alias("value"), "pattern")
    return out.where(F.col("end") > F.col("start"))


def scored_patterns(found: DataFrame, support: int = SUPPORT, rounds: int = ROUNDS, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """((kind, pattern, confidence), (kind, value, confidence)) of the pattern-instance graph after the last round.

    All counts are over distinct values, combined before they are shuffled, so a very frequent line weighs as one.
    """
    met = written(found.where("pattern <> ''").select("kind", "pattern", "value").distinct(), "pii-instances")
    seeds, tokens = met.where("kind <> 'token'"), met.where("kind = 'token'").select("pattern", "value")
    known = seeds.select("kind", "value").distinct().withColumn("confidence", F.lit(1.0))
    patterns, old = None, []
    for _ in range(rounds):
        sure = known.where(F.col("confidence") >= confidence).select("kind", "value")
        held = seeds.unionByName(tokens.join(sure, "value").select("kind", "pattern", "value")).distinct()
        strong = written(held.groupBy("kind", "pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("kind", "pattern"), "pii-patterns")
        edges = seeds.join(strong, ["kind", "pattern"], "left_semi").withColumn("seed", F.lit(1.0))
        edges = edges.unionByName(tokens.join(strong, "pattern").select("kind", "pattern", "value", F.lit(0.0).alias("seed")))
        edges = written(edges.groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed")), "pii-graph")
        believed = F.greatest("seed", F.coalesce("confidence", F.lit(0.0)))
        patterns = written(edges.join(known, ["kind", "value"], "left").groupBy("kind", "pattern").agg(F.avg(believed).alias("confidence")), "pii-pattern-scores")
        miss = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-12))))
        known = written(edges.join(patterns, ["kind", "pattern"]).groupBy("kind", "value").agg(F.greatest(F.max("seed"), 1 - F.exp(miss)).alias("confidence")), "pii-value-scores")
        drop_written(*old, strong, edges)
        old = [patterns, known]
    drop_written(met)
    return patterns, known


def spans(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, th, kind, start, end): all spans of the candidate texts, once for each distinct (doc_id, text)."""
    found = written(occurrences(candidates(docs)), "pii-occurrences")
    patterns, values = scored_patterns(found, support, rounds, confidence)
    tokens = found.where("kind = 'token'").drop("kind")
    new = tokens.join(patterns.where(F.col("confidence") >= confidence).select("kind", "pattern"), "pattern")
    new = new.join(values.where(F.col("confidence") >= confidence).select("kind", "value"), ["kind", "value"], "left_semi")
    new = new.select("doc_id", "th", F.lit(CONTEXT).alias("kind"), "start", "end").distinct()
    return found.where("kind <> 'token'").select("doc_id", "th", "kind", "start", "end").unionByName(new)


def by_document(all_spans: DataFrame) -> DataFrame:
    """(doc_id, th, spans): spans array<struct<start, rank, kind, end>> in order, for candidate rows that have any."""
    rank = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate((*KINDS, SECRET, CONTEXT))])
    one = F.struct("start", rank.alias("rank"), "kind", "end")
    return all_spans.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(one)).alias("spans"))


def report(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """doc_id and spans of every row of docs (doc_id, text); rows without personal data have no spans.

    Null and empty texts have none; repeated rows have the same; null doc_ids are kept; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    held = by_document(spans(docs, support, confidence, rounds))
    rows = candidates(docs).select("doc_id", F.xxhash64("text").alias("th"))
    joined = rows.alias("r").join(held.alias("h"), F.col("r.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("r.th") == F.col("h.th")), "left")
    nothing = F.array().cast(held.schema["spans"].dataType)
    rest = docs.where(~F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))).select("doc_id", nothing.alias("spans"))
    return joined.select("r.doc_id", F.coalesce("h.spans", nothing).alias("spans")).unionByName(rest)


def redacted(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """docs with each span of text replaced by ``<kind>`` (overlapping spans by the first one's), all columns kept.

    n_chars, where there is such a column, is set to the new length. Rows without spans pass unchanged.
    """
    held = by_document(spans(docs.select("doc_id", "text"), support, confidence, rounds))
    th, new = free_name("_th", docs), free_name("_new", docs)
    rows = candidates(docs).withColumn(th, F.xxhash64("text")).alias("r")
    joined = rows.join(held.alias("h"), F.col("r.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col(f"r.{th}") == F.col("h.th")), "left")
    step = F.aggregate(
        F.coalesce("h.spans", F.array().cast(held.schema["spans"].dataType)),
        F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
            F.struct(
                F.concat(a["out"], F.substring(F.col("r.text"), (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int")), F.when(s["start"] >= a["at"], F.concat(F.lit("<"), s["kind"], F.lit(">"))).otherwise("")).alias("out"),
                s["end"].cast("bigint").alias("at"),
            )
        ),
        lambda a: F.concat(a["out"], F.substring(F.col("r.text"), (a["at"] + 1).cast("int"), F.length(F.col("r.text")))),
    )
    changed = joined.withColumn(new, F.when(F.col("h.spans").isNotNull(), step).otherwise(F.col("r.text")))

    def column(c: str):
        if c == "text":
            return F.col(new).alias(c)
        if c == "n_chars":
            return F.when(F.col(new) != F.col("r.text"), F.length(new).cast("bigint")).otherwise(F.col(f"r.{c}")).alias(c)
        return F.col(f"r.{quoted(c)}").alias(c)

    rest = docs.where(~F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False)))
    return changed.select(*[column(c) for c in docs.columns]).unionByName(rest)
