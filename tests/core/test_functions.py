import datetime as dt
import os
import subprocess
import sys

import pytest
from lorekeep.functions import fulltext as S
from lorekeep.functions import text as X
from lorekeep.functions.segmenting import segment_text
from lorekeep.functions.stemming import stem
from pyspark.sql import functions as F


def value(spark, column, **given):
    row = spark.range(1)
    for k, v in given.items():
        row = row.withColumn(k, v if not isinstance(v, str) else F.lit(v))
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "want"),
    [("  My  Budget is $5. ", "my budget is $5"), ("A b!?", "a b"), ("x,;:", "x"), ("", "")],
)
def test_normalize_statement(spark, text, want):
    assert value(spark, X.normalize_statement("t"), t=text) == want


def test_clean_and_tokens(spark):
    assert value(spark, X.clean("t"), t="The  Hetzner   VPS") == "Hetzner VPS"
    assert value(spark, X.clean("t"), t="Theory") == "Theory"
    assert value(spark, X.tokens("t"), t="I pay $5.50, or 3€ a day—ok") == ["i", "pay", "$5.50", "or", "3", "a", "day", "ok"]
    assert value(spark, X.content_tokens("t"), t="I no longer use the VPS anymore") == ["use", "vps"]


@pytest.mark.parametrize(("text", "want"), [("I no longer use it", True), ("I don't use it", True), ("I dont", False), ("he quit", True), ("notable", False)])
def test_is_negated(spark, text, want):
    assert value(spark, X.is_negated("t"), t=text) is want


@pytest.mark.parametrize(
    ("a", "b", "low", "high"),
    [("Postgres", "postgres ", 1, 1), ("postgres", "postgresql", 0.6, 1), ("new york", "new york city", 0.6, 1), ("java", "javascript", 0, 0.5999), ("apple", "zebra", 0, 0.5999), ("a", "abcdefgh", 0, 0.5999), ("", "x", 0, 0)],
)
def test_name_similarity(spark, a, b, low, high):
    got = value(spark, X.name_similarity(X.normalize_name("a"), X.normalize_name("b")), a=a, b=b)
    assert low <= got <= high


def test_numbers_units_and_windows(spark):
    assert value(spark, X.parse_number("t"), t="$1,200.50") == 1200.5
    assert value(spark, X.parse_number("t"), t="about") is None
    assert value(spark, X.normalize_unit("t"), t=" Dollars ") == "$"
    day = lambda d: F.lit(dt.date(2024, 1, d)).cast("timestamp")
    no = F.lit(None).cast("timestamp")
    assert value(spark, X.windows_disjoint(day(1), day(2), day(2), no))
    assert not value(spark, X.windows_disjoint(day(1), day(3), day(2), no))
    assert not value(spark, X.windows_disjoint(no, day(1), day(2), no))
    assert value(spark, X.windows_disjoint(day(5), no, day(1), day(4)))


def test_markup_bytes_and_times(spark):
    assert value(spark, X.strip_html("t"), t="<p>a &amp;lt; b</p><br>c > d <unclosed") == "a < b c d"
    assert value(spark, X.truncate_bytes("t", 5), t="abcdef") == "abcde…"
    assert value(spark, X.truncate_bytes("t", 5), t="abcd€") == "abcd…"
    assert value(spark, X.truncate_bytes("t", 7), t="abcd€") == "abcd€"
    assert value(spark, X.truncate_bytes("t", 6), t="abc😀x") == "abc…"
    assert value(spark, X.from_epoch_seconds(F.lit(1.5))).microsecond == 500000
    assert value(spark, X.rfc3339(F.lit("2024-01-02T03:04:05+02:00"))) == dt.datetime(2024, 1, 2, 1, 4, 5)
    assert value(spark, X.rfc3339(F.lit("1700000000"))) is None
    assert value(spark, X.heading("t"), t="  ### A title ") == "A title"
    assert value(spark, X.heading("t"), t="####### no") is None and value(spark, X.heading("t"), t="#no") is None
    assert value(spark, X.unwrap_hard_lines("t"), t="a\nb\n\nc\r\nd") == "a b\n\nc d"
    assert [value(spark, X.normalize_role("t"), t=r) for r in ("human", "bot", "tool", "odd")] == ["user", "assistant", "tool", "other"]


def reference_spans(text):
    """Sentence spans in bytes, by hand."""
    data, out, start = text.encode(), [], 0
    for i, b in enumerate(data):
        ends = b in b".!?" and (i + 1 == len(data) or data[i + 1 : i + 2] in (b" ", b"\t", b"\n", b"\r", b"\x0c"))
        if ends or b == 10:
            if (i + ends) > start:
                out.append((start, i + ends))
            start = i + 1
    return out + ([(start, len(data))] if start < len(data) else [])


@pytest.mark.parametrize("text", ["One. Two!\nThree? 3.5 is ok.\n\nEnd", "é. ü", "...", "a.b. c", "\n\n", "x", "", "A?!  B.\r\nC", "wait.\n.\nno"])
def test_sentence_pieces(spark, text):
    pieces = value(spark, X.sentence_pieces("t"), t=text)
    assert "".join(pieces) == text
    at, got = 0, []
    for p in pieces:
        if p != "\n":
            got.append((at, at + len(p.encode())))
        at += len(p.encode())
    assert got == reference_spans(text)


def test_segments():
    assert segment_text("# One\nalpha\n\n## Two\nbeta") == [("One", "alpha"), ("Two", "beta")]
    assert segment_text("  \n# Empty\n") == []
    long = segment_text("x" * 5000)
    assert len(long) == 3 and all(len(c.encode()) <= 2000 for _, c in long)
    assert "".join(c for _, c in segment_text("é" * 3000)) == "é" * 3000
    packed = segment_text("\n\n".join(["p" * 900] * 5))
    assert [len(c) for _, c in packed] == [1802, 1802, 900]


def test_stems(spark):
    # Stems that the published rules give.
    want = {
        "running": "run", "runs": "run", "classes": "class", "ponies": "poni", "ties": "tie", "cries": "cri", "gas": "gas", "gaps": "gap", "agreed": "agre", "feed": "feed", "plastered": "plaster", "bled": "bled",
        "hopping": "hop", "hoping": "hope", "sized": "size", "happy": "happi", "say": "say", "by": "by", "relational": "relat", "conditional": "condit", "rationally": "ration", "digitizer": "digit", "operator": "oper",
        "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formality": "formal", "sensitivity": "sensit", "triplicate": "triplic", "electricity": "electr", "goodness": "good",
        "revival": "reviv", "allowance": "allow", "inference": "infer", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "communism": "communism", "effective": "effect", "probate": "probat", "rate": "rate",
        "controlling": "control", "skies": "sky", "dying": "die", "news": "news", "generously": "generous", "knightly": "knight", "yes": "yes", "youth": "youth", "enjoying": "enjoy", "proceeding": "proceed",
    }
    assert {w: stem(w) for w in want} == want
    assert value(spark, S.stems(F.array(*[F.lit(w) for w in want]))) == list(want.values())


@pytest.mark.parametrize(
    ("query", "hits"),
    [
        ("apples pears or bananas", [0, 1, 2, 3, 4]), ("apples bananas", [2]), ("apples -pears", [2, 5]), ('"pears apples" or nothing', [3]), ('"apples pears"', [1, 3]), ('"apples and pears"', [4]),
        ("or bananas or", [0, 2]), ("the of", []), ('"to the pears"', [1, 3, 4]), ("-apples", [0]), ('apples -"apples pears"', [2, 4, 5]),
    ],
)
def test_search_grammar(spark, query, hits):
    rows = spark.createDataFrame(list(enumerate(["only bananas here", "apples, pears", "apple banana", "pears apples pears", "apples and pears", "apples alone"])), "i int, t string")
    assert sorted(r.i for r in rows.withColumn("d", S.analysed(F.col("t"))).where(S.matches(F.col("d"), query)).collect()) == hits



@pytest.mark.parametrize(
    ("query", "hits"),
    [("postgres", {1, 2}), ("postgres index", {1}), ("postgres or duck", {1, 2, 3}), ('"fast index"', {1}), ('"index fast"', set()), ("postgres -index", {2}), ("the of", set()), ("indexes", {1})],
)
def test_web_search(spark, query, hits):
    rows = spark.createDataFrame([(1, "Postgres has a fast index"), (2, "We use Postgres daily"), (3, "The duck is slow")], "id int, t string")
    assert {r.id for r in rows.withColumn("d", S.analysed(F.col("t"))).where(S.matches(F.col("d"), query)).collect()} == hits


def test_workers_find_the_package_from_any_folder(tmp_path):
    """A session that was started elsewhere, with no PYTHONPATH, still runs what is a Python program over words."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from lorekeep.functions import fulltext
from lorekeep.operators import extract
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
docs = spark.createDataFrame([("# Top\\nrunning dogs",)], "text string")
print(docs.select(fulltext.analysed(F.col("text")).alias("a")).first().a, extract.segments(docs).first().content)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "['top', 'run', 'dog'] running dogs" in out.stdout, out.stderr[-2000:]
