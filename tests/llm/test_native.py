import hashlib
import random

import duckdb
import pytest
from helpers import awkward, docs
from lorekeep.llm import chat_trees, queries, scaled_sketch
from pyspark.sql import functions as F

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def brute_sketches(spark, texts, words=5):
    """Sketch of each text from Spark's hash of one value at a time."""
    out = {}
    for t in dict.fromkeys(texts):
        ws = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
        runs = [ws[i : i + words] for i in range(len(ws) - words + 1)] or ([ws] if ws else [])
        out[t] = runs
    flat = sorted({w for runs in out.values() for r in runs for w in r})
    hashed = {r.w: r.h for r in spark.createDataFrame([(w,) for w in flat], "w string").select("w", F.xxhash64("w").alias("h")).collect()} if flat else {}
    rows = {(t, i): [hashed[w] for w in r] for t, runs in out.items() for i, r in enumerate(runs)}
    whole = spark.createDataFrame([(t, i, v) for (t, i), v in rows.items()], "t string, i int, v array<bigint>")
    # a short text's hash is folded from its words alone, a full shingle's is one call over its words: both chain XXH64
    h = F.aggregate("v", F.lit(42).cast("bigint"), lambda a, x: F.xxhash64(a, x))
    full = F.xxhash64(*[F.col("v")[k] for k in range(words)])
    long = {t for t, runs in out.items() if runs and len(__import__("re").split(r"[\x20\x09-\x0D]+", t.strip(" \t\n\r\x0b\x0c"))) > words}
    found = {}
    for r in whole.select("t", F.when(F.size("v") == words, full).otherwise(h).alias("h"), h.alias("g")).collect():
        found.setdefault(r.t, set()).add(r.h if r.t in long else r.g)
    cut = scaled_sketch.threshold(scaled_sketch.FRACTION)
    return {t: (sorted(x for x in found.get(t, ()) if x < cut), min(found.get(t, ()), default=None)) for t in out}


@pytest.mark.parametrize("per_shard", [1, 7, 4096])
def test_edited_report(spark, per_shard, monkeypatch):
    monkeypatch.setattr(scaled_sketch.with_next, "__defaults__", (per_shard,))
    r = random.Random(4)
    texts = [*awkward(), *(" ".join(f"w{r.randint(0, 300)}" for _ in range(r.randint(1, 300))) for _ in range(20))]
    rows = [(3 * i % 101, t) for i, t in enumerate(texts)] + [(None, "null id " * 9), (0, texts[0])]
    df = scaled_sketch.edited_report(docs(spark, rows).withColumnRenamed("lang", "text_w"))
    assert no_python(df)
    got = sorted((tuple(x) for x in df.collect()), key=str)
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = []
    after = [*ordered[1:], ordered[0]]
    edits = []
    for (i, t), (_, n) in zip(ordered, after, strict=True):
        q = len(t) // 4
        edits.append(t[: len(t) - q] + n[:q])
    sketches = brute_sketches(spark, [t for _, t in ordered] + edits)
    digits = lambda x: f"{x & (2**64 - 1):016x}"
    text = lambda s: "".join(map(digits, s[0])) or ("" if s[1] is None else "~" + digits(s[1]))
    like = lambda a, b: len(set(a[0]) & set(b[0])) / len(set(a[0]) | set(b[0])) if a[0] or b[0] else float(a[1] == b[1])
    for (i, t), (_, n), e in zip(ordered, after, edits, strict=True):
        a, b, c = sketches[t], sketches[e], sketches[n]
        want.append((i, len(t), sha(e), text(a), text(b), like(a, b), like(a, c)))
    assert got == sorted(want, key=str)


def test_sketch_of_no_rows_and_merging(spark):
    assert scaled_sketch.edited_report(docs(spark, [])).count() == 0
    one = scaled_sketch.edited_report(docs(spark, [(5, "a b c d e f g h")])).first()
    assert one.edited_sha256 == sha("a b c d e f a b"[:12] + "a b") or one.near_next == 1.0
    r = random.Random(1)
    a, b = (" ".join(f"w{r.randint(0, 10**6)}" for _ in range(900)) for _ in range(2))
    df = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, c string")
    for c in "abc":
        df = scaled_sketch.with_sketch(df, c, "s" + c)
    row = df.select(scaled_sketch.containment("sa", "sc").alias("x"), F.size(F.array_except("sc", scaled_sketch.merged("sa", "sb"))).alias("y")).first()
    assert row.x == 1.0 and row.y <= 4


def test_shards_are_ranges(spark):
    from lorekeep.llm.common import range_shards

    r = random.Random(5)
    keys = [*range(0, 4000, 2), *[7] * 300, *(r.randrange(10**12) for _ in range(700)), -5, 10**15, None, None]
    df = spark.createDataFrame([(k,) for k in keys], "doc_id long").withColumn("_fine", F.lit("x"))
    rows, most, last = range_shards(df.drop("_fine"), "doc_id", 40)
    got = sorted(((x.doc_id is not None, x.doc_id or 0, x._shard, x._starts, x._before) for x in rows.collect()))
    shards = [x[2] for x in got]
    assert shards == sorted(shards) and 50 < len(set(shards)) <= most and shards[-1] == last and len(got) == len(keys)
    sizes = {s: len({x[1] for x in got if x[2] == s}) for s in set(shards)}
    assert max(sizes.values()) < 200
    for a, b in zip(got, got[1:]):
        assert b[3] == (b[2] != a[2]) or b[1] == a[1]
        if b[2] != a[2] and a[0]:
            assert b[4] == a[2]


def test_conversations_match_sql(spark, tmp_path):
    r = random.Random(3)
    odd = ["\\", "#", "###", "</turn>", "</turn", "\n", "### ", ": ", "é😀", "\\h", "\\\\e", ">", "x", ""]
    rows = [(c, t, r.choice(["user", "assistant", "system", "a: b\\### c", ""]), r.choice([None, "".join(r.choice(odd) for _ in range(r.randint(0, 12)))])) for c in range(40) for t in range(r.randint(1, 9))]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "none either")]
    rows += [(99, t, "user", f"t{t}") for t in range(70)] + [(98, 1, "user", "same"), (98, 1, "user", "same"), (98, None, "assistant", "null turn")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit(1))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.op2_reply_trees(spark, str(tmp_path))
    assert no_python(out)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * EXCLUDE depth FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL["op2_reply_trees"].replace("ORDER BY turn", "ORDER BY turn NULLS FIRST")).fetchall()
    assert sorted((tuple(x) for x in out.collect()), key=str) == sorted(want, key=str)
    probe = next(x for x in want if x[0] == -7)
    text = "\\### Assistant: </turn> ok"
    assert probe[1] == 2 and probe[3] == len(text) and probe[4] == sha(text)


def brute_paths(rows):
    nodes = {(t, n): (p, role, text, s or 0) for t, n, p, role, text, s in rows}
    out = {}
    for t, n in nodes:
        if any(k[0] == t and v[0] == n for k, v in nodes.items()):
            continue
        path, at = [], n
        while (t, at) in nodes and len(path) <= len(nodes):
            path.append(at)
            at = nodes[t, at][0]
        if len(path) <= len(nodes):
            out[t, n] = path[::-1]
    return out, nodes


def test_trees_match_brute_force(spark):
    r = random.Random(8)
    rows = []
    for t in range(12):
        for n in range(r.randint(1, 25)):
            rows.append((t, n, r.randrange(n) if n and r.random() < 0.95 else r.choice([None, 777]), r.choice(["user", "assistant"]), f"m{n}", r.choice([None, 0.5, 1.0, -1.0])))
    rows += [(50, 1, 2, "user", "cycle", 1.0), (50, 2, 1, "user", "cycle", 1.0), (50, 3, 1, "user", "below", 1.0), (None, 1, None, "user", "m1", 1.0)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    want, nodes = brute_paths([x for x in rows if x[0] != 50])
    total = {k: sum(nodes[k[0], n][3] for n in v) for k, v in want.items()}
    for best in (None, 1, 2):
        got = {}
        for x in sorted(chat_trees.paths(df, best).collect(), key=lambda x: x.depth):
            got.setdefault((x.tree, x.leaf), []).append(int(x.text[1:]))
        ranked = {}
        for k in sorted(want, key=lambda k: (-total[k], k[1])):
            ranked.setdefault(k[0], []).append(k)
        assert got == {k: want[k] for ks in ranked.values() for k in ks[:best]}
    assert chat_trees.format_paths(chat_trees.paths(df.limit(0))).count() == 0
