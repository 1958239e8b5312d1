"""Steps whose cost must grow with the input: what their plans hold, and that they still do the whole job."""

import datetime as dt
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.functions import text as X
from lorekeep.operators import entities as E
from lorekeep.operators import extract, graph, scan, search
from lorekeep.plans import schema
from lorekeep.sources import bundle, ingest

NOW = dt.datetime(2024, 1, 1)


def units(spark, rows):
    form = "id string, statement string, attrs struct<pattern:string,value:string,unit:string>, subject string, valid_from timestamp, valid_to timestamp, created_at timestamp, embedding array<float>, assignments array<struct<src:string,rel:string,tgt:string>>"
    return scan.features(spark.createDataFrame([(i, s, ("definition", None, None), subject, None, None, None, None, held) for i, s, subject, held in rows], form))


def test_rules_of_a_pair_compile(spark):
    rows = units(spark, [("a", "x", "s", []), ("b", "y", "s", [])])
    plan = scan.score_pairs(scan.pairs_within(rows, rows).withColumn("cos", F.lit(0.5))).select("score")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join ")]
    assert "Generate explode" in above and "lambdafunction" not in above


def test_assignments_that_clash(spark):
    many = [("m", "lives_in", "x"), ("m", "lives_in", "y")]
    rows = units(spark, [("a", "p", "s", [("m", "lives_in", "x")]), ("b", "q", "s", [("m", "lives_in", "x")]), ("c", "r", "s", many), ("d", "t", "s", [("m", "lives_in", None), ("m", "uses", "z")]), ("e", "u", "s", many)])
    got = scan.score_pairs(scan.pairs_within(rows, rows).withColumn("cos", F.lit(1.0))).select("a.id", "b.id", "method").collect()
    assert {r[:2] for r in got} == {("a", "c"), ("b", "c"), ("a", "e"), ("b", "e"), ("c", "e")} and {r[2] for r in got} == {"rule:exclusive-assignment"}


def test_pairs_within_are_all_pairs_in_blocks(spark):
    rows = units(spark, [(f"{i:02}", "x", "one" if i < 30 else "two", []) for i in range(40)])
    got = scan.pairs_within(rows, rows)
    assert got.select("a.id", "b.id").distinct().count() == got.count() == 30 * 29 // 2 + 10 * 9 // 2
    assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 30 * 29 // 2


def test_partners_by_subject(spark):
    rows = scan.placed(units(spark, [(f"{i:02}", "x", "one", []) for i in range(9)] + [("z", "x", None, [])]), 3)
    got = scan.candidates(rows, rows, 3).select("a.id", "b.id").collect()
    want = {(f"{p:02}", f"{o:02}") for p in range(9) for o in [q for q in range(9) if q != p][:3]}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_tables_without_lines_are_left_alone(spark):
    state = schema.empty_state(spark)
    alias = schema.conform(spark.createDataFrame([("1", "e", "ä \"b\"")], "id string, entity_id string, alias string"), "entity_aliases")
    lines = bundle.export(state | {"entity_aliases": alias.unionAll(alias)}, NOW).select("value")
    new, counts = bundle.load(state, lines)
    assert new["artifacts"] is state["artifacts"] and new["entity_aliases"].collect() == alias.collect()
    assert [tuple(r) for r in counts.where("in_bundle > 0").collect()] == [("entity_aliases", 2, 1)]
    escaped = lines.withColumn("value", F.replace("value", F.lit('{"type":"entity_aliases"'), F.lit('{"type":"\\u0065ntity_aliases"')))
    assert bundle.read_lines(escaped)["entity_aliases"].count() == 2


def test_words_as_they_stand(spark):
    rows = spark.createDataFrame([(1, "hier und da"), (2, "hier unds da")], "id int, content string")
    assert [r.id for r in search.text_hits(search.indexed(rows, stemmed=False), "und").collect()] == [1]
    assert [r.id for r in search.text_hits(search.indexed(rows), "und").orderBy("id").collect()] == [1, 2]


def test_segments_come_in_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(extract, "SLICE", 2)
    rows = spark.createDataFrame([(i, f"text {i}\n# Head\nmore" if i % 3 else None) for i in range(11)], "id int, text string").coalesce(1)
    got = {(r.id, r.seq): (r.heading, r.content) for r in extract.segments(rows).collect()}
    assert got == {(i, s): v for i in range(11) if i % 3 for s, v in enumerate([(None, f"text {i}"), ("Head", "more")])}


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_names_of_shared_trigrams_are_ruled_out_where_they_meet(spark, monkeypatch, threshold):
    hexes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(150)]
    names = [*hexes, *[h[:60] + "0" * 4 for h in hexes[:20]], *[h[:45] for h in hexes[20:40]], "new york", "new york city", "york new"]
    rows = spark.createDataFrame([(f"{i:03}", n, "other") for i, n in enumerate(names)], "id string, name string, kind string")
    met, sharing = [], E._sharing
    monkeypatch.setattr(E, "_sharing", lambda *a: met.append(sharing(*a)) or met[-1])
    got = {tuple(r) for r in E.name_pairs(rows, threshold).collect()}
    a, b = rows.select(F.col("id").alias("a"), F.col("name").alias("m")), rows.select(F.col("id").alias("b"), F.col("name").alias("n"))
    every = a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(X.name_similarity(F.col("m"), F.col("n")), 6).alias("score"))
    assert got == {tuple(r) for r in every.where(F.col("score") >= threshold).collect()} and len(got) > 10
    assert sum(df.distinct().count() for df in met) < 2 * len(names)  # thousands of pairs share a rare trigram


def test_dismissed_pairs_are_left_out_however_many(spark):
    rows = [(f"{i}", f"Postgres {'x' * 9}{i}", "tool") for i in range(6)]
    gone = [(a, b, "dismiss") for a in "012345" for b in "012345" if a > b and (a, b) != ("5", "4")]
    state = schema.empty_state(spark) | {"entities": schema.conform(spark.createDataFrame(rows, "id string, name string, kind string"), "entities")}
    state = state | {"entity_merge_audit": schema.conform(spark.createDataFrame(gone, "winner_entity_id string, loser_entity_id string, action string"), "entity_merge_audit")}
    assert [(r.a, r.b) for r in E.merge_suggestions(state, 0.5).collect()] == [("4", "5")]


def test_vectors_are_shuffled_as_often_for_any_table(spark, monkeypatch):
    monkeypatch.setattr(scan, "TILE", 60)
    monkeypatch.setattr(scan, "COMPARED", 16)
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3 if i % 9 else 4)] if i % 13 else None) for i in range(150)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    got = {(r.probe, r.other): (round(r.cos, 9), r["rank"]) for r in scan.nearest_pairs(df, df.where("id % 2 = 0"), 5, 0.6, block=8).collect()}
    size = {i: np.linalg.norm(v) for i, v in rows if v}
    cos = lambda a, b: float(np.dot(a, b))
    want = {}
    for i, v in rows[::2]:
        near = [(round(-cos(v, w) / size[i] / size[j], 9), j) for j, w in rows if v and w and len(v) == len(w) and i != j and size[i] and size[j]]
        want |= {(i, j): (-c, at) for at, (c, j) in enumerate(sorted(x for x in near if 1 + x[0] < 0.6)[:5], 1)}
    assert len(got) == len(want) > 100
    assert sorted((p[0], *r) for p, r in got.items()) == sorted((p[0], *r) for p, r in want.items())
    monkeypatch.setattr(scan, "TILE", 65_536)
    times = [len(x.split(",")) for n in (1000, 3000) for x in re.findall(r"explode\(\[([\d,]+)\]\)", scan.nearest_pairs(*[spark.range(n).select("id", F.array(F.rand(1), F.rand(2)).alias("embedding"))] * 2, block=8)._jdf.queryExecution().optimizedPlan().toString())]
    assert times == [4] * 4


def edges(spark, ends):
    rows = [(f"e{i:03}", s, t, "knows", 1.0, "active") for i, (s, t) in enumerate(ends)]
    return spark.createDataFrame(rows, "id string, source_entity_id string, target_entity_id string, relation_type string, confidence double, status string")


def test_adjacency_is_stored_in_ranges_that_are_sorted_in_memory(spark, monkeypatch):
    monkeypatch.setattr(graph, "SORTED", 10)
    g = edges(spark, [(f"p{i % 7}", f"s{i % 5}") for i in range(35)])
    adj = graph.adjacency(g)
    assert "source_entity_id" not in adj.columns and len(adj.inputFiles()) > 4
    assert sorted(map(tuple, graph.both_ways(adj, *graph.EDGE[1:]).collect())) == sorted(map(tuple, graph.both_ways(g, *graph.EDGE[1:]).collect()))
    assert graph.neighborhood(adj, "s1", 3, 0).collect() == graph.neighborhood(g, "s1", 3, 0).collect()


def test_edges_of_two_sided_graphs_are_not_grouped_again(spark):
    two_sided = [(f"p{i % 7}", f"s{i % 5}") for i in range(0, 35, 2)] + [("p1", "s1"), ("p1", "s1")]
    mixed = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("d", "d"), ("d", "a"), ("p9", "s9"), ("s9", "x"), ("p9", "x")]
    for ends in (two_sided, two_sided + mixed):
        g = edges(spark, ends)
        roots = spark.createDataFrame([(n,) for n in sorted({n for e in ends for n in e})], "root string")
        for depth in (1, 2, 3):
            got = sorted((r.root, r.relationship_id, r.depth, r.source_entity_id, r.target_entity_id) for r in graph.neighborhoods(graph.adjacency(g), roots, depth, max_nodes=0).collect())
            want = []
            for (root,) in roots.collect():
                lvl = {root: 0}
                for at in range(1, depth):
                    lvl |= {y: at for s, t in ends for x, y in ((s, t), (t, s)) if lvl.get(x) == at - 1 and y not in lvl}
                want += [(root, f"e{i:03}", 1 + min(lvl.get(s, 9), lvl.get(t, 9)), s, t) for i, (s, t) in enumerate(ends) if s in lvl or t in lvl]
            assert got == sorted(want)
    plan = graph.neighborhoods(edges(spark, two_sided), spark.createDataFrame([("s1",), ("p1",)], "root string"), 2, max_nodes=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_exports_are_parsed_once_and_counted_without_their_texts(spark):
    chat = lambda i: f'{{"conversations": [{{"id": "{i}", "messages": [{{"role": "user", "content": "hello {i}"}}, {{"role": "user", "content": " "}}]}}]}}'
    raw = spark.createDataFrame([("a", chat(1)), ("b", chat(2)), ("d", "{"), ("e", None)], "filename string, payload string")
    state, counts = ingest.chat_export(schema.empty_state(spark), raw, "generic", NOW)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "parse_json" not in plan and "encode(" not in plan
    assert tuple(counts.first()) == (2, 2, 0, 2)
    assert sorted(r.content for r in state["messages"].collect()) == ["hello 1", "hello 2"]
    assert sorted((r.filename, bytes(r.raw_content).decode()) for r in state["artifacts"].collect()) == [("a", chat(1)), ("b", chat(2))]
    again, counts = ingest.chat_export(state, raw, "generic", NOW)
    assert tuple(counts.first()) == (0, 0, 2, 2) and again["messages"].count() == 2
