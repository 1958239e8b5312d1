import random
import zlib

import numpy as np
from helpers import awkward, docs
from lorekeep.llm import langid, queries, toxicity
from pyspark.sql import functions as F

SYLLABLES = {"en": "the ing er and th on tion re", "de": "der sch ung ein ich ver keit für", "es": "el ción ar ndo los ía qué ñ"}


def prose(r, lang, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(r.choice(s) for _ in range(r.randint(1, 3))) for _ in range(n))


def corpus(n=300, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        out.append((i, prose(r, lang, r.randint(5, 60)), lang))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_language_of_held_out_texts(spark, tmp_path):
    rows = [*corpus(), (900, None, "en"), (901, "", "de"), (902, "12 %% 3", "es"), (903, "x", None), (900, None, "en")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = {i: lang for i, _, lang in rows}
    right = []
    for x in got:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and 0 <= x.score <= 1
        if x.doc_id in (900, 901, 902):
            assert (x.lang_pred, x.score) == ("und", 0.0)
        elif x.doc_id != 903 and x.held_out:
            right.append(x.lang_pred == want[x.doc_id])
    assert len(right) > 50 and np.mean(right) > 0.97


def test_prediction_is_the_nearest_centroid(spark):
    rows = corpus(120)
    model = langid.fit(frame(spark, rows))
    assert sorted(set(model.owner.tolist())) == [0, 1, 2] and len(model.owner) > 3
    for _, text, _ in rows[:20]:
        x = np.log1p(langid.grams(text).astype(float)) * model.idf
        cos = [float(x @ c / np.linalg.norm(x)) for c in model.centroids]
        lang, score, rejected = model.predict([text])
        assert lang[0] == model.languages[model.owner[int(np.argmax(cos))]] and abs(score[0] - max(cos)) < 1e-4 and not rejected[0]
    assert model.predict(["Ω" * 40])[2] == [True]


def test_predict_keeps_columns_and_odd_rows(spark):
    model = langid.fit(frame(spark, corpus(60)))
    odd = docs(spark, awkward()).withColumn("lang_pred", F.lit("clash"))
    got = langid.predict(odd, model)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "lang_score", "lang_rejected"] and got.count() == odd.count()
    nothing = langid.fit(odd.limit(0))
    assert nothing.languages == [] and {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}
    assert langid.predict(odd.limit(0), model).count() == 0


def labelled(n=400, seed=3):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.3
        words = [f"w{r.randint(0, 400)}" for _ in range(r.randint(5, 60))]
        if toxic:
            words.insert(r.randint(0, len(words)), r.choice(["idiot", "Idiots", "grimlocks", "grimlocking", "grimlocked"]))
        if r.random() < (0.5 if toxic else 0.05):
            words.insert(0, "muslims")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_of_held_out_texts(spark, tmp_path):
    rows, labels = labelled()
    docs(spark, [*rows, (900, None), (901, ""), (0, rows[0][1])]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels] + [(5000, 1, 1), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op6_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + 3
    wrong = 0
    for x in got:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5)
        if x.held_out and x.doc_id < 900:
            wrong += x.predicted != labels[x.doc_id][1]
    assert wrong <= 2


def test_counterfactuals_take_weight_from_identity_terms():
    rows, labels = labelled(600)
    sets, y = [toxicity.words(t) for _, t in rows], [t for _, t in labels]
    plain, fair = toxicity.train(sets, y, weight=0.0), toxicity.train(sets, y, weight=20.0)
    gap = lambda m: abs(m.of("muslims") - m.of("christians"))
    assert gap(plain) > 0.5 and gap(fair) < 0.3 * gap(plain)
    neutral = "my neighbours are muslims and w1 w2"
    assert fair.score(neutral) < plain.score(neutral) and fair.score(neutral) < 0.5 < fair.score("what an idiot w1")


def test_toxicity_without_labels_or_rows(spark):
    odd = docs(spark, awkward()).withColumn("toxicity", F.lit("clash"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd, model)
    assert got.count() == odd.count() and got.schema["toxicity"].dataType.simpleString() == "double"
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_every_label_is_sampled(spark):
    rows = [(i, "x", f"l{i:05d}") for i in range(1200)] + [(2000 + i, "x", "zz") for i in range(900)]
    got = {r.lang: r.n for r in langid.labelled_sample(frame(spark, rows), "lang", 300).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert len(got) == 1201 and 200 < got.pop("zz") < 400 and set(got.values()) == {1}


def mentions(n=700, seed=5):
    """A group word of no list stands in many toxic and more clean texts; a stem that only toxic texts have decides."""
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.25
        words = [f"w{r.randint(0, 300)}" for _ in range(r.randint(8, 40))] + ["zorblings"] * (r.random() < (0.6 if toxic else 0.35)) + ["plain"] * (r.random() < 0.5)
        if toxic and r.random() < 0.9:
            words += [r.choice(["grimlocks", "grimlocking", "grimlocked"])]
        rows.append(set(words))
        labels.append(int(toxic))
    return rows, labels


def test_mentions_are_induced_and_lose_their_weight():
    rows, labels = mentions()
    plain, fair = toxicity.train(rows, labels, weight=0.0), toxicity.train(rows, labels, weight=20.0)
    assert "zorblings" in fair.swaps and fair.pairs > 100 and "grimlocks" not in fair.swaps
    assert plain.of("zorblings") > 0.2 and abs(fair.of("zorblings")) < 0.3 * plain.of("zorblings")
    assert fair.score("the zorblings w1 w2") < plain.score("the zorblings w1 w2") and fair.score("w1 grimlocked") > 0.5


def test_scores_and_loss_by_hand():
    rows, labels = mentions(300)
    model = toxicity.train(rows, labels)
    text = "Grimlocking w1 zorblings, GRIMLOCKING w7"
    z = model.bias + sum(model.weights.get(f, 0.0) for w in {"grimlocking", "w1", "zorblings", "w7"} for f in [w, *(w[:k] + "-" for k in (4, 5, 6) if len(w) > k)])
    assert abs(model.score(text) - 1 / (1 + np.exp(-z))) < 1e-12

    kept = toxicity.without_copies(rows, labels)
    n1 = sum(labels[i] for i in kept)

    def loss(m):
        out = 0.0
        for i in kept:
            p = min(max(m.score(" ".join(rows[i])), 1e-12), 1 - 1e-12)
            out -= (np.log(p) * 0.5 / n1) if labels[i] else (np.log(1 - p) * 0.5 / (len(kept) - n1))
        gaps = [sum(map(m.of, rows[i])) - sum(map(m.of, c)) for i in kept if (c := toxicity.counterfactual(rows[i], m.swaps))]
        return out + toxicity.WEIGHT * (np.mean(np.square(gaps)) if gaps else 0) + 1e-3 * sum(w * w for w in m.weights.values()) / max(len(m.weights), 1)

    best = loss(model)
    for scale in (0.0, 0.5, 1.5):  # the fitted weights beat scaled ones and another bias
        assert best < loss(toxicity.Model(model.bias, {f: w * scale for f, w in model.weights.items()}, model.swaps))
    assert best < loss(toxicity.Model(model.bias + 1, model.weights, model.swaps)) and best < loss(toxicity.Model(model.bias - 1, model.weights, model.swaps))


def test_copies_are_told_from_texts_of_common_words():
    r = random.Random(1)
    base = [{f"w{r.randint(0, 60)}" for _ in range(30)} for _ in range(200)]
    copies = [s | {f"x{i}"} for i, s in enumerate(base[:50])]
    kept = toxicity.without_copies([*base, *copies], [0] * 250)
    assert sum(i >= 200 for i in kept) <= 5
    for i in set(range(200)) - set(kept):
        assert any(len(base[i] & base[j]) >= 0.8 * len(base[i] | base[j]) for j in kept if j < i)


def test_unlearned_language_is_rejected_more_than_learned_ones(spark):
    rows = corpus(400)
    model = langid.fit(frame(spark, [x for x in rows if x[2] != "es"]))
    other = [model.predict([t])[2][0] for _, t, lang in rows if lang == "es"]
    own = [model.predict([t])[2][0] for _, t, lang in rows if lang != "es"]
    assert np.mean(own) == 0 and np.mean(other) >= np.mean(own)


def test_clashing_columns(spark):
    model = langid.fit(frame(spark, corpus(60)))
    df = docs(spark, ["the ing er"]).withColumn("a.b", F.lit(1)).withColumn("_text", F.lit("x")).withColumn("LANG_PRED", F.lit("z"))
    got = langid.predict(df, model)
    assert got.columns == [*df.columns[:-1], "lang_pred", "lang_score", "lang_rejected"] and got.first()["a.b"] == 1
    scored = toxicity.score(df, toxicity.Model(0.0, {}))
    assert scored.columns == [*df.columns, "toxicity"] and scored.first()["_text"] == "x"
