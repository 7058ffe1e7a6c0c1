import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import learning, quality, toxicity


def auc(scores, labels):
    s, y = np.array(scores), np.array(labels)
    a, b = s[y == 1], s[y == 0]
    return ((a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean())


@pytest.fixture(scope="module")
def good_and_bad(prose):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        text, bad = prose(rng.randint(20, 120), i), rng.random() < 0.3
        if bad:
            w = text.split()
            kind = rng.randrange(3)
            text = " ".join(x + rng.choice(["###", "%%%", "&&&"]) for x in w) if kind == 0 else " | ".join(w) if kind == 1 else " ".join([w[0]] * len(w))
        rows.append((i, text))
        labels.append((i, int(not bad), 0))
    return rows, labels


@pytest.fixture(scope="module")
def mild_and_toxic(prose):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        w, bad = prose(rng.randint(20, 120), 5000 + i).split(), rng.random() < 0.25
        if bad:
            for _ in range(max(2, len(w) // 20)):
                w.insert(rng.randrange(len(w)), rng.choice(["grobnik", "vashtul", "plimdork", "Zornag"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def frames(spark, make, data, extra=False):
    return make(data[0], extra=extra), spark.createDataFrame(data[1], "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark, make, good_and_bad):
    docs, labels = frames(spark, make, good_and_bad, extra=True)
    truth = {d: q for d, q, _ in good_and_bad[1]}
    got = [r for r in quality.classify(docs, labels).collect() if r["held_out"]]
    assert 200 < len(got) < 400
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in got]) > 0.97
    assert auc([r["score"] for r in got], [truth[r["doc_id"]] for r in got]) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_toxicity_on_held_out_rows(spark, make, mild_and_toxic):
    docs, labels = frames(spark, make, mild_and_toxic, extra=True)
    truth = {d: t for d, _, t in mild_and_toxic[1]}
    got = [r for r in toxicity.classify(docs, labels).collect() if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in got]) > 0.97
    assert auc([r["score"] for r in got], [truth[r["doc_id"]] for r in got]) > 0.98


def test_toxicity_by_join_gives_the_same(spark, make, mild_and_toxic, monkeypatch):
    docs, labels = frames(spark, make, mild_and_toxic)
    one = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, labels).collect()}
    monkeypatch.setattr(toxicity, "MODEL_ROWS", 0)
    two = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, labels).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_toxicity_with_a_small_memory(monkeypatch):
    import pyarrow as pa

    scorer = toxicity.WordRatios((np.zeros(0, np.int64), np.zeros(0, np.float32)))
    monkeypatch.setattr(toxicity, "MEMO", 3)
    got = scorer.features(pa.array([["one", "two", "three", "four", "five", "six"], [], ["one"]]))
    assert got == pytest.approx(np.array([[0, 0, 0, 0, np.log1p(6)], [0] * 5, [0, 0, 0, 0, np.log1p(1)]]))


def brute_shared(words):
    """Kneser-Ney chances, by string, of the shared orders, from the words (with repeats)."""
    grams = Counter()
    for w in words:
        padded = f"_{w}_"
        for i in range(2, len(padded) + 1):
            grams[padded[max(0, i - toxicity.ORDER) : i]] += 1
    weights, above = {}, {g for g in grams if len(g) == toxicity.ORDER}
    for order in range(toxicity.ORDER - 1, 0, -1):
        level = Counter(g[-order:] for g in above)
        level.update({g: n for g, n in grams.items() if len(g) == order and g[0] == "_"})
        weights[order], above = level, set(level)
    chances = {}
    for order in range(1, toxicity.ORDER):
        heads = defaultdict(list)
        for g, n in weights[order].items():
            heads[g[:-1]].append(n)
        for g, n in weights[order].items():
            every = heads[g[:-1]]
            chances[g] = (n - toxicity.DISCOUNT + toxicity.DISCOUNT * len(every) * chances.get(g[1:], toxicity.UNIFORM)) / sum(every)
    return grams, weights, chances


def test_toxicity_model_against_brute_force(spark, prose):
    toxic, other = (prose(n, seed).split() for n, seed in ((60, 71), (400, 72)))
    counts = Counter(toxic + other)
    rows = [(w, Counter(toxic)[w], Counter(other)[w], n) for w, n in counts.items()]
    df = spark.createDataFrame(rows, "word string, n_tox long, n_ord long, n_all long")
    grams, weights, chances = brute_shared(toxic + other)
    frame = spark.createDataFrame(list(grams.items()), "gram string, n_all long")
    got = {r["tail"]: r["p"] for r in toxicity.shared(frame).collect()}
    assert got.keys() == chances.keys() and all(got[g] == pytest.approx(chances[g], rel=1e-12) for g in got)

    model = {r["text"]: r["llr"] for r in toxicity.ratios(df).collect()}
    by_class = {name: brute_shared(words)[0] for name, words in (("tox", toxic), ("ord", other))}

    def chance(gram, name):
        after = {g: n for g, n in by_class[name].items() if g[:-1] == gram[:-1]}
        back = chances.get(gram[1:], toxicity.UNIFORM)
        if not after:
            return back
        return (max(after.get(gram, 0) - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(after) * back) / sum(after.values())

    for gram in by_class["tox"] | by_class["ord"]:
        assert model[gram] == pytest.approx(np.log(chance(gram, "tox") / chance(gram, "ord")), abs=1e-5)


def test_shared_chances_sum_to_one(prose):
    """Over the UNIFORM ** -1 characters that there can be, after each context of each order."""
    _, weights, chances = brute_shared(prose(300, 73).split())
    alphabet = {g for g in weights[1]}

    def chance(g):
        if not g:
            return toxicity.UNIFORM
        if g in chances:
            return chances[g]
        after = [n for t, n in weights[len(g)].items() if t[:-1] == g[:-1]]
        back = chance(g[1:])
        return toxicity.DISCOUNT * len(after) * back / sum(after) if after else back

    unseen = round(1 / toxicity.UNIFORM) - len(alphabet)
    for order in (1, 2, 3):
        for head in list({g[:-1] for g in weights[order] if not g.startswith("_")})[:20]:
            total = sum(chance(head + c) for c in alphabet) + unseen * chance(head + "\x00")
            assert total == pytest.approx(1)


@pytest.mark.parametrize("op", [quality, toxicity])
def test_held_out_labels_are_never_learned(spark, make, op, good_and_bad, mild_and_toxic):
    data = good_and_bad if op is quality else mild_and_toxic
    column, folds, fold = ("quality", 3, 1) if op is quality else ("toxic", 4, 2)
    docs, labels = frames(spark, make, data)
    from pyspark.sql import functions as F

    turned = labels.withColumn(column, F.when(learning.held_out(F.col("doc_id"), folds, fold), 1 - F.col(column)).otherwise(F.col(column)))
    a = sorted(map(tuple, op.classify(docs, labels).collect()))
    assert a == sorted(map(tuple, op.classify(docs, turned).collect()))


@pytest.mark.parametrize("op", [quality, toxicity])
def test_edges(spark, make, op, edge_rows, good_and_bad, mild_and_toxic):
    data = good_and_bad if op is quality else mild_and_toxic
    rows = [(None if d is None else 10_000 + d, t) for d, t in edge_rows]
    docs, labels = frames(spark, make, (data[0] + rows, data[1] + [(None, 1, 1), (1, None, None), (3, 1, 1), (77_777, 1, 1)]), extra=True)
    got = op.classify(docs, labels).collect()
    assert len(got) == len(data[0]) + len(rows) and all(0 <= r["score"] <= 1 for r in got)


@pytest.mark.parametrize("op", [quality, toxicity])
def test_without_labels_or_rows(spark, make, op):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(i, 1, 1) for i in range(50)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in op.classify(make([(1, "x"), (2, None)]), none).collect()} == {0.5 if op is quality else 0.0}
    assert {r["score"] for r in op.classify(make([(i, "x") for i in range(50)]), one).collect()} == {1.0}
    assert op.classify(make([]), one).count() == 0


def test_good_rows_stay(spark, make, good_and_bad):
    docs, labels = frames(spark, make, good_and_bad, extra=True)
    out = quality.keep_good(docs, labels)
    kept = {r["doc_id"] for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == kept


def test_ridge_against_a_dense_solve(spark, make, good_and_bad):
    """The model's weights are those of a ridge regression on the features of all fitting rows at once; reruns agree."""
    docs, labels = frames(spark, make, good_and_bad)
    model = quality.fit(docs, labels, "quality", 3, 1)
    text = dict(good_and_bad[0])
    rows = sorted(learning.training_labels(labels, "quality", 3, 1, quality.MAX_TRAIN).where("part < 75").collect())
    stats = np.array([quality.statistics(text[r["doc_id"]]) for r in rows], dtype=np.float32).astype(np.float64)
    assert np.allclose(model.mean, stats.mean(0)) and np.allclose(model.deviation, np.sqrt(np.maximum(stats.var(0), 1e-6)), rtol=1e-3)
    a, y = model.features(stats), np.array([r["label"] for r in rows], dtype=np.float64)
    k = a.shape[1]
    dense = np.linalg.lstsq(np.vstack([a, np.sqrt(quality.RIDGE) * np.eye(k)]), np.concatenate([y, np.zeros(k)]), rcond=None)[0]
    assert np.allclose(a @ model.weights, a @ dense, atol=1e-6)
    rbf = model.features(stats[:40])[:, : quality.FEATURES]
    z = np.clip((stats[:40] - model.mean) / model.deviation, -6, 6)
    kernel = np.exp(-((z[:, None] - z) ** 2).sum(2) / (2 * z.shape[1]))
    assert np.abs(rbf @ rbf.T - kernel).max() < 0.3 and np.abs(rbf @ rbf.T - kernel).mean() < 0.08
    again = quality.fit(docs.repartition(5), labels, "quality", 3, 1)
    assert np.array_equal(model.weights, again.weights) and np.array_equal(model.chances, again.chances)


def test_isotonic_fit():
    fit = learning.pool_adjacent_violators(np.array([1.0, 0.0, 2.0, 1.5, 3.0]), np.ones(5))
    assert fit.tolist() == [0.5, 0.5, 1.75, 1.75, 3.0]
    assert learning.pool_adjacent_violators(np.zeros(0), np.zeros(0)).tolist() == []


def test_toxicity_cuts_words_at_numerals_both_ways(spark, make, mild_and_toxic, monkeypatch):
    rows, labels = mild_and_toxic
    signs = ["\u00b2", "\u00bd", "\u2167", "\u2460", "\u3007", "3"]
    marked = [(d, t.replace("e", "e" + signs[d % len(signs)]).replace(" ", f" {signs[d % len(signs)]} ", 1)) for d, t, *_ in rows]
    docs, labels = frames(spark, make, (marked, labels))
    one = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, labels).collect()}
    monkeypatch.setattr(toxicity, "MODEL_ROWS", 0)
    two = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, labels).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_words_are_letters_only(spark):
    text = "x\u00b2y \u00bdcup \u2167 na\u00efve 日本3語 a_b"
    row = spark.createDataFrame([(text,), ("",)], "text string").select(toxicity.words_of(F.col("text")).alias("w")).collect()
    assert row[0]["w"] == ["x", "y", "cup", "na\u00efve", "日本", "語", "a", "b"] and row[1]["w"] == []


def test_grams_of_a_word(spark):
    words = ["a", "ab", "abcdefgh", "𝄞é日", "x" * 40]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", toxicity.grams_of(F.col("w")).alias("g"))
    for r in df.collect():
        padded = f"_{r['w']}_"
        assert r["g"] == [padded[max(0, i - toxicity.ORDER) : i] for i in range(2, len(padded) + 1)]


def test_long_words_take_linear_time(spark, make, mild_and_toxic):
    """A text of a million letters without a space goes through the whole operator."""
    import time

    rows, labels = mild_and_toxic[0][:60], spark.createDataFrame(mild_and_toxic[1][:60], "doc_id long, quality int, toxic int")

    def seconds(n):
        docs = make([*rows, (10_000, "ab" * (n // 2))])
        began = time.perf_counter()
        assert toxicity.classify(docs, labels).count() == 61
        return time.perf_counter() - began

    seconds(10)
    short, small, large = seconds(10), seconds(250_000), seconds(1_000_000)
    assert large - short < 60 and large < 6 * max(small, 2)


def test_a_score_does_not_turn_with_its_batch():
    rng = np.random.default_rng(0)
    model = quality.Model(0.5)
    x = rng.normal(size=(1500, 20)).astype(np.float32)
    model.scale(1500, x.sum(0, dtype=float), (x.astype(float) ** 2).sum(0))
    model.weights = rng.normal(size=quality.FEATURES + 21)
    whole = model.raw(x)
    for n in (1, 7, 1000):
        assert np.array_equal(np.concatenate([model.raw(x[i : i + n]) for i in range(0, 1500, n)]) if n > 1 else np.array([model.raw(x[i : i + 1])[0] for i in range(0, 1500, 50)]), whole if n > 1 else whole[::50])


def test_a_labelled_id_of_very_many_rows_counts_once(spark, make, good_and_bad):
    """The model is that of the rows without the copies."""
    rows, labels = good_and_bad[0], spark.createDataFrame(good_and_bad[1], "doc_id long, quality int, toxic int")
    one = quality.fit(make(rows), labels, "quality", 3, 1)
    copies = make(rows).unionByName(make([rows[0]]).crossJoin(spark.range(20_000)).drop("id"))
    many = quality.fit(copies, labels, "quality", 3, 1)
    assert np.array_equal(one.weights, many.weights) and np.array_equal(one.knots, many.knots)


def test_words_are_looked_up_some_at_a_time(monkeypatch):
    monkeypatch.setattr(toxicity, "TOGETHER", 3)
    scorer, sizes = toxicity.WordRatios((np.zeros(0, np.int64), np.zeros(0, np.float32))), []
    monkeypatch.setattr(scorer, "_learn", lambda words, f=scorer._learn: (sizes.append(len(words)), f(words)))
    assert scorer.of([f"w{c}" for c in "abcdefgh"]).tolist() == [0.0] * 8 and sizes == [3, 3, 2]
