import math
import random

from millrace.llm import toxicity as X

SCHEMA = "doc_id long, text string, grade string, severity int"
PLAIN = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)]
MILD, HARSH = ["rude", "sly", "dull"], ["vile", "foul", "mean"]


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(PLAIN) for _ in range(rng.randint(3, 120))]
        grade = rng.choice([0, 0, 0, 1, 2])
        for _ in range(rng.randint(1, 3) if grade else 0):
            words.insert(rng.randrange(len(words)), rng.choice(MILD if grade == 1 else HARSH).title())
        rows.append((i, " ".join(words), grade))
    return rows


def test_held_out_grades(spark):
    rows = corpus(1, 1500)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows], SCHEMA)
    graded = spark.createDataFrame([(i, g) for i, _, g in rows if i % 2], "doc_id long, grade int")
    model = X.train(docs, graded, 3)
    assert model[1] == sorted(model[1]) and len(model[1]) == 2
    got = {r.doc_id: r for r in X.predict(docs, model).collect()}
    held = [(g, got[i]) for i, _, g in rows if i % 2 == 0]
    assert sum((r.toxic) == (g > 0) for g, r in held) / len(held) > 0.97
    mean = [sum(r.severity for g, r in held if g == k) / sum(g == k for g, _ in held) for k in range(3)]
    assert mean[0] < 0.3 < mean[1] < mean[2]


def test_score_is_the_formula_on_the_whole_text(spark):
    model = ({"bad": 2.0, "good": -1.0}, [1.0, 3.0])
    texts = [None, "", "bad", "BAD, good! 3bad_bad", "fine " * 50_000 + "bad", "bad " * 30]
    got = {r.doc_id: r for r in X.predict(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA), model).collect()}
    sums = [0, 0, 2, 2 * (1 + math.log(3)) - 1, 2, 2 * (1 + math.log(X.SATURATION))]
    for i, s in enumerate(sums):
        ps = [1 / (1 + math.exp(t - s)) for t in model[1]]
        assert abs(got[i].severity - sum(ps)) < 1e-9 and got[i].toxic == (ps[0] >= X.CUT) and got[i].grade == sum(p >= X.CUT for p in ps)


def test_no_model_and_odd_labels(spark):
    docs = spark.createDataFrame([(1, "a", None, None), (2, None, None, None)], SCHEMA)
    graded = spark.createDataFrame([(1, 0), (1, None), (None, 1), (2, 7)], "doc_id long, grade int")
    assert X.train(docs, graded, 3) is None
    assert [(r.severity, r.toxic) for r in X.predict(docs, None).collect()] == [(0.0, False)] * 2
    assert X.predict(docs.limit(0), None).count() == 0


def test_grades_of_labels(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 1), (4, None, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    assert [r.grade for r in X.severity_grades(labels).orderBy("doc_id").collect()] == [0, 1, 2, 1, None]


def test_training_is_bounded_and_repeats(spark):
    rows = corpus(2, 300)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows], SCHEMA)
    graded = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, grade int")
    one, two = (X.train(d, graded, 3, sample=100) for d in (docs, docs.repartition(5)))
    assert one == two


def test_rows_that_repeat_stay_within_the_bound(spark):
    """One id that 5,000 documents share, and one row that repeats: no more than `sample` texts are learned from."""
    shared = [(7, f"text number {i} of one id", None, None) for i in range(5000)]
    docs = spark.createDataFrame(shared + [(8, "vile words", None, None)] * 3000, SCHEMA)
    graded = spark.createDataFrame([(7, 0)] * 50 + [(8, 1)] * 50, "doc_id long, grade int")
    rows = X.chosen_texts(docs, graded, 3, sample=10).collect()
    assert len(rows) == 10 and len({(r.doc_id, r.text) for r in rows}) == 10


def test_training_reads_whole_texts(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(PLAIN) for _ in range(2500)) + (" vile" if i % 2 else ""), i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, t, None, None) for i, t, _ in rows], SCHEMA)
    weights, _ = X.train(docs, spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, grade int"), 2)
    assert weights["vile"] > 0.5


def test_fit_reaches_the_optimum():
    """No direction from the fitted weights lowers the loss by more than a trace."""
    from collections import Counter

    rng = random.Random(6)
    grades = [rng.choice([0, 1, 2]) for _ in range(300)]
    texts = [Counter({"base": 1, **({"mild": 1} if g and rng.random() < 0.8 or rng.random() < 0.1 else {}), **({"harsh": 2} if g == 2 and rng.random() < 0.8 or rng.random() < 0.1 else {})}) for g in grades]
    weights, cuts = X.fit(texts, grades, 3, ridge=1e-2, rounds=1500)
    assert cuts[0] < cuts[1]

    def loss(w, t):
        total = sum(1e-2 * x * x / 2 for x in w.values())
        for text, g in zip(texts, grades):
            s = sum(w.get(f, 0) * X.gain(n) for f, n in text.items())
            for k in (0, 1):
                p = 1 / (1 + math.exp(t[k] - s))
                total -= math.log(p if g > k else 1 - p) / len(grades)
        return total

    best = loss(weights, cuts)
    for step in (0.05, -0.05):
        for f in weights:
            assert loss({**weights, f: weights[f] + step}, cuts) > best - 1e-4
        for k in (0, 1):
            assert loss(weights, [c + step * (i == k) for i, c in enumerate(cuts)]) > best - 1e-4
