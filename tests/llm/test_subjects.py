import random

import numpy as np

from cellarflow.llm.subjects import assign_subjects, composition

LATIN = {1: "vines pruning rows soil frost buds roots", 2: "court statute licence ruling appeal decree label", 3: "race team medal lap sprint coach final"}
OTHER = {1: "лозы обрезка ряды почва мороз почки корни", 2: "суд закон лицензия решение апелляция указ норма", 3: "гонка команда медаль круг спринт тренер финал"}
REMARKS = ["More will follow.", "Thanks for reading!", "Мы ещё вернёмся к этому."]


def sentence(rng, words):
    return " ".join(rng.sample(words.split(), 4)) + rng.choice([".", "!", " 2020."])


def corpus(n, seed):
    rng = random.Random(seed)
    docs, labels, truth = [], [], {}
    for i in range(n):
        words = rng.choice([LATIN, OTHER])
        main = rng.sample([1, 2, 3], rng.choice([1, 1, 2]))
        parts = [sentence(rng, words[s]) for s in main for _ in range(rng.randint(3, 5))] + [rng.choice(REMARKS)]
        passing = [s for s in (1, 2, 3) if s not in main]
        if rng.random() < 0.3:
            parts.append(sentence(rng, words[passing[0]]))
        rng.shuffle(parts)
        docs.append((i, "<p>" + rng.choice([" ", "\n", "</p><p>"]).join(parts) + "</p>"))
        truth[i] = set(main)
        if i % 3 == 0:
            labels += [(i, s if rng.random() > 0.04 else s % 3 + 1) for s in main]
    return docs, labels, truth


def test_held_out(spark):
    docs, labels, truth = corpus(600, 3)
    docs += [(1000, None), (1001, ""), (1002, " \n"), (1003, REMARKS[0]), (1004, (LATIN[2] + ". ") * 20_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, *labels[:5], (None, 1), (7, None)], "doc_id long, subject_id int")
    found = {}
    for r in assign_subjects(d, "doc_id", "text", lab, "doc_id", "subject_id").collect():
        found.setdefault(r.doc_id, set()).add(r.subject_id)
    right = sum(found.get(i) == s for i, s in truth.items())
    assert right >= 0.97 * len(truth)
    assert found[1004] == {2} and not {1000, 1001, 1002, 1003} & set(found)


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, subject_id int")
    assert assign_subjects(d, "doc_id", "text", lab, "doc_id", "subject_id").count() == 0
    full = spark.createDataFrame([(1, "a b c. d e f.")], "doc_id long, text string")
    assert assign_subjects(full, "doc_id", "text", lab, "doc_id", "subject_id").count() == 0


def test_composition(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, None, "x"), (4, "b", None), (5, None, "")], "doc_id long, source string, text string")
    shares = spark.createDataFrame([(1, 7, 0.75), (1, 8, 0.25), (2, 7, 0.6), (3, 8, 1.0)], "doc_id long, subject_id int, share double")
    got = {(r.source, r.subject_id): (r.n_documents, r.weight, r.share_of_source) for r in composition(docs, shares, "doc_id", "subject_id", "source").collect()}
    assert got == {("a", 7): (2, 1.75, 0.875), ("a", 8): (1, 0.25, 0.125), (None, 8): (1, 1.0, 0.5), ("b", None): (1, 1.0, 1.0), (None, None): (1, 1.0, 0.5)}
    assert composition(docs.limit(0), shares, "doc_id", "subject_id", "source").count() == 0


def test_sums_of_matrices(spark, monkeypatch):
    import cellarflow.llm.subjects as module

    for size in (5, 1000):
        monkeypatch.setattr(module, "SLICE", size)
        total = module.sum_matrices(spark.range(0, 40, 1, 6), lambda batches: sum((np.outer(np.arange(4), b.column(0).to_numpy()[:, None].sum(0).repeat(3)) for b in batches), np.zeros((4, 3))), (4, 3))
        assert np.array_equal(total, np.outer(np.arange(4), [780] * 3))
