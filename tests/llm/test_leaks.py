import random

import numpy as np
from pyspark.sql import types as T

from cellarflow.llm.leaks import EvalIndex, leaked_items


def errors_at_best(item, text, size):
    """Least errors with which some ``size`` words of the item align with the text, both end words there: plain dynamic programming."""
    best = 99
    for a in range(len(item) - size + 1):
        window = item[a : a + size]
        for j in range(len(text)):
            if text[j] != window[0]:
                continue
            row = {j + 1: 0}  # words of the text used: errors so far
            for word in window[1:-1]:
                step = {}
                for used, e in row.items():
                    step[used] = min(step.get(used, 99), e + 1)
                    if used < len(text):
                        step[used + 1] = min(step.get(used + 1, 99), e + (text[used] != word))
                for used in sorted(step):
                    if used < len(text):
                        step[used + 1] = min(step.get(used + 1, 99), step[used] + 1)
                row = step
            best = min([best, *(e for used, e in row.items() if used < len(text) and text[used] == window[-1])])
    return best


def test_against_plain_alignment():
    rng = random.Random(4)
    item = [rng.randrange(10, 60) for _ in range(60)]
    texts = []
    for _ in range(300):
        length = rng.randint(11, 26)
        start = rng.randint(0, 60 - length)
        piece = []
        for word in item[start : start + length]:
            kind = rng.random()
            if kind < 0.05:
                continue
            piece.append(word if kind > 0.12 else rng.randrange(100, 200))
        texts.append([rng.randrange(200, 300) for _ in range(rng.randint(0, 20))] + piece + [rng.randrange(200, 300) for _ in range(rng.randint(0, 20))])
    flat = np.array([w for t in texts for w in t], np.uint64)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    index = EvalIndex(np.array(item, np.uint64), np.array([0, 60], np.int64))
    got = set(index.matches(flat, offsets)[0].tolist())
    want = {i for i, t in enumerate(texts) if errors_at_best(item, t, 15) <= 1 or errors_at_best(item, t, 16) <= 2 or errors_at_best(item, t, 24) <= 3}
    assert got == want and 50 < len(want) < 280


WORDS = [f"слово{chr(0x430 + i)}{chr(0x430 + j)}" for i in range(12) for j in range(12)]


def test_frames(spark):
    item = " ".join(WORDS[:40]) + "."
    shared = "Укажите винодельню, сорт и сахар, а также год урожая и объём бутылки, и ещё крепость вина, и цвет, и регион."
    items = [(1, item + " " + shared), (2, shared + " " + " ".join(WORDS[50:90])), (3, None), (4, ""), (5, shared)]
    noisy = " ".join(w.upper().replace("О", "O") + "​," for w in WORDS[3:20]).replace(WORDS[9].upper().replace("О", "O"), "иное")
    docs = [(1, "начало <p>" + noisy + "</p> конец"), (2, shared), (3, " ".join(WORDS[5:18])), (4, None), (5, ""), (6, "x " * 50_000 + " ".join(WORDS[60:80])), (6, "x " * 50_000 + " ".join(WORDS[60:80]))]
    doc_type = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    item_type = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
    d, i = spark.createDataFrame(docs, doc_type), spark.createDataFrame(items, item_type)
    got = sorted(map(tuple, leaked_items(d, "doc_id", "text", i, "item_id", "text").collect()))
    assert got == [(1, 1), (6, 2), (6, 2)]
    assert leaked_items(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0
    assert leaked_items(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0


def test_blocks(spark, monkeypatch):
    import cellarflow.llm.leaks as leaks

    monkeypatch.setattr(leaks, "BLOCK_CHARS", 300)
    items = spark.createDataFrame([(k, " ".join(WORDS[k * 20 : k * 20 + 20])) for k in range(6)], "item_id long, text string")
    docs = spark.createDataFrame([(k, "а б " + " ".join(WORDS[k * 20 : k * 20 + 20])) for k in range(6)], "doc_id long, text string")
    assert sorted(map(tuple, leaked_items(docs, "doc_id", "text", items, "item_id", "text").collect())) == [(k, k) for k in range(6)]


def test_passage_quoted_by_two_of_many_items(spark, monkeypatch):
    import cellarflow.llm.leaks as module

    passage = " ".join(f"слово{i}" for i in range(40)) + "."
    items = [(i, f"{' '.join(f'own{i}x{k}' for k in range(20))}. {'Общее указание всем ' * 5}.") for i in range(300)]
    items[7], items[9] = (7, passage + " " + items[7][1]), (9, items[9][1] + " " + passage)
    docs = [(1, "до " + passage + " после"), (2, "Общее указание всем " * 30), (3, (" ".join(f"own5x{k}" for k in range(20)) + " ") * 200)]
    i, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    want = {(1, 7), (1, 9), (3, 5)}
    assert {tuple(r) for r in leaked_items(d, "doc_id", "text", i, "item_id", "text").collect()} == want
    monkeypatch.setattr(module, "MOST_HITS", 50)
    index = module.EvalIndex(np.arange(100, dtype=np.uint64), np.array([0, 60, 100]))
    words = np.concatenate([np.arange(30, dtype=np.uint64)] * 40)
    rows, passages = index.matches(words, np.array([0, 600, 1200]))
    assert list(zip(rows.tolist(), passages.tolist())) == [(0, 0), (1, 0)]
