import random

from pyspark.sql import types as T
from tokenizers import Tokenizer

from cellarflow.llm.bpe import DEFAULT_VOCABULARY, Encoder, RankBitmap, encode_corpus, read_vocabulary


def test_against_the_library():
    library = Tokenizer.from_file(DEFAULT_VOCABULARY)
    library.encode_special_tokens = True
    rng = random.Random(1)
    signs = list("ab  \n\t'sdSll12  \x1c\x85é<|endoftext|>ЖжΩ中文😀́​\r.,!—_")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    texts += ["a" * 5000, "ab" * 1000, "<|endoftext|>", " " * 1000, "0" * 501, "ha" * 999 + "a", "x\xa0 y", "у" * 100_000]
    encoder = Encoder(read_vocabulary())
    for part in (texts[:3000], texts[3000:], texts[:10]):
        ids, sizes = encoder.encode(part)
        got, at = [], 0
        for size in sizes:
            got.append(ids[at : at + size].tolist())
            at += size
        assert got == [x.ids for x in library.encode_batch(part, add_special_tokens=False)]


def test_bitmap():
    rng = random.Random(2)
    bitmap, held = RankBitmap(50_000), set()
    for _ in range(5000):
        if rng.random() < 0.6:
            rank = rng.randrange(50_000)
            bitmap.add(rank)
            held.add(rank)
        else:
            assert bitmap.pop() == (min(held) if held else -1)
            held.discard(min(held, default=-1))


def test_frames(spark):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("ids", T.StringType())])
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Вино wine"), (3, "Вино wine"), (4, " \n")], schema)
    got = sorted((r.id, r.ids) for r in encode_corpus(df, "id", "ids").collect())
    library = Tokenizer.from_file(DEFAULT_VOCABULARY)
    assert got == [(1, []), (2, []), *[(3, library.encode("Вино wine").ids)] * 2, (4, library.encode(" \n").ids)]
    assert encode_corpus(df.limit(0), "id", "ids").count() == 0
