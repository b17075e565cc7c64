"""The pipeline's stages after the quality rules, one after the other, against plain Python."""

import random
from collections import Counter

import corpus_pipeline


def test_stages_in_sequence(spark, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    rng = random.Random(5)
    text = lambda n: [f"v{rng.randrange(400)}" for _ in range(n)]
    passage, base = text(60), text(150)
    given = [base, text(80), [*base, "tail"], [*text(30), *passage, *text(20)], [*text(10), *passage, *text(40)], base, passage, text(5)]
    docs = spark.createDataFrame([(i, " ".join(w), len(" ".join(w))) for i, w in enumerate(given)], "doc_id long, text string, n_chars long")

    grams = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in given]
    alike = lambda i, j: 100 * len(grams[i] & grams[j]) >= 75 * len(grams[i] | grams[j])
    left = [i for i in range(len(given)) if not any(alike(i, j) for j in range(i))]
    seen, cleaned = {}, {}
    for i in left:
        w = given[i]
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), i)
        gone = {k + j for k in range(len(w) - 49) if seen[tuple(w[k : k + 50])] < i for j in range(50)}
        cleaned[i] = [x for k, x in enumerate(w) if k not in gone]
    assert left == [0, 1, 3, 4, 6, 7] and len(cleaned[4]) == 50 and cleaned[6] == []

    for k, stage in enumerate([corpus_pipeline.drop_near_duplicates, corpus_pipeline.remove_repeats]):
        docs = stage(spark, docs, "")
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows = {r.doc_id: r for r in docs.collect()}
        assert {i: r.text.split() for i, r in rows.items()} == ({i: given[i] for i in left} if k == 0 else cleaned)
        assert all(r.n_chars == len(r.text) for r in rows.values())

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    wanted = {i: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in rows.items()}
    got = Counter()
    for r in corpus_pipeline.pack(spark, docs, "").collect():
        got[r.doc_id] += r.length
    assert got == wanted
