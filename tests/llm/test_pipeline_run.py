"""The whole pipeline over a folder with planted junk, near copies and repeated passages, against plain Python."""

import random
import re

from pricelens.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_run(spark, tmp_path):
    import corpus_pipeline as C
    import public_tokenizers as P
    from tokenizers import Tokenizer

    rng = random.Random(9)
    text = lambda n, kind="good": " ".join(f"{kind}{rng.randrange(90)}" for _ in range(n))
    passage = text(70)
    base = text(300)
    texts = [text(120) for _ in range(12)] + [text(40) + " " + passage + " " + text(40) for _ in range(3)] + [base, base + " tail", base.replace(" ", "\n", 5)]
    texts += [text(120, "junk") for _ in range(12)] + ["short", None, "", "again and again " * 40]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 18)) for i in range(30)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))

    # Stage 1: base rules by hand; the log ratio parts the two kinds of words, which the test of quality holds against its definition.
    judged = quality.judged(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    stays = {r.doc_id for r in judged.where("quality.kept").collect()}
    assert stays == set(range(18))
    # Stage 2: the least of each group of documents that are alike in 75 of 100 shingles.
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i in stays for w in [WORD.findall(texts[i].lower())]}
    gone = {j for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert gone == {16, 17}
    # Stage 3: words under a window of 50 that starts in an earlier document too.
    seen, left = {}, {}
    for i in sorted(stays - gone):
        w = WORD.findall(texts[i])
        hit = {k + j for k in range(len(w) - 49) if seen.setdefault(tuple(w[k : k + 50]), i) < i for j in range(50)}
        left[i] = " ".join(x for k, x in enumerate(w) if k not in hit) if hit else texts[i]
    assert sum(left[i] != texts[i] for i in left) == 2
    # Stage 4: every id of what is left, and the end, once.
    coder = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    wanted = {i: len(coder.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
    got: dict[int, int] = {}
    pieces = C.run(spark, str(tmp_path)).collect()
    for r in pieces:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == wanted
    filled: dict[int, int] = {}
    for r in pieces:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= 2048 and sorted(filled) == list(range(len(filled)))
