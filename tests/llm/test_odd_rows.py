"""All operators and stages over one table with null and repeated doc_ids, a very long text, empty texts, and extra columns with the names that the operators use themselves."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pricelens.llm import bpe, fingerprint, minhash, packing, pitman_yor, quality, sharding, sstable, substring
from pricelens.llm._spark import shared_folder

EXTRA = ["_row", "_runs", "_doc", "_key", "_others", "_place", "_w", "_u", "_h", "_k", "_p", "_lines", "_n", "_repeat", "_ratio", "_docs", "quality", "quality_0", "a.b", "node", "label", "n_removed", "_gone", "lot"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")
words = lambda text: WORD.findall(text or "")


def made():
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(2000)}" for _ in range(n))
    passage, base = text(60), text(150)
    rows = [(1, base), (1, text(80)), (2, base + " end"), (None, base), (None, passage), (3, passage + " " + text(30)), (4, text(25) + " " + passage), (4, text(25) + " " + passage), (5, None), (5, ""), (6, " \n "), (7, "one")]
    rows += [(8, "a  b" * 30_000), (9, text(20_000)), (9, None), (10, "x" * 70_000), (11, text(60) + "\n" + text(60))]
    return rows


ROWS = made()


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    return df.select("doc_id", "text", *(F.lit(f"kept {c}").alias(c) for c in EXTRA))


def kept(df, but=()):
    """The extra columns came through, those in but aside."""
    row = df.first()
    return all(row[c] == f"kept {c}" for c in EXTRA if c not in but)


def test_substring(docs):
    out = substring.dedup_substrings(docs)
    assert out.columns[:-2] == [c for c in docs.columns if c != "n_removed"] and kept(out, ["n_removed"])
    seen, wanted = {}, Counter()
    for i, t in sorted((r for r in ROWS if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), i)
    for i, t in ROWS:
        w = words(t)
        gone = {k + j for k in range(len(w) - 49) if i is not None and seen[tuple(w[k : k + 50])] < i for j in range(50)}
        wanted[(i, len(w), len(gone), tuple(x for k, x in enumerate(w) if k not in gone))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_removed, tuple(words(r.text))) for r in out.collect()) == wanted


def sets_of(rows):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    out = []
    for i, t in rows:
        w = words(lower(t))
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} - {()})))
    return out


def linked(rows):
    """component of each doc_id, by all pairs of rows."""
    sets, label = sets_of(rows), {}
    for i, _ in sets:
        label[i] = i
    links = [(i, j) for i, x in sets for j, y in sets if i is not None and j is not None and i < j and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    for _ in range(len(label)):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return label, sets


def test_near_duplicates(docs):
    label, sets = linked(ROWS)
    got = Counter(map(tuple, minhash.near_duplicates(docs).collect()))
    assert got == Counter((i, len(x), None if i is None else label[i], i is None or label[i] == i) for i, x in sets)
    out = minhash.first_of_groups(docs)
    assert out.columns == docs.columns and kept(out)
    assert Counter(r.doc_id for r in out.select("doc_id").collect()) == Counter(i for i, _ in ROWS if i is None or label[i] == i)


def test_groups_in_blocks(spark):
    """Large groups whose members are linked in part only, with blocks far smaller than the groups: no link of brute force is lost."""
    rng = random.Random(4)
    rows = []
    for g in range(3):
        base = [f"g{g}w{k}" for k in range(120)]
        for _ in range(45):
            w = list(base)
            for k in rng.sample(range(120), rng.choice([0, 1, 2, 3, 4, 5, 6, 8])):
                w[k] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    label, _ = linked(rows)
    for block in (1024, 6):
        assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, block=block).collect()} == label
    assert 3 < len(set(label.values())) < 100


def thue_morse(n):
    return "".join("ab"[k.bit_count() % 2] for k in range(n))


def test_words_that_collide_in_polynomials(spark):
    """Complementary words of 1024 to 4096 characters are different words."""
    swap = str.maketrans("ab", "ba")
    pairs = [(n, thue_morse(n), thue_morse(n).translate(swap)) for n in (1024, 2048, 4096)]
    rows = []
    for n, x, y in pairs:
        rows += [(n, " ".join([x] + [f"c{n}"] * 3 + [x] + [f"d{n}.{k}" for k in range(50)])), (n + 1, " ".join([y] + [f"c{n}"] * 3 + [y] + [f"e{n}.{k}" for k in range(50)])), (n + 2, " ".join([f"f{n}"] * 4 + [x])), (n + 3, " ".join([f"f{n}"] * 4 + [y]))]
        rows += [(n + 4, " ".join([x] * 60)), (n + 5, " ".join([y] * 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.component_id == r.doc_id for r in minhash.near_duplicates(df).collect())
    assert all(r.n_removed == 0 for r in substring.dedup_substrings(df).select("n_removed").collect())
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    known = {w for i, t in rows if i not in held for w in words(t)}
    assert {r.doc_id: r.n_known for r in pitman_yor.score(df).collect()} == {i: sum(w in known for w in words(t)) + 1 for i, t in rows}


def test_quality(docs):
    out = quality.measured(docs, [0.0] * quality.CELLS)
    assert out.columns == [c for c in docs.columns if c != "quality"] + ["quality"] and kept(out, ["quality"])
    assert Counter((r.doc_id, r.quality.n_words) for r in out.collect()) == Counter((i, len(words(t))) for i, t in ROWS)


def test_quality_log_ratio(spark):
    """The mean log ratio by its plain definition, cells by an independent hash of the same kind."""
    import math

    import xxhash

    rng = random.Random(2)
    good = lambda: " ".join(f"good{rng.randrange(40)}" for _ in range(80))
    junk = lambda: " ".join(f"junk{rng.randrange(40)}" for _ in range(80))
    rows = [(i, good() if i % 2 else junk()) for i in range(20)] + [(20, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 10, 2)] + [(0, 0)], "doc_id long, quality int")
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def cells(text):
        u = [signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in words(text)]
        pair = lambda a, b: xxhash.xxh64(b.to_bytes(8, "little", signed=True), seed=xxhash.xxh64(a.to_bytes(8, "little", signed=True), seed=42).intdigest()).intdigest()
        return [h & quality.CELLS - 1 for h in u] + [pair(a, b) & quality.CELLS - 1 for a, b in zip(u, u[1:])]

    raw, trusted = Counter(), Counter()
    for i, t in rows:
        raw.update(cells(t))
        if i in range(1, 10, 2):
            trusted.update(cells(t))
    share = lambda n, c: math.log((n[c] + quality.SMOOTHING * n.total() / quality.CELLS) / (n.total() * (1 + quality.SMOOTHING)))
    table = quality.log_ratios(df, quality.trusted_ids(labels))
    for r in quality.measured(df, table).collect():
        own = cells(dict(rows)[r.doc_id])
        wanted = sum(share(trusted, c) - share(raw, c) for c in own) / max(len(own), 1)
        assert math.isclose(r.quality.log_ratio, wanted, rel_tol=1e-6, abs_tol=1e-6)
        assert r.quality.kept == (r.quality.n_words >= 50 and r.quality.n_repeat_words * 100 <= 50 * r.quality.n_words and wanted >= quality.THRESHOLD)


def test_rest(spark, docs):
    import public_tokenizers as P

    sizes = Counter((i, len((t or "").encode()) + 16) for i, t in ROWS)
    out = sharding.shard(docs, shards=3).collect()
    assert Counter((r.doc_id, r.size) for r in out) == sizes
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    prints = fingerprint.fingerprints(docs).collect()
    assert Counter((r.doc_id, r.n_chars) for r in prints) == Counter((i, len(t or "")) for i, t in ROWS)
    scored = pitman_yor.score(docs).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in scored) == Counter((i, len(words(t)) + 1) for i, t in ROWS)
    path = P.path("byte_bpe_50k.tiktoken")
    enc = bpe.encoding(path, P.PATTERN)
    told = Counter((r.doc_id, tuple(r.ids)) for r in bpe.encode(docs, path, P.PATTERN).select("doc_id", "ids").collect())
    assert told == Counter((i, tuple(enc.encode_ordinary(t or ""))) for i, t in ROWS)
    json = P.path("byte_bpe_50k.json")
    pieces = packing.pack(packing.pieces(docs, json, 1)).collect()
    assert sum(r.length for r in pieces) == sum(len(ids) + 1 for (_, ids), n in told.items() for _ in range(n))
    read = sstable.read_shards(sstable.write_shards(docs, json, 2, shared_folder(spark, "odd"), shard_docs=5)).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in read) == Counter((i, (*ids, 2)) for (i, ids), n in told.items() for _ in range(n))


def test_stages(spark, docs, tmp_path):
    import corpus_pipeline as C

    spark.createDataFrame([(1, 1), (9, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (docs, docs.limit(0)):
        out = rows
        for name, stage in C.STAGES[:-1]:
            out = stage(spark, out, str(tmp_path))
            assert out.columns == docs.columns, name
        packed = C.STAGES[-1][1](spark, out, str(tmp_path))
        assert (packed.count() > 0) == (rows is docs)
