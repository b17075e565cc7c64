"""The training-data operators against brute force, on a small table with nulls, empty texts, copies and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import SMALL

from pricelens.llm import bpe, fingerprint, minhash, packing, pitman_yor, quality, sharding, sstable, substring, urls
from pricelens.llm._spark import shared_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
words = lambda text: WORD.findall(text or "")


def made() -> list[tuple]:
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)] + ["Élan", "日本", "naïve", "x#y"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = text(60)
    texts = [None, "", "   \n\t ", "one", "One  two", text(49), text(50), text(400)]
    base = text(120)
    texts += [base, base, base.upper(), base + " tail", passage + " " + text(30), text(20) + "\n" + passage + "\n" + text(10), passage]
    texts += [text(rng.randrange(1, 200)) for _ in range(12)] + ["same line\nsame line\nother", text(5000)]
    return [(i, t, "extra") for i, t in enumerate(texts)]


ROWS = made()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, n_words string").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, n_words string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_substring_dedup(docs, none):
    seen, wanted = {}, {}
    for i, t, _ in ROWS:
        w = words(t)
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), i)
    for i, t, _ in ROWS:
        w = words(t)
        gone = {k + j for k in range(len(w) - 49) if seen[tuple(w[k : k + 50])] < i for j in range(50)}
        wanted[i] = (len(w), len(gone), [x for k, x in enumerate(w) if k not in gone])
    got = by_id(substring.dedup_substrings(docs, cell_bits=16))
    assert {i: (r.n_words, r.n_removed, words(r.text)) for i, r in got.items()} == wanted
    assert sum(x[1] for x in wanted.values()) > 200
    assert substring.dedup_substrings(none, cell_bits=16).count() == 0


def test_quality_counts(spark, docs, none):
    labels = spark.createDataFrame([(7, 1), (8, 1), (20, 0), (None, 1), (5, None)], "doc_id long, quality int")
    table = quality.log_ratios(docs, quality.trusted_ids(labels))
    got = by_id(quality.measured(docs, table))
    for i, t, _ in ROWS:
        w, q = words(t), got[i].quality
        places = defaultdict(list)
        for k in range(len(w) - 2):
            places[tuple(w[k : k + 3])].append(k)
        twice = {k + j for p in places.values() if len(p) > 1 for k in p for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (q.n_words, q.word_chars, q.n_repeat_words) == (len(w), sum(map(len, w)), len(twice))
        assert (q.n_symbols, q.n_dup_lines) == (len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)))
        assert q.base_failed == (len(w) < 50 or 100 * len(twice) > 50 * len(w))
        assert q.kept == (not q.base_failed and q.log_ratio >= quality.THRESHOLD)
    kept = quality.measured(docs, table).where("quality.kept").count()
    assert kept == sum(r.quality.kept for r in got.values())
    assert quality.measured(none, [0.0] * quality.CELLS).count() == 0


def test_near_duplicates(docs, none):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = {}
    for i, t, _ in ROWS:
        w = words(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    label = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    got = by_id(minhash.near_duplicates(docs))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}
    assert minhash.near_duplicates(none).count() == 0


def test_url_rules(spark):
    given = [None, "", "nothing", "http://a.net", "http://a.net/x", "http://EXAMPLE.net/en/1", "http://xexample.com/de/", "http://www.example.com/de/a?b#c", "http://a.org/fr/", "http://a.org/wp-login.php", "http://a.org/", "http://a.org/"]
    rows = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(rows, urls.rules_frame(spark)).collect()}
    wanted = [(None, "allow")] * 4 + [("net/", "block"), ("example.net/en/", "allow"), (None, "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "block"), (None, "allow"), (None, "allow")]
    assert [got[i] for i in range(len(given))] == wanted


def test_url_index_is_as_all_rules(spark):
    """Addresses made of the rules' words, with marks between or not, and odd ones, against all rules in their order."""
    rng = random.Random(3)
    parts = [*urls.TOPICS[:6], *urls.BEFORE[:4], "law", "history", "wp-login", "cgi-bin", "a.exe", "x", "123456789012", "xn--a", "日本", "Casino", "net", "org", "fr", "example.com", "de"]
    given = ["http://" + "".join(rng.choice(parts) + rng.choice([".", "/", "-", "_", "", "/"]) for _ in range(rng.randrange(1, 7))) for _ in range(500)]
    given += ["http://" + "/".join(["casino", *["y" * 50] * 2000, "top-poker"])]
    rows = spark.createDataFrame([(i, u, "kept", "gone") for i, u in enumerate(given)], "page_id long, url string, address string, host string")
    extra = [("block", "日本/", []), ("block", r"^q\.", [])]
    got = urls.filter_urls(rows, urls.rules_frame(spark, pattern_rules=[*urls.PATTERN_RULES, *extra]))
    assert got.columns == ["page_id", "url", "address", "host", "path", "rule", "verdict"]
    for r in got.collect():
        address, host = r.host + r.path, r.host
        fit = [(len(rule), rule, v) for v, rule in urls.HOST_RULES if f".{host}".endswith("." + rule.split("/", 1)[0]) and r.path.startswith("/" + rule.split("/", 1)[1])]
        wanted = max(fit)[2] if fit else next((v for v, p, _ in [*urls.PATTERN_RULES, *extra] if re.search(p, address)), "allow")
        assert (r.verdict, r.rule, r.address) == (wanted, max(fit)[1] if fit else None, "kept"), r.url
    assert len(urls.PATTERN_RULES) > 200 and urls.filter_urls(rows.limit(0), urls.rules_frame(spark)).count() == 0


def winnow(text):
    """Chosen runs of a text and their places, by the plain definition."""
    import xxhash

    code = [(h - (1 << 64) if h >> 63 else h) % fingerprint.MODULUS for h in (xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words(text))]
    runs = []
    for i in range(len(code) - fingerprint.GRAM + 1 if len(code) >= fingerprint.GRAM else min(len(code), 1)):
        h = 0
        for k in range(fingerprint.GRAM):
            h = (h * fingerprint.BASE + (code[i + k] if i + k < len(code) else 0)) % fingerprint.MODULUS
        runs.append(h)
    chosen = []
    for i in range(max(len(runs) - fingerprint.WINDOW + 1, min(len(runs), 1))):
        part = runs[i : i + fingerprint.WINDOW]
        at = max(k for k in range(len(part)) if part[k] == min(part)) + i
        if (runs[at], at) not in chosen:
            chosen.append((runs[at], at))
    return chosen


def test_winnowing(docs, none):
    got = by_id(fingerprint.fingerprints(docs))
    texts = [t or "" for _, t, _ in ROWS]
    for i, t in enumerate(texts):
        following, half = texts[(i + 1) % len(texts)], len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert bool(got[i].fingerprint) == bool(words(t))
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        chosen = [tuple(x.split(":")) for x in got[i].fingerprint.split()]
        own, other, after = winnow(t), winnow(changed), winnow(following)
        assert [(int(h, 16), int(p)) for h, p in chosen] == own
        assert [(int(h, 16), int(p)) for h, p in (x.split(":") for x in got[i].edited_fingerprint.split())] == other
        like = lambda a, b: len({h for h, _ in a} & {h for h, _ in b}) / len(u) if (u := {h for h, _ in a} | {h for h, _ in b}) else 1.0
        assert (got[i].near_edited, got[i].near_next) == (like(own, other), like(own, after))
        places = sorted(int(p) for _, p in chosen)
        runs = max(len(words(t)) - fingerprint.GRAM + 1, 0)
        if runs > fingerprint.WINDOW:  # each window holds a chosen run
            assert places[0] < fingerprint.WINDOW and places[-1] >= runs - fingerprint.WINDOW
            assert all(b - a <= fingerprint.WINDOW for a, b in zip(places, places[1:]))
    assert got[8].fingerprint == got[9].fingerprint and got[8].near_next == 1
    assert fingerprint.fingerprints(none).count() == 0


def test_language_model(docs, none):
    got = by_id(pitman_yor.score(docs))
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = {i: [*words(lower(t)), None] for i, t, _ in ROWS}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(x for i, w in tokens.items() if not held[i] for x in w)
    total, types = sum(counts.values()), len(counts)
    import math

    for i, w in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(counts[x] > 0 for x in w), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (total + types + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0
    assert pitman_yor.score(none).count() == 0


def test_byte_bpe(docs, none):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    enc = bpe.encoding(path, P.PATTERN)
    assert isinstance(enc, tiktoken.Encoding)
    got = by_id(bpe.encode(docs, path, P.PATTERN))
    for i, t, _ in ROWS:
        assert got[i].ids == enc.encode_ordinary(t or "") and bytes(got[i].decoded) == (t or "").encode()
    odd = "a  b   c\n\n d don't 12 345 é" * 50
    assert [x for s in bpe.segments(odd, 20) for x in enc.encode_ordinary(s)] == enc.encode_ordinary(odd)
    assert bpe.encode(none, path, P.PATTERN).count() == 0


@pytest.fixture(scope="module")
def ids():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return {i: t.encode(x or "", add_special_tokens=False).ids for i, x, _ in ROWS}


def test_shard_files(spark, docs, none, ids):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.json")
    shards = sstable.write_shards(docs, path, 2, shared_folder(spark, "t"), shard_docs=7)
    got, start = by_id(sstable.read_shards(shards)), 0
    for i in sorted(ids):
        assert got[i].ids == [*ids[i], 2] and got[i].start == start
        start += len(ids[i]) + 1
    assert [x.tolist() for x in sstable.find(shards, 7)] == [[*ids[7], 2]] and sstable.find(shards, 10_000) == []
    assert sstable.read_shards(sstable.write_shards(none, path, 2, shared_folder(spark, "t"))).count() == 0


def least_capacity(sizes, shards):
    """The smallest greatest load of contiguous shards, by trying every capacity that a run of groups has."""
    sums = [0]
    for x in sizes:
        sums.append(sums[-1] + x)

    def fits(capacity):
        left, n = 0, 1
        for x in sizes:
            if x > capacity:
                return False
            if left + x > capacity:
                left, n = 0, n + 1
            left += x
        return n <= shards

    return min(c for i in range(len(sums)) for j in range(i) if fits(c := sums[i] - sums[j]))


def test_minimax_ends():
    rng = random.Random(5)
    for units in (1, 2, 7, 1000):
        for _ in range(40):
            sizes = [rng.choice([1, 5, 16, rng.randrange(1, 3000)]) for _ in range(rng.randrange(1, 60))]
            shards, ends, calls = rng.randrange(1, 9), [], []
            for x in sizes:
                ends.append((ends[-1] if ends else 0) + x)

            def told(spans, grain, ends=ends, calls=calls):
                got = defaultdict(list)
                for e in ends:
                    if any(a < e <= b for a, b in spans):
                        got[(e - 1) // grain].append(e)
                calls.append(len(got))
                return sorted((min(v), max(v)) for v in got.values())

            cuts = sharding.minimax_ends(told, ends[-1], max(sizes), shards, units)
            assert set(cuts) <= set(ends) and cuts[-1] == ends[-1]
            assert max(b - a for a, b in zip([0, *cuts], cuts)) == least_capacity(sizes, shards)
            assert units < 1000 or max(calls) <= 2 * shards * units + 2 * shards + 2


def test_sharding(docs, none):
    rows = sharding.shard(docs, shards=5).collect()
    assert {r.doc_id: r.size for r in rows} == {i: len((t or "").encode()) + 16 for i, t, _ in ROWS}
    slots, home = defaultdict(list), {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        slots[r.shard].append(r.slot)
        assert home.setdefault(ROWS[r.doc_id][1], r.shard) == r.shard
    assert all(s == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    sizes = {}
    for i, t, _ in ROWS:
        sizes[t] = sizes.get(t, 0) + len((t or "").encode()) + 16
    loads = defaultdict(int)
    for r in rows:
        loads[r.shard] += r.size
    assert max(loads.values()) == least_capacity(list(sizes.values()), 5)
    assert max(fine := Counter(r.shard for r in sharding.shard(docs, shards=5, units=1).collect())) <= 4 and sum(fine.values()) == len(ROWS)
    again = defaultdict(int)
    for r in sharding.shard(docs, shards=5, units=1).collect():
        again[r.shard] += r.size
    assert again == loads
    assert sharding.shard(none).count() == 0


def test_packing(docs, none, ids):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.json")
    rows = packing.pack(packing.pieces(docs, path, 1)).collect()
    whole, filled = defaultdict(list), defaultdict(list)
    for r in rows:
        whole[r.doc_id].append((r.start, r.length, r.ids_crc32))
        filled[r.sequence_id].append((r.offset, r.length))
    for i, own in ids.items():
        own, at = [*own, 1], 0
        for start, length, crc in sorted(whole[i]):
            assert start == at and crc == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own[start : start + length]))
            at += length
        assert at == len(own)
    assert sorted(filled) == list(range(len(filled)))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert len(filled) <= -(-sum(len(x) + 1 for x in ids.values()) // packing.WINDOW) + 1
    assert packing.pack(packing.pieces(none, path, 1)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    given = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    kept = corpus_pipeline.keep_quality(spark, given, SMALL)
    assert kept.columns == given.columns and 0 < kept.count() < 60
