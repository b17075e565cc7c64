"""Scores by a hierarchical Pitman-Yor language model.

The tree of restaurants:

    uniform over the words of the training texts and one unknown word
      one restaurant for all text            customers: tables of its children
        a restaurant for each context        customers: tokens after that context

A context is the token before, whatever its rank: every word of the training texts, and a text's end,
has a restaurant. Pairs are dealt by their context, those of a context that occurs more than HOT times
by their word as well; what a pair needs of its context and of its word is sent to it by key in each
sweep. Words are numbered in 32 bits.

Seating is sampled by Gibbs sweeps, with the tables of each dish of each restaurant as state. Given
the measure that the upper restaurant serves, G, and for each context x ~ Gamma(theta / d + its
tables), dishes are independent, and n customers of a dish sit at t tables with weight
S(n, t) (d x G(dish))^t, S being the generalised Stirling numbers: that sums over all ways to reseat
them one by one. G is drawn from the upper restaurant's seating, sampled alike. Predictive
probabilities are averaged over the sweeps after burn-in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, documents
from ._words import U64, Words, mix, slices

BURN_IN, SAMPLES = 2, 3
#: Discount and strength of the context restaurants and of the one above.
CONTEXT, ROOT = (0.6, 2.0), (0.5, 1.0)
#: Documents and bytes of a chunk, the unit in which words are looked up, at most (a longer text is one chunk).
CHUNK_DOCS, CHUNK_BYTES = 2048, 1 << 23
#: Bytes of text for each bucket of words and pairs. A chunk and a bucket send each other a message only
#: if they share words or pairs, so there are never more messages than distinct words and pairs of chunks.
BUCKET_BYTES = 1 << 24
END = U64(0x9AE16A3B2F90404F) & ~U64(255)
#: Customers of a dish up to which the number of tables is drawn from its exact chances.
EXACT = 1024
#: Occurrences of a context above which its pairs are dealt by word as well.
HOT = 20_000
#: Seatings of which one is drawn by weight, for more customers.
TRIES = 16


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens of a slice, each text's end included, and where each text's begin."""
    keys = words.hashes(lower=True)
    n = np.diff(words.bounds)
    return np.insert(keys, words.bounds[1:], END), np.append(0, np.cumsum(n + 1))


@lru_cache(4)
def stirling(d: float) -> np.ndarray:
    """Logarithms of S(n, t): S(n + 1, t) = S(n, t - 1) + (n - t d) S(n, t)."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0
    for n in range(1, EXACT):
        t = np.arange(1, n + 1)
        out[n + 1, 1 : n + 1] = out[n, 1 : n + 1] + np.log(n - t * d)
        out[n + 1, 1 : n + 2] = np.logaddexp(out[n + 1, 1 : n + 2], out[n, : n + 1])
    return out


def draw_tables(n: np.ndarray, log_a: np.ndarray, d: float, rng: np.random.Generator, exact: int = EXACT) -> np.ndarray:
    """Tables t of n customers of a dish, with weight S(n, t) exp(log_a t), for each n >= 1."""
    out = np.ones(len(n), np.int64)
    if not len(n):
        return out
    order = np.argsort(n, kind="stable")
    values, first = np.unique(n[order], return_index=True)
    for value, i, j in zip(values.tolist(), first, np.append(first[1:], len(n)), strict=True):
        if 2 <= value <= exact:
            t = np.arange(1, value + 1)
            weights = stirling(d)[value, 1 : value + 1]
            step = max(1, 500_000 // value)
            for k in range(i, j, step):
                at = order[k : min(k + step, j)]
                w = weights + log_a[at, None] * t
                w = np.cumsum(np.exp(w - w.max(1, keepdims=True)), axis=1)
                out[at] += (w < (rng.random(len(at)) * w[:, -1])[:, None]).sum(1)
        elif value > exact:
            for at in order[i:j]:
                out[at] = many(value, math.exp(log_a[at]), d, rng)
    return out


def many(n: int, a: float, d: float, rng: np.random.Generator) -> int:
    """Tables of n customers, by importance resampling of TRIES seatings.

    A seating opens its tables independently, with j seated at chance p(j), which follows the mean
    course of the seatings; it has the weight of its target over the chance of its draw.
    """
    j = np.unique(np.geomspace(1, n, 400).astype(np.int64)).astype(np.float64)
    width = np.diff(j)
    over = lambda f: np.append(0, np.cumsum((f[1:] + f[:-1]) / 2 * width))
    h, tau = (j / n) ** d, np.ones(len(j))
    for _ in range(8):
        p = a * h / (a * h + j - d * tau)
        tau = np.minimum((tau + 1 + over(p)) / 2, j)
        lost = over((1 - p) * np.log1p(-np.minimum(d / (j - d * tau), 0.95)))
        h = np.exp(lost[-1] - lost)
    logit = np.log(a * h / (j - d * tau))
    opened = [[] for _ in range(TRIES)]
    for start in range(1, n, 1 << 20):
        at = np.arange(start, min(start + (1 << 20), n))
        odds = np.interp(np.log(at), np.log(j), logit)
        p = 1 / (1 + np.exp(-odds))
        for each in opened:
            some = np.flatnonzero(rng.random(len(at)) < p)
            each.append(np.stack([at[some], odds[some]]))
    weights, tables = np.empty(TRIES), np.empty(TRIES, np.int64)
    for k, each in enumerate(opened):
        s, odds = np.concatenate(each, axis=1)
        t = np.arange(1, len(s) + 2)
        begin, end = np.append(1, s + 1), np.append(s, n)
        joined = sum(map(math.lgamma, (end - d * t).tolist())) - sum(map(math.lgamma, (begin - d * t).tolist()))
        weights[k], tables[k] = joined + len(t) * math.log(a) - odds.sum(), len(t)
    w = np.exp(weights - weights.max())
    return int(rng.choice(tables, p=w / w.sum()))


def unseated(size: int, time: float, d: float, rng: np.random.Generator) -> np.ndarray:
    """Draws of a tempered stable variable, of Laplace transform exp(-time ((1 + s)^d - 1)): a dish's share of what no table holds."""
    pieces = max(1, math.ceil(time))
    out = np.zeros(size)
    for _ in range(pieces):
        left = np.arange(size)
        while len(left):
            u, e = rng.random(len(left)) * np.pi, rng.exponential(size=len(left))
            x = np.sin(d * u) / np.sin(u) ** (1 / d) * (np.sin((1 - d) * u) / e) ** ((1 - d) / d) * (time / pieces) ** (1 / d)
            fits = rng.random(len(left)) < np.exp(-x)
            out[left[fits]] += x[fits]
            left = left[~fits]
    return out


def reseat_upper(customers: np.ndarray, held: np.ndarray, seen: np.ndarray, y: float, types: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word, its tables in the upper restaurant, its share of what that serves (up to the sum) and, as a context with held tables, its x."""
    (d, theta), (d0, _) = CONTEXT, ROOT
    tables, some = np.zeros(len(customers), np.int64), np.flatnonzero(customers)
    tables[some] = draw_tables(customers[some], np.full(len(some), math.log(d0 * y / (types + 1))), d0, rng)
    left = unseated(len(customers), y / (types + 1), d0, rng) * seen
    return tables, left + rng.gamma(customers - d0 * tables), rng.gamma(theta / d + held)


def reseat(n: np.ndarray, log_x: np.ndarray, log_measure: np.ndarray, total: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of pairs that occur n times, by their contexts' x and their words' shares of total."""
    d = CONTEXT[0]
    return draw_tables(n, math.log(d / total) + log_x + log_measure, d, rng)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Buckets that ascend with the keys."""
    return ((keys >> U64(32)).astype(np.float64) * (n / 2.0**32)).astype(np.int64)


def marked(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, held (1 if held out), text; and the number of buckets, by the size of all texts."""
    held = F.coalesce((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).cast("int"), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long"), held.alias("held"), F.col("text").cast("string"))
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    return rows, 1 + size // BUCKET_BYTES


#: Messages: what kind, to which bucket or chunk, from which, and arrays in an order that both know.
KIND = "kind int, to long, at long, a binary, b binary, c binary, d binary, x double, y double"
DOCS, KEYS, ENTITIES, KEY_AT, KEY_ID, COUNTED, PAIRS, PAIR_COUNTS, PAIR_AT, SEATED, SLOTS, VALUES, TABLES, REPORT, TOTALS, KEY_REPLY, PAIR_REPLY = range(17)


def packed(x: np.ndarray) -> bytes:
    """The array's bytes, those of equal place together, compressed."""
    raw = np.ascontiguousarray(x).reshape(-1).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpacked(data: pa.Buffer, kind: str) -> np.ndarray:
    size = int.from_bytes(data[:8].to_pybytes(), "little")
    if not size:
        return np.zeros(0, kind)
    raw = np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


class Mail:
    """Rows of KIND, gathered or read."""

    def __init__(self) -> None:
        self.rows = []

    def add(self, kind: int, to: int, at: int, *arrays: np.ndarray, x: float = 0.0, y: float = 0.0) -> None:
        self.rows.append([kind, int(to), int(at), *map(packed, arrays), *[None] * (4 - len(arrays)), float(x), float(y)])

    def table(self) -> pa.Table:
        names = ["kind", "to", "at", "a", "b", "c", "d", "x", "y"]
        types = [pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 4 + [pa.float64()] * 2
        columns = list(zip(*self.rows, strict=True)) or [[]] * 9
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    @staticmethod
    def read(table: pa.Table, kind: int, **types: str) -> list[tuple]:
        """(at, arrays) of the rows of a kind, by at."""
        kinds, at = table["kind"].to_numpy(), table["at"].to_numpy()
        some = np.flatnonzero(kinds == kind)
        some = some[np.argsort(at[some], kind="stable")]
        return [(int(at[i]), *(unpacked(table[c][int(i)].as_buffer(), t) for c, t in types.items())) for i in some]


def sent_by(deal, *frames: DataFrame) -> DataFrame:
    """Messages that deal() answers to those of each addressee."""
    return cut(reduce(DataFrame.unionByName, frames).groupBy("to").applyInArrow(deal, KIND))


def of_kind(mail: DataFrame, *kinds: int) -> DataFrame:
    return mail.where(F.col("kind").isin(*kinds))


def joined(parts: list[np.ndarray], kind: str) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch's rows, so many at a time as make a chunk."""
    size = np.cumsum(pc.binary_length(batch.column(2)).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK_BYTES, side="right"))
        end = min(max(end, at + 1), at + CHUNK_DOCS)
        yield batch.slice(at, end - at)
        at = end


def read_texts(rows: DataFrame, n_buckets: int) -> DataFrame:
    """Each chunk's documents, as places of tokens among its sorted keys, and its keys' counts in training texts, to their buckets.

    A chunk is a piece of a partition, and numbered by it, so texts stay where they are.
    """

    def own(batches):
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for some in chunks(batch):
                mail, parts, held = Mail(), [], some.column(1).to_numpy()
                for words in slices(some.column(2)):
                    keys, bounds = tokens(words)
                    parts.append((*np.unique(keys, return_inverse=True), np.diff(bounds)))
                keys, at = np.unique(np.concatenate([k for k, _, _ in parts]), return_inverse=True)
                starts = np.cumsum([0, *(len(k) for k, _, _ in parts)])
                place = np.concatenate([at[b : b + len(k)][i] for (k, i, _), b in zip(parts, starts[:-1], strict=True)])
                sizes, ids = np.concatenate([n for _, _, n in parts]), some.column(0)
                flags = held + 2 * ids.is_null().to_numpy(zero_copy_only=False)
                mail.add(DOCS, chunk, chunk, place.astype("<u4"), sizes.astype("<u4"), ids.fill_null(0).to_numpy(), flags.astype("u1"))
                n = np.bincount(place, np.repeat(held == 0, sizes), len(keys)).astype("<i8")
                ends = np.searchsorted(bucket_of(keys, n_buckets), np.arange(n_buckets + 1))
                for b in np.flatnonzero(np.diff(ends)):
                    mail.add(KEYS, b, chunk, keys[ends[b] : ends[b + 1]], n[ends[b] : ends[b + 1]])
                yield from mail.table().to_batches()
                chunk += 1

    return cut(rows.mapInArrow(own, KIND))


def vocabulary(mail: DataFrame) -> DataFrame:
    """Each bucket's counts of its sorted keys, and the places there of each chunk's keys."""

    def merge(table: pa.Table) -> pa.Table:
        out, bucket, got = Mail(), table["to"][0].as_py(), Mail.read(table, KEYS, a="<u8", b="<i8")
        keys, at = np.unique(np.concatenate([k for _, k, _ in got]), return_inverse=True)
        n = np.bincount(at, np.concatenate([x for _, _, x in got]), len(keys)).astype(np.int64)
        out.add(ENTITIES, bucket, len(keys), n, x=n.sum(), y=(n > 0).sum())
        ends = np.cumsum([0, *(len(k) for _, k, _ in got)])
        for (chunk, _, _), i, j in zip(got, ends[:-1], ends[1:], strict=True):
            out.add(KEY_AT, bucket, chunk, at[i:j].astype("<u4"))
            out.add(KEY_ID, chunk, bucket, at[i:j].astype("<u4"), (n[at[i:j]] > HOT).astype("u1"))
        return out.table()

    return sent_by(merge, of_kind(mail, KEYS))


def chunk_pairs(sent: pa.Table, base: np.ndarray) -> tuple:
    """A chunk's documents, each token's place among the keys, that of the token before, and its place among the chunk's pairs; the
    pairs, as numbers of context and word, in the order of their buckets; the buckets' ends."""
    ((_, place, sizes, ids, flags),) = Mail.read(sent, DOCS, a="<u4", b="<u4", c="<i8", d="u1")
    got, n_buckets = Mail.read(sent, KEY_ID, a="<u4", b="u1"), len(base)
    number = np.concatenate([base[b] + at.astype(U64) for b, at, _ in got])
    hot = np.concatenate([h for _, _, h in got]).astype(U64)
    bounds = np.append(0, np.cumsum(sizes, dtype=np.int64))
    before = np.roll(place, 1)
    before[bounds[:-1]] = place[bounds[1] - 1]  # that of the end
    pairs, at = np.unique((number[before] << U64(32)) | number[place], return_inverse=True)
    first = np.zeros(len(pairs), np.int64)
    first[at] = before
    context, word = pairs >> U64(32), pairs & U64(0xFFFFFFFF)
    bucket = bucket_of(mix(context + U64(1) + hot[first] * mix(word + U64(1))), n_buckets)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return (sizes, ids, flags, bounds), place, before, rank[at], pairs[order], np.searchsorted(bucket[order], np.arange(n_buckets + 1))


def counted_pairs(mail: DataFrame, known: DataFrame, base: np.ndarray) -> DataFrame:
    """Counts of pairs of context and word over the training texts, by bucket; where each chunk's are; first tables."""

    def own(table: pa.Table) -> pa.Table:
        out, chunk = Mail(), table["to"][0].as_py()
        (sizes, _, flags, _), _, _, at, pairs, ends = chunk_pairs(table, base)
        n = np.bincount(at, np.repeat(flags & 1 == 0, sizes), len(pairs)).astype("<i8")
        for b in np.flatnonzero(np.diff(ends)):
            i = slice(ends[b], ends[b + 1])
            out.add(COUNTED, b, chunk, np.diff(pairs[i] >> U64(32), prepend=U64(0)).astype("<u4"), (pairs[i] & U64(0xFFFFFFFF)).astype("<u4"), n[i])
        return out.table()

    def merge(table: pa.Table) -> pa.Table:
        out, bucket = Mail(), table["to"][0].as_py()
        got = [(c, (np.cumsum(a.astype(U64)) << U64(32)) | b, n) for c, a, b, n in Mail.read(table, COUNTED, a="<u4", b="<u4", c="<i8")]
        pairs, at = np.unique(np.concatenate([p for _, p, _ in got]), return_inverse=True)
        n = np.bincount(at, np.concatenate([x for _, _, x in got]), len(pairs)).astype(np.int64)
        ends = np.cumsum([0, *(len(p) for _, p, _ in got)])
        for (chunk, _, _), i, j in zip(got, ends[:-1], ends[1:], strict=True):
            out.add(PAIR_AT, bucket, chunk, np.diff(at[i:j], prepend=0).astype("<u4"))
        out.add(PAIR_COUNTS, bucket, bucket, n.astype("<i8"))
        some = np.flatnonzero(n)
        keys, at = np.unique(np.append(pairs[some] >> U64(32), pairs[some] & U64(0xFFFFFFFF)), return_inverse=True)
        c, w = at[: len(some)], at[len(some) :]
        several = n[some] > 1
        sums = [np.bincount(k, v.astype(float), len(keys)) for v in (~several, several) for k in (w, c)]
        again = np.cumsum(sums[2] + sums[3] > 0) - 1  # places among the keys of pairs that are seated anew
        out.add(PAIRS, bucket, bucket, again[c[several]].astype("<u4"), again[w[several]].astype("<u4"), n[some][several])
        ends = np.append(np.searchsorted(keys, base), len(keys))
        for b in np.flatnonzero(np.diff(ends)):
            i = slice(ends[b], ends[b + 1])
            out.add(SEATED, b, bucket, (keys[i] - base[b]).astype("<u4"), np.stack([s[i] for s in sums]).astype("<i8"))
        return out.table()

    sent = of_kind(mail, DOCS).unionByName(of_kind(known, KEY_ID)).groupBy("to").applyInArrow(own, KIND)
    return sent_by(merge, sent)


def registered(known: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each bucket's keys: counts, tables of pairs that occur once; first tables of the others, and where a bucket of pairs has its keys."""

    def work(table: pa.Table) -> pa.Table:
        out, bucket = Mail(), table["to"][0].as_py()
        ((_, n),) = Mail.read(table, ENTITIES, a="<i8")
        fixed = np.zeros((2, len(n)), np.int64)
        for pairs, at, sums in Mail.read(table, SEATED, a="<u4", b="<i8"):
            sums = sums.reshape(4, -1)
            fixed[:, at] += sums[:2]
            some = (sums[2] + sums[3]) > 0
            if some.any():
                out.add(SLOTS, bucket, pairs, at[some].astype("<u4"))
                out.add(REPORT, bucket, pairs, sums[2:, some].astype("<i8"))
        out.add(ENTITIES, bucket, bucket, n, fixed)
        return out.table()

    return sent_by(work, of_kind(known, ENTITIES), of_kind(pairs, SEATED))


def swept(sweep: int, entities: DataFrame, reports: DataFrame, y: float, types: int) -> DataFrame:
    """The upper restaurant seated anew by the tables of its children, and the values that pairs need: its measure (up to the sum, in x) and each context's x."""

    def work(table: pa.Table) -> pa.Table:
        out = Mail()
        ((bucket, n, fixed),) = Mail.read(table, ENTITIES, a="<i8", b="<i8")
        rng = np.random.default_rng((1, sweep, bucket))
        slots = dict(Mail.read(table, SLOTS, a="<u4"))
        seats = fixed.reshape(2, -1).copy()
        for pairs, sums in Mail.read(table, REPORT, a="<i8"):
            seats[:, slots[pairs]] += sums.reshape(2, -1)
        customers, held = seats
        tables, measure, x = reseat_upper(customers, held, n > 0, y, types, rng)
        out.add(TABLES, bucket, sweep, customers.astype("<i8"), tables.astype("<i8"), held.astype("<i8"), x=measure.sum(), y=tables.sum())
        out.add(TOTALS, bucket, sweep, x=customers.sum())
        for pairs, at in slots.items():
            out.add(VALUES, pairs, bucket, np.log(np.maximum(measure[at], 1e-300)).astype("<f4"), np.log(x[at]).astype("<f4"))
        return out.table()

    return sent_by(work, of_kind(entities, ENTITIES, SLOTS), reports)


def seated(sweep: int, pairs: DataFrame, values: DataFrame, total: float) -> DataFrame:
    """Pairs that occur more than once, seated anew: TABLES of each, and a REPORT to each bucket of keys."""

    def work(table: pa.Table) -> pa.Table:
        out = Mail()
        ((bucket, context, key, n),) = Mail.read(table, PAIRS, a="<u4", b="<u4", c="<i8")
        got = Mail.read(table, VALUES, a="<f4", b="<f4")
        measure, x = (joined([v[k] for v in got], "<f4").astype(np.float64) for k in (1, 2))
        t = reseat(n, x[context], measure[key], total, np.random.default_rng((2, sweep, bucket)))
        out.add(TABLES, bucket, sweep, t.astype("<i8"))
        sums = np.stack([np.bincount(key, t, len(x)), np.bincount(context, t, len(x))]).astype("<i8")
        ends = np.cumsum([0, *(len(v[1]) for v in got)])
        for v, i, j in zip(got, ends[:-1], ends[1:], strict=True):
            out.add(REPORT, v[0], bucket, sums[:, i:j])
        return out.table()

    return sent_by(work, of_kind(pairs, PAIRS), values)


def score(docs: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    A null or empty text has one token, its end. A null doc_id counts as training text. Repeated rows
    are all counted and scored. Without training texts every word is unknown. Other columns of docs
    are not read. base_score and score are log10 probabilities of the text.
    """
    rows, n_buckets = marked(docs)
    mail = read_texts(rows, n_buckets)
    known = vocabulary(mail)
    sizes, train_tokens, types = np.zeros(n_buckets, np.int64), 0, 0
    for r in of_kind(known, ENTITIES).select("to", "at", "x", "y").collect():  # a row for each bucket
        sizes[r["to"]], train_tokens, types = r["at"], train_tokens + int(r["x"]), types + int(r["y"])
    base = np.append(0, np.cumsum(sizes)[:-1]).astype(U64)
    pairs = counted_pairs(mail, known, base)
    (d, theta), (d0, theta0) = CONTEXT, ROOT
    entities = registered(known, pairs)
    reports, kept, below, tops = of_kind(entities, REPORT), [], [], []  # tops: tables and customers of the upper restaurant
    rng, top = np.random.default_rng(0), types  # tables of the upper restaurant
    for sweep in range(burn_in + samples + 1):
        y = rng.gamma(theta0 / d0 + top)
        above = swept(sweep, entities, reports, y, types)
        got = {r[0]: r[1:] for r in of_kind(above, TABLES, TOTALS).groupBy("kind").agg(F.sum("x"), F.sum("y")).collect()}
        measure, top = got.get(TABLES, (0, 0))
        total = measure + unseated(1, y / (types + 1), d0, rng)[0]  # the unknown word's share with it
        if sweep > burn_in:
            kept.append(of_kind(above, TABLES))
            tops.append((top, got.get(TOTALS, (0, 0))[0]))
        if sweep < burn_in + samples:
            drawn = seated(sweep, pairs, of_kind(above, VALUES), total)
            reports = of_kind(drawn, REPORT)
            if sweep >= burn_in:
                below.append(of_kind(drawn, TABLES))

    def key_reply(table: pa.Table) -> pa.Table:
        """Count, probabilities in the upper restaurant and tables as a context, for each chunk's keys."""
        out = Mail()
        ((_, n),) = Mail.read(table, ENTITIES, a="<i8")
        above = Mail.read(table, TABLES, a="<i8", b="<i8", c="<i8")
        less = np.array([c - d0 * t for _, c, t, _ in above])
        held = np.array([h for _, _, _, h in above], "<f4")
        for chunk, at in Mail.read(table, KEY_AT, a="<u4"):
            out.add(KEY_REPLY, chunk, table["to"][0].as_py(), n[at].astype("<i8"), less[:, at].astype("<f4"), held[:, at])
        return out.table()

    def pair_reply(table: pa.Table) -> pa.Table:
        """Customers less discounts, for each chunk's pairs."""
        out = Mail()
        ((bucket, n),) = Mail.read(table, PAIR_COUNTS, a="<i8")
        t = (n > 0).astype(np.float64)
        t[n > 1] = np.mean([x for _, x in Mail.read(table, TABLES, a="<i8")], axis=0)
        rest = (n - d * t).astype("<f4")
        for chunk, at in Mail.read(table, PAIR_AT, a="<u4"):
            out.add(PAIR_REPLY, chunk, bucket, rest[np.cumsum(at)])
        return out.table()

    union = lambda *frames: reduce(DataFrame.unionByName, frames)
    to_keys = union(of_kind(known, ENTITIES, KEY_AT), *kept).groupBy("to").applyInArrow(key_reply, KIND)
    to_pairs = union(of_kind(pairs, PAIR_COUNTS, PAIR_AT), *below).groupBy("to").applyInArrow(pair_reply, KIND)

    def work(sent: pa.Table) -> pa.Table:
        """Scores of a chunk's documents by what was sent for its words and pairs."""
        (sizes, ids, flags, bounds), place, before, at, _, _ = chunk_pairs(sent, base)
        got = Mail.read(sent, KEY_REPLY, a="<i8", b="<f4", c="<f4")
        counts = np.concatenate([x[1] for x in got]).astype(np.float64)
        upper = np.concatenate([x[2].reshape(samples, -1) for x in got], axis=1).astype(np.float64)
        held = np.concatenate([x[3].reshape(samples, -1) for x in got], axis=1).astype(np.float64)
        for k, (tables, customers) in enumerate(tops):
            upper[k] = (upper[k] + (theta0 + d0 * tables) / (types + 1)) / (theta0 + customers)
        rest = np.concatenate([x[1] for x in Mail.read(sent, PAIR_REPLY, a="<f4")]).astype(np.float64)
        each = sum((theta + d * held[k][before]) * upper[k][place] for k in range(samples)) / samples
        p = np.log10((rest[at] + each) / (theta + counts[before]))
        base_p = np.log10((counts + 1) / (train_tokens + types + 1))
        sums = [np.add.reduceat(x, bounds[:-1]) for x in (base_p[place], p, counts[place] > 0)]
        return pa.table({"doc_id": pa.array(ids, mask=flags & 2 > 0), "held_out": pa.array(flags & 1 > 0), "n_tokens": sizes.astype(np.int64), "n_known": sums[2].astype(np.int64), "train_tokens": np.full(len(sizes), train_tokens), "base_score": sums[0], "score": sums[1]})

    everything = union(of_kind(mail, DOCS), of_kind(known, KEY_ID), to_keys, to_pairs)
    return everything.groupBy("to").applyInArrow(work, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, n_tokens and perplexity of the training and the held-out texts of score()'s rows: 10 to the mean -log10 probability of a token."""
    mean = -F.sum("score") / F.sum("n_tokens")
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), F.pow(F.lit(10.0), mean).alias("perplexity"))


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
