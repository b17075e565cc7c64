"""Scores of pairs where their sides meet: of each asking row, the best of the rows that share its key.

Rows of both sides go to parts by their key, keys of many rows block by block, so that a row moves once
for each block of the other side and pairs never move. Within a part pairs are numbers of rows; what of a pair
is cheap goes first, and names are compared only where they can still change what is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage

#: Rows of a side of one block, rows of a part, parts at most, and pairs that are looked at at once, about.
BLOCK, PART, MOST_PARTS, PAIRS = 8192, 4096, 2048, 1 << 18
#: Bytes of the letters' places in texts at once.
PLACES = 1 << 26
#: Sets of capacities, and cells of sheets by key, that are held against each other in a table.
SETS, CELLS = 2048, 1 << 24

OUT = "offre_id long, reference_id long, s_semantic double, rank long, relaxed boolean, bare boolean, m double, spec double, name double, n_common int, n_conflict int, n_hard int, score double"


@dataclass(frozen=True)
class Scale:
    """The weights of model, sheet, vectors and names, and what is taken off, as in matching."""

    weights: tuple[float, ...]
    same_model: float
    hard_same: tuple[float, float]
    hard_other: tuple[float, float]
    unlike: tuple[tuple[float, float], ...]
    capacity: tuple[float, float]

    def total(self, m, spec, sem, name, hard, both, apart):
        w = self.weights
        t = w[0] * m + w[1] * spec + w[2] * sem + w[3] * name
        off = np.where(m >= self.same_model, np.minimum(hard * self.hard_same[0], self.hard_same[1]), np.minimum(hard * self.hard_other[0], self.hard_other[1]))
        t = np.where(hard >= 1, np.maximum(0.0, t - off), t)
        (far, much), (wide, some) = self.unlike
        t = np.where(both & (m < wide), np.maximum(0.0, t - np.where(m < far, much, some)), t)
        return np.where(apart & (m >= self.capacity[0]), np.maximum(0.0, t - self.capacity[1]), t)


def rounded(x: np.ndarray) -> np.ndarray:
    """x to four places, halves of its decimal text up, as the engine rounds."""
    from decimal import ROUND_HALF_UP, Decimal

    y = x * 10000
    out = np.floor(np.abs(y) + 0.5)
    for n in np.flatnonzero(np.abs(np.abs(y) % 1 - 0.5) < 1e-6):
        out[n] = float(abs(Decimal(repr(float(x[n])))).scaleb(4).quantize(Decimal(1), ROUND_HALF_UP))
    return np.copysign(out, x) / 10000


class Texts:
    """Different texts, their letters as numbers, and the lengths of their longest common subsequences."""

    def __init__(self, texts: list[str]):
        at: dict[str, int] = {}
        self.number = np.array([at.setdefault(x, len(at)) for x in texts], np.int64)
        self.size = np.array([len(x) for x in at], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        known, flat = np.unique(np.frombuffer("".join(at).encode("utf-32-le"), np.uint32), return_inverse=True)
        self.letters, self.n_letters = flat.astype(np.int64), max(1, len(known))
        self.places = self.placed(np.arange(len(at))) if self.bytes(np.arange(len(at))) <= PLACES else None

    def bytes(self, texts: np.ndarray) -> int:
        return len(texts) * self.n_letters * 8 * (1 + int(self.size[texts].max(initial=0)) // 64)

    def placed(self, texts: np.ndarray) -> np.ndarray:
        """For each word of 64 places, text and letter: a bit for each place."""
        size, begin = self.size[texts], self.begin[texts]
        out = np.zeros((1 + int(size.max(initial=0)) // 64, len(texts) * self.n_letters), np.uint64)
        for p in range(int(size.max(initial=0))):
            held = np.flatnonzero(size > p)
            out[p // 64, held * self.n_letters + self.letters[begin[held] + p]] |= np.uint64(1 << p % 64)
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of numbers of texts the length of the longest common subsequence: all pairs go on by one letter of a at once."""
        if not len(a):
            return np.zeros(0, np.int64)
        places = self.places
        if places is None:
            own, b_at = np.unique(b, return_inverse=True)
            if self.bytes(own) > PLACES and len(a) > 1:
                half = len(a) // 2
                return np.concatenate((self.common(a[:half], b[:half]), self.common(a[half:], b[half:])))
            places = self.placed(own)
        else:
            b_at = b
        order = np.argsort(-self.size[a], kind="stable")  # the longest first: those that go on are a slice
        size, begin, row = self.size[a][order], self.begin[a][order], b_at[order] * self.n_letters
        state = np.full((len(places), len(a)), ~np.uint64(0))
        going = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
        for p, n in enumerate(going):
            at, carry = row[:n] + self.letters[begin[:n] + p], None
            for w in range(len(places)):
                now = state[w, :n]
                hit = now & places[w].take(at)
                total = now + hit
                over = total < now
                if carry is not None:
                    more = total + carry
                    over, total = over | (more < total), more
                carry = over.astype(np.uint64)
                state[w, :n] = total | (now & ~hit)
        out = np.empty(len(a), np.int64)
        out[order] = 64 * len(places) - np.bitwise_count(state).astype(np.int64).sum(axis=0)
        return out

    def ratio(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Twice the common length over both lengths; 1 for two empty texts."""
        both = self.size[a] + self.size[b]
        return np.where(both > 0, 2 * self.common(a, b) / np.maximum(both, 1), 1.0)


class Sets:
    """Lists of texts, equal ones as one number."""

    def __init__(self, lists: list[list[str]]):
        at: dict[tuple, int] = {}
        self.number = np.array([at.setdefault(tuple(x), len(at)) for x in lists], np.int64)
        self.of = list(at)
        self.size = np.array([len(x) for x in at], np.int64)


class Models(Sets):
    def __init__(self, lists: list[list[str]]):
        super().__init__(lists)
        self.texts = Texts([x for s in self.of for x in s])
        self.begin = np.cumsum(self.size) - self.size

    def ratio(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The greatest ratio of a text of one list and one of the other; 0 if one is empty."""
        out = np.zeros(len(a))
        for p in range(int(self.size[a].max(initial=0))):
            for q in range(int(self.size[b].max(initial=0))):
                on = np.flatnonzero((self.size[a] > p) & (self.size[b] > q))
                out[on] = np.maximum(out[on], self.texts.ratio(self.texts.number[self.begin[a[on]] + p], self.texts.number[self.begin[b[on]] + q]))
        return out


class Capacities(Sets):
    def __init__(self, lists: list[list[str]]):
        super().__init__(lists)
        self.sets = [set(x) for x in self.of]
        self.table = np.array([[self.unlike(x, y) for y in range(len(self.of))] for x in range(len(self.of))], bool) if len(self.of) ** 2 <= SETS else None

    def unlike(self, x: int, y: int) -> bool:
        return bool(self.sets[x]) and bool(self.sets[y]) and self.sets[x].isdisjoint(self.sets[y])

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether both tell capacities, and none in common."""
        if self.table is not None:
            return self.table[a, b]
        return np.fromiter((self.unlike(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)), bool, len(a))


class Sheets:
    """Maps by numbers of their keys and values."""

    def __init__(self, maps: pa.MapArray, hard: pa.ListArray):
        begin = maps.offsets.to_numpy()
        self.begin, self.size = begin[:-1].astype(np.int64), np.diff(begin).astype(np.int64)
        keys, values = maps.keys.dictionary_encode(), maps.items.dictionary_encode()
        self.n_keys = len(keys.dictionary)
        self.keys, self.values = keys.indices.to_numpy().astype(np.int64), values.indices.fill_null(-2).to_numpy().astype(np.int64)
        rows = np.repeat(np.arange(len(maps)), self.size)
        entries = np.arange(len(rows)) + np.repeat(self.begin - (np.cumsum(self.size) - self.size), self.size)
        self.hard = np.zeros(self.n_keys, bool)
        flags = hard.offsets.to_numpy()
        told = np.repeat(np.diff(flags) > 0, self.size)
        at = np.arange(int(np.diff(flags).sum())) + np.repeat(flags[:-1] - (np.cumsum(np.diff(flags)) - np.diff(flags)), np.diff(flags))
        self.hard[self.keys[entries[told]][hard.values.to_numpy(zero_copy_only=False)[at].astype(bool)]] = True
        cells = rows * self.n_keys + self.keys[entries]
        if len(maps) * self.n_keys <= CELLS:
            self.cells, self.table = None, np.full(len(maps) * self.n_keys, -1, np.int64)
            self.table[cells] = self.values[entries]
        else:
            order = np.argsort(cells)
            self.cells, self.table = cells[order], self.values[entries][order]

    def value(self, rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """-1 where a row has no such key, -2 for a null."""
        at = rows * self.n_keys + keys
        if self.cells is None:
            return self.table.take(at)
        n = np.minimum(np.searchsorted(self.cells, at), len(self.cells) - 1)
        return np.where(self.cells[n] == at, self.table[n], -1)

    def facts(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys that both have, those of unlike values, and those of these that are hard."""
        n, c, h = np.zeros(len(a), np.int32), np.zeros(len(a), np.int32), np.zeros(len(a), np.int32)
        size, begin = self.size[a], self.begin[a]
        for p in range(int(size.max(initial=0))):
            on = slice(None) if size.min() > p else np.flatnonzero(size > p)
            at = begin[on] + p
            key, own = self.keys.take(at), self.values.take(at)
            other = self.value(b[on], key)
            unlike = (other >= 0) & (own >= 0) & (other != own)
            n[on] += other != -1
            c[on] += unlike
            h[on] += unlike & self.hard.take(key)
        return n, c, h


def starts(i: np.ndarray) -> np.ndarray:
    """Where a new number begins in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.zeros(0, np.int64)


def spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of n numbers each, one after the other."""
    return np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)


def scores(table: pa.Table, keep: int, scale: Scale) -> pa.Table:
    """The keep best rows of the other side for each asking row, by score and rank."""
    column = lambda name: table[name].combine_chunks()
    asks, ids, rank, sem, least = (table[c].to_numpy() for c in ("asks", "id", "rank", "s_semantic", "least"))
    key = column("key").dictionary_encode().indices.to_numpy().astype(np.int64)
    names = Texts([" ".join(sorted((x or "").split())) for x in table["nom"].to_pylist()])
    models, caps, sheets = Models(table["models"].to_pylist()), Capacities(table["caps"].to_pylist()), Sheets(column("specs"), column("hard"))
    a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
    a, b = a[np.argsort(key[a], kind="stable")], b[np.lexsort((rank[b], key[b]))]
    # Rows of b, and their different lists of models, of each key.
    n_keys = int(key.max(initial=-1)) + 1
    rows = np.bincount(key[b], minlength=n_keys)
    b_begin = np.cumsum(rows) - rows
    lists, b_list = np.unique(key[b] * len(models.of) + models.number[b], return_inverse=True)
    l_rows = np.bincount(lists // len(models.of), minlength=n_keys)
    l_begin = np.cumsum(l_rows) - l_rows
    done = np.cumsum(rows[key[a]])
    out: list[tuple] = []
    at = 0
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, side="right")))
        mine = a[at:end]
        at = end
        n, n_lists = rows[key[mine]], l_rows[key[mine]]
        i, j = np.repeat(np.arange(len(mine)), n), spread(b_begin[key[mine]], n)
        m_lists = models.ratio(np.repeat(models.number[mine], n_lists), lists[spread(l_begin[key[mine]], n_lists)] % len(models.of))
        m = m_lists[np.repeat(np.cumsum(n_lists) - n_lists - l_begin[key[mine]], n) + b_list[j]]
        has = models.size[models.number] > 0
        both = has[mine][i] & has[b[j]]
        no, yes = np.zeros(len(i), bool), np.ones(len(i))
        # What a pair cannot exceed: first by models, then by sheets, with names as alike as their lengths let them be.
        can = scale.total(m, yes, sem[b[j]], yes, no, both, no) >= least[mine][i] - 1e-4
        i, j, m, both = i[can], j[can], m[can], both[can]
        if not len(i):
            continue
        x, y = mine[i], b[j]
        common, conflict, hard = sheets.facts(x, y)
        spec, apart = np.where(common > 0, (common - conflict) / np.maximum(common, 1), 0.0), np.zeros(len(i), bool)
        alike = np.flatnonzero(m >= scale.capacity[0])
        apart[alike] = caps.apart(caps.number[x[alike]], caps.number[y[alike]])
        size = names.size[names.number]
        most = np.where(size[x] + size[y] > 0, 2 * np.minimum(size[x], size[y]) / np.maximum(size[x] + size[y], 1), 1.0)
        low, high = (scale.total(m, spec, sem[y], name, hard, both, apart) for name in (np.zeros(len(i)), most))
        first = starts(i)
        which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(i))))
        for k in range(keep):
            bound = np.maximum.reduceat(low, first)
            if k + 1 < keep:
                low[np.minimum.reduceat(np.where(low == bound[which], np.arange(len(i)), len(i)), first)] = -np.inf
        can = high >= np.maximum(bound[which], least[x]) - 1e-4
        i, x, y, m, spec, common, conflict, hard, both, apart = (v[can] for v in (i, x, y, m, spec, common, conflict, hard, both, apart))
        name = names.ratio(names.number[x], names.number[y])
        score = rounded(scale.total(m, spec, sem[y], name, hard, both, apart))
        order = np.lexsort((rank[y], -score, i))
        first = starts(i[order])
        order = order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < keep]
        out.append(tuple(v[order] for v in (x, y, m, spec, name, common, conflict, hard, score)))
    x, y, m, spec, name, common, conflict, hard, score = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, t) for t in (int, int, float, float, float, "int32", "int32", "int32", float))
    relaxed, bare = (table[c].to_numpy() for c in ("relaxed", "bare"))
    told = {"offre_id": ids[x], "reference_id": ids[y], "s_semantic": sem[y], "rank": rank[y], "relaxed": relaxed[y], "bare": bare[x] | bare[y], "m": m, "spec": spec, "name": name, "n_common": common, "n_conflict": conflict, "n_hard": hard, "score": score}
    return pa.table(told)


def best(asking: DataFrame, others: DataFrame, keep: int, scale: Scale, block: int = BLOCK) -> DataFrame:
    """For each row of asking (id, key, nom, specs, models, caps, least) the keep best rows of others (id, key, nom, specs, models, caps, hard,
    s_semantic, rank, relaxed) with its key, as OUT tells. Where a key has more than block of others, keep of each block of these.

    hard: whether each key of the sheet is hard. A pair whose score is below least may be left out. Rows without a key have no pairs.
    """
    told = lambda df, name: df.where("key is not null").groupBy("key").agg(F.count("*").alias(name))
    sizes = storage.stored(told(asking, "n").join(told(others, "m"), "key", "full"), "sizes")
    many = sizes.where((F.col("n") > block) | (F.col("m") > block)).select("key", F.ceil(F.col("n") / block).cast("int").alias("nb"), F.ceil(F.col("m") / block).cast("int").alias("mb")).where("nb is not null and mb is not null")
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
    rows = sizes.agg(F.sum(n * F.greatest(F.lit(1), F.ceil(m / block)) + m * F.greatest(F.lit(1), F.ceil(n / block)))).head()[0]
    parts = 1 + (rows or 0) // PART

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        # At most a row for each block of rows.
        rows = df.join(F.broadcast(many.select("key", own, other)), "key", "left").withColumns({own: F.coalesce(own, F.lit(1)), other: F.coalesce(other, F.lit(1))})
        mine, theirs = F.pmod(F.xxhash64("id"), F.col(own)), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        rows = rows.where("key is not null").withColumn("_theirs", theirs).withColumn("_mine", mine)
        return rows.withColumn("key", F.concat_ws("\x00", "key", *(F.col(c).cast("string") for c in (("_mine", "_theirs") if own == "nb" else ("_theirs", "_mine")))))

    side = lambda df, asks, **other: df.select(F.lit(asks).alias("asks"), "id", "key", "nom", F.coalesce("specs", F.create_map().cast("map<string,string>")).alias("specs"), F.col("specs").isNull().alias("bare"), F.coalesce("models", F.array().cast("array<string>")).alias("models"), "caps", *(x.alias(c) for c, x in other.items()))
    q = side(dealt(asking, "nb", "mb"), True, least=F.col("least"), hard=F.array().cast("array<boolean>"), s_semantic=F.lit(0.0), rank=F.lit(0).cast("long"), relaxed=F.lit(False))
    r = side(dealt(others, "mb", "nb"), False, least=F.lit(0.0), hard=F.coalesce("hard", F.array().cast("array<boolean>")), s_semantic=F.col("s_semantic"), rank=F.col("rank").cast("long"), relaxed=F.col("relaxed"))
    rows = q.unionByName(r).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    return rows.repartition(int(min(parts, MOST_PARTS)), "part").groupBy("part").applyInArrow(lambda table: scores(table, keep, scale), OUT)
