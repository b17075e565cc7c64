"""Substring dedup: words covered by a window of 50 that an earlier document has too.

Windows are counted first, approximately, then those that may repeat are grouped exactly.

*Anchors.* The anchor of a window is the run of ANCHOR words in it with the least hash, of equals
the leftmost; equal windows have equal anchors at equal places. Neighbouring windows mostly share
theirs, so a document is a row of *stretches*: windows one after the other with the same anchor.

*First pass.* Each partition counts the anchors of its stretches, with map-side sums, into the cells
of a count-min sketch; the partitions' sketches are added up. A cell counts at least every
occurrence of each window whose anchor falls into it, so the sketch overestimates, and a window
whose cells are under 2 is in no other document. It has a cell in each row for CELL_BYTES bytes of
text, up to 2**CELL_BITS: beyond that size it lets more through, and loses none.

*Second pass.* Stretches whose anchor is estimated to repeat are grouped as wholes, a light row each:
by the anchor and an unrelated hash of all their words. All but the first document of such a class
lose all of it. Only where the classes of one anchor differ are windows grouped one by one, of each
class those of its first document, in a third reading. Minima are taken before the shuffle, so a
passage that a third of all documents share is no hot key.

Word hashes of the two keys are unrelated 64-bit ones: what is equal in both is taken as equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import IdFilter, apart, bits_of, documents, marked, quoted, stored
from ._spark import words as words_of
from ._words import GRAM_BASE, OTHER_BASE, U64, Words, mix, prefix, run_hash, slices

WINDOW, ANCHOR = 50, 8
#: Rows of the sketch; bytes of text for each cell of a row; binary logarithm of a row's cells, at most (32 MB of marks).
DEPTH, CELL_BYTES, CELL_BITS = 2, 32, 28
#: Seeds of the word hashes.
ONE, TWO = 0, 1


def cells(anchor: np.ndarray, row: int, cell_bits: int) -> np.ndarray:
    """The cells of anchors in one row of the sketch."""
    return (mix(anchor ^ U64(0x9E3779B97F4A7C15 * (row + 1) & (1 << 64) - 1)) >> U64(64 - cell_bits)).astype(np.int64) + (row << cell_bits)


def stretches(words: Words, window: int = WINDOW, gram: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """For each stretch: text, first window (a word of the slice), windows, anchor."""
    n = len(words.start)
    empty = np.zeros(0, np.int64)
    if n < window:
        return empty, empty, empty, np.zeros(0, U64)
    at = np.arange(n - gram + 1)
    anchors = run_hash(prefix(words.hashes(seed=ONE), GRAM_BASE), GRAM_BASE, at, at + gram)
    least, where, span, want = anchors, at, 1, window - gram + 1
    while span < want:
        step = min(span, want - span)
        right = least[step:] < least[:-step]  # else the left one, of equals too
        least, where = np.where(right, least[step:], least[:-step]), np.where(right, where[step:], where[:-step])
        span += step
    count = np.maximum(np.diff(words.bounds) - window + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    ends = np.cumsum(count)
    first = np.arange(len(text)) + np.repeat(words.bounds[:-1] - (ends - count), count)
    place = where[first]
    new = np.ones(len(text), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    return text[begin], first[begin], np.diff(np.append(begin, len(text))), anchors[place[begin]]


def named(doc: np.ndarray, row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A name of each stretch, by document, text and first word."""
    return mix(mix(doc.view(U64) ^ mix(row.view(U64))) + start.view(U64))


def sized(texts: DataFrame, most: int = CELL_BITS) -> int:
    """Binary logarithm of the cells of a row, by the bytes of all texts."""
    total = texts.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    return min(most, max(16, (total // CELL_BYTES).bit_length()))


def sketch(texts: DataFrame, window: int, depth: int, cell_bits: int) -> np.ndarray:
    """A bit for each cell whose count is 2 or more. depth * 2**cell_bits / 8 bytes."""

    def work(batches):
        for batch in batches:
            for words in slices(batch.column(0)):
                anchor = stretches(words, window)[3]
                for row in range(depth):
                    cell, n = np.unique(cells(anchor, row, cell_bits), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(n.astype(np.int64))], ["cell", "n"])

    counted = texts.mapInArrow(work, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1")
    return bits_of(counted.select("cell"), depth << cell_bits)


def candidates(rows: DataFrame, marks: np.ndarray, window: int, depth: int, cell_bits: int) -> DataFrame:
    """The stretches whose anchor may repeat: doc_id, _row, start, n, anchor, b (a hash of all their words), name."""
    shared = rows.sparkSession.sparkContext.broadcast(marks)

    def work(batches):
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for words in slices(batch.column(2)):
                text, first, n, anchor = stretches(words, window)
                keep = np.ones(len(anchor), bool)
                for row in range(depth):
                    keep &= marked(shared.value, cells(anchor, row, cell_bits))
                text, first, n, anchor = text[keep], first[keep], n[keep], anchor[keep]
                if len(text):
                    b = run_hash(prefix(words.hashes(seed=TWO), OTHER_BASE), OTHER_BASE, first, first + n + window - 1)
                    doc, row, start = ids[words.first + text], keys[words.first + text], first - words.bounds[text]
                    cols = [doc, row, start, n, anchor.view(np.int64), b.view(np.int64), named(doc, row, start).view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "_row", "start", "n", "anchor", "b", "name"])

    return rows.mapInArrow(work, "doc_id long, _row long, start long, n long, anchor long, b long, name long")


def windows(rows: DataFrame, names: DataFrame, window: int, name_bits: int = 26) -> DataFrame:
    """doc_id, _row, start, anchor, hash of each window of the stretches in names: doc_id, name (a few others may come along)."""
    at = F.shiftrightunsigned("name", 64 - name_bits).alias("cell")
    shared = rows.sparkSession.sparkContext.broadcast(bits_of(names.select(at), 1 << name_bits))
    docs = IdFilter(names.select("doc_id"))
    told = docs.shared

    def work(batches):
        for batch in batches:
            batch = batch.filter(pa.array(marked(told.value, batch.column(3).to_numpy())))
            ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for words in slices(batch.column(2)):
                text, first, n, anchor = stretches(words, window)
                doc, row = ids[words.first + text], keys[words.first + text]
                keep = marked(shared.value, (named(doc, row, first - words.bounds[text]) >> U64(64 - name_bits)).astype(np.int64))
                text, first, n, anchor, doc, row = text[keep], first[keep], n[keep], anchor[keep], doc[keep], row[keep]
                if len(text):
                    ends = np.cumsum(n)
                    begin = np.arange(ends[-1]) + np.repeat(first - (ends - n), n)
                    each = run_hash(prefix(words.hashes(seed=TWO), OTHER_BASE), OTHER_BASE, begin, begin + window)
                    cols = [np.repeat(doc, n), np.repeat(row, n), begin - np.repeat(words.bounds[text], n), np.repeat(anchor, n).view(np.int64), each.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "_row", "start", "anchor", "hash"])

    placed = rows.select("doc_id", "_row", "text", docs.place(F.col("doc_id")))
    return placed.mapInArrow(work, "doc_id long, _row long, start long, anchor long, hash long")


def covered(rows: DataFrame, window: int = WINDOW, depth: int = DEPTH, cell_bits: int | None = None) -> DataFrame:
    """doc_id, _row, start, stop: runs of words covered by windows that start in an earlier document. They may overlap.

    rows: doc_id, _row (a number of the text) and text.
    """
    cell_bits = cell_bits or sized(rows)
    found = stored(candidates(rows, sketch(rows.select("text"), window, depth, cell_bits), window, depth, cell_bits), "stretches")
    first = found.groupBy("anchor", "b").agg(F.min("doc_id").alias("least"))
    whole = stored(found.join(apart(first, "anchor", "b"), ["anchor", "b"]).select("doc_id", "_row", "start", "n", "anchor", "name", (F.col("least") < F.col("doc_id")).alias("later")), "classes")
    runs = whole.where("later").select("doc_id", "_row", "start", (F.col("start") + F.col("n") + window - 1).alias("stop"))
    # What is left of each class is its first document's; anchors with one document are done.
    own = whole.where("not later")
    several = own.groupBy("anchor").agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high")).where("_low < _high").select("anchor")
    names = stored(own.join(apart(several, "anchor"), "anchor").select("doc_id", "name"), "names")
    each = stored(windows(rows, names, window), "windows")
    least = each.groupBy("anchor", "hash").agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high")).where("_low < _high").select("anchor", "hash", "_low")
    single = each.join(apart(least, "anchor", "hash"), ["anchor", "hash"]).where("_low < doc_id").select("doc_id", "_row", "start", (F.col("start") + window).alias("stop"))
    return runs.unionByName(single)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, depth: int = DEPTH, cell_bits: int | None = None) -> DataFrame:
    """docs with text replaced by the words that are kept, joined by one space, and the columns n_words and
    n_removed (columns of those names are replaced). A text of which nothing is removed stays as it is.

    A word is removed if a window of ``window`` words that covers it also starts in a document with a
    smaller doc_id; windows are judged on the input. Null and empty texts have no words and stay as
    they are, as do rows with a null doc_id, whose windows count for no other document either. Rows
    of the same doc_id are one document: none is earlier than the other. Texts of any length are taken
    whole. All other columns stay, whatever their names. An empty table gives an empty one. Only texts
    that lose words move.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_words", "n_removed")]
    packed = F.struct(*(F.col(quoted(c)) for c in others)) if others else F.lit(None).cast("boolean")
    keyed = docs.select("doc_id", "text", packed.alias("_others")).withColumn("_row", F.xxhash64("text"))
    rows = keyed.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "_row", "text")
    runs = covered(rows, window, depth, cell_bits).groupBy("doc_id", "_row").agg(F.collect_list(F.struct("start", "stop")).alias("_runs"))
    runs = stored(runs.withColumnsRenamed({"doc_id": "_doc", "_row": "_key"}), "runs")
    lose = IdFilter(runs.select("_doc"))
    told, number = lose.shared, F.col("doc_id").cast("long")
    # Rows whose place is not null are passed over if their document may lose words: they come in the other part.
    lost = keyed.where(number.isNotNull() & lose.where(number)).join(runs, (number == F.col("_doc")) & (F.col("_row") == F.col("_key")), "left")
    lost = lost.select("doc_id", "text", "_runs", "_others", F.lit(None).cast("long").alias("_place"))
    rest = keyed.select("doc_id", "text", F.lit(None).cast(runs.schema["_runs"].dataType).alias("_runs"), "_others", F.when(number.isNotNull(), lose.place(number)).alias("_place"))
    joined = lost.unionByName(rest)

    def work(batches):
        for batch in batches:
            place = batch.column(4)
            away = place.is_valid().to_numpy(zero_copy_only=False).copy()
            away[away] = marked(told.value, place.drop_null().to_numpy())
            if away.any():
                batch = batch.filter(pa.array(~away))
            ids, texts, runs, others, _ = batch.columns
            for words in slices(texts):
                begin, count = words.first, len(words.bounds) - 1
                some = runs.slice(begin, count)
                sizes = np.diff(words.bounds)
                which = np.repeat(np.arange(count), some.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                flat = some.flatten()
                edge = np.zeros(len(words.start) + 1, np.int64)
                if len(flat):
                    np.add.at(edge, words.bounds[which] + flat.field("start").to_numpy(), 1)
                    np.add.at(edge, words.bounds[which] + flat.field("stop").to_numpy(), -1)
                gone = np.cumsum(edge[:-1]) > 0
                total = np.append(0, np.cumsum(gone))
                removed = total[words.bounds[1:]] - total[words.bounds[:-1]]
                out = texts.slice(begin, count).to_pylist()
                raw = words.raw.tobytes()
                for k in np.flatnonzero(removed):
                    i = np.arange(words.bounds[k], words.bounds[k + 1])
                    i = i[~gone[i]]
                    out[k] = b" ".join(raw[s:e] for s, e in zip(words.start[i], words.stop[i], strict=True)).decode()
                yield pa.RecordBatch.from_arrays([ids.slice(begin, count), pa.array(out, pa.string()), others.slice(begin, count), pa.array(sizes.astype(np.int64)), pa.array(removed.astype(np.int64))], ["doc_id", "text", "_others", "n_words", "n_removed"])

    kinds = {f.name: f.dataType for f in joined.schema.fields}
    out = T.StructType([T.StructField("doc_id", kinds["doc_id"]), T.StructField("text", T.StringType()), T.StructField("_others", kinds["_others"]), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    done = joined.mapInArrow(work, out)
    return done.select(*(F.col("_others").getField(c).alias(c) if c in others else F.col(c) for c in docs.columns if c not in ("n_words", "n_removed")), "n_words", "n_removed")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.array_join(words_of(F.col("text")), " ").cast("binary"), 256).alias("kept_sha256"))
