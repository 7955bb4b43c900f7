"""Removal of long repeats with suffix arrays built by the difference-cover algorithm.

``suffix_array`` is the difference-cover construction (mod 3): triples at sampled positions are sorted and named, the
names are sorted by recursion until they are distinct, the remaining suffixes are sorted by a symbol and a known rank,
and both are merged.

To spread a corpus over many tasks, positions are dealt by content. Of the ``length - GRAM + 1`` grams that start
in the first part of a window of ``length`` bytes, the least by hash is the window's anchor; equal windows have equal
anchors at equal places. So windows can only be equal where their anchors' grams are, and grams that occur once are
out. Around the others, the bytes that the anchor's windows cover (its context) are sorted: equal contexts are one
entry with its number of occurrences, different contexts of one gram go to one task's suffix array, and there
neighbours that agree on ``length`` bytes are repeats. A gram with more than ``MOST_CONTEXTS`` different contexts is
dealt further, by window.

Defined results: a null text is empty; texts shorter than ``length`` keep all bytes; matches never cross documents,
but may lie in one document and overlap; equal texts lose everything if they are long enough; repeated rows count as
documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, stored, utf8
from .neardup import _BASE, _INVERSE, _mixed, _powers, _runs

LENGTH, GRAM = 400, 128
MOST_SYMBOLS = 1_500_000
MOST_CONTEXTS = 2_000
BROADCAST_KEYS = 1_000_000


# ---------------------------------------------------------------- suffix arrays


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order.

    Symbols are integers from 1 to 2**21 - 2, at most 2**21 - 2 of them.
    """
    return _sorted_suffixes(np.asarray(symbols, np.int64))


def _sorted_suffixes(s: np.ndarray) -> np.ndarray:
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s, np.zeros(4, np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # a position past the end keeps the two runs apart
    sample = np.concatenate([one, two])
    triple = t[sample] << 42 | t[sample + 1] << 21 | t[sample + 2]
    order = np.argsort(triple, kind="stable")
    fresh = np.ones(len(order), np.int64)
    fresh[1:] = triple[order[1:]] != triple[order[:-1]]
    name = np.empty(len(order), np.int64)
    name[order] = np.cumsum(fresh)
    if name[order[-1]] < len(order):
        order = _sorted_suffixes(name)
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(order) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    zero = np.arange(0, n, 3)
    key = t[zero] << 21 | rank[zero + 1]
    zero = zero[np.argsort(key, kind="stable")]
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(t[first] << 21 | rank[first + 1], t[zero] << 21 | rank[zero + 1])
    wide = lambda i: t[i] << 42 | t[i + 1] << 21 | rank[i + 2]
    before = before + np.searchsorted(wide(second), wide(zero))
    out = np.empty(n, np.int64)
    at = before + np.arange(len(zero))
    rest = np.ones(n, bool)
    rest[at] = False
    out[at] = zero
    out[rest] = sampled
    return out


def repeated(texts: list[bytes], counts: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, which starts have ``length`` bytes that also start elsewhere; text i occurs ``counts[i]`` times."""
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    symbols = joined.astype(np.int64) + 2
    symbols[ends - 1] = 1
    order = suffix_array(symbols)
    room = np.repeat(ends - 1, sizes + 1) - np.arange(len(joined))
    order = order[room[order] >= length]
    same = np.zeros(len(order) + 1, bool)
    windows = np.lib.stride_tricks.sliding_window_view(joined, length) if len(joined) >= length else np.zeros((0, length), np.uint8)
    for i in range(1, len(order), 16_384):
        j = min(len(order), i + 16_384)
        same[i:j] = (windows[order[i:j]] == windows[order[i - 1 : j - 1]]).all(axis=1)
    hit = np.zeros(len(joined), bool)
    hit[order] = same[:-1] | same[1:]
    return [hit[b : b + max(0, n - length + 1)] | (c > 1) for b, n, c in zip(begins.tolist(), sizes.tolist(), counts)]


# ---------------------------------------------------------------- dealing by content


def _least(x: np.ndarray, width: int, greatest: bool = False) -> np.ndarray:
    """Least (or greatest) of each ``width`` neighbours."""
    take = np.maximum if greatest else np.minimum
    fill = np.uint64(0 if greatest else 2**64 - 1)
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, fill)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = take.accumulate(rows, axis=1).ravel()
    behind = take.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return take(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(gram hash, context hash, place, low, high) of each anchor; its windows start at low to high."""
    none = np.zeros(0, np.int64)
    if len(text) < length:
        return none, none, none, none, none
    data = np.frombuffer(text, np.uint8)
    size = 1 << max(14, (len(data) + 1).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, size)[: len(data)], out=sums[1:])
    inverse = _powers(_INVERSE, size)
    grams = _mixed((sums[gram:] - sums[:-gram]) * inverse[: len(data) - gram + 1])
    width = length - gram + 1
    least = _least(grams, width)
    edge = np.zeros(width - 1, np.uint64)
    place = np.flatnonzero(_least(np.concatenate([edge, least, edge]), width, greatest=True) == grams)
    # windows in order have their anchors in order: the windows of an anchor follow each other
    starts = np.arange(len(least))
    step = np.searchsorted(place, starts)
    while True:  # the first anchor at or after the start whose gram is the window's least
        wrong = grams[place[step]] != least
        if not wrong.any():
            break
        step[wrong] += 1
    used, low = np.unique(step, return_index=True)
    high = np.append(low[1:], len(starts)) - 1
    place = place[used]
    end = high + length
    context = _mixed((sums[end] - sums[low]) * inverse[low] + _mixed((end - low).astype(np.uint64) * np.uint64(1 << 20) + (place - low).astype(np.uint64)))
    return grams[place].view(np.int64), context.view(np.int64), place, low, high


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(F.col(id_column).alias("id"), text.alias("text")).select("id", "text", F.xxhash64("text").alias("key"), F.octet_length("text").cast("long").alias("n_bytes"))


def _intervals(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - 1


def repeat_places(docs: DataFrame, texts: DataFrame, occurrences: DataFrame, length: int) -> DataFrame:
    """gram, context, first, last: starts (from the context's low end) that are repeated."""
    classes = stored(occurrences.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "n_bytes", "low", "high")).alias("at")), "classes")
    groups = stored(classes.groupBy("gram").agg(F.count("*").alias("contexts")), "grams")
    sized = classes.join(groups, "gram")
    single = sized.where("contexts = 1 and n > 1").select("gram", "context", F.lit(0).cast("long").alias("first"), (F.col("at.high") - F.col("at.low")).alias("last"))
    several = sized.where("contexts > 1").select("gram", "context", "n", "contexts", F.col("at.key").alias("key"), F.col("at.n_bytes").alias("n_bytes"), F.col("at.low").alias("low"), F.col("at.high").alias("high"))
    wanted = several.groupBy("key", "n_bytes").agg(F.collect_list(F.struct("gram", "context", "n", "contexts", "low", "high")).alias("wanted"))
    one_text = texts.dropDuplicates(["key", "n_bytes"]).select("key", "n_bytes", "text")
    listed = wanted.join(one_text, ["key", "n_bytes"])

    def cut_out(batches):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for batch in pieces(batches):
            for text, items in zip(utf8(batch.column(0)), batch.column(1)):
                items = items.as_py()
                rows = [(x["gram"], x["context"], x["n"], x["contexts"], text[x["low"] : x["high"] + length]) for x in items]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["gram", "context", "n", "contexts", "content"])

    contents = stored(listed.select("text", "wanted").mapInArrow(cut_out, "gram long, context long, n long, contexts long, content binary"), "contexts")

    def sorted_groups(batches):
        held: list[pa.Table] = []
        symbols = 0

        def emit():
            table = pa.concat_tables(held)
            grams, contexts, many = (table.column(i).to_pylist() for i in range(3))
            rows = []
            for g, c, hit in zip(grams, contexts, repeated(table.column(3).to_pylist(), many, length)):
                rows += [(g, c, a, b) for a, b in zip(*map(np.ndarray.tolist, _intervals(hit)))]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else ([], [], [], []))], ["gram", "context", "first", "last"])

        for group in _runs(batches, 1):
            size = group.column(3).nbytes
            if held and symbols + size > MOST_SYMBOLS:
                yield emit()
                held, symbols = [], 0
            held.append(group)
            symbols += size
        if held:
            yield emit()

    usual = contents.where(F.col("contexts") <= MOST_CONTEXTS).select("gram", "context", "n", "content").repartition("gram").sortWithinPartitions("gram")
    places = single.unionByName(usual.mapInArrow(sorted_groups, "gram long, context long, first long, last long"))

    def windows(batches):
        for batch in pieces(batches, 200_000):
            g, c, at, digest = [], [], [], []
            for gram, context, n, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for i in range(len(text) - length + 1):
                    g.append(gram), c.append(context), at.append(i), digest.append(hashlib.md5(text[i : i + length]).digest())
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(c, pa.int64()), pa.array(at, pa.int64()), pa.array(digest, pa.binary())], ["gram", "context", "first", "digest"])

    crowd = contents.where(F.col("contexts") > MOST_CONTEXTS)
    if not crowd.isEmpty():
        each = stored(crowd.select("gram", "context", "n", "content").mapInArrow(windows, "gram long, context long, first long, digest binary"), "windows")
        twice = each.groupBy("digest").agg(F.count("*").alias("k")).where("k > 1").select("digest")
        often = crowd.where("n > 1").select("gram", "context")
        hits = each.join(twice, "digest", "left_semi").unionByName(each.join(often, ["gram", "context"], "left_semi"))
        places = places.unionByName(hits.select("gram", "context", "first", F.col("first").alias("last")).distinct())
    return places


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, spans (array of begin, end bytes), kept (binary: the remaining bytes)."""
    kind = docs.schema[id_column].dataType.simpleString()
    keyed = _keyed(docs, id_column, text_column)

    def find(batches):
        for batch in pieces(batches):
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            for key, n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
                g, c, _, low, high = anchors(text, length, gram)
                for column, x in zip(columns, (g, c, np.full(len(g), key, np.int64), np.full(len(g), n, np.int64), low, high)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in columns], ["gram", "context", "key", "n_bytes", "low", "high"])

    found = stored(keyed.where(F.col("n_bytes") >= length).select("key", "n_bytes", "text").mapInArrow(find, "gram long, context long, key long, n_bytes long, low long, high long"), "anchors")
    # a table of its own, so that the join's large partitions can be split
    often = stored(found.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1").select("gram"), "often")
    occurrences = stored(found.join(often, "gram", "left_semi"), "occurrences")
    touched = stored(occurrences.select("key", "n_bytes").distinct(), "touched")
    small = touched.count() <= BROADCAST_KEYS
    keys = F.broadcast(touched) if small else touched
    texts = stored(keyed.join(keys, ["key", "n_bytes"], "left_semi"), "touched-texts")
    places = repeat_places(docs, texts, occurrences, length)
    spans = occurrences.select("gram", "context", "key", "n_bytes", "low").distinct().join(places, ["gram", "context"])
    spans = spans.groupBy("key", "n_bytes").agg(F.collect_list(F.struct((F.col("low") + F.col("first")).alias("begin"), (F.col("low") + F.col("last") + length).alias("end"))).alias("spans"))
    cut = texts.join(spans, ["key", "n_bytes"], "left").select("id", "text", "spans")
    rest = keyed.join(keys, ["key", "n_bytes"], "left_anti").select("id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))

    def removed(batches):
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in pieces(batches):
            rows = []
            for text, given in zip(utf8(batch.column(1)), batch.column(2)):
                merged: list[list[int]] = []
                for x in sorted((x["begin"], x["end"]) for x in given.as_py() or ()):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append(list(x))
                at, kept = 0, []
                for begin, end in merged:
                    kept.append(text[at:begin])
                    at = end
                kept.append(text[at:])
                rows.append((len(text), sum(e - b for b, e in merged), len(merged), [{"begin": b, "end": e} for b, e in merged], b"".join(kept)))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), span, pa.binary())))], ["id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<begin:bigint,end:bigint>>, kept binary"
    done = cut.mapInArrow(removed, schema).unionByName(rest.mapInArrow(removed, schema))
    return done.withColumnRenamed("id", id_column)
