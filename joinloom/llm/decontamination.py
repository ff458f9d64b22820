"""Benchmark decontamination with a distributed positional inverted index.

The index is split by documents: a shard holds the words of some documents in a row and, for each of their terms, the sorted
list of its places. All terms are posted, so the index depends on the documents alone and serves any test set. It is written to the shared
folder and read by as many queries as needed. A phrase is found by starting from the list of its rarest term in the shard, shifting places by the term's offset, and keeping
those that the lists of the other terms, next rarest first, also have at their offsets. Proximity
matches start from the rarest term in the same way: stretches of a few words that hold all words of a window in any order. All phrases of a block are looked up together.

The test set comes to the driver in blocks of at most about ``block_bytes`` of text (an item, at least); the index is read once for each block.

Words: see shared.words_of, "mark". Null text has no words; null ids stay null and repeated rows are documents of their own;
an item of null text or without words gives no window; a null item id counts as the item ''; repeated items count once. Either table may be
empty. A text longer than a slice is a shard of its own. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Words, large_strings, stored, text_slices, word_hashes, words_of

INDEX = "doc_id array<bigint>, first array<bigint>, terms binary, sizes binary, steps binary"
_HITS = "doc_id bigint, n_words bigint, spans array<struct<begin:bigint,end:bigint>>, items array<string>, near_items array<string>"
_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


class Shard:
    """terms: sorted distinct hashes; heads: where each one's list begins; places: all lists, one after the other."""

    def __init__(self, terms: np.ndarray, heads: np.ndarray, places: np.ndarray, first: np.ndarray):
        self.terms, self.heads, self.places, self.first = terms, heads, places, first
        sizes = np.diff(np.append(heads, len(places)))
        self.keys = (np.repeat(np.arange(len(terms), dtype=np.int64), sizes) << 32) | places
        self.sizes = np.append(sizes, 0)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each term; len(terms) if it isn't posted."""
        if not len(self.terms):
            return np.zeros(hashes.shape, np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, len(self.terms))

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = (term << 32) | place
        at = np.searchsorted(self.keys, key)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == key) if len(self.keys) else np.zeros(len(key), bool)

    def after(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first place of each term from the given one on; far beyond all if there is none."""
        if not len(self.keys):
            return np.full(len(term), _FAR)
        at = np.searchsorted(self.keys, (term << 32) | place)
        key = self.keys[np.minimum(at, len(self.keys) - 1)]
        return np.where((at < len(self.keys)) & (key >> 32 == term), key & 0xFFFFFFFF, _FAR)

    def _from_rarest(self, windows: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The terms of windows, their columns from the rarest on, and each (window, place) of a rarest term."""
        term = self.find(windows)
        count = np.where(used, self.sizes[term], np.iinfo(np.int64).max)
        order = np.argsort(count, axis=1, kind="stable")
        live = np.flatnonzero(count.min(axis=1) > 0)
        rarest = term[live, order[live, 0]]
        lists = self.sizes[rarest]
        inside = np.arange(int(lists.sum())) - np.repeat(np.cumsum(lists) - lists, lists)
        return term, order, np.repeat(live, lists), self.places[np.repeat(self.heads[rarest], lists) + inside]

    def phrases(self, windows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of each occurrence of windows[i, :sizes[i]] within one document."""
        n, most = windows.shape if windows.size else (0, 0)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        term, order, window, place = self._from_rarest(windows, np.arange(most) < sizes[:, None])
        place = place - order[window, 0]
        keep = place >= 0
        window, place = window[keep], place[keep]
        doc = np.searchsorted(self.first, place, "right")
        keep = place + sizes[window] <= self.first[np.minimum(doc, len(self.first) - 1)]
        window, place = window[keep], place[keep]
        for rank in range(1, most):
            k = order[window, rank]
            keep = (k >= sizes[window]) | self.has(term[window, k], place + k)
            window, place = window[keep], place[keep]
        return window, place

    def near(self, windows: np.ndarray, sizes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, begin) of stretches of at most ``span`` words of one document that hold all words of windows[i, :sizes[i]] in any order: for each
        place of the rarest term the earliest such stretch around it, from its first word of the window on."""
        n, most = windows.shape if windows.size else (0, 0)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        term, order, window, place = self._from_rarest(windows, np.arange(most) < sizes[:, None])
        doc = np.searchsorted(self.first, place, "right")
        low, end = np.maximum(place - span + 1, self.first[doc - 1]), self.first[doc]
        for rank in range(1, most):  # each word somewhere around
            k = order[window, rank]
            keep = (k >= sizes[window]) | (self.after(term[window, k], low) < np.minimum(place + span, end))
            window, place, low, end = window[keep], place[keep], low[keep], end[keep]
        begin = np.full(len(window), _FAR)
        for _ in range(span):  # a stretch from low on, then from one word later on
            open_ = np.flatnonzero((begin == _FAR) & (low <= place))
            first, last = np.full(len(open_), _FAR), np.zeros(len(open_), np.int64)
            for k in range(most):
                at = np.where(k < sizes[window[open_]], self.after(term[window[open_], k], low[open_]), -1)
                first = np.where(at >= 0, np.minimum(first, at), first)
                last = np.maximum(last, at)
            met = last < np.minimum(low[open_] + span, end[open_])
            begin[open_[met]] = first[met]
            low = low + 1
        return window[begin < _FAR], begin[begin < _FAR]


_FAR = 1 << 32


def post(texts: pa.Array) -> Shard:
    """The index of some texts."""
    w = Words(texts, "mark")
    places = np.argsort(w.hashes, kind="stable")
    terms, heads = np.unique(w.hashes[places], return_index=True)
    return Shard(terms, heads.astype(np.int64), places.astype(np.int64), w.first.astype(np.int64))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored shards of the index, a row each."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), large_strings(b.column(1))
            for a, z in text_slices(texts):
                s = post(texts.slice(a, z - a))
                steps = np.diff(s.places, prepend=0)
                steps[s.heads] = s.places[s.heads]
                row = {"doc_id": [ids.slice(a, z - a).to_pylist()], "first": [s.first.tolist()], "terms": [s.terms.astype("<u8").tobytes()], "sizes": [s.sizes[:-1].astype("<u4").tobytes()], "steps": [steps.astype("<u4").tobytes()]}
                yield pa.RecordBatch.from_pydict(row, schema=schema)

    schema = pa.schema([("doc_id", pa.list_(pa.int64())), ("first", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("terms", "sizes", "steps"))])
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(shards, INDEX), "index")


def _shard(b: pa.RecordBatch, i: int) -> tuple[list, Shard]:
    """A row of the index; each term's list is kept as steps from place to place."""
    terms, sizes, steps = (np.frombuffer(b.column(n)[i].as_py(), t) for n, t in (("terms", "<u8"), ("sizes", "<u4"), ("steps", "<u4")))
    heads = np.cumsum(sizes, dtype=np.int64) - sizes
    sums = np.cumsum(steps, dtype=np.int64)
    before = sums[heads] - steps[heads]
    return b.column("doc_id")[i].as_py(), Shard(terms, heads, sums - np.repeat(before, sizes), np.array(b.column("first")[i].as_py(), np.int64))


class Block:
    """Distinct windows of some test items and which items each stands in."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        owners: dict[tuple, set[str]] = {}
        for item, text in items:
            words = words_of(text, "mark")
            for k in range(max(1, len(words) - size + 1)) if words else ():
                owners.setdefault(tuple(words[k : k + size]), set()).add(item)
        distinct = sorted(owners)
        self.sizes = np.array([len(w) for w in distinct], np.int64)
        flat = word_hashes([x for w in distinct for x in w])
        self.windows = np.zeros((len(distinct), size), np.uint64)
        self.windows[np.arange(size) < self.sizes[:, None]] = flat
        self.items = [sorted(owners[w]) for w in distinct]


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, near: int = 0, block_bytes: int = 2 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, spans, items, near_items``: of each row the stretches of words (merged, [begin, end)) that occurrences of test windows cover,
    the ids of the items with such a window, sorted as strings, and those of the items with a window all of whose words
    stand within ``near`` words in any order (0: not looked for)."""
    items = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text")).distinct()
    blocks = 1 + int(items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // block_bytes
    part = lambda b: Block([(r["item"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()], size)  # noqa: E731  block_bytes at most
    index = build_index(docs, id_col, text_col)
    spark = docs.sparkSession

    def look_up(block: Block) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    yield _hits(*_shard(b, i), sent.value, near)

        return index.mapInArrow(hits, _HITS)

    if blocks == 1:
        return look_up(part(0))
    found = None
    for b in range(blocks):
        hits = look_up(part(b)).withColumn("row", F.monotonically_increasing_id())
        found = hits if found is None else found.unionByName(hits)
    # The same row has the same number in each pass over the stored index.
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    both = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), spans.alias("spans"), *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items")))
    merged = F.expr("""aggregate(spans, cast(array() as array<struct<begin:bigint,end:bigint>>), (a, s) -> if(size(a) > 0 and s.begin <= element_at(a, -1).end,
        concat(slice(a, 1, size(a) - 1), array(named_struct('begin', element_at(a, -1).begin, 'end', greatest(element_at(a, -1).end, s.end)))), concat(a, array(s))))""")
    return both.select("doc_id", "n_words", merged.alias("spans"), "items", "near_items")


def _hits(ids: list, shard: Shard, block: Block, near: int) -> pa.RecordBatch:
    first = shard.first
    window, place = shard.phrases(block.windows, block.sizes)
    steps = np.zeros(int(first[-1]) + 1, np.int64)
    np.add.at(steps, place, 1)
    np.add.at(steps, place + block.sizes[window], -1)
    hit = np.cumsum(steps) > 0
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8)]))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    spans: list[list] = [[] for _ in ids]
    items: list[set] = [set() for _ in ids]
    for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
        d = int(np.searchsorted(first, b, "right")) - 1
        while b < e:  # a stretch can go on into the next document
            stop = min(e, int(first[d + 1]))
            if stop > b:
                spans[d].append({"begin": b - int(first[d]), "end": stop - int(first[d])})
            b, d = stop, d + 1
    near_items: list[set] = [set() for _ in ids]
    for found, (window, place) in ((items, (window, place)), (near_items, shard.near(block.windows, block.sizes, near) if near else (window[:0], place[:0]))):
        doc = np.searchsorted(first, place, "right") - 1
        for d, w in set(zip(doc.tolist(), window.tolist(), strict=True)):
            found[d].update(block.items[w])
    columns = [pa.array(ids, pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array(spans, _SPANS), *(pa.array([sorted(x) for x in found], pa.list_(pa.string())) for found in (items, near_items))]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "spans", "items", "near_items"])


def proximity(index: DataFrame, words: list[str], span: int) -> DataFrame:
    """``doc_id, begin``: stretches of at most ``span`` words that hold all the given words (lower case), see Shard.near; none for no words."""
    hashes = np.unique(word_hashes(words))[None, :]
    sizes = np.array([hashes.size])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, shard = _shard(b, i)
                begins = np.unique(shard.near(hashes, sizes, span)[1])
                doc = np.searchsorted(shard.first, begins, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d in doc], pa.int64()), pa.array(begins - shard.first[doc], pa.int64())], names=["doc_id", "begin"])

    return index.mapInArrow(found, "doc_id bigint, begin bigint")
