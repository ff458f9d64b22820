"""Language-model scores by deleted interpolation.

The probability of a token after its predecessor mixes maximum-likelihood estimates,

    P(w | h) = a2 c(h w) / c(h) + a1 c(w) / N + a0 / (V + 1),

with weights a that depend on the bucket of c(h) (powers of two). Weights are learned by expectation-maximisation: counts come from
most of the training documents (fold A), events from the rest (fold H, one document of ``HELD``). The final estimates use both.

Tokens are words (see shared.words_of, "space") and one end for each document; the first word follows the start, which is as frequent as the end.

Execution. Texts are dealt with in batches of about ``BATCH`` bytes, stored as numbers into the batch's own word list. Each
batch asks for the corpus counts of its distinct words and pairs: hashes and local counts go to the hash's bucket, where counts of all
batches are added; what differs from the local count goes back. So counts are exact sums over all documents, the words'
volume shrinks before it is shuffled, and no table of counts is ever gathered. Only sums of bounded size reach the driver:
two totals, and a histogram of quantised probabilities for the learning of weights.

Null text is empty (the end alone). A document of null id is for training. Repeated rows count each time. Without
training tokens N and V are 0 and all scores are finite. Empty tables give empty results; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import U64, Words, crc_of_id, large_strings, mix, runs, stored, text_slices, width

BATCH = 16 << 20
HELD = 8
BUCKETS, STEPS = 24, 8
A, H, O = 0, 1, 2  # noqa: E741
END = U64(0x5D1F3A77C0FFEE11)
SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
_CODED = "batch bigint, docs array<bigint>, folds binary, lengths binary, numbers binary, words binary"
_ASKED = "bucket bigint, batch bigint, pairs boolean, hashes binary, places binary, counts binary"
_TOLD = "batch bigint, pairs boolean, places binary, counts binary, tokens_a bigint, tokens_t bigint, words_a bigint, words_t bigint"


def fold_of(id_col: str, left_out: Column) -> Column:
    held = F.floor(crc_of_id(id_col) / 7) % HELD == 0
    return F.when(F.coalesce(left_out, F.lit(False)), O).when(F.coalesce(held, F.lit(False)), H).otherwise(A)


def packed(x: np.ndarray) -> bytes:
    """Compressed byte by byte of the numbers: all lowest bytes first, since the higher ones are mostly zero."""
    planes = np.ascontiguousarray(x).view("u1").reshape(-1, x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(x: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "u1").reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind)[:, 0]


def stretches(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of begin .. begin + size of each, in a row."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Batch:
    """Documents of one batch, fold by fold: distinct words and pairs, and their counts in the batch.

    Pairs are (number of the word before, number of the word); the start has the number len(words).
    """

    def __init__(self, folds: np.ndarray, lengths: np.ndarray, numbers: np.ndarray, words: int):
        self.folds, self.lengths, self.numbers, self.words = folds, lengths.astype(np.int64), numbers.astype(np.int64), words
        first = np.cumsum(self.lengths) - self.lengths
        self.first = first
        before = np.empty(len(numbers), np.int64)
        before[1:] = self.numbers[:-1]
        before[first] = words
        self.before = before
        self.pairs, self.pair = np.unique((before << 32) | self.numbers, return_inverse=True)
        self.ends = int(self.lengths[folds == A].sum()), int(self.lengths[folds != O].sum())
        self.word_counts = np.stack([np.bincount(self.numbers[:e], minlength=words) for e in self.ends])
        self.pair_counts = np.stack([np.bincount(self.pair[:e], minlength=len(self.pairs)) for e in self.ends])


def build(ids: list, folds: np.ndarray, lengths: np.ndarray, tokens: np.ndarray) -> dict:
    order = np.argsort(folds, kind="stable")
    begins = np.cumsum(lengths) - lengths
    words, numbers, often = np.unique(tokens[stretches(begins[order], lengths[order])], return_inverse=True, return_counts=True)
    ranked = np.argsort(-often, kind="stable")  # frequent words get small numbers, which compress well
    place = np.empty(len(words), np.int64)
    place[ranked] = np.arange(len(words))
    words, numbers = words[ranked], place[numbers]
    return {
        "batch": [0],
        "docs": [[ids[i] for i in order.tolist()]],
        "folds": [folds[order].astype("u1").tobytes()],
        "lengths": [lengths[order].astype("<u4").tobytes()],
        "numbers": [packed(numbers.astype("<u4"))],
        "words": [words.astype("<u8").tobytes()],
    }


def coded(docs: DataFrame, left_out: Column, id_col: str, text_col: str) -> DataFrame:
    """Batches as rows."""
    schema = pa.schema([("batch", pa.int64()), ("docs", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("folds", "lengths", "numbers", "words"))])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, size = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        gathered: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            nonlocal name, size, ids, gathered
            row = build(ids, *(np.concatenate(x) for x in zip(*gathered, strict=True))) | {"batch": [name]}
            name, size, ids, gathered = name + 1, 0, [], []
            return pa.RecordBatch.from_pydict(row, schema=schema)

        for b in batches:
            texts, fold = large_strings(b.column("text")), b.column("fold").to_numpy()
            for a, z in text_slices(texts):
                w = Words(texts.slice(a, z - a), "space")
                tokens = np.insert(w.hashes, w.first[1:], END)
                gathered.append((fold[a:z], np.diff(w.first) + 1, tokens))
                ids += b.column("doc_id").slice(a, z - a).to_pylist()
                size += len(w.low)
                if size >= BATCH:
                    yield flush()
        if ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), fold_of(id_col, left_out).alias("fold"))
    return stored(rows.mapInArrow(code, _CODED), "coded")


def _batches(b: pa.RecordBatch | pa.Table) -> Iterator[tuple[dict, Batch]]:
    for r in b.to_pylist():
        words = np.frombuffer(r["words"], "<u8") if r.get("words") is not None else None
        numbers = unpacked(r["numbers"], "<u4")
        n = len(words) if words is not None else int(numbers.max()) + 1 if len(numbers) else 0  # every word of the list occurs
        yield r | {"words": words}, Batch(np.frombuffer(r["folds"], "u1"), np.frombuffer(r["lengths"], "<u4"), numbers, n)


def corpus_counts(batches: DataFrame) -> DataFrame:
    """What each batch doesn't know of its words' and pairs' counts, and totals in rows of batch -1."""
    buckets = width(batches, 8)

    def ask(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in given:
            for r, batch in _batches(b):
                words = r["words"]
                heads = np.append(words, U64(0x9A5B3C1D2E4F6071))
                pair = mix(mix(heads[batch.pairs >> 32]) + words[batch.pairs & 0xFFFFFFFF])
                for pairs, hashes, counts in ((False, words, batch.word_counts), (True, pair, batch.pair_counts)):
                    to = (hashes % U64(buckets)).astype(np.int64)
                    order = np.argsort(to, kind="stable")
                    starts = runs(to[order])
                    for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
                        at = order[a:z]
                        # Highest bits, beside those that the bucket tells: 48 of a word, 40 of a pair.
                        size = 5 if pairs else 6
                        short = (hashes[at] >> U64(64 - 8 * size)).astype("<u8").view("u1").reshape(-1, 8)[:, :size]
                        row = [int(to[at[0]]), r["batch"], pairs, np.ascontiguousarray(short).tobytes(), packed(np.diff(at, prepend=0).astype("<u4")), packed(counts[:, at].astype("<u4"))]
                        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["bucket", "batch", "pairs", "hashes", "places", "counts"])

    def tell(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple[int, bool], list[tuple[int, bytes, bytes, bytes]]] = {}
        for b in given:
            for r in b.to_pylist():
                own.setdefault((r["bucket"], r["pairs"]), []).append((r["batch"], r["hashes"], r["places"], r["counts"]))
        schema = pa.schema([("batch", pa.int64()), ("pairs", pa.bool_()), ("places", pa.binary()), ("counts", pa.binary()), *((n, pa.int64()) for n in ("tokens_a", "tokens_t", "words_a", "words_t"))])
        for bucket, pairs in list(own):
            asked = own.pop((bucket, pairs))
            size = 5 if pairs else 6
            raw = np.frombuffer(b"".join(x[1] for x in asked), "u1").reshape(-1, size)
            hashes = np.zeros((len(raw), 8), np.uint8)
            hashes[:, :size] = raw
            known, which = np.unique(hashes.view("<u8")[:, 0], return_inverse=True)
            local = [unpacked(x[3], "<u4").reshape(2, -1) for x in asked]
            each = np.concatenate(local, axis=1)
            total = np.stack([np.bincount(which, each[k], len(known)) for k in (0, 1)]).astype(np.int64)
            if not pairs:
                totals = [int(total[0].sum()), int(total[1].sum()), int((total[0] > 0).sum()), int((total[1] > 0).sum())]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (-1, False, None, None, *totals), strict=True))], schema=schema)
            at = 0
            for (batch, _, places, _), mine in zip(asked, local, strict=True):
                here = total[:, which[at : at + mine.shape[1]]]
                at += mine.shape[1]
                other = np.flatnonzero((here != mine).any(axis=0))
                if len(other):
                    row = (batch, pairs, packed(np.cumsum(unpacked(places, "<u4").astype(np.int64))[other].astype("<u4")), packed(here[:, other].astype("<u8")), None, None, None, None)
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema=schema)

    return stored(batches.mapInArrow(ask, _ASKED).repartition(buckets, "bucket").mapInArrow(tell, _TOLD), "told")


def with_counts(left: pa.Table, right: pa.Table) -> Iterator[tuple[dict, Batch]]:
    """The batches of a table with corpus counts in place of local ones."""
    for r, batch in _batches(left):
        for t in right.to_pylist():
            counts = batch.pair_counts if t["pairs"] else batch.word_counts
            counts[:, unpacked(t["places"], "<u4")] = unpacked(t["counts"], "<u8").reshape(2, -1)
        yield r, batch


def parts_of(batch: Batch, k: int, end: int, tokens: slice | np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, c(h w) / c(h), c(w) / N and c(w) of tokens, by counts of fold A (k = 0) or of all training (1). end: the end's number."""
    words = np.append(batch.word_counts[k], batch.word_counts[k][end])  # the start is as frequent as the end
    before, word = words[batch.before[tokens]], words[batch.numbers[tokens]]
    bucket = np.where(before > 0, 1 + np.minimum(np.log2(np.maximum(before, 1)).astype(np.int64), BUCKETS - 2), 0)
    return bucket, batch.pair_counts[k][batch.pair[tokens]] / np.maximum(before, 1), word / max(total, 1), word


def learn(cells: np.ndarray, vocabulary: int, rounds: int = 100) -> np.ndarray:
    """Weights (a2, a1, a0) of each bucket by expectation-maximisation. cells: rows of bucket, steps of -log2 of the pair's and the
    word's estimate (-1: zero), events."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    p = np.stack([np.where(cells[:, k] < 0, 0.0, np.exp2(-cells[:, k] / STEPS)) for k in (1, 2)] + [np.full(len(cells), 1 / (vocabulary + 1))], axis=1)
    n = cells[:, 3].astype(float)

    def fitted(rows: np.ndarray) -> np.ndarray:
        a = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = a * p[rows]
            share *= (n[rows] / share.sum(axis=1))[:, None]
            a = share.sum(axis=0) / n[rows].sum()
        return a

    if len(cells):
        weights[:] = fitted(np.arange(len(cells)))
    for b in range(BUCKETS):
        rows = np.flatnonzero(cells[:, 0] == b) if len(cells) else []
        if len(rows):
            weights[b] = fitted(rows)
    weights[0, 0] = 0  # an unseen word before gives no estimate
    weights += 1e-6  # nothing is impossible
    return weights / weights.sum(axis=1, keepdims=True)


def scores(docs: DataFrame, left_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every row; ``left_out`` says which are not for training (default: crc32 of the id modulo 7 is 2)."""
    batches = coded(docs, crc_of_id(id_col) % 7 == 2 if left_out is None else left_out, id_col, text_col)
    told = corpus_counts(batches)
    sums = told.where("batch = -1").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens_a", "tokens_t", "words_a", "words_t"))).first()
    tokens_a, tokens_t, words_a, words_t = map(int, sums)
    told = told.where("batch >= 0").select("batch", "pairs", "places", "counts").withColumnRenamed("batch", "of")

    def cells(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for _, batch in with_counts(left, right):
            held = slice(batch.ends[0], batch.ends[1])
            end = int(batch.numbers[-1])  # the last token of any document
            bucket, p2, p1, _ = parts_of(batch, 0, end, held, tokens_a)
            steps = [np.where(p > 0, np.round(-STEPS * np.log2(np.where(p > 0, p, 1))), -1).astype(np.int64) for p in (p2, p1)]
            cell, n = np.unique((bucket << 40) | ((steps[0] + 1) << 20) | (steps[1] + 1), return_counts=True)
            found.append(pa.table({"cell": pa.array(cell, pa.int64()), "n": pa.array(n, pa.int64())}))
        return pa.concat_tables(found) if found else pa.table({"cell": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})

    def both() -> object:
        return batches.drop("words").groupBy("batch").cogroup(told.groupBy("of"))

    # At most BUCKETS times the square of the steps between 1 and the least probability.
    seen = both().applyInArrow(cells, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, n = seen["cell"].to_numpy(), seen["n"].to_numpy()
    weights = learn(np.stack([cell >> 40, ((cell >> 20) & 0xFFFFF) - 1, (cell & 0xFFFFF) - 1, n], axis=1), words_a)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for r, batch in with_counts(left, right):
            bucket, p2, p1, count = parts_of(batch, 1, int(batch.numbers[-1]), slice(None), tokens_t)
            w = weights[bucket]
            p = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (words_t + 1))
            base = np.log10((count + 1) / (tokens_t + words_t + 1))
            add = lambda x: np.add.reduceat(x, batch.first)
            columns = [
                pa.array(r["docs"], pa.int64()),
                pa.array(batch.folds == O, pa.bool_()),
                pa.array(batch.lengths, pa.int64()),
                pa.array(add((count > 0).astype(np.int64)), pa.int64()),
                pa.array(np.full(len(batch.lengths), tokens_t), pa.int64()),
                pa.array(add(base), pa.float64()),
                pa.array(add(p), pa.float64()),
            ]
            out.append(pa.Table.from_arrays(columns, names=[f.split()[0] for f in SCORED.split(", ")]))
        return pa.concat_tables(out) if out else empty

    empty = pa.table({n: pa.array([], t) for n, t in zip([f.split()[0] for f in SCORED.split(", ")], (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)})
    return both().applyInArrow(scored, SCORED)
