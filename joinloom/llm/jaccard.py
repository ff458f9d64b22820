"""Exact Jaccard join over word shingles by a token-group matrix; connected components of its links.

Texts of equal shingle sets form a class; classes are the nodes. Steps, none of which gathers documents on the driver or
enumerates the pairs within a group:

1. Each class is compared with the leaders of the buckets of its first ``LEADERS`` minhashes, a random member for each, if ``ALIKE`` of
   ``KEYS`` minhashes agree. The links found partition most similar documents into components. What this leaves out is found in the next steps.
2. Groups are parts of a component of about ``GROUP`` classes. With a threshold of t, two linked sets share an element among the
   first n - ceil(t n) + 1 of either, in any one order of elements (rare ones first, by counts over the corpus). The matrix
   holds these elements of each group's members with their places, dealt by element. A query's elements give the groups of other
   components, no smaller than its own, that can hold a partner by their sizes and by what is left behind the element.
3. For each such query and group, the overlap with the union of the members' sets bounds every member's: it must
   reach t times the query's size. Only groups that pass are opened and compared member by member.
4. Links of 1 and 3 give the components. A pair left out lies within one component of step 1 already.

Sets are of 64-bit hashes; texts are hashed anew in each step rather than kept, and for 1 and 3 only those that are compared. A set travels to each leader
or group it is compared with; rows arrive sorted, so a task holds one leader's set or one group's at a time, and leaders and groups that
more than ``BLOCK`` classes are compared with are split. Null and empty texts have no shingles and link with nothing; with fewer than
``size`` words the whole sequence is the one shingle. A row of null id takes part, and a component's id is its least id that isn't null.
Repeated rows are of one class. Empty tables give empty results; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import U64, Words, forget, large_strings, mix, runs, stored, text_slices, width

KEYS, ALIKE, LEADERS, GROUP = 8, 5, 5, 64
#: Elements of more classes than COMMON come last in the order, the most frequent MOST_COMMON of them (a bound on what is sent round).
COMMON, MOST_COMMON = 3, 1 << 20
#: Classes compared with one leader or group before it is split.
BLOCK = 1024
#: Elements of texts that one bucket of the count and of the matrix takes, and that a task gathers before it sends them.
BUCKET, GATHERED = 8_000_000, 8_000_000
#: Rows of two numbers up to which a side is broadcast.
FEW = 500_000
_C = mix(np.arange(100, 132, dtype=np.uint64)) | U64(1)


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for a, z in text_slices(texts):
        w = Words(texts.slice(a, z - a), "space")
        h, n = w.hashes, len(w.hashes)
        whole = np.zeros(max(0, n - size + 1), np.uint64)
        for j in range(size):
            whole += h[j : n - size + 1 + j] * _C[j] if n >= size else 0
        whole = mix(whole)
        for b, e in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if e - b >= size:
                yield np.unique(whole[b : e - size + 1])
            elif e > b:
                yield mix((h[b:e] * _C[: e - b]).sum(keepdims=True) + U64(e - b))
            else:
                yield np.zeros(0, np.uint64)


def class_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches the threshold."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sets(docs: DataFrame, size: int, rows: Callable, schema: str) -> DataFrame:
    """mapInArrow over shingle sets: rows(slices) makes tuples of columns from a task's slices (doc_ids, sets)."""
    names = [f.split()[0] for f in schema.split(", ")]
    types = {"bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    kinds = [types[f.split()[1]] for f in schema.split(", ")]

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
        for b in batches:
            ids, texts = b.column(0), large_strings(b.column(1))
            for a, z in text_slices(texts, 1 << 22):
                yield ids.slice(a, z - a).to_pylist(), list(shingle_sets(texts.slice(a, z - a), size))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in rows(slices(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.mapInArrow(made, schema)


def packed(values: np.ndarray) -> bytes:
    """Numbers below 2^32 in ascending order: their differences by byte planes, compressed."""
    steps = np.diff(values.astype("<u4"), prepend=np.uint32(0))
    return pa.compress(steps.view("u1").reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 4 * n, codec="zstd"), "u1").reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _few(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has few rows of a few numbers; the caller has stored it."""
    return F.broadcast(df) if df.count() <= FEW else df


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the least node) of all nodes of ``edges`` (a, b): minimum labels and pointer jumping."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        least = labels.join(near, labels.node == near.a).select("node", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("on"))
        new = stored(least.join(jump, "to").select("node", F.least("to", "on").alias("component"), "was"), "labels")
        changed = not new.where("component != was").isEmpty()
        forget(labels)
        labels = new.drop("was")
        if not changed:
            forget(both)
            return labels


def _salted(asks: DataFrame) -> DataFrame:
    """``class, key, salt``: keys of more than BLOCK classes are split by class."""
    many = stored(asks.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("salts")).where("salts > 1"), "many")
    return asks.join(_few(many), "key", "left").withColumn("salt", F.pmod(F.xxhash64("class"), F.coalesce("salts", F.lit(1).cast("bigint")))).drop("salts")


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for b in batches:
        for i in range(0, b.num_rows, 256):
            yield from zip(*(b.column(c).slice(i, 256).to_pylist() for c in names), strict=True)


def _edges(found: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    found = list(found)
    a, b = zip(*found, strict=True) if found else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _near_leader(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of classes with the leader they ask; the leader's row comes before theirs."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        led = np.zeros(0, np.uint64)
        for key, asks, name, raw in _rows(batches, "key", "asks", "class", "shingles"):
            s = np.frombuffer(raw, "<u8")
            if not asks:
                led = s
            elif linked(s, led, percent):
                yield name, key

    return lambda batches: _edges(found(batches))


def _opened(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of queries with members of the groups they ask, whose rows come first: only groups whose union passes the bound are opened."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        at, inside, union, lead = None, {}, None, {}

        def find(x: int) -> int:
            while lead.setdefault(x, x) != x:
                lead[x] = x = lead[lead[x]]
            return x

        for key, salt, asks, name, component, raw in _rows(batches, "key", "salt", "asks", "class", "component", "shingles"):
            if at != (key, salt):
                at, inside, union = (key, salt), {}, None
                lead.clear()
            s = np.frombuffer(raw, "<u8")
            if not asks:
                inside[name] = component, s
                continue
            if union is None:
                union = np.unique(np.concatenate([x for _, x in inside.values()]))
            place = np.minimum(np.searchsorted(union, s), len(union) - 1)
            if 100 * int((union[place] == s).sum()) >= percent * len(s):
                # What earlier links have joined needs no other link.
                for other, (component, x) in inside.items():
                    if find(component) != find(name) and linked(s, x, percent):
                        lead[find(component)] = find(name)
                        yield name, other

    return lambda batches: _edges(found(batches))


def similar(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row. Components only: links that they don't need are skipped; links() gives all."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def signed(slices: Iterator) -> Iterator[tuple]:
        salts = mix(np.arange(1, KEYS + 1, dtype=np.uint64))
        for ids, sets in slices:
            keys = [[] if not len(s) else [int(mix(s ^ x).min().view(np.int64)) for x in salts] for s in sets]
            yield ids, [len(s) for s in sets], [class_of(s) if len(s) else None for s in sets], keys

    rows = stored(_sets(docs, size, signed, "doc_id bigint, n bigint, class bigint, keys array<bigint>"), "classes")
    distinct = stored(rows.where("n > 0").groupBy("class").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.min("doc_id").alias("least")), "distinct")

    def sent(to: DataFrame) -> DataFrame:
        """The sets of classes where ``to`` (class, key, salt, asks and more) sends them, by key and salt, those that don't ask first."""

        def shingles(slices: Iterator) -> Iterator[tuple]:
            seen: set[int] = set()  # repeated rows go once from each task
            for _, sets in slices:
                new = {c: s for s in sets if len(s) and (c := class_of(s)) not in seen}
                seen |= new.keys()
                yield list(new), [s.astype("<u8").tobytes() for s in new.values()]

        to = stored(to, "to")
        ids = _few(stored(to.select("class").distinct().join(distinct, "class").select(F.col("least").alias("wanted")).distinct(), "wanted"))
        texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
        found = _sets(texts, size, shingles, "class bigint, shingles binary").join(_few(to), "class")
        return found.repartition("key", "salt").sortWithinPartitions("key", "salt", "asks")

    # 1. Leaders.
    keyed = distinct.select("class", F.posexplode("keys").alias("k", "key")).where(F.col("k") < LEADERS)
    led = keyed.groupBy("k", "key").agg(F.min_by("class", F.xxhash64("class", "k")).alias("leader"), F.count("*").alias("members")).where("members > 1").drop("members")
    pairs = keyed.join(led, ["k", "key"]).where("class != leader").select("class", "leader").distinct()
    pairs = pairs.join(distinct, "class").join(distinct.select(F.col("class").alias("leader"), F.col("n").alias("m"), F.col("keys").alias("led")), "leader")
    agree = F.size(F.filter(F.zip_with("keys", "led", lambda x, y: x == y), lambda x: x))
    pairs = stored(pairs.where((agree >= ALIKE) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))).select("class", F.col("leader").alias("key")), "pairs")
    asking = _salted(pairs).withColumn("asks", F.lit(1))
    leaders = asking.select(F.col("key").alias("class"), "key", "salt").distinct().withColumn("asks", F.lit(0))
    stars = stored(sent(asking.unionByName(leaders)).mapInArrow(_near_leader(percent), "a bigint, b bigint"), "stars")
    parts = components(stars)
    # 2. Groups, and the matrix.
    sizes = parts.groupBy("component").agg(F.count("*").alias("members"))
    group = F.xxhash64("component", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / GROUP)))
    pure = parts.join(sizes, "component").select(F.col("node").alias("class"), "component", "members", group.alias("grp"), F.lit(0).alias("mixed"))
    # Classes without a link so far that agree in two minhashes are groups as well: alike, but each a component of its own.
    single = distinct.join(parts, distinct["class"] == parts.node, "left_anti").select("class", F.xxhash64(F.slice("keys", 1, 2)).alias("component"))
    alike = single.groupBy("component").agg(F.count("*").alias("members")).where("members > 1")
    group = F.xxhash64("component", F.pmod(F.xxhash64("class"), F.ceil(F.col("members") / GROUP)), F.lit("mixed"))
    groups = stored(pure.unionByName(single.join(alike, "component").select("class", "component", "members", group.alias("grp"), F.lit(1).alias("mixed"))), "groups")
    # Buckets grow with the input, so that one fits in a task.
    buckets = max(width(docs, 8), (distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] or 0) // BUCKET)
    # Elements by their highest bits, more of them where there is more to tell apart: a bucket and 32 bits.
    bits = 32 + buckets.bit_length() - 1
    short = lambda values, lost=0: values >> U64(64 - bits + lost)

    def dealt(values: np.ndarray, *more: np.ndarray) -> Iterator[tuple]:
        """Short values by bucket, and what belongs to them."""
        to = (values % U64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        rest = (values // U64(buckets)).astype("<u4")
        heads = runs(to[order])
        for a, z in zip(heads.tolist(), [*heads[1:].tolist(), len(order)], strict=True):
            at = order[a:z]
            yield int(to[at[0]]), *(np.ascontiguousarray(x[at]) for x in (rest, *more))

    # Counts only order the elements, so elements that share their first bits may count as one: 8 bits fewer than in the matrix.
    def all_of(slices: Iterator) -> Iterator[tuple]:
        kept: dict[int, np.ndarray] = {}
        n = 0

        def told() -> Iterator[tuple]:
            values = np.sort(np.concatenate(list(kept.values())))
            yield tuple(zip(*((k, len(v), packed(v)) for k, v in dealt(short(values, 8))), strict=True))

        for _, sets in slices:
            for s in sets:
                if len(s) and (c := class_of(s)) not in kept:
                    kept[c] = s
                    n += len(s)
            if n >= GATHERED:
                yield from told()
                kept, n = {}, 0
        if kept:
            yield from told()

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values: dict[int, list[np.ndarray]] = {}
        for k, n, raw in _rows(batches, "bucket", "n", "shingles"):
            values.setdefault(k, []).append(unpacked(raw, n))
        for k in list(values):
            token, n = np.unique(np.concatenate(values.pop(k)), return_counts=True)
            often = n > COMMON
            token = token.astype(np.uint64) * U64(buckets) + U64(k)
            yield pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(n[often], pa.int64())], names=["token", "n"])

    counts = _sets(docs, size, all_of, "bucket bigint, n bigint, shingles binary").repartition(buckets, "bucket").mapInArrow(frequent, "token bigint, n bigint")
    common = counts.orderBy(F.desc("n"), "token").limit(MOST_COMMON).toArrow()  # a statistic of bounded size
    token = common["token"].to_numpy().view(np.uint64)
    order = np.argsort(token)
    spark = docs.sparkSession
    sent_counts = spark.sparkContext.broadcast((token[order], common["n"].to_numpy()[order]))

    def rarest(slices: Iterator) -> Iterator[tuple]:
        token, often = sent_counts.value
        seen: set[int] = set()
        for _, sets in slices:
            out = {}
            for s in sets:
                if len(s) and (c := class_of(s)) not in seen:
                    seen.add(c)
                    if len(token):
                        at = np.minimum(np.searchsorted(token, short(s, 8)), len(token) - 1)
                        n = np.where(token[at] == short(s, 8), often[at], 0)
                        s = s[np.argsort(n, kind="stable")] if n.any() else s
                    out[c] = len(s), s[: prefix_size(len(s), percent)].tobytes()
            yield list(out), [n for n, _ in out.values()], [x for _, x in out.values()]

    # Stored between the two Python steps, so that no task runs both at once.
    firsts_stored = stored(_sets(docs, size, rarest, "class bigint, n bigint, firsts binary"), "firsts", "snappy")
    firsts = firsts_stored.join(_few(groups), "class", "left")
    firsts = firsts.select("class", "n", "firsts", F.coalesce("component", "class").alias("component"), F.coalesce("members", F.lit(1)).alias("members"), F.coalesce("mixed", F.lit(0)).alias("mixed"), F.coalesce("grp", "class").alias("grp"))

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [np.frombuffer(x, "<u8") for x in b.column("firsts").to_pylist()]
            if values:
                n = [len(v) for v in values]
                c, p, m, g, size, mixed = (np.repeat(b.column(x).to_numpy(), n) for x in ("class", "component", "members", "grp", "n", "mixed"))
                place = np.concatenate([np.arange(k, dtype="<u4") for k in n])
                # Most classes are alone: what equals the class becomes zero, which is small once compressed.
                k, *columns = zip(*dealt(short(np.concatenate(values)), c, p ^ c, (2 * np.log2(m).astype("u1") + mixed).astype("u1"), g ^ c, size.astype("<u4"), place), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), *(pa.array([v.tobytes() for v in x], pa.binary()) for x in columns)], names=["bucket", "token", "class", "component", "members", "grp", "n", "place"])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[list[bytes]]] = {}
        for b in batches:
            columns = [b.column(x).to_pylist() for x in ("bucket", "token", "class", "component", "members", "grp", "n", "place")]
            for k, *x in zip(*columns, strict=True):
                for to, v in zip(own.setdefault(k, [[] for _ in x]), x, strict=True):
                    to.append(v)
        for k in list(own):
            t, c, p, m, g, n, at = (np.frombuffer(b"".join(v), d) for v, d in zip(own.pop(k), ("<u4", "<i8", "<i8", "u1", "<i8", "<u4", "<u4"), strict=True))
            order = np.argsort(t, kind="stable")
            t, c, p, m, g, n, at = t[order], c[order], p[order] ^ c[order], m[order], g[order] ^ c[order], n[order], at[order]
            heads = runs(t)
            ends = np.append(heads[1:], len(t))
            several = ends - heads > 1
            found: set[tuple[int, int]] = set()
            for a, z in zip(heads[several].tolist(), ends[several].tolist(), strict=True):
                if (p[a:z] == p[a]).all() and not m[a] & 1:
                    continue
                # Groups of the element by (magnitude, component), with their sizes and the element's first place: a query looks at those of
                # larger components. The first shared element at places i and j leaves an overlap of at most
                # min(|q| - i, |d| - j); a link needs (t / (1 + t)) (|q| + |d|).
                seen: dict[tuple, list[int]] = {}
                for *key, x, i in zip(m[a:z].tolist(), p[a:z].tolist(), g[a:z].tolist(), n[a:z].tolist(), at[a:z].tolist(), strict=True):
                    r = seen.setdefault(tuple(key), [x, x, x - i])
                    r[:] = min(r[0], x), max(r[1], x), max(r[2], x - i)
                keys = sorted(seen)
                low, high, left = np.array([seen[x] for x in keys]).T
                ids = np.array([x[2] for x in keys], np.int64)
                ranks = {x: r for r, x in enumerate(dict.fromkeys(x[:2] for x in keys))}
                rank = np.array([ranks[x[:2]] for x in keys])
                mixed = np.array([x[0] & 1 for x in keys])
                for q, x, i, *mine in zip(c[a:z].tolist(), n[a:z].tolist(), at[a:z].tolist(), m[a:z].tolist(), p[a:z].tolist(), strict=True):
                    # From groups of unlinked classes to themselves, too.
                    fits = (rank + mixed > ranks[tuple(mine)]) & (rank >= ranks[tuple(mine)]) & (100 * low <= x * 10000 // percent) & (100 * high >= percent * x)
                    least = np.maximum(low, -(-percent * x // 100))
                    fits &= (100 + percent) * np.minimum(x - i, left) >= percent * (x + least)
                    found.update((q, h) for h in ids[fits].tolist())
                if len(found) > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["class", "grp"])
                    found = set()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["class", "grp"])

    met = firsts.mapInArrow(matrix, "bucket bigint, token binary, class binary, component binary, members binary, grp binary, n binary, place binary").repartition(buckets, "bucket").mapInArrow(candidates, "class bigint, grp bigint")
    met = stored(met.distinct(), "met")
    forget(firsts_stored)
    # 3. Bounds, and the groups that pass.
    if met.isEmpty():
        more = None
    else:
        asking = _salted(met.withColumnRenamed("grp", "key")).withColumns({"asks": F.lit(1), "component": F.lit(None).cast("bigint")})
        asked = stored(asking.select("key", "salt").distinct(), "asked")
        inside = groups.select("class", F.col("grp").alias("key"), F.when(F.col("mixed") == 1, F.col("class")).otherwise(F.col("component")).alias("component")).join(asked, "key")
        alone = asked.join(groups.select(F.col("grp").alias("key")).distinct(), "key", "left_anti").select(F.col("key").alias("class"), "key", F.col("key").alias("component"), "salt")
        inside = inside.unionByName(alone).withColumn("asks", F.lit(0))
        more = stored(sent(asking.unionByName(inside)).mapInArrow(_opened(percent), "a bigint, b bigint"), "links")
    # 4. Components of all links.
    final = parts if more is None or more.isEmpty() else components(stars.unionByName(more))
    of = rows.join(final.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    low = of.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked_rows = of.where("n > 0").join(low, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked_rows.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def links(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``a, b, class_a, class_b, n_both, n_either``: every link between two classes, once, with the least id of each (null where all are).

    All pairs that share an element among their first ones are compared, so work and rows grow with the square of a large family, as the links do.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def whole(slices: Iterator) -> Iterator[tuple]:
        for ids, sets in slices:
            kept = [(i, class_of(s), s.view(np.int64)) for i, s in zip(ids, sets, strict=True) if len(s)]
            yield [i for i, _, _ in kept], [c for _, c, _ in kept], [s for _, _, s in kept]

    rows = _sets(docs, size, whole, "doc_id bigint, class bigint, shingles array<bigint>")
    classes = stored(rows.groupBy("class").agg(F.min("doc_id").alias("id"), F.first("shingles").alias("s")).withColumn("n", F.size("s").cast("bigint")), "all")
    # The sets are in one order, so two that are linked share an element of their prefixes.
    length = (F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9) + 1).cast("int")
    firsts = classes.select("class", "n", F.explode(F.slice("s", 1, length)).alias("t"))
    near = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    pairs = firsts.join(firsts.toDF("other", "m", "t"), "t").where((F.col("class") < F.col("other")) & near).select("class", "other").distinct()
    both = pairs.join(classes, "class").join(classes.toDF("other", "id_b", "s_b", "m"), "other").withColumn("n_both", F.size(F.array_intersect("s", "s_b")).cast("bigint"))
    both = both.withColumn("n_either", F.col("n") + F.col("m") - F.col("n_both")).where(100 * F.col("n_both") >= percent * F.col("n_either"))
    return both.select(F.col("id").alias("a"), F.col("id_b").alias("b"), F.col("class").alias("class_a"), F.col("other").alias("class_b"), "n_both", "n_either")
