"""Filling containers of fixed capacity with documents that belong together.

Documents are routed to shards by what they are about: centroids of a spherical k-means, fitted on a bounded sample of BM25
vectors, take every document of the corpus. Each shard has a bounded number of tokens and a BM25 index of its own over token
ids, with document frequencies and lengths of the whole corpus; as near documents have the same centroid, a seed finds
its neighbours there. The largest unused document seeds a container; the index scores all unused documents of the shard by
all terms of the seed, and the nearest fill the window greedily. The last gap takes the nearest document that fills it
exactly alone or with one more; documents that share no term come last, by size. What the shards' last containers
leave empty is filled by merging these. A document is split only if it alone exceeds the capacity: into full containers
and a rest that is packed like any other document.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, ship
from ..operators.batches import pieces
from .tokens import TOKENIZER_DIR, TOKENIZER_FILE, VOCABULARY, encode

#: Tokens for each centroid, and most centroids: the vocabulary times these is what workers get (25 MB at most).
CLUSTER_TOKENS, MOST_CLUSTERS = 1_000_000, 128
#: Most tokens in a shard: bounds a task's memory. A centroid with more (one text may be a third of all rows) has several shards, by hash.
SHARD_TOKENS = 8_000_000
#: Documents that the centroids are fitted on, and passes over them.
SAMPLE, PASSES = 6_000, 12
K1, B = 1.5, 0.75


def token_table(df: DataFrame, key: str, text: str, extra: list[str] | None = None, terms: bool = True, folder: str = TOKENIZER_DIR, vocabulary: str = TOKENIZER_FILE) -> DataFrame:
    """``key``, the columns ``extra``, ``n_tokens``, and (with ``terms``) distinct token ids with their counts.

    Null text counts as empty, with no tokens; texts are tokenized whole. A narrow pass.
    """
    ship(df.sparkSession)
    extra = extra or []
    df = df.select(key, *extra, F.col(text).alias("__text"))
    fields = [*df.schema.fields[:-1], T.StructField("n_tokens", T.LongType())]
    names = [f.name for f in fields]
    if terms:
        fields += [T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))]
    at = len(names) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, at):
                ids = encode([t or "" for t in part.column(at).to_pylist()], folder, vocabulary)
                columns = [*(part.column(i) for i in range(at)), pa.array(list(map(len, ids)), pa.int64())]
                if terms:
                    both = [np.unique(np.asarray(x, np.int32), return_counts=True) for x in ids]
                    columns += [pa.array([u for u, _ in both], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c in both], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "terms", "counts"] if terms else names)

    return df.mapInArrow(run, T.StructType(fields))


def document_frequencies(tokens: DataFrame) -> tuple[np.ndarray, int, float]:
    """Inverse document frequency by token id, number of documents and their mean length, over all documents.

    What comes to the driver has a row for each id of the vocabulary at most.
    """
    n, mean = tokens.where("n_tokens > 0").agg(F.count("*"), F.avg("n_tokens")).first()
    n = n or 0
    df = np.zeros(VOCABULARY)
    for term, count in tokens.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        df[term] = count
    return np.log1p((n - df + 0.5) / (df + 0.5)), n, float(mean or 1.0)


def bm25(size: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
    """What each term of each document adds to the score of a query that has the term. size: tokens of each document."""
    tf = tf.astype(float)
    return (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / mean))).astype(np.float32)


class Vectors:
    """BM25 vectors of some documents, end to end."""

    def __init__(self, sizes: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        self.begin = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), np.diff(self.begin))
        self.term = np.concatenate([*terms, np.zeros(0, np.int32)])
        self.weight = bm25(sizes, self.doc, self.term, np.concatenate([*counts, np.zeros(0, np.int32)]), idf, mean)

    def nearest(self, centroids: np.ndarray, at_once: int = 200_000) -> np.ndarray:
        """Number of the centroid (columns of a table by term) with the largest dot product; each document has a term."""
        out = np.zeros(len(self.begin) - 1, np.int32)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.begin, self.begin[i] + at_once, side="right")) - 1)
            a, b = self.begin[i], self.begin[j]
            out[i:j] = np.add.reduceat(centroids[self.term[a:b]] * self.weight[a:b, None], self.begin[i:j] - a, axis=0).argmax(1)
            i = j
        return out


def fit_centroids(v: Vectors, k: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means: a column of unit length for each of ``k`` centroids, a row for each term."""
    n = len(v.begin) - 1
    length = np.sqrt(np.add.reduceat(v.weight.astype(float) ** 2, v.begin[:-1]))
    v.weight = (v.weight / length[v.doc]).astype(np.float32)
    rng = np.random.default_rng(seed)
    chosen = rng.choice(n, k, replace=k > n)
    own = np.full(n, -1)
    centroids = np.zeros((VOCABULARY, k), np.float32)
    for no in range(PASSES + 1):
        if no:
            own = v.nearest(centroids)
            sums = np.bincount(v.term.astype(np.int64) * k + own[v.doc], weights=v.weight, minlength=VOCABULARY * k).reshape(VOCABULARY, k)
            norm = np.linalg.norm(sums, axis=0)
            chosen = np.where(norm > 0, -1, rng.integers(0, n, k))  # a centroid without documents begins anew
            centroids = (sums / np.maximum(norm, 1e-9)).astype(np.float32)
        for c in np.flatnonzero(chosen >= 0).tolist():
            a, b = v.begin[chosen[c]], v.begin[chosen[c] + 1]
            centroids[:, c] = 0
            centroids[v.term[a:b], c] = v.weight[a:b]
    return centroids


def routed(tokens: DataFrame, idf: np.ndarray, n: int, mean: float, cluster_tokens: int = CLUSTER_TOKENS, shard_tokens: int = SHARD_TOKENS, sample: int = SAMPLE) -> tuple[DataFrame, int]:
    """``tokens`` with column ``shard``, and the number of shards.

    The centroids, one for each ``cluster_tokens`` tokens (``MOST_CLUSTERS`` at most), are fitted by the driver on about ``sample``
    documents chosen by hash; every document goes to its nearest one, in a narrow pass. The driver reads the tokens of each
    centroid; one with more than ``shard_tokens`` has several shards, by hash.
    """
    spark = tokens.sparkSession
    k = min(MOST_CLUSTERS, max(1, math.ceil(mean * n / cluster_tokens)))
    per_million = min(1_000_000, math.ceil(sample * 1_000_000 / max(1, n)))
    chosen = tokens.where(F.pmod(F.xxhash64(F.lit("fit"), "item"), F.lit(1_000_000)) < per_million).select("item", "n_tokens", "terms", "counts").orderBy("item").toArrow() if k > 1 else None
    if chosen is None or chosen.num_rows < k:
        parts = max(1, math.ceil(mean * n / shard_tokens))
        return tokens.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int")), parts
    centroids = fit_centroids(Vectors(chosen.column("n_tokens").to_numpy(), _lists(chosen.column("terms")), _lists(chosen.column("counts")), idf, mean), k)
    shared = spark.sparkContext.broadcast((centroids, idf))  # bounded by the vocabulary
    names = tokens.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, weights = shared.value
        for batch in batches:
            if batch.num_rows:
                of = {c: batch.column(names.index(c)) for c in ("n_tokens", "terms", "counts")}
                own = Vectors(of["n_tokens"].to_numpy(), _lists(of["terms"]), _lists(of["counts"]), weights, mean).nearest(table)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], names=[*names, "cluster"])

    clustered = materialize(tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField("cluster", T.IntegerType())])), "clustered")
    size = {r["cluster"]: r["t"] for r in clustered.groupBy("cluster").agg(F.sum("n_tokens").alias("t")).collect()}
    parts = [max(1, math.ceil(size.get(c, 0) / shard_tokens)) for c in range(k)]
    first = np.concatenate([[0], np.cumsum(parts)]).tolist()
    pick = lambda values: F.array(*map(F.lit, values))[F.col("cluster")]
    return clustered.withColumn("shard", (pick(first[:-1]) + F.pmod(F.xxhash64("item"), pick(parts))).cast("int")).drop("cluster"), first[-1]


def pack(sizes: np.ndarray, lengths: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray], capacity: int, idf: np.ndarray, mean: float) -> list[list[tuple[int, bool]]]:
    """Containers of one shard, as lists of (item number, whether it shares a term with the seed); the first is the seed.

    sizes: tokens of each item, from 1 to ``capacity``; lengths: those of the whole document, by which BM25 scores it.
    """
    n = len(sizes)
    v = Vectors(lengths, terms, counts, idf, mean)
    unused = np.ones(n, bool)
    of_size = np.bincount(sizes, minlength=capacity + 1)  # unused items of each size
    typical = int(np.median(sizes)) if n else 0
    index, left = Index(v, np.arange(n)), n
    ready: dict[int, np.ndarray] = {}
    out: list[list[tuple[int, bool]]] = []

    def take(i: int) -> int:
        unused[i] = False
        of_size[sizes[i]] -= 1
        return int(sizes[i])

    seeds = np.lexsort((np.arange(n), -sizes))  # the largest first
    for at, seed in enumerate(seeds.tolist()):
        if not unused[seed]:
            continue
        room = capacity - take(seed)
        box = [(seed, True)]
        out.append(box)
        if room and of_size[: room + 1].any():
            if left < len(index.items) / 2:  # used items leave the index
                index, ready = Index(v, np.flatnonzero(unused)), {}
            if seed not in ready:  # scores don't depend on what is used, so some seeds are scored at once
                ahead = [seed, *seeds[at + 1 :][unused[seeds[at + 1 :]]][: AT_ONCE - 1].tolist()]
                ready = dict(zip(ahead, index.scores([v.term[v.begin[i] : v.begin[i + 1]] for i in ahead]), strict=True))
            score = np.zeros(n, np.float32)
            score[index.items] = ready.pop(seed)
            queue: list[int] = []
            some = FIRST
            while room and of_size[: room + 1].any():
                if room > 2 * typical:
                    while queue and (not unused[queue[-1]] or sizes[queue[-1]] > room):
                        queue.pop()
                    if not queue:
                        queue, some = _nearest(np.flatnonzero(unused & (sizes <= room)), sizes, score, some), some * 8
                        continue
                    picked = [queue.pop()]
                else:
                    picked = _closing(np.flatnonzero(unused & (sizes <= room)), sizes, score, of_size, room)
                for i in picked:
                    room -= take(i)
                    box.append((i, bool(score[i] > 0)))
        left -= len(box)
    return out


#: Seeds that are scored at once.
AT_ONCE = 32
#: Terms in more than this share of the items are held as dense rows, all others as postings.
DENSE_SHARE = 1 / 8


class Index:
    """BM25 index of some of the documents ``v``. Query terms count once; a score is the sum over all terms of the query."""

    def __init__(self, v: Vectors, items: np.ndarray) -> None:
        self.items = items
        column = np.full(len(v.begin) - 1, -1)
        column[items] = np.arange(len(items))
        held = column[v.doc] >= 0
        term, column, weight = v.term[held], column[v.doc[held]], v.weight[held]
        order = np.argsort(term, kind="stable")
        term, self.column, self.weight = term[order], column[order], weight[order]
        known, first, df = np.unique(term, return_index=True, return_counts=True)
        common = df > len(items) * DENSE_SHARE
        self.span = {t: (s, s + c) for t, s, c in zip(known[~common].tolist(), first[~common].tolist(), df[~common].tolist(), strict=True)}
        self.row = {t: i for i, t in enumerate(known[common].tolist())}
        self.dense = np.zeros((len(self.row), len(items)), np.float32)
        for i, (s, c) in enumerate(zip(first[common].tolist(), df[common].tolist(), strict=True)):
            self.dense[i, self.column[s : s + c]] = self.weight[s : s + c]

    def scores(self, queries: list[np.ndarray]) -> np.ndarray:
        """A row of scores, one for each item, for each query (an array of terms)."""
        asked = np.zeros((len(queries), len(self.row)), np.float32)
        for i, q in enumerate(queries):
            asked[i, [r for t in q.tolist() if (r := self.row.get(t)) is not None]] = 1
        out = asked @ self.dense
        for score, q in zip(out, queries, strict=True):
            for t in q.tolist():
                if span := self.span.get(t):
                    s, e = span
                    score[self.column[s:e]] += self.weight[s:e]  # an item occurs once in a term's postings
        return out


#: Nearest items that a seed sorts at first; it sorts more if these don't fill its container.
FIRST = 128


def _nearest(fit: np.ndarray, sizes: np.ndarray, score: np.ndarray, some: int) -> list[int]:
    """At least ``some`` of the items with the highest scores (ties: the larger, then the first), the best one last."""
    if len(fit) > some:
        fit = fit[score[fit] >= np.partition(score[fit], len(fit) - some)[len(fit) - some]]
    return fit[np.lexsort((fit, -sizes[fit], -score[fit]))][::-1].tolist()


def _best(items: np.ndarray, sizes: np.ndarray, score: np.ndarray) -> int:
    items = items[score[items] == score[items].max()]
    return int(items[np.argmax(sizes[items])])


def _closing(fit: np.ndarray, sizes: np.ndarray, score: np.ndarray, of_size: np.ndarray, room: int) -> list[int]:
    """The nearest item that fills the room up to at most seven tokens, alone or with the nearest one of the size that is missing, else the nearest.

    fit: the unused items up to the room, in order; of_size: how many of each size there are.
    """
    size = sizes[fit]
    for total in range(room, max(room - 8, 0), -1):
        missing = total - size
        pairs = (missing >= 0) & ((missing == 0) | (of_size[np.maximum(missing, 0)] > (missing == size)))
        if pairs.any():
            first = _best(fit[pairs], sizes, score)
            rest = total - int(sizes[first])
            return [first, _best(fit[(size == rest) & (fit != first)], sizes, score)] if rest else [first]
    return [_best(fit, sizes, score)]


def containers(
    df: DataFrame, key: str, text: str, limits: dict[str, int], folder: str = TOKENIZER_DIR, vocabulary: str = TOKENIZER_FILE,
    cluster_tokens: int = CLUSTER_TOKENS, shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Documents in containers: ``limit_name, container_id, item_no, key, piece_no, first_token, n_tokens, source``.

    limits: capacity by name. Each document is in one container of each limit, whole, unless it alone exceeds the capacity;
    then its pieces are consecutive token ranges, all but the last of them full containers. ``source`` tells how an item came
    there: ``whole`` (a piece that fills its container), ``seed``, ``neighbour`` (shares a term with the seed) or ``size``. Null and empty texts have
    no tokens and are in no container; equal texts and equal keys are packed like others; other columns are ignored; an
    empty table gives an empty one.

    Only term vectors are shuffled, once, never texts. No source, language or group of copies makes a shard larger than its bound.
    """
    ship(df.sparkSession)
    tokens = token_table(df, key, text, folder=folder, vocabulary=vocabulary).where("n_tokens > 0")
    tokens = materialize(tokens.withColumn("item", F.monotonically_increasing_id()), "tokens")
    idf, n, mean = document_frequencies(tokens)
    sharded, shards = routed(tokens, idf, n, mean, cluster_tokens, shard_tokens)
    key_type = df.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField("limit_name", T.StringType()), T.StructField("container_id", T.LongType()), T.StructField("item_no", T.IntegerType()), T.StructField(key, key_type), T.StructField("piece_no", T.IntegerType()),
            T.StructField("first_token", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("source", T.StringType()), T.StructField("box_tokens", T.LongType()),
        ]
    )
    shared_idf = df.sparkSession.sparkContext.broadcast(idf)  # one number for each id of the vocabulary
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def run(group: pa.Table) -> pa.Table:
        group = group.take(pa.compute.sort_indices(group, [("item", "ascending")])).combine_chunks()
        sizes = group.column("n_tokens").to_numpy()
        terms, counts = _lists(group.column("terms")), _lists(group.column("counts"))
        shard = group.column("shard")[0].as_py()
        rows: list[tuple] = []
        for name, capacity in limits.items():
            made = 0
            rest = sizes.copy()
            for i in np.flatnonzero(sizes > capacity).tolist():
                whole = int(sizes[i]) // capacity
                rows += [(name, shard << 32 | made + piece, 0, i, piece, piece * capacity, capacity, "whole", capacity) for piece in range(whole)]
                made += whole
                rest[i] = sizes[i] - whole * capacity
            some = np.flatnonzero(rest > 0)
            for box in pack(rest[some], sizes[some], [terms[i] for i in some], [counts[i] for i in some], capacity, shared_idf.value, mean):
                filled = int(rest[some[[i for i, _ in box]]].sum())
                for no, (k, near) in enumerate(box):
                    i = int(some[k])
                    piece = int(sizes[i]) // capacity if sizes[i] > capacity else 0
                    rows.append((name, shard << 32 | made, no, i, piece, int(sizes[i] - rest[i]), int(rest[i]), ("neighbour" if near else "size") if no else "seed", filled))
                made += 1
        columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
        columns[3] = group.column(key).take(columns[3])
        return pa.table(columns, names=[f.name for f in schema.fields])

    assigned = materialize(sharded.groupBy("shard").applyInArrow(run, schema), "containers")
    moved = merged_rest(assigned, limits, shards)
    both = assigned.join(moved, ["limit_name", "container_id"], "left")
    return both.select("limit_name", F.coalesce("into", "container_id").alias("container_id"), (F.col("item_no") + F.coalesce("shift", F.lit(0))).alias("item_no"), key, "piece_no", "first_token", "n_tokens", "source")


#: Containers filled less than this are merged, as wholes, with those of other shards.
WELL_FILLED = 0.95


def merged_rest(assigned: DataFrame, limits: dict[str, int], shards: int, group_size: int = 5000) -> DataFrame:
    """Where the poorly filled last containers of the shards go: ``limit_name, container_id, into, shift`` (of item numbers).

    There are about two of them in a shard. Groups of them are bounded by ``group_size`` shards; in each the fullest container
    that still fits joins the fullest one that is open.
    """
    capacity = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("limit_name")]
    poor = assigned.where(F.col("box_tokens") < WELL_FILLED * capacity).groupBy("limit_name", "container_id").agg(F.max("box_tokens").alias("tokens"), F.count("*").cast("int").alias("items"))
    poor = poor.withColumn("part", F.pmod(F.xxhash64("container_id"), F.lit(max(1, math.ceil(shards / group_size)))))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        room_of = limits[group["limit_name"].iloc[0]]
        group = group.sort_values(["tokens", "container_id"])
        left = list(zip(group["tokens"].tolist(), group["container_id"].tolist(), group["items"].tolist(), strict=True))
        out = []
        while left:
            tokens, into, shift = left.pop()
            out.append((into, into, 0))
            room = room_of - tokens
            while left and left[0][0] <= room:
                more, moved, items = left.pop(bisect_right(left, room, key=lambda x: x[0]) - 1)
                out.append((moved, into, shift))
                room, shift = room - more, shift + items
        return pd.DataFrame(out, columns=["container_id", "into", "shift"]).assign(limit_name=group["limit_name"].iloc[0])[["limit_name", "container_id", "into", "shift"]]

    return poor.groupBy("limit_name", "part").applyInPandas(merge, "limit_name string, container_id bigint, into bigint, shift int")


def _lists(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def fill_report(assigned: DataFrame, limits: dict[str, int]) -> DataFrame:
    """``limit_name, capacity, n_containers, n_items, n_tokens, fill`` (share of the room that is used)."""
    capacity = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]) if limits else F.create_map()
    boxes = assigned.groupBy("limit_name", "container_id").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"))
    report = boxes.groupBy("limit_name").agg(F.count("*").alias("n_containers"), F.sum("items").alias("n_items"), F.sum("tokens").alias("n_tokens"))
    report = report.withColumn("capacity", capacity[F.col("limit_name")])
    return report.select("limit_name", "capacity", "n_containers", "n_items", "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("fill"))
