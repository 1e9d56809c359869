"""Sparse retrieval: hashed term vectors as integer rows, top-k by cosine, and retrieval metrics.

Weights are integer counts, so dot products and squared norms are exact under any partitioning; the one
division happens at the end, and ties fall to the position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import text as T
from tallyspark.functions import vec


def doc_frequency(docs: DataFrame) -> DataFrame:
    """(token, df) over (id, text)."""
    return docs.select("id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.countDistinct("id").alias("df"))


def mine_probes(docs: DataFrame, n: int = 3) -> DataFrame:
    """(id, query): the n rarest tokens of each document in the order (df, token)."""
    tok = docs.select("id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token")).distinct()
    df = tok.groupBy("token").agg(F.count("*").alias("df"))
    best = tok.join(df, "token").withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("df", "token"))).where(F.col("rn") <= n)
    return best.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rn", "token"))).alias("x")).select("id", F.array_join(F.transform("x", lambda v: v["token"]), " ").alias("query"))


def sparse(df: DataFrame, key: list[str], slots: Column) -> DataFrame:
    """key, bucket, w: non-zero signed counts of each text's token slots."""
    rows = df.select(*key, F.explode(slots).alias("s")).select(*key, "s.bucket", "s.sign")
    return rows.groupBy(*key, "bucket").agg(F.sum("sign").cast("bigint").alias("w")).where(F.col("w") != 0)


def norms(vectors: DataFrame, key: list[str]) -> DataFrame:
    return vectors.groupBy(*key).agg(F.sum(F.col("w") * F.col("w")).alias("nn"))


#: Entries of query vectors that are sent to every chunk at once; beyond, queries and chunks meet by bucket.
BROADCAST_ENTRIES = 2_000_000


def scores(queries: DataFrame, chunks: DataFrame, query_key: str, chunk_key: list[str]) -> DataFrame:
    """Cosine of every query with every chunk it shares a bucket with: a bucket equi-join that sums before it divides.

    Queries of a checked size are broadcast, so that a chunk's products are summed where its rows are and only one row
    for each query and chunk is shuffled; larger ones join by bucket.
    """
    a = queries.select(query_key, "bucket", F.col("w").alias("qw"))
    if a.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES:
        a = F.broadcast(a)
    dots = a.join(chunks, "bucket").groupBy(query_key, *chunk_key).agg(F.sum(F.col("qw") * F.col("w")).alias("dot"))
    qn = norms(queries, [query_key]).withColumnRenamed("nn", "qn")
    cn = norms(chunks, chunk_key).withColumnRenamed("nn", "cn")
    both = dots.join(qn, query_key).join(cn, chunk_key)
    return both.withColumn("sim", F.col("dot") / F.sqrt(F.col("qn").cast("double") * F.col("cn").cast("double")))


def top_k(scored: DataFrame, query_key: str, position: list[str], k: int, without: DataFrame | None = None) -> DataFrame:
    """The k best of each query with rank; ties by position. ``without`` (query_key, position...) are never returned.

    Each map task keeps its own k best of a query before the shuffle (the planner's limit on a window's rank).
    """
    if without is not None:
        scored = scored.join(without.select(query_key, *position).distinct(), [query_key, *position], "left_anti")
    w = Window.partitionBy(query_key).orderBy(F.desc("sim"), *position)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def argmax(scored: DataFrame, query_key: str, position: str) -> DataFrame:
    """The first of the best of each query, by one aggregate."""
    best = scored.groupBy(query_key).agg(F.max(F.col("sim")).alias("top"))
    at = scored.join(best, query_key).where(F.col("sim") == F.col("top"))
    return at.groupBy(query_key).agg(F.min(position).alias(position), F.max("sim").alias("sim"))


def top_docs(scored: DataFrame, query_key: str, doc: str, position: str, k: int) -> DataFrame:
    """The k best documents of each query: each by its best chunk, the first of equals."""
    best = scored.groupBy(query_key, doc).agg(F.max(F.struct("sim", (-F.col(position)).alias("neg"))).alias("b"))
    flat = best.select(query_key, doc, F.col("b.sim").alias("sim"), (-F.col("b.neg")).alias("chunk_no"))
    return top_k(flat, query_key, ["chunk_no", doc], k)


def best_k(queries: DataFrame, chunks: DataFrame, query_key: str, chunk_key: list[str], k: int, doc: str | None = None) -> DataFrame:
    """(query_key, chunk_key..., sim, rank) of ``top_k`` over ``scores``; with ``doc``, (query_key, doc, chunk_no, sim, rank) of ``top_docs``.

    Chunks are rows of ``sparse``, or one row for each chunk with its ``slots``, which then needs no shuffle at all.
    Queries of a checked size travel to the chunks as one matrix. A batch of chunks meets it in one product, and only
    its k best of each query leave it: no pair is ever a row. Larger query sets go by ``scores``.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    position = next((c for c in chunk_key if c != doc), doc)
    size = queries.agg(F.countDistinct(query_key).alias("n"), F.countDistinct("bucket").alias("width"), F.count("*").alias("entries")).first()
    if size["n"] * size["width"] > BLOCK_NUMBERS or size["entries"] > BROADCAST_ENTRIES:
        vectors = sparse(chunks, chunk_key, F.col("slots")) if "slots" in chunks.columns else chunks
        scored = scores(queries, vectors, query_key, chunk_key)
        return top_docs(scored, query_key, doc, position, k) if doc else top_k(scored, query_key, chunk_key, k)
    held = queries.select(query_key, "bucket", "w").toArrow().combine_chunks()
    ids = pc.unique(held[query_key].combine_chunks()) if held.num_rows else held[query_key].combine_chunks()
    buckets = np.unique(held["bucket"].to_numpy())
    q = np.zeros((len(ids), len(buckets)))
    np.add.at(q, (np.asarray(pc.index_in(held[query_key].combine_chunks(), ids)), np.searchsorted(buckets, held["bucket"].to_numpy())), held["w"].to_numpy())
    shared = queries.sparkSession.sparkContext.broadcast((ids, buckets, q))
    if "slots" in chunks.columns:
        rows = chunks.select(*chunk_key, F.transform("slots", lambda s: F.struct(s["bucket"].alias("bucket"), s["sign"].alias("w"))).alias("m"))
    else:
        rows = chunks.groupBy(*chunk_key).agg(F.collect_list(F.struct("bucket", "w")).alias("m"))
    kinds = dict(chunks.dtypes) | dict(queries.dtypes)

    def best(batches):
        ids, buckets, q = shared.value
        if not len(ids):
            return
        own, has, step = (q * q).sum(1), (q != 0).astype(float), max(64, BLOCK_NUMBERS // len(ids))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                m = batch.column("m")
                inner = m.flatten()
                keys, values = (inner.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("bucket", "w"))
                row = np.repeat(np.arange(len(m)), np.diff(m.offsets.to_numpy()))
                width = int(keys.max()) + 1 if len(keys) else 1
                cells, place = np.unique(row * width + keys, return_inverse=True)
                values = np.bincount(place, values, len(cells))
                row, keys = cells // width, cells % width
                norm = np.bincount(row, values * values, len(m))
                at = np.minimum(np.searchsorted(buckets, keys), len(buckets) - 1)
                known = buckets[at] == keys
                c = np.zeros((len(m), len(buckets)))
                c[row[known], at[known]] = values[known]
                sims = (q @ c.T) / np.sqrt(own[:, None] * np.where(norm > 0, norm, 1)[None, :])
                sims[has @ (c != 0).T.astype(float) == 0] = -np.inf  # no bucket in common
                order = [position, doc] if doc else chunk_key
                ranks = [np.asarray(pc.rank(batch.column(n), "ascending", tiebreaker="dense")).astype(np.int64) for n in order]
                top = sims
                if doc:  # the best of each document
                    by = np.argsort(ranks[1], kind="stable")
                    top = np.maximum.reduceat(sims[:, by], np.flatnonzero(np.diff(ranks[1][by], prepend=-1)), axis=1)
                least = np.partition(top, -k, axis=1)[:, -k] if top.shape[1] > k else np.full(len(sims), -np.inf)
                qs, cs = [], []
                for j in range(len(sims)):
                    line = np.flatnonzero((sims[j] >= least[j]) & (sims[j] > -np.inf))
                    line = line[np.lexsort((*[r[line] for r in reversed(ranks)], -sims[j, line]))]
                    if doc:  # of each document the first
                        line = line[np.sort(np.unique(ranks[1][line], return_index=True)[1])]
                    line = line[:k]
                    qs.append(np.full(len(line), j)), cs.append(line)
                qs, cs = np.concatenate(qs), np.concatenate(cs)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(qs)), *[batch.column(n).take(pa.array(cs)) for n in chunk_key], pa.array(sims[qs, cs])], [query_key, *chunk_key, "sim"])

    fields = ", ".join(f"{n} {kinds[n]}" for n in [query_key, *chunk_key])
    scored = rows.mapInArrow(best, f"{fields}, sim double")
    return top_docs(scored, query_key, doc, position, k) if doc else top_k(scored, query_key, chunk_key, k)


def recall_at_k(ranked: DataFrame, gold: DataFrame, query_key: str, item: str) -> DataFrame:
    """One row: share of gold rows found; 1.0 without queries."""
    hit = gold.join(ranked.select(query_key, item, F.lit(1).alias("hit")).distinct(), [query_key, item], "left")
    return hit.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0)).alias("recall"))


#: Characters of the passages that one broadcast holds, about; more passages are taken in several passes over the documents.
PASSAGE_CHARS = 8_000_000


def containing(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, id): the documents (id, text) in which a passage (qid, passage) stands literally. A null is in nothing, an empty one in every text."""
    size = passages.agg(F.coalesce(F.sum(F.length("passage") + 16), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // PASSAGE_CHARS))
    out = None
    for b in range(blocks):
        block = passages if blocks == 1 else passages.where(F.pmod(F.xxhash64("qid", "passage"), F.lit(blocks)) == b)
        found = docs.join(F.broadcast(block), F.expr("contains(text, passage)")).select("qid", "id")
        out = found if out is None else out.unionByName(found)
    return out


#: Numbers of query vectors that one pass holds (8 bytes each); more queries are taken in several passes.
BLOCK_NUMBERS = 4_000_000


def dense_top_k(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(qid, id, sim, rank) over dense arrays (a zero vector is like nothing); ties by id.

    The query vectors travel to the items in blocks of a checked size. Each batch of items meets a block in one matrix
    product, and only a batch's k best of each query leave it, so no pair is ever a row.
    """
    import numpy as np
    import pyarrow as pa

    spark = items.sparkSession
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("width")).first()
    blocks = max(1, -(-size["n"] * size["width"] // BLOCK_NUMBERS))
    kinds = dict(queries.dtypes)["qid"], dict(items.dtypes)["id"]

    def matrix(column: pa.Array) -> np.ndarray:
        rows = np.array(column.to_pylist(), float).reshape(len(column), -1)
        length = np.sqrt((rows * rows).sum(1, keepdims=True))
        return rows / np.where(length == 0, 1, length)

    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        held = part.select("qid", "v").toArrow().combine_chunks()  # a block: at most BLOCK_NUMBERS numbers, about
        if not held.num_rows:
            continue
        shared = spark.sparkContext.broadcast((held["qid"].combine_chunks(), matrix(held["v"].combine_chunks())))

        def best(batches, shared=shared):
            qids, q = shared.value
            for batch in batches:
                for lo in range(0, batch.num_rows, 2048):
                    ids, v = batch.column("id").slice(lo, 2048), matrix(batch.column("v").slice(lo, 2048)).T
                    rank = np.asarray(pa.compute.rank(ids, "ascending", tiebreaker="dense"))
                    for start in range(0, len(q), 2048):
                        far = -np.round(q[start : start + 2048] @ v, 9)
                        # The k best of each query and their ties, few of all, are sorted; what isn't a number comes last.
                        kth = np.partition(far, k - 1, axis=1)[:, k - 1] if far.shape[1] > k else np.full(len(far), np.inf)
                        rows, columns = np.nonzero(~(far > kth[:, None]))
                        order = np.lexsort((rank[columns], far[rows, columns], rows))
                        order = order[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]
                        rows, columns = rows[order], columns[order]
                        yield pa.RecordBatch.from_arrays([qids.take(pa.array(rows + start)), ids.take(pa.array(columns)), pa.array(-far[rows, columns])], ["qid", "id", "sim"])

        scored = items.select("id", "v").mapInArrow(best, f"qid {kinds[0]}, id {kinds[1]}, sim double")
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        out = spark.createDataFrame([], f"qid {kinds[0]}, id {kinds[1]}, sim double")
    return top_k(out, "qid", ["id"], k)


# ---------------------------------------------------------------- metrics over ranked lists


def ndcg(ranked: DataFrame, relevant: DataFrame, query_key: str, item: str, k: int) -> DataFrame:
    """(query, ndcg): binary gains; the ideal has min(judged, k) hits; 0 for queries without judged items."""
    judged = relevant.select(query_key, item).distinct()
    hits = ranked.join(judged, [query_key, item]).groupBy(query_key).agg(F.sum(1.0 / F.log2(F.col("rank") + 1)).alias("dcg"))
    n = judged.groupBy(query_key).agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + 1))
    every = ranked.select(query_key).distinct()
    return every.join(n, query_key, "left").join(hits, query_key, "left").select(query_key, F.when(F.col("n") > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg"))


def rbo(a: DataFrame, b: DataFrame, query_key: str, item: str, p: float = 0.9) -> DataFrame:
    """(query, rbo): rank-biased overlap of two ranked lists, normalised over the depths seen; 1 if both are empty."""
    la = a.groupBy(query_key).agg(F.max("rank").alias("na"))
    lb = b.groupBy(query_key).agg(F.max("rank").alias("nb"))
    depth = la.join(lb, query_key, "full_outer").select(query_key, F.greatest(F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))).alias("depth"))
    shared = a.select(query_key, item, F.col("rank").alias("ra")).join(b.select(query_key, item, F.col("rank").alias("rb")), [query_key, item])
    at = shared.groupBy(query_key).agg(F.collect_list(F.greatest("ra", "rb")).alias("at"))  # at most k entries
    both = depth.join(at, query_key, "left").withColumn("at", F.coalesce("at", F.array().cast("array<int>")))
    overlap = lambda d: F.size(F.filter("at", lambda x: x <= d)) / d.cast("double")
    ds = F.sequence(F.lit(1), F.col("depth"))
    top = F.aggregate(ds, F.lit(0.0), lambda s, d: s + F.pow(F.lit(p), d - 1) * overlap(d))
    base = F.aggregate(ds, F.lit(0.0), lambda s, d: s + F.pow(F.lit(p), d - 1))
    return both.select(query_key, F.when(F.col("depth") > 0, top / base).otherwise(1.0).alias("rbo"))
