"""N-gram Jaccard self-join: MinHash banding retrieves candidates, full shingle sets verify them.

Shingles are runs of five words (ASCII letters without case, digits, non-ASCII characters); a text of one to
four words is a single shingle. Rows and bands follow from the threshold and the target recall.

1. One narrow pass makes a set key, the set's size and its band hashes for each document. Equal sets
   collapse to one node with a count before anything else, so copies cost nothing later.
2. Nodes shuffle on band hashes; a bucket, in slices, links its nodes to the least of their slice, and those to the
   bucket's least. Components of these candidate links are groups within which every candidate pair lies. A pair is a
   candidate if it shares a band and its sizes allow the similarity.
3. Each group, in blocks of bounded size, verifies its candidate pairs on full sets, and sends back
   only counts and a spanning forest of links. A group larger than a block is cut into chunks, and each pair of
   chunks is one block: every pair is verified in exactly one block, and none is emitted. A group of more than
   MOST_CHUNKS chunks may be no group at all but many that chance links join, so that most of its pairs are no
   candidates: its band buckets are the groups instead, and a pair is verified in the bucket of its first shared band.
4. Components of the forest are the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import Words, cut_lineage, doc_of, list_array, map_texts, mix, ngrams, text_buffers, words
from .components import components, slices, with_least

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.999
#: Candidates at or below this similarity are kept rare when rows are chosen.
UNLIKE = 0.4
BLOCK_SETS = 1024
BLOCK_SHINGLES = 1 << 20
BIN_SHINGLES = 1 << 20
#: Chunks of a group beyond which its band buckets are verified instead of all pairs of its chunks.
MOST_CHUNKS = 8
LOWEST_ID = -(1 << 63)


def banding(similarity: float = SIMILARITY, recall: float = RECALL, unlike: float = UNLIKE, most: int = 192) -> tuple[int, int]:
    """(bands, rows): the most rows, within ``most`` hashes, whose bands retrieve a pair at the threshold with the target recall."""
    fits = []
    for rows in range(1, 33):
        p = similarity**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows <= most:
            fits.append((1 - (1 - unlike**rows) ** bands, bands, rows))
    _, bands, rows = min(fits)
    return bands, rows


def shingle_rows(texts: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles, sorted."""
    data, offsets = text_buffers(texts)
    w: Words = words(data, offsets)
    at, h = ngrams(w, n)
    doc = doc_of(at, w.bounds)
    size = np.diff(w.bounds)
    for k in range(1, n):  # short texts
        few = np.flatnonzero(size == k)
        if len(few):
            own = np.zeros(len(few), np.uint64)
            for j in range(k):
                own = mix(own * np.uint64(31) + w.hashes[w.bounds[few] + j])
            doc, h = np.concatenate([doc, few]), np.concatenate([h, own])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[first], h[first]


def set_keys(doc: np.ndarray, h: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return mix(np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), heads)) if len(h) else np.zeros(0, np.uint64)


def _signer(n: int, bands: int, rows: int):
    odd = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def make():
        def fn(texts: pa.Array) -> list:
            doc, h = shingle_rows(texts, n)
            heads = np.flatnonzero(np.diff(doc, prepend=-1))
            has = doc[heads]
            keys = np.zeros(len(texts), np.uint64)
            sizes = np.bincount(doc, minlength=len(texts))
            keys[has] = set_keys(doc, h, heads)
            band = np.zeros((len(has), bands), np.uint64)
            for k in range(bands * rows if len(h) else 0):
                v = h * odd[k]
                v ^= v >> np.uint64(32)
                low = np.minimum.reduceat(v, heads)
                band[:, k // rows] = mix(band[:, k // rows] * np.uint64(0x9E3779B97F4A7C15) + low)
            counts = np.zeros(len(texts), np.int64)
            counts[has] = bands
            return [pa.array(keys.view(np.int64)), pa.array(sizes, pa.int32()), list_array(band.reshape(-1).view(np.int64), counts, pa.int64())]

        return fn

    return make


def linked_pairs(sets: list[np.ndarray], bands: np.ndarray, side: np.ndarray | None, similarity: float, first: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs (a < b) among candidates: pairs that share a band (``first``, if given, is the first that they share);
    with sides, one from each, so that a single side has none."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    found_a, found_b = [], []
    for lo in range(0, m, 256):
        hi = min(m, lo + 256)
        near = np.zeros((hi - lo, m), bool)
        for k in range(bands.shape[1] if first < 0 else first):
            near |= bands[lo:hi, k, None] == bands[None, :, k]
        if first >= 0:
            near = (bands[lo:hi, first, None] == bands[None, :, first]) & ~near
        near &= np.minimum(size[lo:hi, None], size) >= similarity * np.maximum(size[lo:hi, None], size) - 1e-9
        near &= np.arange(m)[None, :] > np.arange(lo, hi)[:, None]
        if side is not None:
            near &= side[lo:hi, None] != side[None, :]
        a, b = np.nonzero(near)
        found_a.append(a + lo), found_b.append(b)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    if not len(a):
        return a, b
    if len(a) <= max(200, 4 * m):
        shared = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)])
    else:
        shared = _intersections(sets, a, b, size)
    linked = shared >= similarity * (size[a] + size[b] - shared) - 1e-9
    return a[linked], b[linked]


def _intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Intersection sizes of many pairs of similar sets, from their differences to the majority set."""
    m = len(sets)
    _, col = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), size)
    freq = np.bincount(col)
    usual = freq * 2 > m
    # Difference of each set to the majority: its unusual shingles, and the usual ones that it lacks.
    has = np.zeros((m, int(usual.sum())), bool)
    rank = np.cumsum(usual) - 1
    own = usual[col]
    has[row[own], rank[col[own]]] = True
    lack_row, lack = np.nonzero(~has)
    row = np.concatenate([row[~own], lack_row])
    col = np.concatenate([col[~own], np.flatnonzero(usual)[lack]])
    extra = np.bincount(row, minlength=m)
    order = np.lexsort((row, col))
    row, col = row[order], col[order]
    head = np.flatnonzero(np.diff(col, prepend=-1))
    count = np.diff(np.append(head, len(col)))
    both = np.zeros(m * m, np.float32)
    for f in range(2, 9):  # rare differences: the few pairs of each
        at = head[count == f]
        for i, j in combinations(range(f), 2):
            both += np.bincount(row[at + i] * m + row[at + j], minlength=m * m).astype(np.float32) if len(at) else 0
    both = both.reshape(m, m)
    common = np.flatnonzero(count > 8)
    for lo in range(0, len(common), 1024):
        dense = np.zeros((m, min(1024, len(common) - lo)), np.float32)
        for j, c in enumerate(common[lo : lo + 1024]):
            dense[row[head[c] : head[c] + count[c]], j] = 1
        both += dense @ dense.T
    unlike = extra[a] + extra[b] - 2 * np.rint(both[a, b]).astype(np.int64)
    return (size[a] + size[b] - unlike) // 2


def forest(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component."""
    root = np.arange(m)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verifier(n: int, similarity: float):
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by([(c, "ascending") for c in ("comp", "band", "ci", "cj", "node")])
        if not t.num_rows:
            return
        block = np.stack([t[c].to_numpy() for c in ("comp", "band", "ci", "cj")], 1)
        edge = np.concatenate([[0], np.flatnonzero((block[1:] != block[:-1]).any(1)) + 1, [len(block)]])
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            part = t.slice(lo, hi - lo)
            texts = part["t"].combine_chunks()
            doc, h = shingle_rows(texts, n)
            bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
            node = part["node"].to_numpy()
            heads = np.flatnonzero(np.diff(doc, prepend=-1))
            key = np.zeros(len(texts), np.uint64)
            key[doc[heads]] = set_keys(doc, h, heads)
            good = np.flatnonzero(key.view(np.int64) == node)
            good = good[np.unique(node[good], return_index=True)[1]]
            if len(good) < 2:
                continue
            sets = [h[bounds[r] : bounds[r + 1]] for r in good]
            bands = np.stack([part["bands"][int(r)].values.to_numpy() for r in good])
            chunk = part["chunk"].to_numpy()[good]
            side = chunk == block[lo, 3] if block[lo, 2] != block[lo, 3] else None
            a, b = linked_pairs(sets, bands, side, similarity, part["band"][0].as_py())
            if not len(a):
                continue
            weight = part["copies"].to_numpy()[good]
            links = np.bincount(a, weight[b], len(good)) + np.bincount(b, weight[a], len(good))
            root = forest(len(good), a, b)
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[good][at]), pa.array(node[good][root[at]]), pa.array(links[at].astype(np.int64))], schema=schema)

    return run


def _bucket_links(nodes: DataFrame) -> DataFrame:
    """(a, b): links that connect the nodes of each band bucket; a bucket's rows are dealt in slices."""
    banded = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    n = slices(nodes.count())
    sliced = banded.withColumn("slice", F.pmod(F.xxhash64("node", F.lit(9)), F.lit(n)))
    first = sliced.withColumn("least", F.min("node").over(Window.partitionBy("band", "bucket", "slice")))
    heads = first.where("node = least").select("band", "bucket", "node")  # at most n rows a bucket
    second = heads.withColumn("least", F.min("node").over(Window.partitionBy("band", "bucket")))
    return first.select("node", "least").unionByName(second.select("node", "least")).where("node > least").select(F.col("node").alias("a"), F.col("least").alias("b"))


def _chunked(member: DataFrame) -> DataFrame:
    """Adds chunks, the number of parts that a group (comp, band) is cut into."""
    size = member.groupBy("comp", "band").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    size = size.where("members > 1").select("comp", "band", F.greatest(F.ceil(F.col("members") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("chunks"))
    return member.join(size, ["comp", "band"])


def _classes(docs: DataFrame, id_col: str, text_col: str, n: int, similarity: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Rows (i, th, key, n) with their set's key, and sets (key, least, n_links); least is the class's least (i, th)."""
    bands, rows = banding(similarity, recall)
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(LOWEST_ID)).alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).withColumn("th", F.xxhash64("t"))
    sig = cut_lineage(map_texts(base, _signer(n, bands, rows), [("key", "bigint"), ("n", "int"), ("bands", "array<bigint>")], ["i", "th"], "t"))
    # One text stands for each node, known by its id and hash, as rows may share an id and bring other texts.
    nodes = cut_lineage(sig.where("n > 0").groupBy(F.col("key").alias("node")).agg(F.min(F.struct("i", "th")).alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")))

    groups = cut_lineage(components(_bucket_links(nodes)).select("node", F.col("root").alias("comp")))
    member = _chunked(groups.join(nodes, "node").withColumn("band", F.lit(-1)))
    wide = member.where(F.col("chunks") > MOST_CHUNKS).drop("chunks", "band").select("*", F.posexplode("bands").alias("band", "bucket"))
    wide = _chunked(wide.withColumn("comp", F.xxhash64("band", "bucket")).drop("bucket"))
    member = cut_lineage(member.where(F.col("chunks") <= MOST_CHUNKS).unionByName(wide))
    total = member.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BIN_SHINGLES))
    # Every pair of chunks of a group is a block; a member goes to the blocks of its chunk.
    chunk = F.pmod(F.xxhash64("node", F.lit(3)), F.col("chunks")).cast("int")
    blocks = (
        member.withColumn("chunk", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("comp", "band", "node", "rep.i", "rep.th", "copies", "bands", "chunk", F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj"), "chunks")
        .withColumn("bin", F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("comp", "band"), F.lit(bins))).otherwise(F.xxhash64("comp", "band", "ci", "cj")))
    )
    texts = base.where("t is not null").dropDuplicates(["i", "th"])  # rows that repeat id and text are one
    with_text = blocks.join(texts, ["i", "th"]).select("bin", "comp", "band", "ci", "cj", "chunk", "node", "copies", "bands", "t")
    verified = cut_lineage(with_text.groupBy("bin").applyInArrow(_verifier(n, similarity), "node bigint, root bigint, links bigint"))

    classes = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    reps = nodes.join(classes, "node", "left").select("node", "copies", "rep", F.coalesce("root", "node").alias("root"))
    least = with_least(reps, "root", "rep", slices(0))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    return sig, least.join(links, "node", "left").select(F.col("node").alias("key"), F.col("m").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """id, class_id, n_links, n_shingles for each row.

    class_id is the least id of the rows connected by links (pairs with Jaccard similarity of shingle sets >=
    ``similarity``); n_links counts the other rows linked to this one, equal texts included. Rows with a null
    text or no words have no link and are their own class. Rows that repeat an id are rows of their own
    with links like any others; a null id sorts before all others and is a class id of its own. Ids are whole
    numbers: others are an error of the cast (in ANSI mode). Other columns are not read, whatever their names; texts are
    read whole, however long; an empty table gives no rows.
    """
    sig, sets = _classes(docs, id_col, text_col, n, similarity, recall)
    out = sig.where("n > 0").select("i", "key", "n").join(sets, "key").select("i", F.col("least.i").alias("class_id"), "n_links", "n")
    alone = sig.where("n = 0").select("i", F.col("i").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), "n")
    null = lambda c: F.when(F.col(c) != LOWEST_ID, F.col(c))
    return out.unionByName(alone).select(null("i").alias(id_col), null("class_id").alias("class_id"), "n_links", F.col("n").cast("bigint").alias("n_shingles"))


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The columns of ``docs`` and one row of each class of ``link``: that with the least id (null first), and of several
    with this id the one whose text has the least hash.

    Rows without words are classes of their own and stay. Of rows that repeat both id and text one stays, whichever
    if other columns differ. Columns may have any names.
    """
    sig, sets = _classes(docs, id_col, text_col, n, similarity, recall)
    worded = sig.where("n > 0").groupBy("i", "th").agg((F.count("*") > 1).alias("again"))
    kept = worded.join(sets.select("least.i", "least.th").distinct(), ["i", "th"]).unionByName(sig.where("n = 0").select("i", "th", F.lit(False).alias("again")).distinct())
    kept = cut_lineage(kept)
    own = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{j}") for j, c in enumerate(docs.columns)]).alias("row"), F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(LOWEST_ID)).alias("i"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("th"))
    once = own.join(kept.where("not again"), ["i", "th"], "left_semi")
    again = own.join(kept.where("again"), ["i", "th"], "left_semi").groupBy("i", "th").agg(F.first("row").alias("row"))
    return once.select("row").unionByName(again.select("row")).select(*[F.col(f"row.c{j}").alias(c) for j, c in enumerate(docs.columns)])
