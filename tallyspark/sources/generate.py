"""Deterministic generators of labelled inputs over ``range()``: every draw is a hash of the seed and the row.

They give the same rows on any cluster. Their draws are not those of any random number library, so figures that
rest on such a library's numbers are not reproduced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import text as T

# The words that probes and filler are drawn from.
POOL = "vector index chunk recall ranking query token window graph latency shard corpus passage score budget anchor drift gate".split()


def draw(n: int, *parts) -> Column:
    """A number from 0 to n - 1 that depends on the parts (columns or constants) alone."""
    return F.pmod(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), F.lit(n)).cast("int")


def word(*parts) -> Column:
    return F.get(F.array(*[F.lit(w) for w in POOL]), draw(len(POOL), *parts))


def shuffled(tokens: Column, *parts) -> Column:
    """The tokens in an order that depends on the parts."""
    key = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    keyed = F.transform(tokens, lambda t, i: F.struct(F.xxhash64(*key, i, t).alias("k"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda x: x["t"])


def paraphrase_corpus(spark: SparkSession, pairs: int = 30, seed: int = 1234) -> DataFrame:
    """(doc_id, text, pair_id): two documents a pair, of four signature words twice, four words of their own, six of filler."""
    d = spark.range(2 * pairs).select(F.col("id").alias("doc_id"), F.floor(F.col("id") / 2).alias("pair_id"))
    named = lambda stem, *by: [F.concat_ws("", F.lit(stem), *by, F.lit(chr(97 + j))) for j in range(4)]
    signature, own = named("sig", F.col("pair_id")), named("own", F.col("doc_id"))
    filler = [word(seed, F.col("doc_id"), j) for j in range(6)]
    return d.select("doc_id", F.array_join(shuffled(F.array(*signature, *signature, *own, *filler), seed, F.col("doc_id")), " ").alias("text"), "pair_id")


def probes(spark: SparkSession, n: int = 12, seed: int = 0) -> DataFrame:
    """(pos, text): probes of three to seven words."""
    words = F.transform(F.sequence(F.lit(1), 3 + draw(5, seed, F.col("id"), "length")), lambda j: word(seed, F.col("id"), j))
    return spark.range(n).select(F.col("id").cast("int").alias("pos"), F.array_join(words, " ").alias("text"))


def entity_graph(spark: SparkSession, flawed: bool = False, topics: int = 4, entities: int = 3, facts: int = 4, seed: int = 7) -> dict[str, DataFrame]:
    """nodes, node_facts, edges, facts of triangles joined by bridges.

    ``flawed`` merges the first entities of the first two topics into ``apex``, puts the next two topics into one
    community, and adds the orphan ``lonely``.
    """
    e = spark.range(topics * entities).select(F.floor(F.col("id") / entities).cast("int").alias("t"), (F.col("id") % entities).cast("int").alias("k"))
    name, topic = F.format_string("e%d_%d", "t", "k"), F.format_string("topic%d", "t")
    merged = (F.col("k") == 0) & (F.col("t") < 2)
    node = F.when(merged, "apex").otherwise(name) if flawed else name
    community = F.when(F.col("t").isin(2, 3), "topic2_topic3").when(merged, "topic0").otherwise(topic) if flawed else topic
    held = e.select(F.explode(F.sequence(F.lit(0), F.lit(facts - 1))).alias("j"), "t", "k")
    own = lambda v: F.concat_ws("", F.lit("t"), F.col("t"), F.lit("w"), v)
    words = F.concat_ws(" ", *[own(F.lit(i)) for i in range(8)], *[own(8 + draw(6, seed, F.col("t"), F.col("k"), F.col("j"), i)) for i in range(2)])
    fact = F.format_string("f%d_%d_%d", "t", "k", "j")
    inside = e.alias("a").join(e.alias("b"), F.expr("a.t = b.t AND a.k < b.k")).select("a.t", F.col("a.k").alias("k"), F.col("b.t").alias("t2"), F.col("b.k").alias("k2"))
    bridges = spark.range(topics - 1).select(F.col("id").cast("int").alias("t"), F.lit(1).alias("k"), (F.col("id") + 1).cast("int").alias("t2"), F.lit(1).alias("k2"))
    side = lambda t, k: F.when((F.col(k) == 0) & (F.col(t) < 2), "apex").otherwise(F.format_string("e%d_%d", t, k)) if flawed else F.format_string("e%d_%d", t, k)
    nodes = e.select(node.alias("id"), community.alias("community")).distinct()
    if flawed:
        nodes = nodes.unionByName(spark.createDataFrame([("lonely", "topic0")], "id string, community string"))
    return {
        "nodes": nodes,
        "node_facts": held.select(node.alias("id"), (F.col("t") * 100 + F.col("j")).alias("pos"), fact.alias("fact_id")),
        "edges": inside.unionByName(bridges).select(side("t", "k").alias("u"), side("t2", "k2").alias("v")).distinct(),
        "facts": held.select(fact.alias("fact_id"), words.alias("text"), name.alias("real_entity"), topic.alias("real_community")),
    }


def telemetry(schedule: DataFrame, seed: int = 0, jitter_vram: float = 8.0, jitter_temp: float = 0.15) -> DataFrame:
    """(run, hop, vram_mb, temp_c, hop_ms) of schedules (run, hop from 1, vram_mb, temp_c, hop_ms), with a rest sample as hop 0.

    The rest sample has 0.92 of the first memory and four degrees less. Jitter is even within its bounds on either side.
    """
    even = lambda what: draw(2_000_001, seed, F.col("run"), F.col("hop"), what) / 1_000_000 - 1
    rest = schedule.where("hop = 1").select("run", F.lit(0).alias("hop"), (F.col("vram_mb") * 0.92).alias("vram_mb"), (F.col("temp_c") - 4).alias("temp_c"), F.lit(0.0).alias("hop_ms"))
    moved = schedule.select("run", F.col("hop").cast("int").alias("hop"), (F.col("vram_mb") + even("vram") * jitter_vram).alias("vram_mb"), (F.col("temp_c") + even("temp") * jitter_temp).alias("temp_c"), "hop_ms")
    return rest.unionByName(moved)


# ---------------------------------------------------------------- recognition noise


def modelled_noise(text: Column) -> Column:
    """Noise that canonical folding undoes: case, confused digits, a ligature and a doubled space."""
    swapped = F.translate(text, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")

    def once(text: Column, a: str, b: str) -> Column:
        return T.let(text, lambda s: F.when(F.instr(s, a) > 0, F.overlay(s, F.lit(b), F.instr(s, a), F.lit(len(a)))).otherwise(s))

    out = swapped
    for a, b in (("O", "0"), ("o", "0"), ("L", "1"), ("l", "1"), ("FI", "ﬁ"), ("fi", "ﬁ")):
        out = once(out, a, b)
    return T.let(out, lambda s: F.when(F.instr(s, " ") > 1, F.overlay(s, F.lit("  "), F.instr(s, " "), F.lit(1))).otherwise(s))


def unmodelled_noise(text: Column, *parts) -> Column:
    """Noise that no folding undoes: one letter inserted, deleted or exchanged with the one before; which, by the parts."""
    n = F.length(text)
    at = 2 + F.pmod(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts], F.lit("at")), F.greatest(n - 2, F.lit(1))).cast("int")
    kind = draw(3, *parts, "kind")
    letter = F.chr(97 + draw(26, *parts, "letter"))
    left, right = F.substring(text, F.lit(1), at - 1), F.substring(text, at, n)
    exchanged = F.concat(F.substring(text, F.lit(1), at - 2), F.substring(text, at, F.lit(1)), F.substring(text, at - 1, F.lit(1)), F.substring(text, at + 1, n))
    return F.when(n < 3, text).when(kind == 0, F.concat(left, letter, right)).when(kind == 1, F.concat(left, F.substring(right, F.lit(2), n))).otherwise(exchanged)


def citation_bench(spark: SparkSession, n: int = 1000, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """(sources, citations): one source of unique sentences, and its quotations, 60 % with modelled noise, 20 % with other, 20 % clean.

    citations: source_id, cite_id, quote, degradation, true_start (a code point).
    """
    tag = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda j: F.chr(97 + F.pmod(F.floor(F.col("id") / F.pow(F.lit(26), j)), F.lit(26)).cast("int"))), "")
    s = spark.range(n).select("id", F.concat(F.lit("Field report "), tag, F.lit(" finds "), word(seed, F.col("id"), 1), F.lit(" and "), word(seed, F.col("id"), 2), F.lit(" within "), word(seed, F.col("id"), 3), F.lit(" of unit "), F.reverse(tag), F.lit(".")).alias("sentence"))
    sources = s.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "sentence"))), lambda x: x["sentence"]), "\n\n").alias("source")).select(F.lit("bench").alias("source_id"), "source")
    kind = F.when(F.col("id") % 5 < 3, "modelled").when(F.col("id") % 5 == 3, "unmodelled").otherwise("clean")
    quote = F.when(kind == "modelled", modelled_noise(F.col("sentence"))).when(kind == "unmodelled", unmodelled_noise(F.col("sentence"), seed, F.col("id"))).otherwise(F.col("sentence"))
    cites = s.crossJoin(F.broadcast(sources)).select("source_id", F.format_string("C%04d", "id").alias("cite_id"), quote.alias("quote"), kind.alias("degradation"), (F.expr("instr(source, sentence)") - 1).alias("true_start"))  # one source
    return sources, cites


def legibility_corpus(spark: SparkSession, prose: int = 9, tables: int = 4, scrambled: int = 6, collapsed: int = 4, seed: int = 5) -> DataFrame:
    """(chunk_id, text, label): clean prose and tables (0), two prose columns read across and tables without gaps (1)."""
    letter = lambda v: F.chr(97 + F.pmod(v, F.lit(26)))
    # A line's words move on with its number, so that neighbours share more of them than lines two apart.
    topic = lambda c, j: F.concat_ws(" ", *[F.concat(F.lit("w"), letter(c), letter(j + F.lit(i % 4)), letter(c + i // 4)) for i in range(12)])
    lines = lambda c, n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda j: topic(c, j))
    pad = lambda v, n: F.rpad(v.cast("string"), n, " ")
    row = lambda c, j: F.concat(pad(F.concat(F.lit("item"), j.cast("string")), 12), pad(draw(900, seed, c, j, "a") + 100, 10), pad(draw(90, seed, c, j, "b") + 10, 8), (draw(9000, seed, c, j, "c") + 1000).cast("string"))
    table = lambda c: F.transform(F.sequence(F.lit(1), F.lit(6)), lambda j: row(c, j))
    c = F.col("id").cast("int")
    of = lambda n, kind, label, text: spark.range(n).select(F.concat_ws("-", F.lit(kind), "id").alias("chunk_id"), F.array_join(text, "\n").alias("text"), F.lit(label).alias("label"))
    return (
        of(prose, "prose", 0, lines(c, 8))
        .unionByName(of(tables, "table", 0, table(c)))
        .unionByName(of(scrambled, "scrambled", 1, T.interleave(lines(c, 6), lines(c + 100, 6))))
        .unionByName(of(collapsed, "collapsed", 1, F.transform(table(c), T.collapse_gaps)))
    )
