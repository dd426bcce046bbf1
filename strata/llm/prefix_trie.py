"""Prefix trie of conversations: a z-fast trie that grows in batches, then every prefix as a node.

A prefix is known by 128 bits of hash: each turn is hashed with its position, and a prefix has the
exclusive or of its turns' hashes, so the hashes of all prefixes are running totals, which split over
slices of a long conversation like any sum.  ``prefixes`` has one row per conversation and depth.

The trie is kept compacted.  A node stands for an edge: the depths from below its parent (``top``) to
its own ``extent``, which is where conversations branch or end.  Its *handle* is the prefix whose
depth is the two-fattest number of that range (the one with most trailing zero bits), and the trie
is a table with the handle's hash as key.  A conversation is located by fat binary search: from a
known extent a, the numbers that the search can ask for until its first hit are those p > a with
``p & (p - 1) <= a``, about log2 of its length; they are asked for at once, in one join with the
handles, and the longest hit says on which node to go on.  A search ends after a few such
joins at the node where the conversation leaves the trie (its exit node), and a comparison along that
one edge gives the depth.

Conversations that wait at the same place (same depth, same next turn) are inserted in batches: of
each place one conversation, by the smallest hash of its id, becomes a new leaf, edges are split
where conversations leave them, and the others are located again.  A batch that waits at one place
is thereby parted at random, so batches are about as many as the logarithm of the largest group.

At last sums over subtrees are taken by doubling the distance of pointers upwards, and edges are
expanded to their depths.

Hot keys: all joins on prefixes are by (conversation, depth), which is unique, or many-to-one on a
hash, which adaptive execution splits; a long conversation is sliced by ``SLICE`` turns; ids that end
at one node are gathered in blocks of ``SLICE`` ids, and their digest, which is sequential by
definition, reads one block at a time.  Nothing is broadcast or collected but row counts.

Cases: rows without a conversation id are no conversation; a null turn comes first; turns that tie
are ordered by role, then text; null role or text is empty; equal rows are turns of their own;
conversations without turns end at the root; texts of any length are hashed whole; other columns are
ignored; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import discard, materialise, release, stream_bound

#: Turns, depths or ids of one slice of a group.
SLICE = 1024
#: Rows of a table, counted before, that is broadcast: they have less than 100 bytes each.
FEW = 300_000
_KEY = ["h1", "h2"]


def order_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> DataFrame:
    """``conv``, ``place`` (from 1, gapless), ``t1``, ``t2`` (hash of role and text), ``bytes`` (of the text)."""
    turn = F.col(turn_col).cast("long")
    rows = (rows.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), turn.alias("turn"),
        F.coalesce(F.floor(turn / SLICE), F.lit(-(1 << 62))).alias("slice"),
        F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")))
    local = rows.select("conv", "slice", F.row_number().over(
        Window.partitionBy("conv", "slice").orderBy(F.asc_nulls_first("turn"), "role", "text")).alias("n"),
        F.xxhash64("role", "text").alias("t1"), F.xxhash64("text", F.lit(1), "role").alias("t2"),
        F.octet_length("text").cast("long").alias("bytes"))
    before = rows.groupBy("conv", "slice").count().select("conv", "slice", F.coalesce(F.sum("count").over(
        Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return local.join(before, ["conv", "slice"]).select(
        "conv", (F.col("before") + F.col("n")).alias("place"), "t1", "t2", "bytes")


def prefix_hashes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv``, ``p``, ``h1``, ``h2``, ``bytes`` (of the last turn) and ``cum`` (of all) for every prefix,
    the empty one of every row of ``convs`` included."""
    one = turns.select("conv", F.col("place").alias("p"), F.floor(F.col("place") / SLICE).alias("slice"),
                       F.xxhash64("place", "t1").alias("h1"), F.xxhash64("t2", "place").alias("h2"), "bytes")
    inside = (Window.partitionBy("conv", "slice").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = one.select("conv", "slice", "p", "bytes", F.bit_xor("h1").over(inside).alias("l1"),
                       F.bit_xor("h2").over(inside).alias("l2"), F.sum("bytes").over(inside).alias("lc"))
    earlier = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = one.groupBy("conv", "slice").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"), F.sum("bytes").alias("c"))
    before = before.select("conv", "slice", *[F.coalesce(f(c).over(earlier), F.lit(0)).alias(f"b_{c}")
                                              for f, c in ((F.bit_xor, "x1"), (F.bit_xor, "x2"), (F.sum, "c"))])
    found = local.join(before, ["conv", "slice"]).select(
        "conv", "p", F.col("l1").bitwiseXOR(F.col("b_x1")).alias("h1"), F.col("l2").bitwiseXOR(F.col("b_x2")).alias("h2"),
        "bytes", (F.col("lc") + F.col("b_c")).alias("cum"))
    zero = F.lit(0).cast("long")
    return found.unionByName(convs.select("conv", *[zero.alias(c) for c in ("p", "h1", "h2", "bytes", "cum")]))


def two_fattest(a: Column, b: Column) -> Column:
    """The number in (a, b] with most trailing zero bits."""
    k = F.length(F.bin(a.bitwiseXOR(b))).cast("int") - 1
    return F.call_function("shiftleft", F.call_function("shiftright", b, k), k)


def probes(a: Column, b: Column) -> Column:
    """The numbers p in (a, b] with ``p & (p - 1) <= a``, each once."""
    def step(k: Column) -> Column:
        k = k.cast("int")
        return F.call_function("shiftleft", F.call_function("shiftright", a, k) + 1, k)
    return F.array_distinct(F.filter(F.transform(F.sequence(F.lit(0), F.length(F.bin(b)).cast("int")), step), lambda p: p <= b))


def _at(rows: DataFrame, prefixes: DataFrame, conv: str, p: str, names: dict[str, str], few: bool = False) -> DataFrame:
    """``rows`` with columns of the prefix (``conv``, ``p``), renamed by ``names``; ``few``: rows are broadcast."""
    found = prefixes.select(F.col("conv").alias(conv), F.col("p").alias(p), *[F.col(c).alias(n) for c, n in names.items()])
    return _few(rows, few).join(found, [conv, p])


def _few(table: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(table) if few else table


def with_handles(nodes: DataFrame, prefixes: DataFrame, few: bool) -> DataFrame:
    """Nodes (``h1``, ``h2``, ``extent``, ``top``, ``rep``) with their ``handle`` depth and hash, and the hash of
    the first prefix of their edge (``c1``, ``c2``)."""
    nodes = nodes.select(*_KEY, "extent", "top", "rep", two_fattest(F.col("top"), F.col("extent")).alias("handle"),
                         (F.col("top") + 1).alias("entry"))
    nodes = _at(nodes, prefixes, "rep", "handle", {"h1": "g1", "h2": "g2"}, few)
    return _at(nodes, prefixes, "rep", "entry", {"h1": "c1", "h2": "c2"}, few).drop("entry")


def locate(pending: DataFrame, prefixes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``conv``, ``length``, ``depth`` (of its longest prefix in the trie), and the exit edge that this
    prefix lies on, if not at a node (``x1``, ``x2``, ``x_top``, ``x_extent``, ``x_rep``)."""
    n, few_nodes = pending.count(), nodes.count() <= FEW
    few, few_asked = n <= FEW, n * 41 <= 4 * FEW
    key = {"h1": "k1", "h2": "k2"}
    edge = F.struct("h1", "h2", "extent", "top", "rep", "handle").alias("edge")
    handles = _few(nodes.select(F.col("g1").alias("k1"), F.col("g2").alias("k2"), F.col("handle").alias("p"), edge), few_nodes)
    entries = _few(nodes.select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), edge), few_nodes)
    active, ended = pending.withColumn("a", F.lit(0).cast("long")), []
    while True:
        asked = active.where("a < length").select("conv", F.explode(probes(F.col("a"), F.col("length"))).alias("p"))
        hits = (_at(asked, prefixes, "conv", "p", key, few_asked).join(handles, ["k1", "k2", "p"])
                .groupBy("conv").agg(F.max_by("edge", "p").alias("edge")))
        hits = materialise(hits, "trie-hits")
        whole = (_at(hits.withColumn("p", F.col("edge.extent")), prefixes, "conv", "p", key, few)
                 .where("k1 = edge.h1 AND k2 = edge.h2").select("conv", F.lit(True).alias("whole")))
        step = materialise(active.join(_few(hits, few), "conv", "left").join(_few(whole, few), "conv", "left"), "trie-step")
        # on the edge of the hit, whose handle matches; or below the node where the search stands
        ended.append(step.where("edge IS NOT NULL AND whole IS NULL").select("conv", "length", "a", "edge", F.col("edge.handle").alias("low")))
        stands = step.where("edge IS NULL").select("conv", "length", "a", (F.col("a") + 1).alias("p"))
        below = _at(stands.where("a < length"), prefixes, "conv", "p", key, few).join(entries, ["k1", "k2"], "left")
        ended.append(below.select("conv", "length", "a", "edge", F.when(F.col("edge").isNotNull(), F.col("p")).alias("low")))
        ended.append(stands.where("a = length").select("conv", "length", "a", F.lit(None).cast(below.schema["edge"].dataType).alias("edge"),
                                                       F.lit(None).cast("long").alias("low")))
        active = step.where("whole").select("conv", "length", F.col("edge.extent").alias("a"))
        if active.isEmpty():
            break
    found = ended[0]
    for more in ended[1:]:
        found = found.unionByName(more)
    found = materialise(found, "trie-exits")
    last = F.least("length", "edge.extent")
    on_edge = found.where(F.col("edge").isNotNull() & (F.col("low") < last))
    few_along = (on_edge.agg(F.sum(last - F.col("low"))).first()[0] or 0) <= 2 * FEW
    along = on_edge.select("conv", F.col("edge.rep").alias("rep"), F.explode(F.sequence(F.col("low") + 1, last)).alias("p"))
    along = _at(along, prefixes, "conv", "p", key, few_along)
    common = (_at(along, prefixes, "rep", "p", {"h1": "r1", "h2": "r2"}, few_along).where("k1 = r1 and k2 = r2")
              .groupBy("conv").agg(F.max("p").alias("common")))
    return found.join(_few(common, few), "conv", "left").select(
        "conv", "length", F.coalesce("common", "low", "a").alias("depth"), F.col("edge.h1").alias("x1"),
        F.col("edge.h2").alias("x2"), F.col("edge.top").alias("x_top"), F.col("edge.extent").alias("x_extent"),
        F.col("edge.rep").alias("x_rep"))


def insert_batch(located: DataFrame, prefixes: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie with one conversation of each place, and the conversations that still wait.  Both are written."""
    few = located.count() <= FEW
    hashes = {"h1": "h1", "h2": "h2"}
    inside = located.where("depth < x_extent")
    splits = (_at(inside.withColumnRenamed("depth", "p"), prefixes, "conv", "p", hashes, few)
              .groupBy("x1", "x2", F.col("p").alias("extent")).agg(
                  F.first("h1").alias("h1"), F.first("h2").alias("h2"), F.first("x_top").alias("x_top"), F.min("conv").alias("rep")))
    bottoms = inside.select("x1", "x2", F.col("x_extent").alias("extent"), F.col("x1").alias("h1"), F.col("x2").alias("h2"),
                            "x_top", F.col("x_rep").alias("rep")).distinct()
    points = splits.unionByName(bottoms)
    parts = points.select(*_KEY, "extent", F.coalesce(F.lag("extent").over(
        Window.partitionBy("x1", "x2").orderBy("extent")), F.col("x_top")).alias("top"), "rep")
    waiting = _at(located.where("depth < length").withColumn("p", F.col("depth") + 1), prefixes, "conv", "p", {"h1": "k1", "h2": "k2"}, few)
    chosen = materialise(waiting.groupBy("k1", "k2").agg(
        F.min_by(F.struct("conv", "length", "depth"), F.struct(F.xxhash64("conv"), "conv")).alias("x")).select("x.*"), "trie-chosen")
    leaves = _at(chosen.select("conv", F.col("length").alias("p"), F.col("depth").alias("top")), prefixes, "conv", "p", hashes, few).select(
        *_KEY, F.col("p").alias("extent"), "top", F.col("conv").alias("rep"))
    fresh = with_handles(parts.unionByName(leaves), prefixes, few)
    kept = nodes.join(_few(bottoms.select("h1", "h2"), few), _KEY, "left_anti")
    pending = located.where("depth < length").join(_few(chosen.select("conv"), few), "conv", "left_anti").select("conv", "length")
    return materialise(kept.unionByName(fresh), "trie-nodes"), materialise(pending, "trie-pending")


def build_trie(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """Compacted nodes of all conversations (``conv``, ``length``), but for the root."""
    spark = prefixes.sparkSession
    nodes = spark.createDataFrame([], "h1 long, h2 long, extent long, top long, rep long, handle long, g1 long, g2 long, c1 long, c2 long")
    pending = convs.where("length > 0")
    while not pending.isEmpty():
        located = materialise(locate(pending, prefixes, nodes), "trie-located")
        nodes, pending = insert_batch(located, prefixes, nodes)
        discard(located)
        release(spark)   # plans, broadcasts and shuffles of the batch
    return nodes


def end_digests(ends: DataFrame) -> DataFrame:
    """Per node (``h1``, ``h2``) the SHA-256 of its ids, ascending, joined by commas."""
    blocks = (ends.groupBy(*_KEY, F.floor(F.col("conv") / SLICE).alias("block"))
              .agg(F.array_sort(F.collect_list("conv")).alias("ids"))
              .select(*_KEY, "block", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            out = []
            for h1, h2, ids in zip(*[batch.column(c).to_pylist() for c in ("h1", "h2", "ids")]):
                if (h1, h2) != key:
                    if key:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (h1, h2), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("h1", "h2", "ends_sha256"), r)) for r in out], schema=names)
        if key:
            yield pa.RecordBatch.from_pylist([{"h1": key[0], "h2": key[1], "ends_sha256": digest.hexdigest()}], schema=names)

    names = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("ends_sha256", pa.string())])
    blocks = stream_bound(blocks, [*_KEY, "block", "ids"]).repartition(*_KEY).sortWithinPartitions(*_KEY, "block")
    return blocks.mapInArrow(run, "h1 long, h2 long, ends_sha256 string")


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``n``, ``n_leaves``, ``ended``, ``edge_bytes`` summed and ``least`` minimised over subtrees.
    ``u1``, ``u2`` point to the parent; after k rounds they point 2^k nodes up."""
    sums = ["n", "n_leaves", "ended", "edge_bytes"]
    few = nodes.count() <= FEW
    while not nodes.where("u1 is not null").isEmpty():
        gifts = (nodes.where("u1 is not null").groupBy(F.col("u1").alias("h1"), F.col("u2").alias("h2"))
                 .agg(*[F.sum(c).alias(f"g_{c}") for c in sums], F.min("least").alias("g_least")))
        up = nodes.select(F.col("h1").alias("u1"), F.col("h2").alias("u2"), F.col("u1").alias("v1"), F.col("u2").alias("v2"))
        rest = [c for c in nodes.columns if c not in (*sums, *_KEY, "least", "u1", "u2")]
        old = nodes
        nodes = materialise(nodes.join(_few(up, few), ["u1", "u2"], "left").join(_few(gifts, few), _KEY, "left").select(
            *_KEY, F.col("v1").alias("u1"), F.col("v2").alias("u2"), *rest,
            *[(F.col(c) + F.coalesce(f"g_{c}", F.lit(0))).alias(c) for c in sums],
            F.least("least", "g_least").alias("least")), "trie-sums")
        discard(old)
        release(nodes.sparkSession)
    return nodes


def conversation_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per distinct prefix.  ``turns``: ``conv``, ``place`` (from 1, gapless), ``t1``, ``t2``, ``bytes``, as
    ``order_turns`` gives them; ``convs``: ``conv``, each once, those without turns too.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs`` (members),
    ``n_children``, ``n_leaves`` (childless nodes of the subtree), ``saved_tokens`` (of the subtree: for each node
    the bytes of its last text times its members but one), ``ends_sha256`` (of the ids that end here).
    """
    prefixes = materialise(prefix_hashes(turns, convs), "trie-prefixes")
    lengths = materialise(prefixes.groupBy("conv").agg(F.max("p").alias("length")), "trie-lengths")
    nodes = build_trie(prefixes, lengths)
    few, few_ends = nodes.count() <= FEW, lengths.count() <= FEW
    zero = F.lit(0).cast("long")
    edges = _at(nodes.select(*_KEY, "extent", "top", "rep"), prefixes, "rep", "top", {"h1": "u1", "h2": "u2", "cum": "cum_top"}, few)
    edges = _at(edges, prefixes, "rep", "extent", {"cum": "cum"}, few)
    null = F.lit(None).cast("long")
    root = lengths.groupBy().agg(F.min("conv").alias("rep")).where("rep is not null").select(
        zero.alias("h1"), zero.alias("h2"), null.alias("u1"), null.alias("u2"), zero.alias("extent"), F.lit(-1).cast("long").alias("top"),
        "rep", zero.alias("cum_top"), zero.alias("cum"))
    edges = materialise(edges.unionByName(root), "trie-edges")
    ends = _at(lengths.withColumnRenamed("length", "p"), prefixes, "conv", "p", {"h1": "h1", "h2": "h2", "cum": "cum"}, few_ends)
    ends = materialise(ends, "trie-ends")
    here = _few(ends.groupBy(*_KEY).agg(F.count("*").alias("n"), F.sum("cum").alias("ended"), F.min("conv").alias("least")), few)
    children = _few(edges.where("u1 is not null").groupBy(F.col("u1").alias("h1"), F.col("u2").alias("h2"))
                    .agg(F.count("*").alias("n_children")), few)
    start = materialise(edges.join(here, _KEY, "left").join(children, _KEY, "left").select(
        *_KEY, "u1", "u2", "extent", "top", "rep", "cum", F.col("u1").alias("parent1"), F.col("u2").alias("parent2"),
        (F.col("cum") - F.col("cum_top")).alias("own_bytes"), (F.col("cum") - F.col("cum_top")).alias("edge_bytes"),
        F.coalesce("n", zero).alias("n"), F.coalesce("ended", zero).alias("ended"), "least",
        F.coalesce("n_children", zero).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves")), "trie-sums")
    summed = subtree_sums(start)
    above = summed.select(F.col("h1").alias("parent1"), F.col("h2").alias("parent2"), F.col("least").alias("parent_least"))
    summed = summed.join(_few(above, few), ["parent1", "parent2"], "left").join(_few(end_digests(ends), few), _KEY, "left")
    depths = summed.withColumn("p", F.explode(F.sequence(F.col("top") + 1, F.col("extent"))))
    depths = _at(depths, prefixes, "rep", "p", {"bytes": "last_bytes", "cum": "cum_p"})
    above = F.col("cum_p") - F.col("last_bytes")   # bytes of the prefix before this one
    bottom = F.col("p") == F.col("extent")
    return depths.select(
        F.col("least").alias("conv_id"), F.col("p").alias("depth"),
        F.when(F.col("p") == F.col("top") + 1, F.col("parent_least")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(bottom, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        "n_leaves", (F.col("ended") - F.col("n") * above - (F.col("edge_bytes") - F.col("own_bytes") + F.col("cum") - above)
                     ).alias("saved_tokens"),
        F.when(bottom & F.col("ends_sha256").isNotNull(), F.col("ends_sha256")).otherwise(F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def regrown(turns: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: c starts with the first h turns of c - c % ``family`` (all if it has
    fewer) and goes on with its own turns after its first h, h = crc32(c) % ``heads``.  Returns turns and
    conversations as ``conversation_trie`` takes them; ``turns`` as ``order_turns`` gives them, written."""
    lengths = turns.groupBy("conv").agg(F.max("place").alias("length"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    info = lengths.select("conv", "length", h.alias("h"), (F.col("conv") - F.col("conv") % family).alias("base"))
    info = info.join(lengths.select(F.col("conv").alias("base"), F.col("length").alias("base_length")), "base", "left").select(
        "conv", "base", "length", "h", F.least("h", F.coalesce("base_length", F.lit(0))).alias("head"))
    first = turns.where(F.col("place") < heads).withColumnRenamed("conv", "base")
    first = info.where("head > 0").select("conv", "base", "head").join(first, "base").where("place <= head")
    piece = F.floor(F.col("place") / SLICE)   # a long conversation's turns meet its row by slices
    own = turns.where(F.col("place") > h).withColumn("piece", piece).join(info.select(
        "conv", "h", "head", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / SLICE))).alias("piece")), ["conv", "piece"])
    own = own.withColumn("place", F.col("place") - F.col("h") + F.col("head"))
    names = ["conv", "place", "t1", "t2", "bytes"]
    return first.select(*names).unionByName(own.select(*names)), lengths.select("conv")
