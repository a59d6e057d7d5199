"""Near duplicates: many universal hash minima, banding, verification, star components.

Equal shingle sets are one node.  In each band's bucket the nodes are linked to a few hubs,
first the node that meets most others over all bands, rather than to each other; a test of set sizes
and signatures and then a count on the full sets confirm each link.  Buckets that still hold
several components besides the hubs are gone through again: the nodes outside the largest
component against every node of the bucket, in blocks, each pair in its first common band
only.  Where very many nodes are outside it, as with pages of one template that are not alike
enough, a node is told by its difference from what most of the bucket's nodes have in common:
sets can be linked only if their differences share one of their rarest shingles, so a prefix
join finds the pairs, and what the template gives to all is never joined.  So no link between
components is lost, and only links that join two components leave a block.  Texts are read
again once, for the nodes that share a band with any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, row_key, staged
from .components import components
from .hashing import mix, shared, shingles, word_hashes

#: Minima of a band; chance that a link at the threshold shares no band; deviations that an estimate may lie below the threshold.
ROWS, MISSED, DEVIATIONS = 4, 1e-7, 5.0
#: Hubs of a bucket: the node that meets most others, and some by a hash of the node, so that buckets mostly have the same ones.
HUBS = 4
#: Nodes of a block; nodes outside its largest component from which a bucket's differences are joined: up to these, each node of a bucket makes SPLIT / BLOCK + 1 rows at most.
BLOCK, SPLIT = 256, 1024
#: Nodes of a crowded bucket, about, from which the shingles are taken that most have in common. Any such set gives the same links; a good one leaves small differences.
COMMON_OF = 64
SIGNED = "key binary, doc_id long, n long, node binary, sig binary"
HIDDEN = "band long, i int, block int"


def bands_for(threshold: float) -> int:
    """Bands so that a pair at the threshold shares none with a chance of MISSED at most."""
    return math.ceil(math.log(MISSED) / math.log(1 - threshold**ROWS))


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_231)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """16 bits of the least a x + b mod 2^64 over the set, for each hash function."""
    out = np.full(len(a), np.uint64((1 << 64) - 1))
    for low in range(0, len(s), 256):
        np.minimum(out, (s[low : low + 256, None] * a + b).min(0), out=out)
    return mix(out).astype(np.uint16)


def text_shingles(text: str | None, k: int) -> np.ndarray:
    return shingles(word_hashes(text.encode("utf-8", "replace").lower()), k) if text else np.zeros(0, np.uint64)


def signatures(docs: DataFrame, k: int, bands: int) -> DataFrame:
    """(key, doc_id, n, node, sig) per row; node is a hash of the whole set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = multipliers(bands * ROWS)
        for batch in batches:
            n, nodes, sigs = [], [], []
            for text in batch.column(2):
                s = text_shingles(text.as_py(), k)
                n.append(len(s))
                nodes.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s, a, b).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary())], ["key", "doc_id", "n", "node", "sig"])

    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SIGNED)


def _grouped(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Groups of rows that agree in the first columns; the rows come in order and are not held."""

    def rows():
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                yield from zip(*(c.to_pylist() for c in batch.slice(low, 512).columns), strict=True)

    return groupby(rows(), key=lambda r: r[:width])


def _rows(rows: Iterator[tuple], schema: list[tuple[str, pa.DataType]], size: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), schema, strict=True)], [n for n, _ in schema])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), schema, strict=True)], [n for n, _ in schema])


def _alike(own: np.ndarray, sig: np.ndarray, sizes: np.ndarray, n: int, share: tuple[int, int], least: float) -> np.ndarray:
    """Which of the signatures may belong to sets with that share: by the sizes of the sets, then by the places in which they agree."""
    fits = share[1] * np.minimum(sizes, n) >= share[0] * np.maximum(sizes, n)
    fits[fits] = (own[fits] == sig).mean(1) >= least
    return fits


def _estimated(pairs: DataFrame, nodes: DataFrame, share: tuple[int, int], least: float) -> DataFrame:
    """The pairs (u, v) that may be linked."""
    of = lambda c: nodes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in (2, 3))
                yield batch.filter(pa.array((a == b).mean(1) >= least)).select([0, 1])

    sized = pairs.join(of("u"), "u").join(of("v"), "v").where(share[1] * F.least("n_u", "n_v") >= share[0] * F.greatest("n_u", "n_v"))
    return sized.select("u", "v", "sig_u", "sig_v").mapInArrow(run, "u long, v long")


def _hub_links(pairs: DataFrame, texts: DataFrame, k: int, share: tuple[int, int]) -> DataFrame:
    """The pairs (u, hub v) confirmed on their full sets. A hub's text goes once to each block of its nodes."""
    sizes = pairs.groupBy("v").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = pairs.join(sizes, "v").select("v", F.expr("cast(pmod(xxhash64(u), blocks) as int)").alias("block"), F.lit(1).alias("role"), F.col("u").alias("id"))
    hubs = sizes.select("v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), F.col("v").alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for (hub, _), rows in _grouped(batches, 2):
                own, last = None, None
                for _, _, role, node, text in rows:
                    if node == last:
                        continue
                    last, s = node, text_shingles(text, k)
                    if role == 0:
                        own = s
                    elif share[1] * (n := shared(own, s)) >= share[0] * (len(own) + len(s) - n):
                        yield hub, node

        yield from _rows(found(), [("u", pa.int64()), ("v", pa.int64())])

    dealt = members.union(hubs).join(texts, "id").select("v", "block", "role", "id", "text")
    return dealt.repartition("v", "block").sortWithinPartitions("v", "block", "role", "id").mapInArrow(run, "u long, v long")


def _mixed(members: DataFrame, of: DataFrame) -> DataFrame:
    """(band, i, ref, id, component, n, main, outside) of buckets with several components: the bucket's size, its largest component and how many nodes are outside it.

    Hubs are left out, as they have met their whole buckets; the first stands for the bucket as ref.
    """
    comp = members.where("NOT array_contains(hubs, id)").join(of.select(F.col("node").alias("id"), "component"), "id", "left").select("band", "i", F.col("hubs")[0].alias("ref"), "id", F.coalesce("component", "id").alias("component"))
    comp = staged(comp, "bucket-components")
    counts = comp.groupBy("band", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("band").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("x"), F.count("*").alias("components"))
    main = main.where("components > 1").select("band", "n", F.col("x.component").alias("main"), (F.col("n") - F.col("x.n")).alias("outside"))
    out = staged(comp.join(main, "band"), "mixed-buckets")
    discard(comp)
    return out


def _blocks(mixed: DataFrame) -> DataFrame:
    """(band, i, block, role, id, component): each node of a bucket that is not crowded in its block with role 0, and the nodes outside the largest component in every block with role 1."""
    rows = mixed.where(F.col("outside") <= SPLIT).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    data = rows.select("band", "i", F.expr("cast(pmod(xxhash64(id), blocks) as int)").alias("block"), F.lit(0).alias("role"), "id", "component")
    asked = rows.where("component <> main").select("band", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "id", "component")
    return data.union(asked)


def _common(crowd: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(ref, common): the shingles that more than half of some nodes of each crowd (ref, id, n) have, sorted; some by a hash, about COMMON_OF."""
    some = crowd.where(F.expr(f"pmod(xxhash64(id, 9), ceil(n / {COMMON_OF})) = 0")).join(texts, "id").select("ref", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for (ref,), rows in _grouped(batches, 1):
                sets = [text_shingles(text, k) for _, _, text in rows]
                values, many = np.unique(np.concatenate(sets), return_counts=True)
                yield ref, values[2 * many > len(sets)].tobytes()

        yield from _rows(found(), [("ref", pa.int64()), ("common", pa.binary())], 50)

    return staged(some.repartition("ref").sortWithinPartitions("ref", "id").mapInArrow(run, "ref long, common binary"), "crowd-common")


def _differences(crowd: DataFrame, texts: DataFrame, k: int, share: tuple[int, int]) -> DataFrame:
    """(ref, id, component, weight, size, token): the shingles in which a node and its crowd's common ones differ, ``size`` of them.

    With D the greatest difference of two linked sets, which is (b - a) / (a + b) of the sum of
    their sizes, two nodes that are linked share at least (their sizes here - D) / 2 tokens.
    weight is size less the node's own part of D, times a + b: so two nodes share at least the
    sum of their weights, divided by 2 (a + b).
    """
    a, b = share
    sizes = crowd.select("ref", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")).distinct()
    members = crowd.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).join(texts, "id").select("ref", F.expr("cast(pmod(xxhash64(id), blocks) as int)").alias("block"), F.lit(1).alias("role"), "id", "component", "text", F.lit(None).cast("binary").alias("common"))
    heads = sizes.join(_common(crowd, texts, k), "ref").select("ref", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("component"), F.lit(None).cast("string").alias("text"), "common")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for (ref, _), rows in _grouped(batches, 2):
                shared_by_most = np.zeros(0, np.uint64)
                for _, _, role, node, component, text, common in rows:
                    if role == 0:
                        shared_by_most = np.frombuffer(common, np.uint64)
                        continue
                    s = text_shingles(text, k)
                    z = np.setxor1d(s, shared_by_most, assume_unique=True)
                    yield ref, node, component, len(z) * (a + b) - (b - a) * len(s), len(z), z.view(np.int64).tolist()

        yield from _rows(found(), [("ref", pa.int64()), ("id", pa.int64()), ("component", pa.int64()), ("weight", pa.int64()), ("size", pa.int64()), ("z", pa.list_(pa.int64()))], 200)

    dealt = members.union(heads).repartition("ref", "block").sortWithinPartitions("ref", "block", "role", "id")
    return dealt.mapInArrow(run, "ref long, id long, component long, weight long, size long, z array<long>")


def _crowd_pairs(crowd: DataFrame, texts: DataFrame, k: int, share: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Of crowds (ref, id, component, n): pairs (u, v) of other components that may be linked, and pairs that are.

    Two nodes whose weights add up to 0 or less are linked, and so is each of them to the node
    of least weight: one pair for each such node joins them all.  All others share a token.
    Tokens go by their frequency in the crowd, the rarest first.  Of a pair, the node of lesser
    weight has a shared token among its first ones, as many as its own weight leaves; the
    other may have it anywhere, but for both enough tokens must follow.
    """
    whole = sum(share)
    tokens = staged(_differences(crowd, texts, k, share), "crowd-differences")
    center = tokens.groupBy("ref").agg(F.min(F.struct("weight", "id")).alias("c"))
    sure = tokens.join(center, "ref").where("weight + c.weight <= 0 AND id <> c.id").select(F.col("id").alias("u"), F.col("c.id").alias("v"))
    each = tokens.select("ref", "id", "component", "weight", "size", F.explode("z").alias("token"))
    often = each.groupBy("ref", "token").agg(F.count("*").alias("often"))
    placed = each.join(often, ["ref", "token"]).withColumn("p", F.row_number().over(Window.partitionBy("ref", "id").orderBy("often", "token")) - 1).where("often > 1").drop("often")
    placed = staged(placed, "crowd-tokens")
    first = placed.where(f"weight <= 0 OR p < size - (weight + {whole - 1}) div {whole} + 1")
    enough = f"(x.weight + y.weight + {2 * whole - 1}) div {2 * whole}"
    met = first.alias("x").join(placed.alias("y"), ["ref", "token"]).where(
        f"(x.weight, x.id) < (y.weight, y.id) AND x.component <> y.component AND x.weight + y.weight > 0 AND x.size - x.p >= {enough} AND y.size - y.p >= {enough}"
    )
    return staged(met.select(F.col("y.id").alias("u"), F.col("x.id").alias("v")).distinct(), "crowd-pairs"), sure


def _crowd_links(mixed: DataFrame, nodes: DataFrame, texts: DataFrame, of: DataFrame, k: int, share: tuple[int, int], least: float) -> DataFrame:
    """(u, v): links between components in crowded buckets, confirmed on full sets. Buckets of one ref are one crowd."""
    crowd = mixed.where(F.col("outside") > SPLIT).select("ref", "id", "component").distinct()
    crowd = staged(crowd.join(crowd.groupBy("ref").agg(F.count("*").alias("n")), "ref"), "crowds")
    if crowd.isEmpty():
        return crowd.select(F.col("id").alias("u"), F.col("id").alias("v"))
    pairs, sure = _crowd_pairs(crowd, texts, k, share)
    links = _hub_links(staged(_estimated(pairs, nodes, share, least), "crowd-estimated"), texts, k, share).union(sure)
    named = lambda c: of.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    return links.join(named("u"), "u", "left").join(named("v"), "v", "left").select(F.coalesce("of_u", "u").alias("u"), F.coalesce("of_v", "v").alias("v"))


def _promising(blocks: DataFrame, nodes: DataFrame, share: tuple[int, int], least: float) -> DataFrame:
    """The rows of blocks that may be linked to one of the other role and another component. A pair is looked at where its first common band is i only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for (band, i, block), rows in _grouped(batches, 3):
                ids, comps, sizes, sigs, own = [], [], [], [], None
                for *_, role, node, comp, n, sig in rows:
                    sig = np.frombuffer(sig, np.uint16)
                    if role == 0:
                        ids.append(node)
                        comps.append(comp)
                        sizes.append(n)
                        sigs.append(sig)
                        continue
                    if own is None:
                        if not ids:
                            continue
                        own, of, size, hit = np.stack(sigs), np.array(comps), np.array(sizes), np.zeros(len(ids), bool)
                    at = np.flatnonzero(_alike(own, sig, size, n, share, least) & (of != comp))
                    common = (own[at] == sig).reshape(len(at), len(sig) // ROWS, ROWS).all(2)
                    right = common.any(1) & (common.argmax(1) == i)
                    if right.any():
                        hit[at[right]] = True
                        yield band, i, block, 1, node, comp
                if own is not None:
                    for x in np.flatnonzero(hit):
                        yield band, i, block, 0, ids[x], comps[x]

        yield from _rows(found(), [("band", pa.int64()), ("i", pa.int32()), ("block", pa.int32()), ("role", pa.int32()), ("id", pa.int64()), ("component", pa.int64())])

    dealt = blocks.join(nodes.select("id", "n", "sig"), "id").select("band", "i", "block", "role", "id", "component", "n", "sig")
    return dealt.repartition("band", "i", "block").sortWithinPartitions("band", "i", "block", "role", "id").mapInArrow(run, f"{HIDDEN}, role int, id long, component long")


class _Joined:
    """Components within a block."""

    def __init__(self):
        self.up: dict = {}

    def top(self, x):
        while (y := self.up.get(x, x)) != x:
            x = y
        return x

    def join(self, a, b) -> bool:
        a, b = self.top(a), self.top(b)
        self.up[a] = b
        return a != b


def _block_links(blocks: DataFrame, texts: DataFrame, k: int, share: tuple[int, int]) -> DataFrame:
    """(u, v): links between components, confirmed on full sets; of each block, as many as join its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for _, rows in _grouped(batches, 3):
                comps, sets, values, last, joined = [], [], None, None, _Joined()
                for *_, role, node, comp, text in rows:
                    if (role, node) == last:
                        continue
                    last, s = (role, node), text_shingles(text, k)
                    if role == 0:
                        comps.append(comp)
                        sets.append(s)
                        continue
                    if values is None:
                        if not sets:
                            continue
                        sizes = np.array([len(x) for x in sets])
                        everything, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                        order = np.argsort(everything, kind="stable")
                        owner = owner[order]
                        values, many = np.unique(everything, return_counts=True)
                        first = np.concatenate([[0], np.cumsum(many)])
                    at = np.searchsorted(values, s)
                    at[at == len(values)] = 0
                    at = at[values[at] == s]
                    lists = [owner[first[i] : first[i + 1]] for i in at]
                    n = np.bincount(np.concatenate(lists), minlength=len(sets)) if lists else np.zeros(len(sets), int)
                    for i in np.flatnonzero(share[1] * n >= share[0] * (sizes + len(s) - n)):
                        if joined.join(comp, comps[i]):
                            yield comp, comps[i]

        yield from _rows(found(), [("u", pa.int64()), ("v", pa.int64())])

    dealt = blocks.join(texts, "id").select("band", "i", "block", "role", "id", "component", "text")
    return dealt.repartition("band", "i", "block").sortWithinPartitions("band", "i", "block", "role", "id").mapInArrow(run, "u long, v long")


def _linked(nodes: DataFrame, docs: DataFrame, k: int, share: tuple[int, int], bands: int) -> DataFrame:
    """(id, component): the nodes (id, key, n, sig) that are linked to others, with the least id of their component."""
    threshold = share[0] / share[1]
    least = threshold - DEVIATIONS * math.sqrt(threshold * (1 - threshold) / (bands * ROWS))
    placed = nodes.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.col("sig").substr(i * (2 * ROWS) + 1, F.lit(2 * ROWS))))).alias("i", "band"))
    several = staged(placed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "bands")
    met = staged(placed.join(several.hint("merge"), "band"), "members")
    own = staged(nodes.join(met.groupBy("id").agg(F.sum("n").alias("weight")).hint("merge"), "id"), "member-nodes")
    texts = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("text").cast("string").alias("text")).join(own.select("key", "id").hint("shuffle_hash"), "key").select("id", "text")
    texts = staged(texts, "member-texts")
    tops = [F.max(F.struct("weight", "id"))["id"], *[F.min(F.struct(F.xxhash64("id", F.lit(k)), "id"))["id"] for k in range(1, HUBS)]]
    hubs = met.join(own.select("id", "weight"), "id").groupBy("band").agg(F.array_distinct(F.array(*tops)).alias("hubs"))
    members = staged(met.join(hubs, "band").select("band", "i", "id", "hubs"), "buckets")
    discard(several, met)
    paired = F.expr("filter(hubs, h -> id > h OR id < h AND NOT array_contains(hubs, id))")
    stars = members.select(F.col("id").alias("u"), F.explode(paired).alias("v")).distinct()  # two hubs make one pair
    near = staged(_estimated(stars, own, share, least), "stars-estimated")
    first = staged(components(_hub_links(near, texts, k, share)), "components")
    mixed = _mixed(members, first)
    blocks = staged(_promising(_blocks(mixed), own, share, least), "blocks")
    second = staged(components(_block_links(blocks, texts, k, share).union(_crowd_links(mixed, own, texts, first, k, share, least))), "components")
    merged = first.join(second.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    alone = second.join(first, "node", "left_anti").select("node", "component")
    found = staged(merged.union(alone).select(F.col("node").alias("id"), "component"), "components")
    discard(own, texts, members, near, first, mixed, blocks, second)
    return found


def near_duplicates(docs: DataFrame, k: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """(key, doc_id, n_shingles, component_id, first_key) per row of docs; key is that of ``common.row_key``.

    Documents are linked if share[1] * intersection >= share[0] * union of their sets of k-word
    shingles, words being runs without ASCII white space after A-Z are lowered.
    component_id is the least doc_id of the component, first_key the least key among the rows
    that have it.  Null, empty and blank texts have no shingles and are alone.  Null doc_ids are
    never a component's id unless it has no other.  Equal rows share a component and a key.
    Texts of any length are taken whole; other columns are left out; an empty table gives no rows.
    """
    bands = bands_for(share[0] / share[1])
    signed = staged(signatures(docs, k, bands), "signatures")
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("key", "n", "sig")).alias("x"))
    nodes = staged(nodes.select(F.monotonically_increasing_id().alias("id"), "node", "x.*"), "nodes")
    found = _linked(nodes.select("id", "key", "n", "sig"), docs, k, share, bands)
    node = nodes.select("id", "node")
    top = found.join(node, "id").select("node", "component").join(node.select(F.col("id").alias("component"), F.col("node").alias("top")), "component").select("node", "top")
    rows = signed.select("key", "doc_id", "n", "node").join(top, "node", "left").withColumn("component", F.coalesce("top", "node", F.unhex(F.md5(F.concat(F.lit("alone"), F.hex("key"))))))
    rows = staged(rows.select("key", "doc_id", "n", "component"), "classed")
    ids = staged(rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("x")).select("component", F.col("x.doc_id").alias("component_id"), F.col("x.key").alias("first_key")), "component-ids")
    discard(signed, nodes, found)
    return rows.join(ids, "component").select("key", "doc_id", F.col("n").alias("n_shingles"), "component_id", "first_key")


def deduplicated(docs: DataFrame, k: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row of each component of docs, that with the least doc_id, with its columns as they are; of equal rows, one.

    Nulls, blank texts and ties are as in ``near_duplicates``: texts without words all stay, but equal
    rows of them once.  Extra columns may have any name; an empty table gives no rows.
    """
    found = near_duplicates(docs, k, share)
    drop = staged(found.where("NOT (key <=> first_key)").select("key").distinct(), "near-copies")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), row.alias("row")).dropDuplicates(["key"])
    return once.join(drop.hint("merge"), "key", "left_anti").select("row.*")  # both by key: the texts are shuffled once
