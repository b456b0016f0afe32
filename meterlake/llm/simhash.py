"""SimHash near-duplicates with deletion-variant signatures, exact near-duplicates by a prefix-filter set join, and
components of the link graph."""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.common import id_and_text, materialize, release, slices, whole_row

#: Shingles whose bits are counted at once; bounds the memory of a very long text.
COUNT_SHINGLES = 1 << 15


def shingle_hashes(text: str, words: int, seed: int):
    """XXH64 values of a text's word shingles, repeats included, in runs of at most COUNT_SHINGLES.

    A-Z are lower-cased; words are runs of anything but blank and the control characters 9 to 13; a shingle is
    ``words`` consecutive words with one blank between them. Fewer words: one shingle of all; none: nothing.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return
    k = min(words, len(parts))
    joined = b" ".join(parts)
    ends = list(accumulate((len(p) + 1 for p in parts)))
    starts = [0, *ends]
    n = len(parts) - k + 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, COUNT_SHINGLES):
        yield np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts[at : min(at + COUNT_SHINGLES, n)], ends[at + k - 1 :])], ">u8")


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if it is set in over half of the hashes of the text's shingles; no words: 0."""
    return fingerprint_of(shingle_hashes(text, words, seed))


def fingerprint_of(runs) -> int:
    """The SimHash of runs of shingle hashes."""
    counts, n = np.zeros(64, np.int64), 0
    for h in runs:
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big") if n else 0


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp long, text_hash long) for every row; ``fp`` holds the 64 bits as a signed long. Narrow."""

    def run(batches):
        for batch in slices(batches):
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), batch.column(2)], ["doc_id", "fp", "text_hash"])

    return id_and_text(docs).withColumn("text_hash", F.xxhash64("doc_id", "text")).mapInArrow(run, "doc_id long, fp long, text_hash long")


#: A signature shared by more fingerprints than this is split by blocks of the other bits.
HOT_SIGNATURE = 256


def segments(bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest equal segments of 64 bits such that, at ``bits`` differing bits, one segment
    differs by at most one."""
    m = bits // 2 + 1
    cuts = [64 * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _variants(fps: DataFrame, bits: int) -> DataFrame:
    """(fp, g, key): the 64 one-wildcard variants of the segments of each fingerprint; ``g`` is the bit left out.

    Fingerprints whose segment differs by at most one bit share the variant of that segment that leaves the bit out.
    """
    masks = {g: ((1 << w) - 1 << a) & ~(1 << g) for a, w in segments(bits) for g in range(a, a + w)}
    signed = ", ".join(f"{m - (1 << 64) if m >> 63 else m}L" if m != 1 << 63 else "shiftleft(1L, 63)" for m in masks.values())
    return fps.select("fp", F.posexplode(F.expr(f"transform(array({signed}), m -> fp & m)")).alias("g", "key"))


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b) with a < b: every pair of distinct fingerprints ``fp`` that differ in at most ``bits`` bits, once.

    Equality-joins the one-wildcard variants and verifies each pair. A pair that shares several variants is kept at one
    of them only: that of the first segment with at most one differing bit, at the differing bit or else at the
    segment's first. Signatures with over HOT_SIGNATURE fingerprints are joined on one of ``bits`` + 1 blocks of the
    bits outside the segment as well, one of which is equal; such a pair may come from several blocks and is made unique.
    """
    v = materialize(_variants(fps, bits).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("g", "key"))).where("n > 1"), "variants")
    parts = segments(bits)
    x = [f"(shiftrightunsigned(a.fp ^ b.fp, {at}) & {(1 << w) - 1}L)" for at, w in parts]
    cases = []
    for k, (at, w) in enumerate(parts):
        earlier = "".join(f" and bit_count({y}) > 1" for y in x[:k])
        cases.append(f"when a.g < {at + w} then ({x[k]} <> 0 or a.g = {at}){earlier}")
    once = F.expr(f"a.fp < b.fp and bit_count(a.fp ^ b.fp) <= {bits} and case {' '.join(cases)} end")
    few, many = v.where(F.col("n") <= HOT_SIGNATURE), v.where(F.col("n") > HOT_SIGNATURE)
    same = (F.col("a.g") == F.col("b.g")) & (F.col("a.key") == F.col("b.key"))
    plain = few.alias("a").join(few.alias("b"), same & once)
    # the bits outside the segment, moved together: those above it come down over those below
    other = "case " + " ".join(f"when g < {at + w} then {_outside(at, w)} end" if k == len(parts) - 1 else f"when g < {at + w} then {_outside(at, w)}" for k, (at, w) in enumerate(parts))
    rest = 64 - max(w for _, w in parts) + 1
    cuts = [rest * k // (bits + 1) for k in range(bits + 2)]
    values = ", ".join(f"shiftrightunsigned(other, {a}) & {(1 << b - a) - 1}L" for a, b in zip(cuts, cuts[1:]))
    blocks = many.withColumn("other", F.expr(other)).select("g", "key", "fp", F.posexplode(F.expr(f"array({values})")).alias("block", "value"))
    split = blocks.alias("a").join(blocks.alias("b"), same & (F.col("a.block") == F.col("b.block")) & (F.col("a.value") == F.col("b.value")) & once)
    pair = [F.col("a.fp").alias("a"), F.col("b.fp").alias("b")]
    return plain.select(*pair).union(split.select(*pair).distinct())


def _outside(at: int, width: int) -> str:
    low = f"fp & {(1 << at) - 1}L"
    return f"({low}) | shiftleft(shiftrightunsigned(fp, {at + width}), {at})" if at + width < 64 else low


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of undirected ``edges`` (a, b); ``root`` is the smallest node reachable.

    Alternating large-star and small-star steps until no edge changes; each step is written to the shared folder. The
    least neighbour of a node is found by a pre-aggregated minimum and joined back as a table of its own, so that
    adaptive execution can split the rows of a hub. The driver only sees counts and a checksum.
    """

    def least(pairs: DataFrame) -> DataFrame:
        return materialize(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """pairs (u, v): large: links each greater neighbour to the least of u and its neighbours; small: the others."""
        joined = pairs.join(least(pairs), "u")
        if large:
            return joined.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v")
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(joined.select("u", F.col("m").alias("v")))

    def state(pairs: DataFrame):
        return pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before, seen = None, state(now)
    while seen != before:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(star(both, True).distinct(), "large-star")
        small = materialize(star(large, False).distinct(), "small-star")
        release(now)
        now, before, seen = small, seen, state(small)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows (doc_id, fp, text_hash) of every document, classes (fp, root, component_id) of every fingerprint.

    Fingerprints link at ``bits`` or fewer differing bits; ``root`` is the smallest linked fingerprint and
    ``component_id`` the smallest doc_id of all documents reachable. Copies share a fingerprint and are counted once, by
    a pre-aggregated minimum. Null and empty texts have fingerprint 0 and link like any other. Null ids never become a
    component_id unless no document reachable has an id. Empty table: no rows.
    """
    rows = materialize(fingerprints(docs, words), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct-fingerprints")
    linked = materialize(components(links(distinct.select("fp"), bits)), "components")
    members = linked.join(distinct, linked["node"] == distinct["fp"]).select("fp", "root", "doc_id")
    classes = members.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked_classes = members.join(classes, "root").select("fp", F.col("root").alias("linked"), "component_id")
    alone = distinct.select("fp", "doc_id").join(linked_classes, "fp", "left")
    component = F.when(F.col("linked").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows, materialize(alone.select("fp", F.coalesce("linked", "fp").alias("root"), component.alias("component_id")), "classes")


def simhash_components(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint of 16 hex digits, component_id) for every row of ``docs``; see ``near_duplicates``."""
    rows, classes = near_duplicates(docs, words, bits)
    return rows.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: One text in so many is looked at to find the shingles that many sets share, and how many of those are put last.
#: These only choose the order of the prefixes; any order gives the same pairs.
ORDER_SHARE, ORDER_COMMON = 16, 100_000
#: A prefix shingle shared by more sets than this links them to one of their size first.
HOT_SHINGLE = 64
#: Words of 64 bits of the short parity sketch that candidates of a hot shingle are compared by.
SHORT_SKETCH = 8


def distinct_shingles(text: str, words: int, seed: int) -> np.ndarray:
    """Distinct shingle hashes of a text, ascending (as unsigned)."""
    return distinct_of(shingle_hashes(text, words, seed))


def distinct_of(runs) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(h.astype(np.uint64) for h in runs)]))


def prefix_length(size: int, least: float) -> int:
    """Elements of a set of which at least one, in any common order, is among those of each set that is ``least`` similar."""
    return size - math.ceil(least * size - 1e-9) + 1


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of the numbers of hashes in each of 2 to 4 times as many cells (a power of two, at least 512), as longs.

    The sketch of a symmetric difference is the exclusive or of the sketches, so the bits in which two sketches differ
    never outnumber the elements in which their sets differ; halves that are laid over each other keep that.
    """
    cells = max(64 * SHORT_SKETCH, 1 << (2 * len(hashes) - 1).bit_length() if len(hashes) else 0)
    at = ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - cells.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=cells) & 1).astype(np.uint8)).view(np.int64)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def common_shingles(docs: DataFrame, words: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, counts) of at most ORDER_COMMON shingles that occur most often in one text of ORDER_SHARE."""

    def run(batches):
        for batch in slices(batches):
            sets = [distinct_shingles(t, words, seed).view(np.int64) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.int64()))], ["hashes"])

    seen = id_and_text(docs).where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ORDER_SHARE)) == 0).select("text")
    counts = seen.mapInArrow(run, "hashes array<long>").select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    common = counts.where("n > 3").orderBy(F.desc("n"), "h").limit(ORDER_COMMON).collect()
    common.sort(key=lambda r: r.h % (1 << 64))
    return np.array([r.h for r in common], np.int64).view(np.uint64), np.array([r.n for r in common], np.int64)


def set_rows(docs: DataFrame, words: int, least: float, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, c, key, size, fp, prefix, sketch, short) of every row of ``docs``.

    ``key`` is a 128-bit digest of the set of shingle hashes, ``prefix`` its first hashes in one order of all hashes,
    common ones last, ``sketch`` and ``short`` its parity sketch whole and folded, ``fp`` the text's SimHash over the same
    hashes (repeats included), ``c`` a number of the row. The sets themselves are not kept. Narrow; ``c`` holds for one evaluation only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, words, seed))

    def prefix(h: np.ndarray) -> np.ndarray:
        known, counts = shared.value
        p = prefix_length(len(h), least)
        at = np.searchsorted(known, h)
        hit = np.zeros(len(h), bool)
        inside = at < len(known)
        hit[inside] = known[at[inside]] == h[inside]
        last = h[hit]
        last = last[np.lexsort((last, counts[at[hit]]))]
        return np.concatenate([h[~hit][:p], last])[:p].view(np.int64)

    def run(batches):
        c = TaskContext.get().partitionId() << 40
        longs = lambda arrays: pa.array(arrays, pa.list_(pa.int64()))
        for batch in slices(batches):
            fps, sets = np.zeros(batch.num_rows, np.uint64), []
            for n, text in enumerate(batch.column(1).to_pylist()):
                runs = list(shingle_hashes(text, words, seed))
                fps[n] = fingerprint_of(runs)
                sets.append(distinct_of(runs))
            sketches = [parity_sketch(h) for h in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array(range(c, c := c + len(sets)), pa.int64()), pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary()),
                    pa.array([len(h) for h in sets], pa.int32()), pa.array(fps.view(np.int64)), longs([prefix(h) if len(h) else h.view(np.int64) for h in sets]), longs(sketches), longs([folded(x, SHORT_SKETCH) for x in sketches]),
                ],
                ["doc_id", "text_hash", "c", "key", "size", "fp", "prefix", "sketch", "short"],
            )

    schema = "doc_id long, text_hash long, c long, key binary, size int, fp long, prefix array<long>, sketch array<long>, short array<long>"
    return id_and_text(docs).withColumn("text_hash", F.xxhash64("doc_id", "text")).mapInArrow(run, schema)


def named(docs: DataFrame) -> list:
    """Columns ``_id`` and ``_hash``, which name a row by its id and text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_id"), F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).alias("_hash")]


def whole_sets(docs: DataFrame, needed: DataFrame, words: int, seed: int = 42) -> DataFrame:
    """(c, hashes) of the rows ``needed`` (c, _id, _hash): their sets, made anew from the texts. Rows of ``docs`` that repeat
    give one each."""

    def run(batches):
        for batch in slices(batches):
            sets = [distinct_shingles(t, words, seed).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["c", "hashes"])

    texts = docs.select(*named(docs), F.coalesce("text", F.lit("")).alias("text")).join(needed, ["_id", "_hash"]).select("c", "text")
    return texts.mapInArrow(run, "c long, hashes array<long>")


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, least: float) -> DataFrame:
    """The ``pairs`` (a, b) of sets whose Jaccard similarity is at least ``least``, counted on the whole sets.

    Parity sketches first drop pairs that surely differ in too many elements; only the others' sets are made and met.
    """
    own = sets.select("c", "size", "sketch", "doc_id", "text_hash")
    side = lambda c: own.select(F.col("c").alias(c), F.col("size").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    fold = lambda x: f"zip_with(slice({x}, 1, size({x}) div 2), slice({x}, size({x}) div 2 + 1, size({x}) div 2), (x, y) -> x ^ y)"
    halved = lambda x, y: f"if(size({x}) > size({y}), {fold(x)}, {x})"
    differ = F.expr(f"aggregate(zip_with({halved('sa', 'sb')}, {halved('sb', 'sa')}, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x)")
    most = (1 - least) / (1 + least)
    near = pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(differ <= most * (F.col("na") + F.col("nb")) + 1e-6).select("a", "b", "na", "nb")
    near = materialize(near, "near-pairs")
    members = near.select(F.col("a").alias("c")).union(near.select(F.col("b").alias("c"))).distinct()
    # written, so that its size is known: where it is small it goes to the texts, and not the texts to it
    needed = materialize(own.join(members, "c").select("c", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"), F.col("text_hash").alias("_hash")), "needed")
    whole = materialize(whole_sets(docs, needed, words), "whole-sets")
    both = near.join(whole.select(F.col("c").alias("a"), F.col("hashes").alias("ha")), "a").join(whole.select(F.col("c").alias("b"), F.col("hashes").alias("hb")), "b")
    both = both.withColumn("i", F.size(F.array_intersect("ha", "hb")))
    out = materialize(both.where(F.col("i") / (F.col("na") + F.col("nb") - F.col("i")) >= least).select("a", "b").distinct(), "similar")
    release(whole)
    release(near)
    return out


def fingerprint_pairs(sets: DataFrame, bits: int) -> DataFrame:
    """(a, b) with a < b: each set ``c`` with the first set of its class of linked SimHash fingerprints ``fp``.

    Classes are those of ``op8``: deletion-variant links at ``bits`` or fewer differing bits, and their components. One pair
    a set, so a family of near copies grows in proportion.
    """
    distinct = materialize(sets.select("fp").distinct(), "set-fingerprints")
    classes = components(links(distinct, bits)).select(F.col("node").alias("fp"), "root")
    own = materialize(sets.select("c", "fp").join(classes, "fp", "left").select("c", F.coalesce("root", "fp").alias("root")), "fingerprint-classes")
    first = own.groupBy("root").agg(F.min("c").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return own.join(first, "root").where("c <> m").select(F.col("m").alias("a"), F.col("c").alias("b"))


def similar_components(sets: DataFrame, docs: DataFrame, words: int, least: float, bits: int = 2) -> DataFrame:
    """(node, root): components of the sets ``c`` of which each pair with a Jaccard similarity of at least ``least`` is linked.

    SimHash goes first: sets whose fingerprints are linked are compared with the first of their class, on the whole sets, and
    those similar enough are linked. An exact prefix-filter join then finds the pairs that SimHash doesn't reach, between sets
    that aren't linked yet: similar sets share a hash of their prefixes, are of like size, and have enough hashes left from
    there on. Sets that share a hot prefix hash are first compared with one set of their size only; what is then linked
    already needs no further comparison, so only sets of different components meet, and of those only pairs whose short
    sketches allow the similarity leave the join.
    """
    near = verified(fingerprint_pairs(sets, bits), sets, docs, words, least)
    roots = components(near).select(F.col("node").alias("c"), "root")
    rows = sets.join(roots, "c", "left").select("c", "size", F.coalesce("root", "c").alias("first"), F.posexplode("prefix").alias("pos", "h"))
    rows = materialize(rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("n > 1"), "prefixes")
    fits = F.expr(
        f"least(a.size, b.size) >= {least} * greatest(a.size, b.size) - 1e-9 and "
        f"least(a.size - a.pos, b.size - b.pos) >= {least / (1 + least)} * (a.size + b.size) - 1e-6"
    )
    pair = [F.least("a.c", "b.c").alias("a"), F.greatest("a.c", "b.c").alias("b")]
    few, hot = rows.where(F.col("n") <= HOT_SHINGLE), rows.where(F.col("n") > HOT_SHINGLE)
    plain = few.alias("a").join(few.alias("b"), (F.col("a.h") == F.col("b.h")) & (F.col("a.c") < F.col("b.c")) & (F.col("a.first") != F.col("b.first")) & fits).select(*pair)
    if hot.isEmpty():
        return components(near.union(verified(plain, sets, docs, words, least)))
    hot = hot.withColumn("band", F.floor(F.log("size") / math.log(1 / least)))
    leaders = hot.groupBy("h", "band").agg(F.min_by(F.struct("c", "first"), F.xxhash64("c", "h")).alias("m"))
    led = hot.join(leaders, ["h", "band"]).where("c <> m.c and first <> m.first").select(F.least("c", "m.c").alias("a"), F.greatest("c", "m.c").alias("b"))
    edges = near.union(verified(plain.union(led), sets, docs, words, least))
    linked = materialize(components(edges), "linked")
    placed = hot.drop("band", "first").join(linked.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    placed = materialize(placed.join(sets.select("c", "short"), "c"), "hot")
    major = placed.groupBy("h", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("h").agg(F.max_by("root", F.struct("k", "root")).alias("major"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    mixed = materialize(placed.join(major, "h"), "mixed")
    # each pair once: from the greater root if both are apart from the major one
    apart = (F.col("a.h") == F.col("b.h")) & ((F.col("b.root") == F.col("b.major")) | (F.col("a.root") > F.col("b.root"))) & (F.col("a.root") != F.col("b.root")) & fits
    differ = " + ".join(f"bit_count(a.short[{k}] ^ b.short[{k}])" for k in range(SHORT_SKETCH))
    allowed = F.expr(f"{differ} <= {(1 - least) / (1 + least)} * (a.size + b.size) + 1e-6")
    more = mixed.where("root <> major").alias("a").join(mixed.alias("b"), apart & allowed).select(*pair)
    found = verified(more, sets, docs, words, least)
    return linked if found.isEmpty() else components(edges.union(found))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = 2) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (ties: smallest text hash); nulls lose.

    Texts are linked if the Jaccard similarity of their sets of ``words``-word shingles is at least ``similarity``, every
    such pair: SimHash fingerprints that differ in at most ``bits`` bits propose the first links, each verified on the sets,
    and an exact join finds the others (see ``similar_components``); texts without words, null or empty, are alike. Columns stay as they are,
    whatever their names. Rows that agree in id and text count as one. An empty table gives none.
    """
    rows = materialize(set_rows(docs, words, similarity), "set-rows")
    distinct = materialize(rows.groupBy("key").agg(F.min("c").alias("c")), "distinct-sets")
    sets = materialize(rows.where("size > 0").drop("key").join(distinct.select("c"), "c", "left_semi"), "sets")
    linked = similar_components(sets, docs, words, similarity, bits)
    classes = distinct.join(linked.withColumnRenamed("node", "c"), "c", "left").select("key", F.coalesce("root", "c").alias("root"))
    each = rows.groupBy("key", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))  # repeated rows, before they meet
    named_rows = each.join(classes, "key").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "n")).alias("k"))
    keys = materialize(named_rows.select(F.coalesce("k.doc_id", F.lit(-(1 << 63))).alias("_id"), F.col("k.text_hash").alias("_hash"), F.col("k.n").alias("_n")), "kept-keys")
    kept = docs.select(whole_row(docs).alias("row"), *named(docs)).join(keys, ["_id", "_hash"])
    once, again = kept.where("_n = 1"), kept.where("_n > 1").dropDuplicates(["_id", "_hash"])  # only repeated rows are shuffled for it
    return once.select("row.*").union(again.select("row.*"))
