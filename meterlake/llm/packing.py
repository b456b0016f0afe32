"""Best-fit packing of documents into fixed-length sequences by bin completion over the global histogram of lengths.

Pieces of equal length are interchangeable, so the search runs on the histogram (at most ``capacity`` rows, whatever
the corpus): fillings with multiplicities, not documents, are enumerated. Every piece then finds its place through
its rank among the pieces of its length, so nothing that grows with the corpus leaves the executors.
"""

from __future__ import annotations

import logging
import random
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.bpe import loaded
from meterlake.llm.common import id_and_text, materialize, release, slices
from meterlake.llm.tokens import LibraryEncoder

logger = logging.getLogger(__name__)

CAPACITY = 2048
#: Fillings that the branch-and-bound search takes or looks at before it starts anew, and how often it does; the only limits.
SEARCH_NODES, RESTARTS = 20_000, 24
#: A new start looks at a fifth of the fillings and takes up to so many of the best fillings of a bin in another order.
VARIED = 3
#: Deepest frames of the search that keep their place in the list of fillings; others find it anew.
KEPT_FRAMES = 32


def best_fit_fill(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Fills ``room`` greedily with the largest length that is left and fits; ``lengths`` ascend."""
    out: list[int] = []
    used: dict[int, int] = {}
    at = bisect_right(lengths, room)
    while at:
        x = lengths[at - 1]
        k = min(counts[x] - used.get(x, 0), room // x)
        if k > 0:
            out += [x] * k
            used[x] = used.get(x, 0) + k
            room -= x * k
        at = min(at - 1, bisect_right(lengths, room))
    return out


def fillings(counts: dict[int, int], room: int, waste: int) -> Iterator[list[int]]:
    """Every undominated filling of ``room`` that wastes at most ``waste``, one by one, least waste first.

    Sums that can be reached are known for each number of smallest lengths, so no branch ends without a filling. A
    filling is dominated if a left-out piece still fits beside it.
    """
    lengths = sorted(x for x in counts if x <= room)
    mask = (1 << room + 1) - 1
    reach = [1]
    for x in lengths:
        sums, left, k = reach[-1], min(counts[x], room // x), 1
        while left:
            k = min(k, left)
            sums |= sums << k * x & mask
            left, k = left - k, 2 * k
        reach.append(sums)

    def exact(top: int, target: int) -> Iterator[list[int]]:
        if not target:
            yield []
            return
        for j in range(min(top, bisect_right(lengths, target)), 0, -1):
            if not reach[j] >> target & 1:
                return
            x = lengths[j - 1]
            for k in range(min(counts[x], target // x), 0, -1):
                if reach[j - 1] >> target - k * x & 1:
                    for rest in exact(j - 1, target - k * x):
                        yield [x] * k + rest

    for w in range(min(waste, room) + 1):
        for found in exact(len(lengths), room - w) if reach[-1] >> room - w & 1 else ():
            if not any(counts[x] > found.count(x) for x in lengths[: bisect_right(lengths, w)]):
                yield found


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Incumbent: largest piece first, each bin filled by best fit; [(lengths in a bin, number of such bins)]."""
    counts = dict(histogram)
    lengths = sorted(counts)
    out = []
    while lengths:
        first = lengths[-1]
        counts[first] -= 1
        filling = [first, *best_fit_fill([x for x in lengths if counts[x]], counts, capacity - first)]
        counts[first] += 1
        out.append((filling, times := min(counts[x] // filling.count(x) for x in set(filling))))
        for x in set(filling):
            counts[x] -= times * filling.count(x)
        lengths = [x for x in lengths if counts[x]]
    return out


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: the greatest, over all thresholds up to half the capacity, of the number of pieces over
    half of it and what the pieces from the threshold up to half can't fill into those bins."""
    number, total = np.zeros(capacity + 2, np.int64), np.zeros(capacity + 2, np.int64)
    for x, n in histogram.items():
        number[x], total[x] = n, x * n
    number, total = number[::-1].cumsum()[::-1], total[::-1].cumsum()[::-1]  # of pieces of at least that length
    half = capacity // 2
    best = -(-int(total[0]) // capacity)
    for least in range(1, half + 1):
        above = capacity - least + 1  # these share a bin with no piece of the threshold or more
        room = int(number[half + 1] - number[above]) * capacity - int(total[half + 1] - total[above])
        best = max(best, int(number[half + 1]) + max(0, -(-(int(total[least] - total[half + 1]) - room) // capacity)))
    return max(best, int(number[half + 1]))


class Packing(NamedTuple):
    """(lengths in a bin, number of such bins) of a packing, bins that any packing needs, and whether fewer are ruled out."""

    bins: list[tuple[list[int], int]]
    bound: int
    proven: bool


def bin_completion(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int | None = SEARCH_NODES, restarts: int = RESTARTS) -> list[tuple[list[int], int]]:
    """The bins of ``packing_of``."""
    return packing_of(histogram, capacity, nodes, restarts).bins


def varied(found: Iterator[list[int]], rng: random.Random | None) -> Iterator[list[int]]:
    """``found`` in its order or, with ``rng``, the first few of it (at most VARIED) in another order before the rest."""
    if rng is None:
        yield from found
        return
    some = list(islice(found, rng.randint(1, VARIED)))
    rng.shuffle(some)
    yield from some
    yield from found


def packing_of(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int | None = SEARCH_NODES, restarts: int = RESTARTS) -> Packing:
    """The best packing of one search of ``nodes`` fillings and, while fewer bins aren't ruled out, of up to ``restarts`` searches of a
    fifth of that, each with the fillings of a bin in another order (the same in every run). With ``nodes`` None the first search goes on until it is proven.

    A search only varies the bins it fills last before its nodes are used up; those it fills first are varied by starting anew.
    """
    best = _searched(histogram, capacity, nodes, None)
    for seed in range(restarts):
        if best.proven:
            break
        found = _searched(histogram, capacity, nodes // 5, random.Random(seed))
        if found.proven or sum(n for _, n in found.bins) < sum(n for _, n in best.bins):
            best = found
    return best


def _searched(histogram: dict[int, int], capacity: int, nodes: int | None, rng: random.Random | None) -> Packing:
    """Branch-and-bound over fillings around the largest piece left.

    A node takes one undominated filling as often as the counts allow, and when all were tried, each fewer times. Waste
    so far may not exceed what a better solution than the incumbent can waste in all (incumbent bins - 1, times
    capacity, minus all lengths); the search ends at ``lower_bound``, when nothing is left to try, or after ``nodes``
    fillings (None: never) with the best solution so far; only then is it not proven.
    """
    histogram = {x: n for x, n in histogram.items() if n > 0}
    if any(not 0 < x <= capacity for x in histogram):
        raise ValueError("lengths must lie between 1 and the capacity")
    total = sum(x * n for x, n in histogram.items())
    bound = lower_bound(histogram, capacity)
    best = best_fit_decreasing(histogram, capacity)
    best_bins = sum(n for _, n in best)
    #: a frame: waste and bins so far, how many choices were taken, the others (None: to be found anew); one table of counts
    #: serves all frames, as the way to a frame is applied to it and taken back
    limit = (best_bins - 1) * capacity - total
    path: list[tuple[list[int], int]] = []
    frames: list[list] = []
    counts = dict(histogram)

    def apply(filling: list[int], times: int) -> None:
        for x in set(filling):
            counts[x] = counts.get(x, 0) - times * filling.count(x)
            if not counts[x]:
                del counts[x]

    def choices(limit):
        first = max(counts)
        rest = {x: n - (x == first) for x, n in counts.items() if n > (x == first)}
        for fewer in (False, True):
            for found in varied(fillings(rest, capacity - first, limit), rng):
                filling = [first, *found]
                most = min(counts[x] // filling.count(x) for x in set(filling))
                yield from ((filling, k) for k in (range(most - 1, 0, -1) if fewer else [most]))
                if fewer and most == 1:
                    yield filling, 0

    if histogram and best_bins > bound:
        frames.append([0, 0, 0, None])
    while frames and nodes != 0 and best_bins > bound:
        top = frames[-1]
        waste, bins, taken, rest = top
        if rest is None:
            rest = top[3] = islice(choices(limit - waste), taken, None)
        filling, times = next(rest, (None, 0))
        if filling is None:
            frames.pop()
            if path:
                filling, times = path.pop()
                apply(filling, -times)
            continue
        top[2] += 1
        nodes = None if nodes is None else nodes - 1
        wasted = waste + times * (capacity - sum(filling))
        if not times or wasted > (best_bins - 1) * capacity - total:
            continue
        apply(filling, times)
        path.append((filling, times))
        if not counts:
            if bins + times < best_bins:
                best, best_bins = list(path), bins + times
            path.pop()
            apply(filling, -times)
            continue
        frames.append([wasted, bins + times, 0, None])
        if len(frames) > KEPT_FRAMES:
            frames[-1 - KEPT_FRAMES][3] = None
    return Packing(best, bound, best_bins == bound or not frames and rng is None)  # a varied search may skip fillings


def plan_rows(solution: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """(length, first rank, end rank, copies in a bin, place of the first copy, first sequence, length) for each length of each filling.

    Pieces of one length get consecutive ranks; those from ``first rank`` up to ``end rank`` go, ``copies`` at a time,
    into the sequences from ``first sequence`` on.
    """
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for filling, times in solution:
        offset = 0
        for x in dict.fromkeys(filling):
            k = filling.count(x)
            begin = taken.get(x, 0)
            taken[x] = begin + k * times
            rows.append((x, begin, taken[x], k, offset, sequence))
            offset += x * k
        sequence += times
    return rows


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int | None, capacity: int, with_ids: bool) -> DataFrame:
    """Pieces of every document in one narrow scan: (doc_id, piece, start, length, ids_crc32, part, nth[, ids binary]).

    ``nth`` counts the pieces of that length within the task ``part``, from 0.
    """
    tail = [] if end_id is None else [end_id]

    def run(batches):
        encoder, part = loaded(LibraryEncoder, vocabulary), TaskContext.get().partitionId()
        end = np.array(tail, encoder.dtype).tobytes()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                ids = np.frombuffer(raw + end, encoder.dtype).astype("<u4").tobytes()
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    n = len(cut) // 4
                    rows.append((doc_id, piece, at // 4, n, zlib.crc32(cut), part, int(seen[n]), cut))
                    seen[n] += 1
            columns = list(zip(*rows)) or [[]] * 8
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"]
            keep = 8 if with_ids else 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:keep], kinds)], names[:keep])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * with_ids
    return id_and_text(docs).mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int | None = 0, capacity: int = CAPACITY, with_ids: bool = False, nodes: int | None = SEARCH_NODES, restarts: int = RESTARTS) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids: little-endian u32].

    A document is the library's ids of its whole text (null: empty) and ``end_id``; only longer ones than ``capacity``
    are cut, into pieces of ``capacity`` with a shorter last one. Each sequence holds pieces without gaps from offset
    0. With ``end_id`` None an empty text has no piece. Null ids are kept; repeated rows are packed each; an empty
    table gives no rows; other columns are ignored. The number of sequences is that of ``packing_of`` over the
    histogram of all lengths, at most ``capacity`` rows, the only thing that the driver gets; ``nodes`` None searches until no fewer are possible.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, vocabulary, end_id, capacity, with_ids), "pieces")
    by_part = materialize(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    found = packing_of(histogram, capacity, nodes, restarts)
    if not found.proven:
        logger.warning("packing: %d sequences; any packing needs %d; %d searches ended before fewer were ruled out", sum(n for _, n in found.bins), found.bound, restarts + 1)
    plan = spark.createDataFrame(plan_rows(found.bins), "length long, first_rank long, end_rank long, copies long, place long, sequence long")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    # the plan has a few rows for each length (at most some thousands in all), so its size is bounded by the capacity
    at = (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank"))
    placed = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & at).drop(plan["length"])
    nth = F.col("rank") - F.col("first_rank")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("place") + F.pmod(nth, F.col("copies")) * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
