"""Product codes of vectors, by Lloyd's rounds that rescan only what a heap of bounds gives up.

Vectors are cut into parts, and each part position has a codebook. In every block of vectors a heap for each part and
entry holds the parts assigned to that entry, keyed by the slack between their bounds: lower bound of the distance to all
other entries minus upper bound of the distance to their own. When entries move, only parts whose slack the entry's
cumulative drift has used up are popped and compared with all entries again; all others are proven to stay. Components
and distances are whole numbers, so results don't depend on partitions or on the order of additions.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import column, materialize, release, slices

#: Vectors in a block, whose heaps are held together.
BLOCK_ROWS = 4096
#: Components are held between these bounds; sums of them stay exact far beyond any number of rows.
LIMIT = 1 << 62
#: Squared distances up to this size are exact as doubles.
EXACT = 1 << 52
#: Bounds are widened by this share, far above the rounding of a square root or a sum of drifts.
SAFE = 1e-9
MOST = (1 << 63) - 1


def cuts(dim: int, parts: int) -> list[slice]:
    """Places of ``parts`` consecutive parts of a vector, as equal as they can be."""
    return [slice(dim * p // parts, dim * (p + 1) // parts) for p in range(parts)]


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all entries: doubles where these are exact, else Python's integers."""
    if points.shape[1] == 0:
        return np.zeros((len(points), len(entries)))
    top = int(np.abs(points).max(initial=0)) + int(np.abs(entries).max(initial=0))
    if top * top * points.shape[1] < EXACT:
        x, c = points.astype(float), entries.astype(float)
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    return np.stack([((points.astype(object) - c) ** 2).sum(axis=1) for c in entries.astype(object)], axis=1)


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each point's nearest entry (ties to the lower) and the slack of its bounds."""
    d = distances(points, entries)
    code = np.argmin(d, axis=1)
    if len(entries) == 1:
        return code, np.full(len(points), np.inf)
    best = d[np.arange(len(d)), code]
    d[np.arange(len(d)), code] = d.max() + 1 if len(d) else 0
    root = lambda x: np.sqrt(x.astype(float))
    return code, root(d.min(axis=1)) * (1 - SAFE) - root(best) * (1 + SAFE)


def drift(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How much of its parts' slack each entry uses up by a move: its own way and the longest way of another one."""
    if old.shape[1] == 0 or len(old) == 1:
        return np.zeros(len(old))
    way = np.sqrt(np.array([int(sum((int(a) - int(b)) ** 2 for a, b in zip(x, y))) for x, y in zip(old, new)], float)) * (1 + SAFE)
    first = int(way.argmax())
    others = np.full(len(way), way[first])
    others[first] = np.delete(way, first).max()
    return (way + others) * (1 + SAFE)


class Heaps:
    """The parts of a block at one position: their codes, and for each entry a heap of (key, row); a part is proven to stay
    with its entry as long as its key is over the entry's cumulative drift."""

    def __init__(self, points: np.ndarray, entries: np.ndarray, used: np.ndarray):
        self.points = points
        self.codes, slack = nearest(points, entries)
        self.heaps = [[] for _ in entries]
        for row, (code, key) in enumerate(zip(self.codes.tolist(), (slack + used[self.codes]).tolist())):
            self.heaps[code].append((key, row))
        for heap in self.heaps:
            heapify(heap)

    @classmethod
    def restored(cls, points: np.ndarray, codes: np.ndarray, keys: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> "Heaps":
        self = cls.__new__(cls)
        self.points, self.codes = points, codes
        both, ends = list(zip(keys.tolist(), rows.tolist())), np.cumsum(sizes).tolist()
        self.heaps = [both[a:b] for a, b in zip([0, *ends], ends)]
        return self

    def stored(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys rounded down, rows, sizes) of all heaps in their heap order."""
        both = [x for heap in self.heaps for x in heap]
        keys = np.array([k for k, _ in both], float).astype("<f4")
        return np.nextafter(keys, np.float32(-np.inf)), np.array([r for _, r in both], "<i4"), np.array([len(h) for h in self.heaps], "<i4")

    def move(self, entries: np.ndarray, used: np.ndarray) -> int:
        """Entries have moved and ``used`` up that much in all: pops and rescans; returns how many were rescanned."""
        out = []
        for heap, most in zip(self.heaps, used.tolist()):
            while heap and heap[0][0] <= most:
                out.append(heappop(heap)[1])
        if out:
            codes, slack = nearest(self.points[out], entries)
            self.codes[out] = codes
            for row, code, key in zip(out, codes.tolist(), (slack + used[codes]).tolist()):
                heappush(self.heaps[code], (key, row))
        return len(out)


def _pack(arrays) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


STATE = "rows binary, width int, points binary, codes binary, keys binary, heap_rows binary, sizes binary, rescanned long, counts array<long>, sums array<decimal(38,0)>"


def _state_schema() -> pa.Schema:
    kinds = {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<decimal(38,0)>": pa.list_(pa.decimal128(38, 0))}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in STATE.split(", "))])


def _state(row: list) -> pa.RecordBatch:
    schema = _state_schema()
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types)], schema=schema)


class Codebooks:
    """All entries (part -> rows of whole numbers) and how much slack each entry has used up; a few thousand numbers."""

    def __init__(self, books: list[np.ndarray], used: list[np.ndarray] | None = None):
        self.books = books
        self.used = used or [np.zeros(len(b)) for b in books]

    def updated(self, counts: np.ndarray, sums: list[np.ndarray]) -> "Codebooks":
        books, used = [], []
        for book, own, n, total in zip(self.books, self.used, counts, sums):
            new = np.array([[int(s) // int(k) for s in t] if k else row for row, k, t in zip(book.tolist(), n, total)], np.int64).reshape(book.shape)
            books.append(new)
            used.append(own + drift(book, new))
        return Codebooks(books, used)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.books for x in book.ravel().tolist()).encode()).hexdigest()


def _blocks(batches, dim: int):
    """(carried rows, points) of Arrow batches whose last column holds the vectors."""
    for batch in slices(batches, BLOCK_ROWS):
        vectors = batch.column(batch.num_columns - 1)
        rows = batch.select(list(range(batch.num_columns - 1)))
        yield rows, np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(batch.num_rows, dim)


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


class _Block:
    """The heaps of all parts of one block, as a row of the state table and back."""

    def __init__(self, rows: bytes, points: np.ndarray, heaps: list[Heaps], rescanned: int):
        self.rows, self.points, self.heaps, self.rescanned = rows, points, heaps, rescanned

    def row(self) -> list:
        top = int(np.abs(self.points).max(initial=0))
        width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
        keys, places, sizes = zip(*(h.stored() for h in self.heaps))
        codes = [h.codes.astype("<u4") for h in self.heaps]
        return [self.rows, width, self.points.astype(f"<i{width}").tobytes(), _pack(codes), _pack(keys), _pack(places), _pack(sizes), self.rescanned, None, None]

    @classmethod
    def read(cls, x: dict, dim: int, parts: list[slice]) -> "_Block":
        each = lambda name, kind: np.frombuffer(x[name], kind).reshape(len(parts), -1)
        points = np.frombuffer(x["points"], f"<i{x['width']}").astype(np.int64).reshape(each("codes", "<u4").shape[1], dim)
        stored = zip(parts, each("codes", "<u4"), each("keys", "<f4"), each("heap_rows", "<i4"), each("sizes", "<i4"))
        return cls(x["rows"], points, [Heaps.restored(points[:, p], c.astype(np.int64), k, r, s) for p, c, k, r, s in stored], 0)


class _Sums:
    """Counts and sums of the parts of a task's blocks, by part and entry."""

    def __init__(self, books: list[np.ndarray]):
        self.counts = [np.zeros(len(b), np.int64) for b in books]
        self.sums = [np.zeros(b.shape, object) for b in books]
        self.any = False

    def add(self, block: _Block) -> None:
        self.any = True
        for heaps, n, total in zip(block.heaps, self.counts, self.sums):
            n += np.bincount(heaps.codes, minlength=len(n))
            small = int(np.abs(heaps.points).max(initial=0)) * max(1, len(heaps.points)) < EXACT
            for k in range(total.shape[1]):
                x = heaps.points[:, k]
                if small:
                    total[:, k] += np.bincount(heaps.codes, x, minlength=len(n)).astype(np.int64).astype(object)
                else:
                    np.add.at(total[:, k], heaps.codes, x.astype(object))

    def row(self) -> list:
        return [None] * 8 + [np.concatenate(self.counts).tolist(), [Decimal(int(x)) for s in self.sums for x in s.ravel()]]


def _assigned(vectors: DataFrame, dim: int, parts: list[slice], books: Codebooks) -> DataFrame:
    """The first round's state: every part compared with every entry, heaps built; one row a block, one of sums a task."""

    def run(batches):
        sums = _Sums(books.books)
        for rows, points in _blocks(batches, dim):
            heaps = [Heaps(points[:, p], b, u) for p, b, u in zip(parts, books.books, books.used)]
            block = _Block(_ipc(rows), points, heaps, len(points) * len(parts))
            sums.add(block)
            yield _state(block.row())
        if sums.any:
            yield _state(sums.row())

    return vectors.mapInArrow(run, STATE)


def _moved(state: DataFrame, dim: int, parts: list[slice], books: Codebooks) -> DataFrame:
    """A later round's state: only parts that their heaps give up are compared again."""

    def run(batches):
        sums = _Sums(books.books)
        for batch in batches:
            for x in batch.to_pylist():
                block = _Block.read(x, dim, parts)
                block.rescanned = sum(h.move(b, u) for h, b, u in zip(block.heaps, books.books, books.used))
                sums.add(block)
                yield _state(block.row())
        if sums.any:
            yield _state(sums.row())

    return state.where("points is not null").mapInArrow(run, STATE)


def _coded(state: DataFrame, dim: int, parts: list[slice], books: Codebooks, carried: str, digits: int) -> DataFrame:
    """(carried columns, code, error) by the final entries."""

    def run(batches):
        for batch in batches:
            for x in batch.to_pylist():
                block = _Block.read(x, dim, parts)
                error = np.zeros(len(block.points), object)
                for heaps, book, used in zip(block.heaps, books.books, books.used):
                    heaps.move(book, used)
                    gap = heaps.points.astype(object) - book[heaps.codes] if int(np.abs(heaps.points).max(initial=0)) + int(np.abs(book).max(initial=0)) > 1 << 20 else heaps.points - book[heaps.codes]
                    error = error + (gap * gap).sum(axis=1)
                codes = np.stack([h.codes for h in block.heaps], axis=1).tolist()
                rows = pa.ipc.open_stream(pa.py_buffer(x["rows"])).read_all().combine_chunks().to_batches()
                rows = rows[0]
                more = [pa.array(["".join(f"{c:0{digits}x}" for c in row) for row in codes]), pa.array([min(int(e), MOST) for e in error], pa.int64())]
                yield pa.RecordBatch.from_arrays([*rows.columns, *more], [*rows.schema.names, "code", "error"])

    return state.where("points is not null").mapInArrow(run, f"{carried}, code string, error long")


def vector_codes(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id long, label, code string, error long, label_error long, codebooks_sha256 string).

    Components become floor(``scale`` * x), held within +-2^62. Codebooks start as the parts of the ``entries`` vectors of
    smallest id (null ids last; vectors of one id in the order of their components). In each of ``rounds`` every part goes
    to its nearest entry (ties to the lower index) and each entry becomes the floored mean of its parts; unused entries
    stay. ``code`` has two hex digits a part (more if there are over 256 entries); ``error`` sums the squared distances
    and ``label_error`` sums it over rows of one label, null labels together (over 2^63 - 1: that number).

    Rows whose vector is null or holds a null, infinite or NaN component are left out. Repeated rows count each. Vectors
    of another length than that of the smallest id share no codebook: they stay, with null code and error. A length that
    doesn't divide is cut as evenly as it can be; an empty part is entry 0 at distance 0. An empty table gives none.
    """
    spark = vectors.sparkSession
    x = F.transform(column(vector_col), lambda c: c.cast("double"))
    clean = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    held = lambda c: F.greatest(F.lit(-float(LIMIT)), F.least(c * scale, F.lit(float(LIMIT))))
    kind = vectors.select(column(label_col)).dtypes[0][1]
    kept = vectors.select(column(id_col).cast("long").alias("vec_id"), column(label_col).alias("label"), x.alias("x")).where("x is not null").where(clean)
    kept = kept.select("vec_id", "label", F.transform("x", lambda c: F.floor(held(c)).cast("long")).alias("v"))
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    first = kept.select("vec_id", "v").orderBy(*order).limit(entries).collect()
    if first and any(len(r.v) != len(first[0].v) for r in first):
        first = kept.where(F.size("v") == len(first[0].v)).select("vec_id", "v").orderBy(*order).limit(entries).collect()
    if not first:
        return spark.createDataFrame([], f"vec_id long, label {kind}, code string, error long, label_error long, codebooks_sha256 string")
    dim = len(first[0].v)
    where = cuts(dim, parts)
    start = np.array([r.v for r in first], np.int64).reshape(len(first), dim)
    books = Codebooks([start[:, p] for p in where])
    state = materialize(_assigned(kept.where(F.size("v") == dim), dim, where, books), "codes-0")
    for n in range(1, rounds + 1):
        books = books.updated(*_collected(state, books))
        if n < rounds:
            before, state = state, materialize(_moved(state, dim, where, books), f"codes-{n}")
            release(before)
    coded = _coded(state, dim, where, books, f"vec_id long, label {kind}", 2 if entries <= 256 else 8)
    others = kept.where(F.size("v") != dim).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    rows = materialize(coded.unionByName(others), "coded")
    release(state)
    most = F.lit(MOST).cast("decimal(38,0)")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    total = F.when(total > most, most).otherwise(total).cast("long")
    by_label = rows.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))
    joined = rows.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _collected(state: DataFrame, books: Codebooks) -> tuple[np.ndarray, list[np.ndarray]]:
    """Counts and sums of all tasks, by part and entry; as many numbers as the codebooks hold."""
    own = state.where("points is null")
    added = lambda name, kind: dict(own.select(F.posexplode(name).alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast(kind)).alias("x")).collect())
    counts, sums = added("counts", "long"), added("sums", "decimal(38,0)")
    n, at, out = len(books.books[0]), 0, []
    for book in books.books:
        out.append(np.array([int(sums[at + k]) for k in range(book.size)], object).reshape(book.shape))
        at += book.size
    return np.array([[counts[p * n + k] for k in range(n)] for p in range(len(books.books))]), out
