"""Collocations: count tries of limited depth for each shard, merged by ranges of prefixes, scored by their weakest cut.

A task counts its words and phrases in a trie held as sorted arrays, one level a phrase length. When the trie is full it is
cut by the range that the hash of a node's first two words falls into (ranges of hashes are even, whatever the words),
and each piece goes to its range as one compressed row. There all pieces of a language are merged and counts below the
least are dropped; a walk down the merged trie gives each phrase the count of the phrase without its last words. What
stands right of a cut is found through suffix links, a join of phrases by their words.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import column, materialize
from meterlake.llm.sharding import prefix_sums

#: Words that a task counts before its trie is cut and sent: some 150 MB of arrays.
RUN_WORDS = 2_000_000
#: Distinct words of a task's vocabulary before all its tries are sent and words are numbered anew.
VOCABULARY_WORDS = 1_000_000
#: Bytes of text for each range of prefixes; a range is merged in one task, in steps of at most MERGE_NODES nodes.
RANGE_BYTES = 16 << 20
MERGE_NODES = 2_000_000
#: So many languages are sent to every task; more are joined by a shuffle.
FEW_LANGUAGES = 10_000
#: Stands between pieces: no byte of UTF-8.
MARK = 0xFF
#: Lower-cases A-Z, puts the mark in place of what ends a piece: [.,;:!?] and \n \v \f \r.
TABLE = bytes(b + 32 if 65 <= b <= 90 else MARK if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))


class Numbers(dict):
    """Word -> number from 1 in order of arrival; the mark is 0."""

    def __init__(self):
        super().__init__({bytes([MARK]): 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def numbered(text: bytes, numbers: Numbers) -> list[int]:
    """Words of a text by number, 0 between its pieces and at its end."""
    words = text.translate(TABLE).replace(b"\xff", b" \xff ").split()  # what is left of white space: blank and tab
    return [*map(numbers.__getitem__, words), 0]


def summed(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys ascending, sum of counts of each, place of each key among them)."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(new)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    total = np.diff(np.append(starts, len(keys))) if counts is None else np.add.reduceat(counts[order], starts) if len(starts) else np.zeros(0, np.int64)
    return ordered[starts], total.astype(np.int64), place


class Trie:
    """Counts of words and phrases: ``words`` ascending as bytes, and for each length the nodes' parent (place one level up),
    word (place in ``words``) and count, ascending by parent and word. A node that only leads to others counts 0."""

    def __init__(self, words: pa.Array, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.words, self.levels = words, levels

    @property
    def size(self) -> int:
        return sum(len(count) for _, _, count in self.levels)

    @classmethod
    def counted(cls, ids: np.ndarray, names: list[bytes], depth: int) -> "Trie":
        """Of word numbers with 0 between pieces; ``names`` by number."""
        used = np.unique(ids)
        used = used[used > 0]
        words = sorted(names[k] for k in used.tolist())
        place = {w: k for k, w in enumerate(words)}
        to = np.zeros(int(used.max(initial=0)) + 1, np.int64)
        to[used] = [place[names[k]] for k in used.tolist()]
        at = np.where(ids > 0, to[ids], -1)
        levels, here, node = [], np.arange(len(at)), np.zeros(len(at), np.int64)
        for n in range(depth):
            inside = (here + n < len(at))
            here, node = here[inside], node[inside]
            inside = at[here + n] >= 0
            here, node = here[inside], node[inside]
            keys, counts, node = summed(node * (len(words) + 1) + at[here + n], None)
            levels.append((keys // (len(words) + 1), keys % (len(words) + 1), counts))
        return cls(pa.array(words, pa.binary()), levels)

    @classmethod
    def merged(cls, tries: list["Trie"]) -> "Trie":
        """The sum of several, level by level: sorted runs of children meet under the node that their parents became."""
        coded = pa.chunked_array([t.words for t in tries]).combine_chunks().dictionary_encode()
        names = coded.dictionary.to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        ranks, ends = rank[coded.indices.to_numpy()], np.cumsum([len(t.words) for t in tries]).tolist()
        words = [ranks[a:b] for a, b in zip([0, *ends], ends)]
        levels, parents = [], [np.zeros(1, np.int64)] * len(tries)
        for n in range(len(tries[0].levels)):
            keys = np.concatenate([p[t.levels[n][0]] * (len(names) + 1) + w[t.levels[n][1]] for t, p, w in zip(tries, parents, words)])
            keys, counts, place = summed(keys, np.concatenate([t.levels[n][2] for t in tries]))
            levels.append((keys // (len(names) + 1), keys % (len(names) + 1), counts))
            ends = np.cumsum([len(t.levels[n][0]) for t in tries]).tolist()
            parents = [place[a:b] for a, b in zip([0, *ends], ends)]
        return cls(coded.dictionary.take(pa.array(order, pa.int64())).cast(pa.binary()), levels)

    def ranges(self, n: int) -> list[np.ndarray]:
        """The range of prefixes, of ``n``, that each node belongs to: by its first two words."""
        own = np.array([zlib.crc32(w) for w in self.words.to_pylist()], np.uint64)
        out = []
        for level, (parent, word, _) in enumerate(self.levels):
            if level == 0:
                hashed = own[word]
            elif level == 1:
                hashed = own[self.levels[0][1][parent]] * np.uint64(0x9E3779B1) + own[word]
            if level < 2:
                mixed = (hashed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                out.append(((mixed * np.uint64(n)) >> np.uint64(32)).astype(np.int64))
            else:
                out.append(out[-1][parent])
        return out

    def cut(self, n: int):
        """(range, trie) for each range that has nodes: its nodes with what leads to them."""
        ranges = self.ranges(n)
        orders = [np.argsort(r, kind="stable") for r in ranges]
        bounds = [np.searchsorted(r[o], np.arange(n + 1)) for r, o in zip(ranges, orders)]
        for g in range(n):
            picked = [o[b[g] : b[g + 1]] for o, b in zip(orders, bounds)]
            if not any(map(len, picked)):
                continue
            first = np.unique(np.concatenate([picked[0], self.levels[1][0][picked[1]]])) if len(self.levels) > 1 else picked[0]
            kept, levels, before = [first, *picked[1:]], [], np.zeros(1, np.int64)
            for level, ((parent, word, count), rows) in enumerate(zip(self.levels, kept)):
                own = count[rows] if level else np.where(ranges[0][rows] == g, count[rows], 0)
                levels.append((np.searchsorted(before, parent[rows]) if level else np.zeros(len(rows), np.int64), word[rows], own))
                before = rows
            used = np.unique(np.concatenate([w for _, w, _ in levels]))
            yield g, Trie(self.words.take(pa.array(used)), [(p, np.searchsorted(used, w), c) for p, w, c in levels])

    def pack(self) -> bytes:
        """Compressed bytes: words in order, then each level as children of each parent, words, counts."""
        names = self.words.to_pylist()
        parts = [b"\n".join(names)]
        above = 1
        for parent, word, count in self.levels:
            parts += [np.bincount(parent, minlength=above).astype("<u4").tobytes(), word.astype("<u4").tobytes(), count.astype("<u8").tobytes()]
            above = len(parent)
        head = np.array([len(names), *map(len, parts)], "<u8").tobytes()
        return zstandard.ZstdCompressor(level=1).compress(np.array([len(head)], "<u8").tobytes() + head + b"".join(parts))

    @classmethod
    def unpacked(cls, data: bytes) -> "Trie":
        data = zstandard.ZstdDecompressor().decompress(data)
        size = int(np.frombuffer(data, "<u8", 1)[0])
        n, *sizes = np.frombuffer(data, "<u8", size // 8, 8).tolist()
        at, parts = 8 + size, []
        for s in sizes:
            parts.append(data[at : at + s])
            at += s
        levels = []
        for k in range(1, len(parts), 3):
            below, word, count = np.frombuffer(parts[k], "<u4"), np.frombuffer(parts[k + 1], "<u4"), np.frombuffer(parts[k + 2], "<u8")
            levels.append((np.repeat(np.arange(len(below)), below), word.astype(np.int64), count.astype(np.int64)))
        return cls(pa.array(parts[0].split(b"\n") if n else [], pa.binary()), levels)

    def frequent(self, least: int):
        """(length, words of each phrase as lists, counts, counts of what leads to it from length 2 on) of counts of at least ``least``."""
        paths, walked = None, []
        for n, (parent, word, count) in enumerate(self.levels):
            paths = word[:, None] if n == 0 else np.concatenate([paths[parent], word[:, None]], axis=1)
            walked = [x[parent] for x in walked]
            if n >= 2:
                walked.append(self.levels[n - 1][2][parent])
            rows = np.flatnonzero(count >= least)
            if len(rows):
                words = [self.words.take(pa.array(paths[rows, k])).to_pylist() for k in range(n + 1)]
                yield n + 1, list(zip(*words)), count[rows].tolist(), [list(x) for x in zip(*(w[rows].tolist() for w in walked))] if walked else [[] for _ in rows]


RUNS = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("trie", pa.binary())])
NODES = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("f", pa.int64()), ("lefts", pa.list_(pa.int64()))])


def runs(texts: DataFrame, depth: int, ranges: int) -> DataFrame:
    """(range int, lang string, trie binary) of (lang, text): the pieces of each task's tries."""

    def run(batches):
        numbers, held, sizes = Numbers(), {}, {}

        def sent(lang):
            ids = np.concatenate(held.pop(lang)).astype(np.int64)
            del sizes[lang]
            pieces = [(g, trie.pack()) for g, trie in Trie.counted(ids, list(numbers), depth).cut(ranges)]
            for at in range(0, len(pieces), 64):
                some = pieces[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in some], pa.int32()), pa.array([lang] * len(some), pa.string()), pa.array([b for _, b in some], pa.binary())], schema=RUNS)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                ids = numbered(text.as_py(), numbers)
                held.setdefault(lang, []).append(np.array(ids, np.int32))
                sizes[lang] = sizes.get(lang, 0) + len(ids)
                if sizes[lang] >= RUN_WORDS:
                    yield from sent(lang)
                if sum(sizes.values()) >= 2 * RUN_WORDS or len(numbers) >= VOCABULARY_WORDS:
                    for each in list(held):
                        yield from sent(each)
                    numbers = Numbers()
        for lang in list(held):
            yield from sent(lang)

    return texts.mapInArrow(run, "range int, lang string, trie binary")


def merged_nodes(pieces: DataFrame, ranges: int, least: int) -> DataFrame:
    """(lang, words, f, lefts) of phrases that occur ``least`` times, and for each range and language a row of null words with
    the number of all word occurrences."""

    def run(batches):
        def done(lang, trie):
            count = int(trie.levels[0][2].sum())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([lang, None, count, None], NODES.types)], schema=NODES)
            for _, words, counts, lefts in trie.frequent(least):
                for at in range(0, len(words), 4096):
                    cut = slice(at, at + 4096)
                    rows = [[lang] * len(words[cut]), [[w.decode(errors="replace") for w in p] for p in words[cut]], counts[cut], lefts[cut]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, NODES.types)], schema=NODES)

        lang, held = None, []
        for batch in batches:
            for own, piece in zip(batch.column(1).to_pylist(), batch.column(2)):
                if held and own != lang:
                    yield from done(lang, Trie.merged(held))
                    held = []
                lang = own
                held.append(Trie.unpacked(piece.as_py()))
                if len(held) > 1 and sum(t.size for t in held[1:]) >= max(MERGE_NODES, held[0].size):
                    held = [Trie.merged(held)]
        if held:
            yield from done(lang, Trie.merged(held))

    dealt = pieces.repartitionById(ranges, F.col("range")).sortWithinPartitions("lang")
    return dealt.mapInArrow(run, "lang string, words array<string>, f long, lefts array<long>")


def _phrase(words: Column, first: int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, share: int = 50, top: int | None = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase string; a, l, r, n, score long): the first ``top`` phrases of 2 to ``max_words`` words of each language (None: all).

    Texts are lower-cased (A-Z), split at ``[.,;:!?\\n\\v\\f\\r]`` into pieces and at blanks and tabs into words; a phrase stays inside
    a piece. ``a`` counts it (at least ``least`` times), ``n`` counts all words of the language. A cut after k words has
    score floor(1000000 * a * a / (l * r)), l and r being the counts of its sides; the lowest counts, ties to the smallest k. A phrase
    inside a longer one that occurs ``share`` percent as often or more goes. Order: score and a descending, phrase ascending by bytes.

    A null text has no words, a null language is ``und``, repeated rows count each; texts of any length are counted
    whole; extra columns are ignored; an empty table gives none.
    """
    if max_words < 2:
        raise ValueError("phrases have at least two words")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(column(lang_col), F.lit("und")).alias("lang"), column(text_col).alias("text")).where("text is not null and text <> ''")
    held = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // RANGE_BYTES))
    nodes = materialize(merged_nodes(runs(texts, max_words, ranges), ranges, least), "phrases")
    n = nodes.where("words is null").groupBy("lang").agg(F.sum("f").alias("n"))
    counts = nodes.where("words is not null").select("lang", F.array_join("words", " ").alias("phrase"), "f")
    found = nodes.where(F.size("words") > 1).select("lang", "words", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "lefts")
    exact = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    cuts = []
    for k in range(1, max_words):
        right = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_right"), F.col("f").alias(f"r{k}"))
        found = found.withColumn("_s", _phrase(F.col("words"), k + 1, max_words)).join(right, (F.col("lang") == F.col("_lang")) & (F.col("_s") == F.col("_right")) & (F.size("words") > k), "left").drop("_lang", "_right", "_s")
        if k == 1:
            word = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_left"), F.col("f").alias("l1"))
            found = found.join(word, (F.col("lang") == F.col("_lang")) & (F.get("words", 0) == F.col("_left"))).drop("_lang", "_left")
        else:
            found = found.withColumn(f"l{k}", F.when(F.size("words") > k, F.get("lefts", k - 2)))
        score = F.call_function("div", exact("a", 15) * exact("a", 15) * F.lit(1_000_000).cast("decimal(7,0)"), exact(f"l{k}", 15) * exact(f"r{k}", 15))
        cuts.append(F.when(F.size("words") > k, F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))))
    scored = found.withColumn("cut", F.array_min(F.filter(F.array(*cuts), lambda c: c.isNotNull())))
    scored = materialize(scored.select("lang", "words", "phrase", "a", "cut"), "scored")
    inner = scored.where(F.size("words") > 2).select("lang", "words", "a").withColumn("_at", F.explode(_inside(max_words)))
    inner = inner.where("_at.first + _at.size <= size(words) and _at.size < size(words)").groupBy("lang", _phrase(F.col("words"), F.col("_at.first") + 1, F.col("_at.size")).alias("phrase")).agg(F.max("a").alias("_longer"))
    left = scored.join(inner, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (100 * F.col("_longer") < share * F.col("a")))
    left = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("_one", F.lit(1).cast("long"))
    placed = prefix_sums(left, [F.col("lang"), -F.col("score"), -F.col("a"), F.col("phrase")], "_one", "ranked").drop("_before", "_all")
    by_lang = placed.groupBy("lang").agg(F.min("_rank").alias("_first")).join(n, "lang")
    few = n.limit(FEW_LANGUAGES + 1).count() <= FEW_LANGUAGES
    ranked = placed.join(F.broadcast(by_lang) if few else by_lang, "lang").withColumn("rank", F.col("_rank") - F.col("_first") + 1)
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _inside(max_words: int) -> Column:
    """Places of phrases of two words or more inside a longer one."""
    return F.array(*(F.struct(F.lit(first).alias("first"), F.lit(size).alias("size")) for size in range(2, max_words) for first in range(max_words - size + 1))) if max_words > 2 else F.array().cast("array<struct<first:int,size:int>>")
