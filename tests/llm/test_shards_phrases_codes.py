"""Sharding, collocations and vector codes against plain versions, with nulls, ties, repeats, long texts and odd columns."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from meterlake.llm import collocations, common, queries, sharding, vector_codes

TABLES = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, size int, shard string, `a.b` int, `row` string, _part int, words string, f int, _o0 int"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    common.ship_package(spark)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "s", 2, "r", 3, "w", 4, 5) for i, t, lang in rows], ODD)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_byte_shards", "op12_collocations", "op13_vector_codes"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{TABLES}/{t}.parquet')")
    want, got = con.execute(queries.ORACLE_SQL[name]).fetchdf(), queries.QUERIES[name](spark, TABLES).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    plain = lambda d: sorted(map(str, d[columns].astype(object).where(d[columns].notna(), None).values.tolist()))
    assert plain(got) == plain(want)


# --- sharding -------------------------------------------------------------------------------------------------------


def plain_shards(rows, n):
    """(id, size, checksum, shard, slot) in the order of the ids."""
    own = sorted(((i is not None, i or 0), zlib.crc32((t or "").encode()), len((t or "").encode()) + 1, i) for i, t, _ in rows)
    total, before, out, slots = sum(x[2] for x in own), 0, [], Counter()
    for _, crc, size, i in own:
        shard = min(n - 1, (2 * before + size) * n // (2 * total))
        out.append((i, size, crc, shard, slots[shard]))
        slots[shard] += 1
        before += size
    return out


CASES = {
    "plain": [(i, "word " * (i % 7), "en") for i in range(50)],
    "one id": [(7, f"text {i % 3}", "en") for i in range(40)] + [(7, "text 0", None)] * 40,
    "nulls": [(None, None, None), (None, "", "en"), (None, "é😀", "en"), (3, None, None), (-2, "x", "en"), (2**62, "y", "en")] * 2,
    "long": [(1, "a" * 5_000_000, "en"), *((k, "b", "en") for k in range(2, 12))],
    "single": [(1, "a", "en")],
}


@pytest.mark.parametrize("n", [1, 3, 8])
@pytest.mark.parametrize("case", CASES)
def test_shards_equal_plain_prefix_sums(spark, case, n):
    out = sharding.shard_by_bytes(docs(spark, CASES[case]).repartition(3), n)
    got = sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in out.collect()), key=lambda x: (x[3], x[4]))
    assert got == plain_shards(CASES[case], n)
    assert all((r.row["a.b"], r.row["row"], r.row["shard"]) == (2, "r", "s") for r in out.collect())


def test_shards_of_no_rows_and_files(spark, tmp_path):
    df = docs(spark, CASES["plain"])
    assert sharding.shard_by_bytes(df.limit(0), 8).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_by_bytes(df, 0)
    sharding.write_shards(df, f"{tmp_path}/shards", 4)
    back = spark.read.parquet(f"{tmp_path}/shards")
    rows = sorted(back.selectExpr("shard", "slot", "row.doc_id", "row.text").collect())
    assert [(r.doc_id, r.text) for r in rows] == [(i, t) for i, t, _ in CASES["plain"]]


def test_shards_are_nearly_equal_though_one_id_has_most_rows(spark):
    rows = [(5, "same text here", "en")] * 3000 + [(k, "x" * (k % 50), "en") for k in range(1500)]
    sizes = Counter()
    for r in sharding.shard_by_bytes(docs(spark, rows), 8, []).collect():
        sizes[r.shard] += r["size"]
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 2 * 50


# --- collocations ---------------------------------------------------------------------------------------------------


def plain_collocations(rows, max_words=3, least=10, share=50, top=2000):
    counts, words = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            counts.update((lang, *w[i : i + n]) for n in range(1, max_words + 1) for i in range(len(w) - n + 1))
    kept = {}
    for (lang, *p), a in counts.items():
        if len(p) > 1 and a >= least:
            kept[lang, tuple(p)] = min((10**6 * a * a // (counts[(lang, *p[:k])] * counts[(lang, *p[k:])]), k) for k in range(1, len(p)))
    inside = lambda s, t: len(s) < len(t) and any(t[i : i + len(s)] == s for i in range(len(t)))
    out = []
    for lang in {k[0] for k in kept}:
        mine = {p: v for (x, p), v in kept.items() if x == lang}
        rest = [p for p in mine if not any(inside(p, q) and 100 * counts[(lang, *q)] >= share * counts[(lang, *p)] for q in mine)]
        rest.sort(key=lambda p: (-mine[p][0], -counts[(lang, *p)], " ".join(p).encode()))
        for rank, p in enumerate(rest[:top], 1):
            score, k = mine[p]
            out.append((lang, rank, " ".join(p), counts[(lang, *p)], counts[(lang, *p[:k])], counts[(lang, *p[k:])], words[lang], score))
    return sorted(out)


rng = random.Random(3)
VOCABULARY = ["the", "The", "stone", "river", "über", "naïve", "日本", "x1", "moon\x00", "\x1c", "a-b", "😀"]
TEXTS = [(i, "".join(rng.choice(VOCABULARY) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randint(0, 120))), rng.choice(["en", "de", None, "und", ""])) for i in range(60)]
TEXTS += [(None, None, None), (1, "", "en"), (1, " .\t", "en"), (2, "a a a a a a a a a a a a a", "en"), (2, "stone river " * 300, "en"), (2, "stone river " * 300, "en"), (9, "x" * 200_000, "fr")]


@pytest.mark.parametrize("max_words", [2, 3, 4])
def test_collocations_equal_brute_force(spark, monkeypatch, max_words):
    monkeypatch.setattr(collocations, "RANGE_BYTES", 2000)
    got = collocations.collocations(docs(spark, TEXTS).repartition(5), max_words, least=4, top=30 if max_words == 3 else None)
    assert sorted(map(tuple, got.collect())) == plain_collocations(TEXTS, max_words, 4, top=30 if max_words == 3 else 10**9)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs(spark, TEXTS).limit(0)).count() == 0
    assert collocations.collocations(docs(spark, [(1, None, None), (2, "one two", "en")])).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(docs(spark, TEXTS), 1)


def test_tries_that_fill_up_and_vocabularies_that_start_anew(monkeypatch):
    """What the tasks send adds up to the counts, whatever the size of a run; packed tries come back whole."""
    monkeypatch.setattr(collocations, "RUN_WORDS", 50)
    numbers, texts = collocations.Numbers(), [(t or "").encode() for _, t, _ in TEXTS]
    whole = collocations.Trie.counted(np.concatenate([collocations.numbered(t, numbers) for t in texts]), list(numbers), 3)
    parts = []
    for t in texts:
        numbers = collocations.Numbers()
        ids = np.array(collocations.numbered(t, numbers), np.int64)
        parts += [collocations.Trie.unpacked(p.pack()) for _, p in collocations.Trie.counted(ids, list(numbers), 3).cut(7)]
    both = [{(n, p): (c, tuple(lefts)) for n, ps, cs, ls in t.frequent(1) for p, c, lefts in zip(ps, cs, ls)} for t in (whole, collocations.Trie.merged(parts))]
    assert both[0] == both[1] and len(both[0]) > 500
    assert sum(t.size > 0 for _, t in whole.cut(7)) == 7


def test_a_full_run_is_sent_in_parts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "RUN_WORDS", 40)
    monkeypatch.setattr(collocations, "VOCABULARY_WORDS", 30)
    monkeypatch.setattr(collocations, "MERGE_NODES", 20)
    texts = docs(spark, TEXTS).selectExpr("coalesce(lang, 'und') as lang", "coalesce(text, '') as text").coalesce(1)
    found = Counter()
    for r in collocations.runs(texts, 3, 5).collect():
        for _, ps, cs, _ in collocations.Trie.unpacked(bytes(r.trie)).frequent(1):
            found.update({(r.lang, *(w.decode() for w in p)): c for p, c in zip(ps, cs)})
    low = lambda t: (t or "").encode().lower().decode()
    want = Counter((x, w) for _, t, lang in TEXTS for x in ["und" if lang is None else lang] for w in re.findall(r"[^ \t.,;:!?\n\x0b\x0c\r]+", low(t)))
    assert {k: c for k, c in found.items() if len(k) == 2} == want
    pairs = {(x[0], *x[2].split(" ")): x[3] for x in plain_collocations(TEXTS, 2, 1, share=10**6, top=10**9)}
    assert {k: c for k, c in found.items() if len(k) == 3} == pairs


# --- vector codes ---------------------------------------------------------------------------------------------------


def plain_codes(rows, parts, entries, rounds, scale=256):
    kept = [(i, [max(-(1 << 62), min(1 << 62, int(np.floor(np.float64(x) * scale)))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    if not kept:
        return []
    dim = len(kept[0][1])
    own, other = [r for r in kept if len(r[1]) == dim], [r for r in kept if len(r[1]) != dim]
    places = [range(dim * p // parts, dim * (p + 1) // parts) for p in range(parts)]
    books = [[[r[1][k] for k in at] for r in own[:entries]] for at in places]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        codes = [[min((gap([r[1][k] for k in at], e), n) for n, e in enumerate(book)) for at, book in zip(places, books)] for r in own]
        if turn < rounds:
            for p, at in enumerate(places):
                for n in range(len(books[p])):
                    mine = [[r[1][k] for k in at] for r, c in zip(own, codes) if c[p][1] == n]
                    if mine:
                        books[p][n] = [sum(x) // len(mine) for x in zip(*mine)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    most = (1 << 63) - 1
    out = [(r[0], r[2], "".join(f"{n:02x}" for _, n in c), min(most, sum(d for d, _ in c))) for r, c in zip(own, codes)] + [(r[0], r[2], None, None) for r in other]
    by = {}
    for _, lab, _, e in out:
        by[lab] = by.get(lab, 0) + e if e is not None and by.get(lab, 0) is not None else by.get(lab, e)
    return sorted([(*r, None if by[r[1]] is None else min(most, by[r[1]]), digest) for r in out], key=str)


VECTORS = "vec_id long, embedding array<float>, label int, v int, x string, `a.b` int"
nprng = np.random.default_rng(1)


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, 1, "x", 2) for i, v, lab in rows], VECTORS)


def some(n, dim, kind=None):
    rows = [(int(i), np.float32(nprng.normal(size=dim) * (1 + i % 5)).tolist(), int(i) % 3) for i in nprng.permutation(n)]
    nan = float("nan")
    odd = [(None, [0.5] * dim, None), (None, [0.5] * dim, None), (3, [0.25] * dim, 1), (3, [0.25] * dim, 1), (900, None, 1), (901, [nan] + [0.0] * (dim - 1), 1), (902, [float("inf")] * dim, 1), (903, [None] * dim, 1)]
    huge = [(910, [3e38] * dim, 1), (911, [-3e38] * dim, 2), (912, [1e9] * dim, None)]
    ragged = [(920, [], 7), (921, [1.0] * (dim + 1), 1)]
    return rows + {None: [], "odd": odd, "huge": odd + huge, "ragged": odd + ragged}[kind]


@pytest.mark.parametrize("kind", [None, "odd", "huge", "ragged"])
@pytest.mark.parametrize("parts, entries, rounds, dim", [(4, 8, 2, 8), (16, 64, 3, 20), (3, 1, 1, 3), (16, 5, 2, 4)])
def test_codes_equal_plain_rounds(spark, monkeypatch, kind, parts, entries, rounds, dim):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 40)
    rows = some(150, dim, kind)
    got = vector_codes.vector_codes(vectors(spark, rows).repartition(3), parts, entries, rounds)
    assert sorted(map(tuple, got.collect()), key=str) == plain_codes(rows, parts, entries, rounds)


def test_codes_of_few_or_no_vectors(spark):
    assert vector_codes.vector_codes(vectors(spark, []), 16, 64).count() == 0
    assert vector_codes.vector_codes(vectors(spark, [(1, None, 1), (2, [None], 1)]), 16, 64).count() == 0
    rows = [(1, [0.5, 0.25], 1), (1, [0.5, 0.25], None)]
    assert sorted(map(tuple, vector_codes.vector_codes(vectors(spark, rows), 2, 64).collect()), key=str) == plain_codes(rows, 2, 64, 2)
    rows = [(1, [], 1), (2, [], 1)]
    assert sorted(map(tuple, vector_codes.vector_codes(vectors(spark, rows), 2, 64).collect()), key=str) == plain_codes(rows, 2, 64, 2)


def test_heaps_rescan_only_what_drift_gives_up():
    """On clustered parts whose entries hardly move, few are compared again, and codes stay exact."""
    centres = nprng.integers(-4000, 4000, size=(16, 8))
    points = np.concatenate([c + nprng.integers(-20, 20, size=(200, 8)) for c in centres])
    books = vector_codes.Codebooks([points[::200].copy()])
    heaps = vector_codes.Heaps(points, books.books[0], books.used[0])
    rescanned = []
    for _ in range(4):
        counts = np.bincount(heaps.codes, minlength=16)
        sums = np.stack([np.bincount(heaps.codes, points[:, k], 16).astype(int) for k in range(8)], axis=1)
        books = books.updated(counts[None], [sums])
        stored = heaps.stored()
        heaps = vector_codes.Heaps.restored(points, heaps.codes, *stored)
        rescanned.append(heaps.move(books.books[0], books.used[0]))
        assert (heaps.codes == vector_codes.distances(points, books.books[0]).argmin(axis=1)).all()
    assert sum(rescanned) < 0.1 * 4 * len(points)
