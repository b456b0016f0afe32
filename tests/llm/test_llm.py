"""The training-data operators against brute force, on small tables with nulls, ties, repeats and extra columns."""

import random
import re
import time
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from meterlake.llm import bpe, bpe_codec, common, huffman, licenses, packing, pii, quality, simhash, token_counts, topk, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, toxicity string, quality string, _id string, _q string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    common.ship_package(spark)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def docs(spark, texts, ids=None):
    rows = [(i, t, "en", "s", None if t is None else len(t), *"xxxxx") for i, t in zip(ids if ids is not None else range(len(texts)), texts)]
    return spark.createDataFrame(rows, SCHEMA)


rng = random.Random(5)
WORDS = ["the", "stone", "river", "Wanders", "über", "naïve", "don't", "x1", "…", "red", "blue", "tall", "quiet", "moon", "house"]
SENTENCES = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 90))) for _ in range(40)]
ODD = [None, "", " \n", "a" * 3000, "<|endoftext|>x <|startoftext|>", "ΣΑΣ İ K 日本 \U0001f600 é", "x'd'll 're\x1c!", SENTENCES[0], SENTENCES[0]]
TEXTS = SENTENCES + ODD


def test_bpe_equals_the_library(library):
    array, heap = bpe.RankArrayBpe(PATH), bpe.HeapBpe(PATH)
    letters = [chr(c) for c in range(1, 0x500)] + list("日本語ﬁ ‍\U0001f469 '")
    for n in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) if n >= len(TEXTS) else TEXTS[n] or ""
        want = library.encode(text, add_special_tokens=False).ids
        assert array.encode(text) == want
        assert heap.count(text) == len(want)
        assert array.decode(want) == library.decode(want, skip_special_tokens=False)


def test_both_merges_agree_on_long_words():
    v = bpe.WordVocabulary(PATH)
    for word in ("abab" * 60, "thestone" * 30):
        kept = v.symbols(word)
        merges = bpe.heap_merge(v, kept)
        assert bpe.rank_array_merge(v, v.symbols(word)) == [s for s in kept if s >= 0]
        assert merges == len(word) - sum(s >= 0 for s in kept)


def test_token_counts_and_round_trip(spark, library):
    df = docs(spark, TEXTS)
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]
    rows = {r.doc_id: r for r in token_counts.count_tokens(df, limit=20).collect()}
    assert [rows[i].n_tokens for i in range(len(TEXTS))] == want
    assert [rows[i].n_bytes for i in range(len(TEXTS))] == [len((t or "").encode()) for t in TEXTS]
    assert all(r.over_limit == (r.n_tokens > 20) for r in rows.values())
    back = {r.doc_id: r.text for r in bpe_codec.decode(bpe_codec.encode(df)).collect()}
    assert back[3] == library.decode(library.encode(TEXTS[3], add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe_codec.round_trip(df.limit(0)).count() == 0


def test_huffman_corpus(spark, library):
    ids = [None, 7, 7, *range(10, 10 + len(TEXTS) - 3)]
    path = common.scratch_path(spark, "test")
    huffman.write_corpus(docs(spark, TEXTS, ids), path)
    rows = huffman.read_corpus(spark, path).orderBy("start").collect()
    assert len(rows) == len(TEXTS)
    assert [r.doc_id for r in rows] == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r.start for r in rows] == list(np.cumsum([0, *(r.n_tokens for r in rows)])[:-1])
    want = sorted((i is not None, i or 0, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in zip(ids, TEXTS))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in rows) == want
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)
    empty = common.scratch_path(spark, "empty")
    huffman.write_corpus(docs(spark, []), empty)
    assert huffman.read_corpus(spark, empty).count() == 0


def test_code_lengths_are_optimal_within_the_limit():
    counts = np.array([1, 1, 2, 4, 8, 16, 32, 64])
    free = huffman.code_lengths(counts, 16)
    assert sorted(free) == [1, 2, 3, 4, 5, 6, 7, 7]
    bound = huffman.code_lengths(counts, 4)
    assert bound.max() == 4 and sum(2.0**-x for x in bound) <= 1
    best = min(sum(c * x for c, x in zip(counts, ls)) for ls in combinations_of_lengths(8, 4))
    assert (counts * bound).sum() == best
    assert list(huffman.code_lengths(np.array([5]))) == [1]
    with pytest.raises(ValueError):
        huffman.read_block(b"HUF1" + bytes(40))


def combinations_of_lengths(n, top):
    """Non-increasing code lengths of n symbols with Kraft sum at most 1."""
    def extend(prefix, kraft):
        if len(prefix) == n:
            yield prefix
            return
        for x in range(1, (prefix[-1] if prefix else top) + 1):
            if kraft + 2.0**-x <= 1:
                yield from extend([*prefix, x], kraft + 2.0**-x)

    return extend([], 0.0)


def test_packing(spark, library):
    texts = TEXTS + [" ".join(rng.choice(WORDS) for _ in range(5000))]
    rows = packing.pack(docs(spark, texts, [None, *range(1, len(texts))]), capacity=256, with_ids=True).collect()
    got = sorted((r.doc_id or 0, r.piece, r.start, r.length, bytes(r.ids)) for r in rows)
    want = []
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, k // 256, k, len(ids[k : k + 256]), np.array(ids[k : k + 256], "<u4").tobytes()) for k in range(0, len(ids), 256)]
    assert got == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        assert [o for o, _ in sorted(spans)] == list(np.cumsum([0, *(n for _, n in sorted(spans))])[:-1])
        assert sum(n for _, n in spans) <= 256
    assert len(bins) == sum(n for _, n in packing.bin_completion({x: sum(r.length == x for r in rows) for x in {r.length for r in rows}}, 256))
    assert packing.pack(docs(spark, [])).count() == 0


def fewest_bins(items, capacity):
    items = sorted(items, reverse=True)
    best = len(items)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for b in sorted({x for x in bins if x + items[k] <= capacity}):
            rest = list(bins)
            rest[rest.index(b)] += items[k]
            place(k + 1, rest)
        place(k + 1, [*bins, items[k]])

    place(0, [])
    return best


def test_bin_completion_is_optimal_on_small_sets():
    for _ in range(60):
        items = [rng.randint(5, 60) for _ in range(rng.randint(1, 10))]
        solution = packing.bin_completion({x: items.count(x) for x in set(items)}, 100)
        assert sorted(x for f, n in solution for x in f * n) == sorted(items)
        assert all(sum(f) <= 100 for f, _ in solution)
        assert sum(n for _, n in solution) == fewest_bins(items, 100)


def test_lower_bound_and_proof():
    r = random.Random(12)
    for _ in range(400):
        items = [r.randint(5, 70) for _ in range(r.randint(1, 11))]
        h = {x: items.count(x) for x in set(items)}
        found = packing.packing_of(h, 100)
        assert found.proven and found.bound <= fewest_bins(items, 100) == sum(n for _, n in found.bins)
    assert packing.lower_bound({60: 3, 41: 2}, 100) == 4  # the sum alone says 3
    assert packing.packing_of({}, 100) == packing.Packing([], 0, True)
    hard = {x: 1 + x % 3 for x in range(151, 1024, 7)}
    cut = packing.packing_of(hard, 2048, nodes=1)
    assert sorted(x for f, n in cut.bins for x in f * n) == sorted(x for x, n in hard.items() for _ in range(n))


def components(fps, linked):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(set(fps)), 2):
        if linked(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_bin_completion_beyond_the_first_perfect_filling():
    lengths = [48, 45, 40, 38, 30, 27, 25, 25, 22]
    many = [90, 7, 2, 1] + [20] * 5 + [13, 12, 11, 10, 9, 9, 8, 8, 6, 6, 5, 3]
    for items, bins in ((lengths, 3), (lengths + [100] * 3, 6), (many, 3)):
        solution = packing.bin_completion({x: items.count(x) for x in set(items)}, 100)
        assert sorted(x for f, n in solution for x in f * n) == sorted(items) and all(sum(f) <= 100 for f, _ in solution)
        assert sum(n for _, n in solution) == bins
    items = [17, 19, 20, 23, 25, 25, 30, 37, 46, 49, 49, 49, 50, 58]
    assert sum(n for _, n in packing.bin_completion({x: items.count(x) for x in set(items)}, 100)) == 5
    items = [50, 50, 30, 30, 20, 20, 35, 35, 15, 15]
    assert sum(n for _, n in packing.bin_completion({x: items.count(x) for x in set(items)}, 100)) == 3
    r = random.Random(3)
    for _ in range(300):
        bins = [[*(b - a for a, b in zip([0, *cuts], [*cuts, 100]))] for cuts in (sorted(r.sample(range(10, 91), r.randint(1, 3))) for _ in range(4))]
        items = [x for b in bins for x in b]
        assert sum(n for _, n in packing.bin_completion({x: items.count(x) for x in set(items)}, 100)) == 4


def test_simhash_components(spark):
    base = [" ".join(rng.choice(WORDS) for _ in range(200)) for _ in range(6)]
    texts = TEXTS + base + [b.replace("moon", "sun", 1) for b in base] + base[:2]
    got = {r.doc_id: r for r in simhash.simhash_components(docs(spark, texts)).collect()}
    want = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        want[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == want
    roots = components(want.values(), lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for i, f in want.items():
        first[roots[f]] = min(first.get(roots[f], i), i)
    assert {i: r.component_id for i, r in got.items()} == {i: first[roots[f]] for i, f in want.items()}
    assert simhash.simhash_components(docs(spark, [])).count() == 0


@pytest.mark.parametrize("bits,hot", [(2, 256), (2, 3), (7, 256), (7, 2)])
def test_links_at_any_number_of_bits(spark, monkeypatch, bits, hot):
    monkeypatch.setattr(simhash, "HOT_SIGNATURE", hot)
    r = random.Random(bits * 1000 + hot)
    fps = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(12):
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(10):
            fps.add(x ^ sum(1 << b for b in r.sample(range(64), r.randint(0, bits + 2))))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = sorted(tuple(sorted((signed(a), signed(b)))) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= bits)
    got = sorted((e.a, e.b) for e in simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), bits).collect())
    assert got == want


def test_keep_one(spark):
    long = " ".join(f"w{k} v{k % 7}" for k in range(400))
    texts = [long, long, long.replace("w200", "zz"), " ".join(f"other{k}" for k in range(300)), None, "", long]
    kept = simhash.keep_one(docs(spark, texts, [5, 3, 9, 4, 8, None, 3]))
    assert kept.columns == docs(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 8]
    assert simhash.keep_one(docs(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [64, 2])
def test_keep_one_links_every_pair_at_the_similarity(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_SHINGLE", hot)
    monkeypatch.setattr(simhash, "ORDER_SHARE", 2)
    r = random.Random(17)
    texts = []
    for k in range(60):
        words = [f"{k}w{j}" for j in range(r.choice([6, 40, 300, 700]))] + ["a", "common", "line", "of", "every", "text", "here"]
        texts.append(" ".join(words))
        for _ in range(3):
            at = r.sample(range(len(words)), r.randint(0, max(1, len(words) // 40)))
            texts.append(" ".join(f"z{r.random()}" if j in at else w for j, w in enumerate(words)))
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    alike = [len(a & b) / len(a | b) for a, b in combinations(sets, 2)]
    assert sum(0.8 <= x < 0.9 for x in alike) > 10 < sum(0.7 <= x < 0.8 for x in alike)
    roots = components(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)
    want = {min(i for i in roots if roots[i] == x) for x in set(roots.values())}
    assert {x.doc_id for x in simhash.keep_one(docs(spark, texts)).collect()} == want


def test_keep_one_links_by_simhash_first(spark, monkeypatch):
    long = [f"w{k} v{k % 7}" for k in range(400)]
    texts = [" ".join(long), " ".join(long).replace("w200", "zz"), " ".join(long[10:] + long[:10]), " ".join(f"other{k}" for k in range(300))]
    sets = simhash.set_rows(docs(spark, texts), 5, 0.8).orderBy("doc_id").collect()
    assert [s.fp % (1 << 64) for s in sets] == [simhash.fingerprint(t, 5) for t in texts]
    bits = max((sets[0].fp ^ s.fp).bit_count() if (sets[0].fp ^ s.fp) >= 0 else ((sets[0].fp ^ s.fp) % (1 << 64)).bit_count() for s in sets[1:3])
    compared, verified = [], simhash.verified

    def recorded(pairs, *rest):
        compared.append(pairs.distinct().count())
        return verified(pairs, *rest)

    monkeypatch.setattr(simhash, "verified", recorded)
    assert sorted(r.doc_id for r in simhash.keep_one(docs(spark, texts), bits=bits).collect()) == [0, 3]
    assert compared[0] == 2 and not any(compared[1:])  # the fingerprints found both; the set join had nothing left


def repeated(words):
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    return len({j for k, g in enumerate(grams) if grams.count(g) > 1 for j in (k, k + 1, k + 2)})


def test_quality_counts_and_verdicts(spark):
    good = [" ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(120)) + "." for _ in range(30)]
    good = [g.replace(" ", ". ", 6) for g in good]
    junk = [" ".join(w + "$$$" for w in g.split()) for g in good[:6]] + [g.upper().replace(" ", "!! ") for g in good[6:9]]
    texts = good + junk + TEXTS + ["a a a a", "x\nx\n\nx y\n \nx y"]
    rows = {r.doc_id: r.quality for r in quality.score_quality(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), repeated(w))
        q = rows[i]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == want
        assert q.base_failed == (len(w) < 50 or 100 * want[4] > 50 * len(w))
        assert not (q.kept and q.base_failed)
    assert all(rows[i].kept for i in range(30)) and not any(rows[i].kept for i in range(30, 39))
    assert quality.keep_good(docs(spark, [])).count() == 0
    assert quality.keep_good(docs(spark, good)).columns == docs(spark, []).columns


def brute_em(patterns):
    share, prior = np.array(quality.START_SHARES), np.array([quality.prior_bad(kind) for *_, kind in quality.RULES])
    bad, n = prior.copy(), np.array(list(patterns.values()), float)
    v = np.array([[int(d) for d in x] for x in patterns])

    def expect():
        w = np.array([[share[c] * np.prod([bad[j, c] if d == 0 else 1 - bad[j, c] if d == 2 else 1.0 for j, d in enumerate(x)]) for c in range(len(share))] for x in v])
        return w / w.sum(axis=1, keepdims=True)

    for _ in range(quality.EM_STEPS):
        p = expect() * n[:, None]
        share = (p.sum(axis=0) + 1) / (n.sum() + len(share))
        said, voted = (v == 0).T @ p, (v != 1).T @ p
        bad = (said + quality.PRIOR_TEXTS * prior) / (voted + quality.PRIOR_TEXTS)
    return dict(zip(patterns, expect()[:, 0]))


def test_posterior_equals_plain_expectation_maximisation(spark):
    patterns = {"".join(rng.choice("012") for _ in quality.RULES): rng.randint(1, 50) for _ in range(25)}
    got = {r.votes: r.p_good for r in quality.posterior(spark.createDataFrame(list(patterns.items()), "votes string, n long")).collect()}
    want = brute_em(patterns)
    assert got.keys() == want.keys() and all(got[v] == pytest.approx(want[v]) for v in want)
    assert quality.posterior(spark.createDataFrame([], "votes string, n long")).count() == 0


def test_rule_estimates_follow_the_votes(spark):
    """Votes of known rules: estimates come near the truth, whatever the prior says, and a random rule's falls."""
    r = random.Random(8)
    names = [name for name, *_ in quality.RULES]

    def votes(junk):
        out = []
        for name, *_, kind in quality.RULES:
            hit = 0.9 if kind and kind == junk else 0.01
            out.append(1 if r.random() < 0.1 else 0 if r.random() < hit else 2)
        return out

    texts = [votes(r.choice(quality.KINDS) if k % 5 == 0 else None) for k in range(4000)]

    def estimates(rows):
        counts = {}
        for v in rows:
            key = "".join(map(str, v))
            counts[key] = counts.get(key, 0) + 1
        return {x.rule: x for x in quality.rule_estimates(spark.createDataFrame(list(counts.items()), "votes string, n long")).collect()}

    own = estimates(texts)
    assert list(own) == names and all(0.001 < x.bad_on_good < 0.03 for x in own.values())
    assert all(x.bad_on_junk == pytest.approx(0.9 / 3, abs=0.06) for x in own.values() if x.rule != "length")
    for j in (1, 4, 8):
        swapped = estimates([[*v[:j], r.choice([0, 2]), *v[j + 1 :]] for v in texts])
        assert swapped[names[j]].accuracy < own[names[j]].accuracy - 0.05
        assert swapped[names[j]].bad_on_good == pytest.approx(0.5, abs=0.05)


def test_toxicity_learns_and_holds_out(spark):
    clean = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(300)]
    texts = [c.replace("moon", "vilewretch", 1) + (" vilewretch" if k % 4 == 0 else "") if k % 4 == 0 else c.replace("vilewretch", "") for k, c in enumerate(clean)]
    df = docs(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(300)] + [(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.toxicity(df, labels).collect()}
    assert all(rows[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in rows)
    right = [rows[k].predicted == (k % 4 == 0) for k in range(300) if rows[k].held_out]
    assert sum(right) / len(right) > 0.95
    assert rows[300].score == rows[301].score and 0 <= rows[300].score < 0.5
    assert toxicity.drop_toxic(df, labels).columns == df.columns
    assert {r.score for r in toxicity.toxicity(df, labels.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity(df.limit(0), labels).count() == 0


def test_toxicity_with_labels_of_other_documents(spark):
    df = docs(spark, [f"{'vile hateful' if k % 2 else 'kind gentle'} words {k}" for k in range(200)])
    schema = "doc_id long, quality int, toxic int"
    own = [(k, 1, k % 2) for k in range(200)]
    alone = toxicity.fit_toxicity(df, spark.createDataFrame(own, schema), sample_rows=100)
    mixed = toxicity.fit_toxicity(df, spark.createDataFrame(own + [(k, 1, 1) for k in range(1000, 5000)], schema), sample_rows=100)
    assert [list(x) for x in mixed[:2]] == [list(x) for x in alone[:2]] and mixed[2] == alone[2] != 0.0
    for rows in ([], [(k, 1, None) for k in range(200)], [(k, 1, 1) for k in range(1000, 1010)]):
        assert toxicity.drop_toxic(df, spark.createDataFrame(rows, schema)).count() == 200


def brute_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]


def test_plain_personal_data_equals_the_patterns():
    parts = ["a", ".", "@", "1", "12", "255", "300", "-", "+", " ", "(", ")", "4111111111111111", "x.com", "é", "007", "+1 (415) 555-0100"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.find_plain(t) == brute_spans(t)


@pytest.mark.parametrize(
    "text,kind,found",
    [
        ("mail john [at] site [dot] com now", "email", "john [at] site [dot] com"),
        ("write jo.doe at mail dot example dot com please", "email", "jo.doe at mail dot example dot com"),
        ("see jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("call plus one five five five one two three four five six seven!", "phone", "plus one five five five one two three four five six seven"),
        ("host 192[.]168[.]1[.]1 up", "ip", "192[.]168[.]1[.]1"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    base, every = pii.find_all(text)
    assert base == [] and [(k, text[a:b]) for k, a, b in every] == [(kind, found)]


@pytest.mark.parametrize("text", ["we met at noon dot", "one two three go", "a [dot] product", "", "he is at home at 5.30"])
def test_clean_texts_stay_clean(text):
    assert pii.find_all(text) == ([], [])


@pytest.mark.parametrize(
    "text,kind,found",
    [
        ("ask jane at mail dot example dot nl now", "email", "jane at mail dot example dot nl"),
        ("ask jane at example.com now", "email", "jane at example.com"),
        ("ask jane @ example.com, please", "email", "jane @ example.com"),
        ("ask jane at the dot com now", "email", "jane at the dot com"),
        ("an jane at beispiel punkt de bitte", "email", "jane at beispiel punkt de"),
        ("pour jane arobase exemple point fr merci", "email", "jane arobase exemple point fr"),
        ("para jane arroba ejemplo punto es gracias", "email", "jane arroba ejemplo punto es"),
        ("call plus 1 five 5 five 1 two 3 four 5 six!", "phone", "plus 1 five 5 five 1 two 3 four 5 six"),
        ("plus vier neun drei null eins zwei fünf sechs sieben acht", "phone", "plus vier neun drei null eins zwei fünf sechs sieben acht"),
        ("plus trois trois un deux quatre cinq six sept huit neuf", "phone", "plus trois trois un deux quatre cinq six sept huit neuf"),
        ("más tres cuatro uno dos cinco seis siete ocho nueve cero", "phone", "más tres cuatro uno dos cinco seis siete ocho nueve cero"),
    ],
)
def test_disguises_of_any_ending_and_language(text, kind, found):
    base, every = pii.find_all(text)
    assert base == [] and [(k, text[a:b]) for k, a, b in every] == [(kind, found)]
    assert found not in pii.redact(text, every)


@pytest.mark.parametrize("text", ["look at the dot on the map", "look at this point in time", "see us at www.example.com", "he was at home.Then he left", "one 2 three four"])
def test_prose_near_disguises_stays_clean(text):
    assert pii.find_all(text) == ([], [])


def disguised(r, kind):
    """(plain, disguised) of a random address or number, by one of the disguises."""
    name = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 7)))
    if kind == "email":
        parts = [name(), name(), r.choice(["com", "org", "nl", "fr", "app"])]
        at, dot = r.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" @ ", "."), (" arobase ", " point "), (" arroba ", " punto "), (" ät ", " punkt "), ("@", "․")])
        return f"{parts[0]}@{parts[1]}.{parts[2]}", f"{parts[0]}{at}{parts[1]}{dot}{parts[2]}"
    digits = [r.randint(0, 9) for _ in range(11)]
    words = r.choice(["zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve"]).split()
    shown = [words[d] if r.random() < 0.8 or k < 2 else str(d) for k, d in enumerate(digits)]
    return "+" + "".join(map(str, digits)), "plus " + " ".join(shown)


def test_random_disguises_come_back_with_their_offsets():
    r = random.Random(21)
    for _ in range(2000):
        want, text = [], ""
        for _ in range(r.randint(1, 4)):
            text += r.choice(["Ünd so. ", "call me, ", "ok - ", "\n", "日本 "])
            kind = r.choice(["email", "phone"])
            plain, hidden = disguised(r, kind)
            shown = r.choice([plain, hidden])
            want.append((kind, len(text), len(text) + len(shown)))
            text += shown + r.choice([", ", "; ", "!\n"])
        base, every = pii.find_all(text)
        assert sorted(s for s in every if s[0] in ("email", "phone")) == sorted(want), text
        assert set(base) <= set(every)
        clean = pii.redact(text, every)
        assert all(text[a:b] not in clean for _, a, b in want)


def test_overlapping_spans_are_redacted_together():
    text = "x +1 415 555 0100.joe@x.com y 10.0.0.1"
    assert pii.redact(text, pii.find_all(text)[1]) == "x [PHONE+EMAIL] y [IP]"
    assert pii.redact("abc", []) == "abc"


def test_long_texts_with_many_disguises_take_time_in_proportion():
    text = "mail joe@x.com or ann [at] y [dot] org or a dot b dot c dot d; " * 40_000  # 2.5 MB
    base, every = pii.find_all(text)
    assert (len(base), len(every)) == (40_000, 80_000)
    assert pii.find_all("a dot " * 300_000 + "@" * 1000) == ([], [])


def test_personal_data_frames(spark):
    df = docs(spark, [None, "", "a@b.co 10.0.0.1", "x" * 2000 + "@", "none"])
    rows = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert (rows[2].n_email, rows[2].n_ip, rows[2].spans) == (1, 1, "email:0:6,ip:7:15") and rows[0].spans == ""
    clean = {r.doc_id: r for r in pii.redact_pii(df).collect()}
    assert (clean[2].text, clean[2].n_chars, clean[0].text) == ("[EMAIL] [IP]", 12, None)
    assert pii.redact_pii(df).columns == df.columns and pii.redact_pii(df.limit(0)).count() == 0


def test_license_scan(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    texts = [None, "", apache, "CC-BY and cc by; All RIGHTS\nreserved", "Licensed under the GNU General Public License, version 3", "by cc rights", "Licensed under the GNU (really) General Public License, version 3", "K cc by", apache]
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs(spark, texts, [None, *range(1, 8), 2])).collect()}
    assert (rows[2].base_labels, rows[2].labels, rows[2].n_words) == ("", "apache-2.0", 8)
    assert (rows[3].n_base, rows[3].first_word, rows[3].last_word, rows[3].base_labels) == (3, 0, 5, "cc-by,reserved")
    assert rows[4].labels == "gpl,gpl-3.0" and rows[6].labels == "gpl,gpl-3.0"
    assert (rows[5].labels, rows[5].score, rows[5].first_word) == ("", 0.0, None)
    assert rows[7].n_words == 3 and rows[1].n_words == 0 and rows[None].score == 0
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


def brute_licenses(text):
    """(base labels, all labels, score) by plain loops over words, templates and diagonals."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    base = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase]
    spans = []
    for label, template in licenses.TEMPLATES:
        own = template.split(" ")
        hits = [(i - j, j) for j in range(len(own) - 2) for i in range(len(words) - 2) if words[i : i + 3] == own[j : j + 3]]
        groups = []
        for d in sorted({d for d, _ in hits}):
            if groups and d - groups[-1][-1] <= licenses.DRIFT:
                groups[-1].append(d)
            else:
                groups.append([d])
        for g in groups:
            mine = [(d + j, j) for d, j in hits if d in g]
            first, last = min(i for i, _ in mine), max(i for i, _ in mine) + 2
            share = len({j + k for _, j in mine for k in range(3)}) / len(own)
            if share >= licenses.COVERAGE and last + 1 - first <= len(own) + licenses.DRIFT * len(g):
                spans.append((-share, -len(own), label, first, last))
    best = [x for x in spans if not any(y[:4] < x[:4] and y[3] <= x[4] and x[3] <= y[4] for y in spans)]
    labels = {label for _, label in base}
    return ",".join(sorted(labels)), ",".join(sorted(labels | {x[2] for x in best})), 1.0 if base else max([-x[0] for x in best], default=0.0)


def test_license_scan_equals_brute_force(spark):
    r = random.Random(4)
    texts = []
    for _ in range(150):
        words = []
        for _ in range(r.randint(1, 4)):
            words += [r.choice(WORDS) for _ in range(r.randint(0, 12))]
            notice = r.choice(licenses.TEMPLATES)[1].split(" ")
            for _ in range(r.choice([0, 0, 1, 2, 6])):
                at = r.randrange(len(notice))
                notice[at : at + r.randint(0, 2)] = r.choices(WORDS, k=r.randint(0, 2))
            words += notice
        texts.append(" ".join(w.upper() if r.random() < 0.1 else w + r.choice(["", ",", "."]) for w in words))
    got = {x.doc_id: (x.base_labels, x.labels, x.score) for x in licenses.scan_licenses(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = brute_licenses(t)
        assert got[i][:2] == want[:2] and got[i][2] == pytest.approx(want[2])
    assert sum(g[0] != g[1] for g in got.values()) > 30


def test_only_spans_that_a_better_one_overlaps_go(spark):
    rows = [(1, 1, "a", 10, 0.9, 0, 10), (1, 1, "b", 12, 0.95, 8, 20), (1, 1, "c", 10, 0.99, 18, 28), (1, 1, "d", 10, 0.9, 29, 300), (2, 1, "a", 10, 0.9, 0, 10), (3, 1, "a", 10, 0.95, 0, 10), (3, 1, "b", 10, 0.9, 8, 20), (3, 1, "c", 10, 0.93, 18, 28)]
    spans = spark.createDataFrame(rows, "_id long, _hash long, label string, size int, share double, first int, last int")
    assert sorted((x._id, x.label) for x in licenses.best_of_overlapping(spans).collect()) == [(1, "c"), (1, "d"), (2, "a"), (3, "a"), (3, "c")]


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    monkeypatch.setattr(topk, "GROUP_BUCKETS", 2)
    r = np.random.default_rng(3)
    centres = r.normal(size=(5, 8))
    vectors = [(k, [float(x) for x in np.float32(centres[k % 5] * r.choice([1, 1, 3]) + r.normal(size=8) * 0.05)]) for k in range(200)]
    vectors += [(300, vectors[0][1]), (301, vectors[0][1]), (302, None), (303, [1.0, float("nan")]), (304, [1.0, None]), (350, [0.5, 0.5]), (None, vectors[0][1]), (400, [])]
    rows = topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), every=10).collect()
    clean = [(i, np.floor(256 * np.array(np.float32(v), float)).astype(int)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, x in clean:
        if q % 10 == 0:
            scores = sorted((-int(x @ y), i) for i, y in clean if i != q and len(y) == len(x))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in rows) == sorted(want)


def test_pipeline_stages(spark, tmp_path):
    good = [". ".join(" ".join(rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(12)) for _ in range(10)) + "." for _ in range(12)]
    texts = [*good, good[0], good[1] + " a@b.co", "short", good[2].upper().replace(" ", "!! ")]
    docs(spark, texts).drop("row", "toxicity", "quality", "_id", "_q").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(5)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "near duplicates", "personal data", "best-fit packing"]
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} >= set(range(12)) and not {12, 14, 15} & {r.doc_id for r in rows}
    kept = corpus_pipeline.redact_personal_data(spark, docs(spark, texts), str(tmp_path))
    assert kept.where(F.col("text").contains("a@b.co")).count() == 0


def test_top_level_queries_are_registered():
    from meterlake.llm.queries import QUERIES

    assert [n.split("_")[0] for n in QUERIES] == [*(f"op{k}" for k in range(1, 14)), "pipeline"]


def test_new_starts_vary_what_a_search_fills_first(monkeypatch):
    """Searches that end early are followed by varied ones; the best of all counts, and every packing is whole."""
    r, seen = random.Random(8), []
    sizes = [min(512, max(20, int(r.lognormvariate(5.0, 0.7)))) for _ in range(300)]
    h = {x: sizes.count(x) for x in set(sizes)}
    plain = packing._searched

    def counted(histogram, capacity, nodes, rng):
        seen.append((nodes, rng is None))
        return plain(histogram, capacity, nodes, rng)._replace(proven=len(seen) == 4)

    monkeypatch.setattr(packing, "_searched", counted)
    found = packing.packing_of(h, 512, 100, 9)
    assert seen == [(100, True)] + [(20, False)] * 3 and found.proven
    assert sorted(x for f, n in found.bins for x in f * n) == sorted(sizes) and all(sum(f) <= 512 for f, _ in found.bins)
    monkeypatch.undo()
    for seed in range(4):
        one = packing._searched(h, 512, 300, random.Random(seed))
        assert sorted(x for f, n in one.bins for x in f * n) == sorted(sizes) and all(sum(f) <= 512 for f, _ in one.bins)
    for _ in range(500):
        items = [r.randint(10, 60) for _ in range(r.randint(1, 9))]
        whole = packing.packing_of({x: items.count(x) for x in set(items)}, 100, None)
        assert whole.proven and sum(n for _, n in whole.bins) == fewest_bins(items, 100)


def test_addresses_with_any_number_of_dots():
    name, host = " dot ".join(f"n{k}" for k in range(40)), " dot ".join(f"h{k}x" for k in range(40))
    text = f"write to {name} at {host} dot org today"
    (found,) = pii.find_all(text)[1]
    assert text[found[1] : found[2]] == f"{name} at {host} dot org"
    began = time.monotonic()
    for chain in ("a dot " * 60_000, "a dot " * 30_000 + "at " + "b dot " * 30_000, "a.b dot " * 40_000 + "@ c", "x at y dot " * 30_000):
        pii.find_all(chain)
    assert time.monotonic() - began < 20


def test_distinct_words_vote_alike_at_any_length(spark):
    """The same share of new words on the logarithmic scale gets the same vote, whatever the number of words."""
    rule = next(r for r in quality.RULES if r[0] == "distinct words")
    sizes = [100, 1000, 1999, 2000, 2001, 5000, 100_000]
    df = spark.createDataFrame([(n, int(n**e)) for n in sizes for e in (0.75, 0.86, 0.95)], "n_words long, n_distinct long")
    votes = [(r.bad, r.good) for r in df.selectExpr(f"{rule[1]} as bad", f"{rule[2]} as good").collect()]
    assert votes == [(True, False), (False, False), (False, True)] * len(sizes)
    none = spark.createDataFrame([(0, 0)], "n_words long, n_distinct long").selectExpr(f"{rule[1]} as bad", f"{rule[2]} as good").first()
    assert (none.bad, none.good) == (False, False)
