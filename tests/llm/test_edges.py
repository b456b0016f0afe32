"""Edge cases of every operator and stage, and plain versions of whole runs."""

import hashlib
import math
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from meterlake.llm import bpe_codec, common, huffman, licenses, packing, pii, quality, simhash, token_counts, topk, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
LABELS = "doc_id long, quality int, toxic int"
#: Extra columns whose names clash with ones that the operators use, or hold a dot or a blank.
ODD_NAMES = "doc_id long, text string, n_chars long, `a.b` int, `row` string, kept string, `_q x` int, toxicity double, c long, h long, votes string, `rest` int"
LONG = ("Stone river moon. " * 300_000)[:5_000_000]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    common.ship_package(spark)


def odd_docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None if t is None else len(t), 1, "r", "k", 2, 0.5, 3, 4, "v", 5) for i, t in zip(ids, texts)], ODD_NAMES)


PROSE = [" ".join(f"word{chr(97 + k % 26)}{chr(97 + j % 26)}" for j in range(60 + k)) + f". unique {k}." for k in range(12)]
STAGES = {
    "quality": lambda df, labels: quality.keep_good(df),
    "toxicity": lambda df, labels: toxicity.drop_toxic(df, labels),
    "near duplicates": lambda df, labels: simhash.keep_one(df),
    "personal data": lambda df, labels: pii.redact_pii(df),
}


@pytest.mark.parametrize("name", STAGES)
def test_filtering_stages_keep_columns_of_any_name(spark, name):
    texts = [*PROSE, None, "", PROSE[0], PROSE[0], "mail a@b.co now"]
    df = odd_docs(spark, texts, [*range(11), None, None, 12, 0, 0, 13])
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(8)], LABELS)
    out = STAGES[name](df, labels)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    rows = out.collect()
    assert len(rows) <= len(texts)
    assert all((r["a.b"], r["row"], r["kept"], r["_q x"], r["c"], r["h"], r["votes"], r["rest"]) == (1, "r", "k", 2, 3, 4, "v", 5) for r in rows)
    assert STAGES[name](df.limit(0), labels).count() == 0


OPERATORS = {
    "op2": lambda df: toxicity.toxicity(df, df.sparkSession.createDataFrame([(0, 1, 1), (1, 1, 0)], LABELS)),
    "op3": bpe_codec.round_trip,
    "op5": licenses.scan_licenses,
    "op6": token_counts.count_tokens,
    "op7": pii.find_pii,
    "op8": simhash.simhash_components,
    "op9": packing.pack,
    "op10": quality.score_quality,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_take_odd_rows(spark, name):
    texts = [None, "", "a", "a", " \t\n", LONG, "x" * 300_000, "é\x00😀"]
    df = odd_docs(spark, texts, [None, 1, 2, 2, -3, 4, None, 2**62])
    out = OPERATORS[name](df)
    ids = sorted(str(r.doc_id) for r in out.select("doc_id").collect())
    if name == "op9":
        ids = sorted({*ids} | {"2"})
    want = ["None", "1", "2", "2", "-3", "4", "None", str(2**62)]
    assert ids == sorted(want) if name != "op9" else set(ids) == set(want)
    assert OPERATORS[name](df.limit(0)).count() == 0


def test_token_files_take_odd_rows(spark):
    df = odd_docs(spark, [None, "", "a", "a", LONG[:200_000], "x" * 100_000], [None, 1, 2, 2, -4, None])
    path = common.scratch_path(spark, "odd")
    huffman.write_corpus(df, path)
    rows = huffman.read_corpus(spark, path).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == [(False, 0), (False, 0), (True, -4), (True, 1), (True, 2), (True, 2)]


def test_round_trip_digests_equal_the_library(spark):
    library = Tokenizer.from_file(PATH)
    texts = [*PROSE, None, "", "Ünïcode 日本 don't <|endoftext|>", "x'd  \n\n y", LONG[:30_000]]
    for r in bpe_codec.round_trip(odd_docs(spark, texts)).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_top_k_of_odd_vectors(spark):
    schema = "vec_id long, embedding array<double>, v string, `a.b` int, norm string"
    rows = [(0, [1e300, 1.0]), (1, [1e300, -1.0]), (50, [3e16, 2.0]), (2, [0.0, 0.0]), (100, [0.0, 0.0]), (3, [0.5, 0.5]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1, "n") for i, v in rows], schema)
    got = topk.top_k(df, k=2).collect()
    assert sorted({r.query_id for r in got}) == [0, 50, 100] and all(r.rank in (1, 2) for r in got)
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 100] == [(1, 0, 0), (2, 1, 0)]
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_prunes_pairs_of_blocks(spark, monkeypatch):
    """Clusters far apart, and short vectors: most pairs of blocks are dropped before vectors meet, none that counts."""
    monkeypatch.setattr(topk, "BUCKET_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    r = np.random.default_rng(5)
    centres = np.eye(16)[:12]
    vectors = [(k, [float(x) for x in (centres[k % 12] + r.normal(size=16) * 0.02) * (1.0 if k % 3 else 0.2)]) for k in range(2400)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    kept = []
    whole = topk.surviving

    def counted(queries, buckets):
        out = whole(queries, buckets)
        kept.append((out.select(F.sum(F.size("chosen"))).first()[0] or 0, queries.count() * buckets.count()))
        return out

    monkeypatch.setattr(topk, "surviving", counted)
    rows = topk.top_k(df, k=5, every=10).collect()
    v = np.floor(256 * np.array([x for _, x in vectors])).astype(np.int64)
    want = [(q, n + 1, int(i), int(s)) for q in range(0, 2400, 10) for scores in [v @ v[q]] for n, (s, i) in enumerate(sorted(((s, i) for i, s in enumerate(scores) if i != q), key=lambda x: (-x[0], x[1]))[:5])]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in rows) == sorted(want)
    assert kept[0][0] < 0.35 * kept[0][1]


# --- plain versions -------------------------------------------------------------------------------------------------


def plain_features(text):
    h = [xxhash.xxh64_intdigest(w.encode()) for w in re.findall(r"[^\W_]+", (text or "").lower())]
    a, b, c, d, e = (int(x) for x in toxicity._MIX)
    mixed = [x * a for x in h] + [x * b + (y ^ y >> 29) * c for x, y in zip(h, h[1:])] + [x * d + (y ^ y >> 29) * e for x, y in zip(h, h[2:])]
    return {x % 2**64 >> 44 for x in mixed}


def plain_ftrl(examples):
    """{feature: weight} and bias by the textbook rule, one coordinate at a time."""
    z, n, bias = {}, {}, -1

    def weight(i):
        zi, l1 = z.get(i, 0.0), 0.0 if i == bias else toxicity.L1
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((toxicity.BETA + math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.PASSES):
        for features, label in examples:
            own = {i: weight(i) for i in [*features, bias]}
            g = (1 / (1 + math.exp(-max(-35.0, min(35.0, math.fsum(own.values()))))) - label) * (toxicity.TOXIC_WEIGHT if label else 1.0)
            for i, w in own.items():
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / toxicity.ALPHA * w
                n[i] = before + g * g
    return {i: w for i in z if i != bias and (w := weight(i))}, weight(bias)


def plain_scores(texts, labelled):
    """Score of each text by a model learned from ``labelled`` (id, text, label)."""
    order = sorted((x for x in labelled if zlib.crc32(str(x[0]).encode()) % 5), key=lambda x: (xxhash.xxh64_intdigest(str(x[0])), x[0]))
    weights, bias = plain_ftrl([(plain_features(t), y) for _, t, y in order])
    return [1 / (1 + math.exp(-(bias + sum(weights.get(f, 0.0) for f in plain_features(t))))) for t in texts]


def toxic_texts(n, seed):
    r = random.Random(seed)
    clean = [" ".join(r.choice(["kind", "warm", "stone", "river", "quiet", "moon", "house", "tall"]) for _ in range(30)) for _ in range(n)]
    return [t.replace("stone", "vile", 2) + " hateful vile scum" if k % 3 == 0 else t for k, t in enumerate(clean)]


def test_toxicity_equals_a_plain_ftrl(spark):
    texts = [*toxic_texts(90, 1), None, ""]
    df = odd_docs(spark, [*texts, texts[0], texts[0]], [*range(92), 0, 0])  # copies of a labelled row train once
    labels = [(k, 1, int(k % 3 == 0)) for k in range(90)]
    got = {r.doc_id: r.score for r in toxicity.toxicity(df, spark.createDataFrame(labels, LABELS)).collect()}
    want = plain_scores(texts, [(k, texts[k], y) for k, _, y in labels])
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in range(92))
    assert sum((got[k] >= 0.5) == (k % 3 == 0) for k in range(90)) > 85


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    text = text or ""
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len({j for k, g in enumerate(grams) if grams.count(g) > 1 for j in (k, k + 1, k + 2)}), "n_distinct": len(set(words)), "n_letters": sum(c.isalpha() for c in text),
        "n_capitals": len(re.findall("[A-Z]", text)), "n_exclaims": text.count("!"), "n_ends": len(re.findall("[.?!]", text)),
    }


def plain_quality(texts):
    from tests.llm.test_llm import brute_em

    counts = [plain_counts(t) for t in texts]
    votes = ["".join("0" if eval(bad, {"ln": math.log}, c) else "2" if eval(good, {"ln": math.log}, c) else "1" for _, bad, good, _ in quality.RULES) for c in counts]  # the rules' SQL is Python as well
    p = brute_em({v: votes.count(v) for v in set(votes)})
    return [p[v] >= 0.5 and c["n_words"] >= 50 and 100 * c["n_repeat_words"] <= 50 * c["n_words"] for c, v in zip(counts, votes)]


def test_pipeline_equals_plain_stages(spark, tmp_path):
    r = random.Random(31)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(800)]
    prose = lambda n: ". ".join(" ".join(r.choice(vocabulary) for _ in range(10)).capitalize() for _ in range(n // 10)) + "."
    texts = [prose(r.randint(60, 300)) for _ in range(60)]
    texts += [" ".join(w + "$$$" for w in prose(100).split()) for _ in range(12)] + [("buy now " * 40) for _ in range(6)] + [prose(80).upper().replace(" ", "!! ") for _ in range(6)]
    texts += [prose(100) + " Vile hateful scum, vile hateful scum." for _ in range(12)]
    for _ in range(30):  # near copies of every degree
        words = r.choice(texts[:60]).split(" ")
        for at in r.sample(range(len(words)), r.randint(0, max(1, len(words) // 25))):
            words[at] = r.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [texts[0], texts[1], None, "", texts[2] + " Ask joe at mail dot example dot org or +1 415 555 0100.joe@x.com."]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    rows = dict(zip(ids, texts))
    odd_docs(spark, texts, ids).select("doc_id", "text", "n_chars", F.lit("en").alias("lang")).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int("scum" in (t or ""))) for i, t in rows.items()]
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))

    docs, got = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, str(tmp_path)), "test")
        got.append(docs)
    good = plain_quality(texts)
    left = [i for i, ok in zip(ids, good) if ok]
    assert sorted(x.doc_id for x in got[0].collect()) == sorted(left) and 60 <= len(left) < len(texts) - 20

    score = dict(zip(left, plain_scores([rows[i] for i in left], [(i, rows[i], y) for i, _, y in labels if i in left])))
    left = [i for i in left if score[i] < 0.5]
    assert sorted(x.doc_id for x in got[1].collect()) == sorted(left)

    sets = {i: {tuple(w[k : k + 5]) for w in [rows[i].lower().split()] for k in range(len(w) - 4)} for i in left}
    root = {i: i for i in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(left), 2):
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    kept = sorted({find(i) for i in left})
    assert sorted(x.doc_id for x in got[2].collect()) == kept and len(kept) < len(left) - 5

    clean = {i: pii.redact(rows[i], pii.find_all(rows[i])[1]) for i in kept}
    assert {x.doc_id: x.text for x in got[3].collect()} == clean
    assert not any("joe" in t for t in clean.values())

    library = Tokenizer.from_file(PATH)
    want = sorted((i, k // 2048, ids[k : k + 2048]) for i, t in clean.items() for ids in [[*library.encode(t, add_special_tokens=False).ids, 0]] for k in range(0, len(ids), 2048))
    pieces = got[4].collect()
    assert sorted((x.doc_id, x.piece, np.frombuffer(x.ids, "<u4").tolist()) for x in pieces) == want
    lengths = [len(x[2]) for x in want]
    assert len({x.sequence_id for x in pieces}) == packing.lower_bound({x: lengths.count(x) for x in set(lengths)}, 2048)


def test_values_of_odd_rows(spark):
    """What null, empty, blank, very long and odd texts give, not only that they give something."""
    texts = [None, "", " \t\n", LONG, "x" * 300_000, "é\x00😀"]
    df = odd_docs(spark, texts)
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    rows = lambda out: sorted(out.collect(), key=lambda r: r.doc_id)
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in rows(token_counts.count_tokens(df))] == [(len((t or "").encode()), len(i), len(i) > 2048) for t, i in zip(texts, ids)]
    trips = rows(bpe_codec.round_trip(df))
    assert [r.ids_sha256 for r in trips] == [hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest() for i in ids]
    assert [r.decoded_sha256 for r in trips] == [hashlib.sha256(library.decode(i, skip_special_tokens=False).encode()).hexdigest() for i in ids]
    same = rows(simhash.simhash_components(df))
    assert [r.fingerprint for r in same[:3]] == ["0" * 16] * 3 and [r.component_id for r in same[:3]] == [0, 0, 0]
    counts = rows(quality.score_quality(df, carry=["doc_id"]).select("doc_id", "quality.*"))
    assert [(r.n_words, r.word_chars, r.kept) for r in counts] == [(n, c, k) for (n, c), k in zip([(0, 0)] * 3 + [(len(LONG.split()), len("".join(LONG.split()))), (1, 300_000), (1, 3)], [False] * 6)]
    assert [(r.n_words, r.n_base, r.first_word, r.labels, r.score) for r in rows(licenses.scan_licenses(df))[:3]] == [(0, 0, None, "", 0.0)] * 3
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in rows(pii.find_pii(df))] == [(0, 0, 0, 0, empty, "")] * 6
    pieces = rows(packing.pack(df))
    assert [(r.doc_id, r.length) for r in pieces if r.doc_id in (0, 1)] == [(0, 1), (1, 1)] and sum(r.length for r in pieces) == sum(len(i) + 1 for i in ids)
