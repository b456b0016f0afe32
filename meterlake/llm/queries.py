"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm import bpe_codec, collocations, huffman, licenses, packing, pii, quality, sharding, simhash, sql, token_counts, topk, toxicity, vector_codes
from meterlake.llm.common import table
from meterlake.sources.scratch import scratch_path

VOCABULARY = "word_bpe_49k.json"


def op1_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "huffman")
    huffman.write_corpus(table(spark, sf_dir, "documents"), path, VOCABULARY, end_id=1)
    return huffman.read_corpus(spark, path, with_ids=False)


def op2_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"), VOCABULARY)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256.0)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), VOCABULARY)


def op7_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), words=3)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY, end_id=0, capacity=2048)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents"), carry=["doc_id"])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return scored.select("doc_id", *(f"quality.{c}" for c in counts))


def op11_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=8, carry=[])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), max_words=3, least=10, share=50, top=2000)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.vector_codes(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256.0)
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the top of the repository, beside the package

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_huffman_tokens": op1_huffman_tokens,
    "op2_ftrl_toxicity": op2_ftrl_toxicity,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_exact_topk": op4_exact_topk,
    "op5_license_scan": op5_license_scan,
    "op6_token_counts": op6_token_counts,
    "op7_pii_spans": op7_pii_spans,
    "op8_simhash_components": op8_simhash_components,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_quality_rules": op10_quality_rules,
    "op11_byte_shards": op11_byte_shards,
    "op12_collocations": op12_collocations,
    "op13_vector_codes": op13_vector_codes,
    "pipeline": pipeline,
}



def _quality_sql() -> str:
    """op10 in SQL: counts, votes, and expectation-maximisation as a recursive query over vote patterns."""
    rules, classes = range(len(quality.RULES)), range(len(quality.KINDS) + 1)
    at = lambda j, c: j * len(classes) + c + 1  # noqa: E731  place in the list of all estimates
    prior = [x for *_, kind in quality.RULES for x in quality.prior_bad(kind)]
    votes = ", ".join(f"case when {bad} then 0 when {good} then 2 else 1 end as v{j}" for j, (_, bad, good, _) in enumerate(quality.RULES))
    logs = ", ".join(" + ".join([f"ln(share[{c + 1}])", *(f"case v{j} when 0 then ln(bad[{at(j, c)}]) when 2 then ln(1 - bad[{at(j, c)}]) else 0 end" for j in rules)]) for c in classes)
    p = f"list_transform([{logs}], lambda y: exp(y))"
    share = ", ".join(f"(sum(n * p[{c + 1}]) + 1) / (sum(n) + {len(classes)})" for c in classes)
    w = quality.PRIOR_TEXTS
    bad = ", ".join(f"(sum(case v{j} when 0 then n * p[{c + 1}] else 0 end) + {w * prior[at(j, c) - 1]}) / (sum(case v{j} when 1 then 0 else n * p[{c + 1}] end) + {w})" for j in rules for c in classes)
    normal = "list_transform(w, lambda y: y / list_sum(w)) as p"
    keys = ", ".join(f"v{j}" for j in rules)
    return rf"""
        with recursive parts as (
            select doc_id, coalesce(text, '') as text,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
            from documents
        ), placed as (
            select doc_id, unnest(words) as a, generate_subscripts(words, 1) as i from parts
        ), windows as (
            select *, lead(a, 1) over (partition by doc_id order by i) as b, lead(a, 2) over (partition by doc_id order by i) as c from placed
        ), counted as (
            select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from windows where c is not null
        ), repeats as (
            select doc_id, count(distinct j) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as j from counted where n > 1) group by doc_id
        ), counts as (
            select doc_id, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
                   cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols, cast(len(lines) as bigint) as n_lines,
                   cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
                   length(regexp_replace(text, '[^A-Z]+', '', 'g')) as n_capitals, length(regexp_replace(text, '[^!]+', '', 'g')) as n_exclaims,
                   length(regexp_replace(text, '[^.?!]+', '', 'g')) as n_ends, length(regexp_replace(text, '[^\p{{L}}\p{{M}}]+', '', 'g')) as n_letters, len(list_distinct(words)) as n_distinct
            from parts left join repeats using (doc_id)
        ), voted as materialized (
            select *, {votes} from counts
        ), patterns as materialized (
            select {keys}, cast(count(*) as double) as n from voted group by all
        ), em as (
            select 0 as t, cast({list(quality.START_SHARES)} as double[]) as share, cast({prior} as double[]) as bad
            union all
            select t + 1, [{share}], [{bad}]
            from (select *, {normal} from (select em.*, patterns.*, {p} as w from em, patterns where t < {quality.EM_STEPS})) group by t
        ), scored as (
            select {keys}, {normal.replace(' as p', '[1] as p_good')} from (select {keys}, {p} as w from patterns, em where t = {quality.EM_STEPS})
        )
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
               not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and p_good >= 0.5 as kept
        from voted join scored using ({keys})"""


def _license_sql() -> str:
    """op5 in SQL: phrase places, votes of template word triples by diagonal, merged and verified spans."""
    text = lambda x: "'" + x + "'"
    grams = ", ".join(
        f"({t}, {text(label)}, {i}, {len(w)}, {text(w[i])}, {text(w[i + 1])}, {text(w[i + 2])})" for t, (label, words) in enumerate(licenses.TEMPLATES) for w in [words.split(" ")] for i in range(len(w) - 2)
    )
    phrase = lambda words: " and ".join(f"{c} = {text(w)}" for c, w in zip("abc", words))
    places = " union all ".join(f"select r, i, {text(label)} as label from placed where {phrase(words)}" for words, label in licenses.PHRASES)
    k, drift = licenses.GRAM, licenses.DRIFT
    return rf"""
        with own as (
            select row_number() over () as r, doc_id,
                   list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as words
            from documents
        ), each as (
            select r, unnest(words) as a, generate_subscripts(words, 1) - 1 as i from own
        ), placed as materialized (
            select *, lead(a, 1) over w as b, lead(a, 2) over w as c from each window w as (partition by r order by i)
        ), base as (
            select r, count(*) as n_base, min(i) as first_word, max(i) as last_word, list_sort(list(distinct label)) as labels from ({places}) group by r
        ), grams as (
            select * from (values {grams}) t(template, label, place, size, a, b, c)
        ), votes as (
            select r, template, label, size, i - place as diagonal, min(place) as low, max(place) as high, list(distinct place) as ats from placed join grams using (a, b, c) group by all
        ), steps as (
            select *, case when diagonal - lag(diagonal) over w > {drift} then 1 else 0 end as new from votes window w as (partition by r, template order by diagonal)
        ), numbered as (
            select *, sum(new) over (partition by r, template order by diagonal) as part from steps
        ), merged as (
            select r, template, label, size, list_distinct(flatten(list(ats))) as ats, min(diagonal + low) as first, max(diagonal + high + {k}) as finish, count(*) as merged from numbered group by r, template, label, size, part
        ), spans as (
            select r, label, size, first, finish - 1 as last, len(list_distinct(flatten(list_transform(ats, lambda x: range(x, x + {k}))))) / size as share
            from merged where finish - first <= size + {drift} * merged
        ), found as (
            select * from spans where share >= {licenses.COVERAGE}
        ), best as (
            select * from found a where not exists (
                select 1 from found b where a.r = b.r and a.first <= b.last and b.first <= a.last
                and (b.share > a.share or b.share = a.share and (b.size > a.size or b.size = a.size and (b.label < a.label or b.label = a.label and b.first < a.first))))
        ), more as (
            select r, list(distinct label) as more, max(share) as share from best group by r
        )
        select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(array_to_string(labels, ','), '') as base_labels,
               coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(more, [])))), ','), '') as labels,
               case when n_base > 0 then 1.0::double else coalesce(share, 0.0)::double end as score
        from own left join base using (r) left join more using (r)"""


ORACLE_SQL: dict[str, str] = {
    "op5_license_scan": _license_sql(),
    "op11_byte_shards": sql.shard_sql(),
    "op12_collocations": sql.collocation_sql(),
    "op13_vector_codes": sql.vector_code_sql(),
    "op10_quality_rules": _quality_sql(),
    "op4_exact_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
            from embeddings
            where vec_id is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scored as (
            select q.vec_id as query_id, c.vec_id,
                   cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
            from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
            where q.vec_id % 50 = 0
        ), ranked as (
            select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank
            from scored
        )
        select query_id, rank, vec_id, score from ranked where rank <= 5
    """,
}
