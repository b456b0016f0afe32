"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation estimates how accurate they are,
and the posterior probability of good quality decides. DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import materialize, whole_row

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"

#: Kinds of junk. A text is good or of one of these, and the rules of a kind are expected to fire together.
KINDS = ("noise", "repetition", "shouting")
#: Each rule: (name, SQL of a bad vote, SQL of a good vote, kind it was written for or None); neither: it abstains. Columns:
#: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_exclaims, n_ends, n_letters, n_distinct.
#: Distinct words are compared on the logarithmic scale, on which their share hardly falls with a text's length.
RULES = (
    ("length", "n_words < 50", "n_words >= 60", None),
    ("repeated words", "100 * n_repeat_words > 40 * n_words", "100 * n_repeat_words < 10 * n_words", "repetition"),
    ("distinct words", "ln(n_distinct + 1) < 0.83 * ln(n_words + 1)", "ln(n_distinct + 1) > 0.9 * ln(n_words + 1)", "repetition"),
    ("repeated lines", "100 * n_dup_lines > 25 * n_lines", "100 * n_dup_lines < 5 * n_lines", "repetition"),
    ("symbols", "100 * n_symbols > 20 * n_words", "100 * n_symbols < 2 * n_words", "noise"),
    ("letters", "100 * n_letters < 90 * word_chars", "100 * n_letters > 94 * word_chars", "noise"),
    ("word length", "word_chars < 3 * n_words or word_chars > 20 * n_words", "2 * word_chars >= 7 * n_words and word_chars <= 12 * n_words", "noise"),
    ("sentence ends", "100 * n_ends < n_words or 100 * n_ends > 40 * n_words", "100 * n_ends >= 2 * n_words and 100 * n_ends <= 30 * n_words", "shouting"),
    ("capitals", "100 * n_capitals > 30 * word_chars", "100 * n_capitals < 10 * word_chars", "shouting"),
    ("exclamations", "100 * n_exclaims > 30 * n_words", "100 * n_exclaims < 5 * n_words", "shouting"),
)

#: Steps of expectation-maximisation and the shares of good texts and of each kind of junk that it starts from.
EM_STEPS = 30
START_SHARES = (0.85, 0.05, 0.05, 0.05)
#: Beta prior of a rule's bad votes: its weight in texts, and the expected share of bad votes among those on good texts, on
#: the rule's own kind of junk and on other kinds. The same for every rule; nothing is clamped.
PRIOR_TEXTS, PRIOR_GOOD, PRIOR_OWN, PRIOR_OTHER = 100.0, 0.02, 0.6, 0.1


def prior_bad(kind: str | None) -> list[float]:
    """Expected share of bad votes of a rule written for ``kind``, on good texts and on each kind of junk."""
    return [PRIOR_GOOD, *(PRIOR_OWN if kind == k else PRIOR_OTHER for k in KINDS)]


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, as an array's only element: lambdas compute what stands in them for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Number of words that stand in three-word windows found twice or more in ``words``.

    Windows are compared by the 64-bit XXH64 of their words; sorting the positions by that value puts equal windows
    side by side, and each repeated position covers three words less what its successor covers as well.
    """

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    def positions(pairs: Column) -> Column:
        def again(x, i):
            return F.coalesce(F.get(pairs, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(pairs, i + 1)["h"] == x["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(pairs, again), lambda x: x["i"]))

    def count(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, lambda x: let(positions(x), covered)))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(hashes, count))


def features(text: Column) -> Column:
    """Struct of the counts that rules read, of a text that isn't null; see the names in RULES."""

    def of_words(words: Column) -> Column:
        joined = F.array_join(words, "")
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(joined).cast("long").alias("word_chars"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    left = lambda drop: F.length(F.regexp_replace(text, drop, "")).cast("long")  # noqa: E731  characters outside the class
    words = let(F.array_remove(F.split(text, BLANKS), ""), of_words)
    lines = let(F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")), of_lines)
    return F.struct(
        words.alias("words"), lines.alias("lines"), left(SYMBOLS).alias("n_symbols"), left("[^A-Z]+").alias("n_capitals"), left("[^!]+").alias("n_exclaims"), left("[^.?!]+").alias("n_ends"),
        left(r"[^\p{L}\p{M}]+").alias("n_letters"),
    )


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_q``, a struct of the counts, base_failed, and ``votes``, one digit for each rule: 0 bad, 1 no vote, 2 good."""
    f = docs.withColumn("_f", features(F.coalesce(F.col(text_col), F.lit(""))))
    counts = [F.col(f"_f.words.{c}") for c in ("n_words", "word_chars", "n_repeat_words", "n_distinct")] + [F.col(f"_f.lines.{c}") for c in ("n_lines", "n_dup_lines")] + [F.col(f"_f.{c}") for c in ("n_symbols", "n_capitals", "n_exclaims", "n_ends", "n_letters")]
    f = f.withColumn("_q", F.struct(*counts)).drop("_f")
    prefix = lambda sql: "".join(f"_q.{w}" if w.startswith(("n_", "word_")) else w for w in sql.replace("(", " ( ").split(" ") for w in (w, " "))
    votes = [F.expr(f"case when {prefix(bad)} then '0' when {prefix(good)} then '2' else '1' end") for _, bad, good, *_ in RULES]
    failed = F.expr("_q.n_words < 50 or 100 * _q.n_repeat_words > 50 * _q.n_words")
    return f.withColumn("_q", F.struct("_q.*", failed.alias("base_failed"), F.concat(*votes).alias("votes")))


def fitted(patterns: DataFrame, steps: int = EM_STEPS, rules=RULES) -> DataFrame:
    """(rows, p, fit) of (votes, n), one row: the patterns, each one's posterior by class, and the estimates.

    Latent classes are good texts and each kind of junk. Given its class, a rule that votes says bad with a probability of
    its own, ``fit.bad[rule][class]``; abstaining says nothing. Expectation-maximisation alternates posteriors and
    estimates from the weights of all patterns (at most 3 to the number of rules) under one weak Beta prior, which also
    says which kind a rule is meant for. A fold over ``steps`` does it in one row, so the corpus is read once.
    """
    last, classes = len(rules) - 1, len(KINDS) + 1
    doubles = lambda xs: "array(" + ", ".join(f"{x}D" for x in xs) + ")"
    prior = "array(" + ", ".join(doubles(prior_bad(kind)) for *_, kind in rules) + ")"
    state = "struct<share array<double>, bad array<array<double>>>"
    start = f"named_struct('share', {doubles(START_SHARES)}, 'bad', {prior})"
    vote = "case x.v[j] when 0 then ln(s.bad[j][c]) when 2 then ln(1 - s.bad[j][c]) else 0D end"
    logs = f"transform(sequence(0, {classes - 1}), c -> aggregate(sequence(0, {last}), ln(s.share[c]), (a, j) -> a + {vote}))"
    soft = f"transform(array({logs}), l -> transform(l, y -> exp(y - array_max(l))))[0]"
    expect = f"transform(pats, x -> transform(array({soft}), w -> transform(w, y -> y / aggregate(w, 0D, (a, z) -> a + z)))[0])"
    total = lambda term: f"aggregate(zip_with(pats, q, (x, p) -> {term}), 0D, (a, y) -> a + y)"
    share = f"transform(sequence(0, {classes - 1}), c -> ({total('x.n * p[c]')} + 1D) / ({total('x.n')} + {classes}D))"
    said, voted = total("if(x.v[j] = 0, x.n * p[c], 0D)"), total("if(x.v[j] = 1, 0D, x.n * p[c])")
    bad = f"transform(sequence(0, {last}), j -> transform(sequence(0, {classes - 1}), c -> ({said} + {PRIOR_TEXTS}D * {prior}[j][c]) / ({voted} + {PRIOR_TEXTS}D)))"
    step = f"cast(transform(array({expect}), q -> named_struct('share', {share}, 'bad', {bad}))[0] as {state})"
    one = patterns.groupBy().agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("rows"))  # bounded by the number of patterns
    one = one.withColumn("pats", F.expr("transform(rows, r -> struct(transform(split(r.votes, ''), d -> cast(d as int)) as v, cast(r.n as double) as n))"))
    done = one.where("size(rows) > 0").withColumn("fit", F.expr(f"aggregate(sequence(1, {steps}), cast({start} as {state}), (s, t) -> {step})"))
    return done.withColumn("p", F.expr(f"transform(array(fit), s -> {expect})[0]")).select("rows", "p", "fit")


def posterior(patterns: DataFrame, steps: int = EM_STEPS) -> DataFrame:
    """(votes, p_good) from (votes, n): the posterior probability of good quality of each vote pattern; see ``fitted``."""
    found = fitted(patterns, steps).select(F.explode(F.arrays_zip("rows", "p")).alias("z"))
    return found.select(F.col("z.rows.votes").alias("votes"), F.get("z.p", F.lit(0)).alias("p_good"))


def rule_estimates(patterns: DataFrame, steps: int = EM_STEPS, rules=RULES) -> DataFrame:
    """(rule, bad_on_good, bad_on_junk, accuracy) from (votes, n): a rule's estimated shares of bad votes on good texts and
    on all junk, and the mean of its accuracies on both. An empty table gives no rows."""
    names = F.array(*(F.lit(name) for name, *_ in rules))
    each = fitted(patterns, steps, rules).select("fit.share", F.explode(F.arrays_zip(names.alias("name"), F.col("fit.bad").alias("bad"))).alias("z"))
    junk = "aggregate(zip_with(share, z.bad, (a, b) -> a * b), 0D, (a, x) -> a + x) - share[0] * z.bad[0]"
    out = each.select(F.col("z.name").alias("rule"), F.expr("z.bad[0]").alias("bad_on_good"), F.expr(f"({junk}) / (1 - share[0])").alias("bad_on_junk"))
    return out.withColumn("accuracy", (1 - F.col("bad_on_good") + F.col("bad_on_junk")) / 2)


def score_quality(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``carry``; None: all) with ``quality``: a struct of the counts, votes, base_failed, p_good and kept (p_good >= 0.5 and not base_failed).

    Null text counts as empty: no words, so base_failed. Rows that repeat vote each. An empty table gives no rows.
    A column named ``quality`` is replaced; others stay. The counts are computed once and written to the shared folder;
    the posterior table (at most 3 to the number of rules rows) is broadcast.
    """
    own = [c for c in (docs.columns if carry is None else carry) if c != "quality"]
    packed = docs.select(whole_row(docs, own).alias("row"), F.col(text_col).alias("text"))  # no name can clash with those used here
    scored = materialize(measured(packed).select("row", "_q"), "quality")
    model = posterior(scored.groupBy(F.col("_q.votes").alias("votes")).agg(F.count(F.lit(1)).alias("n")))
    joined = scored.join(F.broadcast(model), F.col("_q.votes") == model["votes"]).drop(model["votes"])
    kept = ~F.col("_q.base_failed") & (F.col("p_good") >= 0.5)
    return joined.select("row.*", F.struct("_q.*", "p_good", kept.alias("kept")).alias("quality"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns unchanged, whatever their names.

    Null and empty texts have no words, so they go; ids aren't read and may be null; rows that repeat are kept or go alike;
    a posterior of exactly one half is kept; an empty table gives none; very long texts are measured whole.
    """
    own = docs.select(whole_row(docs).alias("kept_row"), F.col(text_col).alias("text"))
    return score_quality(own, carry=["kept_row"]).where("quality.kept").select("kept_row.*")
