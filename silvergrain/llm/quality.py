"""Robust multivariate outliers among documents, with DataFrame functions only.

Per document a vector of transformed statistics is built; per language and
source its centre and spread are estimated by minimum covariance determinant
(concentration steps from several starts, the best of which goes on until its
determinant settles); documents whose squared Mahalanobis distance exceeds a
chi-square quantile are rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvergrain.llm.common import NOT_SPACE, broadcast_if_small, cut, words

#: Share of a group that the estimate rests on.
CORE = 0.75
#: Starts of the search, the steps after which the best of them is kept, and the most steps that follow.
STARTS, FIRST_STEPS, MORE_STEPS = 4, 2, 12
#: The search ends when no logarithm of a determinant falls by more than this.
SETTLED = 1e-3
#: A group's estimate is mixed with that of all groups, which weighs as much as so many documents.
POOLED = 30
#: The covariance of the CORE of least distance falls short of the whole's by this factor under a normal law: P(chi-square with
#: seven degrees <= q) / CORE is its inverse, q being the CORE quantile with five.
CONSISTENCY = 1.412
#: Squared distance beyond which a document is rejected: the 0.999 quantile of chi-square with five degrees.
CUTOFF = 20.515
#: Least spread of a direction; shares that are 0 in nearly all documents would have none. They are what a text of 100 words
#: spreads by sampling alone: a root of a share by 1 / (2 * root of the units), the units of x2 being characters, of x3 words, of
#: x4 repeats of six words at least; x1, the logarithm of a mean, by half the mean over the root of 100. Directions that spread
#: more than this don't feel it.
FLOORS = (0.2, 0.05, 0.02, 0.05, 0.12)
#: Hash of a window of three words.
WINDOW_HASH = "xxhash64({0}, {1}, {2})"
STATS = ("x0", "x1", "x2", "x3", "x4")
MOMENTS = [f"m{i}" for i in range(len(STATS))] + [f"c{i}{j}" for i in range(len(STATS)) for j in range(i + 1)]


def text_statistics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; null counts as a text without words.

    Three-word windows are sorted by the upper bits of a 64-bit hash that also
    holds the window's place (as few low bits as the text's length needs), so
    that one sort of an array of longs brings equal ones together. Windows whose
    hashes agree are compared word by word; where neighbours' words differ all
    the same, all windows of that hash are looked at.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    first = docs.withColumns({"__w": words(F.col(text_column)), "__lines": lines})
    second = first.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.length(F.array_join("__w", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            # a power of two above the number of windows
            "__m": F.expr("shiftleft(1L, cast(ceil(log2(size(__w) + 1.0D)) as int))"),
        }
    )
    third = second.withColumn("__k", F.sort_array(F.expr(f"transform(slice(__w, 1, greatest(size(__w) - 2, 0)), (w, i) -> ({WINDOW_HASH.format('w', 'get(__w, i + 1)', 'get(__w, i + 2)')} & -__m) | i)")))
    at = lambda y, k: f"get(__w, cast({y} & (__m - 1) as int) + {k})"
    words_equal = lambda y: "(" + " and ".join(f"{at('x', k)} = {at(y, k)}" for k in range(3)) + ")"
    hash_equal = lambda y: f"((x ^ {y}) & -__m) = 0"
    before, after = "coalesce(get(__k, i - 1), ~x)", "coalesce(get(__k, i + 1), ~x)"
    found = f"case when not ({hash_equal(before)} or {hash_equal(after)}) then false when {hash_equal(before)} and {words_equal(before)} then true when {hash_equal(after)} and {words_equal(after)} then true else exists(__k, y -> y <> x and {hash_equal('y')} and {words_equal('y')}) end"
    fourth = third.withColumn("__p", F.sort_array(F.expr(f"transform(filter(__k, (x, i) -> {found}), x -> x & (__m - 1))")))
    covered = "aggregate(transform(__p, (x, i) -> least(3L, coalesce(get(__p, i + 1), x + 3) - x)), 0L, (a, x) -> a + x)"
    return fourth.withColumn("n_repeat_words", F.expr(covered)).drop("__w", "__lines", "__m", "__k", "__p")


def base_failed(least_words: int = 50, repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def _vector() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = lambda c: F.sqrt(F.col(c) / n)
    return {
        "x0": F.log(n),
        "x1": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "x2": F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "x3": share("n_dup_lines"),
        "x4": share("n_repeat_words"),
    }


def _moments(core: DataFrame, key: list[str]) -> DataFrame:
    """Count n, centre m0.. and covariance c00.. per key: partial sums on the map side, whatever a key's share of the rows."""
    d = range(len(STATS))
    return core.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *(F.avg(STATS[i]).alias(f"m{i}") for i in d), *(F.covar_pop(STATS[i], STATS[j]).alias(f"c{i}{j}") for i in d for j in range(i + 1)))


def _factored(moments: DataFrame) -> DataFrame:
    """Add the lower Cholesky factor l00.. of the covariance, no direction below its floor, and log_det; drop c00.."""
    d = range(len(STATS))
    out = moments
    for i in d:
        for j in range(i + 1):
            rest = reduce(lambda a, b: a + b, [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.lit(0.0))
            value = F.col(f"c{i}{j}") - rest
            value = F.sqrt(F.greatest(value, F.lit(FLOORS[i] ** 2))) if i == j else value / F.col(f"l{j}{j}")
            out = out.withColumn(f"l{i}{j}", value)
    logs = reduce(lambda a, b: a + b, [F.log(f"l{i}{i}") for i in d])
    return out.withColumn("log_det", 2 * logs)


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. from m0.. by forward substitution with l00.."""
    y: list[Column] = []
    for i in range(len(STATS)):
        rest = reduce(lambda a, b: a + b, [F.col(f"l{i}{k}") * y[k] for k in range(i)], F.lit(0.0))
        y.append((F.col(STATS[i]) - F.col(f"m{i}") - rest) / F.col(f"l{i}{i}"))
    return reduce(lambda a, b: a + b, [v * v for v in y])


def _starts(vectors: DataFrame) -> DataFrame:
    """(grp, start, x0.., d): distances from the medians in units of the quartile range (their squares' sum, their largest,
    their sum) and from the means in standard deviations."""
    q = vectors.groupBy("grp").agg(*(F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"q{c}") for c in STATS), *(F.avg(c).alias(f"a{c}") for c in STATS), *(F.stddev_pop(c).alias(f"s{c}") for c in STATS))
    joined = vectors.join(broadcast_if_small(cut(q, "quartiles")), "grp")
    z = [F.abs(F.col(c) - F.col(f"q{c}")[1]) / F.greatest((F.col(f"q{c}")[2] - F.col(f"q{c}")[0]) / 1.349, F.lit(f)) for c, f in zip(STATS, FLOORS, strict=True)]
    plain = [(F.col(c) - F.col(f"a{c}")) / F.greatest(F.col(f"s{c}"), F.lit(f)) for c, f in zip(STATS, FLOORS, strict=True)]
    add = lambda terms: reduce(lambda a, b: a + b, terms)
    ways = [add([v * v for v in z]), add([v * v for v in plain]), F.greatest(*z), add(z)]
    return joined.select("grp", *STATS, F.posexplode(F.array(*ways)).alias("start", "d"))


def _step(ranged: DataFrame) -> DataFrame:
    """The fit of each (grp, start) to the CORE of least d.

    What is joined to the rows are tables of a row per group and start: small
    ones, by count, are broadcast and the rows stay where they are; others meet
    them in a join that splits skewed keys.
    """
    near = cut(ranged.groupBy("grp", "start").agg(F.percentile_approx("d", F.lit(CORE), 2000).alias("__most")), "near")
    core = ranged.join(broadcast_if_small(near), ["grp", "start"]).where(F.col("d") <= F.col("__most"))
    return cut(_factored(_moments(core, ["grp", "start"])), "fit")


def minimum_covariance_determinant(vectors: DataFrame) -> DataFrame:
    """Per grp: n (rows of the core), m0.., c00.., l00.., log_det of the least determinant found.

    vectors: grp, x0... Every quantile and moment is a mergeable aggregate over
    all rows, so a group that holds a third of them is no more than a key. The
    search ends when no group's log_det falls by more than SETTLED, after
    FIRST_STEPS + MORE_STEPS at the latest: a group that is still falling then keeps its last fit.
    """
    against = lambda fit: vectors.join(broadcast_if_small(fit), "grp").withColumn("d", _distance()).select("grp", "start", *STATS, "d")
    fit = _step(_starts(vectors))
    for _ in range(FIRST_STEPS - 1):
        fit = _step(against(fit))
    best = fit.groupBy("grp").agg(F.min_by("start", F.struct("log_det", "start")).alias("start"))
    fit = cut(fit.join(best, ["grp", "start"]), "best")
    for _ in range(MORE_STEPS):
        nxt = _step(against(fit))
        fell = fit.join(nxt.select("grp", F.col("log_det").alias("__next")), "grp").agg(F.max(F.col("log_det") - F.col("__next"))).first()[0]
        fit = nxt
        if fell is None or fell <= SETTLED:
            break
    return fit.drop("start")


def shrunk(fit: DataFrame) -> DataFrame:
    """Per grp: m0.., l00.. of its consistent estimate mixed with that of all groups, by POOLED.

    All groups' covariance is the mean one inside groups plus that of their
    centres. A group of many documents keeps its own estimate, one of a few is
    judged like the collection; in between nothing jumps.
    """
    d = range(len(STATS))
    fit = fit.select("grp", F.col("n").cast("double").alias("n"), *[f"m{i}" for i in d], *[(CONSISTENCY * F.col(f"c{i}{j}")).alias(f"c{i}{j}") for i in d for j in range(i + 1)])
    mean = lambda c: F.sum(F.col("n") * c) / F.sum("n")
    pool = fit.agg(*(mean(F.col(f"m{i}")).alias(f"pm{i}") for i in d), *((mean(F.col(f"c{i}{j}")) + mean(F.col(f"m{i}") * F.col(f"m{j}")) - mean(F.col(f"m{i}")) * mean(F.col(f"m{j}"))).alias(f"pc{i}{j}") for i in d for j in range(i + 1)))
    own = F.col("n") / (F.col("n") + CORE * POOLED)
    mixed = fit.crossJoin(F.broadcast(pool)).select("grp", *[(own * F.col(c) + (1 - own) * F.col("p" + c)).alias(c) for c in MOMENTS])  # one row
    return _factored(mixed).drop(*[f"c{i}{j}" for i in d for j in range(i + 1)], "log_det")


def _measured(docs: DataFrame, id_column: str, text_column: str, carry: dict[str, Column]) -> DataFrame:
    """doc_id, grp, the statistics, base_failed, x0.. and the columns of carry."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) if c in docs.columns else F.lit("")
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.concat_ws("\1", name("lang"), name("source")).alias("grp"), *(c.alias(k) for k, c in carry.items()))
    return text_statistics(narrow).drop("text").withColumn("base_failed", base_failed()).withColumns(_vector())


def _estimates(stats: DataFrame) -> DataFrame:
    """Per grp: m0.., l00.. by the rows that pass the base rules."""
    return shrunk(minimum_covariance_determinant(stats.where(~F.col("base_failed")).select("grp", *STATS)))


def _verdict(stats: DataFrame, fit: DataFrame) -> DataFrame:
    """Add distance and kept, which is one condition on both sides of the join, so that none of it is worked out below."""
    judged = stats.join(broadcast_if_small(fit), "grp", "left").withColumn("distance", _distance())
    return judged.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))))


def estimates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """What kept_documents judges by: a row per language and source."""
    return _estimates(cut(_measured(docs, id_column, text_column, {}).select("grp", *STATS, "base_failed"), "statistics"))


def kept_documents(docs: DataFrame, fit: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that quality_verdicts keeps, whole. fit: estimates of the same docs.

    Statistics are worked out again where a row is read, so that no row has to
    move to meet its verdict.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return _verdict(_measured(docs, id_column, text_column, {"__row": row}), fit).where("kept").select("__row.*")


def quality_verdicts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance and the columns of carry.

    Estimates use the rows that pass the base rules. Null and empty texts have no
    words and fail them. A null language or source is a value of its own; a
    group without rows that pass has no estimate and needs none. Repeated rows
    count and return as often as they come, and equal rows (ties) get equal
    verdicts. Very long texts are read whole; other columns are ignored,
    whatever their names. An empty table gives an empty one. distance is the
    squared distance, to be held against chi-square with five degrees.
    """
    stats = cut(_measured(docs, id_column, text_column, {f"__carry{k}": F.col(c) for k, c in enumerate(carry)}), "statistics")
    judged = _verdict(stats, cut(_estimates(stats), "estimates"))
    return judged.select(F.col("doc_id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance", *(F.col(f"__carry{k}").alias(c) for k, c in enumerate(carry)))
