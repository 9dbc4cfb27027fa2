"""Quality rules with robust multivariate outliers, in DataFrame functions alone.

measured() takes each text's statistics; fitted() estimates, per language and source, the minimum covariance determinant of
their transforms: two concentration steps (each keeps the rows nearest to the current estimate) from four fixed starts,
then steps from the start of the least determinant until no group's determinant falls any more; judged() rejects rows of a
large Mahalanobis distance.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import free, settled

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: Words of a window that counts as repeated.
WINDOW = 8
#: Share of a group's rows that an estimate rests on.
CORE = 0.75
#: What makes the core's covariance consistent for normal rows: CORE / P(chi2(6) <= the CORE quantile of chi2(4)).
CONSISTENCY = 1.486
#: Squared distance beyond which a row is rejected: with 4 statistics, a normal row gets there once in 10^8.
CUTOFF = 42.0
#: Rows that a group needs for an estimate of its own; the rows of smaller ones are taken by language.
LEAST = 60
#: Groups, at most, whose numbers (under 1 kB each) are sent to every executor; more are joined by salted keys.
SENT, SALTS = 20_000, 64
#: Starts of an estimate, concentration steps of each, and the fall of a log determinant that is worth another step.
STARTS, STEPS, FALL = 4, 2, 1e-3
#: Words that an average text adds to each text, so that the shares of a short one are not wild.
PRIOR = 40.0
#: Least standard deviation of each transformed statistic.
FLOOR = (0.05, 0.15, 0.15, 0.15)
_P = len(FLOOR)
#: What judged() reads of measured() rows.
_MEASURED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _bound(value: Column, use) -> Column:  # noqa: ANN001
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more; hashes are those of the windows at each word."""

    def walk(ranked: Column) -> Column:
        n = F.size(ranked)
        twice = F.transform(
            ranked,
            lambda x, k: F.when(
                ((k > 0) & (F.get(ranked, k - 1)["h"] == x["h"])) | ((k < n - 1) & (F.get(ranked, k + 1)["h"] == x["h"])), x["at"]
            ),
        )
        begins = F.array_sort(F.array_compact(twice))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum"))
        return F.aggregate(begins, start, lambda acc, at: F.struct(at.alias("last"), (acc["sum"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("sum")))["sum"]

    ranked = F.array_sort(F.transform(hashes, lambda h, at: F.struct(h.alias("h"), at.alias("at"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _bound(ranked, walk)).otherwise(0)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each whole text, and base_failed.

    Null and empty texts have no words, so they fail. A row gets its numbers from its own text alone: repeated rows get the
    same ones, ids and other columns may hold anything, an empty table gives no rows. Texts of any length are taken whole.
    Columns of docs with these names are replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    some = F.btrim(text, F.lit(_SPACE))
    words = F.when(some == "", F.array().cast("array<string>")).otherwise(F.split(some, r"[ \t-\r]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))

    def counts(w: Column) -> Column:
        last = F.size(w) - (WINDOW - 1)
        windows = F.when(last > 1, F.transform(F.sequence(F.lit(1), last), lambda k: F.xxhash64(F.slice(w, k, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
        return F.struct(F.size(w).cast("bigint").alias("n_words"), _bound(windows, _covered).cast("bigint").alias("n_repeat_words"))

    def line_counts(x: Column) -> Column:
        return (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")

    both = free("words", docs.columns)
    out = docs.withColumns(
        {
            both: _bound(words, counts),
            "word_chars": F.length(F.translate(text, _SPACE, "")).cast("bigint"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("bigint"),
            "n_dup_lines": _bound(lines, line_counts),
        }
    )
    out = out.withColumns({k: F.col(both)[k] for k in ("n_words", "n_repeat_words")}).drop(both)
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _vector() -> list[Column]:
    """The transformed statistics: the word length and the shares of symbols, repeated lines and repeated words, in logarithms."""
    n = F.col("n_words") + PRIOR
    return [
        F.log((F.col("word_chars") + 5.5 * PRIOR) / n),
        F.log1p(20.0 * F.col("n_symbols") / n),
        F.log1p(20.0 * F.col("n_dup_lines") / n),
        F.log1p(5.0 * F.col("n_repeat_words") / n),
    ]


def _total(parts: list[Column]) -> Column:
    return reduce(add, parts)


def _squared(x: list[Column], inverse: dict[tuple[int, int], Column], mean: list[Column]) -> Column:
    """The squared Mahalanobis distance by the inverse of the lower Cholesky factor."""
    d = [a - m for a, m in zip(x, mean, strict=True)]
    return _total([_total([inverse[i, j] * d[j] for j in range(i + 1)]) * _total([inverse[i, j] * d[j] for j in range(i + 1)]) for i in range(_P)])


def _factored(moments: DataFrame, keys: list[str], s: int) -> DataFrame:
    """Mean, inverse Cholesky factor and log determinant of start s from the sums of its core."""
    name = lambda k, *i: f"{k}{s}_" + "_".join(map(str, i))
    out = moments.withColumns({name("m", i): F.col(name("s", i)) / F.col(name("n", 0)) for i in range(_P)})
    for i, j in combinations_with_replacement(range(_P), 2):  # i <= j
        cov = F.col(name("q", i, j)) / F.col(name("n", 0)) - F.col(name("m", i)) * F.col(name("m", j))
        out = out.withColumn(name("c", j, i), CONSISTENCY * cov + (FLOOR[i] ** 2 if i == j else 0.0))
    for j in range(_P):
        done = _total([F.col(name("l", j, k)) ** 2 for k in range(j)]) if j else F.lit(0.0)
        out = out.withColumn(name("l", j, j), F.sqrt(F.greatest(F.col(name("c", j, j)) - done, F.lit(1e-9))))
        for i in range(j + 1, _P):
            done = _total([F.col(name("l", i, k)) * F.col(name("l", j, k)) for k in range(j)]) if j else F.lit(0.0)
            out = out.withColumn(name("l", i, j), (F.col(name("c", i, j)) - done) / F.col(name("l", j, j)))
    for i in range(_P):
        out = out.withColumn(name("v", i, i), 1 / F.col(name("l", i, i)))
        for j in range(i):
            below = _total([F.col(name("l", i, k)) * F.col(name("v", k, j)) for k in range(j, i)])
            out = out.withColumn(name("v", i, j), -below / F.col(name("l", i, i)))
    out = out.withColumn(name("det", 0), _total([F.log(F.col(name("l", i, i))) for i in range(_P)]))
    kept = [name("m", i) for i in range(_P)] + [name("v", i, j) for i in range(_P) for j in range(i + 1)] + [name("det", 0)]
    return out.select(*keys, *kept)


def _keyed(stats: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """stats with its group: (language, source), nulls being values of their own, and a salt."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    salt = F.floor(F.rand(11) * SALTS).cast("int")
    return stats.withColumns({"_lang": name(lang_col), "_source": name(source_col), "_salt": salt})


def _met(rows: DataFrame, groups: DataFrame, keys: list[str], few: bool, how: str = "inner") -> DataFrame:
    """rows (with _salt) joined with a row a group: sent to every executor if there are few (at most SENT), else salted."""
    if few:
        return rows.join(F.broadcast(groups), keys, how)
    spread = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(spread, [*keys, "_salt"], how)


def _sums(s: int, x: list[Column], on: Column | None = None) -> list[Column]:
    """Number, sums and sums of products of x over the rows that are on, as start s."""
    held = (lambda v: F.sum(F.when(on, v))) if on is not None else F.sum
    out = [held(F.lit(1.0)).alias(f"n{s}_0"), *[held(x[i]).alias(f"s{s}_{i}") for i in range(_P)]]
    return out + [held(x[i] * x[j]).alias(f"q{s}_{i}_{j}") for i, j in combinations_with_replacement(range(_P), 2)]


def _distance(s: int, x: list[Column], mean: list[Column] | None = None) -> Column:
    """The squared distance of x by start s."""
    return _squared(x, {(i, j): F.col(f"v{s}_{i}_{j}") for i in range(_P) for j in range(i + 1)}, mean or [F.col(f"m{s}_{i}") for i in range(_P)])


def _joined(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys), parts)


def _step(placed: DataFrame, keys: list[str], x: list[Column], starts: range, few: bool) -> DataFrame:
    """The estimates of each group from the CORE rows of the least distance (_d0, ...) of each start."""
    cuts = placed.groupBy(*keys).agg(*[F.percentile_approx(f"_d{s}", CORE, 2000).alias(f"_cut{s}") for s in starts])
    inside = [v for s in starts for v in _sums(s, x, F.col(f"_d{s}") <= F.col(f"_cut{s}"))]
    sums = settled(_met(placed, cuts, keys, few).groupBy(*keys).agg(*inside))
    return settled(_joined([_factored(sums, keys, s) for s in starts], keys))


def _own_groups(good: DataFrame, keys: list[str]) -> DataFrame:
    """(_lang, _source) with the group (_own_lang, _own) that it is judged by."""
    sizes = settled(good.groupBy(*keys).agg(F.count("*").alias("_n")))
    pools = sizes.where(F.col("_n") < LEAST).groupBy("_lang").agg(F.sum("_n").alias("_pool"))
    sizes = sizes.join(pools, "_lang", "left")
    large, pooled = F.col("_n") >= LEAST, F.col("_pool") >= LEAST
    lang = F.when(large | pooled, F.col("_lang")).otherwise(F.lit("*"))
    return settled(sizes.select(*keys, lang.alias("_own_lang"), F.when(large, F.col("_source")).otherwise(F.lit("*")).alias("_own")))


def fitted(stats: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """A row a (language, source) of measured() rows: mean, inverse Cholesky factor and log determinant of its estimate.

    Groups of under LEAST rows that pass the base rules are pooled by language; where such a pool is under LEAST too, they
    are judged by one estimate of all rows of the table. The numbers are null where even those are under LEAST. Rows that repeat count
    each time; null languages and sources are values of their own; an empty table gives no rows. All sums are taken per
    task before they move.
    """
    keys = ["_lang", "_source"]
    x = [F.col(f"_x{i}") for i in range(_P)]
    good = _keyed(stats, lang_col, source_col).where(~F.col("base_failed"))
    good = settled(good.select(*keys, "_salt", *[v.alias(f"_x{i}") for i, v in enumerate(_vector())]))
    own = _own_groups(good, keys)
    few = own.count() <= SENT
    placed = _met(good, own, keys, few)
    every = placed.where("_own_lang != '*'").withColumns({"_lang": F.col("_own_lang"), "_source": F.col("_own")}).select(good.columns)
    if own.where("_own_lang = '*'").take(1):
        every = every.unionByName(good.withColumns({"_lang": F.lit("*"), "_source": F.lit("*")}))
    good = settled(every)

    # The starts, in units of the middle half around the medians: the distance, its largest part, and distances by the
    # covariances of the hyperbolic tangents and of the directions.
    quarter = good.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.percentile_approx(c, [0.25, 0.5, 0.75], 2000).alias(f"_q{i}") for i, c in enumerate(x)])
    quarter = settled(quarter.where(F.col("_n") >= LEAST).drop("_n"))
    z = [(x[i] - F.col(f"_q{i}")[1]) / (F.col(f"_q{i}")[2] - F.col(f"_q{i}")[0] + FLOOR[i]) for i in range(_P)]
    unit = _met(good, quarter, keys, few).select(*keys, "_salt", *x, *[v.alias(f"_z{i}") for i, v in enumerate(z)])
    z = [F.col(f"_z{i}") for i in range(_P)]
    length = F.sqrt(_total([v * v for v in z]))
    shapes = [[F.tanh(v) for v in z], [F.when(length > 0, v / length).otherwise(0.0) for v in z]]
    shaped = settled(unit.groupBy(*keys).agg(*[v for s, y in enumerate(shapes) for v in _sums(s, y)]))
    shaped = settled(_joined([_factored(shaped, keys, s) for s in range(2)], keys))
    middle = [F.lit(0.0)] * _P
    near = [length, F.greatest(*[F.abs(v) for v in z]), _distance(0, z, middle), _distance(1, z, middle)]
    at = _met(unit, shaped, keys, few)
    for _ in range(STEPS):
        current = _step(at.select(*keys, "_salt", *x, *[d.alias(f"_d{s}") for s, d in enumerate(near)]), keys, x, range(STARTS), few)
        at, near = _met(good, current, keys, few), [_distance(s, x) for s in range(STARTS)]

    def least(rows: DataFrame, starts: range) -> DataFrame:
        """Of some starts that of the least determinant, as start 0."""
        dets = [F.col(f"det{s}_0") for s in starts]
        best = F.least(*dets)
        every = [F.struct(*[F.col(f"{k}{s}_{n}").alias(f"{k}0_{n}") for k, n in kinds]) for s in starts]
        chosen = F.coalesce(*[F.when(d == best, e) for d, e in zip(dets, every, strict=True)])
        return rows.select(*keys, chosen.alias("_best")).select(*keys, "_best.*")

    kinds = [("m", str(i)) for i in range(_P)] + [("v", f"{i}_{j}") for i in range(_P) for j in range(i + 1)] + [("det", "0")]
    best = settled(least(current, range(STARTS)))
    while True:
        after = _step(_met(good, best, keys, few).select(*keys, "_salt", *x, _distance(0, x).alias("_d0")), keys, x, range(1), few)
        moved = after.select(*keys, *[F.col(f"{k}0_{n}").alias(f"{k}1_{n}") for k, n in kinds]).join(best, keys)
        falls = bool(moved.where(F.col("det1_0") < F.col("det0_0") - FALL).take(1))
        best = settled(least(moved, range(2)))
        if not falls:
            break
    named = own.select(F.col("_lang").alias("_l"), F.col("_source").alias("_s"), F.col("_own_lang").alias("_lang"), F.col("_own").alias("_source"))
    return settled(named.join(best, keys, "left").drop(*keys).withColumnsRenamed({"_l": "_lang", "_s": "_source"}))


def judged(stats: DataFrame, groups: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """measured() rows with distance2 (squared, robust; null where there is no estimate) and kept, by fitted() groups.

    A row is kept if it passes the base rules and its distance is within CUTOFF, or if there is no estimate: only where
    fewer than LEAST rows of the whole table pass. Repeated rows are judged alike; an empty table gives no rows. Other columns
    may have any names and stay as they are; columns named distance2 and kept are replaced.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in stats.columns if c not in ("distance2", "kept")])
    rows = stats.select(whole.alias("whole"), *_MEASURED, F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"))
    found = _met(_keyed(rows, "lang", "source"), groups, ["_lang", "_source"], groups.count() <= SENT, "left")
    found = found.withColumn("distance2", _distance(0, _vector()))
    found = found.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= CUTOFF))
    return found.select("whole.*", "distance2", "kept")
