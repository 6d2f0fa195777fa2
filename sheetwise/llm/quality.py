"""Quality rules: fixed base rules, and robust multivariate outliers by minimum covariance determinants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, cut, let, n_words, table, words

MIN_WORDS = 10
MOST_REPEATED = 20  # percent of the words
SYMBOLS = "#*$%&|<>"
SHINGLE = 5

#: The transformed statistics, in thousandths, and the standard deviations of the target that every covariance is regularised
#: by (as in minimum regularised covariance determinants): its square is added to the diagonal. Most documents have no
#: symbol and no repeated line or window, so that half of a group often lies on one hyperplane, where a plain determinant is 0 and any
#: document off it would be infinitely far. What these deviations say is how much of a symbol or a repeat is ordinary.
FEATURES = {"f_length": 120, "f_symbols": 40, "f_lines": 100, "f_repeats": 150}
#: Squared Mahalanobis distance beyond which a document goes: the 0.99999 quantile of chi-square with 4 degrees.
CUTOFF = 28.47
#: Share of a group that the covariance determinant is taken over, and what makes that covariance consistent for normal
#: data: share / P(chi-square with 6 degrees <= the median of chi-square with 4).
SHARE, CONSISTENT = 0.5, 2.11
#: Rows that the least determinant finds within the 0.975 quantile of chi-square with 4 degrees give the final estimate, with its own factor.
INNER, INNER_CONSISTENT = 11.14, 1.0645
#: Concentration steps at most, from each start; they end when no determinant falls by more than this share any more.
STEPS, SETTLED = 12, 1e-3
#: Starts from parts of a group, dealt by a hash of the statistics, besides those from the whole of it.
PARTS = 4
#: Groups up to which their estimates (about 700 bytes each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_GROUPS = 20_000


def _covered(pairs: Column) -> Column:
    """pairs: sorted (gram, position); the number of words in the windows whose gram occurs twice or more."""
    n = F.size(pairs)
    gram = lambda i: F.get(pairs, i)["g"]
    same = lambda i, j: F.coalesce(gram(i) == gram(j), F.lit(False))
    again = F.filter(F.sequence(F.lit(0), n - 1), lambda i: same(i, i - 1) | same(i, i + 1))
    places = F.sort_array(F.transform(again, lambda i: F.get(pairs, i)["p"]))
    return let(places, lambda at: F.aggregate(
        F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda x, y: F.least(F.lit(SHINGLE), F.coalesce(y - x, F.lit(SHINGLE)))),
        F.lit(0), lambda a, x: a + x,
    ))


def n_repeat_words(text: Column) -> Column:
    """Words in windows of SHINGLE words that occur twice or more in the text, first occurrences included."""

    def of_words(w: Column) -> Column:
        n = F.size(w)
        grams = F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE)))))
        return let(grams, lambda g: F.when(
            F.size(F.array_distinct(g)) < F.size(g),
            let(F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("p")))), _covered),
        ))

    return F.coalesce(let(words(text), of_words), F.lit(0)).cast("long")


def statistics(text: Column) -> dict[str, Column]:
    """The base statistics of a text; all 0 for null."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": n_words(text),
        "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": n_repeat_words(text),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _features() -> list[Column]:
    thousandths = lambda x: F.round(1000 * x).cast("long")
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return [
        thousandths(F.log(chars / n)).alias("f_length"),
        thousandths(F.sqrt(F.col("n_symbols") / chars)).alias("f_symbols"),
        thousandths(F.sqrt(F.col("n_dup_lines") * 10 / n)).alias("f_lines"),
        thousandths(F.sqrt(F.col("n_repeat_words") / n)).alias("f_repeats"),
    ]


def _cholesky(cov) -> dict[tuple[int, int], Column]:
    """Lower factor of a covariance given as columns cov(i, j)."""
    low: dict[tuple[int, int], Column] = {}
    for i in range(len(FEATURES)):
        for j in range(i + 1):
            rest = cov(i, j)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            low[i, j] = F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}")
    return low


_P = len(FEATURES)
_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]
_SUMS = ["n", *[f"s{i}" for i in range(_P)], *[f"q{i}{j}" for i, j in _PAIRS]]
_ESTIMATE = [*[f"m{i}" for i in range(_P)], *[f"l{i}{j}" for i, j in _PAIRS]]


def _factored(moments: DataFrame, consistent: float) -> DataFrame:
    """Group sums (n, s_i, q_ij) -> means m_i, the factor l_ij of the regularised covariance, and the logarithm of its determinant."""
    floors = list(FEATURES.values())
    n = F.col("n").cast("double")
    out = moments.select("*", *[(F.col(f"s{i}") / n).alias(f"m{i}") for i in range(_P)])
    cov = lambda i, j: consistent * (F.col(f"q{i}{j}") / n - F.col(f"m{i}") * F.col(f"m{j}")) + (floors[i] ** 2 if i == j else 0.0)
    for (i, j), x in _cholesky(cov).items():
        out = out.withColumn(f"l{i}{j}", x)
    return out.withColumn("logdet", 2 * sum((F.log(f"l{i}{i}") for i in range(1, _P)), F.log("l00")))


def _distance(of=F.col) -> Column:
    """Squared Mahalanobis distance by forward substitution; of(name) is a part of the estimate."""
    ys: list[Column] = []
    for i, f in enumerate(FEATURES):
        y = F.col(f) - of(f"m{i}")
        for k in range(i):
            y = y - of(f"l{i}{k}") * ys[k]
        ys.append(y / of(f"l{i}{i}"))
    return sum((y * y for y in ys[1:]), ys[0] * ys[0])


def _moments() -> list[Column]:
    f = list(FEATURES)
    return [F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(f)], *[F.sum(F.col(f[i]) * F.col(f[j])).alias(f"q{i}{j}") for i, j in _PAIRS]]


def _starts(used: DataFrame) -> DataFrame:
    """(grp, start, estimate): medians with the target's spreads, medians with half the range of the middle half, means with the covariance of all, and those of PARTS parts."""
    spread = list(FEATURES.values())
    quart = used.groupBy("grp").agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"p{i}") for i, c in enumerate(FEATURES)])
    middle = [F.get(f"p{i}", F.lit(1)).alias(f"m{i}") for i in range(_P)]
    diagonal = lambda of: [(of(i) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in _PAIRS]
    half = lambda i: 0.7413 * (F.get(f"p{i}", F.lit(2)) - F.get(f"p{i}", F.lit(0)))
    plain = quart.select("grp", F.lit(0).alias("start"), *middle, *diagonal(lambda i: F.lit(float(spread[i]))))
    ranged = quart.select("grp", F.lit(1).alias("start"), *middle, *diagonal(lambda i: F.sqrt(half(i) * half(i) + spread[i] ** 2)))
    parts = cut(used.groupBy("grp", F.pmod(F.xxhash64(*FEATURES), F.lit(PARTS)).cast("int").alias("part")).agg(*_moments()))
    of_parts = _factored(parts, 1.0).select("grp", (3 + F.col("part")).alias("start"), *_ESTIMATE)
    whole = _factored(parts.groupBy("grp").agg(*[F.sum(c).alias(c) for c in _SUMS]), 1.0).select("grp", F.lit(2).alias("start"), *_ESTIMATE)
    return plain.union(ranged).union(whole).union(of_parts)


def _halves(used: DataFrame, now: DataFrame) -> DataFrame:
    """(grp, start, was, sums): the sums over the nearest SHARE of each group's rows by each of its estimates, and the determinants of these.

    Rows are binned by distance, an eighth of an octave wide, and a group's bins are summed from the nearest on. Of the bin in which SHARE is
    reached, every row counts with the same weight, such that just SHARE of the group's weight is taken. Binned sums are all that is
    shuffled, some 400 rows a group and start from each task.
    """
    d = used.join(now, "grp").withColumn("e", F.explode("e"))
    of = lambda c: F.col(f"e.{c}")
    binned = d.select("grp", of("start").alias("start"), *FEATURES, of("logdet").alias("was"), F.floor(8 * F.log2(_distance(of) + 2.0**-20)).cast("int").alias("bin")).groupBy("grp", "start", "bin").agg(F.first("was").alias("was"), *_moments())
    own = W.partitionBy("grp", "start")
    before = F.coalesce(F.sum("n").over(own.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    room = SHARE * F.sum("n").over(own) - before
    weight = F.least(F.lit(1.0), F.col("room") / F.col("n"))
    return binned.withColumn("room", room).where("room > 0").groupBy("grp", "start").agg(F.first("was").alias("was"), *[F.sum(F.col(c) * weight).alias(c) for c in _SUMS])


def robust_estimates(used: DataFrame) -> DataFrame:
    """rows (grp and the features) -> grp, its location m_i, the factor l_ij of its scatter, and the logarithm of the least determinant found.

    Minimum covariance determinants: from several starts, concentration steps take the nearest half of a group by the last
    estimate, of which each step can only lower the determinant, until none falls any more. The start with the least determinant
    wins, ties to the first; rows within INNER of it give the final estimate. Sums are of whole thousandths. Groups of any size work.
    """
    state = cut(_starts(used).withColumn("logdet", F.lit(None).cast("double")))
    small = state.select("grp").distinct().count() <= BROADCAST_GROUPS
    hint = F.broadcast if small else (lambda x: x)
    packed = lambda st: hint(st.groupBy("grp").agg(F.collect_list(F.struct("start", "logdet", *_ESTIMATE)).alias("e")))
    live, done = state, None
    for _ in range(STEPS):
        new = cut(_factored(_halves(used, packed(live)), CONSISTENT).select("grp", "start", *_ESTIMATE, "logdet", "was"))
        over = F.coalesce(F.col("logdet") >= F.col("was") + F.log(F.lit(1 - SETTLED)), F.lit(False))
        ended = new.where(over).drop("was")
        done = ended if done is None else done.union(ended)
        live = new.where(~over).drop("was")
        if live.isEmpty():
            break
    last = done.union(live)
    best = cut(last.groupBy("grp").agg(F.min(F.struct("logdet", "start", *_ESTIMATE)).alias("b")).select("grp", *[F.col(f"b.{c}").alias(c) for c in [*_ESTIMATE, "logdet"]]))
    inner = used.join(hint(best), "grp").where(_distance() <= INNER).groupBy("grp").agg(*_moments())
    final = _factored(inner, INNER_CONSISTENT).select("grp", *_ESTIMATE)
    return final.join(best.select("grp", "logdet"), "grp")


def outliers(rows: DataFrame, keep: Column) -> DataFrame:
    """rows (grp and the features) -> with distance, from its group's location and scatter. Only rows with keep count for these."""
    now = cut(robust_estimates(rows.where(keep)))
    hint = F.broadcast if now.count() <= BROADCAST_GROUPS else (lambda x: x)
    # A group without rows to estimate from rejects none.
    return rows.join(hint(now), "grp", "left").withColumn("distance", F.coalesce(_distance(), F.lit(0.0))).drop(*[c for c in now.columns if c != "grp"])


def quality_rules(docs: DataFrame) -> DataFrame:
    """docs (id, text, lang, source) -> id, the base statistics, base_failed, distance, kept.

    kept: the base rules hold, and the document's transformed statistics are no outlier among those of its language and
    source. Null and empty texts fail for want of words. Null lang or source is a value of its own. Repeated rows count
    each; equal distances share a weight where only some of them fit into a half. Very long texts are taken whole. Only id, text, lang and
    source are read, so other columns can have any name. Empty input: no rows.
    """
    stats = statistics(F.col("text"))
    grp = F.concat(*[x for c in ("lang", "source") for x in (F.when(F.col(c).isNull(), "-").otherwise("+"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\u0001"))])
    rows = docs.select("id", grp.alias("grp"), *[v.alias(k) for k, v in stats.items()])
    rows = rows.select("*", base_failed().alias("base_failed"))
    rows = cut(rows.select("*", *_features()))
    out = outliers(rows, ~F.col("base_failed"))
    return out.select("id", *stats, "base_failed", "distance", (~F.col("base_failed") & (F.col("distance") <= CUTOFF)).alias("kept"))


def op3_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdicts of all documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    return quality_rules(docs).select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
