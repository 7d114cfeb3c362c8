"""Operator 4 [native]: quality rules as robust multivariate outliers.

Five statistics of a text, transformed so that they are roughly symmetric and those of short
texts are not noisier than those of long ones, form a vector. For every language and source a
minimum-covariance-determinant estimate is made of these vectors: from several starts (medians
and median absolute deviations, all rows, subsets drawn by a hash), repeat: keep the ``SUPPORT``
share of the cell's vectors nearest to the centre, take their mean and covariance. The result of
the least determinant counts. A text whose Mahalanobis distance exceeds ``CUTOFF`` is rejected.

A cell with few usable texts is judged by the estimate of its language, or of all rows, which
rests on all usable rows there, those of large cells too.

Everything is DataFrame functions. A step is two aggregations by cell with partial sums and
sketches of quantiles, so a source with a third of all rows is no hot group; what is joined back
is one row for each cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

WORD, SPACES = r"[^\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Share of a cell that the estimate rests on, and the factor that makes the covariance of that
#: part of a five-dimensional normal distribution that of the whole: .75 / P(chi2_7 <= 6.626).
SUPPORT, CONSISTENCY = 0.75, 1.41
#: Squared distance beyond which a vector is an outlier: the 0.99999 quantile of chi2 with 5 degrees.
CUTOFF = 30.86
#: Cells below this many usable texts borrow the estimate of their language, then of all rows.
LEAST_CELL = 50
#: Words of typical text added to a text's own before ratios are taken.
PRIOR_WORDS = 50
#: Least standard deviation of each statistic; many are 0 for nearly all texts.
FLOORS = (0.3, 0.15, 0.1, 0.25, 0.15)
#: Concentration steps from each start, and the share (one in so many) of a cell's rows that a drawn start rests on.
STEPS, DRAWN = 4, 4
_P = len(FLOORS)
_POSITION_BITS = 24


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where lambdas inside use it."""
    return F.transform(F.array(value), body)[0]


def _covered(words: Column) -> Column:
    """Words in 5-word windows that occur twice or more among ``words``, an array of at least five.

    Hashes of the windows are sorted together with their positions; windows whose hash has an
    equal neighbour are compared by their words.
    """
    w = WINDOW

    def keyed(h: Column) -> Column:
        gram = lambda i: F.xxhash64(*(h[i + j] for j in range(w)))
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(h) - w), lambda i: F.shiftleft(F.shiftright(gram(i), _POSITION_BITS), _POSITION_BITS) + i))

    def suspects(s: Column) -> Column:
        top = lambda x: F.shiftright(x, _POSITION_BITS)
        twin = lambda x, i: F.coalesce(top(x) == top(F.get(s, i - 1)), F.lit(False)) | F.coalesce(top(x) == top(F.get(s, i + 1)), F.lit(False))
        at = F.transform(s, lambda x, i: F.when(twin(x, i), x.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).cast("int")))
        return F.filter(at, lambda p: p.isNotNull())

    def repeated(grams: Column) -> Column:
        same = lambda x, i: F.coalesce(x["g"] == F.get(grams, i - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get(grams, i + 1)["g"], F.lit(False))
        return F.sort_array(F.filter(F.transform(grams, lambda x, i: F.when(same(x, i), x["p"])), lambda p: p.isNotNull()))

    def length(q: Column) -> Column:
        part = F.transform(q, lambda p, i: F.least(F.lit(w), F.coalesce(F.get(q, i + 1) - p, F.lit(w))))
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def exact(at: Column) -> Column:
        grams = F.sort_array(F.transform(at, lambda p: F.struct(F.array_join(F.slice(words, p + 1, w), " ").alias("g"), p.alias("p"))))
        return F.when(F.size(at) == 0, F.lit(0)).otherwise(let(let(grams, repeated), length))

    return let(let(let(F.transform(words, lambda x: F.xxhash64(x)), keyed), suspects), exact)


def statistics(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, lang, source)`` -> ids, ``lang``, ``source`` and the counts of each text.

    A null text counts as empty. A text of 2^24 words and more is an error: its
    positions cannot be packed.
    """
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD))
    base = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), t.alias("t"))
    too_long = F.raise_error(F.lit("a text has 2^24 words or more")).cast("int")
    words = F.split(F.btrim("t", F.lit(SPACES)), r"[\x20\x09-\x0D]+", -1)
    counted = base.select(
        "doc_id", "lang", "source", F.regexp_count("t", F.lit(WORD)).cast("long").alias("n_words"),
        F.char_length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(words, lambda x: F.when(F.size(x) < WINDOW, F.lit(0)).when(F.size(x) >= 1 << _POSITION_BITS, too_long).otherwise(_covered(x))).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _vector() -> list[Column]:
    n, k = F.col("n_words").cast("double"), F.lit(float(PRIOR_WORDS))
    return [
        F.log1p(n),
        (F.col("word_chars") + k * F.col("typical")) / (n + k),
        F.log1p(F.col("n_symbols") / (n + k)),
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.sqrt(F.col("n_repeat_words") / (n + k)),
    ]


def _with_cells(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``stats`` with ``cell`` and ``typical``, and the rows that estimates rest on.

    A row's ``cell`` is its language and source, or only the language, or neither, by the number
    of usable texts. The second table has every usable row once for each cell that it belongs to
    and by which some row is judged.
    """
    usable = stats.where("not base_failed")
    typical = F.percentile_approx(F.col("word_chars") / F.col("n_words"), 0.5)
    by_source = usable.groupBy("lang", "source").agg(F.count("*").alias("n_source"), typical.alias("typical_2"))
    by_lang = usable.groupBy("lang").agg(F.count("*").alias("n_lang"), typical.alias("typical_1"))
    level = F.when(F.col("n_source") >= LEAST_CELL, F.lit(2)).when(F.col("n_lang") >= LEAST_CELL, F.lit(1)).otherwise(F.lit(0))
    sizes = materialize(by_source.join(by_lang, "lang").crossJoin(usable.agg(typical.alias("typical_0"))).withColumn("level", level))
    lent = sizes.groupBy("lang").agg(F.max(F.col("level") == 1).alias("lent_1"))
    lent_0 = not sizes.where("level = 0").isEmpty()
    sizes = materialize(sizes.join(lent, "lang"))

    def cell(i: int, used: Column) -> Column:
        at = F.struct(F.lit(i).alias("level"), (F.col("lang") if i else F.lit("")).alias("lang"), (F.col("source") if i == 2 else F.lit("")).alias("source"))
        return F.struct(at.alias("cell"), F.col(f"typical_{i}").alias("typical"), used.alias("used"))

    cells = sizes.select("lang", "source", F.filter(F.array(*(cell(i, F.col("level") == i) for i in range(3))), lambda x: x["used"])[0].alias("at"))
    judged = stats.join(cells, ["lang", "source"], "left").select(*stats.columns, "at.cell", "at.typical")
    lenders = sizes.select("lang", "source", F.filter(F.array(cell(2, F.col("level") == 2), cell(1, F.col("lent_1")), cell(0, F.lit(lent_0))), lambda x: x["used"]).alias("at"))
    members = usable.join(lenders, ["lang", "source"]).withColumn("at", F.explode("at")).select(*stats.columns, "at.cell", "at.typical")
    return judged, members


def _inverse_factor(moments: DataFrame) -> DataFrame:
    """Rows of mean ``m`` and covariance ``c_i_j`` -> ``m`` and the inverse of the Cholesky factor, ``k_i_j``."""
    for i in range(_P):
        for j in range(i + 1):
            rest = F.col(f"c_{i}_{j}") - sum((F.col(f"l_{i}_{q}") * F.col(f"l_{j}_{q}") for q in range(j)), F.lit(0.0))
            moments = moments.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{j}_{j}"))
    for i in range(_P):
        for j in range(i + 1):
            if i == j:
                moments = moments.withColumn(f"k_{i}_{j}", 1 / F.col(f"l_{i}_{i}"))
            else:
                rest = sum((F.col(f"l_{i}_{q}") * F.col(f"k_{q}_{j}") for q in range(j, i)), F.lit(0.0))
                moments = moments.withColumn(f"k_{i}_{j}", -rest / F.col(f"l_{i}_{i}"))
    logs = sum((F.log(f"l_{i}_{i}") for i in range(_P)), F.lit(0.0)).alias("log_det")
    return moments.select("cell", *(f"m_{i}" for i in range(_P)), *(f"k_{i}_{j}" for i in range(_P) for j in range(i + 1)), logs)


def _distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance; null where the cell has no estimate."""
    joined = rows.join(estimate, "cell", "left")
    parts = [sum((F.col(f"k_{i}_{j}") * (F.col(f"x_{j}") - F.col(f"m_{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(_P)]
    return joined.withColumn("d2", sum((p * p for p in parts), F.lit(0.0))).select(*rows.columns, "d2")


def _moments(rows: DataFrame) -> DataFrame:
    """Mean and covariance of each cell, the latter scaled as for the central rows of a normal sample."""
    return rows.groupBy("cell").agg(
        *(F.avg(f"x_{i}").alias(f"m_{i}") for i in range(_P)),
        *((F.coalesce(F.covar_pop(f"x_{i}", f"x_{j}"), F.lit(0.0)) * CONSISTENCY + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i in range(_P) for j in range(i + 1)),
    )


def _starts(rows: DataFrame) -> list[DataFrame]:
    """First estimates: medians and absolute deviations from them; all rows; and two subsets drawn by a hash of the row."""
    middle = materialize(rows.groupBy("cell").agg(*(F.percentile_approx(f"x_{i}", 0.5).alias(f"m_{i}") for i in range(_P))))
    spread = rows.join(middle, "cell").groupBy("cell").agg(*(F.percentile_approx(F.abs(F.col(f"x_{i}") - F.col(f"m_{i}")), 0.5).alias(f"s_{i}") for i in range(_P)), *(F.first(f"m_{i}").alias(f"m_{i}") for i in range(_P)))
    scale = lambda i: F.greatest(1.4826 * F.col(f"s_{i}"), F.lit(FLOORS[i]))
    robust = spread.select("cell", *(f"m_{i}" for i in range(_P)), *((1 / scale(i) if i == j else F.lit(0.0)).alias(f"k_{i}_{j}") for i in range(_P) for j in range(i + 1)))
    drawn = F.pmod(F.xxhash64(*(f"x_{i}" for i in range(_P))), F.lit(DRAWN))
    return [robust, *(_inverse_factor(materialize(_moments(x))) for x in (rows, rows.where(drawn == 0), rows.where(drawn == 1)))]


def estimate_cells(rows: DataFrame) -> DataFrame:
    """MCD estimate of each ``cell`` over ``x_0`` .. ``x_4``: location ``m_i`` and factor ``k_i_j``.

    From every start ``STEPS`` concentration steps are made, each an estimate of the central
    ``SUPPORT`` of the rows by the last one; the result of the least determinant is taken.
    """
    starts = _starts(rows)
    numbered = lambda df, i: df.withColumn("cell", F.struct("cell", i.alias("start")))
    estimate = None
    for i, start in enumerate(starts):
        start = numbered(start.select("cell", *(f"m_{i}" for i in range(_P)), *(f"k_{i}_{j}" for i in range(_P) for j in range(i + 1))), F.lit(i))
        estimate = start if estimate is None else estimate.unionByName(start)
    estimate = materialize(estimate)
    tried = numbered(rows.withColumn("_start", F.explode(F.sequence(F.lit(0), F.lit(len(starts) - 1)))), F.col("_start")).drop("_start")
    for _ in range(STEPS):
        near = _distance(tried, estimate)
        reach = near.groupBy("cell").agg(F.percentile_approx("d2", SUPPORT, F.lit(1000)).alias("reach"))
        estimate = materialize(_inverse_factor(materialize(_moments(near.join(reach, "cell").where("d2 <= reach")))))
    columns = [c for c in estimate.columns if c not in ("cell", "log_det")]
    best = estimate.groupBy("cell.cell").agg(F.min_by(F.struct(*columns), "log_det").alias("best"))
    return materialize(best.select("cell", "best.*"))


def judge(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, lang, source)`` -> counts, ``base_failed``, ``kept`` and ``distance``.

    One row per input row, further columns ignored. Null languages and sources are cells of
    their own (as empty strings). A text that fails the base rules is never kept and shapes no
    estimate; one whose cell has no estimate is kept by the base rules alone.
    """
    stats = materialize(statistics(docs))
    cells, members = _with_cells(stats)
    vector = [x.alias(f"x_{i}") for i, x in enumerate(_vector())]
    rows = cells.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cell", *vector)
    judged = _distance(rows, estimate_cells(materialize(members.select("cell", *vector))))
    kept = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= CUTOFF)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.sqrt("d2").alias("distance"))
