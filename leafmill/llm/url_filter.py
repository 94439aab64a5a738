"""URL filters: character language-model ratio, with DataFrame functions only.

Rules (host and path prefix) judge the URLs they fit; the longest rule wins. The URLs so accepted and
rejected train two smoothed variable-order Markov models over a small alphabet; all other URLs are
judged by the calibrated, length-normalised log-likelihood difference of the two.

Contexts of two characters back off to one and to none by interpolation, with a weight that grows with
the number of different characters seen after a context (Witten-Bell). The two models become one dense
table of ``ALPHABET ** 3`` log ratios. Its size is fixed (about 1 MB), so it travels as one value, and
scoring a URL is a fold inside its row, without a join. The threshold has the least balanced error on the
judged URLs that took no part in the counts (a quarter of them, by hash of the URL).

Cases: a null URL or one without ``://`` has an empty host and path and no rule, and its text (null:
empty) is scored; a URL with an empty path fits no rule whose path is ``/``; without accepted or without
rejected examples every score is 0 and the verdict is allow; repeated rows are judged row by row; of rules of
one length the later in the list wins; an empty table gives an empty result; URLs of any length are read whole;
columns other than the id and the URL are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.session import cut


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = (
    UrlRule("allow", "org", "/"), UrlRule("block", "example.org", "/es/"), UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"), UrlRule("block", "com", "/de/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The models' alphabet: number 0 is the edge of a URL, 1 any other character ("!"), then these.
SYMBOLS = "!" + _LOWER + "0123456789" + "/.-_:?=&#%+~@"
ALPHABET = len(SYMBOLS) + 1
CALIBRATION_FOLDS = 4
BINS, LEAST, MOST = 512, -4.0, 4.0


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def with_runs(urls: DataFrame) -> DataFrame:
    """The rows with ``runs``: numbers of all runs of three symbols of ``url``, edges included."""
    plain = F.regexp_replace(F.translate(F.coalesce("url", F.lit("")), _UPPER, _LOWER), "(?s)[^a-z0-9/._:?=&#%+~@-]", "!")
    numbers = F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.call_function("instr", F.lit(SYMBOLS), c))
    coded = urls.withColumn("code", F.concat(F.array(F.lit(0), F.lit(0)), numbers, F.array(F.lit(0))))
    code = F.col("code")
    runs = F.transform(F.sequence(F.lit(2), F.size(code) - 1), lambda k: (F.get(code, k - 2) * ALPHABET + F.get(code, k - 1)) * ALPHABET + F.get(code, k))
    return coded.withColumn("runs", runs).drop("code")


def model_table(runs: DataFrame) -> DataFrame:
    """All ``ALPHABET ** 3`` runs of three symbols with the log ratio of their two probabilities.

    ``runs`` has accepted (bigint, 1 or 0), run and n: how often a run stands in the examples of a class.
    """
    grid = runs.sparkSession.range(ALPHABET**3).select(F.col("id").alias("run"))
    return runs.sparkSession.sql(
        """
        WITH one AS (SELECT accepted, run % {a} AS x, sum(n) AS n1 FROM {runs} GROUP BY accepted, run % {a}),
        two AS (SELECT accepted, run % ({a} * {a}) AS bx, sum(n) AS n2 FROM {runs} GROUP BY accepted, run % ({a} * {a})),
        every AS (SELECT accepted, sum(n) AS n0 FROM {runs} GROUP BY accepted),
        after_b AS (SELECT accepted, bx div {a} AS b, sum(n2) AS nb, count(*) AS tb FROM two GROUP BY accepted, bx div {a}),
        after_ab AS (SELECT accepted, run div {a} AS ab, sum(n) AS nab, count(*) AS tab FROM {runs} GROUP BY accepted, run div {a}),
        cells AS (SELECT run, run % {a} AS x, run % ({a} * {a}) AS bx, (run % ({a} * {a})) div {a} AS b, run div {a} AS ab, accepted
                  FROM {grid} LATERAL VIEW explode(array(0L, 1L)) AS accepted),
        shorter AS (
            SELECT cells.*, (coalesce(n1, 0) + 1) / (coalesce(n0, 0) + {a}) AS p1, coalesce(n2, 0) AS n2, coalesce(nb, 0) AS nb, coalesce(tb, 0) AS tb
            FROM cells LEFT JOIN one USING (accepted, x) LEFT JOIN two USING (accepted, bx) LEFT JOIN after_b USING (accepted, b) LEFT JOIN every USING (accepted)
        ), middle AS (SELECT *, CASE WHEN nb = 0 THEN p1 ELSE (n2 + tb * p1) / (nb + tb) END AS p2 FROM shorter),
        longest AS (
            SELECT run, accepted, CASE WHEN coalesce(nab, 0) = 0 THEN p2 ELSE (coalesce(n, 0) + tab * p2) / (nab + tab) END AS p3
            FROM middle LEFT JOIN after_ab USING (accepted, ab) LEFT JOIN {runs} USING (accepted, run)
        )
        SELECT run, sum(CASE WHEN accepted = 1 THEN ln(p3) ELSE -ln(p3) END) AS ratio FROM longest GROUP BY run
        """,
        a=ALPHABET, runs=runs, grid=grid,
    )


def train(judged: DataFrame) -> DataFrame:
    """One row with ``model``: the array of log ratios by run. ``judged`` has url and verdict (allow or block).

    Without examples of both classes all ratios are 0.
    """
    each = with_runs(judged.where(F.col("verdict").isNotNull())).select(F.when(F.col("verdict") == "allow", 1).otherwise(0).cast("long").alias("accepted"), F.explode("runs").alias("run"))
    runs = cut(each.groupBy("accepted", F.col("run").cast("long").alias("run")).agg(F.count("*").alias("n")))  # at most 2 * ALPHABET ** 3 rows
    both = runs.select("accepted").distinct().count() == 2
    ratio = F.col("ratio") if both else F.lit(0.0)
    ordered = F.array_sort(F.collect_list(F.struct("run", ratio.alias("ratio"))))
    return model_table(runs).agg(F.transform(ordered, lambda x: x["ratio"]).alias("model"))


def score(urls: DataFrame, model: DataFrame) -> DataFrame:
    """The rows with ``llr``: the mean log ratio over the runs of ``url``."""
    # runs and model are referred to once each, so the optimiser folds them into the sum and no row carries the model
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"))
    mean = F.aggregate(
        "runs", start, lambda so_far, run: F.struct((so_far["total"] + F.get(F.col("model"), run)).alias("total"), (so_far["n"] + 1).alias("n")), lambda x: x["total"] / x["n"]
    )
    return with_runs(urls).withColumn("model", model.scalar()).withColumn("llr", mean).drop("runs", "model")


def calibrate(scored: DataFrame) -> DataFrame:
    """One row with ``threshold``: the bin edge of least balanced error over rows with llr and verdict.

    Ties go to the edge nearest to 0; 0 where a class has no row.
    """
    place = F.floor((F.least(F.greatest("llr", F.lit(LEAST)), F.lit(MOST)) - LEAST) / ((MOST - LEAST) / BINS)).cast("long")
    bins = scored.where(F.col("verdict").isNotNull()).groupBy(place.alias("bin")).agg(F.sum((F.col("verdict") == "allow").cast("long")).alias("good"), F.sum((F.col("verdict") == "block").cast("long")).alias("bad"))
    rows = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most BINS + 1 rows
    whole = Window.partitionBy(F.lit(1))
    edges = bins.select(
        (F.col("bin") * ((MOST - LEAST) / BINS) + LEAST).alias("edge"), F.sum("good").over(whole).alias("all_good"), F.sum("bad").over(whole).alias("all_bad"),
        F.coalesce(F.sum("good").over(rows), F.lit(0)).alias("lost"), F.coalesce(F.sum("bad").over(rows), F.lit(0)).alias("caught"),
    )
    judged = edges.where("all_good > 0 and all_bad > 0").withColumn("error", F.col("lost") / F.col("all_good") + 1 - F.col("caught") / F.col("all_bad"))
    return judged.agg(F.coalesce(F.min_by("edge", F.struct(F.round("error", 9), F.abs("edge"), "edge")), F.lit(0.0)).alias("threshold"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """One row per input row: the id, host, path, rule, verdict and llr."""
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = split_url(F.col("url"))
    split = urls.withColumn("host", host).withColumn("path", path)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    split = split.withColumn("rule", rule).withColumn("verdict", verdict)
    left_out = F.pmod(F.crc32(F.coalesce("url", F.lit(""))), F.lit(CALIBRATION_FOLDS)) == 0
    model = cut(train(split.where(~left_out)))
    threshold = cut(calibrate(score(split.where(left_out), model)))
    scored = score(split, model)
    by_method = F.when(F.col("llr") >= threshold.scalar(), "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_method).alias("verdict"), F.round("llr", 6).alias("llr"))
