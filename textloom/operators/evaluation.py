"""Page fidelity, calibration error, refusals, and the grid search for a better calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.hashing import shuffled
from textloom.operators.ranking import CENTER, SLOPE, THRESHOLD, confidence

# Questions that no document answers.
PROBES = (
    "Qual e a capital de Marte no ano de 3020?",
    "Explique a receita de bolo de cenoura com cobertura quantica intergalactica.",
    "Quem venceu a copa do mundo de 2150?",
)
CLAMP = 20.0


def probes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(-k - 1, p) for k, p in enumerate(PROBES)], "q_id long, question string")


def sample_size(n: int, share: float, most: int | None = None) -> int:
    k = min(n, max(1, int(n * share + 0.5)))
    return min(k, most) if most else k


def sample_by_hash(questions: DataFrame, share: float, seed: int = 42, most: int | None = None) -> DataFrame:
    """A fixed sample: the rows with the smallest hashes of seed and id."""
    n = questions.count()
    return questions.withColumn("h", F.md5(F.concat(F.lit(f"{seed}/"), F.col("q_id").cast("string")))).orderBy("h").limit(sample_size(n, share, most) if n else 0).drop("h")


def numbered(rows: DataFrame, key: str, name: str, ranges: int = 128) -> DataFrame:
    """Rows with their number from 0 in the order of an integer key: places in ranges of it, plus the rows of the ranges before."""
    bounds = rows.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)])).first()[0] or []
    bounds = sorted(set(bounds))
    part = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < F.col(key))) if bounds else F.lit(0)
    rows = rows.withColumn("part", part)
    sizes = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}  # at most `ranges` rows
    before = [sum(n for p, n in sizes.items() if p < k) for k in range(len(bounds) + 1)]
    place = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    return rows.withColumn(name, place + F.element_at(F.array(*[F.lit(n).cast("long") for n in before]), F.col("part") + 1)).drop("part")


def sample_by_shuffle(questions: DataFrame, share: float, seed: int = 42, most: int | None = None, parity: int = 1_000_000) -> DataFrame:
    """The sample that an exchange shuffle of the question list takes, and each row's place in it (nth).

    The shuffle is a chain of swaps, made on the driver; above ``parity`` questions rows are drawn in the order
    of a keyed hash of their id instead: as many of them, as uniformly, but other ones.
    """
    n = questions.count()
    k = sample_size(n, share, most) if n else 0
    if n > parity:
        return numbered(questions.withColumn("h", F.xxhash64(F.lit(seed), "q_id")), "h", "nth").where(F.col("nth") < k).drop("h")
    where = questions.sparkSession.createDataFrame([(p, i) for i, p in enumerate(shuffled(n, seed)[:k])], "place long, nth long")
    return numbered(questions, "q_id", "place").join(F.broadcast(where), "place").drop("place")


def outcomes(decisions: DataFrame, questions: DataFrame) -> DataFrame:
    """Decisions with the question's type and page, and whether they hit."""
    rows = decisions.select("q_id", "score", "confidence", "page", "refused").join(questions.select("q_id", "type", F.col("page").alias("expected")), "q_id")
    return rows.withColumn("hit", (~F.col("refused") & (F.col("page") == F.col("expected"))).cast("int"))


def bin_of(conf: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(4), F.floor(conf * 5))).cast("int")


def ece_bins(rows: DataFrame) -> DataFrame:
    return rows.groupBy(bin_of(F.col("confidence")).alias("bin")).agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg("confidence").alias("mean_confidence"))


def ece(bins: DataFrame) -> DataFrame:
    return bins.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))) / F.sum("n"), F.lit(0.0)).alias("ece"))


def report(rows: DataFrame) -> DataFrame:
    n, hit = F.count("*"), F.sum("hit")
    return rows.agg(
        n.alias("n"), hit.alias("hits"), F.avg("hit").alias("fidelity"), F.avg("confidence").alias("mean_confidence"),
        F.abs(F.avg("confidence") - F.avg("hit")).alias("gap"), F.sum(F.col("refused").cast("int")).alias("refused_in_scope"),
    )


def by_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))


def confusion(points: DataFrame, center: float = CENTER, slope: float = SLOPE, threshold: float = THRESHOLD) -> DataFrame:
    """points (score, y) -> tpr, tnr, balanced, gap at one calibration; an empty class counts as 1."""
    c = confidence(F.col("score"), center, slope, CLAMP)
    return _rates(points.withColumn("conf", c).withColumn("yes", (c >= threshold).cast("int")).groupBy())


def _rates(groups) -> DataFrame:
    pos, neg = F.sum("y"), F.sum(1 - F.col("y"))
    tpr = F.when(pos > 0, F.sum(F.col("yes") * F.col("y")) / pos).otherwise(1.0)
    tnr = F.when(neg > 0, F.sum((1 - F.col("yes")) * (1 - F.col("y"))) / neg).otherwise(1.0)
    # the gap compares mean confidence with the share of points that are decided rightly
    right = F.avg(F.when(F.col("yes") == F.col("y"), 1.0).otherwise(0.0))
    rows = groups.agg(tpr.alias("tpr"), tnr.alias("tnr"), F.avg("conf").alias("mc"), right.alias("acc"))
    return rows.select(*[c for c in rows.columns if c not in ("tpr", "tnr", "mc", "acc")], "tpr", "tnr", ((F.col("tpr") + F.col("tnr")) / 2).alias("balanced"), F.abs(F.col("mc") - F.col("acc")).alias("gap"))


def grid(spark: SparkSession) -> DataFrame:
    """12 centers, 14 slopes and 81 thresholds."""
    ids = spark.range(12 * 14 * 81).select(F.expr("cast(id div 1134 as int)").alias("ci"), F.expr("cast(id div 81 % 14 as int)").alias("si"), F.expr("cast(id % 81 as int)").alias("li"))
    return ids.select("ci", "si", "li", (F.lit(0.05) + 0.05 * F.col("ci")).alias("center"), (4.0 + 2.0 * F.col("si")).alias("slope"), (F.lit(0.10) + 0.01 * F.col("li")).alias("threshold"))


def calibrate(points: DataFrame, recall: DataFrame | None = None) -> DataFrame:
    """The grid point of the best balanced accuracy (with gold: averaged with recall), ties to the smaller gap, then the first.

    Every pair of center and slope meets every point once: thresholds are compared with sums over sorted
    confidences' bins, not by another product of points and thresholds.
    """
    spark = points.sparkSession
    pairs = F.broadcast(grid(spark).where("li = 0").select("ci", "si", "center", "slope"))  # 168 rows
    conf = points.crossJoin(pairs).withColumn("conf", confidence(F.col("score"), F.col("center"), F.col("slope"), CLAMP))
    # threshold 0.10 + 0.01 li passes conf >= threshold: the largest such li for each point
    steps = F.expr("aggregate(sequence(0, 80), -1, (m, l) -> if(conf >= 0.10D + 0.01D * l, l, m))")
    cells = conf.withColumn("top", steps).groupBy("ci", "si", "center", "slope", "top").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"), F.sum("conf").alias("c"))
    hist = cells.groupBy("ci", "si", "center", "slope").agg(F.sum("pos").alias("n1"), F.sum("neg").alias("n0"), F.sum("c").alias("c"), F.collect_list(F.struct("top", "pos", "neg")).alias("h"))
    rows = hist.withColumn("li", F.explode(F.sequence(F.lit(0), F.lit(80)))).withColumn("threshold", F.lit(0.10) + 0.01 * F.col("li"))
    yes1 = F.expr("aggregate(filter(h, x -> x.top >= li), 0L, (s, x) -> s + x.pos)")
    yes0 = F.expr("aggregate(filter(h, x -> x.top >= li), 0L, (s, x) -> s + x.neg)")
    rows = rows.withColumn("yes1", yes1).withColumn("yes0", yes0)
    tpr = F.when(F.col("n1") > 0, F.col("yes1") / F.col("n1")).otherwise(1.0)
    tnr = F.when(F.col("n0") > 0, (F.col("n0") - F.col("yes0")) / F.col("n0")).otherwise(1.0)
    total = F.col("n1") + F.col("n0")
    gap = F.abs(F.col("c") / total - (F.col("yes1") + F.col("n0") - F.col("yes0")) / total)
    rows = rows.withColumn("tpr", tpr).withColumn("tnr", tnr).withColumn("balanced", (F.col("tpr") + F.col("tnr")) / 2).withColumn("gap", gap)
    goal = F.col("balanced")
    if recall is not None:
        rows = rows.join(recall, ["ci", "si", "li"])
        goal = (F.col("balanced") + F.col("recall")) / 2
    best = rows.withColumn("objective", goal).orderBy(F.desc(F.round("objective", 9)), F.round("gap", 9), "ci", "si", "li").limit(1)
    return best.select(*[F.round(c, 6).alias(c) for c in ("center", "slope", "threshold", "tpr", "tnr", "balanced", "gap")])


def gold_recall_grid(scored: DataFrame) -> DataFrame:
    """scored (score, page1, page2, expected) -> (ci, si, li, recall): answered, and the page among the first two or unknown."""
    ok = (F.col("expected") < 0) | (F.col("page1") == F.col("expected")) | (F.col("page2") == F.col("expected"))
    rows = scored.crossJoin(F.broadcast(grid(scored.sparkSession)))
    hit = ok & (confidence(F.col("score"), F.col("center"), F.col("slope"), CLAMP) >= F.col("threshold"))
    return rows.groupBy("ci", "si", "li").agg(F.avg(F.coalesce(hit, F.lit(False)).cast("int")).alias("recall"))


def threshold_sweep(rows: DataFrame, thresholds: tuple[float, ...] = (0.30, 0.50, 0.70, 0.85, 0.89)) -> DataFrame:
    """How many are answered, ranked rightly, both, and refused though ranked rightly, at each threshold."""
    at = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    put = rows.select("confidence", (F.col("page") == F.col("expected")).alias("ok"), at)
    answered = F.col("confidence") >= F.col("threshold")
    count = lambda c: F.sum(c.cast("int"))
    return put.groupBy("threshold").agg(
        count(answered).alias("responded"), count(F.col("ok")).alias("rank_ok"), count(answered & F.col("ok")).alias("both_ok"), count(~answered & F.col("ok")).alias("refused_rank_ok")
    )
