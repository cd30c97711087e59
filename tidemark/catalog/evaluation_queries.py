"""Real-against-synthetic metrics."""

from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.catalog.clinical import CODED_SQL, static_features
from tidemark.catalog.descriptive import _corr_sql
from tidemark.catalog.preparation import u_sql
from tidemark.catalog.registry import query, r, rounded, table
from tidemark.catalog.series_queries import SEQ_SQL, hourly, sequences
from tidemark.catalog.statistics import LINE_COLS, halves
from tidemark.operators import fidelity, plausibility, privacy, temporal, utility
from tidemark.operators.bayes import fit_network
from tidemark.operators.neighbors import nearest_distances
from tidemark.operators.prep import apply_minmax, fit_minmax
from tidemark.plans import evaluation
from tidemark.session import cut_lineage


@query(
    "corr_frobenius",
    f"""SELECT {r("sqrt(SUM((a.r - b.r) ** 2))")} AS frobenius_distance FROM ({_corr_sql("lineitem", LINE_COLS, "l_linestatus = 'O'")}) a
    JOIN ({_corr_sql("lineitem", LINE_COLS, "l_linestatus = 'F'")}) b ON a.a = b.a AND a.b = b.b""",
)
def corr_frobenius(spark, folder):
    real, synth = halves(spark, folder)
    return rounded(fidelity.correlation_distance(real, synth, LINE_COLS))


@query(
    "category_abundance",
    f"""WITH s AS (SELECT o_orderpriority AS c, SUM(CAST(o_orderstatus = 'O' AS INT)) / (SELECT CAST(COUNT(*) AS DOUBLE) FROM orders WHERE o_orderstatus = 'O') AS x,
      SUM(CAST(o_orderstatus <> 'O' AS INT)) / (SELECT CAST(COUNT(*) AS DOUBLE) FROM orders WHERE o_orderstatus <> 'O') AS y FROM orders GROUP BY 1)
    SELECT {r("SUM(abs(x - y))")} AS mca_manhattan FROM s""",
)
def category_abundance(spark, folder):
    o = table(spark, folder, "orders")
    return rounded(fidelity.category_abundance(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus <> 'O'"), "o_orderpriority"))


_RULES = {
    "quantity_range": (["l_quantity"], "l_quantity >= 5 AND l_quantity <= 45"),
    "price_positive": (["l_extendedprice"], "l_extendedprice > 0"),
    "discount_over_tax": (["l_discount", "known_tax"], "l_discount > known_tax"),
    "absent_column": (["not_there"], "not_there > 0"),
}


@query(
    "plausibility_rules",
    f"""WITH x AS (SELECT *, CASE WHEN l_tax > 0.02 THEN l_tax END AS known_tax FROM lineitem),
    v AS (SELECT COUNT(*) AS n, SUM(CAST(NOT (l_quantity >= 5 AND l_quantity <= 45) AS INT)) AS a, SUM(CAST(NOT l_extendedprice > 0 AS INT)) AS b,
      SUM(CAST(NOT COALESCE(l_discount > known_tax, FALSE) AS INT)) AS c FROM x)
    SELECT rule, CAST(violations AS BIGINT) AS violations, {r("violations / CAST(d AS DOUBLE)")} AS violation_rate FROM (
      SELECT 'quantity_range' AS rule, a AS violations, n AS d FROM v UNION ALL SELECT 'price_positive', b, n FROM v
      UNION ALL SELECT 'discount_over_tax', c, n FROM v UNION ALL SELECT 'absent_column', 0, n FROM v UNION ALL SELECT 'total', a + b + c, n * 4 FROM v)""",
)
def plausibility_rules(spark, folder):
    x = table(spark, folder, "lineitem").withColumn("known_tax", F.expr("CASE WHEN l_tax > 0.02 THEN l_tax END"))
    return rounded(plausibility.check_rules(x, _RULES))


_SCALE_RULES = {
    "age_valid": (["anchor_age"], "anchor_age >= 20.5 AND anchor_age <= 90.5"),
    "los_positive": (["los"], "los > 0.5"),
}


@query(
    "plausibility_normalised",
    f"""WITH {CODED_SQL}, v AS (SELECT hospital_expire_flag, COUNT(*) AS n, SUM(CAST(NOT anchor_age BETWEEN 20.5 AND 90.5 AS INT)) AS a, SUM(CAST(NOT los > 0.5 AS INT)) AS b FROM static GROUP BY 1)
    SELECT hospital_expire_flag, rule, CAST(v AS BIGINT) AS violations, {r("v / CAST(d AS DOUBLE)")} AS violation_rate FROM (
      SELECT hospital_expire_flag, 'age_valid' AS rule, a AS v, n AS d FROM v UNION ALL SELECT hospital_expire_flag, 'los_positive', b, n FROM v
      UNION ALL SELECT hospital_expire_flag, 'total', a + b, n * 2 FROM v)""",
)
def plausibility_normalised(spark, folder):
    s = cut_lineage(static_features(spark, folder).select("hospital_expire_flag", "anchor_age", "los"))
    fit = fit_minmax(s, ["anchor_age", "los"])
    return rounded(plausibility.check_rules(apply_minmax(s, fit), _SCALE_RULES, fit, ["hospital_expire_flag"]))


_NN = """SELECT q.vec_id, MIN(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[]))) AS d FROM embeddings q, embeddings r
  WHERE q.label >= 5 AND r.label < 5 GROUP BY q.vec_id"""


def _embeddings(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))
    return e.where("label < 5"), e.where("label >= 5")


@query("nn_distance", f"SELECT vec_id, {r('d')} AS distance FROM ({_NN})")
def nn_distance(spark, folder):
    refs, queries = _embeddings(spark, folder)
    d = nearest_distances(queries, refs, "vec_id")
    return rounded(d.select("vec_id", F.col("distances")[0].alias("distance")))


@query(
    "knn_distances",
    f"""SELECT vec_id, k, {r("d")} AS distance FROM (SELECT q.vec_id, ROW_NUMBER() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[]))) AS k,
      list_distance(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS d FROM embeddings q, embeddings r WHERE q.label >= 5 AND r.label < 5) WHERE k <= 5""",
)
def knn_distances(spark, folder):
    refs, queries = _embeddings(spark, folder)
    d = nearest_distances(queries, refs, "vec_id", k=5)
    return rounded(
        d.select("vec_id", F.posexplode("distances").alias("p", "distance")).select("vec_id", (F.col("p") + 1).cast("long").alias("k"), "distance")
    )


_SCALED = """fit AS (SELECT AVG(c_acctbal) AS ma, stddev_pop(c_acctbal) AS sa, AVG(c_nationkey) AS mn, stddev_pop(c_nationkey) AS sn FROM customer),
real AS (SELECT c_custkey AS id, (c_acctbal - ma) / sa AS x, (c_nationkey - mn) / sn AS y FROM customer, fit),
synth AS (SELECT s_suppkey AS id, (s_acctbal - ma) / sa AS x, (s_nationkey - mn) / sn AS y FROM supplier, fit),
near AS (SELECT s.id, MIN(sqrt((s.x - r.x) ** 2 + (s.y - r.y) ** 2)) AS d FROM synth s, real r GROUP BY s.id)"""


def _people(spark, folder):
    real = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    synth = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return real, synth


@query(
    "dcr",
    f"WITH {_SCALED} SELECT {r('AVG(d)')} AS mean_dcr, {r('MEDIAN(d)')} AS median_dcr, {r('MIN(d)')} AS min_dcr, {r('quantile_cont(d, 0.05)')} AS p5_dcr FROM near",
)
def dcr(spark, folder):
    real, synth = _people(spark, folder)
    return rounded(privacy.dcr_summary(privacy.closest_record(real, synth, ["balance", "nation"], "id", "id")))


@query(
    "mia",
    f"""WITH {_SCALED}, mixed AS (SELECT d, 0 AS member FROM near UNION ALL SELECT 0.0, 1 FROM (SELECT id FROM real LIMIT (SELECT LEAST((SELECT COUNT(*) FROM real), (SELECT COUNT(*) FROM synth))))),
    t AS (SELECT MEDIAN(d) AS t FROM mixed),
    c AS (SELECT SUM(CAST(d < t AND member = 1 AS INT)) AS tp, SUM(CAST(d < t AND member = 0 AS INT)) AS fp, SUM(CAST(d >= t AND member = 1 AS INT)) AS fn FROM mixed, t)
    SELECT {r("2.0 * tp / (2.0 * tp + fp + fn)")} AS mia_f1, {r("(SELECT MEDIAN(d) FROM near)")} AS median_nn_distance, {r("(SELECT AVG(d) FROM near)")} AS mean_nn_distance FROM c""",
)
def mia(spark, folder):
    real, synth = _people(spark, folder)
    return rounded(privacy.membership_inference(real, synth, ["balance", "nation"], "id", "id"))


@query(
    "mia_leave_self_out",
    f"""WITH {_SCALED}, members AS (SELECT id, x, y FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY {u_sql("42", "id")}, id) AS rn FROM real) WHERE rn <= (SELECT COUNT(*) FROM synth)),
    mixed AS (SELECT d, 0 AS member FROM near UNION ALL SELECT MIN(sqrt((s.x - r.x) ** 2 + (s.y - r.y) ** 2)), 1 FROM members s, real r WHERE s.id <> r.id GROUP BY s.id),
    t AS (SELECT MEDIAN(d) AS t FROM mixed),
    c AS (SELECT SUM(CAST(d < t AND member = 1 AS INT)) AS tp, SUM(CAST(d < t AND member = 0 AS INT)) AS fp, SUM(CAST(d >= t AND member = 1 AS INT)) AS fn FROM mixed, t)
    SELECT {r("2.0 * tp / (2.0 * tp + fp + fn)")} AS mia_f1, {r("(SELECT MEDIAN(d) FROM near)")} AS median_nn_distance, {r("(SELECT AVG(d) FROM near)")} AS mean_nn_distance FROM c""",
)
def mia_leave_self_out(spark, folder):
    real, synth = _people(spark, folder)
    return rounded(privacy.membership_inference(real, synth, ["balance", "nation"], "id", "id", leave_self_out=True))


_SIDES = f"{SEQ_SQL}, real AS (SELECT p.* FROM padded p JOIN customer ON user_id = c_custkey WHERE c_acctbal > 4500), synth AS (SELECT p.* FROM padded p JOIN customer ON user_id = c_custkey WHERE c_acctbal <= 4500)"


def _sequence_sides(spark, folder):
    s = sequences(spark, folder)
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 4500).alias("rich"))
    both = s.join(c, "user_id")
    return both.where("rich").drop("rich"), both.where("NOT rich").drop("rich")


@query(
    "sequence_distance",
    f"""WITH {_SIDES}, d AS (SELECT r.user_id, MIN(list_distance(list_concat(r.click, r.view), list_concat(s.click, s.view))) AS d FROM real r, synth s GROUP BY r.user_id)
    SELECT {r("AVG(d)")} AS mean_distance, {r("MEDIAN(d)")} AS median_distance, {r("stddev_pop(d)")} AS std_distance FROM d""",
)
def sequence_distance(spark, folder):
    real, synth = _sequence_sides(spark, folder)
    return rounded(temporal.sequence_distance(real, synth, "user_id", ["click", "view"]))


def _acf_sql(side: str) -> str:
    return f"""SELECT channel, lag, AVG(p / ss) AS acf FROM (
      SELECT a.user_id, a.channel, lag, SUM(a.x * b.x) AS p, MAX(a.ss) AS ss FROM c_{side} a JOIN range(13) t(lag) ON TRUE
      JOIN c_{side} b ON a.user_id = b.user_id AND a.channel = b.channel AND b.pos = a.pos + lag GROUP BY a.user_id, a.channel, lag) GROUP BY channel, lag"""


def _centred_sql(side: str) -> str:
    return f"""l_{side} AS (SELECT user_id, 'click' AS channel, unnest(click) AS v, unnest(range(24)) AS pos FROM {side} UNION ALL SELECT user_id, 'view', unnest(view), unnest(range(24)) FROM {side}),
    c_{side} AS (SELECT * FROM (SELECT *, SUM(x * x) OVER (PARTITION BY user_id, channel) AS ss FROM (SELECT *, v - AVG(v) OVER (PARTITION BY user_id, channel) AS x FROM l_{side})) WHERE ss > 0)"""


@query(
    "acf_compare",
    f"""WITH {_SIDES}, {_centred_sql("real")}, {_centred_sql("synth")}
    SELECT a.channel, {r("AVG(abs(a.acf - b.acf))")} AS mean_diff, {r("MAX(abs(a.acf - b.acf))")} AS max_diff FROM ({_acf_sql("real")}) a JOIN ({_acf_sql("synth")}) b ON a.channel = b.channel AND a.lag = b.lag GROUP BY a.channel""",
)
def acf_compare(spark, folder):
    real, synth = _sequence_sides(spark, folder)
    return rounded(temporal.compare_autocorrelations(real, synth, ["click", "view"], 12).select("channel", "mean_diff", "max_diff"))


@query(
    "scaled_sequences",
    f"""WITH {SEQ_SQL}, m AS (SELECT MIN(list_min(click)) AS lo, MAX(list_max(click)) AS hi FROM padded)
    SELECT user_id, {r("list_sum(list_transform(click, lambda x: 2 * (x - lo) / (hi - lo) - 1))")} AS total FROM padded, m""",
)
def scaled_sequences(spark, folder):
    s = temporal.scale_sequences(sequences(spark, folder), ["click", "view"])
    return rounded(s.select("user_id", F.aggregate("click", F.lit(0.0), lambda a, v: a + v).alias("total")))


@query(
    "candidate_ranking",
    f"""SELECT l_suppkey, {r("abs(a - 0.5) + (1 - t) + f / 10", 9)} AS score FROM (SELECT l_suppkey, AVG(l_discount) * 10 AS a, AVG(l_tax) * 10 AS t, AVG(l_quantity) / 10 AS f FROM lineitem GROUP BY l_suppkey)
    ORDER BY abs(a - 0.5) + (1 - t) + f / 10, l_suppkey LIMIT 10""",
)
def candidate_ranking(spark, folder):
    c = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        (F.avg("l_discount") * 10).alias("discriminator_auc"), (F.avg("l_tax") * 10).alias("tstr_auc"), (F.avg("l_quantity") / 10).alias("frobenius_distance")
    )
    return rounded(evaluation.rank_candidates(c, 10).select("l_suppkey", "score"), 9)


# ---- model-based metrics: no SQL twin ------------------------------------
def _metric_row(spark, found):
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "metric string, value double")


@query("discriminator_auc")
def discriminator_auc(spark, folder):
    real, synth = halves(spark, folder)
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return _metric_row(spark, fidelity.discriminator(real, synth, LINE_COLS, ids))


def _labelled_docs(spark, folder):
    return table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id").select(
        "doc_id", "quality", F.col("toxic").cast("double").alias("toxic"), F.col("n_chars").cast("double").alias("n_chars"),
        F.length(F.regexp_replace("text", "[^A-Z]", "")).cast("double").alias("capitals"),
        (F.col("lang") == "en").cast("double").alias("english"),
    )


@query("tstr")
def tstr(spark, folder):
    docs = _labelled_docs(spark, folder)
    from tidemark.operators.prep import stratified_split

    parts = cut_lineage(stratified_split(docs, ["doc_id"], "quality", 0.3, 0.35))
    pick = lambda s: parts.where(F.col("split") == s).drop("split")
    return _metric_row(spark, utility.tstr(pick("train"), pick("val"), pick("test"), "quality", ["toxic", "n_chars", "capitals", "english"]))


@query("attribute_inference")
def attribute_inference(spark, folder):
    real, synth = halves(spark, folder)
    flag = F.col("l_returnflag") == "R"
    acc = privacy.attribute_inference(real.withColumn("ret", flag.cast("int")), synth.withColumn("ret", flag.cast("int")), "ret", LINE_COLS, max_depth=12)
    return _metric_row(spark, {"aia_accuracy": acc})


@query("candidate_score")
def candidate_score(spark, folder):
    """Events as real series, the same users with click and view exchanged as synthetic ones."""
    h = hourly(spark, folder).select(F.col("user_id").alias("stay_id"), "hour", "click", "view")
    swapped = h.select("stay_id", "hour", F.col("view").alias("click"), F.col("click").alias("view"))
    static = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("stay_id"), (F.col("c_acctbal") > 4500).cast("int").alias("hospital_expire_flag"), F.col("c_nationkey").cast("double").alias("nation")
    )
    return _metric_row(spark, evaluation.score_candidate(h, swapped, static, static, "stay_id", ["click", "view"]))


@query("evaluation_tables")
def evaluation_tables(spark, folder):
    """Fit the profile network on the training rows, sample ten datasets, evaluate and pool: all features, 100 trees."""
    from tidemark.operators.prep import impute, stratified_split

    features = list(vocab.PROFILE_FEATURES)
    static = cut_lineage(static_features(spark, folder).select("stay_id", *features))
    static = cut_lineage(stratified_split(impute(static), ["stay_id"], "hospital_expire_flag"))
    static = static.drop(*[c for c in static.columns if c.endswith("_missing")])
    train, test = (static.where(F.col("split") == s).drop("split") for s in ("train", "test"))
    net = fit_network(train, features)
    synth = cut_lineage(net.sample(test.count(), 42, 10).withColumnRenamed("row_id", "rid"))
    found = evaluation.evaluate([evaluation.Model("network", synth, "rid")], train, test, fit_minmax(train, ["anchor_age", "los"]))
    tables = evaluation.result_tables(cut_lineage(found))
    out = None
    for name, t in tables.items():
        cols = [c for c in t.columns if c != "model"]
        long = t.select("model", F.explode(F.array(*[F.struct(F.lit(name).alias("result"), F.lit(c).alias("metric"), F.col(c).alias("pooled")) for c in cols])).alias("e")).select("model", "e.*")
        out = long if out is None else out.unionByName(long)
    return out
