"""Feature preparation: impute, encode, scale, bin, split, sample."""

from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.catalog.clinical import CODED_SQL, static_features
from tidemark.catalog.registry import query, r, rounded, rs, table
from tidemark.functions.exprs import bin_label
from tidemark.operators import prep
from tidemark.plans.preprocessing import preprocess


def labelled(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, folder, "labels"), "doc_id", "left")


LABELLED_SQL = "labelled AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@query(
    "impute_flags",
    f"""WITH {LABELLED_SQL}, x AS (SELECT doc_id, CASE WHEN quality IS NOT NULL THEN n_chars END AS lab_chars, quality, CASE WHEN quality IS NOT NULL THEN lang END AS lang FROM labelled),
    f AS (SELECT MEDIAN(lab_chars) AS mc, MEDIAN(quality) AS mq FROM x),
    m AS (SELECT lang AS ml FROM x WHERE lang IS NOT NULL GROUP BY lang ORDER BY COUNT(*) DESC, lang LIMIT 1)
    SELECT doc_id, {r("COALESCE(lab_chars, mc)")} AS lab_chars, {r("COALESCE(quality, mq)")} AS quality, COALESCE(lang, ml) AS lang,
           CAST(lab_chars IS NULL AS INT) AS lab_chars_missing FROM x, f, m""",
)
def impute_flags(spark, folder):
    known = F.col("quality").isNotNull()
    x = labelled(spark, folder).select(
        "doc_id", F.when(known, F.col("n_chars").cast("double")).alias("lab_chars"), F.col("quality").cast("double").alias("quality"),
        F.when(known, F.col("lang")).alias("lang"),
    )
    return rounded(prep.apply_imputation(x, prep.fit_imputation(x, exclude=["doc_id"])))


@query(
    "impute_mean",
    f"""WITH {LABELLED_SQL} SELECT doc_id, {r("COALESCE(quality, (SELECT AVG(quality) FROM labelled))")} AS quality,
        {r("COALESCE(toxic, (SELECT AVG(toxic) FROM labelled))")} AS toxic FROM labelled""",
)
def impute_mean(spark, folder):
    x = labelled(spark, folder).select("doc_id", "quality", "toxic")
    return rounded(prep.apply_imputation(x, prep.fit_imputation(x, "mean", exclude=["doc_id"])))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "onehot_align",
    f"""SELECT c_custkey AS k, 'customer' AS side, {", ".join(f"CAST(c_mktsegment = '{s}' AS INT) AS segment_{s}" for s in _SEGMENTS)}, {r("c_acctbal")} AS balance, 0 AS p_size FROM customer
    UNION ALL SELECT p_partkey, 'part', {", ".join("0" for _ in _SEGMENTS)}, 0.0, p_size FROM part""",
)
def onehot_align(spark, folder):
    a = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("k"), F.lit("customer").alias("side"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")
    )
    a = prep.one_hot(a, prep.fit_categories(a, ["segment"]))
    b = table(spark, folder, "part").select(F.col("p_partkey").alias("k"), F.lit("part").alias("side"), "p_size")
    a, b = prep.align_columns(a, b)
    return rounded(a.unionByName(b))


@query(
    "sparse_onehot",
    """WITH c AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS customer, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status FROM orders),
    i AS (SELECT v, x, ROW_NUMBER() OVER (ORDER BY v, x) - 1 AS at FROM (SELECT DISTINCT 'customer' AS v, customer AS x FROM c UNION SELECT DISTINCT 'status', status FROM c WHERE status IS NOT NULL))
    SELECT o_orderkey, a.at AS customer_at, b.at AS status_at, customer, status FROM c JOIN i a ON a.v = 'customer' AND a.x = customer LEFT JOIN i b ON b.v = 'status' AND b.x = status""",
)
def sparse_onehot(spark, folder):
    """Customers and states of orders as places in one wide indicator row, and back from it."""
    o = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("customer"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status")
    )
    cols = ["customer", "status"]
    index = prep.category_index(o, cols)
    hot = prep.sparse_indicators(o, index, cols)
    places = hot.withColumns({"customer_at": F.get("hot", F.lit(0)), "status_at": F.get("hot", F.lit(1))})
    return prep.from_indicators(places, index, cols).select("o_orderkey", "customer_at", "status_at", *cols)


@query(
    "reverse_onehot",
    """SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'BUILDING' END AS segment, 'none' AS absent FROM customer""",
)
def reverse_onehot(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    wide = prep.one_hot(c, {"segment": ["BUILDING", "MACHINERY"]})
    return wide.select(
        "c_custkey",
        prep.reverse_one_hot(wide, "segment_", ["BUILDING", "MACHINERY"], "none").alias("segment"),
        prep.reverse_one_hot(wide, "unknown_", ["a", "b"], "none").alias("absent"),
    )


@query(
    "minmax_roundtrip",
    f"""SELECT c_custkey, {r("2 * (c_acctbal - lo) / (hi - lo) - 1")} AS scaled, {r("c_acctbal")} AS back, {r("7.0")} AS constant
    FROM customer, (SELECT MIN(c_acctbal) AS lo, MAX(c_acctbal) AS hi FROM customer)""",
)
def minmax_roundtrip(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", F.col("c_acctbal").alias("v"), F.lit(7.0).alias("constant"))
    fit = prep.fit_minmax(c, ["v", "constant"])
    scaled = prep.apply_minmax(c, fit).withColumn("scaled", F.col("v"))
    return rounded(prep.invert_minmax(scaled, fit).select("c_custkey", "scaled", F.col("v").alias("back"), "constant"))


@query(
    "zscore_standard",
    f"""WITH {LABELLED_SQL}, s AS (SELECT AVG(quality) AS m, stddev_pop(quality) AS d, AVG(COALESCE(quality, 0)) AS m0, stddev_pop(COALESCE(quality, 0)) AS d0,
      AVG(n_chars) AS mc, stddev_pop(n_chars) AS dc FROM labelled)
    SELECT doc_id, {r("COALESCE((quality - m) / (d + 1e-8), 0)")} AS z_quality, {r("(COALESCE(quality, 0) - m0) / d0")} AS s_quality, {r("(n_chars - mc) / dc")} AS s_chars FROM labelled, s""",
)
def zscore_standard(spark, folder):
    x = labelled(spark, folder).select("doc_id", F.col("quality").alias("z_quality"), F.col("quality").alias("s_quality"), F.col("n_chars").alias("s_chars"))
    x = prep.z_scores(x, ["z_quality"])
    return rounded(prep.apply_standard(x, prep.fit_standard(x, ["s_quality", "s_chars"])))


@query(
    "quartile_bins",
    f"""WITH e AS (SELECT quantile_cont(p_retailprice, [0, 0.25, 0.5, 0.75, 1]) AS p, list_sort(list_distinct(quantile_cont(p_size, [0, 0.25, 0.5, 0.75, 1]))) AS s FROM part)
    SELECT p_partkey, CASE WHEN p_retailprice <= p[2] THEN 'Q1' WHEN p_retailprice <= p[3] THEN 'Q2' WHEN p_retailprice <= p[4] THEN 'Q3' ELSE 'Q4' END AS price_bin,
      CASE WHEN p_size <= s[2] THEN 'Q1' WHEN p_size <= s[3] THEN 'Q2' WHEN p_size <= s[4] THEN 'Q3' ELSE 'Q4' END AS size_bin,
      CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'big' END AS fixed_bin,
      CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'mid' ELSE 'big' END AS closed_bin FROM part, e""",
)
def quartile_bins(spark, folder):
    p = table(spark, folder, "part")
    e = prep.quartile_edges(p, ["p_retailprice", "p_size"])
    return p.select(
        "p_partkey",
        prep.quartile_label("p_retailprice", e["p_retailprice"], e["p_retailprice__fill"]).alias("price_bin"),
        prep.quartile_label("p_size", e["p_size"], e["p_size__fill"]).alias("size_bin"),
        bin_label("p_size", [0, 10, 30, 1000], ["small", "mid", "big"]).alias("fixed_bin"),
        bin_label("p_size", [0, 10, 30, 1000], ["small", "mid", "big"], right_closed=True).alias("closed_bin"),
    )


def u_sql(*parts: str) -> str:
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(('0x' || substr(md5({text}), 1, 12)) AS BIGINT) / 281474976710656.0)"


@query(
    "stratified_split",
    f"""SELECT doc_id, quality, CASE WHEN rn <= round(n * 0.2) THEN 'test' WHEN rn <= round(n * 0.2) + round((n - round(n * 0.2)) * 0.125) THEN 'val' ELSE 'train' END AS split
    FROM (SELECT doc_id, quality, ROW_NUMBER() OVER (PARTITION BY quality ORDER BY {u_sql("42", "doc_id")}, doc_id) AS rn, COUNT(*) OVER (PARTITION BY quality) AS n FROM labels)""",
)
def stratified_split(spark, folder):
    lab = table(spark, folder, "labels")
    return prep.stratified_split(lab, ["doc_id"], "quality", 0.2, 0.1, 42).select("doc_id", "quality", "split")


@query(
    "random_sample",
    f"""SELECT c_custkey, c_acctbal FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY {u_sql("7", "c_custkey")}, c_custkey) AS rn FROM customer) WHERE rn <= 200""",
)
def random_sample(spark, folder):
    return prep.random_sample(table(spark, folder, "customer"), ["c_custkey"], 200, 7).select("c_custkey", "c_acctbal")


@query(
    "head_tail_sample",
    """SELECT 'head' AS part, o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20)
       UNION ALL SELECT 'tail', o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20)""",
)
def head_tail_sample(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    order = ["o_totalprice", "o_orderkey"]
    return prep.head_sample(o, order, 20).select(F.lit("head").alias("part"), "*").unionByName(
        prep.tail_sample(o, order, 20).select(F.lit("tail").alias("part"), "*")
    )


@query(
    "coerce_text",
    f"""SELECT event_id, {r("CAST(json_extract_string(props, '$.k') AS DOUBLE)")} AS k, event_type FROM events""",
)
def coerce_text(spark, folder):
    ev = table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type")
    return rounded(prep.coerce_numeric_text(ev, ["k", "event_type"]))


_CATS = ["gender", "race", "insurance", "stroke_subtype"]


@query(
    "preprocess_splits",
    f"""WITH {CODED_SQL}, marked AS (SELECT *, CASE WHEN rn <= round(n * 0.2) THEN 'test' WHEN rn <= round(n * 0.2) + round((n - round(n * 0.2)) * 0.125) THEN 'val' ELSE 'train' END AS split
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY hospital_expire_flag ORDER BY {u_sql("42", "stay_id")}, stay_id) AS rn, COUNT(*) OVER (PARTITION BY hospital_expire_flag) AS n FROM static)),
    f AS (SELECT {", ".join(f"MEDIAN({c}) AS m_{c}" for c in [*vocab.LAB_COLUMNS])} FROM marked WHERE split = 'train'),
    filled AS (SELECT split, stay_id, anchor_age, los, gender, has_afib, hospital_expire_flag, {", ".join(f"COALESCE({c}, m_{c}) AS {c}, CAST({c} IS NULL AS INT) AS {c}_missing" for c in vocab.LAB_COLUMNS)} FROM marked, f),
    p AS (SELECT {", ".join(f"MIN({c}) AS lo_{c}, MAX({c}) AS hi_{c}" for c in ["anchor_age", "los", *vocab.LAB_COLUMNS])} FROM filled WHERE split = 'train')
    SELECT split, stay_id, hospital_expire_flag, has_afib, {r("CASE WHEN gender = 'F' THEN 1 ELSE -1 END")} AS gender_f,
      {", ".join(f"{r(f'2 * ({c} - lo_{c}) / (hi_{c} - lo_{c}) - 1')} AS {c}" for c in ["anchor_age", "los", *vocab.LAB_COLUMNS])},
      {", ".join(f"{c}_missing" for c in vocab.LAB_COLUMNS)} FROM filled, p""",
)
def preprocess_splits(spark, folder):
    p = preprocess(static_features(spark, folder), categorical=_CATS)
    keep = ["stay_id", "hospital_expire_flag", "has_afib", F.col("gender_F").alias("gender_f"), "anchor_age", "los", *vocab.LAB_COLUMNS,
            *[f"{c}_missing" for c in vocab.LAB_COLUMNS]]
    parts = [d.select(F.lit(s).alias("split"), *keep) for s, d in (("train", p.train), ("val", p.val), ("test", p.test))]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))
