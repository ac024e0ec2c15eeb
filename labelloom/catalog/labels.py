"""Projections, filters, joins and taxonomy queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelloom.catalog.registry import (
    LABELS,
    SQL_FOLDED,
    fold_predictions,
    query,
    rounded,
    sql_uniform,
    table,
)
from labelloom.functions.labels import binarize, blend, one_hot, smooth_labels
from labelloom.functions.losses import sigmoid
from labelloom.functions.portable import uniform
from labelloom.operators import columns as C
from labelloom.operators.combine import (
    alignment_report,
    attach_by_position,
    combine_columns,
    restore_order,
)
from labelloom.operators.ensemble import fold_mean, majority_vote
from labelloom.operators.metrics import table_profile
from labelloom.operators.positions import row_position
from labelloom.operators.rollup import (
    label_descriptions,
    roll_up_long,
    roll_up_wide,
    taxonomy_levels,
)
from labelloom.sources.taxonomy import parse_taxonomy
from labelloom.sources.weights import malformed_lines, parse_weights


@query("default_usage", "SELECT doc_id, source, 'test' AS usage FROM documents")
def default_usage(spark: SparkSession, d: str) -> DataFrame:
    return C.with_default(table(spark, d, "documents").select("doc_id", "source"), "usage", "test")


@query(
    "split_by_usage",
    """SELECT CASE lang WHEN 'en' THEN 'train' WHEN 'fr' THEN 'validation' ELSE 'test' END AS part,
              doc_id, n_chars FROM documents""",
)
def split_by_usage(spark: SparkSession, d: str) -> DataFrame:
    usage = F.when(F.col("lang") == "en", "train").when(F.col("lang") == "fr", "validation")
    docs = table(spark, d, "documents").select("doc_id", "n_chars", usage.otherwise("test").alias("usage"))
    parts = C.split_by_value(docs, "usage")
    return C.stack(*[p.withColumn("part", F.lit(u)) for u, p in zip(C.USAGES, parts)])


@query("select_labels", "SELECT doc_id, toxic, quality FROM labels")
def select_labels(spark: SparkSession, d: str) -> DataFrame:
    return C.select_labels(table(spark, d, "labels"), ["toxic", "quality"], "doc_id")


@query("keep_present", "SELECT doc_id, toxic FROM labels")
def keep_present(spark: SparkSession, d: str) -> DataFrame:
    return C.keep_present(table(spark, d, "labels"), ["doc_id", "Premise", "toxic", "Stimulation"])


@query(
    "labels_to_vector",
    """SELECT doc_id, 0 AS pos, quality AS y FROM labels
       UNION ALL SELECT doc_id, 1, toxic FROM labels""",
)
def labels_to_vector(spark: SparkSession, d: str) -> DataFrame:
    vectors = C.with_label_vector(table(spark, d, "labels"), LABELS)
    return vectors.select("doc_id", F.posexplode("labels").alias("pos", "y"))


@query("vector_to_labels", "SELECT doc_id, toxic AS first, quality AS second FROM labels")
def vector_to_labels(spark: SparkSession, d: str) -> DataFrame:
    vectors = C.with_label_vector(table(spark, d, "labels"), ["toxic", "quality"])
    return C.spread_vector(vectors, "labels", ["first", "second"])


@query("binarize_strict", "SELECT event_id, (value / 500 > 0.5)::INTEGER AS hit FROM events")
def binarize_strict(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", binarize(F.col("value") / 500).alias("hit"))


@query("binarize_inclusive", "SELECT event_id, (value / 500 >= 0.5)::INTEGER AS hit FROM events")
def binarize_inclusive(spark: SparkSession, d: str) -> DataFrame:
    hit = binarize(F.col("value") / 500, 0.5, inclusive=True)
    return table(spark, d, "events").select("event_id", hit.alias("hit"))


@query(
    "sigmoid_scores",
    "SELECT event_id, round(1 / (1 + exp(-(value / 50 - 5))), 6) AS score FROM events",
)
def sigmoid_scores(spark: SparkSession, d: str) -> DataFrame:
    logit = F.col("value") / 50 - 5
    return table(spark, d, "events").select("event_id", rounded(sigmoid(logit)).alias("score"))


@query("prediction_head", "SELECT doc_id, 'SVM' AS \"Method\" FROM documents")
def prediction_head(spark: SparkSession, d: str) -> DataFrame:
    return C.prediction_head(table(spark, d, "documents"), "doc_id", "SVM")


@query("one_baseline", "SELECT doc_id, 1 AS quality, 1 AS toxic FROM labels")
def one_baseline(spark: SparkSession, d: str) -> DataFrame:
    return C.predict_one_baseline(table(spark, d, "labels"), LABELS, "doc_id")


@query("drop_marked", "SELECT conv_id, turn FROM conversations WHERE role <> 'system'")
def drop_marked(spark: SparkSession, d: str) -> DataFrame:
    return C.drop_marked(table(spark, d, "conversations"), "role", "system").select("conv_id", "turn")


@query("head_n", "SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def head_n(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return C.preview(docs, [F.desc("n_chars"), "doc_id"], 10)


@query(
    "union_datasets",
    """SELECT doc_id AS id, text FROM documents
       UNION ALL SELECT item_id, text FROM benchmark""",
)
def union_datasets(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    more = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return C.stack(docs, more)


@query("table_profile", "SELECT count(*) AS rows, 5::BIGINT AS columns FROM documents")
def profile(spark: SparkSession, d: str) -> DataFrame:
    return table_profile(table(spark, d, "documents"))


@query(
    "blend_scores",
    f"""SELECT vec_id, pos::INTEGER AS pos,
               round(0.75 * {sql_uniform('model', 'vec_id', 'pos')}
                     + 0.25 * (pos = label)::INTEGER, 6) AS score
        FROM embeddings, range(0, 10) AS r(pos)""",
)
def blend_scores(spark: SparkSession, d: str) -> DataFrame:
    model = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: uniform("model", F.col("vec_id"), i))
    mixed = blend(model, one_hot(F.col("label"), 10))
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(mixed).alias("pos", "score"))
    return rows.withColumn("score", rounded("score"))


@query(
    "one_hot",
    """SELECT vec_id, pos::INTEGER AS pos, (pos = label)::INTEGER AS y
       FROM embeddings, range(0, 10) AS r(pos)""",
)
def one_hot_rows(spark: SparkSession, d: str) -> DataFrame:
    hot = one_hot(F.col("label"), 10)
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(hot).alias("pos", "y"))


@query(
    "label_smoothing",
    """SELECT vec_id, pos::INTEGER AS pos,
              round((pos = label)::INTEGER * 0.9::DOUBLE + 0.01::DOUBLE, 6) AS y
       FROM embeddings, range(0, 10) AS r(pos)""",
)
def label_smoothing(spark: SparkSession, d: str) -> DataFrame:
    soft = smooth_labels(one_hot(F.col("label"), 10), 0.1, 10)
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(soft).alias("pos", "y"))
    return rows.withColumn("y", rounded("y"))


@query(
    "combine_args_labels",
    "SELECT doc_id, lang, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)",
)
def combine_args_labels(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return combine_columns(docs, table(spark, d, "labels"), "doc_id")


@query(
    "align_check",
    """WITH sides AS (
         SELECT doc_id, 1 AS l, 0 AS p FROM labels UNION ALL SELECT doc_id, 0, 1 FROM documents
       ), ids AS (SELECT doc_id, sum(l) AS l, sum(p) AS p FROM sides GROUP BY doc_id)
       SELECT sum(l)::BIGINT AS label_rows, sum(p)::BIGINT AS prediction_rows,
              count(*) FILTER (WHERE l > 0 AND p > 0) AS matched_ids,
              count(*) FILTER (WHERE p = 0) AS only_labels,
              count(*) FILTER (WHERE l = 0) AS only_predictions,
              count(*) FILTER (WHERE l > 1 OR p > 1) AS repeated_ids
       FROM ids""",
)
def align_check(spark: SparkSession, d: str) -> DataFrame:
    return alignment_report(table(spark, d, "labels"), table(spark, d, "documents"), "doc_id")


@query(
    "attach_by_position",
    """WITH l AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_pos FROM labels),
            r AS (SELECT doc_id AS other, quality, row_number() OVER (ORDER BY quality, doc_id) - 1 AS row_pos FROM labels)
       SELECT row_pos, doc_id, other, quality FROM l FULL JOIN r USING (row_pos)""",
)
def attach(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "labels").select("doc_id")
    marks = table(spark, d, "labels").select(F.col("doc_id").alias("other"), "quality")
    return attach_by_position(ids, marks, ["doc_id"], ["quality", "other"])


@query(
    "fold_mean",
    f"""WITH {SQL_FOLDED}
        SELECT doc_id, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic
        FROM folded GROUP BY doc_id""",
)
def fold_means(spark: SparkSession, d: str) -> DataFrame:
    means = fold_mean(fold_predictions(spark, d), LABELS, "doc_id")
    return means.select("doc_id", *[rounded(n).alias(n) for n in LABELS])


SQL_VOTED = f"""{SQL_FOLDED}, voted AS (
  SELECT doc_id, (2 * sum(quality) >= 6)::INTEGER AS quality, (2 * sum(toxic) >= 6)::INTEGER AS toxic
  FROM folded GROUP BY doc_id
)"""


@query("majority_vote", f"WITH {SQL_VOTED} SELECT * FROM voted")
def vote(spark: SparkSession, d: str) -> DataFrame:
    return majority_vote(fold_predictions(spark, d), LABELS, "doc_id")


@query(
    "rejoin_order",
    f"""WITH {SQL_VOTED}, placed AS (
          SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS row_pos FROM documents
        )
        SELECT doc_id, quality, toxic, row_pos FROM placed JOIN voted USING (doc_id)""",
)
def rejoin_order(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    placed = row_position(docs, ["source", "doc_id"])
    voted = majority_vote(fold_predictions(spark, d), LABELS, "doc_id")
    return restore_order(placed, voted, [*LABELS, "row_pos"], "doc_id")


def place_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Region -> nation -> supplier as JSON fragments of one taxonomy, one per supplier."""
    nations = table(spark, d, "nation").join(
        table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    suppliers = table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    inner = F.create_map("n_name", F.array("s_name"))
    return suppliers.select("s_suppkey", F.to_json(F.create_map("r_name", inner)).alias("json"))


SQL_PLACES = """places AS (
  SELECT s_suppkey, r_name AS category, n_name AS value
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


@query(
    "taxonomy_levels",
    f"""WITH {SQL_PLACES}, names AS (
          SELECT 2 AS level, category AS name, s_suppkey FROM places
          UNION ALL SELECT 1, value, s_suppkey FROM places
        ), firsts AS (SELECT level, name, min(s_suppkey) AS first_at FROM names GROUP BY ALL)
        SELECT level, (row_number() OVER (PARTITION BY level ORDER BY first_at) - 1)::INTEGER AS pos, name FROM firsts""",
)
def levels(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy_levels(parse_taxonomy(place_taxonomy(spark, d), "json", F.col("s_suppkey")))


@query(
    "taxonomy_examples",
    """SELECT r_name AS category, n_name AS value, s_name AS example
       FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def examples(spark: SparkSession, d: str) -> DataFrame:
    parsed = parse_taxonomy(place_taxonomy(spark, d), "json", F.col("s_suppkey"))
    return parsed.select("category", "value", F.explode("examples").alias("example"))


@query(
    "label_descriptions",
    f"""WITH {SQL_PLACES}, firsts AS (SELECT category, value, min(s_suppkey) AS first_at FROM places GROUP BY ALL)
        SELECT category, category || ' ' || string_agg(value, ' ' ORDER BY first_at) AS description
        FROM firsts GROUP BY category""",
)
def descriptions(spark: SparkSession, d: str) -> DataFrame:
    return label_descriptions(parse_taxonomy(place_taxonomy(spark, d), "json", F.col("s_suppkey")))


@query(
    "rollup_labels",
    """WITH flags AS (
         SELECT user_id, bool_or(event_type = 'click') AS click, bool_or(event_type = 'view') AS view,
                bool_or(event_type = 'signup') AS signup, bool_or(event_type = 'purchase') AS purchase,
                bool_or(event_type = 'error') AS error
         FROM events GROUP BY user_id)
       SELECT user_id, (click OR view)::INTEGER AS engage, (signup OR purchase)::INTEGER AS commerce,
              error::INTEGER AS fault FROM flags""",
)
def rollup(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["click", "view", "signup", "purchase", "error"]
    flags = table(spark, d, "events").groupBy("user_id").agg(
        *[F.max((F.col("event_type") == k).cast("int")).alias(k) for k in kinds]
    )
    children = {"engage": ["click", "view"], "commerce": ["signup", "purchase"], "fault": ["error"]}
    return roll_up_wide(flags, children, ["user_id"])


@query(
    "rollup_long",
    """SELECT l_orderkey, r_name AS category, max((l_quantity >= 25)::INTEGER) AS y
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
            JOIN region ON n_regionkey = r_regionkey
       GROUP BY l_orderkey, r_name""",
)
def rollup_rows(spark: SparkSession, d: str) -> DataFrame:
    taxonomy = table(spark, d, "nation").join(
        table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("r_name").alias("category"), F.col("n_name").alias("value"))
    suppliers = table(spark, d, "supplier").join(
        table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select("s_suppkey", F.col("n_name").alias("value"))
    cells = table(spark, d, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "l_orderkey", "value", (F.col("l_quantity") >= 25).cast("int").alias("y")
    )
    return roll_up_long(cells, taxonomy, ["l_orderkey"])


@query(
    "json_props",
    """SELECT event_id, 'k' AS key, (props->>'$.k')::INTEGER AS value FROM events""",
)
def json_props(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.from_json("props", "map<string,int>")
    return table(spark, d, "events").select("event_id", F.explode(parsed).alias("key", "value"))


def weight_lines(spark: SparkSession, d: str) -> DataFrame:
    """Weight lines from the parts; the large ones carry a third field."""
    extra = F.when(F.col("p_size") > 40, F.col("p_type"))
    line = F.concat_ws(",", F.concat(F.lit(" "), "p_name", F.lit(" ")), F.col("p_retailprice"), extra)
    return table(spark, d, "part").select(F.col("p_partkey").alias("line_no"), line.alias("value"))


@query(
    "parse_label_weights",
    "SELECT p_partkey AS line_no, p_name AS label, p_retailprice AS pos_weight FROM part WHERE p_size <= 40",
)
def weights(spark: SparkSession, d: str) -> DataFrame:
    return parse_weights(weight_lines(spark, d), "value", ("line_no",))


@query(
    "weight_lines_skipped",
    """SELECT count(*) FILTER (WHERE p_size <= 40) AS read, count(*) FILTER (WHERE p_size > 40) AS skipped
       FROM part""",
)
def skipped_lines(spark: SparkSession, d: str) -> DataFrame:
    return malformed_lines(weight_lines(spark, d))
