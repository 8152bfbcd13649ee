"""Queries of the general training-data problems: orphan references (4), heavy keys (5), hierarchies (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.tables import table
from vellum.functions.text import WHITE_SPACE, filled, folded_name, is_image, stripped
from vellum.operators.hierarchy import descendant_pairs, hierarchies
from vellum.operators.references import orphan_references
from vellum.operators.skew import balanced_key_results
from vellum.runtime import settle


# ---- 4: references to images that do not exist
def image_references(spark: SparkSession, d: str) -> DataFrame:
    """Every reference to a file name: (table_name, row_key, dataset, filename, at). Names of any suffix count, null and blank ones don't."""
    labels = table(spark, d, "labels").where(filled("filename") & filled("hand_id"))
    zones = table(spark, d, "zones").where("bbox is not null")
    manifests = table(spark, d, "dataset_manifest").select("manifest_id", folded_name("name").alias("dataset"), F.explode("orphan_rows").alias("filename"), "scanned_at")
    parts = [
        labels.select(F.lit("labels").alias("table_name"), F.col("label_id").alias("row_key"), "dataset", stripped("filename").alias("filename"), F.col("labeled_at").alias("at")),
        zones.select(F.lit("zones").alias("table_name"), F.col("zone_id").alias("row_key"), "dataset", stripped("filename").alias("filename"), F.col("detected_at").alias("at")),
        manifests.select(F.lit("dataset_manifest").alias("table_name"), F.col("manifest_id").alias("row_key"), "dataset", stripped("filename").alias("filename"), F.col("scanned_at").alias("at")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("filename <> ''")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    # as the reference lists a folder: a file without an image's suffix is not there, so a reference that names it is an orphan
    images = table(spark, d, "images").where(is_image("filename")).select("dataset", "filename", "arrived_at", "removed_at")
    return orphan_references(image_references(spark, d), images, ["dataset", "filename"], "at", "arrived_at", "removed_at")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "row_key", "filename").distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans by table, month of the reference, and reason."""
    once = _orphans(spark, d).select("table_name", "row_key", "filename", "at", "reason").distinct()
    return once.groupBy("table_name", F.date_format(F.date_trunc("month", "at"), "yyyy-MM").alias("period"), "reason").agg(F.count(F.lit(1)).alias("n_orphans"), F.count_distinct("filename").alias("n_names"))


# ---- 5: a few keys holding most records
MIN_SHARE = 0.02


def _hand_results(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").where(filled("filename") & filled("hand_id"))
    sure = F.col("confidence").between(0.0, 1.0)
    lean = rows.select(stripped("hand_id").alias("hand_id"), "labeled_at", "label_id", stripped("source").alias("source"), F.when(sure, F.col("confidence")).alias("confidence"))
    return balanced_key_results(lean, "hand_id", "labeled_at", "label_id", "source", "confidence")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    hands = settle(_hand_results(spark, d))
    whole = hands.agg(F.sum("n_rows").alias("n_all"))
    return hands.join(F.broadcast(whole), F.col("n_rows") >= F.col("n_all") * MIN_SHARE).select("hand_id")


def p5_hands(spark: SparkSession, d: str) -> DataFrame:
    return _hand_results(spark, d).select("hand_id", "n_rows", "first_at", "last_at", "n_switches", "longest_gap_s", F.round("mean_value", 6).alias("mean_confidence"))


# ---- 7: parent-child links to full hierarchies
def current_models(spark: SparkSession, d: str) -> DataFrame:
    """The row of each model_id with the latest loaded_at: (model_id, parent_id stripped, blank as null)."""
    parent = stripped("parent_id")
    rows = table(spark, d, "registry").select("model_id", F.struct("loaded_at", F.when(parent != "", parent).alias("parent_id")).alias("last"))
    return rows.groupBy("model_id").agg(F.max("last").alias("last")).select("model_id", "last.parent_id")


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return hierarchies(current_models(spark, d), "model_id", "parent_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).where("loop_id is not null").select("model_id", "loop_id")


def p7_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    tree = settle(_tree(spark, d))
    below = descendant_pairs(tree, "model_id").groupBy(F.col("ancestor_id").alias("model_id")).agg(F.count(F.lit(1)).alias("n"))
    return tree.join(below, "model_id", "left").select("model_id", "parent_id", "root_id", "depth", F.array_join("path", " > ").alias("path"), "loop_id", "on_loop", F.coalesce("n", F.lit(0)).alias("n_descendants"))


def p7_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendant_pairs(_tree(spark, d), "model_id")


def queries() -> dict:
    return {f.__name__: f for f in (p4_found, p4_report, p5_found, p5_hands, p7_found, p7_hierarchy, p7_descendants)}


# ---- the same results in SQL
_W = "".join(f"chr({ord(c)})||" for c in WHITE_SPACE)[:-2]
TRIM = f"trim({{0}}, {_W})"
_IMG = r"regexp_matches(lower({0}), '\.(png|jpg|jpeg|tif|tiff|bmp|webp)\z')"


def trim(x: str) -> str:
    return TRIM.format(x)


REFS = f"""refs AS (
  SELECT DISTINCT * FROM (
    SELECT 'labels' AS table_name, label_id AS row_key, dataset, {trim('filename')} AS filename, labeled_at AS ref_at
    FROM labels WHERE {trim('filename')} <> '' AND {trim('hand_id')} <> ''
    UNION ALL SELECT 'zones', zone_id, dataset, {trim('filename')}, detected_at FROM zones WHERE bbox IS NOT NULL
    UNION ALL SELECT 'dataset_manifest', manifest_id, lower({trim('name')}), {trim('o')}, scanned_at
    FROM (SELECT manifest_id, name, scanned_at, unnest(orphan_rows) AS o FROM dataset_manifest)
  ) WHERE {_IMG.format('filename')}),
orphans AS (
  SELECT r.*, (SELECT min(i.arrived_at) FROM images i WHERE i.dataset = r.dataset AND i.filename = r.filename) AS first_at
  FROM refs r WHERE NOT EXISTS (
    SELECT 1 FROM images i WHERE i.dataset = r.dataset AND i.filename = r.filename
      AND i.arrived_at <= r.ref_at AND (i.removed_at IS NULL OR i.removed_at > r.ref_at)))"""

MODELS = f"""models2 AS (SELECT model_id, max(nullif({trim("coalesce(parent_id, '')")}, '')) AS parent_id FROM registry
            JOIN (SELECT model_id AS m, max(loaded_at) AS l FROM registry GROUP BY model_id) ON model_id = m AND loaded_at = l GROUP BY model_id),
links AS (SELECT a.model_id, a.parent_id, b.model_id AS up FROM models2 a LEFT JOIN models2 b ON a.parent_id = b.model_id),
tree AS (
  SELECT model_id, parent_id, model_id AS root_id, 0 AS depth, [model_id] AS path FROM links WHERE up IS NULL
  UNION ALL
  SELECT l.model_id, l.parent_id, t.root_id, t.depth + 1, list_append(t.path, l.model_id) FROM links l JOIN tree t ON l.up = t.model_id),
walk AS (
  SELECT model_id AS start, model_id AS at, [model_id] AS seen FROM links WHERE model_id NOT IN (SELECT model_id FROM tree)
  UNION ALL
  SELECT w.start, l.up, list_append(w.seen, l.up) FROM walk w JOIN links l ON l.model_id = w.at WHERE NOT list_contains(w.seen, l.up)),
rings AS (SELECT w.start, w.seen, l.up AS again FROM walk w JOIN links l ON l.model_id = w.at WHERE list_contains(w.seen, l.up)),
loops AS (SELECT start AS model_id, list_min(seen[list_position(seen, again):]) AS loop_id, list_contains(seen[list_position(seen, again):], start) AS on_loop FROM rings)"""


def sql() -> dict:
    return {
        "p4_found": f"WITH {REFS} SELECT DISTINCT table_name, row_key, filename FROM orphans",
        "p4_report": f"""WITH {REFS}, once AS (
            SELECT DISTINCT table_name, row_key, filename, ref_at,
              CASE WHEN first_at IS NULL THEN 'missing' WHEN first_at <= ref_at THEN 'removed' ELSE 'late' END AS reason FROM orphans)
            SELECT table_name, strftime(ref_at AT TIME ZONE 'UTC', '%Y-%m') AS period, reason, count(*) AS n_orphans, count(DISTINCT filename) AS n_names
            FROM once GROUP BY 1, 2, 3""",
        "p5_found": f"""WITH v AS (SELECT {trim('hand_id')} AS hand_id FROM labels WHERE {trim('hand_id')} <> '' AND {trim('filename')} <> '')
            SELECT hand_id FROM v GROUP BY 1 HAVING count(*) >= (SELECT count(*) FROM v) * {MIN_SHARE}""",
        "p5_hands": f"""WITH v AS (
              SELECT {trim('hand_id')} AS hand_id, labeled_at, label_id, coalesce({trim('source')}, '') AS source,
                CASE WHEN confidence BETWEEN 0.0 AND 1.0 THEN confidence END AS c
              FROM labels WHERE {trim('hand_id')} <> '' AND {trim('filename')} <> ''),
            s AS (SELECT *, lag(source) OVER w AS before, lag(labeled_at) OVER w AS earlier FROM v
                  WINDOW w AS (PARTITION BY hand_id ORDER BY labeled_at, label_id, source, c NULLS FIRST))
            SELECT hand_id, count(*) AS n_rows, min(labeled_at) AS first_at, max(labeled_at) AS last_at,
              CAST(count(*) FILTER (before <> source) AS BIGINT) AS n_switches,
              coalesce(max(epoch_us(labeled_at) - epoch_us(earlier)), 0) / 1e6 AS longest_gap_s, round(avg(c), 6) AS mean_confidence
            FROM s GROUP BY hand_id""",
        "p7_found": f"WITH RECURSIVE {MODELS} SELECT model_id, loop_id FROM loops",
        "p7_hierarchy": f"""WITH RECURSIVE {MODELS}, below AS (SELECT unnest(path[:-2]) AS model_id FROM tree),
            n AS (SELECT model_id, count(*) AS n FROM below GROUP BY 1)
            SELECT l.model_id, l.parent_id, t.root_id, CAST(t.depth AS INTEGER) AS depth, array_to_string(t.path, ' > ') AS path, p.loop_id,
              coalesce(p.on_loop, false) AS on_loop, coalesce(n.n, 0) AS n_descendants
            FROM links l LEFT JOIN tree t USING (model_id) LEFT JOIN loops p USING (model_id) LEFT JOIN n USING (model_id)""",
        "p7_descendants": f"""WITH RECURSIVE {MODELS},
            u AS (SELECT model_id AS descendant_id, depth, unnest(path) AS ancestor_id, generate_subscripts(path, 1) - 1 AS pos FROM tree)
            SELECT ancestor_id, descendant_id, CAST(depth - pos AS INTEGER) AS distance FROM u WHERE pos < depth""",
    }
