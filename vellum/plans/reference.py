"""Queries of the page-embedding operators over the test tables, each beside the SQL that states the same result.

Where there is no table of the needed kind one stands in: the tokens of a page are ten successive rows of embeddings,
its labels stand for hands, detection geometry at scale comes from lineitem and orders, metric series from events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions import vectors as V
from vellum.functions.tables import table
from vellum.operators import codebook, labels, lineage, linalg, meters, pooling, presets, reconcile, report, retrieval, training_math, windows, zones
from vellum.operators.skew import balanced_positions
from vellum.plans.problems import MODELS, trim
from vellum.runtime import settle
from vellum.sources import folders, matrices, plugins
from vellum.streaming import meters as streams

# In SQL "round(...) + 0" makes a negative zero plain, which Spark's rounding never gives.
TIE = 1e-9  # moves means of short decimals off the boundary of rounding, on both sides alike
_DRAW = "CAST('0x' || substr(md5({0}), 1, 12) AS BIGINT)"  # training_math.draw of a text whose parts stand between bars
_QUERIES: dict = {}
_SQL: dict = {}


def query(text: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if text is not None:
            _SQL[f.__name__] = text
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def sql() -> dict:
    return dict(_SQL)


_IMG = r"regexp_matches(lower({0}), '\.(png|jpg|jpeg|tif|tiff|bmp|webp)\z')"
_IMAGES = f"imgs AS (SELECT DISTINCT dataset, filename FROM images WHERE {_IMG.format('filename')})"
_VALID = f"valid AS (SELECT dataset, {trim('filename')} AS filename, {trim('hand_id')} AS hand_id, confidence, source, notes, label_id, received_at FROM labels WHERE {trim('filename')} <> '' AND {trim('hand_id')} <> '')"
_TOKENS = "tokens AS (SELECT vec_id, vec_id // 10 AS page, (vec_id % 10) // 5 AS win, vec_id % 5 AS pos, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


def _images(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "images").where(T.is_image("filename"))


def _embeddings(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").where("embedding is not null")


def _tokens(s: SparkSession, d: str) -> DataFrame:
    return _embeddings(s, d).select("vec_id", F.expr("vec_id div 10").alias("page"), F.expr("(vec_id % 10) div 5").alias("win"), (F.col("vec_id") % 5).alias("pos"), F.col("embedding").alias("v"), "label")


# ---- folders and labels
@query(f"SELECT dataset, filename, split_part(path, '/', -1) AS base, split_part(path, '/', -2) AS folder, count(*) AS n_stays, count(*) FILTER (removed_at IS NULL) AS n_open FROM images WHERE {_IMG.format('filename')} GROUP BY ALL")
def image_inventory(s, d):
    return _images(s, d).groupBy("dataset", "filename", T.base_name("path").alias("base"), T.parent_name("path").alias("folder")).agg(F.count(F.lit(1)).alias("n_stays"), F.count_if(F.col("removed_at").isNull()).alias("n_open"))


@query(f"SELECT dataset, count(DISTINCT filename) AS n_images FROM images WHERE {_IMG.format('filename')} GROUP BY 1")
def dataset_discovery(s, d):
    return folders.discovered_datasets(_images(s, d))


@query("SELECT dataset, count(DISTINCT filename) AS n_images FROM images WHERE regexp_matches(lower(filename), '\\.(png|jpg|jpeg|tif|tiff)\\z') GROUP BY 1")
def legacy_listing(s, d):
    return folders.discovered_datasets(table(s, d, "images").where(T.is_image("filename", T.LEGACY_SUFFIXES)))


_LABELS = f"""{_IMAGES}, {_VALID}, known AS (SELECT v.*, row_number() OVER (ORDER BY received_at, label_id) AS rn FROM valid v SEMI JOIN imgs USING (dataset, filename)),
lab AS (SELECT dataset, filename, arg_max(hand_id, rn) AS hand_id, arg_max(confidence, rn) FILTER (confidence IS NOT NULL AND NOT isnan(confidence)) AS confidence,
  arg_max({trim('source')}, rn) FILTER (source <> '') AS source, arg_max({trim('notes')}, rn) FILTER (notes <> '') AS notes FROM known GROUP BY 1, 2)"""


def _labels(s, d):
    return labels.label_table(table(s, d, "labels"), _images(s, d), ["received_at", "label_id"])


@query(f"WITH {_LABELS} SELECT * FROM lab")
def label_last_wins(s, d):
    return _labels(s, d)


@query(f"WITH {_IMAGES}, {_VALID} SELECT label_id, dataset, filename, hand_id FROM valid ANTI JOIN imgs USING (dataset, filename)")
def label_orphans(s, d):
    return labels.label_orphans(table(s, d, "labels"), _images(s, d)).select("label_id", "dataset", "filename", "hand_id")


@query(f"""WITH {_LABELS}, n AS (SELECT dataset, count(*) AS n_images FROM imgs GROUP BY 1), l AS (SELECT dataset, count(*) AS n_labeled, count(DISTINCT hand_id) AS n_hands FROM lab GROUP BY 1)
SELECT dataset, n_images, coalesce(n_labeled, 0) AS n_labeled, coalesce(n_hands, 0) AS n_hands, round(coalesce(n_labeled, 0) / n_images, 6) AS label_coverage FROM n LEFT JOIN l USING (dataset)""")
def label_coverage(s, d):
    return labels.coverage(_images(s, d), _labels(s, d)).withColumn("label_coverage", F.round("label_coverage", 6))


@query(f"""WITH {_LABELS}, m AS (SELECT row_id, split_part(image, '/', -2) AS dataset, split_part(image, '/', -1) AS filename FROM mapping)
SELECT row_id, dataset, filename, coalesce(hand_id, 'unlabeled') AS hand_id FROM m LEFT JOIN lab USING (dataset, filename)""")
def unlabeled_join(s, d):
    rows = table(s, d, "mapping").select("row_id", T.parent_name("image").alias("dataset"), T.base_name("image").alias("filename"))
    return labels.with_hand(rows, _labels(s, d)).select("row_id", "dataset", "filename", "hand_id")


@query("SELECT label, list(vec_id ORDER BY vec_id) AS rows FROM embeddings GROUP BY 1")
def label_index(s, d):
    return labels.label_index(_embeddings(s, d), "label", "vec_id")


@query("SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r <= 5")
def first_k_per_class(s, d):
    return labels.first_k(_embeddings(s, d).select("label", "vec_id"), "label", "vec_id", 5)


_HANDS = "p AS (SELECT label, vec_id, row_number() OVER (ORDER BY label, vec_id) - 1 AS place, count(*) OVER () AS n_all, count(*) OVER (PARTITION BY label) AS n FROM embeddings), h AS (SELECT *, min(place) OVER (PARTITION BY label) AS start FROM p)"


@query(f"""WITH {_HANDS}, k AS (SELECT *, unnest(range(3)) AS k FROM h),
d AS (SELECT vec_id AS anchor, CAST(k AS INT) AS k, start + (place - start + 1 + {_DRAW.format("'11|positive|' || vec_id || '|' || k")} % (n - 1)) % n AS p, {_DRAW.format("'11|negative|' || vec_id || '|' || k")} % (n_all - n) AS g, start, n FROM k)
SELECT anchor, k, a.vec_id AS positive, b.vec_id AS negative FROM d JOIN h a ON a.place = d.p JOIN h b ON b.place = d.g + CASE WHEN d.g >= d.start THEN d.n ELSE 0 END""")
def hand_triplets(s, d):
    return labels.triplets(_embeddings(s, d), "label", "vec_id", 3, 11)


@query("SELECT * FROM (SELECT label, vec_id AS anchor, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS positive FROM embeddings) WHERE positive IS NOT NULL")
def same_hand_pairs(s, d):
    return labels.same_label_pairs(_embeddings(s, d), "label", "vec_id")


@query(f"WITH {_IMAGES} SELECT dataset, filename FROM imgs ORDER BY filename, dataset LIMIT 8")
def first_images(s, d):
    return _images(s, d).select("dataset", "filename").distinct().orderBy("filename", "dataset").limit(8)


@query(f"WITH {_IMAGES} SELECT dataset, filename, row_number() OVER (ORDER BY dataset, filename) - 1 AS index, 0 AS target FROM imgs")
def indexed_images(s, d):
    listed = _images(s, d).select("dataset", "filename").distinct().withColumn("one", F.lit(0))
    return balanced_positions(listed, "one", ["dataset", "filename"], None, "index", None).select("dataset", "filename", "index", F.lit(0).alias("target"))


# ---- zones
_DET = """det AS (SELECT zone_id, dataset, filename, pos, d[1] AS label, try_cast(d[2] AS DOUBLE) AS score, CAST(trunc(try_cast(d[3] AS DOUBLE)) AS INT) AS x0, CAST(trunc(try_cast(d[4] AS DOUBLE)) AS INT) AS y0,
  CAST(trunc(try_cast(d[5] AS DOUBLE)) AS INT) AS x1, CAST(trunc(try_cast(d[6] AS DOUBLE)) AS INT) AS y1
  FROM (SELECT zone_id, dataset, filename, unnest(detections) AS d, generate_subscripts(detections, 1) - 1 AS pos FROM (SELECT DISTINCT ON (zone_id) * FROM zones)))"""


def _detections(s, d):
    return zones.exploded_detections(table(s, d, "zones").dropDuplicates(["zone_id"]))


@query(f"WITH {_DET} SELECT zone_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_boxes FROM det WHERE split_part(label, '_', 1) = 'Text' AND score >= 0.25 GROUP BY 1")
def zone_union(s, d):
    return zones.union_box(_detections(s, d), ["zone_id"], least_score=0.25)


_MAIN = f"""{_DET}, page AS (SELECT DISTINCT ON (zone_id) zone_id, page_size[1] AS width, page_size[2] AS height FROM zones WHERE len(page_size) = 2),
u AS (SELECT zone_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM det WHERE split_part(label, '_', 1) = 'Text' GROUP BY 1),
main AS (SELECT zone_id, width, height, CASE WHEN u.zone_id IS NOT NULL THEN greatest(0, x0 - 16) END AS x0, CASE WHEN u.zone_id IS NOT NULL THEN greatest(0, y0 - 16) END AS y0,
  CASE WHEN u.zone_id IS NOT NULL THEN least(width, x1 + 16) END AS x1, CASE WHEN u.zone_id IS NOT NULL THEN least(height, y1 + 16) END AS y1, u.zone_id IS NULL AS fell_back FROM page LEFT JOIN u USING (zone_id))"""


def _main(s, d):
    pages = table(s, d, "zones").where(F.size("page_size") == 2).dropDuplicates(["zone_id"]).select("zone_id", F.col("page_size")[0].alias("width"), F.col("page_size")[1].alias("height"))
    return zones.main_zones(pages, _detections(s, d), ["zone_id"], 16)


@query(f"WITH {_MAIN} SELECT * FROM main")
def zone_main(s, d):
    return _main(s, d)


@query(f"WITH {_MAIN} SELECT z.dataset, count(*) AS n_pages, count(*) FILTER (m.fell_back) AS n_fell_back FROM main m JOIN (SELECT DISTINCT ON (zone_id) zone_id, dataset FROM zones) z USING (zone_id) GROUP BY 1")
def zone_fallbacks(s, d):
    names = table(s, d, "zones").dropDuplicates(["zone_id"]).select("zone_id", "dataset")
    return _main(s, d).join(names, "zone_id").groupBy("dataset").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if("fell_back").alias("n_fell_back"))


@query("SELECT DISTINCT ON (dataset, filename) dataset, filename, bbox, coalesce(page_size, [0, 0]) AS size, fell_back, detections FROM (SELECT * FROM zones ORDER BY zone_id)")
def zone_json_roundtrip(s, d):
    one = table(s, d, "zones").groupBy("dataset", "filename").agg(F.min_by(F.struct("bbox", "page_size", "fell_back", "detections"), "zone_id").alias("z")).select("dataset", "filename", "z.*")
    again = folders.zone_entries(settle(folders.zone_documents(one)))
    return again.select("dataset", "filename", "bbox", "size", "fell_back", "detections")


@query(f"WITH {_DET} SELECT zone_id, pos, round_even(score / 7, 3) AS score FROM det")
def rounded_scores(s, d):
    return _detections(s, d).select("zone_id", F.col("pos").cast("long").alias("pos"), F.bround(F.col("score") / 7, 3).alias("score"))


@query(f"WITH {_DET} SELECT zone_id, pos, label, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY score DESC NULLS LAST, pos) AS rank FROM det) WHERE rank <= 8")
def detections_top8(s, d):
    return zones.top_detections(_detections(s, d), ["zone_id"]).select("zone_id", F.col("pos").cast("long").alias("pos"), "label", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_IMAGES}, {_DET}, j AS (SELECT det.* FROM det SEMI JOIN imgs USING (dataset, filename))
SELECT dataset, CASE split_part(label, '_', 1) WHEN 'Text' THEN '#1f77b4' WHEN 'Initial' THEN '#d62728' WHEN 'Damage' THEN '#7f7f7f' ELSE '#888888' END AS colour, count(*) AS n, round(avg(score), 6) AS mean_score FROM j GROUP BY 1, 2""")
def zone_rebuild(s, d):
    known = _detections(s, d).join(_images(s, d).select("dataset", "filename").distinct(), ["dataset", "filename"], "left_semi")
    return known.groupBy("dataset", zones.family_colour("label").alias("colour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


_LINES = "l_orderkey AS page, l_partkey % 1500 AS x0, l_suppkey % 900 AS y0, l_partkey % 1500 + 40 + l_linenumber * 10 AS x1, l_suppkey % 900 + 25 + l_linenumber * 5 AS y1"


@query(f"SELECT page, count(*) AS n FROM (SELECT {_LINES}, (x1 - x0) * (y1 - y0) AS area FROM lineitem) WHERE area >= 0.002::DOUBLE * 1500 * 900 GROUP BY 1")
def min_area_filter(s, d):
    boxes = table(s, d, "lineitem").selectExpr("l_orderkey AS page", "l_partkey % 1500 AS x0", "l_suppkey % 900 AS y0", "l_linenumber AS l").withColumns({"x1": F.col("x0") + 40 + F.col("l") * 10, "y1": F.col("y0") + 25 + F.col("l") * 5})
    return zones.large_enough(boxes, F.lit(1500), F.lit(900), 0.002).groupBy("page").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH b AS (SELECT l_orderkey, l_linenumber, {_LINES} FROM lineitem) SELECT page, CAST(sum(x0 - 3) AS BIGINT) AS sx0, CAST(sum(y0 - 2) AS BIGINT) AS sy0, CAST(sum(x1 + 4) AS BIGINT) AS sx1, CAST(sum(y1 + 5) AS BIGINT) AS sy1 FROM b GROUP BY 1")
def obb_to_bbox(s, d):
    rows = table(s, d, "lineitem").selectExpr("l_orderkey AS page", "l_partkey % 1500 AS a", "l_suppkey % 900 AS b", "l_linenumber AS l")
    a, b, w, h = F.col("a"), F.col("b"), 40 + F.col("l") * 10, 25 + F.col("l") * 5
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    rows = rows.withColumn("c", F.array(corner(a - 3, b), corner(a + w, b - 2), corner(a + w + 4, b + h), corner(a, b + h + 5)))
    return rows.select("page", *[x.alias(n) for n, x in zones.axis_aligned("c").items()]).groupBy("page").agg(*[F.sum(n).alias(f"s{n}") for n in ("x0", "y0", "x1", "y1")])


# ---- windows
_AX = "CASE WHEN {1} - {0} <= 512 THEN [{0}] ELSE range({0}, {1} - 512 + 1, 256) END"
_WIN = f"page AS (SELECT dataset, filename, max(width) AS w, max(height) AS h FROM images WHERE {_IMG.format('filename')} AND width IS NOT NULL AND height IS NOT NULL GROUP BY 1, 2)"


def _pages(s, d):
    return _images(s, d).where("width is not null and height is not null").groupBy("dataset", "filename").agg(F.max("width").alias("width"), F.max("height").alias("height"))


@query(f"WITH {_WIN}, g AS (SELECT dataset, filename, unnest({_AX.format('0', 'h')}) AS y, w FROM page) SELECT dataset, filename, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (SELECT dataset, filename, y, unnest({_AX.format('0', 'w')}) AS x FROM g)")
def window_grid(s, d):
    return windows.window_grid(_pages(s, d)).select("dataset", "filename", "x", "y")


_ZONED = f"""{_WIN}, z AS (SELECT dataset, filename, arg_min(bbox, zone_id) FILTER (len(bbox) = 4) AS b FROM zones GROUP BY 1, 2),
p AS (SELECT dataset, filename, w, h, least(greatest(coalesce(b[1], 0), 0), w) AS ax, least(greatest(coalesce(b[2], 0), 0), h) AS ay, greatest(least(coalesce(b[3], w), w), 0) AS bx, greatest(least(coalesce(b[4], h), h), 0) AS by_ FROM page LEFT JOIN z USING (dataset, filename))"""


def _zoned(s, d):
    boxes = table(s, d, "zones").where(F.size("bbox") == 4).groupBy("dataset", "filename").agg(F.min_by("bbox", "zone_id").alias("b"))
    at = lambda i: F.col("b")[i]
    return windows.window_grid(_pages(s, d).join(boxes, ["dataset", "filename"], "left").select("dataset", "filename", "width", "height", at(0).alias("x0"), at(1).alias("y0"), at(2).alias("x1"), at(3).alias("y1")))


@query(f"WITH {_ZONED}, g AS (SELECT dataset, filename, ax, bx, unnest({_AX.format('ay', 'by_')}) AS y FROM p) SELECT dataset, filename, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (SELECT dataset, filename, y, unnest({_AX.format('ax', 'bx')}) AS x FROM g)")
def window_grid_zoned(s, d):
    return _zoned(s, d).select("dataset", "filename", "x", "y")


@query(f"WITH {_ZONED} SELECT dataset, count(*) AS n_images, CAST(sum(len({_AX.format('ax', 'bx')}) * len({_AX.format('ay', 'by_')})) AS BIGINT) AS n_windows FROM p GROUP BY 1")
def window_counts(s, d):
    return _zoned(s, d).groupBy("dataset").agg(F.count_distinct("filename").alias("n_images"), F.count(F.lit(1)).alias("n_windows"))


@query(f"WITH {_WIN} SELECT dataset, filename, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (SELECT dataset, filename, x, unnest(range(0, h - 512, 256)) AS y FROM (SELECT dataset, filename, unnest(range(0, w - 512, 256)) AS x, h FROM page WHERE w > 512 AND h > 512))")
def window_grid_legacy_a(s, d):
    return windows.legacy_grid_a(_pages(s, d), 512, 0.5).select("dataset", "filename", "x", "y")


@query(f"""WITH {_WIN}, g AS (SELECT dataset, (w - 256) // 32 + 1 AS a, (h - 256) // 32 + 1 AS b FROM page WHERE w >= 256 AND h >= 256)
SELECT dataset, CAST(sum(a * b) AS BIGINT) AS n, CAST(sum(b * 32 * (a * (a - 1) // 2)) AS BIGINT) AS sum_x, CAST(sum(a * 32 * (b * (b - 1) // 2)) AS BIGINT) AS sum_y FROM g GROUP BY 1""")
def window_grid_legacy_b(s, d):
    # the dense grid has thousands of windows a page; their sums stand for them
    return windows.legacy_grid_b(_pages(s, d)).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


@query(f"WITH {_WIN}, l AS (SELECT dataset, filename, {_AX.format('0', 'w')} AS xs, {_AX.format('0', 'h')} AS ys FROM page) SELECT dataset, filename, CAST(len(xs) * len(ys) AS INT) AS n_windows, flatten(list_transform(ys, lambda y: list_transform(xs, lambda x: [CAST(x AS INT), CAST(y AS INT)]))) AS windows FROM l")
def page_index(s, d):
    return windows.page_index(_pages(s, d), ["dataset", "filename"])


# a vector of 64 stands for a page of 8 x 8 pixels
_INK = "ink AS (SELECT vec_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, len(list_filter(range(16), lambda i: embedding[(y + i // 4) * 8 + x + i % 4 + 1] < 0)) / 16 AS ink FROM (SELECT *, unnest([0, 2, 4]) AS x FROM (SELECT *, unnest([0, 2, 4]) AS y FROM embeddings)))"


def _inked(s, d):
    pages = _embeddings(s, d).select("vec_id", F.col("embedding").alias("pixels"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    return pages, windows.sampled_windows(pages, "pixels", 4, 0.5, 0.0, 0.6)


@query(f"WITH {_INK} SELECT vec_id, x, y, ink FROM ink WHERE ink >= 0.6")
def window_sampling(s, d):
    return _inked(s, d)[1].select("vec_id", "x", "y", "ink")


@query(f"""WITH {_INK}, l AS (SELECT vec_id, list([x, y] ORDER BY y, x) AS w FROM ink WHERE ink >= 0.6 GROUP BY 1), n AS (SELECT vec_id, w, unnest(range(5)) AS draw_id FROM embeddings LEFT JOIN l USING (vec_id)),
p AS (SELECT vec_id, CAST(draw_id AS INT) AS draw_id, w[{_DRAW.format("'5|' || vec_id || '|' || draw_id")} % len(w) + 1] AS p, CAST(coalesce(len(w), 0) AS INT) AS n_windows FROM n) SELECT vec_id, draw_id, p[1] AS x, p[2] AS y, n_windows FROM p""")
def random_windows(s, d):
    pages, found = _inked(s, d)
    return windows.random_windows(pages, ["vec_id"], found, 5, 5)


@query("SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: floor(x * 8) <> 0)) / len(embedding) >= 0.55")
def not_blank(s, d):
    rows = _embeddings(s, d).select("vec_id", F.transform("embedding", lambda x: F.floor(x * F.lit(8).cast("float"))).alias("px"))
    return windows.not_blank(rows, "px", 0.55).select("vec_id")


@query("SELECT vec_id, list_transform(list_filter(range(16), lambda t: list_sum(list_transform([0, 1, 8, 9], lambda o: CAST(embedding[(t // 4) * 16 + (t % 4) * 2 + o + 1] AS DOUBLE))) / 4 < 0.02), lambda t: CAST(t AS INT)) AS tokens FROM embeddings")
def foreground_tokens(s, d):
    return _embeddings(s, d).select("vec_id", windows.foreground_tokens(F.col("embedding"), 8, 8, 2, 0.02).alias("tokens"))


@query(f"WITH {_ZONED} SELECT dataset, CAST(2 * sum(len({_AX.format('ax', 'bx')}) * len({_AX.format('ay', 'by_')})) AS BIGINT) AS n_global, CAST(4 * sum(len({_AX.format('ax', 'bx')}) * len({_AX.format('ay', 'by_')})) AS BIGINT) AS n_local FROM p GROUP BY 1")
def view_counts(s, d):
    return windows.crop_views(_zoned(s, d)).groupBy("dataset").agg(F.count_if(F.col("kind") == "global").alias("n_global"), F.count_if(F.col("kind") == "local").alias("n_local"))


@query("SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x < 0)) / len(embedding) >= 0.5")
def foreground_filter(s, d):
    return windows.foreground(_embeddings(s, d), "embedding", 0.0, 0.5).select("vec_id")


@query(f"""WITH {_WIN}, z AS (SELECT dataset, filename, arg_min(page_size, zone_id) AS ps FROM zones GROUP BY 1, 2)
SELECT dataset, filename, CASE WHEN ps[1] > 0 AND ps[2] > 0 THEN ps[1] ELSE w END AS width, CASE WHEN ps[1] > 0 AND ps[2] > 0 THEN ps[2] ELSE h END AS height FROM page LEFT JOIN z USING (dataset, filename)""")
def page_size_fallback(s, d):
    sizes = table(s, d, "zones").where("page_size is not null").groupBy("dataset", "filename").agg(F.min_by("page_size", "zone_id").alias("ps"))
    w, h = folders.known_size("ps", "width", "height")
    return _pages(s, d).join(sizes, ["dataset", "filename"], "left").select("dataset", "filename", w.alias("width"), h.alias("height"))


# ---- pooling and codebooks
_LONG = "long AS (SELECT page, win, pos, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM tokens)"
_POOL = f"""{_TOKENS}, {_LONG}, w AS (SELECT page, win, i, avg(x) AS x FROM long WHERE pos >= 1 GROUP BY 1, 2, 3), m AS (SELECT page, i, avg(x) AS x, count(*) AS n_windows FROM w GROUP BY 1, 2),
n AS (SELECT page, sqrt(sum(x * x)) AS n FROM m GROUP BY 1)"""


@query(f"WITH {_POOL} SELECT page, list(round(x / greatest(n, 1e-12), 6) + 0 ORDER BY i) AS vec, max(n_windows) AS n_windows FROM m JOIN n USING (page) GROUP BY 1")
def pool_mean(s, d):
    return pooling.pooled_mean(_tokens(s, d), "page", "win", "pos", "v", 1).withColumn("vec", V.rounded(F.col("vec")))


@query(f"""WITH {_TOKENS}, {_LONG}, m AS (SELECT page, pos * 64 + i AS i, avg(x) AS x, count(*) AS n_windows FROM long WHERE pos < 2 GROUP BY 1, 2), n AS (SELECT page, sqrt(sum(x * x)) AS n FROM m GROUP BY 1)
SELECT page, list(round(x / greatest(n, 1e-12), 6) + 0 ORDER BY i) AS vec, max(n_windows) AS n_windows FROM m JOIN n USING (page) GROUP BY 1""")
def pool_cls(s, d):
    return pooling.pooled_class(_tokens(s, d), "page", "win", "pos", "v", 2).withColumn("vec", V.rounded(F.col("vec")))


@query(f"WITH {_TOKENS} SELECT row_number() OVER (ORDER BY page, win, pos) - 1 AS row, page, v AS vec FROM tokens WHERE pos >= 1")
def pool_patches(s, d):
    return pooling.patch_rows(_tokens(s, d), "page", "win", "pos", "v", 1).select("row", "page", V.doubles("vec").alias("vec"))


@query("SELECT vec_id, list_transform([1, 4, 9], lambda i: embedding[i]) AS kept FROM embeddings")
def token_drop(s, d):
    return pooling.taken_tokens(_embeddings(s, d).select("vec_id", F.col("embedding").alias("kept")), "kept", [2, 7])


_BOOK = """cl AS (SELECT label AS cluster_id, i, round(avg(x), 9) AS c FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2),
book AS (SELECT cluster_id, list(c ORDER BY i) AS center FROM cl GROUP BY 1)"""
_NEAR = f"""{_TOKENS}, {_BOOK}, dist AS (SELECT vec_id, page, v, cluster_id, center, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_sum(list_transform(list_zip(v, center), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9), cluster_id) AS r FROM tokens, book),
near AS (SELECT * FROM dist WHERE r = 1)"""


def _book(s, d):
    return settle(codebook.label_codebook(_embeddings(s, d), "label", "embedding"))


@query(f"WITH {_BOOK} SELECT cluster_id, list_transform(center, lambda x: round(x, 6) + 0) AS center FROM book")
def codebook_table(s, d):
    return _book(s, d).select("cluster_id", V.rounded(F.col("center")).alias("center"))


@query(f"WITH {_NEAR} SELECT vec_id, cluster_id FROM near")
def nearest_center(s, d):
    return codebook.nearest_centres(_tokens(s, d), _book(s, d), "v").select("vec_id", "cluster_id")


_RES = f"""{_NEAR}, res AS (SELECT page, cluster_id, i, sum(x - c) AS s FROM (SELECT page, cluster_id, unnest(v) AS x, unnest(center) AS c, generate_subscripts(v, 1) AS i FROM near) GROUP BY 1, 2, 3)"""
_VLAD = "SELECT page, list(round({0} / greatest(sqrt(t), 1e-12), 5) + 0 ORDER BY cluster_id, i) AS vec FROM (SELECT *, sum({0} * {0}) OVER (PARTITION BY page) AS t FROM {1}) GROUP BY page"
_FULL = "all_ AS (SELECT page, b.cluster_id, i, coalesce(s, 0) AS s FROM (SELECT DISTINCT page FROM res) CROSS JOIN (SELECT DISTINCT cluster_id FROM book) b CROSS JOIN (SELECT unnest(range(1, 65)) AS i) LEFT JOIN res USING (page, cluster_id, i))"


@query(f"WITH {_RES}, {_FULL}, intra AS (SELECT page, cluster_id, i, s / greatest(sqrt(sum(s * s) OVER (PARTITION BY page, cluster_id)), 1e-12) AS s FROM all_), pw AS (SELECT page, cluster_id, i, sign(s) * sqrt(abs(s)) AS s FROM intra) " + _VLAD.format("s", "pw"))
def vlad_encode(s, d):
    return codebook.vlad(_tokens(s, d), _book(s, d), "page", "v").withColumn("vec", V.rounded(F.col("vec"), 5))


@query(f"WITH {_RES}, {_FULL} " + _VLAD.format("s", "all_"))
def vlad_legacy(s, d):
    return codebook.vlad(_tokens(s, d), _book(s, d), "page", "v", intra=False, power=False).withColumn("vec", V.rounded(F.col("vec"), 5))


@query()
def kmeans_codebook(s, d):
    return codebook.fitted_codebook(_embeddings(s, d), "vec_id", "embedding", 8)


@query("SELECT vec_id // 10 AS page, 512 AS width, 1.0::DOUBLE AS norm FROM embeddings GROUP BY 1")
def vlad_kmeans(s, d):
    # centres hang on the fit, but whatever they are a page's vector has their width and unit length
    made = codebook.vlad(_tokens(s, d), codebook.fitted_codebook(_embeddings(s, d), "vec_id", "embedding", 8), "page", "v")
    return made.select("page", F.size("vec").alias("width"), F.round(V.norm(F.col("vec")), 9).alias("norm"))


@query(f"WITH {_BOOK}, u AS (SELECT 0 AS rank, vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings UNION ALL SELECT 1, cluster_id, list_transform(center, lambda x: round(x, 6) + 0) FROM book) SELECT row_number() OVER (ORDER BY rank, id) - 1 AS row, rank, id, vec FROM u")
def descriptor_union(s, d):
    # the descriptors of two sources, one behind the other, under one numbering
    first = _embeddings(s, d).select(F.lit(0).alias("rank"), F.col("vec_id").alias("id"), V.doubles("embedding").alias("vec"))
    second = _book(s, d).select(F.lit(1).alias("rank"), F.col("cluster_id").cast("long").alias("id"), V.rounded(F.col("center")).alias("vec"))
    return balanced_positions(first.unionByName(second).withColumn("one", F.lit(0)), "one", ["rank", "id"], None, "row", None).select("row", "rank", "id", "vec")


# ---- projections
# Axes have no defined sign, so the SQL states what holds for any: lengths from the mean, and the covariance of the result.
_LENGTHS = "m AS (SELECT avg(x) AS m, i FROM (SELECT CAST(unnest({0}) AS DOUBLE) AS x, generate_subscripts({0}, 1) AS i FROM embeddings) GROUP BY i), c AS (SELECT list(m ORDER BY i) AS c FROM m), l AS (SELECT vec_id, list_sum(list_transform(list_zip(CAST({0} AS DOUBLE[]), c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS l FROM embeddings, c)"


@query(f"WITH {_LENGTHS.format('embedding')} SELECT vec_id, 64 AS n_axes, round(l, 6) AS squares FROM l")
def pca_scores(s, d):
    made = linalg.pca_scores(_embeddings(s, d), "embedding", 64)
    return made.select("vec_id", F.size("scores").alias("n_axes"), F.round(V.dot(F.col("scores"), F.col("scores")), 6).alias("squares"))


@query("SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, 0.0::DOUBLE AS mean_i, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0 END AS cov FROM range(64) a(i), range(64) b(j)")
def pca_whiten(s, d):
    made = linalg.moments(linalg.whitened(_embeddings(s, d), "embedding", unit=False), "white")
    return made.select("i", "j", F.round("mean_i", 6).alias("mean_i"), F.round("cov", 6).alias("cov"))


@query("SELECT vec_id, 64 AS width, 1.0::DOUBLE AS norm FROM embeddings")
def whiten_unit(s, d):
    return linalg.whitened(_embeddings(s, d), "embedding").select("vec_id", F.size("white").alias("width"), F.round(V.norm(F.col("white")), 9).alias("norm"))


@query("SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0 END AS cov FROM range(8) a(i), range(8) b(j)")
def pca_legacy(s, d):
    rows = _embeddings(s, d)
    n = rows.count()
    made = linalg.moments(linalg.covariance_pca(rows, "embedding", 8), "scores")
    # the older covariance is over n
    return made.select("i", "j", F.round(F.col("cov") * (n - 1) / n, 6).alias("cov"))


@query(f"WITH {_LENGTHS.format('embedding[1:2]')} SELECT vec_id, round(l, 6) AS squares FROM l")
def plane_coordinates(s, d):
    flat = _embeddings(s, d).select("vec_id", F.slice("embedding", 1, 2).alias("v"))
    return linalg.plane(flat, "v").select("vec_id", F.round(F.col("px") * F.col("px") + F.col("py") * F.col("py"), 6).alias("squares"))


_XY = "xy AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS px, CAST(embedding[2] AS DOUBLE) AS py FROM embeddings), r AS (SELECT min(px) AS a, max(px) AS b, min(py) AS c, max(py) AS e FROM xy)"


@query(f"WITH {_XY} SELECT vec_id, round(44 + (px - a) / (b - a) * 812, 6) AS cx, round(856 - (py - c) / (e - c) * 812, 6) AS cy FROM xy, r")
def scatter_coords(s, d):
    xy = _embeddings(s, d).select("vec_id", F.col("embedding")[0].cast("double").alias("px"), F.col("embedding")[1].cast("double").alias("py"))
    return linalg.scaled_to_canvas(xy, "px", "py").select("vec_id", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query("SELECT row_id, CASE WHEN regexp_matches(image, '-([a-z]+)-[0-9]+/') THEN regexp_extract(image, '-([a-z]+)-[0-9]+/', 1) ELSE '—' END AS category FROM mapping")
def scatter_categories(s, d):
    return table(s, d, "mapping").select("row_id", T.regex_category("image", "-([a-z]+)-[0-9]+/").alias("category"))


@query("SELECT category, count(*) AS count FROM (SELECT split_part(image, '/', -2) AS category FROM mapping) GROUP BY 1 ORDER BY count DESC, category LIMIT 60")
def category_legend(s, d):
    return report.legend(table(s, d, "mapping").select(T.parent_name("image").alias("c")), "c")


# ---- retrieval
_UNIT = "unit AS (SELECT vec_id AS id, label, vec_id % 3 AS ds, vec_id % 11 = 0 AS junk, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS v FROM embeddings)"
_PAIR = "pair AS (SELECT q.id AS qid, g.id AS gid, q.label = g.label AS pos, {junk} AS junk, q.ds AS ds, q.ds <> g.ds AS other, round(list_sum(list_transform(list_zip(q.v, g.v), lambda z: z[1] * z[2])), 6) AS sim FROM unit q JOIN unit g ON q.id <> g.id)"
_RANK = f"{_UNIT}, {_PAIR.format(junk='false')}, rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, gid) - 1 AS rank FROM pair), hit AS (SELECT * FROM rk WHERE pos)"
_AP = "ap AS (SELECT qid, any_value(n) AS n_relevant, sum(((CASE WHEN rank = 0 THEN 1 ELSE j / rank END) + (j + 1) / (rank + 1)) / (2 * n)) AS ap FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) - 1 AS j, count(*) OVER (PARTITION BY qid) AS n FROM hit) GROUP BY qid)"


def _ranks(s, d, **k):
    return retrieval.relevant_ranks(_embeddings(s, d), "vec_id", "embedding", "label", **k)


@query(f"WITH {_RANK}, {_AP} SELECT qid, n_relevant, round(ap, 6) AS ap FROM ap")
def retrieval_ap(s, d):
    return retrieval.average_precision(_ranks(s, d)).select("qid", "n_relevant", F.round("ap", 6).alias("ap"))


@query(f"WITH {_RANK}, {_AP}, t AS (SELECT qid, min(rank) AS r FROM hit GROUP BY 1) SELECT round(avg(ap), 6) AS map, round(avg(CASE WHEN r < 1 THEN 100.0::DOUBLE ELSE 0 END), 6) AS top1, round(avg(CASE WHEN r < 5 THEN 100.0::DOUBLE ELSE 0 END), 6) AS top5, count(*) AS n_queries FROM ap JOIN t USING (qid)")
def retrieval_map(s, d):
    ranks = settle(_ranks(s, d))
    best = ranks.groupBy("qid").agg(F.min("rank").alias("r"))
    share = lambda k: F.round(F.avg(F.when(F.col("r") < k, 100.0).otherwise(0.0)), 6)
    return retrieval.average_precision(ranks).join(best, "qid").agg(F.round(F.avg("ap"), 6).alias("map"), share(1).alias("top1"), share(5).alias("top5"), F.count(F.lit(1)).alias("n_queries"))


@query(f"WITH {_RANK}, {_AP} SELECT u.ds, round(avg(ap), 6) AS map, count(*) AS n_queries FROM ap JOIN unit u ON u.id = qid GROUP BY GROUPING SETS ((u.ds), ())")
def retrieval_by_dataset(s, d):
    scored = retrieval.average_precision(_ranks(s, d)).withColumn("ds", F.col("qid") % 3)
    return scored.groupingSets([["ds"], []], "ds").agg(F.round(F.avg("ap"), 6).alias("map"), F.count(F.lit(1)).alias("n_queries"))


@query(f"WITH {_RANK} SELECT ds, other AS across, count(*) AS n_hits FROM hit WHERE rank < 10 GROUP BY 1, 2")
def retrieval_across(s, d):
    return _ranks(s, d).where("rank < 10").groupBy((F.col("qid") % 3).alias("ds"), (F.col("qid") % 3 != F.col("gid") % 3).alias("across")).agg(F.count(F.lit(1)).alias("n_hits"))


@query(f"""WITH {_UNIT}, {_PAIR.format(junk='g.junk')}, r0 AS (SELECT *, row_number() OVER w - 1 AS r, sum(junk::INT) OVER w AS jb FROM pair WINDOW w AS (PARTITION BY qid ORDER BY sim DESC, gid)),
hit AS (SELECT qid, gid, CAST(r - jb AS BIGINT) AS rank FROM r0 WHERE pos AND NOT junk), {_AP} SELECT qid, n_relevant, round(ap, 6) AS ap FROM ap""")
def retrieval_junk(s, d):
    return retrieval.average_precision(_ranks(s, d, junk=F.col("vec_id") % 11 == 0)).select("qid", "n_relevant", F.round("ap", 6).alias("ap"))


@query(f"WITH {_RANK}, k AS (SELECT qid, least(max(rank) + 1, 10) AS kq FROM hit GROUP BY 1) SELECT qid, round(count(*) FILTER (rank + 1 <= kq) / any_value(kq), 6) AS p_at_k FROM hit JOIN k USING (qid) GROUP BY 1")
def precision_at_k(s, d):
    return retrieval.precision_at(_ranks(s, d), 10).select("qid", F.round("p_at_k", 6).alias("p_at_k"))


@query(f"WITH {_UNIT}, {_PAIR.format(junk='false')} SELECT qid, gid, CAST(rank AS INT) AS rank, sim FROM (SELECT qid, gid, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, gid) AS rank FROM pair) WHERE rank <= 5")
def retrieval_topk(s, d):
    return retrieval.top_k(_embeddings(s, d), "vec_id", "embedding", 5)


# ---- metric series
_SER = "s AS (SELECT event_type AS name, event_id AS step, value FROM events WHERE value IS NOT NULL)"


def _series(s, d):
    return table(s, d, "events").where("value is not null").select(F.col("event_type").alias("name"), F.col("event_id").alias("step"), "value")


@query(f"""WITH {_SER} SELECT name, step, quantile_disc(value, 0.5) OVER w AS median, round(avg(value) OVER w + 1e-9::DOUBLE, 6) AS avg, max(value) OVER w AS max, value, round(avg(value) OVER (PARTITION BY name ORDER BY step ROWS UNBOUNDED PRECEDING) + 1e-9::DOUBLE, 6) AS global_avg
FROM s WINDOW w AS (PARTITION BY name ORDER BY step ROWS 19 PRECEDING)""")
def rolling_meter(s, d):
    return meters.trailing_meter(_series(s, d), "name", "step", "value").withColumns({"avg": F.round(F.col("avg") + TIE, 6), "global_avg": F.round(F.col("global_avg") + TIE, 6)})


@query(f"WITH {_SER} SELECT name, round(sum(value * (step % 7 + 1)) / sum(step % 7 + 1), 6) AS global_avg FROM s GROUP BY 1")
def reduce_mean(s, d):
    return meters.weighted_meter(_series(s, d).withColumn("n", F.col("step") % 7 + 1), "name", "value", "n").withColumn("global_avg", F.round("global_avg", 6))


@query(f"WITH {_SER} SELECT name, step, value FROM s WHERE step % 50 = 0")
def scalar_cadence(s, d):
    return meters.at_cadence(_series(s, d), "step", 50)


@query(f"WITH {_SER}, n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY step) AS r, count(*) OVER (PARTITION BY name) AS n FROM s) SELECT name, step, CAST(r AS INT) AS at FROM n WHERE r <= n // 64 * 64")
def drop_last_batches(s, d):
    return meters.full_batches(_series(s, d), "name", "step", 64).select("name", "step", "at")


@query(f"WITH {_SER} SELECT step, step // 312 AS epoch, step % 312 AS skip FROM s")
def resume_offset(s, d):
    epoch, skip = meters.resume_point(F.col("step"), 312)
    return _series(s, d).select("step", epoch.alias("epoch"), skip.alias("skip"))


@query(f"WITH {_SER} SELECT name, step, round(avg(value) OVER (PARTITION BY name ORDER BY step ROWS UNBOUNDED PRECEDING) * (100000 - row_number() OVER (PARTITION BY name ORDER BY step)) + 1e-6::DOUBLE, 3) AS eta FROM s")
def eta(s, d):
    return meters.time_left(_series(s, d), "name", "step", "value", F.lit(100000)).select("name", "step", F.round(F.col("eta") + 1000 * TIE, 3).alias("eta"))


@query("SELECT label_id FROM labels WHERE isnan(confidence) OR isinf(confidence)")
def divergence(s, d):
    return table(s, d, "labels").where(meters.diverged(F.col("confidence"))).select("label_id")


@query("""WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
n AS (SELECT *, sum(CASE WHEN r > 1 AND b = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e), g AS (SELECT user_id, run, event_type, count(*) AS n FROM n GROUP BY 1, 2, 3)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, n, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY run) AS BIGINT) AS ends FROM g""")
def run_lengths(s, d):
    return meters.run_lengths(table(s, d, "events"), "user_id", "event_id", "event_type").select("user_id", "run", "event_type", "n", "ends")


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, round(avg(value) + 1e-9::DOUBLE, 6) AS avg, max(value) AS max, count(value) AS n FROM events GROUP BY 1, 2")
def stream_windows(s, d):
    # the table as a stream that is read to its end; the SQL says the same of the table
    path, name = (f"{d}/events.parquet", "*.parquet") if _is_folder(s, f"{d}/events.parquet") else (d, "events.parquet")
    stream = s.readStream.schema(table(s, d, "events").schema).option("pathGlobFilter", name).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    made = streams.finished(streams.windowed_means(stream, "ts", "event_type", "value", "1 day", "60 days"))
    return made.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", F.round(F.col("avg") + TIE, 6).alias("avg"), "max", "n")


def _is_folder(s, path: str) -> bool:
    where = s._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(s._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


# ---- schedules and losses
@query("SELECT i AS step, round(CASE WHEN i < 20 THEN 0.0005::DOUBLE * i / 19 ELSE 1e-6::DOUBLE + 0.5 * (0.0005::DOUBLE - 1e-6::DOUBLE) * (1 + cos(pi() * (i - 20) / 180)) END, 9) AS value FROM range(200) t(i)")
def cosine_schedule(s, d):
    return training_math.cosine_schedule(s, 0.0005, 1e-6, 200, 20).withColumn("value", F.round("value", 9))


@query("SELECT i AS epoch, round(CASE WHEN i < 5 THEN 0.04::DOUBLE WHEN i < 35 THEN 0.04::DOUBLE + (0.07::DOUBLE - 0.04::DOUBLE) * (i - 5) / 29 ELSE 0.07::DOUBLE END, 9) AS value FROM range(100) t(i)")
def temp_schedule(s, d):
    return training_math.temperature_schedule(s, 0.04, 0.07, 30, 100, 5).withColumn("value", F.round("value", 9))


@query(f"""WITH RECURSIVE {_SER}, n AS (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY step) AS r, count(*) OVER (PARTITION BY name) AS n FROM s)
SELECT name, CAST(any_value(n) AS INT) AS n, round(sum(0.1::DOUBLE * value * pow(0.9::DOUBLE, n - r)), 6) AS value FROM n GROUP BY 1""")
def ema_center(s, d):
    return training_math.exponential_average(_series(s, d), "name", "step", "value", 0.9).withColumn("value", F.round("value", 6))


@query("SELECT l_orderkey AS key, round(0.996::DOUBLE * avg(l_extendedprice) + 0.004::DOUBLE * any_value(o_totalprice) + 1e-8::DOUBLE, 4) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def ema_params(s, d):
    teacher = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.avg("l_extendedprice").alias("value"))
    student = table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"))
    return training_math.blended_parameters(teacher, student, "key", "value", 1 - 0.004).withColumn("value", F.round(F.col("value") + 10 * TIE, 4))


_SM = "list_transform({0}, lambda x: exp((x - list_max({0})) / {1}::DOUBLE))"
_CENTER = f"{_TOKENS}, {_LONG}, cm AS (SELECT i, avg(x) AS m FROM (SELECT page, i, avg(x) AS x FROM long WHERE win = 0 AND pos < 2 GROUP BY 1, 2) GROUP BY 1), cv AS (SELECT list(m ORDER BY i) AS c FROM cm)"


def _views(s, d):
    """Teacher views (two of a page), student views (five), and the centre: the mean over a page's views, then over pages."""
    rows = _tokens(s, d).select("page", "win", "pos", V.doubles("v").alias("v"))
    teacher, student = rows.where("win = 0 and pos < 2"), rows.where("win = 1")
    return teacher, student, pooling.mean_vectors(pooling.mean_vectors(teacher, ["page"], "v"), [], "vec", "center")


@query(f"WITH {_CENTER} SELECT list_transform(c, lambda x: round(x, 6) + 0) AS center FROM cv")
def center_mean(s, d):
    return _views(s, d)[2].select(V.rounded(F.col("center")).alias("center"))


@query(f"""WITH {_CENTER}, t AS (SELECT page, pos AS q, list_transform(list_zip(v, c), lambda z: z[1] - z[2]) AS v FROM tokens, cv WHERE win = 0 AND pos < 2), st AS (SELECT page, pos AS w, v FROM tokens WHERE win = 1),
e AS (SELECT page, q, {_SM.format('v', '0.04')} AS p FROM t), l AS (SELECT page, w, v, ln(list_sum({_SM.format('v', '0.1')})) AS z, list_max(v) AS m FROM st),
x AS (SELECT page, -list_sum(list_transform(list_zip(p, v), lambda y: y[1] / list_sum(p) * ((y[2] - m) / 0.1::DOUBLE - z))) AS loss FROM e JOIN l USING (page) WHERE q <> w)
SELECT page, count(*) AS n_pairs, round(avg(loss), 6) AS loss FROM x GROUP BY 1""")
def softmax_ce(s, d):
    teacher, student, center = _views(s, d)
    pairs = teacher.select("page", F.col("pos").alias("q"), F.col("v").alias("t")).join(student.select("page", F.col("pos").alias("w"), F.col("v").alias("s")), "page").where("q <> w")
    loss = training_math.cross_entropy(F.col("t"), F.col("s"), F.col("center"), 0.04)
    return pairs.join(F.broadcast(center), F.lit(True)).groupBy("page").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg(loss), 6).alias("loss"))


@query("""SELECT vec_id, round(list_sum(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x > 0)) / greatest(len(list_filter(embedding, lambda x: x > 0)), 1), 6) AS loss FROM embeddings""")
def masked_patch_loss(s, d):
    v = V.doubles("embedding")
    return _embeddings(s, d).select("vec_id", F.round(training_math.masked_mean(v, F.transform(v, lambda x: x > 0)), 6).alias("loss"))


@query(f"WITH {_TOKENS}, p AS (SELECT page, pos FROM tokens WHERE win = 0) SELECT a.page, a.pos AS q, b.pos AS v, CASE WHEN a.pos = b.pos THEN 'patch' ELSE 'class' END AS kind FROM p a JOIN p b USING (page) WHERE a.pos < 2")
def view_pairs(s, d):
    views = _tokens(s, d).where("win = 0")
    wanted = training_math.view_pairs(s, 2, 5)
    have = lambda n: views.select("page", F.col("pos").alias(n))
    return have("q").join(F.broadcast(wanted), "q").join(have("v"), ["page", "v"]).select("page", "q", "v", "kind")


@query(f"SELECT event_id, CASE WHEN event_id % 100 < 10 THEN 0.0 ELSE CASE {_DRAW.format("'choice|' || event_id")} % 2 WHEN 0 THEN 0.3::DOUBLE - 0.05::DOUBLE + {_DRAW.format("'spread|' || event_id")} / 281474976710656 * 0.1::DOUBLE ELSE 0.5::DOUBLE END END AS ratio FROM events")
def masking_ratios(s, d):
    ratio = training_math.masking_ratio(F.col("event_id") % 100, 10, [0.3, 0.5], [0.05, 0.0], F.col("event_id"))
    return table(s, d, "events").select("event_id", ratio.alias("ratio"))


@query("SELECT event_id, (event_id // 312 + 1) % 5 = 0 AS saves, event_id // 312 <> 0 AND event_id // 312 % 4 = 0 AS shows FROM events")
def epoch_cadence(s, d):
    epoch = F.expr("event_id div 312")
    return table(s, d, "events").select("event_id", meters.at_epoch_ends(epoch, 5).alias("saves"), meters.at_later_epochs(epoch, 4).alias("shows"))


@query("""WITH t AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings)
SELECT vec_id, round(n, 6) AS norm, list_transform(v, lambda x: round(x * least(1, 0.5::DOUBLE / (n + 1e-6::DOUBLE)), 6) + 0) AS clipped FROM t""")
def grad_clip(s, d):
    n, v = training_math.clipped("embedding", 0.5)
    return _embeddings(s, d).select("vec_id", F.round(n, 6).alias("norm"), V.rounded(v).alias("clipped"))


@query("""WITH a AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), r AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) <= 19 AS m FROM a)
SELECT vec_id, list(m ORDER BY i) AS mask FROM r GROUP BY 1""")
def attention_topn_mask(s, d):
    return _embeddings(s, d).select("vec_id", training_math.top_mask(F.col("embedding"), 0.3).alias("mask"))


@query(f"""WITH a AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), r AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r FROM a),
h AS (SELECT *, r <= 6 AND row_number() OVER (PARTITION BY vec_id, r <= 6 ORDER BY {_DRAW.format("vec_id || '|' || i")}, i) <= 1 AS shown FROM r) SELECT vec_id, list(r <= 19 AND NOT shown ORDER BY i) AS mask FROM h GROUP BY 1""")
def hint_mask(s, d):
    return _embeddings(s, d).select("vec_id", training_math.hinted_mask(F.col("embedding"), 0.3, 0.1, F.col("vec_id")).alias("mask"))


@query(f"WITH k AS (SELECT vec_id, unnest(range(64)) AS i FROM embeddings), o AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY {_DRAW.format("vec_id || '|' || i")}, i) <= 19 AS m FROM k) SELECT vec_id, list(m AND {_DRAW.format("vec_id || '|drop'")} / 281474976710656 <= 0.5 ORDER BY i) AS mask FROM o GROUP BY 1")
def random_mask(s, d):
    return _embeddings(s, d).select("vec_id", training_math.dropped_masks(training_math.seeded_mask(64, 0.3, F.col("vec_id")), 0.5, F.col("vec_id"), F.lit("drop")).alias("mask"))


@query(f"SELECT DISTINCT ON (t, path) dataset, filename, path FROM (SELECT DISTINCT dataset, filename, path, {_DRAW.format("'700021|' || path")} AS t FROM images WHERE {_IMG.format('filename')}) ORDER BY t, path LIMIT 300")
def sampled_pages(s, d):
    return training_math.seeded_sample(_images(s, d).select("dataset", "filename", "path").distinct(), "path", 300, 7)


@query(f"SELECT vec_id, row_number() OVER (ORDER BY {_DRAW.format("'100006|' || vec_id")}, vec_id) - 1 AS position FROM embeddings")
def shuffled_epoch(s, d):
    return training_math.shuffled(_embeddings(s, d).select("vec_id"), "vec_id", 1, 3)


@query(f"WITH p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place, count(*) OVER () AS n FROM embeddings) SELECT draw_id, vec_id FROM range(700) r(draw_id) JOIN p ON p.place = {_DRAW.format("'9|' || draw_id")} % p.n")
def drawn_again(s, d):
    return training_math.drawn_again(_embeddings(s, d).select("vec_id"), "vec_id", 700, 9)


@query(f"""WITH {_TOKENS}, a AS (SELECT page, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM tokens WHERE pos >= 1), m AS (SELECT page, i, avg(x) AS x FROM a GROUP BY 1, 2), n AS (SELECT page, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM m GROUP BY 1)
SELECT page, list(round(x / n, 6) + 0 ORDER BY i) AS vec FROM m JOIN n USING (page) GROUP BY 1""")
def projector_vectors(s, d):
    # No page has more than four windows here, so the SQL need not draw.
    return pooling.projector_vectors(_tokens(s, d).where("pos >= 1"), "page", "win", "v", 2).select("page", V.rounded(F.col("vec")).alias("vec"))


# ---- state dictionaries
_KEYS = "CASE p_partkey % 4 WHEN 0 THEN 'module.backbone.blocks.' || p_partkey % 12 || '.' || p_name WHEN 1 THEN 'backbone.blocks.' || p_partkey % 12 || '.' || p_name WHEN 2 THEN 'head.' || p_name ELSE p_name END"
_BARE = "regexp_replace(regexp_replace({0}, '^module\\.', ''), '^backbone\\.', '')"
_STATE = f"state AS (SELECT name, list(p_partkey % 5 ORDER BY p_partkey) AS shape FROM (SELECT {_KEYS} AS name, p_partkey FROM part) GROUP BY 1)"
_STRIPPED = f"bare AS (SELECT {_BARE.format('name')} AS name, min(shape) AS shape FROM state WHERE NOT regexp_matches(regexp_replace(name, '^module\\.', ''), '^(head|fc)\\.') GROUP BY 1)"


def _state(s, d):
    k, n = F.col("p_partkey"), F.col("p_name")
    block = F.concat(F.lit("blocks."), (k % 12).cast("string"), F.lit("."), n)
    name = F.when(k % 4 == 0, F.concat(F.lit("module.backbone."), block)).when(k % 4 == 1, F.concat(F.lit("backbone."), block)).when(k % 4 == 2, F.concat(F.lit("head."), n)).otherwise(n)
    return table(s, d, "part").groupBy(name.alias("name")).agg(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: x % 5).alias("shape"))


def _bare(s, d):
    return reconcile.backbone_keys(_state(s, d), "name").groupBy("name").agg(F.min("shape").alias("shape"))


@query(f"WITH {_STATE}, {_STRIPPED} SELECT * FROM bare")
def key_strip(s, d):
    return _bare(s, d)


_GIVEN = "given AS (SELECT p_name AS name, list(p_partkey % 5 ORDER BY p_partkey) AS shape FROM part WHERE p_partkey % 3 > 0 GROUP BY 1)"


@query(f"""WITH {_STATE}, {_STRIPPED}, {_GIVEN} SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.shape IS NULL THEN 'missing' WHEN a.shape IS NULL THEN 'unexpected' WHEN a.shape = b.shape THEN 'loaded' ELSE 'shape_mismatch' END AS status,
b.shape IS NULL OR (a.shape IS NOT NULL AND a.shape <> b.shape) AS is_missing FROM bare a FULL JOIN given b ON a.name = b.name""")
def state_dict_reconcile(s, d):
    given = table(s, d, "part").where("p_partkey % 3 > 0").groupBy(F.col("p_name").alias("name")).agg(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: x % 5).alias("shape"))
    return reconcile.reconciled(_bare(s, d), given)


@query(f"""WITH {_STATE}, {_STRIPPED}, {_GIVEN} SELECT a.name FROM bare a LEFT JOIN given b ON a.name = b.name WHERE (b.shape IS NULL OR a.shape <> b.shape) AND NOT starts_with(a.name, 'blocks.1.')""")
def inference_gaps(s, d):
    return reconcile.gaps(state_dict_reconcile(s, d), "blocks.1.").select("name")


@query("SELECT p_partkey, p_partkey % 4 < 2 AND contains(CASE WHEN p_partkey % 3 = 0 THEN 'head.last_layer.' || p_name ELSE p_name END, 'last_layer') AS frozen FROM part")
def frozen_parameters(s, d):
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("head.last_layer."), F.col("p_name"))).otherwise(F.col("p_name"))
    return table(s, d, "part").select("p_partkey", training_math.frozen(name, F.col("p_partkey") % 4, 2).alias("frozen"))


@query(f"WITH {_STATE} SELECT name, NOT (ends_with(name, '.bias') OR len(shape) = 1) AS decayed FROM state")
def param_groups(s, d):
    return _state(s, d).select("name", reconcile.decayed(F.col("name"), F.col("shape")).alias("decayed"))


@query(f"WITH {_STATE}, {_STRIPPED} SELECT CAST(max(try_cast(split_part(name, '.', 2) AS INT)) FILTER (starts_with(name, 'blocks.')) + 1 AS INT) AS depth FROM bare")
def infer_depth(s, d):
    return reconcile.depth_of(_bare(s, d), "name")


@query("SELECT o_orderkey AS key, coalesce(n, o_custkey) AS value, coalesce(n, o_custkey) <> o_custkey AS changed FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1) ON l_orderkey = o_orderkey")
def adopt_config(s, d):
    given = table(s, d, "lineitem").where("l_orderkey % 2 = 0").groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("value"))
    return reconcile.adopted(table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value")), given, "key", "value")


@query("SELECT coalesce(a.k, b.k) AS key, coalesce(b.v, a.v) AS value FROM (SELECT c_custkey AS k, c_name AS v FROM customer) a FULL JOIN (SELECT s_suppkey AS k, s_name AS v FROM supplier) b ON a.k = b.k")
def merged_states(s, d):
    return reconcile.merged_states(table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value")), table(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("value")), "key", "value")


@query("""WITH k AS (SELECT * FROM (VALUES ('vit_base', 768, 12, 12), ('vit_large', 1024, 24, 16), ('vit_small', 384, 12, 6), ('vit_tiny', 192, 12, 3)) t(arch, w, n, heads)),
c AS (SELECT s_suppkey, CAST([192, 384, 768, 1024, 512][s_suppkey % 5 + 1] AS INT) AS embed_dim, CAST([12, 24][s_suppkey % 3 % 2 + 1] AS INT) AS depth FROM supplier) SELECT s_suppkey, embed_dim, depth, arch, heads FROM c LEFT JOIN k ON w = embed_dim AND n = depth""")
def arch_lookup(s, d):
    key = F.col("s_suppkey")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    told = table(s, d, "supplier").select("s_suppkey", pick([192, 384, 768, 1024, 512], key % 5).alias("embed_dim"), pick([12, 24], key % 3 % 2).alias("depth"))
    return reconcile.named_architecture(told, "embed_dim", "depth")


# ---- lineage and sidecars
@query(f"""WITH RECURSIVE {MODELS}, l AS (SELECT r.model_id, arg_max(config_hash, loaded_at) AS config_hash, arg_max(seed, loaded_at) AS seed FROM registry r GROUP BY 1) SELECT model_id, parent_id, config_hash, seed FROM l JOIN models2 USING (model_id)""")
def lineage_models(s, d):
    parent = T.stripped("parent_id")
    return lineage.current_entries(table(s, d, "registry")).select("model_id", F.when(parent != "", parent).alias("parent_id"), "config_hash", "seed")


@query(f"""WITH l AS (SELECT model_id, max(loaded_at) AS t FROM registry GROUP BY 1), e AS (SELECT DISTINCT r.model_id, r.dataset_manifests AS m FROM registry r JOIN l ON r.model_id = l.model_id AND r.loaded_at = l.t)
SELECT DISTINCT model_id, lower({trim('n')}) AS name FROM (SELECT model_id, unnest(m) AS n FROM e) WHERE {trim('n')} <> ''""")
def lineage_folders(s, d):
    return lineage.used_folders(table(s, d, "registry"))


@query("""WITH l AS (SELECT model_id, max(loaded_at) AS t FROM registry GROUP BY 1), e AS (SELECT r.model_id, any_value(r.eval_scores) AS m FROM registry r JOIN l ON r.model_id = l.model_id AND r.loaded_at = l.t GROUP BY 1)
SELECT model_id, u.key AS metric, u.value AS score FROM (SELECT model_id, unnest(map_entries(m)) AS u FROM e) WHERE u.value IS NOT NULL AND NOT isnan(u.value)""")
def lineage_scores(s, d):
    return lineage.scores(table(s, d, "registry"))


@query("SELECT model_id, count(*) AS n FROM (SELECT 'vit@' || substr(config_hash, 1, 8) || '+step' || seed AS model_id FROM registry) WHERE model_id <> 'vit@00000000+step1' GROUP BY 1")
def sidecar_mismatch(s, d):
    cars = table(s, d, "registry").select(matrices.model_id(F.lit("vit"), F.col("config_hash"), F.col("seed")).alias("model_id"))
    return matrices.mismatched_sidecars(cars, "vit@00000000+step1").groupBy("model_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT row_id AS row, image, n_windows, (SELECT count(*) FROM mapping) AS n_rows FROM mapping")
def sidecar_rows(s, d):
    fields, listed = matrices.sidecar(table(s, d, "mapping"), {"model_id": "vit@00000000+step1", "pooling": "mean"}, "row_id", "image", "n_windows")
    return matrices.listed_rows(settle(listed)).join(F.broadcast(fields.select("n_rows")), F.lit(True))


@query("SELECT CAST(vec_id AS VARCHAR) AS image, " + ", ".join(f"embedding[{i + 1}] AS d{i}" for i in range(64)) + " FROM embeddings")
def wide_embeddings(s, d):
    return matrices.wide(_embeddings(s, d).select(F.col("vec_id").cast("string").alias("image"), "embedding"), "image", "embedding", 64)


@query("SELECT CAST(vec_id AS VARCHAR) AS image, embedding AS vec FROM embeddings")
def wide_roundtrip(s, d):
    return matrices.narrow(settle(wide_embeddings(s, d)), "image")


# ---- scalars and small tables
@query("SELECT doc_id, sha256(body) AS digest FROM documents WHERE body IS NOT NULL")
def file_digest(s, d):
    return table(s, d, "documents").where("body is not null").select("doc_id", F.sha2("body", 256).alias("digest"))


@query(f"""SELECT doc_id, split_part(source, '.', 1) AS family, regexp_replace(source, '^www\\.', '') AS bare, 'checkpoint_epoch' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(4, len(CAST(doc_id AS VARCHAR))) AS INT), '0') AS name,
lower({trim("coalesce([' Yes', 'TRUE', '0', 'on ', 'no', NULL, '1', 'off'][doc_id % 8 + 1], '')")}) IN ('1', 'true', 'yes', 'on') AS truthy, replace(replace(replace(replace(replace(source, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM documents""")
def string_scalars(s, d):
    return table(s, d, "documents").select("doc_id", F.split_part("source", F.lit("."), F.lit(1)).alias("family"), F.regexp_replace("source", r"^www\.", "").alias("bare"), F.concat(F.lit("checkpoint_epoch"), F.format_string("%04d", "doc_id")).alias("name"), T.truthy(F.element_at(F.array(*map(F.lit, [" Yes", "TRUE", "0", "on ", "no", None, "1", "off"])), (F.col("doc_id") % 8 + 1).cast("int"))).alias("truthy"), T.html_escaped("source").alias("escaped"))


@query("SELECT label, CAST(least(30, greatest(5, (count(*) - 1) // 3)) AS BIGINT) AS perplexity FROM embeddings GROUP BY 1")
def perplexity(s, d):
    return _embeddings(s, d).groupBy("label").agg(F.least(F.lit(30).cast("long"), F.greatest(F.lit(5).cast("long"), F.expr("(count(*) - 1) div 3"))).alias("perplexity"))


@query(f"""WITH {_ZONED}, n AS (SELECT dataset, CAST(sum(len({_AX.format('ax', 'bx')}) * len({_AX.format('ay', 'by_')})) AS BIGINT) AS n FROM p GROUP BY 1), v AS (SELECT * FROM (VALUES ('aggressive', 8), ('default', 6), ('mild', 4)) t(preset, n_local))
SELECT dataset, preset, 3 * n AS n_global, n_local * n AS n_local FROM n, v""")
def aug_presets(s, d):
    # the views of each preset, the number of global ones overridden
    crops = presets.preset_rows(s, global_crops_number=3).where("parameter in ('global_crops_number', 'local_crops_number')")
    crops = crops.groupBy("preset").agg(F.max(F.when(F.col("parameter") == "global_crops_number", F.col("high"))).cast("long").alias("g"), F.max(F.when(F.col("parameter") == "local_crops_number", F.col("high"))).cast("long").alias("l"))
    counts = _zoned(s, d).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(crops), F.lit(True)).select("dataset", "preset", (F.col("g") * F.col("n")).alias("n_global"), (F.col("l") * F.col("n")).alias("n_local"))


@query("SELECT vec_id, list_transform(range(4), lambda j: round(list_sum(list_transform(range(64), lambda i: CAST(embedding[i + 1] AS DOUBLE) * ((i * 7 + j * 13) % 11 - 5))), 4) + 0) AS vec FROM embeddings")
def embed_udf_contract(s, d):
    import numpy as np

    weights = np.array([[(i * 7 + j * 13) % 11 - 5 for j in range(4)] for i in range(64)], np.float64)

    def model(contents):
        return np.array([np.frombuffer(c, np.float32).astype(np.float64) for c in contents]).reshape(-1, 64) @ weights

    packed = _embeddings(s, d).select("vec_id", "embedding").mapInArrow(_bytes_of, "vec_id long, content binary")
    return plugins.embedded(packed, model, ["vec_id"], "content").select("vec_id", V.rounded(V.doubles("vec"), 4).alias("vec"))


def _bytes_of(batches):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        yield pa.record_batch([b.column("vec_id"), pa.array([np.array(v, np.float32).tobytes() for v in b.column("embedding").to_pylist()], pa.binary())], names=["vec_id", "content"])


@query()
def detector_udf_contract(s, d):
    # a body stands for a page of 32 pixels a line, the rest of its last line blank (white); without a body there is no page
    size = F.coalesce(F.length("body"), F.lit(0))
    height = F.ceil(size / 32).cast("int")
    pages = table(s, d, "documents").select("doc_id", F.lit(32).alias("width"), height.alias("height"), F.rpad(F.col("body").cast("binary"), height * 32, F.lit(b"\xff")).alias("gray"))
    return plugins.detected(pages, plugins.detector("heuristic"), ["doc_id"])
