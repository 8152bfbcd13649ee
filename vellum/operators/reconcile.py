"""State dictionaries as tables of names and shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import as_column

# Backbone sizes by name, as (embedding width, depth, heads).
ARCHITECTURES = {"vit_tiny": (192, 12, 3), "vit_small": (384, 12, 6), "vit_base": (768, 12, 12), "vit_large": (1024, 24, 16)}


def bare_key(name: Column | str) -> Column:
    """A parameter name without ``module.`` and then ``backbone.``."""
    return F.regexp_replace(F.regexp_replace(as_column(name), r"^module\.", ""), r"^backbone\.", "")


def backbone_keys(state: DataFrame, name: str) -> DataFrame:
    """Bare names; heads (``head.``, ``fc.``) are dropped unless they stand under ``backbone.``."""
    inner = F.regexp_replace(F.col(name), r"^module\.", "")
    head = inner.startswith("head.") | inner.startswith("fc.")
    return state.where(~head).withColumn(name, bare_key(name))


def reconciled(wanted: DataFrame, given: DataFrame, name: str = "name", shape: str = "shape") -> DataFrame:
    """(name, status): loaded, shape_mismatch (which also counts as missing), missing or unexpected."""
    a, b = wanted.select(name, F.col(shape).alias("_a")), given.select(name, F.col(shape).alias("_b"))
    both = a.join(b, name, "full_outer")
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unexpected").when(F.col("_a") == F.col("_b"), "loaded").otherwise("shape_mismatch")
    return both.select(name, status.alias("status"), status.isin("missing", "shape_mismatch").alias("is_missing"))


def gaps(report: DataFrame, allowed: str = "masked_embed") -> DataFrame:
    """Missing or mismatched names that inference can't do without."""
    return report.where(F.col("is_missing") & ~F.col("name").startswith(allowed))


def decayed(name: Column, shape: Column) -> Column:
    """False for biases and vectors, which take no weight decay."""
    return ~(name.endswith(".bias") | (F.size(shape) == 1))


def depth_of(state: DataFrame, name: str) -> DataFrame:
    """1 + the greatest block number in names like blocks.N.…; null without any."""
    block = F.when(F.col(name).startswith("blocks."), F.split_part(name, F.lit("."), F.lit(2)).try_cast("int"))
    return state.agg((F.max(block) + 1).alias("depth"))


def architectures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in ARCHITECTURES.items()], "arch string, embed_dim int, depth int, heads int")


def named_architecture(rows: DataFrame, dim: str, depth: str) -> DataFrame:
    """``rows`` with arch and heads by width and depth; null where no architecture has both."""
    known = architectures(rows.sparkSession).select(F.col("embed_dim").alias("_d"), F.col("depth").alias("_n"), "arch", "heads")
    return rows.join(F.broadcast(known), (F.col(dim) == F.col("_d")) & (F.col(depth) == F.col("_n")), "left").drop("_d", "_n")


def architecture_of(dim: int, depth: int) -> str:
    """Name of the architecture; an unknown pair is an error."""
    for name, (d, n, _) in ARCHITECTURES.items():
        if (d, n) == (dim, depth):
            return name
    raise ValueError(f"no architecture of width {dim} and depth {depth}; known: {ARCHITECTURES}")


def normalized_checkpoint(saved: dict, config: dict | None = None) -> dict:
    """{backbone, config, global_step, foreign} of a checkpoint given as a dictionary of names and arrays (or of shapes).

    A checkpoint of our own has ``student`` and ``config``; a foreign one has ``teacher`` or a bare state, and its width
    and depth are read from its names and shapes unless ``config`` or its ``args`` tell the architecture.
    """
    state = saved.get("teacher") or saved.get("student") or saved.get("state_dict") or saved
    inner = {k.removeprefix("module."): v for k, v in state.items()}
    bare = {k.removeprefix("backbone."): v for k, v in inner.items() if not k.startswith(("head.", "fc."))}
    told = config or saved.get("config")
    if told is None and isinstance(saved.get("args"), dict):
        told = {k: saved["args"][k] for k in ("arch", "patch_size") if k in saved["args"]}
    if told is None:
        shape = lambda v: tuple(getattr(v, "shape", v))
        blocks = [int(k.split(".")[1]) for k in bare if k.startswith("blocks.")]
        if "cls_token" not in bare or not blocks:
            raise ValueError("the checkpoint's architecture can't be told from its names")
        told = {"arch": architecture_of(shape(bare["cls_token"])[-1], max(blocks) + 1)}
        if "patch_embed.proj.weight" in bare:
            told["patch_size"] = shape(bare["patch_embed.proj.weight"])[-1]
    return {"backbone": bare, "config": told, "global_step": saved.get("global_step", saved.get("epoch", 0)), "foreign": "global_step" not in saved}


def adopted(target: DataFrame, source: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, changed): the source's value where it has one, else the target's."""
    t, s = target.select(key, F.col(value).alias("_t")), source.select(key, F.col(value).alias("_s"))
    merged = F.coalesce("_s", "_t")
    return t.join(s, key, "left").select(key, merged.alias(value), (~merged.eqNullSafe(F.col("_t"))).alias("changed"))


def merged_states(base: DataFrame, over: DataFrame, key: str, value: str) -> DataFrame:
    """Union of names, the value of ``over`` where both have one."""
    b, o = base.select(key, F.col(value).alias("_b")), over.select(key, F.col(value).alias("_o"))
    return b.join(o, key, "full_outer").select(key, F.coalesce("_o", "_b").alias(value))
