"""Captures from a model's layer outputs in long form: states, attention rows, embeddings, and their assembly.

hidden: (sample, layer, position, h_prev, o_attn, o_ffn); attention: (sample, layer, head, query, weights by position);
plan: (sample, support_positions, prompt_positions, visual_start, visual_end); targets: (sample, span_idx,
target_token_id, prediction_position); probabilities of the target: (sample, span_idx, layer, position, probability).
A prompt's length bounds every group that is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A


def states(hidden: DataFrame) -> DataFrame:
    """``hidden`` with h_mid = h_prev + o_attn and layer_hidden = h_mid + o_ffn."""
    mid = hidden.withColumn("h_mid", A.residual(F.col("h_prev"), F.col("o_attn")))
    return mid.withColumn("layer_hidden", A.residual(F.col("h_mid"), F.col("o_ffn")))


def token_and_patches(hidden: DataFrame, position: int, start: int, end: int) -> DataFrame:
    """(sample, layer, token, patches): the layer output at a position, and those of the visual range in order."""
    s = states(hidden).where((F.col("position") == position) | ((F.col("position") >= start) & (F.col("position") < end)))
    patch = F.when((F.col("position") >= start) & (F.col("position") < end), F.struct("position", "layer_hidden"))
    by = s.groupBy("sample", "layer").agg(F.max(F.when(F.col("position") == position, F.col("layer_hidden"))).alias("token"), F.array_sort(F.array_compact(F.collect_list(patch))).alias("p"))
    return by.select("sample", "layer", "token", F.col("p.layer_hidden").alias("patches"))


def attention_rows(attention: DataFrame, position: Column, start: int, end: int) -> DataFrame:
    """(sample, layer, head, patch_attention, text_attention): a query's weights on the visual range, and on all other
    positions but its own."""
    w = attention.where(F.col("query") == position)
    inside = lambda i: (i >= start) & (i < end)
    text = F.filter("weights", lambda x, i: ~inside(i) & (i != F.col("query")))
    return w.select("sample", "layer", "head", F.filter("weights", lambda x, i: inside(i)).alias("patch_attention"), text.alias("text_attention"))


def embedding_for_token(targets: DataFrame, inputs: DataFrame, outputs: DataFrame, width: int) -> DataFrame:
    """``targets`` with target_embedding: the token's row of the input table, else of the output table, if of ``width``.

    A token that neither has is an error at run time, as no feature could be right.
    """
    row = lambda t, n: t.where(F.size("embedding") == width).select(F.col("token_id").alias("target_token_id"), F.col("embedding").alias(n))
    out = targets.join(row(inputs, "__in"), "target_token_id", "left").join(row(outputs, "__out"), "target_token_id", "left")
    found = F.coalesce("__in", "__out")
    missing = F.raise_error(F.concat(F.lit("no embedding of token "), F.col("target_token_id").cast("string")))
    return out.withColumn("target_embedding", F.when(found.isNull(), missing).otherwise(found)).drop("__in", "__out")


def _collected(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    by = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", F.col(value).alias("v")))).alias("p"))
    return by.select(*keys, F.col("p.v").alias(name))


def assemble(hidden: DataFrame, attention: DataFrame, plan: DataFrame, targets: DataFrame, probabilities: DataFrame) -> DataFrame:
    """One row a (sample, span_idx, layer), with the columns that ``kernels.layer_stats`` reads.

    ``targets`` has its embedding already. Samples without support or prompt positions give no row.
    """
    s = states(hidden)
    at = lambda c: plan.select("sample", F.explode(c).alias("position"))
    support = _collected(s.join(at("support_positions"), ["sample", "position"]), ["sample", "layer"], "h_mid", "support")
    prompt = _collected(s.join(at("prompt_positions"), ["sample", "position"]), ["sample", "layer"], "layer_hidden", "prompt")
    mean = F.transform(F.get("prompt", F.lit(0)), lambda x, i: A.mean(F.transform("prompt", lambda p: F.get(p, i))))
    prompt = prompt.select("sample", "layer", F.element_at("prompt", -1).alias("prompt_last"), mean.alias("prompt_mean"))
    own = targets.join(s.select("sample", "layer", F.col("position").alias("prediction_position"), F.col("o_ffn").alias("update"), F.col("layer_hidden").alias("state")), ["sample", "prediction_position"])
    rows = own.join(support, ["sample", "layer"]).join(prompt, ["sample", "layer"]).join(plan, "sample")
    heads = attention.select("sample", "layer", F.col("query").alias("prediction_position"), "weights")
    heads = heads.join(plan.select("sample", "support_positions"), "sample")
    each = heads.select("sample", "layer", "prediction_position", F.posexplode(A.take(F.col("weights"), F.col("support_positions"))).alias("position", "w"))
    mass = each.groupBy("sample", "layer", "prediction_position", "position").agg(F.avg("w").alias("w"))
    rows = rows.join(_collected(mass, ["sample", "layer", "prediction_position"], "w", "attention"), ["sample", "layer", "prediction_position"])
    keys = ["sample", "span_idx", "layer"]
    semantic = _collected(probabilities.join(at("support_positions"), ["sample", "position"]), keys, "probability", "semantic")
    confident = _collected(probabilities.join(at("prompt_positions"), ["sample", "position"]), keys, "probability", "prompt_probabilities")
    return rows.join(semantic, keys).join(confident, keys).withColumnRenamed("support_positions", "positions")
