"""Index arithmetic of prompts with a placeholder that stands for a run of visual positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def span(start: Column | int, end: Column | int) -> Column:
    """[start, end) as an array; empty where end <= start."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    return F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))


def merged_position(at: Column, placeholder: Column, visual_count: Column | int) -> Column:
    """Where a tokenised position stands once the placeholder is ``visual_count`` positions wide."""
    return F.when(at > placeholder, at + visual_count - 1).otherwise(at)


def prompt_positions(ids: Column, prompt_len: Column | int, image_token: int, start: Column, end: Column) -> Column:
    """Text positions of the prompt: one placeholder is dropped and later ones shift; otherwise visual ones are dropped."""
    at = F.array_position(ids, F.lit(image_token)).cast("int") - 1
    single = F.size(F.filter(ids, lambda x: x == image_token)) == 1
    every = span(F.lit(0), prompt_len)
    shifted = F.transform(F.filter(every, lambda p: p != at), lambda p: merged_position(p, at, end - start))
    plain = F.filter(every, lambda p: ((p < start) | (p >= end)) & (F.coalesce(F.get(ids, p), F.lit(0)) != image_token))
    return F.when(single, shifted).otherwise(plain)


def support_positions(scope: str, start: Column, end: Column, prompt: Column) -> Column:
    if scope == "visual":
        return span(start, end)
    if scope == "visual_prompt":
        return F.array_sort(F.array_union(span(start, end), prompt))
    raise ValueError(f"unknown support scope {scope!r}")


def prediction_position(index: Column, prompt_len: Column | int, prompt: Column, placeholder: Column, visual_count: Column | int) -> Column:
    """The position whose state predicts the response's token ``index``."""
    return F.when(index <= 0, F.array_max(prompt)).otherwise(merged_position(prompt_len + index - 1, placeholder, visual_count))


def text_positions(n: Column, visual: Column, own: Column) -> Column:
    return F.array_except(span(F.lit(0), n), F.concat(visual, F.array(own)))


def vision_range(ids: Column, begin: int, finish: int, fallback: tuple[int, int]) -> Column:
    """(start, end) between two markers, or a fallback where one is missing."""
    a, b = F.array_position(ids, F.lit(begin)).cast("int"), F.array_position(ids, F.lit(finish)).cast("int") - 1
    ok = (a > 0) & (b >= 0)
    return F.struct(F.when(ok, a).otherwise(fallback[0]).alias("start"), F.when(ok, b).otherwise(fallback[1]).alias("end"))


def image_input(before: Column, token: int, count: Column, after: Column) -> Column:
    """Ids with ``count`` image tokens between two parts, and where those stand."""
    return F.struct(F.concat(before, F.array_repeat(F.lit(token), count), after).alias("ids"), F.size(before).alias("start"), (F.size(before) + count).alias("end"))
