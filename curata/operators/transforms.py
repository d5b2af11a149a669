"""Tokenising transforms by name, and a runner that applies a list of them.

A transform takes a DataFrame and options and gives a DataFrame; all are projections or filters, so a chain of them is one
stage. Rendered messages are tokenised by an expression (:func:`curata.operators.sequences.hashed_ids` by default).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.operators.filters import any_label, within_limits
from curata.operators.messages import prompt_and_last, raw_prompt, render, system_override
from curata.operators.sequences import MASKED, hashed_ids, turn_labels

Tokenize = Callable[[Column], Column]


def ones(ids: Column) -> Column:
    """The attention mask of unpadded ids."""
    return F.transform(ids, lambda x: F.lit(1))


def _encoded(messages: Column, tokenize: Tokenize, template: str, generate: bool = False) -> Column:
    return tokenize(render(messages, template, generate=generate))


def sft_tokenize(df: DataFrame, messages: str = "messages", tokenize: Tokenize = hashed_ids, template: str = "tags") -> DataFrame:
    """``input_ids_prompt, input_ids, attention_mask, labels``: the prompt is all but the last message (or the only one)."""
    m = F.col(messages)
    prompt, _ = prompt_and_last(m)
    out = df.withColumns({"input_ids_prompt": _encoded(prompt, tokenize, template, True), "input_ids": _encoded(m, tokenize, template)})
    return out.withColumns({"attention_mask": ones(F.col("input_ids")), "labels": F.col("input_ids")})


def sft_tokenize_masked(df: DataFrame, messages: str = "messages", tokenize: Tokenize = hashed_ids, template: str = "tags") -> DataFrame:
    """As :func:`sft_tokenize`, with as many leading labels masked as the prompt has ids."""
    out = sft_tokenize(df, messages, tokenize, template)
    n = F.size("input_ids_prompt")
    return out.withColumn("labels", F.transform("input_ids", lambda x, i: F.when(i < n, F.lit(MASKED)).otherwise(x)))


def sft_truncate(df: DataFrame, max_length: int, messages: str = "messages", tokenize: Tokenize = hashed_ids, last_only: bool = False) -> DataFrame:
    """``input_ids, labels, attention_mask`` cut at ``max_length``: only answers (or only the last one) keep labels."""
    pair = turn_labels(F.col(messages), tokenize, max_length, last_only)
    out = df.withColumn("input_ids", pair["input_ids"]).withColumn("labels", pair["labels"])
    return out.withColumn("attention_mask", ones(F.col("input_ids")))


def sft_filter(df: DataFrame, max_prompt: int | None = None, max_length: int | None = None, need_labels: bool = True) -> DataFrame:
    labels = F.col("labels") if need_labels else None
    return df.where(within_limits(F.col("input_ids_prompt") if max_prompt is not None else F.col("input_ids"), F.col("input_ids"), max_prompt, max_length, labels))


def has_labels(df: DataFrame) -> DataFrame:
    return df.where(any_label(F.col("labels")))


def preference_tokenize(df: DataFrame, tokenize: Tokenize = hashed_ids, template: str = "tags") -> DataFrame:
    """Ids and masks of the prompt (all but the last chosen message), of ``chosen`` and of ``rejected``."""
    prompt = F.slice("chosen", 1, F.greatest(F.size("chosen") - 1, F.lit(0)))
    parts = {"": (prompt, True), "chosen_": (F.col("chosen"), False), "rejected_": (F.col("rejected"), False)}
    ids = {f"{k}input_ids{'' if k else '_prompt'}": _encoded(m, tokenize, template, g) for k, (m, g) in parts.items()}
    out = df.withColumns(ids)
    return out.withColumns({n.replace("input_ids", "attention_mask"): ones(F.col(n)) for n in ids})


def preference_filter(df: DataFrame, max_prompt: int | None = None, max_length: int | None = None) -> DataFrame:
    """Rows whose prompt and both answers are within their limits."""
    ok = F.lit(True)
    if max_prompt is not None:
        ok = ok & (F.size("input_ids_prompt") <= max_prompt)
    if max_length is not None:
        ok = ok & (F.size("chosen_input_ids") <= max_length) & (F.size("rejected_input_ids") <= max_length)
    return df.where(ok)


def preference_truncate(df: DataFrame, max_length: int, tokenize: Tokenize = hashed_ids, last_only: bool = True) -> DataFrame:
    """Ids, labels and masks of both answers cut at ``max_length``; an empty side raises. Labels on the last turn only
    unless told otherwise."""
    for side in ("chosen", "rejected"):
        full = F.when(F.size(side) > 0, F.col(side)).otherwise(F.raise_error(F.lit(f"{side} has no messages")))
        pair = turn_labels(full, tokenize, max_length, last_only)
        df = df.withColumn(f"{side}_input_ids", pair["input_ids"]).withColumn(f"{side}_labels", pair["labels"])
        df = df.withColumn(f"{side}_attention_mask", ones(F.col(f"{side}_input_ids")))
    return df


def preference_has_labels(df: DataFrame) -> DataFrame:
    return df.where(any_label(F.col("chosen_labels")) & any_label(F.col("rejected_labels")))


def rlvr_tokenize(
    df: DataFrame, messages: str = "messages", truth: str = "ground_truth", source: str = "dataset", tokenize: Tokenize = hashed_ids,
    template: str = "tags", pad: int | None = None, system: str | None = None,
) -> DataFrame:
    """``input_ids_prompt, input_ids, attention_mask, labels, ground_truth, dataset, prompt`` of verifiable rows.

    Pad ids are taken out of the ids, scalar labels and names of verifiers become lists of one, and the prompt stays as
    text. ``system`` takes the place of the system message.
    """
    m = system_override(F.col(messages), system) if system is not None else F.col(messages)
    prompt = F.when(F.size(m) > 1, F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(1)))).otherwise(m)
    bare = (lambda ids: F.array_remove(ids, F.lit(pad))) if pad is not None else (lambda ids: ids)
    kinds = dict(df.dtypes)
    wrapped = lambda c: F.col(c) if kinds[c].startswith("array") else F.array(c)
    out = df.withColumns(
        {
            "input_ids_prompt": bare(_encoded(prompt, tokenize, template, True)), "input_ids": bare(_encoded(m, tokenize, template)),
            "ground_truth": wrapped(truth), "dataset": wrapped(source), "prompt": raw_prompt(prompt),
        }
    )
    return out.withColumns({"attention_mask": ones(F.col("input_ids")), "labels": F.col("input_ids")})


def rlvr_filter(df: DataFrame, max_prompt: int | None = None, max_length: int | None = None, need_labels: bool = True) -> DataFrame:
    """The full filter of verifiable rows: both limits and a trainable label."""
    return df.where(within_limits(F.col("input_ids_prompt"), F.col("input_ids"), max_prompt, max_length, F.col("labels") if need_labels else None))


def rlvr_max_prompt(df: DataFrame, max_prompt: int | None = None) -> DataFrame:
    """The filter of verifiable rows by the length of the prompt alone."""
    return df if max_prompt is None else df.where(F.size("input_ids_prompt") <= max_prompt)


#: Names as data configurations list them, and what runs. Names of older versions run the newer functions.
TRANSFORMS: dict[str, Callable[..., DataFrame]] = {
    "sft_tokenize_v1": sft_tokenize,
    "sft_tokenize_mask_out_prompt_v1": sft_tokenize_masked,
    "sft_filter_v1": sft_filter,
    "sft_tulu_tokenize_and_truncate_v1": sft_truncate,
    "sft_tulu_filter_v1": has_labels,
    "preference_tokenize_v1": preference_tokenize,
    "preference_filter_v1": preference_filter,
    "preference_tulu_tokenize_and_truncate_v1": preference_truncate,
    "preference_tulu_filter_v1": preference_has_labels,
    "rlvr_tokenize_v1": rlvr_tokenize,
    "rlvr_max_length_filter_v1": rlvr_max_prompt,
}

#: Columns that stay beside the target columns where a table has them.
PRESERVED = ["dataset_source", "tools", "env_config"]


def run_transforms(df: DataFrame, names: list[str], options: list[dict] | None = None, target: list[str] | None = None, index: str | None = None) -> DataFrame:
    """Apply transforms in order, keep the target columns and :data:`PRESERVED` ones; an empty result raises.

    ``index`` names an integer column along which rows get a gapless ``index`` from 0.
    """
    steps = list(zip(names, options or [{}] * len(names), strict=True))
    unknown = [n for n in names if n not in TRANSFORMS]
    if unknown:
        raise ValueError(f"unknown transforms {unknown}")
    out = reduce(lambda d, s: TRANSFORMS[s[0]](d, **s[1]), steps, df)
    if target is not None:
        keep = [*target, *(c for c in PRESERVED if c in out.columns and c not in target)]
        out = out.select(*keep, *([index] if index and index not in keep else []))
    if out.isEmpty():
        raise ValueError("no row is left after the transforms")
    if index:
        from curata.operators.mixing import numbered

        out = numbered(out, index)
    return out


def config_hash(names: list[str], options: list[dict] | None = None, seed: int = 42) -> str:
    """A name for what a list of transforms gives, to tell results of earlier runs apart."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps([names, options or [], seed], sort_keys=True).encode()).hexdigest()[:10]
