"""Batches of notes for a model: numbered over the whole table, sent one call a batch, what fails sent again alone."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.functions import scores
from notewright.operators.hooks import Generator, loose_json
from notewright.operators.skew import exact_ranks, kept

#: The budget of a second try, and how an error says that it is worth waiting.
RETRY_BUDGET = 1536
WAIT_SIGN = r"(?i)\b429\b|try again in|rate limit"
FIRST = "batch_no long, key string, prompt string, size int, reply string, error string"


def global_batches(notes: DataFrame, words: str, key: str, partitions: int | None = None) -> DataFrame:
    """``notes`` with bucket, batch_no and batch_place: all notes by length bucket, shortest first, in batches of the bucket's
    limit; a batch holds one bucket only, and numbers run on from bucket to bucket.

    Ranks are exact over the whole table, yet no task holds a bucket. Equal ``words`` go by ``key``.
    """
    bucketed = notes.withColumn("bucket", scores.length_bucket(F.col(words))).withColumn("__order", scores.bucket_rank(F.col("bucket")))
    ranked = exact_ranks(bucketed, "__order", [words, key], "__rank", partitions)
    limit = scores.batch_limit(F.col("bucket"))
    sizes = bucketed.groupBy("__order", "bucket").agg(F.ceil(F.count("*") / F.max(limit)).alias("n"))  # four rows
    before = sizes.alias("a").join(F.broadcast(sizes.alias("b")), F.col("b.__order") < F.col("a.__order"), "left")
    starts = before.groupBy(F.col("a.__order").alias("__order")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("__start"))
    out = ranked.join(F.broadcast(starts), "__order")
    return out.withColumns(
        {"batch_no": (F.col("__start") + F.floor(F.col("__rank") / limit)).cast("long"), "batch_place": (F.col("__rank") % limit).cast("int")}
    ).drop("__order", "__rank", "__start")


def _runs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of sorted parts, one frame a batch number, also where a batch goes on in the next part."""
    held: list[pd.DataFrame] = []
    for part in parts:
        for number, rows in part.groupby("batch_no", sort=False):
            if held and held[0]["batch_no"].iloc[0] != number:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(rows)
    if held:
        yield pd.concat(held, ignore_index=True)


def _error(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:300]


def _judged(replies: list) -> list[str | None]:
    return [None if loose_json(x) is not None else "no JSON in the reply" for x in replies]


def ask_batches(
    notes: DataFrame, make: Callable[[], Generator], key: str, prompt: str, budget: str, retry_budget: int = RETRY_BUDGET, pause: Callable[[float], None] = time.sleep
) -> DataFrame:
    """(batch_no, key, size, reply, error, retried, retry_error, wait) of ``notes`` with batch_no and batch_place.

    Every batch is one call, wherever its rows were. A call that fails gives rows with its error; those and the rows
    whose reply holds no JSON are asked once more, each alone with ``retry_budget`` tokens, after ``wait`` seconds where
    the error asks for patience. Replies of the first pass are kept in the checkpoint folder before the second reads
    them, so a lost executor does not make the model answer twice. ``size`` is the number of prompts of the first call.
    """
    source = notes.select(F.col("batch_no").cast("long").alias("batch_no"), "batch_place", F.col(key).cast("string").alias("key"), F.col(prompt).alias("prompt"), F.col(budget).cast("int").alias("budget"))

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for rows in _runs(parts):
            prompts = list(rows["prompt"])
            try:
                replies = list(model.generate(prompts, int(rows["budget"].max())))
                if len(replies) != len(prompts):
                    raise ValueError(f"{len(replies)} replies to {len(prompts)} prompts")
                errors = _judged(replies)
            except Exception as e:  # a model may raise anything; the rows carry it
                replies, errors = [None] * len(prompts), [_error(e)] * len(prompts)
            yield pd.DataFrame({"batch_no": rows["batch_no"], "key": rows["key"], "prompt": prompts, "size": len(prompts), "reply": replies, "error": errors})

    def alone(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for part in parts:
            replies, errors = [], []
            for text, wait in zip(part["prompt"], part["wait"]):
                if wait > 0:
                    pause(float(wait))
                try:
                    replies.append(model.generate([text], retry_budget)[0])
                    errors.append(_judged(replies[-1:])[0])
                except Exception as e:
                    replies.append(None)
                    errors.append(_error(e))
            yield part.assign(reply=replies, retry_error=errors).drop(columns="prompt")

    first = kept(source.repartition("batch_no").sortWithinPartitions("batch_no", "batch_place").mapInPandas(ask, FIRST))
    wait = F.when(F.col("error").rlike(WAIT_SIGN), scores.retry_delay(F.lit(0), F.lit(None), F.col("error"))).otherwise(F.lit(0.0))
    again = first.where("error is not null").select("batch_no", "key", "prompt", "size", "error", wait.alias("wait"))
    second = again.mapInPandas(alone, "batch_no long, key string, size int, error string, wait double, reply string, retry_error string")
    columns = ["batch_no", "key", "size", "reply", "error"]
    done = first.where("error is null").select(*columns, F.lit(False).alias("retried"), F.lit(None).cast("string").alias("retry_error"), F.lit(0.0).alias("wait"))
    return done.unionByName(second.select(*columns, F.lit(True).alias("retried"), "retry_error", "wait"))


class StrainedGenerator:
    """A stand-in for a model with limits: batches with a busy prompt are refused, long prompts need a large budget."""

    def generate(self, prompts: list[str], max_tokens: int) -> list[str]:
        if len(prompts) > 1 and any(p.startswith("BUSY") for p in prompts):
            raise RuntimeError("429 rate limit: try again in 1.5s")
        return ['{"mentions": []}' if len(p) <= max_tokens else "no answer" for p in prompts]


def no_pause(seconds: float) -> None:
    """Waits for nothing: for stand-ins."""
