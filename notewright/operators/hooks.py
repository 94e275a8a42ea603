"""Hooks for models outside the engine: parsers, recognisers, generators. Failures become rows, never lost work."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.operators.replies import tolerant_json


class Generator(Protocol):
    """Prompts to replies, in order."""

    def generate(self, prompts: list[str], max_tokens: int) -> list[str]: ...


class Recogniser(Protocol):
    """An image's bytes to text and confidence."""

    def recognize(self, image: bytes) -> tuple[str, float]: ...


class Parser(Protocol):
    """A document's bytes to blocks (dicts with text, role, bbox)."""

    def is_available(self) -> bool: ...

    def parse(self, content: bytes) -> list[dict]: ...


class LineParser:
    """A stand-in parser: the non-empty lines of UTF-8 text are its blocks."""

    def is_available(self) -> bool:
        return True

    def parse(self, content: bytes) -> list[dict]:
        lines = (x.strip(" \t\n\v\f\r") for x in content.decode("utf-8", "replace").split("\n"))
        return [{"text": x, "role": "body"} for x in lines if x]


class BrokenParser(LineParser):
    """A stand-in for a parser that fails on every document."""

    def parse(self, content: bytes) -> list[dict]:
        raise ValueError("not a document of this kind")


class EchoGenerator:
    """A stand-in without a model: replies with one mention that quotes the prompt's first words."""

    def generate(self, prompts: list[str], max_tokens: int) -> list[str]:
        return [json.dumps({"mentions": [{"category": "note", "label": "head", "value": " ".join(p.split()[:5])}]}) for p in prompts]


class FixedVerdict:
    """A stand-in for a validating model: one verdict for every record."""

    def generate(self, prompts: list[str], max_tokens: int) -> list[str]:
        return [json.dumps({"confidence": 0.5, "flags": ["model"], "notes": p}) for p in prompts]


def strip_reply(c: Column) -> Column:
    """Stage one of loose JSON: fences, tags, a speaker's name and trailing commas go."""
    t = F.regexp_replace(c, r"(?i)```(?:json)?|</?json>", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?is)^\s*(?:assistant|answer)\s*:\s*", ""), r",\s*([}\]])", "$1")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def balanced_parts(text: str) -> Iterator[str]:
    """Every outermost balanced {...} or [...] of a text, strings respected; a closer of the other kind closes nothing."""
    opened, start, quoted, escape = [], -1, False, False
    for i, ch in enumerate(text):
        if quoted:
            escape = ch == "\\" and not escape
            if ch == '"' and not escape:
                quoted = False
            continue
        if ch == '"' and opened:
            quoted = True
        elif ch in "{[":
            if not opened:
                start = i
            opened.append("}" if ch == "{" else "]")
        elif opened and ch == opened[-1]:
            opened.pop()
            if not opened:
                yield text[start : i + 1]


def loose_json(text: str | None):
    """The first object or list of a reply: the whole if it parses, then each balanced part, then whatever a tolerant
    reader makes of each part and of the text from its first brace on. Linear in the text."""
    bare = re.sub(r",\s*([}\]])", r"\1", re.sub(r"(?i)```(?:json)?|</?json>", "", text or "")).strip()
    parts = list(balanced_parts(bare))
    for part in [bare, *parts]:
        try:
            value = json.loads(part)
        except (ValueError, RecursionError):
            continue
        if isinstance(value, (dict, list)):
            return value
    for part in [*parts, bare]:
        value = tolerant_json(part)
        if value:
            return value
    return None


def parse_replies(replies: DataFrame, key: str, reply: str) -> DataFrame:
    """(key, parsed): the reply as JSON text, or null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values = [loose_json(x) for x in b["reply"]]
            yield pd.DataFrame({"key": b["key"], "parsed": [None if v is None else json.dumps(v, sort_keys=True) for v in values]})

    return replies.select(F.col(key).cast("string").alias("key"), F.col(reply).alias("reply")).mapInPandas(run, "key string, parsed string")


REPLY = "struct<mentions:array<struct<category:string,label:string,value:string,normalized_value:string,date_text:string,certainty:string,evidence_quote:string>>>"


def clean_replies(replies: DataFrame, keys: list[str], reply: str, note_date: str) -> DataFrame:
    """Mentions of model replies: nothing without value and label, defaults filled, unknown certainty words mapped,
    the note's date where none is given."""
    nz = lambda c: F.nullif(F.trim(c), F.lit(""))
    m = replies.select(*keys, note_date, F.explode(F.from_json(strip_reply(F.col(reply)), REPLY)["mentions"]).alias("m")).select(*keys, note_date, "m.*")
    m = m.where(nz(F.col("value")).isNotNull() | nz(F.col("label")).isNotNull())
    sure = F.lower(F.col("certainty"))
    return m.select(
        *keys,
        F.coalesce(nz(F.col("category")), F.lit("unknown")).alias("category"), F.coalesce(F.col("label"), F.lit("")).alias("label"),
        F.coalesce(nz(F.col("value")), F.col("label")).alias("value"),
        F.coalesce(nz(F.col("normalized_value")), nz(F.col("value")), F.col("label")).alias("normalized_value"),
        F.coalesce(nz(F.col("date_text")), F.col(note_date), F.lit("")).alias("date_text"),
        F.when(sure.isin("confirmed", "possible", "ruled_out", "unknown"), sure).otherwise("unknown").alias("certainty"),
        F.left(F.coalesce(F.col("evidence_quote"), F.lit("")), F.lit(240)).alias("evidence_quote"),
    )


def _in_groups(model: Generator, prompts: list[str], tokens: list[int], size: int) -> list[str | Exception]:
    """Replies of neighbouring prompts of one budget, ``size`` at a call; a group that fails is asked one by one."""
    out: list[str | Exception] = []
    for budget, group in groupby(range(len(prompts)), key=lambda i: tokens[i]):
        rows = list(group)
        for at in range(0, len(rows), size):
            part = [prompts[i] for i in rows[at : at + size]]
            try:
                replies = list(model.generate(part, budget))
                if len(replies) != len(part):
                    raise ValueError(f"{len(replies)} replies to {len(part)} prompts")
                out += replies
            except Exception as e:  # a model may raise anything; the row carries it
                out += [e] if len(part) == 1 else _in_groups(model, part, [budget] * len(part), 1)
    return out


def run_generator(batches: DataFrame, make: Callable[[], Generator], key: str, prompt: str, budget: str, size: int = 1) -> DataFrame:
    """(key, reply, error): one attempt, ``size`` prompts at a call, a second alone with half as many tokens again if the
    reply is no JSON; an exception becomes the row's error. The generator is made once in each task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in parts:
            tokens = [int(x) for x in b["budget"]]
            replies, errors = [], []
            for text, n, reply in zip(b["prompt"], tokens, _in_groups(model, list(b["prompt"]), tokens, size)):
                if isinstance(reply, str) and loose_json(reply) is None:
                    reply = _in_groups(model, [text], [n * 3 // 2], 1)[0]
                failed = isinstance(reply, Exception)
                replies.append(None if failed else reply)
                errors.append(f"{type(reply).__name__}: {reply}"[:300] if failed else None if loose_json(reply) is not None else "no JSON in the reply")
            yield pd.DataFrame({"key": b["key"], "reply": replies, "error": errors})

    source = batches.select(F.col(key).cast("string").alias("key"), F.col(prompt).alias("prompt"), F.col(budget).alias("budget"))
    return source.mapInPandas(run, "key string, reply string, error string")


def parse_documents(files: DataFrame, makes: list[Callable[[], Parser]], key: str, content: str, rows: int = 10_000) -> DataFrame:
    """(key, reading_order, role, text, bbox, error): the blocks of the first parser at hand that finds any, from one on.
    A document without blocks is one row, with the errors of the parsers that failed on it, if any. Parsers are made once
    in each task; rows leave in batches of about ``rows``."""
    names = ["key", "reading_order", "role", "text", "bbox", "error"]

    def blocks_of(parsers: list[Parser], x: bytes) -> tuple[list[dict], str | None]:
        errors = []
        for parser in parsers:
            try:
                blocks = parser.parse(x)
            except Exception as e:
                errors.append(f"{type(e).__name__}: {e}"[:300])
                continue
            if blocks:
                return blocks, None
        return [], " | ".join(errors) or None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsers = [p for p in (make() for make in makes) if p.is_available()]
        out: list[tuple] = []
        for b in parts:
            for k, x in zip(b["key"], b["content"]):
                blocks, error = blocks_of(parsers, b"" if x is None else bytes(x))
                out += [(k, i, y.get("role"), y.get("text"), y.get("bbox"), None) for i, y in enumerate(blocks, 1)] or [(k, None, None, None, None, error)]
                if len(out) >= rows:
                    yield pd.DataFrame(out, columns=names).astype({"reading_order": "Int32"})
                    out = []
        if out:
            yield pd.DataFrame(out, columns=names).astype({"reading_order": "Int32"})

    source = files.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content"))
    return source.mapInPandas(run, "key string, reading_order int, role string, text string, bbox array<double>, error string")


def validate_records(records: DataFrame, models: list[tuple[str, Callable[[], Generator]]], key: str, prompt: str, max_tokens: int = 512) -> DataFrame:
    """(key, model, status, confidence, flags, missing, notes): the first model whose reply is a JSON object with one of
    confidence, flags, missing_categories and notes adds its verdict to the record's own flags, confidence and missing.

    A model that fails once is not asked again in the task. If all fail, the record's own verdict stays, with a flag."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[str, Generator] = {}
        failed: set[str] = set()
        for b in parts:
            out = []
            for k, text, own, sure, missing in zip(b["key"], b["prompt"], b["flags"], b["confidence"], b["missing"]):
                own, missing, errors, row = list(own) if own is not None else [], list(missing) if missing is not None else [], [], None
                for name, make in models:
                    if name in failed or row:
                        continue
                    try:
                        model = made.setdefault(name, None) or make()
                        made[name] = model
                        reply = model.generate([text], max_tokens)[0]
                        got = loose_json(reply)
                        if not isinstance(got, dict) or not {"confidence", "flags", "missing_categories", "notes"} & set(got):
                            raise ValueError(f"no verdict in the reply: {reply}"[:300])
                        flags = sorted({*own, *map(str, got.get("flags") or [])})
                        row = (k, name, "completed", float(got.get("confidence", sure)), flags, list(map(str, got.get("missing_categories") or missing)), str(got.get("notes", reply))[:1000])
                    except Exception as e:
                        failed.add(name)
                        errors.append(f"{name}: {e}")
                out.append(row or (k, models[0][0] if models else None, "failed", sure, sorted({*own, "validation_model_failed"}), missing, " | ".join(errors[-3:])))
            yield pd.DataFrame(out, columns=["key", "model", "status", "confidence", "flags", "missing", "notes"])

    source = records.select(F.col(key).cast("string").alias("key"), F.col(prompt).alias("prompt"), "flags", F.col("confidence").cast("double").alias("confidence"), "missing")
    return source.mapInPandas(run, "key string, model string, status string, confidence double, flags array<string>, missing array<string>, notes string")


class PlainRecogniser:
    """Reads images that are UTF-8 text; a stand-in for a reader of images. Longer texts are surer."""

    def recognize(self, image: bytes) -> tuple[str, float]:
        text = image.decode("utf-8")
        if not text.strip():
            raise ValueError("an empty image")
        return text, 0.9 if len(text) > 200 else 0.5


def recognise(images: DataFrame, make: Callable[[], Recogniser], key: str, content: str) -> DataFrame:
    """(key, text, confidence, error) for each image. One reader serves a task; an image that it can't read, a null one
    too, is a row with the error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in parts:
            rows = []
            for k, x in zip(b["key"], b["content"]):
                try:
                    if x is None:
                        raise ValueError("no image")
                    text, sure = model.recognize(bytes(x))
                    rows.append((k, text, float(sure), None))
                except Exception as e:
                    rows.append((k, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["key", "text", "confidence", "error"])

    source = images.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content"))
    return source.mapInPandas(run, "key string, text string, confidence double, error string")


def better_text(native: Column, read: Column) -> Column:
    """A read text replaces the native one only if it is longer."""
    return F.when(F.length(F.coalesce(read, F.lit(""))) > F.length(F.coalesce(native, F.lit(""))), read).otherwise(native)


def merge_votes(candidates: Column, most: int = 12) -> Column:
    """Candidates (drug, dose, score) in order to one row per drug, its name in any case: the nth vote adds 4 (n - 1), 100
    at most. A vote with a dose replaces one without and keeps the greater score; else the greater score stays. The best
    ``most``, sorted by score, then drug."""
    start = F.expr("map()").cast("map<string,struct<n:int,drug:string,score:int,dose:string>>")

    def step(m: Column, x: Column) -> Column:
        key = F.lower(x["drug"])
        old = F.try_element_at(m, key)
        n = F.coalesce(old["n"], F.lit(0)) + 1
        score = F.least(F.lit(100), x["score"] + 4 * (n - 1)).cast("int")
        dosed = lambda d: F.coalesce(d, F.lit("")) != ""
        row = lambda drug, s, d: F.struct(n.cast("int").alias("n"), drug.alias("drug"), s.cast("int").alias("score"), d.alias("dose"))
        taken = row(x["drug"], score, x["dose"])
        new = (
            F.when(old.isNull(), taken)
            .when(dosed(x["dose"]) & ~dosed(old["dose"]), row(x["drug"], F.greatest(score, old["score"]), x["dose"]))
            .when(score > old["score"], taken)
            .otherwise(row(old["drug"], old["score"], old["dose"]))
        )
        kept = F.when(F.coalesce(x["drug"], F.lit("")) == "", m)
        return kept.otherwise(F.map_concat(F.map_filter(m, lambda k, v: k != key), F.create_map(F.coalesce(key, F.lit("")), new)))

    entries = lambda m: F.slice(F.array_sort(F.transform(F.map_values(m), lambda v: F.struct((-v["score"]).alias("o"), v["drug"].alias("drug"), v["score"].alias("score"), v["dose"].alias("dose")))), 1, most)
    return F.transform(F.aggregate(candidates, start, step, entries), lambda e: F.struct(e["drug"].alias("drug"), e["score"].alias("score"), e["dose"].alias("dose")))
