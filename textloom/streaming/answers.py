"""Model answers that arrive late and out of order, gathered per document until it can be settled."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.structure import read_answers, with_levels

SETTLED = "doc_id long, outcome string, found string"


def arrivals(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions (doc_id, at, n_batches) and answers (doc_id, at, batch, response) as rows of one stream; null ids go."""
    line = lambda e: F.substring(e.key, 2, 20).try_cast("int")
    named = F.transform(F.map_entries("parsed"), lambda e: F.struct(line(e).alias("line"), e.value.level.alias("level")))
    lines = F.to_json(F.filter(named, lambda e: e.line.isNotNull()))
    told = read_answers(answers).select("doc_id", "at", F.lit(None).cast("int").alias("n_batches"), F.col("batch").cast("int").alias("batch"), F.col("error").isNotNull().alias("bad"), lines.alias("lines"))
    none = [F.lit(None).cast(t).alias(name) for name, t in (("batch", "int"), ("bad", "boolean"), ("lines", "string"))]
    return asked.select("doc_id", "at", F.col("n_batches").cast("int").alias("n_batches"), *none).unionByName(told).where("doc_id is not null and at is not null")


def judged(held: dict, wait_ms: int) -> str | None:
    """What a document's state says: null while answers are missing."""
    if held["asked"] is None:
        return None
    told = [a for a in held["answers"] if a["at"] <= held["asked"] + wait_ms]
    if any(a["bad"] for a in told):
        return "bad"
    return "answered" if len({a["batch"] for a in told}) >= held["n"] else None


def levels_of(held: dict, wait_ms: int) -> dict[int, int | None]:
    """Of several levels for a line that of the last batch, within a batch the largest."""
    best: dict[int, tuple] = {}
    for a in held["answers"]:
        if a["at"] <= held["asked"] + wait_ms:
            for x in a["lines"]:
                level = x.get("level")
                best[x["line"]] = max(best.get(x["line"], (-1,)), (a["batch"], level is not None, level or 0))
    return {line: b[2] if b[1] else None for line, b in best.items()}


def settled(asked: DataFrame, answers: DataFrame, wait_seconds: int = 3600, late_seconds: int = 0) -> DataFrame:
    """A stream of (doc_id, outcome, levels): every document asked about, once.

    ``answered``: all its batches were answered within ``wait_seconds`` of the question; ``levels`` are theirs, later
    batches first. ``bad``: one answer couldn't be read. ``late``: the time is over. The last two have null levels, so
    that the heuristic decides. Times are event times (``at``), and the watermark is ``late_seconds`` behind the latest, so
    that a rerun settles alike. Answers before their question wait for it; answers to nothing go when their time is over.
    Rows with a null id or time go, as do rows no later than the watermark, which starts at 1970. A settled document is remembered until its time is over, so repeated answers change nothing.
    """
    wait = wait_seconds * 1000

    def gather(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"asked": None, "n": 0, "answers": [], "done": False}
        for frame in () if state.hasTimedOut else frames:
            for r in frame.to_dict("records"):
                at = int(r["at"].timestamp() * 1000)
                if pd.isna(r["bad"]):
                    if held["asked"] is None:
                        held |= {"asked": at, "n": int(r["n_batches"])}
                else:
                    held["answers"].append({"at": at, "batch": int(r["batch"]), "bad": bool(r["bad"]), "lines": json.loads(r["lines"] or "[]")})
        outcome = None if held["done"] else judged(held, wait)
        start = held["asked"] if held["asked"] is not None else max((a["at"] for a in held["answers"]), default=0)
        over = state.hasTimedOut or start + wait <= state.getCurrentWatermarkMs()
        if over and not held["done"] and held["asked"] is not None:
            outcome = outcome or "late"
        if outcome:
            found = levels_of(held, wait) if outcome == "answered" else {}
            rows = json.dumps([{"line": line, "level": level} for line, level in found.items()])
            yield pd.DataFrame({"doc_id": [key[0]], "outcome": [outcome], "found": [rows]})
            held |= {"answers": [], "done": True}
        if over:
            state.remove()
        else:
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(start + wait)

    timed = arrivals(asked, answers).withWatermark("at", f"{late_seconds} seconds")
    out = timed.groupBy("doc_id").applyInPandasWithState(gather, SETTLED, "held string", "append", GroupStateTimeout.EventTimeTimeout)
    levels = F.when(F.col("outcome") == "answered", F.map_from_entries(F.from_json("found", "array<struct<line: int, level: int>>")))
    return out.select("doc_id", "outcome", levels.alias("levels"))


def recovered_stream(docs: DataFrame, asked: DataFrame, answers: DataFrame, wait_seconds: int = 3600, late_seconds: int = 0) -> DataFrame:
    """The rows of ``docs`` (a table) with their headings' levels, each as soon as it is settled."""
    return with_levels(settled(asked, answers, wait_seconds, late_seconds).drop("outcome").join(docs, "doc_id")).select(*docs.columns)
