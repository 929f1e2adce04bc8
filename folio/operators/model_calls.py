"""Calls of a model from inside tasks: bounded, in order, with a second attempt, each failure alone.

A call is a function of a payload and the attempt's number (from 0) that returns
the answer's text or raises.  Every task keeps at most ``most_open`` calls open,
whatever the size of its partition, and gives its rows in the order in which they
came; answers that wait for an earlier one are as many at most.  An answer that
the check refuses is asked for once more; an exception is not.

Defined cases: a row without a payload is not asked and has neither answer nor
error; repeated rows are asked each; columns of the input named like a result
are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators import roles as R

MOST_OPEN, ATTEMPTS = 50, 2
MADE = ("answer", "call_error", "attempts", "latency_ms")
Call = Callable[[str, int], str]
#: Tells what is wrong with an answer to a payload, or gives None.
Check = Callable[[str, str], str | None]


def check_decision(payload: str, answer: str) -> str | None:
    """The code of what keeps an answer from being a role decision, by the rules of ``roles.parse_decision``."""
    text = re.sub(r"(?is)<think>.*?</think>", "", answer or "").strip()
    if fenced := re.search(r"(?is)```(?:json)?\s*(.*?)\s*```", text):
        text = fenced[1]
    try:
        found = json.loads(text[text.index("{") :] if "{" in text else text)
    except ValueError:
        return "invalid_json"
    if not isinstance(found, dict):
        return "invalid_json"
    confidence, level, domain = found.get("role_confidence"), found.get("generated_role_level"), found.get("domain_role")
    fits = (
        set(found) <= set(R.DECISION_KEYS)
        and found.get("generic_role") in R.DOMAINS
        and (domain is None or any(domain in allowed for allowed in R.DOMAINS.values()))
        and isinstance(confidence, (int, float))
        and 0 <= confidence <= 1
        and found.get("block_id") == json.loads(payload).get("block_id")
        and (level is None or str(level).strip().lower() in R.LEVELS)
    )
    return None if fits else "schema_mismatch"


def _resolve(payload: str | None, call: Call, check: Check, attempts: int) -> tuple[str | None, str | None, int, int]:
    """Answer (the last one that came), error code, attempts made and milliseconds of one row."""
    if payload is None:
        return None, None, 0, 0
    answer = error = None
    began = time.perf_counter()
    made = 0
    for attempt in range(attempts):
        made = attempt + 1
        try:
            answer = call(payload, attempt)
        except Exception:
            answer, error = None, "backend_error"
            break
        error = check(payload, answer)
        if error is None:
            break
    return answer, error, made, int((time.perf_counter() - began) * 1000)


def ask(rows: DataFrame, call: Call, check: Check = check_decision, payload: str = "payload", most_open: int = MOST_OPEN, attempts: int = ATTEMPTS) -> DataFrame:
    """``rows`` with answer, call_error, attempts and latency_ms."""
    kept = [c for c in rows.columns if c not in MADE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(most_open) as pool:
            waiting: deque = deque()
            for batch in batches:
                done = []
                for one in batch.column(payload).to_pylist():
                    if len(waiting) == most_open:
                        done.append(waiting.popleft().result())
                    waiting.append(pool.submit(_resolve, one, call, check, attempts))
                done += [w.result() for w in waiting]
                waiting.clear()
                columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [()] * 4, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=[*kept, *MADE])

    schema = rows.select(*kept).schema.add("answer", "string").add("call_error", "string").add("attempts", "integer").add("latency_ms", "long")
    return rows.select(*kept).mapInArrow(run, schema)


def decide(blocks: DataFrame, call: Call, most_open: int = MOST_OPEN) -> DataFrame:
    """The semantic run over blocks (block_id, payload, eligible, quality and what is kept): asked where due, parsed, gated.

    Blocks that aren't eligible or lie on a page of low quality are not asked.
    Gives the columns of ``roles.gate`` with attempts.
    """
    due = F.col("eligible") & (F.col("quality") >= R.QUALITY)
    asked = ask(blocks.withColumn("payload", F.when(due, F.col("payload"))), call, most_open=most_open)
    # What was refused has no say, whatever it holds.
    parsed = R.parse_decision(asked.withColumn("answer", F.when(F.col("call_error").isNull(), F.col("answer"))))
    judged = parsed.withColumn("error", F.when(F.col("attempts") > 0, F.coalesce("call_error", "error"))).drop("call_error", "payload", "latency_ms")
    return R.gate(judged)
