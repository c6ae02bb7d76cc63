"""Event streams: progress lines, turn reassembly, sessions, per-host rates, windows.

Every transformation takes a batch or a streaming DataFrame; the batch twin gives the same rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loam.functions.text import truncated_middle
from loam.operators.crawl import DELAY_S, RETRYABLE
from loam.operators.memory import BUDGET, step

PROGRESS = "event string, question_id string, kind string, score int, turns int, elapsed_ms long"


# --- progress


def emit_progress(path: str, **event) -> None:
    """Append one line; a sink that fails never fails the row."""
    try:
        with open(path, "a", encoding="utf-8") as f:
            f.write(json.dumps(event, ensure_ascii=False) + "\n")
    except OSError:
        pass


def progress_lines(spark: SparkSession, folder: str, stream: bool = True) -> DataFrame:
    """Progress events of a folder of JSON lines; torn and foreign lines are left out, a score that is no integer is null."""
    reader = spark.readStream if stream else spark.read
    lines = reader.schema("value string").text(folder)
    parsed = F.from_json("value", "event string, question_id string, kind string, score string, turns int, elapsed_ms long")
    rows = lines.select(parsed.alias("e")).where(F.col("e.event") == "row_done").select("e.*")
    return rows.withColumn("score", F.when(F.col("score").rlike(r"^-?\d+$"), F.col("score").try_cast("int"))).select(*[c.split()[0] for c in PROGRESS.split(", ")])


def progress(events: DataFrame) -> DataFrame:
    """Rows done, mean of the scored ones, those without a score."""
    return events.agg(F.count(F.lit(1)).alias("done"), F.coalesce(F.round(F.avg("score"), 6), F.lit(0.0)).alias("mean"), F.count_if(F.col("score").isNull()).alias("unscored"), F.sum("elapsed_ms").alias("elapsed_ms"))


def eta_seconds(done: Column, total: int, elapsed_s: Column) -> Column:
    return F.when(done > 0, elapsed_s / done * (F.lit(total) - done))


def for_each_row(df: DataFrame, on_row: Callable[[dict], None]):
    """Call ``on_row`` for the rows of each micro-batch, one after the other as they reach the driver: a listener lives there."""

    def batch(rows: DataFrame, _: int) -> None:
        for row in rows.toLocalIterator():
            on_row(row.asDict(recursive=True))

    return df.writeStream.foreachBatch(batch)


# --- turns


def turns(events: DataFrame) -> DataFrame:
    """Turns from their events ``(turn_id, seq, kind, text)``: deltas in order, the final text, failed without one."""
    deltas = F.array_sort(F.collect_list(F.when(F.col("kind") == "assistant.delta", F.struct("seq", "text"))))
    return events.groupBy("turn_id").agg(
        F.array_join(F.transform(deltas, lambda d: d["text"]), "").alias("streamed"),
        F.max(F.when(F.col("kind") == "assistant.final", F.col("text"))).alias("final"), F.bool_or(F.col("kind") == "assistant.final").alias("finished"),
        F.count_if(F.col("kind") == "tool.call").alias("tool_calls"), F.count_if(F.col("kind") == "error").alias("errors"), F.count(F.lit(1)).alias("events"),
    ).select("turn_id", "streamed", "final", (~F.col("finished")).alias("failed"), "tool_calls", "errors", "events")


def turn_latency(events: DataFrame) -> DataFrame:
    """Milliseconds to the first token and to the end of each turn; ``events(turn_id, kind, ts)``."""
    at = lambda kind, f: f(F.when(F.col("kind") == kind, F.col("ts")))
    ms = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / 1000
    rows = events.groupBy("turn_id").agg(at("start", F.min).alias("s"), at("assistant.delta", F.min).alias("d"), at("assistant.final", F.max).alias("f"))
    return rows.select("turn_id", ms(F.col("d"), F.col("s")).alias("first_token_ms"), ms(F.col("f"), F.col("s")).alias("total_ms"))


def numbered_events(events: DataFrame, channel: str = "turn_id") -> DataFrame:
    """Events with ``seq`` from 1 within their turn or channel, by time, then ``event_id``."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(channel).orderBy("ts", "event_id")))


def turn_metrics(events: DataFrame) -> DataFrame:
    """One row of counts per turn of ``events(turn_id, kind, text, ts)``: tool calls, deltas, errors, characters out, time to the first token and to the end."""
    at = lambda kind, f: f(F.when(F.col("kind") == kind, F.col("ts")))
    count = lambda kind, name: F.count_if(F.col("kind") == kind).alias(name)
    rows = events.groupBy("turn_id").agg(
        count("tool.call", "tool_calls"), count("assistant.delta", "deltas"), count("error", "errors"), F.coalesce(F.max(F.when(F.col("kind") == "assistant.final", F.length("text"))), F.lit(0)).alias("output_chars"),
        F.min("ts").alias("s"), at("assistant.delta", F.min).alias("d"), at("assistant.final", F.max).alias("f"),
    )
    ms = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / 1000
    return rows.select("turn_id", "tool_calls", "deltas", "errors", "output_chars", ms(F.col("d"), F.col("s")).alias("first_token_ms"), ms(F.col("f"), F.col("s")).alias("total_ms"))


def as_events(replies: DataFrame) -> DataFrame:
    """Events of a model that does not stream: ``replies(turn_id, text)`` become one delta and the final text."""
    kinds = F.array(F.struct(F.lit(1).alias("seq"), F.lit("assistant.delta").alias("kind")), F.struct(F.lit(2).alias("seq"), F.lit("assistant.final").alias("kind")))
    return replies.select("turn_id", "text", F.inline(kinds))


def transcription(events: DataFrame) -> DataFrame:
    """``(turn_id, seq, message)``: JSON messages of a transcription channel; what an event lacks is left out."""
    return events.select("turn_id", "seq", F.to_json(F.struct("seq", "kind", F.col("turn_id").cast("string").alias("turn_id"), "text")).alias("message"))


def trace_payload(role: Column, blocks: Column, most: int = 2000) -> Column:
    """A message for a trace, JSON: block texts with a mark for images, long ones cut in the middle. ``blocks ARRAY<STRUCT<kind,text>>``."""
    text = F.array_join(F.transform(blocks, lambda b: F.when(b["kind"] == "image", "[image]").otherwise(F.coalesce(b["text"], F.lit("")))), "\n")
    return F.to_json(F.struct(role.alias("role"), truncated_middle(text, most).alias("content")))


def long_waits(paced_rows: DataFrame, delay_s: float = DELAY_S) -> DataFrame:
    """Requests whose wait is worth a line on the console: over twice the delay."""
    return paced_rows.where(F.col("wait_s") > 2 * delay_s)


def fragments(parts: DataFrame) -> DataFrame:
    """Tool calls from fragments ``(call_id, index, seq, name, arguments)``; arguments that are no JSON object become ``{}``."""
    rows = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("arguments", F.lit("")).alias("a"))))
    text = F.array_join(F.transform(rows, lambda x: x["a"]), "")
    out = parts.groupBy("call_id", "index").agg(F.max("name").alias("name"), text.alias("raw"))
    return out.select("call_id", "index", "name", F.when(F.from_json("raw", "map<string,string>").isNotNull() & F.trim("raw").rlike(r"(?s)^\{.*\}$"), F.col("raw")).otherwise("{}").alias("arguments"))


def sse_frames(chunks: DataFrame) -> DataFrame:
    """Frames of server-sent events from pieces ``(stream_id, seq, data)`` that cut them anywhere; an unfinished last frame waits."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "data")))
    whole = F.replace(F.array_join(F.transform(rows, lambda x: x["data"]), ""), F.lit("\r\n"), F.lit("\n"))
    frames = F.split(whole, "\n\n")
    done = F.slice(frames, 1, F.greatest(F.size(frames) - 1, F.lit(0)))
    text = chunks.groupBy("stream_id").agg(done.alias("frames")).select("stream_id", F.posexplode("frames").alias("frame_no", "frame"))
    data = F.filter(F.split("frame", "\n"), lambda x: F.startswith(x, F.lit("data:")))
    return text.select("stream_id", "frame_no", F.array_join(F.transform(data, lambda x: F.regexp_replace(x, "^data: ?", "")), "\n").alias("data")).where(F.col("data") != "")


def sse_stream(chunks: DataFrame) -> DataFrame:
    """The same over a stream of pieces: what is unfinished waits in the state of its stream for the next batch."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, number = state.get if state.exists else ("", 0)
        text = (held + "".join(pd.concat(list(batches)).sort_values("seq")["data"])).replace("\r\n", "\n")
        # a carriage return at the end may be half of a line end
        tail = "\r" if text.endswith("\r") else ""
        *frames, rest = text.removesuffix("\r").split("\n\n")
        out = []
        for frame in frames:
            data = "\n".join(x[5:].removeprefix(" ") for x in frame.split("\n") if x.startswith("data:"))
            if data:
                out.append((key[0], number, data))
            number += 1
        state.update((rest + tail, number))
        yield pd.DataFrame(out, columns=["stream_id", "frame_no", "data"])

    kind = chunks.schema["stream_id"].dataType.simpleString()
    return chunks.groupBy("stream_id").applyInPandasWithState(run, f"stream_id {kind}, frame_no int, data string", "held string, number int", "append", GroupStateTimeout.NoTimeout)


def sse_frame(payload: Column) -> Column:
    return F.concat(F.lit("data: "), F.to_json(payload), F.lit("\n\n"))


def interrupted(events: DataFrame) -> DataFrame:
    """Turns with ``interrupted``: the next user's words came before the turn's end. ``events(session, turn_id, started, ended)``."""
    following = F.lead("started").over(Window.partitionBy("session").orderBy("started", "turn_id"))
    return events.withColumn("interrupted", following.isNotNull() & (F.col("ended").isNull() | (following < F.col("ended"))))


# --- keyed state


def session_stream(calls: DataFrame, tokens: dict[str, int], budget: int = BUDGET, ttl_ms: int | None = None) -> DataFrame:
    """The session memory over a stream of calls: the same transition as the batch fold, state per session.

    ``ttl_ms`` forgets sessions that stay silent; it keeps a stream going, so leave it out of ``availableNow`` runs.

    ``tokens`` is one knowledge base's catalog. Calls of a batch are taken in ``call_no`` order.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        active = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("call_no")
        out = []
        for call_no, claimed, requested in zip(rows["call_no"], rows["claimed"], rows["requested"]):
            active, d = step(active, list(claimed) if claimed is not None else [], list(requested) if requested is not None else [], tokens, budget)
            out.append((key[0], int(call_no), d["loaded"], d["evicted"], list(active), d["redundant"], d["error_ids"], d["error_reason"]))
        state.update((active,))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=["session", "call_no", "loaded", "evicted", "active_after", "redundant", "error_ids", "error_reason"])

    from loam.operators.memory import DELTA

    return calls.groupBy("session").applyInPandasWithState(run, DELTA, "active array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout)


def host_rates(requests: DataFrame, delay_s: float = DELAY_S, ttl_ms: int | None = None) -> DataFrame:
    """Waiting times over a stream of requests, in microseconds as in a batch; the state of a host is when its next request may start."""

    def us(seconds: float | None) -> int:
        return 0 if seconds is None or seconds != seconds else round(seconds * 1e6)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        allowed = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(list(frames)).sort_values("pos").itertuples():
            arrive = us(r.arrive_s)
            start = arrive if allowed is None else max(arrive, allowed)
            allowed = start + us(r.took_s) + max(us(delay_s), us(r.retry_s) if r.status in RETRYABLE else 0)
            out.append((key[0], int(r.pos), start / 1e6, (start - arrive) / 1e6, allowed / 1e6))
        state.update((int(allowed),))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=["host", "pos", "start_s", "wait_s", "next_allowed"])

    from loam.operators.crawl import PACED

    return requests.groupBy("host").applyInPandasWithState(run, PACED, "allowed long", "append", GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout)


# --- event time: beyond what the question needs, since Spark has it


def windowed(events: DataFrame, length: str = "5 minutes", slide: str | None = None, late: str = "10 minutes", key: str = "event_type", value: str = "value") -> DataFrame:
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), "n")


def once(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Events without those delivered again."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append", seconds: int = 120) -> list[Any]:
    """Drive a stream over what is there and give its rows; for tests and one-off runs."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", os.path.join(checkpoint, name)).trigger(availableNow=True).start()
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"{name} did not end in {seconds} s")
    return df.sparkSession.table(name).collect()
