"""The request stream: sessions' requests assembled in keyed state (A02, A10), and a rate limiter.

State is one small record for each request that has begun, which goes when nothing has come for it for a while. Requests are
dealt to parts of their session, as a call and a frame for each request cost far more than its few events; batch queries
over the same events (:mod:`pellucid.operators.requests`) give the same observations.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOST_REDIRECTS = 8
LIMIT, WINDOW_MS = 20, 10_000
IDLE_MS = 86_400_000

EVENT = ("session", "request_id", "seq", "kind", "type", "norm_method", "norm_status", "mime_state", "mime", "now_ms")
OBSERVED = (
    "session long, request_id long, end_seq long, resource_type string, method string, response_status int, declared_mime_state string, declared_mime string, "
    "completed boolean, network_error boolean, redirected boolean, redirect_count long"
)
#: Status and media type before any headers.
_NONE = (None, "missing", None)
# Parts that a session's requests are dealt to; each is one state.
PARTS = 64
# End of the fixed values.


def assemble(events: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """One observation per finished request of a stream of normalised events (the columns of EVENT).

    Events before a request's begin, and after its end, don't count; a redirect makes its headers void; more than
    eight redirects drop it. Within a batch events are taken in the order of ``seq``. A request, finished or not,
    is forgotten once the watermark, ``idle_ms`` behind the latest event, is as far beyond its own last event: state
    stays in proportion to what comes within that time. The default is a day, as long as a session lasts.
    """
    columns = [c.split()[0] for c in OBSERVED.split(", ")]
    longs = {"session": "Int64", "request_id": "Int64", "end_seq": "Int64", "redirect_count": "Int64", "response_status": "Int32"}

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        # a request that has begun, by its number
        held: dict[int | None, dict] = dict(json.loads(state.get[0])) if state.exists else {}
        latest, out = {}, []
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values("seq")
            values = (rows[c].astype(object).where(rows[c].notna(), None).tolist() for c in EVENT[1:])
            for request, seq, kind, type_, method, status, mime_state, mime, now in zip(*values, strict=True):
                latest[request] = max(latest.get(request, watermark), watermark if now is None else int(now))
                r = held.get(request)
                if r is None:
                    if kind == "begin":
                        held[request] = {"type": type_, "method": method, "redirects": 0, "headers": _NONE}
                elif r.get("done"):
                    continue
                elif kind == "redirect":
                    r.update(redirects=r["redirects"] + 1, headers=_NONE)
                elif kind == "headers":
                    r["headers"] = (None if status is None else int(status), mime_state, mime)
                elif kind in ("completed", "error"):
                    if r["redirects"] <= MOST_REDIRECTS:
                        out.append((key[0], request, seq, r["type"], r["method"], *r["headers"], kind == "completed", kind == "error", r["redirects"] > 0, r["redirects"]))
                    held[request] = {"done": True}
        for request in latest.keys() & held.keys():
            held[request]["until"] = latest[request] + idle_ms
        kept = {request: r for request, r in held.items() if request in latest or r["until"] >= watermark}
        if kept:
            state.update((json.dumps(list(kept.items())),))
            state.setTimeoutTimestamp(max(min(r["until"] for r in kept.values()), watermark + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=columns).astype(longs)

    timed = events.select(*EVENT, F.timestamp_millis("now_ms").alias("at")).withWatermark("at", f"{idle_ms} milliseconds")
    # numbers that are missing stay apart from the others, which would be read as floats beside them
    part = F.when(F.col("request_id").isNotNull(), F.pmod(F.xxhash64("request_id"), F.lit(PARTS))).otherwise(F.lit(-1)).cast("int")
    keyed = timed.withColumn("part", part).groupBy("session", "part")
    return keyed.applyInPandasWithState(step, OBSERVED, "requests string", "append", GroupStateTimeout.EventTimeTimeout)


def rate_limited(log: DataFrame) -> DataFrame:
    """Requests (seq, sender, now_ms) with ``allowed``: at most LIMIT accepted in WINDOW_MS per sender.

    A rejected request isn't counted, so each depends on those before it: senders' requests pass in order through
    a fold that holds a sender's last LIMIT accepted times only, however many requests it has.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, accepted = None, deque(maxlen=LIMIT)
        for frame in frames:
            allowed = []
            for sender, now in zip(frame["sender"].tolist(), frame["now_ms"].tolist()):
                if sender != of:
                    of, accepted = sender, deque(maxlen=LIMIT)
                allowed.append(len(accepted) < LIMIT or accepted[0] <= now - WINDOW_MS)
                if allowed[-1]:
                    accepted.append(now)
            yield frame.assign(allowed=allowed)

    rows = log.select(F.col("seq").cast("long"), F.col("sender").cast("long"), F.col("now_ms").cast("long")).where("sender IS NOT NULL AND now_ms IS NOT NULL")
    return rows.repartition("sender").sortWithinPartitions("sender", "now_ms", "seq").mapInPandas(fold, "seq long, sender long, now_ms long, allowed boolean")


# What may be asked for.
ACTIONS = ("hello", "get-findings")
# End of the fixed values.


def gated(calls: DataFrame, allowed: list[int]) -> DataFrame:
    """Which gate ends each call, or ok (G09): allowlist, page, action, rate, front, tab, in this order.

    Calls that an earlier gate refuses do not count for the rate limit; those refused behind it do. ``calls``: seq, sender,
    now_ms, from_page, action, tab_id (null: none named), in_front; the tab in front is 1. Without a sender a call is not allowed.
    """
    first = F.when(~F.coalesce(F.col("sender").isin(allowed), F.lit(False)), "allowlist").when(F.col("from_page"), "page").when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "action")
    rows = calls.withColumn("gate", first)
    counted = rate_limited(rows.where("gate IS NULL")).select("seq", "allowed")
    late = F.when(~F.col("allowed"), "rate").when(F.col("action") == "hello", "ok").when(~F.col("in_front"), "front").when(F.coalesce(F.col("tab_id") != 1, F.lit(False)), "tab").otherwise("ok")
    return rows.join(counted, "seq", "left").select("seq", "sender", "action", F.coalesce("gate", late).alias("gate"))
