"""Findings of split instructions as they are merged (P19), committed (P20) and retracted.

Decisions pass in order through a fold that holds one region's findings; a page's findings are keyed state, which a
stream's micro-batches and a batch's sorted rows change by the same steps.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Candidates of a finding, pending and active findings, entries of the reverse index.
MOST_CANDIDATES, MOST_PENDING, MOST_ACTIVE, MOST_INDEXED = 8, 200, 200, 1_000
# End of the fixed values.

_REGION = ["conv_id", "run", "chunk"]
_DECISION = "source_type, action_group, rule_id, confidence, severity, path, turn, candidates, contributing".split(", ")
_MERGED = (
    "conv_id long, run long, chunk long, source_type string, action_group string, rule_id string, confidence long, severity long, path int, candidates array<int>, contributing array<int>, n_decisions long"
)


def _rank(f: dict) -> tuple:
    """More is preferred: confidence, then severity, then the closeness of the path."""
    return f["confidence"], f["severity"], -f["path"]


def merge_decision(pending: list[dict], decision: dict) -> bool:
    """Merge a decision into the first finding of its group and source that shares a candidate, or add it; False beyond a limit."""
    own = decision["candidates"]
    if not own or len(decision["contributing"]) < 2 or max(len(own), len(decision["contributing"])) > MOST_CANDIDATES:
        return False
    same = ("action_group", "source_type")
    found = next((f for f in pending if all(f[k] == decision[k] for k in same) and not set(own).isdisjoint(f["candidates"])), None)
    if found is None:
        if len(pending) >= MOST_PENDING:
            return False
        pending.append({**decision, "n_decisions": 1})
        return True
    merged = {k: sorted({*found[k], *decision[k]}) for k in ("candidates", "contributing")}
    if max(map(len, merged.values())) > MOST_CANDIDATES:
        return False
    preferred = decision if _rank(decision) > _rank(found) else found
    found.update({**preferred, **merged, "n_decisions": found["n_decisions"] + 1})
    return True


def merge_decisions(decisions: DataFrame) -> DataFrame:
    """Eligible decisions as findings of their regions; a decision that a finding has no room for is left out.

    A region's decisions, which windows bound, are taken in the order of turn, size, path and rule; no more than the
    findings of a batch's regions are held at a time.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _MERGED.split(", ")]
        region, pending = None, []
        told = lambda: [[*region, *(f[c] for c in columns[3:])] for f in pending]

        for frame in frames:
            done = []  # regions that end in these rows leave in one frame: a frame of its own costs more than a region's fold
            for row in frame.itertuples(index=False):
                key = (row.conv_id, row.run, row.chunk)
                if key != region:
                    done += told()
                    region, pending = key, []
                decision = {c: getattr(row, c) for c in _DECISION}
                merge_decision(pending, decision | {c: [int(x) for x in decision[c]] for c in ("candidates", "contributing")})
            if done:
                yield pd.DataFrame(done, columns=columns)
        if pending:
            yield pd.DataFrame(told(), columns=columns)

    rows = decisions.where("eligible").select(*_REGION, *(c for c in _DECISION if c != "candidates"), F.col("spans.candidate").alias("candidates"), "size", "ord")
    rows = rows.withColumns({c: F.transform(c, lambda x: x.cast("int")) for c in ("candidates", "contributing")})
    ordered = rows.repartition(*_REGION).sortWithinPartitions(*_REGION, "turn", "size", "path", "ord")
    return ordered.mapInPandas(fold, _MERGED)


class PageFindings:
    """The active findings of one page in the order in which they came, under keys that stay while their candidates do."""

    def __init__(self, saved: str | None = None):
        state = json.loads(saved) if saved else {"active": [], "next": 1, "revision": 0, "partial": False}
        self.active: dict[int, dict] = {f["key"]: f for f in state["active"]}
        self.next, self.revision, self.partial = state["next"], state["revision"], state["partial"]

    def saved(self) -> str:
        return json.dumps({"active": list(self.active.values()), "next": self.next, "revision": self.revision, "partial": self.partial})

    @staticmethod
    def _identity(f: dict) -> tuple:
        return f["action_group"], f["source_type"], tuple(f["region"]), tuple(sorted(f["candidates"]))

    @staticmethod
    def _content(findings: dict[int, dict]) -> list[str]:
        return sorted(json.dumps({k: v for k, v in f.items() if k not in ("key", "first")}, sort_keys=True) for f in findings.values())

    def commit(self, seq: int, scope: str, regions: list, partial: bool, findings: list[dict]) -> bool:
        """A full commit replaces all findings, one of regions those of its regions, a partial one replaces none. Whether anything changed."""
        kept: dict[int, dict] = {}
        if partial or scope == "region":
            gone = [] if partial else [list(r) for r in regions]
            kept = {k: f for k, f in self.active.items() if list(f["region"]) not in gone}
        known: dict[tuple, dict] = {}
        for f in [*kept.values(), *self.active.values()]:
            known.setdefault(self._identity(f), f)
        for f in findings:
            old = known.get(self._identity(f))
            key = old["key"] if old else self.next
            self.next += old is None
            kept[key] = known[self._identity(f)] = {**f, "key": key, "first": old["first"] if old else seq}
        if len(kept) > MOST_ACTIVE:
            kept, partial = dict(list(kept.items())[:MOST_ACTIVE]), True
        changed = self._content(kept) != self._content(self.active)
        self.active, self.partial = kept, partial
        self._index()
        self.revision += changed
        return changed

    def _index(self) -> dict[int, set[int]]:
        """Candidates with the keys of their findings; a page with more entries than are kept is partial."""
        index: dict[int, set[int]] = {}
        room = MOST_INDEXED
        for key, f in self.active.items():
            for candidate in f["candidates"][:room]:
                index.setdefault(candidate, set()).add(key)
            room -= len(f["candidates"]) + 1  # a region's entry counts as well
            if room < 0:
                self.partial = True
                break
        return index

    def remove(self, candidates: list[int]) -> bool:
        index = self._index()
        gone = set().union(*(index.get(c, ()) for c in candidates))
        for key in gone:
            del self.active[key]
        self.revision += bool(gone)
        return bool(gone)

    def apply(self, event) -> tuple:
        """(status, number of findings, revision, whether it changed) after an event of ``EVENT``'s columns."""
        if event.scope == "remove":
            changed = self.remove([int(c) for c in event.candidates])
        else:
            regions = [] if event.regions is None else [[int(x) for x in r] for r in event.regions]
            changed = self.commit(int(event.seq), event.scope, regions, bool(event.partial), json.loads(event.findings))
        return "partial" if self.partial else "complete", len(self.active), self.revision, changed


EVENT = ("conv_id", "seq", "scope", "regions", "partial", "candidates", "findings")
_REVISED = "conv_id long, seq long, status string, active long, revision long, changed boolean"
_COLUMNS = [c.split()[0] for c in _REVISED.split(", ")]


def revisions(events: DataFrame) -> DataFrame:
    """What each event makes of its conversation's findings, from a table of events: pages pass in order, one at a time."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, state = None, PageFindings()
        for frame in frames:
            out = []
            for e in frame.itertuples(index=False):
                if e.conv_id != page:
                    page, state = e.conv_id, PageFindings()
                out.append((e.conv_id, e.seq, *state.apply(e)))
            yield pd.DataFrame(out, columns=_COLUMNS)

    return events.select(*EVENT).where("conv_id IS NOT NULL").repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInPandas(fold, _REVISED)


def revision_stream(events: DataFrame) -> DataFrame:
    """The same from a stream whose micro-batches bring a page's events in order; state is a page's findings, at most 200."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        page = PageFindings(state.get[0] if state.exists else None)
        rows = pd.concat(list(frames)).sort_values("seq")
        out = [(key[0], e.seq, *page.apply(e)) for e in rows.itertuples(index=False)]
        state.update((page.saved(),))
        yield pd.DataFrame(out, columns=_COLUMNS)

    return events.select(*EVENT).groupBy("conv_id").applyInPandasWithState(step, _REVISED, "saved string", "append", GroupStateTimeout.NoTimeout)


def replayed(merged: DataFrame) -> DataFrame:
    """Merged findings as events of their conversations, four each: all; the first region anew, without its later findings; others in part; a removal."""
    finding = F.struct(F.array(*_REGION[1:]).alias("region"), "source_type", "action_group", "rule_id", "confidence", "severity", "path", "candidates", "contributing")
    rows = merged.withColumn("finding", finding).withColumn("nth", F.row_number().over(Window.partitionBy("conv_id").orderBy(*_REGION[1:], "action_group", "source_type", F.element_at("candidates", 1))))
    lists = F.array_sort(F.collect_list(F.struct("nth", "finding")))  # no more than a conversation's findings
    pages = rows.groupBy("conv_id").agg(lists.alias("all"), F.min(F.struct(*_REGION[1:])).alias("region"))
    told = lambda kept: F.to_json(F.transform(kept, lambda x: x["finding"]))
    regions, none = F.array(F.array("region.run", "region.chunk")), F.array().cast("array<array<bigint>>")
    event = lambda seq, scope, partial, found, regions=none, gone=None: F.struct(
        F.lit(seq).cast("long").alias("seq"), F.lit(scope).alias("scope"), regions.alias("regions"), F.lit(partial).alias("partial"), (F.array().cast("array<int>") if gone is None else gone).alias("candidates"), found.alias("findings")
    )
    first = F.filter("all", lambda x: (x["finding"]["region"] == F.array("region.run", "region.chunk")) & (x["nth"] <= 1))
    events = F.array(
        event(1, "full", False, told(F.filter("all", lambda x: x["nth"] % 3 != 0))), event(2, "region", False, told(first), regions), event(3, "full", True, told(F.filter("all", lambda x: x["nth"] % 3 == 0))),
        event(4, "remove", False, F.lit("[]"), gone=F.slice(F.col("all")[0]["finding"]["candidates"], 1, 1)),
    )
    return pages.select("conv_id", F.explode(events).alias("e")).select("conv_id", "e.*")
