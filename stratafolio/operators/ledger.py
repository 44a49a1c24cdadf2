"""The budget ledger: an ordered fold over the requests of an account, the same for batch and streams.

An account's events are taken in the order of their sequence. A reservation is granted if no cap would be broken by what is used and what is
still reserved; a refused one leaves no trace. Settling replaces the estimate by the real usage, a failure after dispatch charges the
estimate, a release gives it back. Every reservation is charged once at most, and a replay changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import folds

EVENT = "account string, sequence long, action string, reservation_id string, kind string, est_input long, counts_request boolean, as_page boolean, input_tokens long"
RESULT = "account string, sequence long, outcome string, input long, requests long, pages long"

# Kinds of attempts and pages, what a settled call counts as a request, and the names of refusals.
ATTEMPT, PAGE = "http-attempt", "vision-page"
CALLS = ("chat", "embedding", "vision-page", "http-attempt")
OVER_INPUT, OVER_REQUESTS, OVER_PAGES = "budget_exceeded_total_input_tokens", "budget_exceeded_max_requests", "budget_exceeded_max_pages"


@dataclass(frozen=True)
class Caps:
    """Most input tokens, requests and pages of an account, used and reserved together; None is no cap."""

    input: int | None = None
    requests: int | None = None
    pages: int | None = None


@dataclass
class Account:
    """Totals, and each granted reservation as [kind, estimate, counts a request, status, charged]."""

    input: int = 0
    requests: int = 0
    pages: int = 0
    held: dict[str, list] = field(default_factory=dict)

    def apply(self, caps: Caps, action: str, reservation: str, kind: str | None, est_input: int | None, counts: bool | None, as_page: bool | None, tokens: int | None) -> str:
        if action == "reserve":
            return self._reserve(caps, reservation, kind or "chat", max(1, int(est_input or 0)), counts is None or bool(counts), bool(as_page))
        row = self.held.get(reservation)
        if row is None:
            return "unknown_reservation" if action == "settle" else "ignored"
        if action == "release":
            self._free(row)
            row[3] = "released"
            return "released"
        if action not in ("settle", "fail"):
            return "ignored"
        done = ("settled",) if action == "settle" else ("settled", "unknown")
        if row[3] in done:
            return "replayed"
        if row[4]:
            return "already_charged"
        self._free(row)
        if action == "settle":
            self.input += int(tokens or 0) or row[1]
            self.requests += 1 if row[0] in CALLS else row[2]
            row[3] = "settled"
        else:
            self.input += row[1]
            self.requests += 1 if row[0] == ATTEMPT else row[2]
            row[3] = "unknown"
        self.pages += row[0] == PAGE
        row[4] = True
        return row[3]

    def _reserve(self, caps: Caps, reservation: str, kind: str, estimate: int, counts: bool, as_page: bool) -> str:
        if reservation in self.held:
            return "replayed"
        if caps.input is not None and self.input + estimate > caps.input:
            return OVER_INPUT
        if (kind == ATTEMPT or counts) and caps.requests is not None and self.requests + 1 > caps.requests:
            return OVER_REQUESTS
        if as_page and caps.pages is not None and self.pages + 1 > caps.pages:
            return OVER_PAGES
        kind = ATTEMPT if kind == ATTEMPT else PAGE if as_page else kind
        self.held[reservation] = [kind, estimate, int(counts), "reserved", False]
        self.input += estimate
        self.requests += int(counts)
        self.pages += kind == PAGE
        return "reserved"

    def _free(self, row: list) -> None:
        """What an open reservation holds is given back; a page whose outcome is unknown is held, too."""
        if row[3] == "reserved":
            self.input -= row[1]
            self.requests -= row[2]
        if row[0] == PAGE and row[3] in ("reserved", "unknown"):
            self.pages -= 1

    def totals(self) -> tuple[int, int, int]:
        return self.input, self.requests, self.pages


def folded(events: DataFrame, caps: Caps) -> DataFrame:
    """(account, sequence, outcome, input, requests, pages): what became of each of the events (see EVENT), with the account's totals after it.

    Outcomes: reserved, settled, unknown (charged by its estimate), released, replayed, ignored, unknown_reservation, already_charged, or the cap
    that a reservation would break. Memory holds the reservations of one account, not its events. A sequence that repeats is taken in the order of action
    and reservation. Null accounts are one account.
    """
    typed = events.selectExpr(*(f"CAST({c} AS {kind}) AS {c}" for c, kind in (x.split() for x in EVENT.split(", "))))

    def step(state: Account, row: tuple) -> tuple:
        return (row[0], state.apply(caps, *row[1:]), *state.totals())

    return folds.folded(typed, ["account"], ["sequence", "action", "reservation_id"], RESULT, Account, step)


class LedgerProcessor(StatefulProcessor):
    """The same fold for transformWithStateInPandas, keyed by account: totals in one state, each reservation under its own key in another. A batch is taken in
    the order of its sequences."""

    def __init__(self, caps: Caps):
        self.caps = caps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("totals", "input long, requests long, pages long")
        self.held = handle.getMapState("held", "reservation string", "kind string, estimate long, counts int, status string, charged boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = Account(*(self.sums.get() if self.sums.exists() else (0, 0, 0)))
        frame = pd.concat(list(rows)).sort_values(["sequence", "action", "reservation_id"])
        plain = lambda x: None if pd.isna(x) else x
        out = []
        for r in frame.itertuples():
            name = (r.reservation_id,)
            if r.reservation_id not in state.held and self.held.containsKey(name):
                state.held[r.reservation_id] = list(self.held.getValue(name))
            outcome = state.apply(self.caps, r.action, r.reservation_id, *map(plain, (r.kind, r.est_input, r.counts_request, r.as_page, r.input_tokens)))
            out.append((key[0], r.sequence, outcome, *state.totals()))
        for name, row in state.held.items():
            self.held.updateValue((name,), tuple(row))
        self.sums.update(state.totals())
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    def close(self) -> None:
        pass


def stream_folded(events: DataFrame, caps: Caps) -> DataFrame:
    """folded() for a stream of events; the stream needs the RocksDB state store."""
    return events.groupBy("account").transformWithStateInPandas(LedgerProcessor(caps), RESULT, "append", "none")
