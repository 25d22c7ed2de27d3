"""A model's token stream as events, piece by piece: in a keyed stream whose pieces may come late or again, and over whole rows.

Pieces are (stream, seq from 0, piece, last). The first of the opening tags `<answer>` and `<query>` decides the stream's mode.
In an answer, what is certain to be shown comes out as deltas: nothing before the opening tag, nothing of what may be the
beginning of the closing one. With the last piece the stream ends: done with the answer (or error empty_answer), query with
the query, or error invalid_agent_action. Events are numbered in each stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "stream string, n long, kind string, text string"


class Fold:
    """One stream's state: what has come, how much of the answer is shown, and how many events there are."""

    def __init__(self, raw: str = "", mode: str = "", shown: int = 0, n: int = 0):
        self.raw, self.mode, self.shown, self.n = raw, mode, shown, n

    def _event(self, kind: str, text: str | None) -> tuple[int, str, str | None]:
        self.n += 1
        return self.n - 1, kind, text

    def _visible(self) -> str:
        """What is certain of the answer so far."""
        content = self.raw.split("<answer>", 1)[1]
        closing = "</answer>"
        if closing in content:
            return content.split(closing, 1)[0]
        held = next((k for k in range(min(len(closing) - 1, len(content)), 0, -1) if content.endswith(closing[:k])), 0)
        return content[: len(content) - held]

    def add(self, piece: str, last: bool) -> Iterator[tuple[int, str, str | None]]:
        self.raw += piece
        if not self.mode:
            found = sorted((at, kind) for kind in ("answer", "query") if (at := self.raw.find(f"<{kind}>")) >= 0)
            if found:
                self.mode = found[0][1]
                if self.mode == "answer":
                    yield self._event("answer_start", None)
        if self.mode == "answer" and len(visible := self._visible()) > self.shown:
            yield self._event("answer_delta", visible[self.shown :])
            self.shown = len(visible)
        if last:
            yield self._end()

    def _whole(self, tag: str) -> str:
        """The first whole tag's content, without white space around it."""
        content = self.raw.split(f"<{tag}>", 1)
        return content[1].split(f"</{tag}>", 1)[0].strip() if len(content) > 1 and f"</{tag}>" in content[1] else ""

    def _end(self) -> tuple[int, str, str | None]:
        if self.mode == "answer":
            answer = self._whole("answer") or self._visible()[: self.shown].strip()
            return self._event("done", answer) if answer else self._event("error", "empty_answer")
        query = self._whole("query")
        return self._event("query", query) if query else self._event("error", "invalid_agent_action")


STATE = "next long, raw string, mode string, shown long, n long, ended boolean, early_seq array<long>, early_piece array<string>, early_last array<boolean>"


def _arrived(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A stream's pieces in the order of seq: those that came early wait in the state, those that come again are left out."""
    at, raw, mode, shown, n, ended, *early = state.get if state.exists else (0, "", "", 0, 0, False, [], [], [])
    if ended:
        return
    fold, out = Fold(raw, mode, shown, n), []
    waiting = {seq: (piece, last) for seq, piece, last in zip(*early, strict=True)}
    for frame in rows:
        for seq, piece, last in zip(frame["seq"].tolist(), frame["piece"].tolist(), frame["last"].tolist(), strict=True):
            if seq >= at:
                waiting.setdefault(seq, (piece or "", bool(last)))
    while not ended and at in waiting:
        piece, last = waiting.pop(at)
        out += fold.add(piece, last)
        at, ended = at + 1, last
    # What has ended needs no text any more, only the mark that later pieces are repeats.
    if ended:
        waiting = {}
    early = list(waiting), [p for p, _ in waiting.values()], [e for _, e in waiting.values()]
    state.update((at, "" if ended else fold.raw, fold.mode, fold.shown, fold.n, ended, *early))
    if not out:
        return
    texts = lambda i: pd.Series([key[0] if i is None else e[i] for e in out], dtype=object)
    yield pd.DataFrame({"stream": texts(None), "n": pd.Series([e[0] for e in out], dtype="int64"), "kind": texts(1), "text": texts(2)})


def streamed_events(pieces: DataFrame) -> DataFrame:
    """Streaming `pieces` (stream string, seq long, piece string, last boolean) to events (stream, n, kind, text).

    A stream's state goes to Python with its rows, so streams that are met together cost no call each.
    """
    return pieces.groupBy("stream").applyInPandasWithState(_arrived, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def events_of(pieces: DataFrame) -> DataFrame:
    """The batch twin: the same events of whole streams; repeated pieces count once, what follows a missing piece waits for ever."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, own, at, ended = Fold(), None, 0, False
        for b in batches:
            out = []
            for stream, seq, piece, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if stream != own:
                    fold, own, at, ended = Fold(), stream, 0, False
                if seq == at and not ended:
                    out += [(stream, *e) for e in fold.add(piece or "", bool(last))]
                    at, ended = at + 1, bool(last)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], ["stream", "n", "kind", "text"])

    return pieces.select("stream", "seq", "piece", "last").repartition("stream").sortWithinPartitions("stream", "seq").mapInArrow(run, OUT)
