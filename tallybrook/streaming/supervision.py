"""Several streams that run and end together."""

from __future__ import annotations

import logging
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql.streaming import StreamingQuery

log = logging.getLogger(__name__)

#: Seconds between two looks at the queries.
POLL_SECONDS = 1.0


@dataclass(frozen=True)
class QueryEnd:
    """How a query ended: its last finished batch (-1 if none), and its failure or None.

    `stopped` tells that it was still running when another one ended.
    """

    query_id: str
    name: str | None
    last_batch: int
    stopped: bool
    error: str | None


class StreamsFailed(RuntimeError):
    """One or more supervised queries failed; `ends` tells of all of them, in the order given."""

    def __init__(self, ends: Sequence[QueryEnd]):
        self.ends = list(ends)
        failed = [f"{end.name or end.query_id}: {end.error}" for end in ends if end.error]
        super().__init__(f"{len(failed)} of {len(ends)} streams failed: " + "; ".join(failed))


def supervise(queries: Sequence[StreamingQuery], poll: float = POLL_SECONDS) -> list[QueryEnd]:
    """Wait until one of the queries ends, stop the others and report how each ended.

    A failure is raised as StreamsFailed once no query is left running, so that the job's exit
    tells of it and nothing goes on without the others. A stopped query may have been within a
    batch: it does that batch again when it starts from its checkpoint. The queries are
    stopped too where the wait itself is interrupted. Without queries it returns at once.
    """
    running: set[int] = set()
    try:
        while queries and all(query.isActive for query in queries):
            time.sleep(poll)
    finally:
        for i, query in enumerate(queries):
            if query.isActive:
                running.add(i)
                query.stop()
    ends = [_end(query, i in running) for i, query in enumerate(queries)]
    for end in ends:
        log.info("%s", end)
    if any(end.error for end in ends):
        raise StreamsFailed(ends)
    return ends


def _end(query: StreamingQuery, stopped: bool) -> QueryEnd:
    progress, failure = query.lastProgress, query.exception()
    return QueryEnd(
        str(query.id),
        query.name,
        progress.batchId if progress else -1,
        stopped,
        str(failure) if failure else None,
    )
