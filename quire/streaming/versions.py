"""A stream of document versions into a catalog.

For each document the state keeps the newest version seen and the hash of its
text. A version that is older, or that repeats the text, changes nothing, so a
stream may come in any order and more than once. What is left of a batch is put in
the catalog in one generation, with the batch's number: a batch that runs again
after a crash finds its number there and is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.changes import Changes

KEYS = ["store", "model", "doc"]
#: A version of a document; of equal versions the text with the greater hash counts.
VERSION = "store string, model string, doc string, path string, text string, version long"


def newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The newest version of a document, if it is newer than the state's and has another text."""
    seen, last = state.get if state.exists else (None, "")
    best = None
    for batch in batches:
        for path, text, version in zip(batch["path"], batch["text"], batch["version"]):
            found = (version, hashlib.sha256((text or "").encode()).hexdigest())
            if best is None or found > best[0]:
                best = (found, path, text)
    if best is None or (seen is not None and best[0] <= (seen, last)):
        return
    state.update(best[0])
    if seen is None or best[0][1] != last:
        yield pd.DataFrame([(*key, best[1], best[2], best[0][0])], columns=[*KEYS, "path", "text", "version"])


def newest_versions(versions: DataFrame) -> DataFrame:
    """Versions (VERSION) of a stream that change a document."""
    return versions.groupBy(*KEYS).applyInPandasWithState(newest, VERSION, "version long, hash string", "append", GroupStateTimeout.NoTimeout)


def stream_into(changes: Changes, versions: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Put all of ``versions`` that is there now into the catalog; a later call goes on where this one ended.

    ``name`` is the stream's in the catalog, which keeps its last batch.
    """

    def put(batch: DataFrame, number: int) -> None:
        changes.take(batch.drop("version"), (name, number))

    return newest_versions(versions).writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
