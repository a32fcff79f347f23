"""Tables that micro-batches write: append-once feedback and a session table that can be read, written and deleted from.

A micro-batch's rows go to a folder named by its number, which a replay of the batch overwrites with the same rows: replays add
nothing.  ``foreachBatch`` passes the number; a writer outside a stream passes one of its own."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storewatch.operators.dialogue import SLOTS
from storewatch.operators.validate import validate_feedback

FEEDBACK = ("id string, session_id string, prediction_id string, rating int, comment string, was_accurate boolean, "
            "created_at timestamp, api_key string")


def write_batch(rows: DataFrame, path: str, batch_id: int | str) -> None:
    """``rows`` as the one content of a batch's folder."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches of a table with their number as text (column ``batch``); an unwritten table is empty."""
    try:
        return spark.read.schema(f"{schema}, batch string").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, batch string")


class FeedbackTable:
    """Append-only feedback: valid rows below ``<path>/rows``, the others with their reasons below ``<path>/rejected``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, rows: DataFrame, batch_id: int | str) -> None:
        """Add a batch; the same number again replaces it.  Also the function for ``foreachBatch``."""
        checked = validate_feedback(rows).drop("valid").persist()
        try:
            write_batch(checked.where(F.size("reasons") == 0).drop("reasons"), f"{self.path}/rows", batch_id)
            write_batch(checked.where(F.size("reasons") > 0), f"{self.path}/rejected", batch_id)
        finally:
            checked.unpersist()

    def rows(self) -> DataFrame:
        """Accepted feedback, one row per id (the first of its batches)."""
        every = read_batches(self.spark, f"{self.path}/rows", FEEDBACK)
        names = [c for c in every.columns if c != "batch"]
        return every.groupBy("id").agg(F.min_by(F.struct(*names), F.struct("created_at", "batch")).alias("r")).select("r.*")

    def rejected(self) -> DataFrame:
        return read_batches(self.spark, f"{self.path}/rejected", f"{FEEDBACK}, reasons array<string>").drop("batch")


SESSION = ("session_id string, turn int, ts timestamp, expires_at timestamp, deleted boolean, "
           + ", ".join(f"{s} {'string' if s in ('industry_code', 'region_code') else 'double'}" for s in SLOTS) + ", missing string")


class SessionTable:
    """Session states, last write wins by time: states of a stream, and single saves and deletions.

    Writes add rows; :meth:`compact` leaves the last state of every session that is not deleted or expired."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def upsert(self, states: DataFrame, batch_id: int | str) -> None:
        """Add states; the same number again replaces them.  Also the function for ``foreachBatch``."""
        write_batch(_last(states.select(*[c.split()[0] for c in SESSION.split(", ")])), self.path, batch_id)

    def save(self, states: DataFrame, name: str) -> None:
        self.upsert(states, f"save-{name}")

    def delete(self, sessions: DataFrame, at: str, name: str) -> None:
        """Delete the sessions (column session_id) as of a time: a state that is saved later begins anew."""
        time, known = F.lit(at).cast("timestamp"), {"deleted": F.lit(True), "missing": F.lit("")}
        known |= {"ts": time, "expires_at": time}
        types = dict(c.split() for c in SESSION.split(", "))
        rows = sessions.where("session_id is not null").select("session_id").distinct().withColumns(
            {c: known.get(c, F.lit(None)).cast(t) for c, t in types.items() if c != "session_id"})
        self.upsert(rows, f"delete-{name}")

    def states(self) -> DataFrame:
        """The last state of every session, deleted and expired ones included."""
        return _last(read_batches(self.spark, self.path, SESSION).drop("batch"))

    def live(self, at: str) -> DataFrame:
        """Sessions that are neither deleted nor expired at a time."""
        return self.states().where(~F.col("deleted") & (F.col("expires_at") > F.lit(at).cast("timestamp")))

    def get(self, session_id: str, at: str) -> DataFrame:
        return self.live(at).where(F.col("session_id") == session_id)

    def compact(self, at: str, path: str) -> SessionTable:
        """A new table with what is live."""
        smaller = SessionTable(self.spark, path)
        smaller.upsert(self.live(at), "compact")
        return smaller


def _last(states: DataFrame) -> DataFrame:
    names = states.columns
    # a deletion beats a state of the same time
    return states.groupBy("session_id").agg(F.max_by(F.struct(*names), F.struct("ts", "deleted", F.coalesce("turn", F.lit(-1)))).alias("r")).select("r.*")


def run_into(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything available, each micro-batch through ``sink(rows, batch number)``."""
    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode)
         .trigger(availableNow=True).start())
    q.awaitTermination()
