"""Record streams into durable state: each micro-batch is reconciled like an incremental scan.

A batch carries whole sources. It adds a part with its own sources' records, and a list of the sources that these
replace, so what is written follows the batch and not the state. Publishing is by generation, and a batch that was already
published is passed over, so a restarted query gives the same tables as one rebuild from the last version of
every source. Of several events of one source in a batch the highest version counts; of equal versions the greatest file hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import state
from millrace.plans.shared import materialize, remove
from millrace.plans.store import Keyed, Store

EVENTS = f"source_key string, file_hash string, version long, deleted boolean, records array<struct<{', '.join(x.replace(' ', ':', 1) for x in ['id string', 'title string', 'content string', 'content_hash string'])}>>"
RECORDS = "source_key string, file_hash string, id string, title string, content string, content_hash string"


#: Parts of the state beyond which the later ones become one.
PARTS = 16


def stream_store(spark: SparkSession, place: str) -> Store:
    """A store whose stream_records change by source."""
    return Store(spark, place, {"stream_records": Keyed("source_key", "stream", ("source_key", "id"))})


def apply_batch(store: Store, events: DataFrame, batch_id: int) -> dict:
    """Reconciles one batch."""
    marker = store.marker()
    if marker.get("batch", -1) >= batch_id:
        return marker
    newest = Window.partitionBy("source_key").orderBy(F.desc("version"), F.desc("file_hash"), F.desc_nulls_last("deleted"))
    last = materialize(events.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n"), "batch")
    old = store.read("stream_records", RECORDS)
    touched = last.select("source_key")
    fresh = last.where("NOT coalesce(deleted, false)").select("source_key", "file_hash", F.explode("records").alias("r")).select("source_key", "file_hash", "r.*")
    stay = old.select("id", "source_key").join(touched, "source_key", "left_anti")
    if not state.ownership_conflicts(stay, fresh).isEmpty():
        raise ValueError("another source owns a record of this batch")
    changes = state.diff(old.join(touched, "source_key", "left_semi"), fresh).where("state_change <> 'unchanged'")
    changed = not changes.isEmpty()
    facts = {"generation": marker["generation"] + int(changed), "batch": batch_id, "state": "Current", "identity": marker["identity"]}
    out = store.write({}, append={"stream_records": fresh}, dead={"stream": (touched, last.count())}, **facts)
    if len(store.parts("stream_records", out)) > PARTS:
        out = store.write({}, tails={"stream_records": store.merged_tail("stream_records", RECORDS)})
        first, *later = (store.spark.read.schema(RECORDS).parquet(f"{store.root}/{p['place']}").count() for p in store.parts("stream_records", out))
        if sum(later) > first:  # the first part is the smaller one: all become one
            out = store.write({"stream_records": store.read("stream_records", RECORDS)})
    store.sweep()
    remove(last)
    return out


def start(events: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Runs over what is there, then stops; schedule it, or give another trigger."""
    return events.writeStream.foreachBatch(lambda df, i: apply_batch(store, df, i) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["EVENTS", "RECORDS", "apply_batch", "start", "stream_store"]
