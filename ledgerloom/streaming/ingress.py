"""Arrivals as streams: files and queue messages in one stream, contents seen before, and files that are still being written.

State is kept by content and by path, in the query's checkpoint, so that a restart goes on where the stream stopped. What a key gets in one
micro-batch is bounded by the source's limit on a micro-batch (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``), and has no contents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import queue_name

FILE, QUEUE = "FTP", "QUEUE"
ARRIVALS = ("name", "sha256", "size", "ingress", "seq")


def from_files(files: DataFrame, name: Column, seq: Column) -> DataFrame:
    """Arrivals of a stream of files (content)."""
    return files.select(
        name.alias("name"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"), F.lit(FILE).alias("ingress"), seq.cast("long").alias("seq")
    )


def from_messages(messages: DataFrame, seq: Column, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Arrivals of a stream of messages (value, topic, partition, offset), and the malformed ones as they came.

    An envelope ``{messageId, source, payload}`` names its arrival and holds its content; any other JSON is content as it stands.
    """
    read = messages.withColumn("_v", F.try_parse_json(value))
    get = lambda path: F.try_variant_get("_v", path, "string")
    content = F.coalesce(get("$.payload"), F.col(value))
    name = queue_name(get("$.source"), get("$.messageId"), F.col("topic"), F.col("partition"), F.col("offset"))
    good = read.where("_v IS NOT NULL").select(
        name.alias("name"), F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("size"), F.lit(QUEUE).alias("ingress"), seq.cast("long").alias("seq")
    )
    return good, read.where("_v IS NULL").drop("_v")


def verdicts(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One content's arrivals in the order of seq: NEW the first time ever, then DUPLICATE under the same name and REDELIVERY under another."""
    rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
    first_seq, first_name, times = state.get if state.exists else (int(rows["seq"].iloc[0]), rows["name"].iloc[0], 0)
    again = rows["name"].map(lambda n: "DUPLICATE" if n == first_name or n is None and first_name is None else "REDELIVERY")
    out = rows.assign(verdict=again, prior_seq=first_seq, times_seen=range(times + 1, times + 1 + len(rows)))
    if not times:
        out.iloc[0, out.columns.get_loc("verdict")] = "NEW"
    state.update((first_seq, first_name, times + len(rows)))
    yield out[[*ARRIVALS, "verdict", "prior_seq", "times_seen"]]


def with_verdicts(arrivals: DataFrame) -> DataFrame:
    """A stream of arrivals (from one or several sources) with verdict, prior_seq (of the first arrival of the content) and times_seen.

    Only NEW arrivals are to be recorded and passed on; the others are to be audited. As a table, ``arrivals.dedupe_verdicts`` gives the same verdicts
    where micro-batches come in the order of seq.
    """
    schema = "name string, sha256 string, size long, ingress string, seq long, verdict string, prior_seq long, times_seen long"
    held = "first_seq long, first_name string, times long"
    return arrivals.groupBy("sha256").applyInPandasWithState(verdicts, schema, held, "append", GroupStateTimeout.NoTimeout)


def quiet_files(
    scans: DataFrame, path: str, seq: str, time: str, state: Sequence[str], interval: float, quiet: float, sentinel: str | None = None, forget: float | None = None
) -> DataFrame:
    """(path, seq): the scan at which each file of a stream of scans counts as completely written, once for each appearance of it.

    As ``arrivals.quiescent`` on a table: a file is complete when its ``state`` stayed the same for ``quiet`` seconds of scans ``interval`` apart, or at its first unchanged scan
    if its ``sentinel`` exists; any change starts anew, and a file that a scan missed is a new one. Each observation sets the file's timer anew, by the scans' own ``time``
    (so that a stop of the stream isn't a silence of the files): a file that no scan has seen for ``forget`` seconds (three intervals) has vanished, and its state goes.
    """
    wait = int(1000 * (3 * interval if forget is None else forget))
    mark = F.to_json(F.struct(*state), {"ignoreNullFields": "false"})
    rows = scans.select(
        F.col(path).cast("string").alias("path"), F.col(seq).cast("long").alias("seq"), F.col(time).alias("time"), mark.alias("mark"),
        (F.col(sentinel) if sentinel else F.lit(False)).cast("boolean").alias("sentinel"),
    )

    def observe(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        last, mark, still, told = held.get if held.exists else (None, None, 0, False)
        done = []
        seen = pd.concat(list(frames)).sort_values("seq", kind="stable")
        for r in seen.itertuples():
            if last is None or r.seq != last + 1:  # not seen before, or missed by a scan
                still, told = 0, False
            else:
                still = still + 1 if r.mark == mark else 0
            last, mark = r.seq, r.mark
            if not told and still and (still * interval >= quiet or r.sentinel):
                told = True
                done.append(r.seq)
        held.update((int(last), mark, still, told))
        held.setTimeoutTimestamp(max(int(seen["time"].max().timestamp() * 1000) + wait, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"path": [key[0]] * len(done), "seq": pd.Series(done, dtype="int64")})

    return rows.withWatermark("time", f"{wait} milliseconds").groupBy("path").applyInPandasWithState(
        observe, "path string, seq long", "last long, mark string, still long, told boolean", "append", GroupStateTimeout.EventTimeTimeout
    )
