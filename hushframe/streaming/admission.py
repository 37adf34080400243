"""Budget admission on a stream of requests, with the same answer as ``operators.ledger.admit``.

``admit_stream`` keeps the spent amounts as operator state, of many keys together, and takes requests in slices of bounded size.
``admit_micro_batches`` settles each micro-batch with the batch operator against a stored ledger, so a
backlog in which one user holds most of the requests is spread over the cluster as well.
"""

from __future__ import annotations

import heapq
import io
import json
from collections.abc import Iterable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from hushframe.errors import LibraryFailure
from hushframe.operators.ledger import AMOUNTS, KEYS, admit, amount
from hushframe.session import written

PARTS = 1 << 12  # groups of keys that share a state: a call and a state cost the same for many keys as for one
SLICE = 4096  # requests of a key or part that are in memory at a time, from each slice that Spark hands over and in each that is handed on
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # holds a part's waiting slices on disk
OUTPUT = "user_name string, dataset_name string, request_id bigint, cost_epsilon double, cost_delta double, admitted boolean"


SPENT = f"user_name string, dataset_name string, e {AMOUNTS['epsilon']}, d {AMOUNTS['delta']}"


def admit_stream(requests: DataFrame, budgets: DataFrame) -> DataFrame:
    """Admit requests in order per (user, dataset); the spent amounts are the state.

    Requests must arrive in request order across micro-batches; one that is older than a request settled
    before it fails the stream, since its answer would depend on the order of arrival.  Requests above the whole budget
    never reach the state.  Keys are dealt to ``PARTS`` parts by a hash; a part's keys are settled together, in request
    order, and share one state.  Within a micro-batch a part's requests come in any order and in any number: slices are
    sorted as they come, wait in the part's state in pieces, and are merged piece by piece, so no task holds a key's
    requests, only the amounts of one part's keys.  The session's state store is set to the one on disk that this needs.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    budget = budgets.select(*KEYS, amount("epsilon", "epsilon").alias("be"), amount("delta", "delta").alias("bd"))
    priced = requests.join(budget, KEYS, "left").withColumns(
        {"e": amount("cost_epsilon", "epsilon"), "d": amount("cost_delta", "delta")})
    affordable = F.coalesce((F.col("e") <= F.col("be")) & (F.col("d") <= F.col("bd")), F.lit(False))
    plain = [*KEYS, "request_id", "cost_epsilon", "cost_delta"]
    refused = priced.filter(~affordable).select(*plain, F.lit(False).alias("admitted"))
    decided = (
        priced.filter(affordable).select(F.pmod(F.xxhash64(*KEYS), F.lit(PARTS)).cast("int").alias("part"), *plain, "e", "d", "be", "bd")
        .groupBy("part")
        .transformWithStateInPandas(PartAdmission(), OUTPUT, "Append", "None")
    )
    return decided.unionByName(refused)


def admit_micro_batches(requests: DataFrame, budgets: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writer that stores decisions under ``path/decisions`` and amounts spent so far under ``path/spent``.

    Both are written per batch number and replaced when a batch is retried; a batch reads only the totals
    of the batch before it, so a retry decides the same.
    """

    def settle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(SPENT).parquet(f"{path}/spent/batch={number - 1}") if number else spark.createDataFrame([], SPENT)
        left = budgets.join(before, KEYS, "left").select(
            *KEYS, (amount("epsilon", "epsilon") - F.coalesce("e", F.lit(0).cast(AMOUNTS["epsilon"]))).alias("epsilon"),
            (amount("delta", "delta") - F.coalesce("d", F.lit(0).cast(AMOUNTS["delta"]))).alias("delta"))
        decided = admit(written(batch, "admission-batch"), left)  # read once from its source
        decided.write.mode("overwrite").parquet(f"{path}/decisions/batch={number}")
        stored = spark.read.schema(decided.schema).parquet(f"{path}/decisions/batch={number}").filter("admitted")
        fresh = stored.select(*KEYS, amount("cost_epsilon", "epsilon").alias("e"), amount("cost_delta", "delta").alias("d"))
        totals = fresh.unionByName(before).groupBy(*KEYS).agg(F.sum("e").cast(AMOUNTS["epsilon"]).alias("e"), F.sum("d").cast(AMOUNTS["delta"]).alias("d"))
        totals.write.mode("overwrite").parquet(f"{path}/spent/batch={number}")

    return requests.writeStream.foreachBatch(settle).option("checkpointLocation", checkpoint)


class Admission(StatefulProcessor):
    """Per (user, dataset): the amounts spent, the last request settled, and the slices of the running micro-batch."""

    def __init__(self, slice: int = SLICE):
        self.slice = slice

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "e string, d string, last bigint")
        self.waiting = handle.getMapState("waiting", "run int, piece int", "rows binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        e, d, last = self.spent.get() if self.spent.exists() else ("0", "0", None)
        spent_e, spent_d = Decimal(e), Decimal(d)
        for part in self._in_order(rows):
            if last is not None and part["request_id"].iloc[0] <= last:
                raise LibraryFailure(f"request {part['request_id'].iloc[0]} of {key} arrived after request {last}")
            admitted = []
            for e, d, be, bd in zip(part["e"], part["d"], part["be"], part["bd"]):
                fits = spent_e + e <= be and spent_d + d <= bd
                admitted.append(fits)
                if fits:
                    spent_e, spent_d = spent_e + e, spent_d + d
            ended = int(part["request_id"].iloc[-1])
            out = part[["request_id", "cost_epsilon", "cost_delta"]].assign(user_name=key[0], dataset_name=key[1], admitted=admitted)
            yield out[["user_name", "dataset_name", "request_id", "cost_epsilon", "cost_delta", "admitted"]]
            self.spent.update((str(spent_e), str(spent_d), ended))

    def close(self) -> None:
        pass

    def _in_order(self, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """All rows by request, in pieces; more than one slice waits in the state until the last one has come."""
        first, runs = next(rows, None), []
        if first is None:
            return
        second = next(rows, None)
        if second is None:
            first = first.sort_values("request_id", kind="stable")
            for at in range(0, len(first), self.slice):
                yield first.iloc[at:at + self.slice]
            return
        while first is not None:
            runs.append(self._store(len(runs), first.sort_values("request_id", kind="stable")))
            first, second = second, next(rows, None)
        merged, held = heapq.merge(*[self._read(k, n) for k, n in enumerate(runs)], key=lambda r: r.request_id), []
        for row in merged:
            held.append(row)
            if len(held) == self.slice:
                yield pd.DataFrame(held)
                held = []
        if held:
            yield pd.DataFrame(held)
        self.waiting.clear()

    def _store(self, run: int, part: pd.DataFrame) -> int:
        size = max(64, self.slice // 16)
        for n, at in enumerate(range(0, len(part), size)):
            text = io.BytesIO()
            part.iloc[at:at + size].to_pickle(text)
            self.waiting.updateValue((run, n), (text.getvalue(),))
        return -(-len(part) // size)

    def _read(self, run: int, pieces: int) -> Iterable:
        for n in range(pieces):
            part = pd.read_pickle(io.BytesIO(self.waiting.getValue((run, n))[0]))
            self.waiting.removeKey((run, n))
            yield from part.itertuples(index=False)


class PartAdmission(Admission):
    """The same for all keys of a part at once: one call and one state, whatever the number of its keys."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "keys string")  # JSON, amounts as text
        self.waiting = handle.getMapState("waiting", "run int, piece int", "rows binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = json.loads(self.spent.get()[0]) if self.spent.exists() else []
        last = {(user, dataset): at for user, dataset, _, _, at in stored}
        state = {(user, dataset): (Decimal(e), Decimal(d), at) for user, dataset, e, d, at in stored}
        for part in self._in_order(rows):
            admitted = []
            for user, dataset, request, e, d, be, bd in zip(*[part[c] for c in (*KEYS, "request_id", "e", "d", "be", "bd")]):
                name = user, dataset
                if name in last and request <= last[name]:
                    raise LibraryFailure(f"request {request} of {name} arrived after request {last[name]}")
                spent_e, spent_d, _ = state.get(name, (Decimal(0), Decimal(0), None))
                fits = spent_e + e <= be and spent_d + d <= bd
                admitted.append(fits)
                state[name] = (spent_e + e, spent_d + d, int(request)) if fits else (spent_e, spent_d, int(request))
            yield part[[*KEYS, "request_id", "cost_epsilon", "cost_delta"]].assign(admitted=admitted)
        self.spent.update((json.dumps([[*name, str(e), str(d), at] for name, (e, d, at) in state.items()]),))
