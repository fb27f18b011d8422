"""Keys and models for a rate-limited service: which are usable, in what order they are tried, and how runs went.

Values of keys never enter a DataFrame: tables have names, and runs are read from logs of their calls.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import errors as E
from ..functions.urls import strip
from .dedup import first_wins, ranked


def usable_keys(names: DataFrame, *, no_free: bool = False) -> DataFrame:
    """name, tier, interval in trial order. ``names``: pos, name, value_id (equal for equal values, null for blank ones), placeholder."""
    good = names.where(F.col("name").rlike(E.KEY_NAME) & F.col("value_id").isNotNull() & ~F.coalesce("placeholder", F.lit(False)))
    first = first_wins(good, "value_id", "pos")
    free = F.contains(F.upper("name"), F.lit("FREE"))
    tiers = first.select("name", F.when(free, "free").otherwise("paid").alias("tier"), F.when(free, 4.5).otherwise(0.5).alias("interval"))
    return tiers.where("tier = 'paid'") if no_free else tiers


def trial_order(keys: DataFrame) -> DataFrame:
    """Free keys before paid ones, by name."""
    return keys.orderBy("tier", "name")


def trial_places(keys: DataFrame) -> DataFrame:
    """``keys`` with place, from 1, in trial order: what a table can tell of an order."""
    return ranked(keys, "tier", "name", name="place")


def models(primary: Column, fallbacks: Column) -> Column:
    """Trimmed, first of equals, in order; a bad name or none at all is an error."""
    listed = F.filter(F.transform(F.concat(F.array(F.coalesce(primary, F.lit(""))), F.split(F.coalesce(fallbacks, F.lit("")), ",")), strip), lambda m: m != "")
    bad = F.filter(listed, lambda m: ~m.rlike(E.MODEL_NAME))
    return F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("bad model name: "), F.get(bad, F.lit(0))))).when(F.size(listed) == 0, F.raise_error(F.lit("no model is set"))).otherwise(F.array_distinct(listed))


def trial_plan(model_list: DataFrame, keys: DataFrame, attempts: int) -> DataFrame:
    """model, attempt, key, tier in the order in which a run would try them: free keys in each attempt, paid keys once.

    Keys stay where they are; what goes to all of them are the models and attempts, which are settings.
    """
    rounds = keys.sparkSession.range(attempts).select(F.col("id").cast("int").alias("attempt"))
    free = keys.where("tier = 'free'").crossJoin(F.broadcast(model_list.crossJoin(rounds))).select(*model_list.columns, "attempt", *keys.columns)
    paid = keys.where("tier = 'paid'").crossJoin(F.broadcast(model_list.withColumn("attempt", F.lit(attempts)))).select(*model_list.columns, "attempt", *keys.columns)
    return free.unionByName(paid)


def call_counts(calls: DataFrame) -> DataFrame:
    """tier, calls: answered calls (null outcome), empty answers among them (empty outcome); errors are no calls."""
    return calls.where(F.coalesce("outcome", F.lit("")) == "").groupBy("tier").agg(F.count(F.lit(1)).alias("calls"))


def run_results(calls: DataFrame) -> DataFrame:
    """run, result, model, key, calls_free, calls_paid, bad_models of observed calls: run, seq, model, key, tier, outcome.

    The first answer that isn't empty ends a run well; otherwise it was busy if its last call found the service busy, and exhausted
    if not. All is combined before the shuffle, so a run of very many calls costs one row a task.
    """
    kind = F.when(F.col("outcome") == "", "empty").otherwise(E.classify(F.col("outcome"), F.col("tier")))
    own = calls.select("run", "seq", "model", "key", "tier", kind.alias("kind"))
    ok, answered = F.col("kind") == "ok", F.col("kind").isin("ok", "empty")
    ends = own.groupBy("run").agg(
        F.min_by(F.when(ok, F.struct("model", "key")), F.when(ok, F.col("seq"))).alias("first"),
        F.max_by("kind", "seq").alias("last"),
        F.count_if(answered & (F.col("tier") == "free")).alias("calls_free"),
        F.count_if(answered & (F.col("tier") != "free")).alias("calls_paid"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == "no_model", F.col("model")))), ",").alias("bad_models"),
    )
    result = F.when(F.col("first").isNotNull(), "ok").when(F.col("last") == "transient", "busy").otherwise("exhausted")
    return ends.select("run", result.alias("result"), "first.model", "first.key", "calls_free", "calls_paid", "bad_models")


def models_per_key(listed: DataFrame) -> DataFrame:
    """key, models: how many of a key's listed models (key, model, actions) have a name and generate."""
    usable = E.supports_generate(F.col("actions")) & (F.coalesce("model", F.lit("")) != "")
    return listed.groupBy("key").agg(F.count_if(usable).alias("models"))


def call_estimate(counts: DataFrame, n: str) -> DataFrame:
    """``counts`` with calls_least, calls_most: an item costs one call with captions and two without."""
    return counts.withColumn("calls_least", F.col(n)).withColumn("calls_most", 2 * F.col(n))


def first_client(trials: DataFrame, key: str) -> DataFrame:
    """key, client, tried: the first client by ``n`` that succeeds; a permanent error ends the trials. ``trials``: key, n, client, message (null: success)."""
    stop = trials.groupBy(key).agg(F.min(F.when(E.is_permanent(F.col("message")), F.col("n"))).alias("_stop"), F.min(F.when(F.col("message").isNull(), F.col("n"))).alias("_ok"))
    ended = F.least(F.col("_stop"), F.col("_ok"))
    joined = trials.join(stop, key).where(ended.isNull() | (F.col("n") <= ended))
    return joined.groupBy(key).agg(F.min_by(F.when(F.col("message").isNull(), F.col("client")), F.when(F.col("message").isNull(), F.col("n"))).alias("client"), F.count(F.lit(1)).alias("tried"))


#: Services of this worker process, by the name they are shared under.
_SHARED: dict[str, object] = {}


def _made(setup: Callable | None, shared: str | None):
    if not shared:
        return setup() if setup else None
    if shared not in _SHARED:
        _SHARED[shared] = setup()
    return _SHARED[shared]


def with_service(rows: DataFrame, work, schema: str, setup=None, *, shared: str | None = None) -> DataFrame:
    """Apply ``work(service, batch)`` to pandas batches; ``setup()`` makes one service a task. The call itself is the caller's.

    Under a ``shared`` name a worker process makes one service and keeps it, for all tasks and all operators that use the name: a pool that
    transcribes and refines knows in the one step what it learned in the other.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = _made(setup, shared)
        for batch in batches:
            yield work(service, batch)

    return rows.mapInPandas(run, schema)


def with_clients(rows: DataFrame, call: Callable, *, key: str, url: str = "url", clients: str = "clients", wait: float = 0.0, clock: Callable = time.monotonic, sleep: Callable = time.sleep) -> DataFrame:
    """key, client, result, tried, message, seconds: ``call(url, client)`` by each of a row's ``clients`` (array) until one answers.

    An exception goes on to the next client after ``wait`` seconds, unless its message is permanent; without an answer client and
    result are null. ``call``, ``clock`` and ``sleep`` are the caller's and must pickle.
    """
    kind = rows.schema[key].dataType.simpleString()

    def tried(one, names):
        client = result = message = None
        n, began = 0, clock()
        for n, name in enumerate(names if names is not None else (), 1):
            if n > 1 and wait:
                sleep(wait)
            try:
                client, result, message = name, call(one, name), None
                break
            except Exception as error:  # the caller's call may raise anything
                client, message = None, str(error)
                if any(said in message.lower() for said in E.PERMANENT):
                    break
        return client, result, n, message, clock() - began

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([tried(u, c) for u, c in zip(batch["_url"], batch["_clients"])], columns=["client", "result", "tried", "message", "seconds"])
            yield pd.concat([batch[["_key"]].reset_index(drop=True), found], axis=1)

    asked = rows.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(clients).alias("_clients"))
    return asked.mapInPandas(run, f"_key {kind}, client string, result string, tried long, message string, seconds double").withColumnRenamed("_key", key)


def transcribed(files: DataFrame, upload: Callable, state: Callable, answer: Callable, *, path: str = "path", poll: float = 2.0, sleep: Callable = time.sleep) -> DataFrame:
    """path, text: each file is uploaded, its state asked for every ``poll`` seconds while it is "PROCESSING", then its text fetched; null if it fails.

    ``upload(path)``, ``state(handle)`` and ``answer(handle)`` are the caller's and must pickle.
    """

    def one(name):
        handle = upload(name)
        while (now := state(handle)) == "PROCESSING":
            sleep(poll)
        return None if now == "FAILED" else answer(handle)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "text": [one(p) for p in batch["path"]]})

    return files.select(F.col(path).alias("path")).mapInPandas(run, "path string, text string")
