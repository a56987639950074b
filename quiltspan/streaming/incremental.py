"""Incremental scoring: a stream of pair lists, each pair scored once, whichever way round it comes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState

from ..operators.maintenance import unordered
from ..options import ScoringOptions
from ..plans.scoring import score_pairs
from ..storage import cut


def first_seen(pairs: DataFrame) -> DataFrame:
    """Of a stream of pairs (seed, query) those that come for the first time, either way round; of a batch's equal ones
    the first by seed and query. Keyed state remembers one flag for each pair, so that a batch costs what its own
    pairs cost, however many there have been."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        least = min(((a, b) for part in parts for a, b in zip(part["seed"], part["query"], strict=True)), default=None)
        if least is not None and not state.exists:
            state.update((True,))
            yield pd.DataFrame([least], columns=["seed", "query"])

    lo, hi = unordered()
    keyed = pairs.where("seed is not null and query is not null").withColumns({"lo": lo, "hi": hi})
    return keyed.groupBy("lo", "hi").applyInPandasWithState(run, "seed string, query string", "seen boolean", "append", "NoTimeout")


def score_new_pairs(spark: SparkSession, pair_dir: str, out: str, checkpoint: str, proteins: DataFrame, options: ScoringOptions) -> None:
    """Score the pairs of the files that are new in ``pair_dir`` and add them to the Parquet table ``out``.

    ``proteins`` are prepared ones. Which pairs are new is known from the stream's state in ``checkpoint`` alone: the
    table is never read. A batch is written under its number, and its state under its version, so that a batch that is
    run again finds the same pairs new and replaces its own rows.
    """
    pairs = spark.readStream.schema("seed string, query string").option("sep", "\t").csv(pair_dir)

    def batch(rows: DataFrame, number: int) -> None:
        new = cut(rows.select("seed", "query"), "new-pairs")  # the state is asked once
        score_pairs(new, proteins, proteins, options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    first_seen(pairs).writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

