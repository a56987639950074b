"""A user's own predictor as a table function of SQL: sequences in, instances out, in the tasks that read them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: What a predictor gives for each instance, the last ones optional.
FIELDS = "feature string, start int, stop int, evalue double, bit_score double, hmm_from int, hmm_to int"


def register_predictor(spark: SparkSession, name: str, tool: str, predict: Callable[[str], Iterable[tuple]]) -> None:
    """Make ``predict`` the table function ``name`` of ``spark``:

        SELECT id AS protein_id, p.* FROM fasta, LATERAL name(sequence) AS p

    ``predict`` gets a sequence and gives (feature, start, stop[, evalue, bit_score, hmm_from, hmm_to]) for each
    instance; features are named ``<tool>_<feature>``. Sequences come to it in Arrow batches; a null one has no
    instances, and neither has one for which it gives none. A position that is not within the sequence is an error.
    """
    width = len(FIELDS.split(", "))

    class Predictor:
        def eval(self, sequence: str) -> Iterator[tuple]:
            if sequence is None:
                return
            for found in predict(sequence):
                feature, start, stop, *more = found
                if not 1 <= start <= stop <= len(sequence):
                    raise ValueError(f"{name}: {feature} from {start} to {stop} in a sequence of {len(sequence)}")
                yield (f"{tool}_{feature}", int(start), int(stop), *more, *[None] * (width - 3 - len(more)))

    spark.udtf.register(name, F.udtf(Predictor, returnType=FIELDS, useArrow=True))
