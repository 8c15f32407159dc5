"""Folds over a key's rows in order, with a state that is carried from batch to batch instead of an array of the key's rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.session import ensure_on_workers


def fold_in_order(df: DataFrame, key: str, order: str, value: str, start: tuple, step: Callable, schema: str) -> DataFrame:
    """One row a key: the key and what step(state, values) makes of `start` over the key's values (numbers, not null), a stretch at a time.

    Rows are dealt by key and sorted by the task, which spills; a task holds one Arrow batch. schema: the key's and the state's columns.
    """

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [{"long": pa.int64(), "double": pa.float64()}.get(x.split()[1]) for x in schema.split(", ")][1:]
        open_, done, state = None, [], start

        def flush(kind):
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), *(pa.array([d[1][i] for d in done], kinds[i]) for i in range(len(start)))], names=names)

        for b in batches:
            keys, values = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
            at = 0
            for run_ in _ends(keys):
                k = (keys[at].as_py(),)
                if k != open_:
                    if open_ is not None:
                        done.append((open_[0], state))
                    open_, state = k, start
                state = step(state, values[at:run_])
                at = run_
            if len(done) >= 4096:
                yield flush(keys.type)
                done = []
        if open_ is not None:
            done.append((open_[0], state))
            yield flush(keys.type)

    ensure_on_workers(df.sparkSession)
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(value).alias("v"))
    return rows.repartition("k").sortWithinPartitions("k", "o").select("k", "v").mapInArrow(run, schema)


def _ends(keys) -> list[int]:
    """Ends of the runs of equal keys."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.run_end_encode(keys, run_end_type=pa.int64()).run_ends.to_pylist()
