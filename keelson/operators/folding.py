"""Ordered folds: decisions that depend on earlier decisions of the same key, which no running sum can express.

Rows are dealt by key and sorted within each part, so a task meets the rows of a key in
order and carries one small state from row to row and from batch to batch; it never holds
a key's rows.  What one key decides is a sequence by its nature; keys are many, and run
side by side.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

_TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}


def folded(rows: DataFrame, key: str, order: list[str], read: list[str], start: Callable, step: Callable, made: dict[str, str]) -> DataFrame:
    """``rows`` with the columns ``made`` (name to string, long or boolean).

    ``start()`` gives a key's first state; ``step(state, values of read)`` gives the values
    made and changes the state.  A null key is a key.
    """
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{n}` {t}" for n, t in made.items()])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = [], None
        for batch in batches:
            found = []
            for name, *values in zip(*(batch.column(c).to_pylist() for c in (key, *read))):
                if held != [name]:
                    held, state = [name], start()
                found.append(step(state, *values))
            arrays = [pa.array(c, t) for c, t in zip(zip(*found), (_TYPES[t] for t in made.values()))] if found else [pa.array([], _TYPES[t]) for t in made.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *made])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(fold, schema)


class Spending:
    """What a run has spent (in millionths) and how many calls it was allowed."""

    def __init__(self) -> None:
        self.calls = self.spent = 0


def authorised(calls: DataFrame, budget: int, most_calls: int, most_chars: int) -> DataFrame:
    """Calls (run_id, ts, seq, prompt_chars, micro_usd, worst_micro_usd) with spent_before and decision, in their order.

    Only an allowed call is made, and only then counts and adds what it cost (null: its
    worst case); decision says why another is refused.
    """

    def step(run: Spending, chars: int, usd: int | None, worst: int) -> tuple[int, str]:
        before, decision = run.spent, "allowed"
        if chars > most_chars:
            decision = "prompt_too_large"
        elif run.calls >= most_calls:
            decision = "call_limit"
        elif before >= budget:
            decision = "budget_exhausted"
        elif before + worst > budget:
            decision = "budget_would_be_exceeded"
        else:
            run.calls += 1
            run.spent += worst if usd is None else usd
        return before, decision

    return folded(calls, "run_id", ["ts", "seq"], ["prompt_chars", "micro_usd", "worst_micro_usd"], Spending, step, {"spent_before": "long", "decision": "string"})


cloudpickle.register_pickle_by_value(sys.modules[__name__])
