"""Isolation of rows that fail: bisecting inside a task, so an error is a column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Fatal(Exception):
    """Ends the work of a task: its further rows are not tried."""


def run_batch(call: Callable[[list], list], rows: list, fatal: type[BaseException] = Fatal) -> list[tuple[object, str | None]]:
    """A result or an error for each row; a failing batch is halved until a single row is to blame."""
    out: list = [None] * len(rows)
    todo, stopped = [(0, len(rows))], None
    while todo:
        a, b = todo.pop()
        if a == b:
            continue
        if stopped is not None:
            out[a:b] = [(None, stopped)] * (b - a)
            continue
        try:
            out[a:b] = [(x, None) for x in call(rows[a:b])]
        except fatal as e:
            stopped = f"fatal: {e}"
            out[a:b] = [(None, stopped)] * (b - a)
        except Exception as e:  # noqa: BLE001
            if b - a == 1:
                out[a] = (None, str(e))
            else:
                mid = (a + b) // 2
                todo += [(mid, b), (a, mid)]
    return out


def apply(df: DataFrame, key: str, value: str, call: Callable[[list], list], kind: str = "string") -> DataFrame:
    """key, result and error of each row, through ``call`` on whole batches."""
    import pandas as pd

    key_kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for p in batches:
            got = run_batch(call, p[value].tolist())
            yield pd.DataFrame({key: p[key], "result": [r for r, _ in got], "error": [e for _, e in got]})

    return df.select(key, value).mapInPandas(run, f"{key} {key_kind}, result {kind}, error string")


def tensor_extent(start: Column, shape: Column, stride: Column) -> Column:
    """One past the last element that a strided tensor reads; nothing for an empty one."""
    reach = F.aggregate(F.zip_with(shape, stride, lambda n, s: (n - 1) * s), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(F.exists(shape, lambda n: n == 0), start).otherwise(start + reach + 1)


def is_contiguous(shape: Column, stride: Column) -> Column:
    """Row-major: each stride is the product of the later sizes."""
    n = F.size(shape)
    want = F.transform(F.sequence(F.lit(1), n), lambda k: F.aggregate(F.slice(shape, k + 1, F.greatest(n - k, F.lit(0))), F.lit(1).cast("long"), lambda a, x: a * x))
    return F.when(n > 0, want == stride).otherwise(F.lit(True))


def unmapped(names: DataFrame, mapping: DataFrame, name: str, show: int = 8) -> DataFrame:
    """The first names without a mapping."""
    return names.select(name).join(mapping.select(name), name, "left_anti").orderBy(name).limit(show)


def model_kind(config: Column) -> Column:
    """dense, int4 or int8 by the flags of a JSON model description."""
    flag = lambda path: F.lower(F.coalesce(F.get_json_object(config, path), F.lit("false"))) == "true"
    return F.when(flag("$.quantization.load_in_4bit"), "int4").when(flag("$.quantization.load_in_8bit"), "int8").otherwise("dense")
