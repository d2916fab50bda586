"""Relations as chains of SQL steps, which Spark plans as a whole and DuckDB can repeat for the oracle.

A step is one SELECT over the step before it; equal steps have equal names, so shared sub-plans are written once. Text is in Spark's dialect with a few
macros where the engines differ:

    KNOWN(x) OVER (...)     the last value that isn't null in the frame
    EXPAND(a, b)            one row for each integer from a to b
    JOINED(x, order)        strings of a group joined by commas in an order
    LISTED(x, order)        values of a group as a list in an order
    ITEM(list, i)           the item of a list at place i, from 1
    RAISE(text)             an error
    LN(x)                   ln(x) by the C library, as DuckDB has it, for values that are ranked: Spark's own differs in the last bit for one in 25
    DEVIATION(x, order)     OVER (...): stddev_samp(x) added up in that order as DuckDB does on one thread, for values that are ranked: Spark's own may differ in the last bit
    LONG(x)                 a 64-bit integer, for numbers that Spark has in 32 bits and DuckDB in 64
    {name}                  a table

Numbers are written with an exponent, which makes them doubles in both engines; see num().
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType


def num(x: float) -> str:
    """A double literal."""
    text = repr(float(x))
    return text if "e" in text else f"{text}e0"


def _arguments(text: str, start: int) -> tuple[list[str], int]:
    """The arguments of a call whose parenthesis opens at start, and the place after it."""
    depth, parts, last, quoted = 0, [], start + 1, False
    for i in range(start, len(text)):
        c = text[i]
        if c == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return [*parts, text[last:i].strip()], i + 1
        elif c == "," and depth == 1:
            parts.append(text[last:i].strip())
            last = i + 1
    raise ValueError(f"unbalanced: {text[start : start + 80]}")


def _replaced(text: str, name: str, form) -> str:
    pattern, out, at = re.compile(rf"\b{name}\("), [], 0
    while m := pattern.search(text, at):
        args, end = _arguments(text, m.end() - 1)
        out += [text[at : m.start()], form(*(_replaced(a, name, form) for a in args))]
        at = end
    return "".join([*out, text[at:]])


@arrow_udf(DoubleType())
def _libm_ln(x: pa.Array) -> pa.Array:
    return pa.array([None if v is None or v <= 0 else math.log(v) for v in x.to_pylist()], pa.float64())


@arrow_udf(DoubleType())
def _running_deviation(x: pa.Array, order: pa.Array) -> float:
    n, mean, squares = 0, 0.0, 0.0
    for v in x.take(pc.sort_indices(order)).drop_null().to_pylist():
        n += 1
        moved = mean + (v - mean) / n
        squares += (v - moved) * (v - mean)
        mean = moved
    return math.sqrt(squares / (n - 1)) if n > 1 else None


#: Functions that the spelling for Spark calls by name.
FUNCTIONS = {"libm_ln": _libm_ln, "running_deviation": _running_deviation}

SPARK = {
    "KNOWN": lambda x: f"last_value({x}) IGNORE NULLS",
    "EXPAND": lambda a, b: f"explode(sequence(cast({a} AS bigint), cast({b} AS bigint)))",
    "JOINED": lambda x, order: f"listagg({x}, ',') WITHIN GROUP (ORDER BY {order})",
    "LISTED": lambda x, order: f"array_sort(collect_list(struct({order} AS at, {x} AS item))).item",
    "ITEM": lambda x, i: f"element_at({x}, {i})",
    "RAISE": lambda text: f"cast(raise_error({text}) AS double)",
    "LN": lambda x: f"libm_ln({x})",
    "DEVIATION": lambda x, order: f"running_deviation({x}, {order})",
    "LONG": lambda x: f"cast({x} AS bigint)",
}
DUCK = {
    "KNOWN": lambda x: f"last_value({x} IGNORE NULLS)",
    "EXPAND": lambda a, b: f"unnest(generate_series({a}, {b}))",
    "JOINED": lambda x, order: f"string_agg({x}, ',' ORDER BY {order})",
    "LISTED": lambda x, order: f"list({x} ORDER BY {order})",
    "ITEM": lambda x, i: f"list_extract({x}, {i})",
    "RAISE": lambda text: f"cast(error({text}) AS double)",
    "LN": lambda x: f"ln({x})",
    "DEVIATION": lambda x, order: f"stddev_samp({x})",
    "LONG": lambda x: x,
    "percentile": lambda x, p: f"quantile_cont({x}, {p})",
    "sha2": lambda x, bits: f"sha256({x})",
    "kurtosis": lambda x: f"kurtosis_pop({x})",
}


STEP = re.compile(r"\bs[0-9a-f]{10}\b")


class Relation:
    """A chain of named SELECT steps; the last one is the relation."""

    def __init__(self, steps: tuple[tuple[str, str], ...], frames: dict[str, DataFrame] | None = None) -> None:
        self.steps, self.frames = steps, frames or {}

    @property
    def name(self) -> str:
        return self.steps[-1][0]

    @classmethod
    def select(cls, sql: str, *of: Relation, frames: dict[str, DataFrame] | None = None) -> Relation:
        """A SELECT over tables in braces, and over relations as $1, $2 and so on."""
        for i, r in enumerate(of, 1):
            sql = re.sub(rf"\${i}\b", r.name, sql)
        steps = dict(s for r in of for s in r.steps)
        # what only Spark needs is left out of the name, so that the text for DuckDB is that without it
        plain = sql
        for name in ("LN", "LONG", "DEVIATION"):
            plain = _replaced(plain, name, DUCK[name])
        steps["s" + hashlib.md5(plain.encode()).hexdigest()[:10]] = sql
        held = {k: v for r in of for k, v in r.frames.items()} | (frames or {})
        return cls(tuple(steps.items()), held)

    @classmethod
    def of(cls, df: DataFrame) -> Relation:
        """A relation over a frame of the caller's."""
        name = f"f{id(df):x}"
        return cls.select(f"SELECT * FROM {{{name}}}", frames={name: df})

    def then(self, sql: str, *more: Relation) -> Relation:
        return Relation.select(sql, self, *more)

    def add(self, **columns: str) -> Relation:
        """All columns and new ones."""
        return self.then("SELECT *, " + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + " FROM $1")

    def keep(self, *columns: str, **more: str) -> Relation:
        return self.then("SELECT " + ", ".join([*columns, *(f"{sql} AS {name}" for name, sql in more.items())]) + " FROM $1")

    def where(self, condition: str) -> Relation:
        return self.then(f"SELECT * FROM $1 WHERE {condition}")

    def group(self, *keys: str, **aggregates: str) -> Relation:
        columns = ", ".join([*keys, *(f"{sql} AS {name}" for name, sql in aggregates.items())])
        return self.then(f"SELECT {columns} FROM $1" + (f" GROUP BY {', '.join(keys)}" if keys else ""))

    @staticmethod
    def _spelled(sql: str, macros: dict, tables: Callable[[str], str]) -> str:
        for name, form in macros.items():
            sql = _replaced(sql, name, form)
        return re.sub(r"\{(\w+)\}", lambda m: tables(m[1]), sql)

    def sql(self) -> str:
        """The text for DuckDB, over views named like the tables."""
        body = ",\n".join(f"{n} AS ({self._spelled(sql, DUCK, lambda t: t)})" for n, sql in self.steps)
        return f"WITH {body}\nSELECT * FROM {self.name}"

    def frame(self, spark: SparkSession, sf_dir: str = "") -> DataFrame:
        """The frame that Spark plans for it; tables are read from the folder. Steps are analysed one after the other, as the analyser's passes are limited."""
        done: dict[str, DataFrame] = {}
        for name, sql in self.steps:
            text = self._spelled(sql, SPARK, lambda t: f"{{{t}}}" if t in self.frames else f"parquet.`{sf_dir}/{t}.parquet`")
            text = STEP.sub(lambda m: f"{{{m[0]}}}" if m[0] in done else m[0], text)
            used = {k: v for k, v in (self.frames | done).items() if f"{{{k}}}" in text}
            for function in FUNCTIONS.keys() & set(re.findall(r"\w+(?=\()", text)):
                spark.udf.register(function, FUNCTIONS[function])
            done[name] = spark.sql(text, **used)
        return done[self.name]


def rounded(columns: Iterable[str], digits: int = 4) -> list[str]:
    """Doubles for comparison between engines: rounded, without a negative zero. The offset decides values that lie half-way but for noise."""
    return [f"round({c} + 3.1e-11, {digits}) + 0e0 AS {c}" for c in columns]
