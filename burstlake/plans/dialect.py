"""Queries written once as SQL for two engines: the few points where their dialects differ are methods here."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from burstlake.sources.tables import PHOTO_ROWS, TABLES, prefixed, register


@dataclass(frozen=True)
class Dialect:
    name: str

    @property
    def spark(self) -> bool:
        return self.name == "spark"

    def at(self, array: str, i: str) -> str:
        """Element of an array, counted from 0; null outside."""
        return f"get({array}, CAST({i} AS INT))" if self.spark else f"{array}[CAST({i} AS INT) + 1]"

    def each(self, array: str, var: str, body: str) -> str:
        return f"transform({array}, {var} -> {body})" if self.spark else f"list_transform({array}, lambda {var}: {body})"

    def keep(self, array: str, var: str, body: str) -> str:
        return f"filter({array}, {var} -> {body})" if self.spark else f"list_filter({array}, lambda {var}: {body})"

    def series(self, n: int | str, alias: str) -> str:
        """A cross join with the numbers 0 to n - 1."""
        return f"LATERAL VIEW explode(sequence(0, {n} - 1)) AS {alias}" if self.spark else f"CROSS JOIN (SELECT CAST(unnest(range({n})) AS INT) AS {alias})"

    def total(self, array: str) -> str:
        return f"aggregate({array}, CAST(0 AS DOUBLE), (a, x) -> a + x)" if self.spark else f"list_sum({array})"

    def range(self, n: int | str) -> str:
        """The array of the numbers 0 to n - 1."""
        return f"sequence(0, {n} - 1)" if self.spark else f"range({n})"

    def head(self, array: str, n: int) -> str:
        return f"slice({array}, 1, {n})" if self.spark else f"{array}[1:{n}]"

    def head_of(self, array: str, n: str) -> str:
        """The first n items, n an expression that may be 0."""
        return f"slice({array}, 1, {n})" if self.spark else f"{array}[1:{n}]"

    def least_of(self, array: str) -> str:
        return f"array_min({array})" if self.spark else f"list_min({array})"

    def most_of(self, array: str) -> str:
        return f"array_max({array})" if self.spark else f"list_max({array})"

    def let(self, value: str, var: str, body: str) -> str:
        """body with var standing for value, which is worked out once."""
        return self.at(self.each(self.list(value), var, body), "0")

    def record(self, **fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")" if self.spark else "struct_pack(" + ", ".join(f"{k} := {v}" for k, v in fields.items()) + ")"

    def iterate(self, start: str, times: int, var: str, body: str) -> str:
        """start put through body ``times`` times; body has the type of start."""
        if self.spark:
            return f"aggregate(sequence(1, {times}), {start}, ({var}, i_) -> {body})"
        return f"list_reduce(list_transform(range({times + 1}), lambda i_: {start}), lambda {var}, e_: {body})"

    def quantile(self, array: str, share: float) -> str:
        """Linear between the neighbouring values in order; null for no values."""
        at = f"((len_ - 1) * {share!r})"
        inner = f"{self.at('s_', f'floor({at})')} + ({self.at('s_', f'least(floor({at}) + 1, len_ - 1)')} - {self.at('s_', f'floor({at})')}) * ({at} - floor({at}))"
        ordered = f"sort_array({array})" if self.spark else f"list_sort({array})"
        return self.let(ordered, "s_", inner.replace("len_", self.size("s_")))

    def median(self, array: str) -> str:
        return self.quantile(array, 0.5)

    def mean(self, array: str) -> str:
        return self.let(array, "m_", f"({self.total('m_')} / {self.size('m_')})")

    def levels(self, source: str, **columns: str) -> str:
        """source with more columns, each worked out once for a row however often later ones read it."""
        if not self.spark:
            return f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM ({source})"
        return f"SELECT * FROM ({LEVEL}{source}{END}) LATERAL VIEW inline(array(struct({', '.join(columns.values())}))) AS {', '.join(columns)}"

    def size(self, array: str) -> str:
        return f"size({array})" if self.spark else f"len({array})"

    def list(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))" if self.spark else f"(({a}) // ({b}))"

    def hit(self, text: str, pattern: str) -> str:
        return f"regexp_like({text}, r'{pattern}')" if self.spark else f"regexp_matches({text}, '{pattern}')"

    def pick(self, text: str, pattern: str, group: int) -> str:
        return f"regexp_extract({text}, r'{pattern}', {group})" if self.spark else f"regexp_extract({text}, '{pattern}', {group})"

    def all(self, text: str, pattern: str) -> str:
        return f"regexp_extract_all({text}, r'{pattern}', 0)" if self.spark else f"regexp_extract_all({text}, '{pattern}')"

    def sub(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, r'{pattern}', '{by}')" if self.spark else f"regexp_replace({text}, '{pattern}', '{by}', 'g')"

    def micros(self, ts: str) -> str:
        return f"unix_micros(CAST({ts} AS TIMESTAMP))" if self.spark else f"epoch_us({ts})"

    def number(self, text: str) -> str:
        return f"try_cast({text} AS DOUBLE)" if self.spark else f"TRY_CAST({text} AS DOUBLE)"

    def percentile(self, x: str, p: float) -> str:
        return f"percentile({x}, {p})" if self.spark else f"quantile_cont({x}, {p})"

    def quotient(self, a: str, b: str) -> str:
        """a / b, null where b is 0."""
        return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


SPARK, DUCK = Dialect("spark"), Dialect("duck")
#: What encloses the source of a level in a text for Spark, and how many levels are resolved at once.
LEVEL, END, AT_ONCE = "\x01", "\x02", 6


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    """The text as a DataFrame.  The analyser takes a bounded number of passes, some for each nested level of columns, so
    that inner levels are resolved first, a few at a time."""
    views: dict[str, str] = {}

    def resolved(part: str) -> tuple[str, int]:
        out, depth, i = "", 0, 0
        while (j := part.find(LEVEL, i)) >= 0:
            k, nested = j + 1, 1
            while nested:
                nested += (part[k] == LEVEL) - (part[k] == END)
                k += 1
            inner, d = resolved(part[j + 1 : k - 1])
            if d >= AT_ONCE:
                if inner not in views:
                    views[inner] = f"step_{uuid.uuid4().hex}"
                    spark.sql(inner).createOrReplaceTempView(views[inner])
                inner, d = f"SELECT * FROM {views[inner]}", 0
            out += part[i:j] + inner
            depth, i = max(depth, d + 1), k
        return out + part[i:], depth

    try:
        return spark.sql(resolved(text)[0])
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def _doubles(sql: str) -> str:
    """Decimal literals as doubles, so that both engines do the same arithmetic."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.])", r"\1E0", sql)


class Catalog:
    """Named queries; each is given as a function from a dialect to SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}
        #: Names that stand for more than a table: how Spark makes them a view, and what they are in plain SQL.
        self.derived: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}

    def add(self, sql: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
        text = _doubles(sql(SPARK))
        names = tuple(t for t in (*TABLES, PHOTO_ROWS) if re.search(rf"\b{t}\b", text))
        derived = [n for n in self.derived if re.search(rf"\b{n}\b", text)]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            register(spark, sf_dir, names)
            out = prefixed(text)
            for n in derived:
                view = f"{n}_{uuid.uuid4().hex}"
                self.derived[n][0](spark, sf_dir).createOrReplaceTempView(view)
                out = re.sub(rf"\b{n}\b", view, out)
            return run_sql(spark, out)

        self.queries[sql.__name__] = run
        plain = sql(DUCK).replace(LEVEL, "").replace(END, "")
        for n, (_, meaning) in self.derived.items():
            plain = re.sub(rf"\b{n}\b", lambda m, x=meaning: f"({x})", plain)
        self.oracles[sql.__name__] = _doubles(plain)
        return sql
