"""Table functions for SQL: words of a text, and the leading rows of a group that fit a budget.

    SELECT doc_id, t.place, t.word FROM docs, LATERAL tokenize(text) t
    SELECT * FROM within_budget(TABLE(lines), 'manager,customer,stat_date', 'line_no', 'cost', 60)

within_budget() streams a group's rows in order and holds none of them: Spark deals and sorts the rows by the columns
that the call names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, Row, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from parley.functions.segment import Dictionary


def tokenizer(words: Mapping[str, int] | Iterable[str] = ()):
    """A table function text -> (place, word): the words of a text in order, by a dictionary of Han words."""
    dictionary = Dictionary(words)

    class Tokenize:
        def eval(self, text: str) -> Iterator[tuple[int, str]]:
            yield from enumerate(dictionary.words(text))

    return udtf(Tokenize, returnType="place int, word string")


class WithinBudget:
    """Rows of a table with ``used``, the sum of costs so far in their group, while it is within the budget.

    Costs are positive, so the first row that does not fit ends its group. Null costs count as 0.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, by: AnalyzeArgument, order: AnalyzeArgument, cost: AnalyzeArgument, budget: AnalyzeArgument) -> AnalyzeResult:
        names = [c.strip() for c in by.value.split(",")]
        missing = [c for c in [*names, order.value, cost.value] if c not in rows.dataType.names]
        if missing:
            raise ValueError(f"the table has no column {missing[0]}")
        schema = StructType(list(rows.dataType.fields)).add("used", LongType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(c) for c in names], orderBy=[OrderingColumn(order.value)])

    def __init__(self) -> None:
        self.used = 0

    def eval(self, row: Row, by: str, order: str, cost: str, budget: int) -> Iterator[tuple]:
        self.used += row[cost] or 0
        if self.used <= budget:
            yield (*row, self.used)


def register(spark: SparkSession, words: Mapping[str, int] | Iterable[str] = ()) -> None:
    """Makes tokenize() and within_budget() known to the session's SQL."""
    spark.udtf.register("tokenize", tokenizer(words))
    spark.udtf.register("within_budget", udtf(WithinBudget))


