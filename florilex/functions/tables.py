"""Table functions for SQL: words of a TEI column, and runs over the rows of a table.

    tables.register(spark)
    spark.sql("SELECT f.path, w.* FROM files f, LATERAL tei_words(f.xml) w")
    spark.sql("SELECT * FROM runs(TABLE(words) PARTITION BY path ORDER BY (word_index), 'reference')")
"""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from ..operators import tei


@udtf(returnType="pos int, word string, reference string, label string, initial_reference string, line string")
class TeiWords:
    """The words of one TEI document, cleaned by `tei.clean_markup`, with what holds where they stand; none of an ill-formed one."""

    def eval(self, xml: str):
        for pos, word in enumerate(tei.words(xml or "") or ()):
            yield (pos, *word)


@udtf
class Runs:
    """Maximal runs of equal values of a text column, over each partition in order: part (the table's first column), run (from 1), value, n, and the places (from 0) of its first and last row.

    It holds the run that is open, whatever the number of rows.
    """

    def __init__(self):
        self.value, self.n, self.run, self.at, self.key = None, 0, 0, 0, None

    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or column.dataType != T.StringType() or column.value not in table.dataType.fieldNames():
            raise ValueError("runs(TABLE(rows) PARTITION BY .. ORDER BY .., 'column') needs a table and the name of one of its columns")
        kept = [f for f in table.dataType.fields if f.name == column.value]
        first = table.dataType.fields[0]
        fields = [T.StructField("part", first.dataType), T.StructField("run", T.LongType()), T.StructField("value", kept[0].dataType), T.StructField("n", T.LongType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]
        return AnalyzeResult(T.StructType(fields))

    def _closed(self):
        return (self.key, self.run, self.value, self.n, self.at - self.n, self.at - 1)

    def eval(self, row: Row, column: str):
        value = row[column]
        if not self.n or value != self.value:
            if self.n:
                yield self._closed()
            self.key, self.value, self.n, self.run = row[0], value, 0, self.run + 1
        self.n += 1
        self.at += 1

    def terminate(self):
        if self.n:
            yield self._closed()


def register(spark: SparkSession) -> None:
    spark.udtf.register("tei_words", TeiWords)
    spark.udtf.register("runs", Runs)
