"""Schemas of the corpus tables; sources read everything as strings."""

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


WORD_FILE = _strings("line", "word", "label", "reference", "reference normalized")
WORDS = T.StructType([T.StructField("source_path", T.StringType()), T.StructField("source_file", T.StringType()), T.StructField("word_index", T.IntegerType()), *WORD_FILE.fields])
VERSES = _strings("reference", "book", "chapter", "verse", "part", "text")
DOCX_TOKENS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("p_id", T.IntegerType()),
        T.StructField("n", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("style", T.ArrayType(T.StringType())),
        T.StructField("fn_id", T.StringType()),
        T.StructField("citation", T.StringType()),
        T.StructField("is_insertion", T.BooleanType()),
    ]
)
TEI_WORDS = T.StructType([T.StructField("path", T.StringType()), T.StructField("pos", T.IntegerType()), *_strings("word", "reference", "label", "initial_reference", "line").fields])
