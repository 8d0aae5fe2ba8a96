from pyspark.sql import functions as F

from florilex.functions import refs

GOLDEN = [
    ("Io 3,16", "Jn 3:16"), ("1 Cor 13,1-3", "1 Co 13:1-3"), ("1 Co 3,4", "1 Co 3:4"), ("Co 1,2", "Col 1:2"), ("3 Rg 2,1", "1 K 2:1"), ("13 Rg 2,1", "1 K 2:1"),
    ("Ps 15,11", "Ps 15:11"), ("Ps. 1,2", ""), ("Ps 2,3s", "Ps 2:3-5"), ("Ps 2,3sq", "Ps 2:3-5"), ("Ps 2,3-4ss", "Ps 2:3-6"), ("Ps 1,1-2;Ps 2,3s", "Ps 1:1-5"),
    ("Ps 1,1; Mt 2,2", "Ps 1:1 ;  Mt 2:2"), ("Ps 1,1 et Lc 2,3", "Ps 1:1 ;  Lk 2:3"), ("Ps 1,1;2,2", "Ps 1:1"), ("Mt 5,3.5-7", "Mt 5:3.5-7"), ("1 Petr 1,1", "r 1:1"),
    ("Ps Hb 1,1", " Heb 1:1"), ("cf. Ps 4,5", " Ps 4:5"), ("Éz 1,2", "Ez 1:2"), ("Ps 118", ""), ("Ps 1,1 – 3", "Ps 1:1"),
]


def test_golden_columns_and_strings(spark):
    df = spark.createDataFrame(GOLDEN, "initial string, want string")
    got = {x.initial: x.got for x in df.select("initial", refs.normalize_ref(F.col("initial")).alias("got")).collect()}
    assert got == dict(GOLDEN)
    one = refs.Normalizer()
    assert {a: one(a) for a, _ in GOLDEN} == dict(GOLDEN)


def test_rewrite_of_markup(spark):
    xml = '<p>lemma <seg type="biblicalRef">Io 3,16</seg> <seg  ana="Occurrence"  type="biblicalRef" >Ps\t2,3s</seg><hi rend="bold">x\ny</hi><seg type="biblicalRef" ana="citationExacte"><!--a-->Mt 1,1</seg></p>'
    row = spark.createDataFrame([(xml,)], "x string").select(refs.rewrite_references(F.col("x")).alias("r")).first().r
    assert row.n_matches == 3
    assert row.xml == '<p>Quotation <seg type="biblicalRef" ana="Quotation"><!--Io 3,16-->Jn 3:16</seg> <seg ana="Occurrence" type="biblicalRef"><!--Ps2,3s-->Ps 2:3-5</seg><seg type="biblicalRef" ana="Quotation"><!----><!--a-->Mt 1,1</seg></p>'
