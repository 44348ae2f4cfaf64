from pyspark.sql import functions as F

from marketloom import catalogue
from tests.oracle import differences

SF = "/root/testdata/sf0.01"


def test_whole_text_is_folded(spark):
    name = "text_fold_whole"
    assert differences(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], SF) == ""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = docs.agg(F.max(F.length("text"))).first()[0]
    assert long > 200 and catalogue.QUERIES[name](spark, SF).agg(F.max(F.length("folded"))).first()[0] == long
