"""The safety screen against its SQL on texts that break rules of their own, beside the sentence put behind them."""

import duckdb

from lectern.plans import catalog


def test_texts_with_hits_of_their_own(spark, tmp_path):
    texts = ["see section 5.18 of it", "A 5x18 board", "인생은\x0b도박", None, "살인 5.18 자살\n삶을 \x0b 끝", "정신 이상"] * 5
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = catalog.QUERIES["q7_safety_screen"](spark, str(tmp_path))
    wanted = con.sql(catalog.ORACLE["q7_safety_screen"]).df()
    key = sorted(found.columns)
    got = sorted(map(tuple, found.toPandas()[key].values.tolist()))
    assert got == sorted(map(tuple, wanted[key].values.tolist())) and any("5.18" in r for r in got)
