"""The contents that header_probe builds hold their pages whole."""

from pyspark.sql import functions as F

from segmetrica.plans import load_all
from segmetrica.sources import probe


def test_frames_stand_behind_the_whole_page(spark, tmp_path, monkeypatch):
    rows = [(k, "<p>page</p>" * (k * 400)) for k in range(9)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    query = load_all()[0]["header_probe"]
    found = {r.path: r for r in query(spark, str(tmp_path)).collect()}
    monkeypatch.setattr(probe, "probe", lambda df: df)
    sizes = {r.path: r.n for r in query(spark, str(tmp_path)).select("path", F.octet_length("content").alias("n")).collect()}
    for k, html in rows:
        if k % 3 == 1:
            assert sizes[str(k)] == len(html) + 834
            assert (found[str(k)].codec, found[str(k)].sample_rate, found[str(k)].channels) == ("mp3", 44100, 2)
