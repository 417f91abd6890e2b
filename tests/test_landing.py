from foliant.plans.filings import filings
from foliant.sources import submissions
from foliant.streaming.landing import segment_arrivals


def test_files_in_a_folder(spark, tmp_path):
    made = filings(spark, "/root/testdata/sf0.001").where("doc_id in (1, 6)").collect()
    (tmp_path / "in").mkdir()
    for r in made:
        (tmp_path / "in" / f"{r.doc_id}.txt").write_text(r.raw_text)
    (tmp_path / "in" / "9.htm").write_bytes(b"<html><body>FORM 10-Q caf\xe9</body></html>")
    segment_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = {r.doc_id.rsplit("/", 1)[1]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {k: r.doc_status.split("_")[0] for k, r in rows.items()} == {"1.txt": "success", "6.txt": "success", "9.htm": "failed"}
    assert [i.item for i in rows["1.txt"]["items"]][:3] == ["1", "2", "3"] and rows["9.htm"]["items"] == []
    assert rows["9.htm"].normalized_text == "FORM 10-Q café"
    listing = submissions.read_files(spark, str(tmp_path / "in")).select("doc_id", "length")
    assert listing.count() == 3
    best = submissions.largest_per_directory(listing.withColumnRenamed("doc_id", "path")).collect()
    assert len(best) == 1 and best[0].dir == "in"
