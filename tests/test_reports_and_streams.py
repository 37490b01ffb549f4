from caselens.operators import report
from caselens.streaming import arrivals


def test_reports_escape(spark):
    risk = spark.createDataFrame([("<b>E</b>", 1.0, "MEDIUM")], "cse_id string, risk double, tier string")
    page = report.supervisory("R", risk, risk, risk)
    assert "<b>E</b>" not in page and page.count("&lt;b&gt;E&lt;/b&gt;") == 4
    rows = spark.createDataFrame([("E", "preliminary", True), ("F", "confirmed", True), ("G", "preliminary", False)], "cse_id string, level string, sufficient boolean")
    page = report.interventions("I", rows)
    assert page.index("Preliminary") < page.index("Confirmed") < page.index("Insufficient")


def test_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("cse_id,case_id,event,ts,actor,handover_reason\nE,C,closed,2024-01-01T00:00:00Z,x,\nE,C,what,2024-01-01T00:00:00Z,x,\n")
    seen = []
    arrivals.each_batch(arrivals.arrivals(spark, str(tmp_path / "in")), str(tmp_path / "check"), lambda df, i: seen.extend(df.collect())).awaitTermination(60)
    assert [(r.cse_id, r.type) for r in seen] == [("E", "CLOSE")]
    assert arrivals.windowed_counts(arrivals.arrivals(spark, str(tmp_path / "in"))).columns == ["cse_id", "type", "start", "n"]
