import json

import pytest

from bidlake.sources import feed as D
from bidlake.sources import tables as S

FEED = "tests.feeds:folder"


def item(k, **more):
    return {"id": f"f{k}", "modified": f"2024-01-{1 + k % 28:02d}T00:00:00", **more}


def put(path, pages):
    for n, items in enumerate(pages):
        (path / f"page-{n}.json").write_text(json.dumps(items))


def ids(df):
    return sorted(r["file_id"] for r in df.collect())


def test_batch_read_leaves_folders_out_and_marks_removals(spark, tmp_path):
    put(tmp_path, [[item(0), item(1, is_folder=True)], [item(2, trashed=True), {"id": "f3"}], []])
    rows = {r["file_id"]: (r["change"], r["modified"] is None) for r in D.read_feed(spark, FEED, str(tmp_path)).collect()}
    assert rows == {"f0": ("upserted", False), "f2": ("removed", False), "f3": ("upserted", True)}
    assert ids(D.changed(D.read_feed(spark, FEED, str(tmp_path)), "2024-01-02")) == ["f2", "f3"]


@pytest.mark.parametrize("most", [1, 2, 3, 100])
def test_a_restart_in_mid_page_loses_and_doubles_nothing(spark, tmp_path, most):
    (tmp_path / "feed").mkdir()
    put(tmp_path / "feed", [[item(k) for k in range(5)], [item(k) for k in range(5, 7)]])

    def run():
        query = D.append_feed(D.stream_feed(spark, FEED, str(tmp_path / "feed"), most), str(tmp_path / "out"), str(tmp_path / "c"), "0 seconds")
        query.processAllAvailable()
        query.stop()

    run()
    # What is added to the last page, new pages, and items that the feed sends again.
    put(tmp_path / "feed", [[item(k) for k in range(5)], [item(k) for k in range(5, 9)], [item(2), item(9), item(9)], [item(10, trashed=True)]])
    run()
    run()
    assert ids(spark.read.parquet(str(tmp_path / "out"))) == sorted(f"f{k}" for k in range(11))


def test_offsets_stop_inside_pages(tmp_path):
    put(tmp_path, [[item(k) for k in range(4)], [item(4)]])
    reader = D.FeedStreamReader({"feed": FEED, "where": str(tmp_path), "most": "3"})
    rows, end = reader.read(reader.initialOffset())
    assert len(list(rows)) == 3 and end == {"cursor": "", "done": 3}
    rows, later = reader.read(end)
    assert [r[0] for r in rows] == ["f3", "f4"]
    assert [r[0] for r in reader.readBetweenOffsets(end, later)] == ["f3", "f4"] and [r[0] for r in reader.readBetweenOffsets(reader.initialOffset(), end)] == ["f0", "f1", "f2"]
    assert reader.read(later)[1] == later


def test_capped_export_reaches_a_database_whole(spark):
    url, own = "jdbc:derby:memory:bids;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    df = spark.range(5000).selectExpr("id", "cast(id % 7 as int) AS grade", "concat('n', id) AS name")
    for n, order in ((100, ["grade", "id"]), (300, ["id"])):
        assert S.write_jdbc(S.capped_export(df, order, n), url, "SERVING", own, batch=50, writers=4) == n
        got = spark.read.jdbc(url, "SERVING", properties=own)
        want = df.orderBy(*order).limit(n)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert S.write_jdbc(df.limit(0), url, "SERVING", own) == 0 and spark.read.jdbc(url, "SERVING", properties=own).count() == 0
