import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from sigloom.operators import kernels
from sigloom.streaming import blocks


@pytest.fixture(scope="module")
def parts(spark, sf, tmp_path_factory):
    """The events in six files in order of time, and one late in each track that closes all windows."""
    df = spark.read.parquet(f"{sf}/events.parquet").toPandas().sort_values(["ts", "event_id"])
    last = pd.DataFrame({"event_id": [10**9], "ts": [df.ts.max() + pd.Timedelta("90 days")], "user_id": [10**6], "event_type": ["end"], "value": [0.0], "props": ["{}"]})
    folder = tmp_path_factory.mktemp("events") / "events.parquet"
    folder.mkdir()
    for k, p in enumerate([*np.array_split(df, 5), last]):
        p["ts"] = p["ts"].astype("datetime64[us]")
        p.to_parquet(folder / f"part-{k}.parquet", index=False)
    return str(folder), df


def test_windows_equal_batch(spark, parts):
    path, df = parts
    got = blocks.run(blocks.tumbling(blocks.read_events(spark, path))).where("track <> 'end'").toPandas()
    want = df.groupby(["event_type", df.ts.dt.floor("6h")]).value.agg(["size", "mean"]).reset_index()
    assert sorted((r.track, pd.Timestamp(r.start), r.n) for r in got.itertuples()) == sorted((t, s, n) for t, s, n in zip(want.event_type, want.ts, want["size"]))
    slid = blocks.run(blocks.sliding(blocks.read_events(spark, path))).where("track <> 'end'").agg(F.sum("n")).head()[0]
    assert slid == 2 * len(df)


def test_sessions_equal_batch(spark, parts):
    path, df = parts
    got = blocks.run(blocks.sessions(blocks.read_events(spark, path))).where("track < 1000000")
    new = df.groupby("user_id").ts.diff().fillna(pd.Timedelta("1D")) >= pd.Timedelta("6h")
    assert got.count() == int(new.sum()) and got.agg(F.sum("n")).head()[0] == len(df)


def test_carried_state_equals_whole_tracks(spark, parts):
    path, df = parts
    got = {r.event_id: r.y for r in blocks.run(blocks.filtered(blocks.read_events(spark, path))).where("track < 1000000").collect()}
    for _, g in df.groupby("user_id"):
        y, _ = kernels.high_pass(g.value.to_numpy(float), 0.05)
        assert [got[e] for e in g.event_id] == pytest.approx(y.tolist())
    out = {}
    for r in blocks.run(blocks.overlap_added(blocks.read_events(spark, path))).where("track < 1000000").orderBy("track", "ix").collect():
        out.setdefault(r.track, []).append(r.y)
    for t, y in out.items():
        x = df[df.user_id == t].value.to_numpy(float)
        assert y[4:] == pytest.approx(x[4 : len(y)].tolist())


def test_all_comes_out_of_files_in_any_order(spark, parts, tmp_path):
    """Many small files, not in order of time: no row is late, and what is open at the end is closed."""
    path, df = parts
    mixed = tmp_path / "events.parquet"
    spark.createDataFrame(df.sample(frac=1, random_state=1)).repartition(9).write.parquet(str(mixed))
    got = blocks.drained(spark, str(mixed), blocks.tumbling, file_rows=60).agg(F.sum("n")).head()[0]
    assert got == len(df)
    y = {(r.track, r.ix): r.y for r in blocks.drained(spark, str(mixed), blocks.overlap_added, file_rows=130).collect()}
    assert len(y) == len(df)
    for t, g in df.groupby("user_id"):
        assert [y[t, i] for i in range(4, len(g))] == pytest.approx(g.value.tolist()[4:])


def test_a_query_goes_on_where_it_stopped(spark, parts, tmp_path):
    import shutil

    path, df = parts
    inbox, folder = tmp_path / "in.parquet", str(tmp_path / "query")
    inbox.mkdir()
    for k in range(6):
        shutil.copy(f"{path}/part-{k}.parquet", inbox)
        out = blocks.run(blocks.filtered(blocks.read_events(spark, str(inbox))), folder)
        assert out.count() == min(k + 1, 5) * len(df) // 5 + (k == 5)
    got = {r.event_id: r.y for r in out.where("track < 1000000").collect()}
    for _, g in df.groupby("user_id"):
        assert [got[e] for e in g.event_id] == pytest.approx(kernels.high_pass(g.value.to_numpy(float), 0.05)[0].tolist())


def test_a_track_that_was_silent_goes_on(spark, tmp_path):
    """Closed after years of silence, heard again: positions go on, none twice."""
    inbox, folder = tmp_path / "in.parquet", str(tmp_path / "query")
    inbox.mkdir()
    batches = [(1, 0, 11), (2, 800, 3), (3, 1600, 3), (1, 2400, 9), (2, 3200, 3), (3, 4000, 1)]
    for k, (user, day, n) in enumerate(batches):
        ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(day, "D") + pd.to_timedelta(range(n), "s")
        df = pd.DataFrame({"event_id": np.arange(n) + 100 * k, "ts": ts.astype("datetime64[us]"), "user_id": user, "event_type": "a", "value": 1.0, "props": "{}"})
        df.to_parquet(inbox / f"part-{k}.parquet", index=False)
        out = blocks.run(blocks.overlap_added(blocks.read_events(spark, str(inbox))), folder)
    ix = sorted(r.ix for r in out.where("track = 1").collect())
    assert ix == list(range(20))


def test_late_rows_are_no_silent_loss(spark, tmp_path):
    inbox, folder = tmp_path / "in.parquet", str(tmp_path / "query")
    inbox.mkdir()
    for k, day in enumerate((100, 0)):
        df = pd.DataFrame({"event_id": [k], "ts": pd.to_datetime([pd.Timestamp("2024-01-01") + pd.to_timedelta(day, "D")]).astype("datetime64[us]"), "user_id": 1, "event_type": "a", "value": 1.0, "props": "{}"})
        df.to_parquet(inbox / f"part-{k}.parquet", index=False)
        stream = blocks.tumbling(blocks.read_events(spark, str(inbox)))
        if k:
            with pytest.raises(RuntimeError, match="later than the watermark"):
                blocks.run(stream, folder, whole=True)
        else:
            blocks.run(stream, folder, whole=True)
