import json
import threading
from datetime import date, datetime
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from vigilark.sources import files, filters, http, snapshots
from vigilark.streaming import merge as S


@pytest.mark.parametrize("ext", ["csv", "tsv", "parquet", "orc", "jsonl", "dta", "geojson"])
def test_round_trip(spark, tmp_path, ext):
    df = spark.createDataFrame([(i, s, float(i), 1.5 * i) for i, s in enumerate(['a', 'b,"c"', "é\t", "d", "e"], 1)], "a int, b string, lon double, lat double")
    path = str(tmp_path / f"t.{ext}")
    files.save(df, path)
    got = files.read(spark, path).select(F.col("a").cast("int"), "b", "lon", "lat")
    assert sorted(got.collect()) == sorted(df.collect())


def test_read_text_kinds(spark, tmp_path):
    (tmp_path / "a.txt").write_text('"ID" "Name" "Age"\n1 "Alice B" 25\n2 "Bob" 30\n')
    (tmp_path / "b.txt").write_text("ID;Name;Age\n1;Alice B;25\n")
    (tmp_path / "c.csvy").write_text("#---\n#fields:\n#- name: ID\n#  type: integer\n#- name: Name\n#  type: string\n#---\nID,Name\n1,Alice\n2,007\n")
    assert [tuple(r) for r in files.read(spark, str(tmp_path / "a.txt")).collect()] == [(1, "Alice B", 25), (2, "Bob", 30)]
    assert files.read(spark, str(tmp_path / "b.txt")).columns == ["ID", "Name", "Age"]
    assert [tuple(r) for r in files.read(spark, str(tmp_path / "c.csvy")).collect()] == [(1, "Alice"), (2, "007")]
    (tmp_path / "e.csv").write_text("a,b\n")
    assert files.read(spark, str(tmp_path / "e.csv")).count() == 0
    for f in (lambda: files.read(spark, "x.zzz"), lambda: files.save(spark.range(1), "x.zzz")):
        with pytest.raises(ValueError, match="File format 'zzz' not supported"):
            f()


def test_read_all(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "one" / "t.parquet"))
    spark.range(3).withColumn("x", F.lit(1)).write.parquet(str(tmp_path / "two" / "t.parquet"))
    (tmp_path / "three").mkdir()
    got = files.read_all(spark, str(tmp_path), "t")
    assert {(r.source, r["count"]) for r in got.groupBy("source").count().collect()} == {("one", 2), ("two", 3)}


def test_snapshots(spark, tmp_path):
    for k, d in enumerate([date(2024, 12, 16), date(2024, 12, 23), date(2024, 12, 30), date(2025, 1, 6), date(2025, 1, 6)]):
        snapshots.save_snapshot(spark.range(k), str(tmp_path), "virus", d, keep=3)
    assert snapshots.snapshot_weeks(spark, str(tmp_path), "virus") == [(2024, 52), (2025, 1), (2025, 2)]
    got = snapshots.read_snapshots(spark, str(tmp_path), "virus", 2)
    assert {(r.snapshot, r["count"]) for r in got.groupBy("snapshot").count().collect()} == {("2025 W01", 2), ("2025 W02", 4)}
    assert set(snapshots.init_folders(str(tmp_path / "p")).values()) == {"Created"} and set(snapshots.init_folders(str(tmp_path / "p")).values()) == {"Exists"}


BASE = "https://api.example.com/"


def test_urls():
    want = BASE + "data?$filter=dateField%20ge%20DateTime'2020-01-01'%20and%20dateField%20le%20DateTime'2020-12-31'%20and%20regionField%20eq%20'AFRO'"
    assert filters.odata_url(BASE, "data", "2020-01-01", "2020-12-31", "dateField", None, "regionField", "AFRO") == want
    assert filters.odata_url(BASE, "data", "2020-01-01", "2020-12-31", "dateField", None, "regionField", "AFRO", ["field1", "field2"]) == want + "&$select=field1,field2"
    assert "AFRO" not in filters.odata_url(BASE, "Im", "2020-01-01", "2020-12-31", "d", None, "r", "AFRO")
    assert filters.endpoint("cases") == ("Case", "CaseDate", "LastUpdateDate") and filters.endpoint("virus") == ("Virus", "VirusDate", "UpdatedDate")
    with pytest.raises(ValueError, match="Invalid data_type specified"):
        filters.endpoint("x")
    assert filters.base_url("https://h.org/a/b?c") == "https://h.org"


def test_queries(spark):
    assert json.loads(filters.comparison_query("~ a >= 1 & a <= 2 & b == 3")) == {"a": {"$gte": "1", "$lte": "2"}, "b": {"$eq": "3"}}
    assert json.loads(filters.logical_query({"a": 1, "b": [1, 2]})) == {"$and": [{"a": 1}, {"$or": [{"b": 1}, {"b": 2}]}]}
    assert json.loads(filters.logical_query({"a": [1, 2], "b": [3, 4]}, flat_or=True)) == {"$or": [{"a": 1}, {"a": 2}, {"b": 3}, {"b": 4}]}
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "a int, b string")
    assert filters.comparison_filter(df, "a >= 2", "b == 'y'").count() == 1 and filters.logical_filter(df, {"a": [1, 3]}).count() == 2
    state = spark.createDataFrame([(1, "2024-01-05"), (1, "2024-02-07"), (2, None)], "form_id_num int, date_last_updated string")
    assert filters.form_urls(state, "https://h.org/x", [1, 2, 3]) == ["https://h.org/api/v1/data/1?last_edited__gte=2024-02-07", "https://h.org/api/v1/data/2", "https://h.org/api/v1/data/3"]


class Stub(BaseHTTPRequestHandler):
    fails, hits, forms, virus = {}, [], {}, []

    def do_GET(self):
        u = urlparse(self.path)
        q = parse_qs(u.query)
        self.hits.append(self.path)
        if self.fails.get(u.path, 0) > 0:
            self.fails[u.path] -= 1
            self.send_response(503)
            self.end_headers()
            return
        if u.path.startswith("/api/v1/data/"):
            form, page, size = int(u.path.rsplit("/", 1)[1]), int(q["page"][0]), int(q["page_size"][0])
            rows = [{"_id": i, "form": form, "v": None if i % 2 else "x", "never": None} for i in range(form)]
            if form in self.forms:
                rows = [{"_id": k, "v": v} for k, v, day in self.forms[form] if day >= q.get("last_edited__gte", [""])[0]]
            body = rows[(page - 1) * size : page * size]
        elif u.path == "/api/v1/data":
            body = [{"id": 1, "title": "a"}, {"id": 2, "title": None}]
        elif u.path == "/t.csv":
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"a,b\n1,x\n2,y\n")
            return
        elif u.path == "/Env/EnvSample":
            f = q["$filter"][0]
            lo, hi, field = f.split("DateTime'")[1][:10], f.split("DateTime'")[2][:10], f.split()[0]
            body = {"value": [r for r in self.virus if lo <= r[field] <= hi]}
        elif u.path == "/Virus":
            first = "skip" not in q
            body = {"value": [{"k": 1 if first else 2, "f": q.get("$filter", [""])[0][:20]}]} | ({"odata.nextLink": f"http://127.0.0.1:{self.server.server_port}/Virus?skip=1"} if first else {})
        else:
            self.send_response(404)
            self.end_headers()
            return
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def server():
    s = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_http(spark, server):
    Stub.fails["/api/v1/data/5"] = 1
    df = http.read_forms(spark, server, [5, 2], page_size=2, pause=0.01)
    assert df.columns == ["form_id_num", "_id", "form", "v"] and df.count() == 7
    assert http.read_urls(spark, [f"{server}/api/v1/data/3"], on=date(2024, 1, 1), page_size=10).where("date_last_updated = '2024-01-01' and form_id_num = '3'").count() == 3
    v = http.read_odata(spark, server + "/", "virus", date(2024, 1, 1), date(2024, 3, 1), days_per_partition=31)
    assert v.count() == 4 and v.where("k = '2'").count() == 2
    assert http.catalogue(spark, server).count() == 2
    status = {r.table: r.status for r in http.tables_available(spark, server + "/", ["Virus", "Nope"]).collect()}
    assert status == {"Virus": "200", "Nope": "404"}
    with pytest.raises(RuntimeError, match="status 404"):
        http.fetch(server + "/nope", tries=3)
    xml = b'<e xmlns="x"><EntitySet Name="A" EntityType="T1"/><EntitySet Name="B" EntityType="T1"/><EntitySet Name="C" EntityType="T2"/></e>'
    assert http.entity_sets(xml) == [("A", "T1"), ("C", "T2")]


def test_files_behind_urls(spark, server):
    """What is fetched lies in the folder all executors share."""
    df = files.read(spark, f"{server}/t.csv?x=1")
    assert sorted(map(tuple, df.collect())) == [(1, "x"), (2, "y")] and spark.conf.get("spark.checkpoint.dir") in df.inputFiles()[0]


def test_pages_are_requested_once(spark, server):
    Stub.hits.clear()
    df = http.read_forms(spark, server, [5, 3], page_size=2)
    assert df.count() == 8 and df.where("v is null").count() == 3 and "never" not in df.columns
    assert len(Stub.hits) == len(set(Stub.hits)) == 5  # three pages of one form, two of the other
    with pytest.warns(DeprecationWarning):
        assert http.read_multi_forms(spark, server, [3]).count() == 3


def test_forms_are_kept_up_to_date(spark, server, tmp_path):
    path, day = str(tmp_path / "forms"), date(2024, 5, 1)
    Stub.forms.update({11: [(1, "a", "2024-01-01"), (2, "b", "2024-01-01")], 12: [(1, "z", "2024-01-01")]})
    Stub.hits.clear()
    rows, log = http.update_forms(spark, path, server, [11], on=day)
    assert {(r.form_id_num, r._id, r.v) for r in rows.collect()} == {("11", "1", "a"), ("11", "2", "b")}
    assert [(r.total_rows, r.new_rows, r.note) for r in log.collect()] == [(2, 2, " Initial Download")]
    Stub.forms[11] += [(2, "B", "2024-05-02"), (3, "c", "2024-05-02")]
    rows, log = http.update_forms(spark, path, server, [11, 12], on=date(2024, 5, 3))
    assert {(r.form_id_num, r._id, r.v) for r in rows.collect()} == {("11", "1", "a"), ("11", "2", "B"), ("11", "3", "c"), ("12", "1", "z")}
    assert sorted((r.form_id_num, r.total_rows, r.new_rows) for r in log.where("update_time = '2024-05-03'").collect()) == [("11", 3, 1), ("12", 1, 1)]
    assert len(Stub.hits) == len(set(Stub.hits)) == 3 and any("last_edited__gte=2024-05-01" in h for h in Stub.hits)
    assert http.update_forms(spark, path, server, [11], on=date(2024, 6, 1))[0].count() == 4


def test_odata_is_kept_up_to_date(spark, server, tmp_path):
    row = lambda i, made, upd, v: {"Id": str(i), "CollectionDate": made, "LastUpdateDate": upd, "v": v}
    Stub.virus[:] = [row(1, "2024-01-05", "2024-01-06", "a"), row(2, "2024-02-05", "2024-02-06", "b"), row(3, "2024-06-01", "2024-06-01", "later")]
    args = (spark, str(tmp_path / "env"), f"{server}/Env/", "env", date(2024, 1, 1))
    rows, log = http.update_odata(*args, date(2024, 3, 1), keys=["Id"])
    assert {(r.Id, r.v) for r in rows.collect()} == {("1", "a"), ("2", "b")} and [r.new_rows for r in log.collect()] == [2]
    Stub.virus[0] = row(1, "2024-01-05", "2024-06-02", "A")
    Stub.hits.clear()
    rows, log = http.update_odata(*args, date(2024, 7, 1), keys=["Id"])
    assert {(r.Id, r.v) for r in rows.collect()} == {("1", "A"), ("2", "b"), ("3", "later")}
    assert all("LastUpdateDate" in h and "2024-02-06" in h or "2024-05" in h for h in Stub.hits) and len(Stub.hits) == len(set(Stub.hits))
    assert sorted((r.query_start, r.new_rows) for r in log.collect()) == [("2024-01-01", 2), ("2024-02-06", 1)]


def test_shapefiles(spark, tmp_path):
    """Polygons with holes and parts, null shapes and values, several files of a folder; regions are found in what was read."""
    ring = lambda x, y, r: [[x, y], [x + r, y], [x + r, y + r], [x, y + r], [x, y]]
    shapes = [{"type": "Polygon", "coordinates": [ring(0, 0, 10), ring(2, 2, 1)]}, {"type": "MultiPolygon", "coordinates": [[ring(20, 0, 5)], [ring(30, 0, 5), ring(31, 1, 1)]]}, None]
    rows = [(i, ["é-Land", None, "c"][i], 1.5 * i if i else None, i == 1, date(2024, 1, 1 + i), json.dumps(g) if g else None) for i, g in enumerate(shapes)]
    df = spark.createDataFrame(rows, "n int, name string, v double, flag boolean, day date, geometry string")
    files.save(df, str(tmp_path / "a.shp"))
    files.save(df.where("n < 2"), str(tmp_path / "b.shp"))
    got = {r.n: r for r in files.read(spark, str(tmp_path / "a.shp")).collect()}
    assert [(got[i].name, got[i].v, got[i].flag, got[i].day) for i in range(3)] == [r[1:5] for r in rows]
    assert got[2].geometry is None and json.loads(got[0].geometry)["type"] == "Polygon" and len(json.loads(got[0].geometry)["coordinates"]) == 2
    assert [len(p) for p in json.loads(got[1].geometry)["coordinates"]] == [1, 2]
    from vigilark.sources.shapefile import read_shp

    assert read_shp(spark, str(tmp_path)).count() == 5
    files.save(spark.createDataFrame([(1, 2.5, -3.5), (2, None, 1.0)], "id int, lon double, lat double"), str(tmp_path / "p" / "p.shp"))
    assert sorted((r.id, r.lon, r.lat) for r in files.read(spark, str(tmp_path / "p" / "p.shp")).collect()) == [(1.0, 2.5, -3.5), (2.0, None, None)]
    with pytest.raises(ValueError, match="one kind"):
        files.save(spark.createDataFrame([(json.dumps(shapes[0]),), ('{"type":"Point","coordinates":[1,2]}',)], "geometry string"), str(tmp_path / "c.shp"))


def test_single_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "SINGLE_ROWS", 3)
    with pytest.raises(ValueError, match="too many rows"):
        files.save(spark.range(4), str(tmp_path / "a.csv"), single=True)
    files.save(spark.range(4), str(tmp_path / "b.csv"))
    assert files.read(spark, str(tmp_path / "b.csv")).count() == 4


def test_bucketed_stream(spark, tmp_path):
    """Only the buckets of a batch are rewritten; a repeated batch gives the same."""
    src, s = str(tmp_path / "in"), "k int, v string, t timestamp"
    t = S.BucketedTable(spark, str(tmp_path / "out"), ["k"], 8)
    assert t.read() is None
    run = lambda: S.merge_stream(spark.readStream.schema(s).parquet(src), t, ["k"], "t", str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(i, "a", datetime(2024, 1, 1)) for i in range(50)], s).write.parquet(src)
    run()
    second = spark.createDataFrame([(1, "c", datetime(2024, 1, 2)), (2, "old", datetime(2023, 1, 1)), (99, "n", None)], s)
    second.write.mode("append").parquet(src)
    run()
    want = {(i, "c" if i == 1 else "a") for i in range(50)} | {(99, "n")}
    assert {(r.k, r.v) for r in t.read().collect()} == want
    assert sum(len(t._table(b).versions()) for b in range(8)) <= 8 + 3
    t.merge(second, "t", 1)
    assert {(r.k, r.v) for r in t.read().collect()} == want and t.read().count() == 51


def test_streams(spark, tmp_path):
    src, s = str(tmp_path / "in"), "k int, v string, t timestamp"
    t = S.VersionedTable(spark, str(tmp_path / "out"))
    run = lambda: S.merge_stream(spark.readStream.schema(s).parquet(src), t, ["k"], "t", str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(1, "a", datetime(2024, 1, 1)), (2, "b", datetime(2024, 1, 1))], s).write.parquet(src)
    run()
    spark.createDataFrame([(1, "c", datetime(2024, 1, 2)), (2, "old", datetime(2023, 1, 1))], s).write.mode("append").parquet(src)
    run()
    run()
    assert {(r.k, r.v) for r in t.read().collect()} == {(1, "c"), (2, "b")}
    t.write(t.read(before=t.versions()[-1]), t.versions()[-1])  # a repeated batch replaces its own version
    assert len(t.versions()) == 2
    stream = spark.readStream.schema(s).parquet(src)
    q = S.windowed_counts(S.dedup_pages(stream, ["k", "v"], "t"), "t", "1 day", delay=None).writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").count() >= 1
    g = S.gap_sessions(spark.createDataFrame([(1, "a", datetime(2024, 1, 1, h)) for h in (0, 1, 5)], s), "t", "2 hours", ["k"])
    assert sorted(r.n for r in g.collect()) == [1, 2]
