"""Paged scans against a plain reading and a local service; files, digests, builds."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest

from tideline.sources import files, paged


def fills(n=57):
    tokens = [f"t{k}" for k in range(5)]
    return [{**{c.split()[0]: "0" for c in paged.FILL_SCHEMA.split(", ")}, "fill_id": f"f{i:04d}", "makerAssetId": tokens[i % 5], "takerAssetId": "0" if i % 3 else tokens[(i * 2) % 5]} for i in range(n)]


@pytest.fixture
def base(tmp_path):
    rows = fills()
    (tmp_path / "fills.jsonl").write_text("\n".join(json.dumps(r) for r in rows[::-1]))
    (tmp_path / "meta.jsonl").write_text('{"block": "123"}')
    (tmp_path / "activity.jsonl").write_text("\n".join(json.dumps({"id": f"a{i % 30:02d}", "side": "BUY"}) for i in range(45)))
    return str(tmp_path)


def test_keyset_scan_of_both_sides(spark, base):
    want = {r["fill_id"] for r in fills() if {r["makerAssetId"], r["takerAssetId"]} & {"t1", "t3"}}
    got = [r.fill_id for r in paged.scan_fills(spark, base, ["t1", "t3"], page=4).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert 0 < paged.scan_fills(spark, base, ["t1", "t3"], page=4, max_pages=2).count() <= 16
    assert paged.scan_fills(spark, base, ["nothing"], page=4).count() == 0


def test_offset_scan_drops_repeats_and_stops(spark, base):
    rows = paged.scan_activity(spark, base, "id string, side string", ["id", "side"], page=10, last_offset=100).collect()
    assert [r.id for r in rows] == [f"a{i:02d}" for i in range(30)]
    assert paged.scan_activity(spark, base, "id string, side string", ["id"], page=10, last_offset=0).count() == 10
    assert paged.block_height(base) == 123


def test_service_with_retries():
    seen = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            request = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(request)
            body = {"errors": "busy"} if len(seen) == 1 else {"rows": [{"fill_id": "a"}, {"fill_id": "b"}][: request["first"]] if not request["after"] else []}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        got = list(paged.keyset_pages(f"http://127.0.0.1:{server.server_port}", "fills", "makerAssetId", ["x"], page=2))
    finally:
        server.shutdown()
    assert [r["fill_id"] for r in got] == ["a", "b"] and [r["after"] for r in seen] == ["", "", "b"]


def test_backoff_doubles_and_the_last_failure_is_raised():
    waits, calls = [], []

    def call():
        calls.append(1)
        raise OSError("down")

    with pytest.raises(OSError):
        paged.with_retry(call, 5, waits.append)
    assert len(calls) == 5 and waits == [1, 2, 4, 8]


def test_snapshot_wants_one_event(tmp_path):
    (tmp_path / "events.jsonl").write_text('{"slug": "one", "x": 1}\n{"slug": "two"}\n{"slug": "two"}')
    assert paged.snapshot(str(tmp_path), "one", str(tmp_path / "out.json"))["x"] == 1
    for slug in ("two", "none"):
        with pytest.raises(ValueError):
            paged.snapshot(str(tmp_path), slug, str(tmp_path / "out.json"))


def test_markets_with_arrays_in_strings(spark, tmp_path):
    market = lambda **x: {"conditionId": "c1", "question": " Will it? ", "outcomes": '["Yes", "No"]', "clobTokenIds": '["11", "22"]', "outcomePrices": '["0", "1"]', "closedTime": "2025-11-30T12:00:00Z"} | x
    event = {"slug": "s", "markets": [market(), market(conditionId="c2", outcomes='["No", "Yes"]', outcomePrices='["0.4", "0.6"]', closedTime=" "), market(conditionId="c3", outcomes=None, clobTokenIds="", outcomePrices=None, closedTime="2025-01-01 00:00:00")]}
    (tmp_path / "e.json").write_text(json.dumps(event))
    rows = {r.condition_id: tuple(r)[2:] for r in files.markets_of(spark, str(tmp_path)).collect()}
    assert rows == {"c1": ("Will it?", "11", "22", "No", 1764504000), "c2": ("Will it?", "22", "11", None, None), "c3": ("Will it?", None, None, None, 1735689600)}
    counts = {r.token_id: r.markets for r in files.token_universe(files.markets_of(spark, str(tmp_path))).collect()}
    assert counts == {"11": 2, "22": 2}


def test_scenarios_vectors_reports_and_builds(spark, tmp_path):
    for name, whole in (("a", True), ("b", True), ("c", False)):
        spark.range(3).write.parquet(f"file://{tmp_path}/sim/{name}x")
        (tmp_path / "sim" / name).mkdir()
        (next((tmp_path / "sim" / f"{name}x").glob("*.parquet"))).rename(tmp_path / "sim" / name / "trades.parquet")
        if whole:
            (tmp_path / "sim" / name / "manifest.json").write_text(json.dumps({"level": 2}))
    trades, manifests = files.scenarios(spark, f"file://{tmp_path}/sim")
    assert {r.scenario_id for r in trades.collect()} == {"a", "b"} == {r.scenario_id for r in manifests.collect()}
    digest = files.save_vector(spark.range(5), str(tmp_path / "v.npy"))
    assert np.load(tmp_path / "v.npy").tolist() == [0, 1, 2, 3, 4] and files.load_vector(spark, str(tmp_path / "v.npy")).count() == 5
    files.verify_inputs(spark, f"file://{tmp_path}", {"v.npy": digest})
    for wrong in ({"v.npy": "0"}, {"gone.npy": digest}):
        with pytest.raises(ValueError):
            files.verify_inputs(spark, f"file://{tmp_path}", wrong)
    one = files.save_report({"b": [1, {"elapsed_seconds": 3, "x": 2}], "a": None}, str(tmp_path / "r.json"))
    two = files.save_report({"a": None, "b": [1, {"x": 2, "elapsed_seconds": 9}]}, str(tmp_path / "r.json"))
    assert one == two and (tmp_path / "r.json").read_text() == '{"a":null,"b":[1,{"x":2}]}\n'
    build = files.build_id({"k": 20})
    tables = {n: files.stamped(spark.range(2), build) for n in "xy"}
    assert files.one_build(tables) == build and len(build) == 16
    with pytest.raises(ValueError):
        files.one_build(tables | {"z": files.stamped(spark.range(1), "other")})
    told = files.save_manifest(spark, f"file://{tmp_path}/sim/a", tables, str(tmp_path / "m.json"))
    assert told["tables"] == {"x": 2, "y": 2} and list(told["files"]) == ["trades.parquet"]
    files.save_csv(spark.range(2), f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").columns == ["id"]


def test_tracks_and_frozen_plans(spark, tmp_path):
    tracks = files.Tracks()
    tracks.register("real", lambda s: {"t": s.range(1)})
    assert tracks.load(spark, "real")["t"].count() == 1
    with pytest.raises(ValueError):
        tracks.register("real", lambda s: {})
    with pytest.raises(ValueError):
        tracks.load(spark, "none")
    code = tmp_path / "engine.py"
    code.write_text("x = 1")
    plan = files.frozen_plan({"a": 1}, [str(code)])
    files.require_frozen(plan, {"a": 1}, [str(code)])
    with pytest.raises(ValueError):
        files.require_frozen(plan, {"a": 2}, [str(code)])
    code.write_text("x = 2")
    with pytest.raises(ValueError):
        files.require_frozen(plan, {"a": 1}, [str(code)])
