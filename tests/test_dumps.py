"""A dump that is one object, cut at byte ranges, against the JSON library."""

import json
import random

import pytest
from gatewatch.sources import dumps, requests


def row(rng, k):
    odd = ["}", "{", "},", "]}", '"', "\\", '\\"', "é", "日本", "\n", "[{", '":"', "}\\}", "a"]
    text = lambda: "".join(rng.choice(odd) for _ in range(rng.randint(0, 9)))
    return {"id": k, "ip": "1.1.1.1", "method": "GET", "route": text(), "full_url": text(), "user_agent": rng.choice([None, text()]), "request_body": json.dumps({text(): [text(), {}]}), "extra": [{}, {"deep": [{text(): text()}]}], "status_code": 200, "created_at": "2024-01-05T09:00:00.000Z"}


@pytest.fixture
def small_ranges(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before, opened = spark.conf.get(name), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set(name, "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set(name, before)
    spark.conf.set("spark.sql.files.openCostInBytes", opened)


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("ascii_only", [True, False])
def test_every_request_comes_out(spark, tmp_path, small_ranges, indent, ascii_only):
    rng = random.Random(7)
    rows = [row(rng, k) for k in range(60)]
    path = tmp_path / "logs_requests_202501010000.json"
    path.write_text(json.dumps({"logs_requests": rows}, indent=indent, ensure_ascii=ascii_only) + ("\n" if indent else ""))
    assert dumps.pieces(spark, str(path)).select("range").distinct().count() > 5
    got = sorted((json.loads(r.request) for r in dumps.requests_of(spark, str(path)).collect()), key=lambda r: r["id"])
    assert got == rows
    read = {r.id: r for r in requests.read_dump(spark, str(path)).collect()}
    assert len(read) == 60 and all(read[k].request_body == rows[k]["request_body"] and read[k].route == rows[k]["route"] for k in read)


def test_lines_of_objects_empty_lists_and_broken_dumps(spark, tmp_path):
    def found(text):
        (tmp_path / "dump.json").write_text(text)
        return sorted(json.loads(r.request)["id"] for r in dumps.requests_of(spark, str(tmp_path / "dump.json")).collect())

    assert found('{"logs_requests":[{"id":1},{"id":2}]}\n{"logs_requests":[]}\n{ "logs_requests" : [ {"id":3} ] }\n{"logs_requests":[]}') == [1, 2, 3]
    assert found('{"logs_requests":[]}') == [] and found('{"logs_requests":[{"id":1}]}') == [1]
    for text in ("", "[]", '{"other":[{"id":1}]}', '{"logs_requests":[{"id":1},{"id":2', '{"logs_requests":[{"id":1}', '{"logs_requests":[{"id":1},{"id":"}'):
        with pytest.raises(ValueError):
            found(text)
