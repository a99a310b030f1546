"""Long documents read by many tasks equal the same documents read whole."""

import json
import random

import pytest

from riskboard.sources import longjson, publish, snapshot


def write(path, document, **kw):
    path.write_text(json.dumps(document, ensure_ascii=False, **kw), encoding="utf-8")


ODD = ['plain', 'brace } in text', '"quoted" {"a": [1]}', 'back\\slash', '\\"}', ']},{"name":"no"', '保本 } 高息', 'line\nbreak', '', '\\', '}' * 40]


def companies(n, seed):
    rnd = random.Random(seed)
    return [{"name": f"firm {k}", "status": rnd.choice(["OPEN", "CLOSED", None]), "icp": {"web": [{"domain": f"c{k}.example", "name": rnd.choice(ODD)}], "mapp": []},
             "risk": {"overall_risk_found": None, "evidence": [{"id": f"E{i}", "claim": rnd.choice(ODD), "excerpt": rnd.choice(ODD) * rnd.randrange(1, 30)}
                                                              for i in range(rnd.randrange(0, 4))], "uncertainties": rnd.sample(ODD, 3)}} for k in range(n)]


def document(n, seed, run):
    return {"meta": {"run_id": run, "notice": 'a "}" here'}, "sources": [{"id": "S1", "name": "}{"}, {"id": "S2", "name": None}],
            "count": 3, "names": ["x", "}", {"loose": 1}], "companies": companies(n, seed), "flag": True, "empty": []}


@pytest.mark.parametrize("split", ["300b", "2k", "128m"])
def test_elements_of_a_long_document(spark, tmp_path, split):
    told = {"a.json": document(60, 1, "r1"), "b.json": document(25, 2, "r2"), "c.json": {"meta": {"run_id": "r3"}, "companies": []}}
    write(tmp_path / "a.json", told["a.json"], separators=(",", ":"))
    write(tmp_path / "b.json", told["b.json"], indent=2)
    (tmp_path / "c.json").write_text(json.dumps(told["c.json"]) + "\n\n", encoding="utf-8")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = longjson.elements(spark, str(tmp_path)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    if split == "300b":
        assert len({r["start"] for r in rows}) > 20
    for name, doc in told.items():
        own = sorted((r for r in rows if r["path"].endswith(name)), key=lambda r: (r["start"], r["seq"]))
        for key in ("meta", "sources", "companies"):
            want = [doc[key]] if key == "meta" else doc.get(key, [])
            assert [json.loads(r["value"]) for r in own if r["name"] == key] == want
        assert [json.loads(r["value"]) for r in own if r["name"] == "names"] == [x for x in doc.get("names", []) if isinstance(x, dict)]
        assert {r["name"] for r in own} <= {"meta", "sources", "companies", "names"}


def test_tables_equal_those_of_whole_documents(spark, board_path, rows, tmp_path):
    whole = snapshot.normalise(snapshot.read_snapshot(spark, board_path))
    long_ = snapshot.normalise_long(spark, board_path)
    assert list(whole) == list(long_)
    for name in whole:
        assert rows(long_[name]) == rows(whole[name]), name
        assert long_[name].dtypes == whole[name].dtypes


def test_written_documents_read_back(spark, tmp_path):
    told = [(k, json.dumps(c, ensure_ascii=False)) for k, c in enumerate(companies(50, 5))]
    objects = spark.createDataFrame(told, "k long, value string").repartition(3)
    publish.write_documents(objects, str(tmp_path / "run"), "r9")
    tables = snapshot.normalise_long(spark, str(tmp_path / "run"))
    assert {r["name"] for r in tables["company"].collect()} == {f"firm {k}" for k in range(50)}
    assert {r["run_id"] for r in tables["evidence"].collect()} == {"r9"}
    assert tables["evidence"].count() == sum(len(json.loads(c)["risk"]["evidence"]) for _, c in told)


def test_long_objects_reach_python_in_small_batches(spark, tmp_path):
    """A batch is bounded by its bytes: 20 MB of objects in one task come in several."""
    rows = spark.range(2_000, numPartitions=1).selectExpr("""concat('{"name": "', id, repeat('x', 10000), '"}') as value""")
    publish.write_documents(rows, str(tmp_path / "run"), "r")
    sizes = rows.mapInArrow(lambda batches: (type(b).from_pydict({"n": [b.nbytes]}) for b in batches), "n bigint").collect()
    assert len(sizes) > 1 and max(r["n"] for r in sizes) < 10_000_000
    assert snapshot.normalise_long(spark, str(tmp_path / "run"))["company"].count() == 2_000
