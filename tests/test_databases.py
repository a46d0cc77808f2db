import io
import json
import types

import numpy as np
import pytest

from strandline import cli
from strandline.errors import SketchError
from strandline.sources import databases, oxli, sbt, signatures
from test_sources import text


def signature_text(name, mins):
    one = json.loads(text(mins))
    one[0]["name"] = name
    return json.dumps(one)


@pytest.fixture
def store(spark, tmp_path):
    for name, mins in {"a": [1, 2, 3, 4], "b": [1, 2, 3, 9], "c": [50, 60]}.items():
        databases.save_file(spark, f"file://{tmp_path}/.leaves", name, signature_text(name, mins).encode())
    leaves = {str(i + 2): {"filename": n, "name": n, "metadata": n} for i, n in enumerate("abc")}
    tree = {"d": 2, "version": 5, "storage": {"backend": "FSStorage", "args": {"path": ".leaves"}}, "factory": {"class": "F", "args": [1]}, "nodes": {}, "leaves": leaves}
    (tmp_path / "t.sbt.json").write_text(json.dumps(tree))
    (tmp_path / "q.sig").write_text(signature_text("a", [1, 2, 3, 4]))
    return tmp_path


def test_search_of_trees_and_files(spark, store, capsys):
    found = databases.load_databases(spark, [f"{store}/t.sbt.json", f"{store}/q.sig", f"{store}/.leaves"])
    assert len(found) == 2 and [x.count() for x in found.values()] == [3, 1]
    assert cli.main(["search", f"{store}/q.sig", f"{store}/t.sbt.json", "--threshold", "0.1", "-o", f"{store}/out", "--save-matches", f"{store}/sigs"]) == 0
    shown = capsys.readouterr().out
    assert " 100.0%       a" in shown and "  60.0%       b" in shown and "2 matches" in shown
    assert spark.read.option("header", True).csv(f"{store}/out").count() == 2
    assert {r["name"] for r in signatures.read_written(spark, f"{store}/sigs").collect()} == {"a", "b"}
    a = cli.arguments(["search", f"{store}/q.sig", f"{store}/t.sbt.json", "--best-only", "--containment", "--threshold", "0.5", "--scaled", "1"])
    assert [r["name"] for r in cli.run_search(spark, a).collect()] == ["a"]


def test_folders_and_errors(spark, store):
    assert len(databases.files_of(spark, f"{store}/.leaves", traverse=True)) == 3 and databases.files_of(spark, f"{store}/.leaves") == []
    with pytest.raises(SketchError):
        databases.load_databases(spark, [f"{store}/.leaves"])
    assert databases.load_query(spark, f"{store}/q.sig").first()["id"] == "a"
    assert databases.load_query(spark, f"{store}/q.sig", 31).count() == 0


def test_index(spark, store):
    some = databases.load_database(spark, f"{store}/t.sbt.json")
    databases.save_index(some, f"{store}/index")
    assert databases.load_index(spark, f"{store}/index", 21, "DNA").count() == 3 and databases.load_index(spark, f"{store}/index", 31).count() == 0
    assert sorted(map(str, databases.load_index(spark, f"{store}/index").select(some.columns).collect())) == sorted(map(str, some.collect()))


def test_scaffold_command(spark, store, capsys):
    assert cli.main(["scaffold", f"{store}/t.sbt.json"]) == 0
    assert capsys.readouterr().out.count("true") == 3


def test_node_filters(spark, tmp_path):
    bins = {0: [[1, 5, 12], [0, 8]], 2: [[], [3]]}
    for pos, some in bins.items():
        databases.save_file(spark, f"file://{tmp_path}/.sbt", f"n{pos}", oxli.render([13, 9], [np.array(b, np.int64) for b in some], 21))
    databases.save_file(spark, f"file://{tmp_path}/.sbt", "other", b"no filter, and not named by the tree")
    nodes = {str(pos): {"filename": f"n{pos}", "name": f"n{pos}", "metadata": {}} for pos in bins}
    tree = {"d": 2, "version": 5, "storage": {"backend": "FSStorage", "args": {"path": ".sbt"}}, "factory": {"class": "F", "args": [1]}, "nodes": nodes, "leaves": {}}
    (tmp_path / "t.sbt.json").write_text(json.dumps(tree))
    filters, sizes = sbt.TreeFile(spark, f"{tmp_path}/t.sbt.json").node_filters()
    found = {(r["node"], r["tbl"]): np.flatnonzero(np.unpackbits(np.frombuffer(bytes(r["bitmap"]), np.uint8), bitorder="little")).tolist() for r in filters.collect()}
    assert found == {(pos, i): b for pos, some in bins.items() for i, b in enumerate(some) if b}
    assert sorted(map(tuple, sizes.collect())) == [(0, 21, [13, 9]), (2, 21, [13, 9])]
    (tmp_path / "bare.sbt.json").write_text(json.dumps(tree | {"nodes": {}}))
    with pytest.raises(ValueError):
        sbt.TreeFile(spark, f"{tmp_path}/bare.sbt.json").node_filters()


def test_standard_streams(spark, monkeypatch, capsys):
    given = signature_text("a", [1, 2, 3, 4]).encode()
    monkeypatch.setattr("sys.stdin", types.SimpleNamespace(buffer=io.BytesIO(given)))
    read = signatures.read_signatures(spark, "-")
    assert [r["name"] for r in read.collect()] == ["a"]
    signatures.write_signatures(read, "-")
    assert [json.loads(x)[0]["name"] for x in capsys.readouterr().out.splitlines()] == ["a"]
    monkeypatch.setattr("sys.stdin", types.SimpleNamespace(buffer=io.BytesIO(given)))
    assert [x.count() for x in databases.load_databases(spark, ["-"]).values()] == [1]
    assert cli.arguments(["search", "-", "x", "--ignore-abundance"]).ignore_abundance
