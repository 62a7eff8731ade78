import json

import pytest

from fundstelle.__main__ import main
from fundstelle.plans import report


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    text = "nach § 433 Abs. 1 BGB gilt, BGH 1 A 2/03 x"
    docs = [{"doc_id": "a", "format": "plain", "raw": text, "text": text}, {"doc_id": "b", "raw": "y", "text": "y"}]
    cites = [{"id": "1", "type": "law", "span": {"start": 5, "end": 21, "text": "§ 433 Abs. 1 BGB"}, "book": "BGB", "number": "433"}, {"id": "2", "type": "case", "span": {"start": 28, "end": 40, "text": "BGH 1 A 2/03"}, "court": "BGH", "file_number": "1 A 2/04"}]
    (path / "documents.jsonl").write_text("\n".join(map(json.dumps, docs)), encoding="utf-8")
    (path / "annotations.jsonl").write_text(json.dumps({"doc_id": "a", "citations": cites, "relations": []}), encoding="utf-8")
    return str(path)


def test_evaluation(spark, folder, capsys):
    assert main(["evaluate", "--data", folder, "--json"], spark) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["documents"] == 1 and got["exact"]["tp"] == 2 and got["fields"]["book"]["accuracy"] == 1.0 and got["fields"]["file_number"]["incorrect"] == 1
    assert main(["evaluate", "--data", folder, "--engine", "citations", "--limit", "1"], spark) == 0
    assert "overlap all" in capsys.readouterr().out
    with pytest.raises(ValueError):
        report.predictions(spark.createDataFrame([], "doc_id string, text string, citations string"), "none")


def test_commands(spark, folder, tmp_path, capsys):
    assert main(["validate", "--data", folder], spark) == 0
    assert "no annotations" in capsys.readouterr().err
    assert main(["diagnose", "--data", folder], spark) == 0
    assert "file numbers" in capsys.readouterr().out
    assert main(["bio", "--data", folder, "--out", str(tmp_path / "bio")], spark) == 0
    assert spark.read.json(str(tmp_path / "bio")).count() == 1
    assert main(["extract", "--data", f"{folder}/documents.jsonl", "--out", str(tmp_path / "out")], spark) == 0
    assert spark.read.text(str(tmp_path / "out")).count() == 2
