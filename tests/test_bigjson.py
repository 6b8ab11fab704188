"""Huge JSON documents by byte ranges: equal rows for every size of range, and work in several tasks."""

import json
import random

import pytest

from reelspark.sources import bigjson, readers


def document(n, seed=1):
    rnd = random.Random(seed)
    odd = ['a "quoted" \\ back', "{not} [a] bracket", "\\\\", "é ü 漢", "", 'end\\"', "\n\t", '\\"}]{[']
    text = lambda: "".join(rnd.choice(odd) for _ in range(rnd.randrange(4)))
    return {
        "dicoms": [{"dicom_uuid": f"d{rnd.randrange(n)}", "type": text()} for _ in range(n)],
        "meta": {"made": ["x", {"y": "{"}]},
        "studies": [{"study_uuid": f"s{rnd.randrange(n)}", "bmi": rnd.random(), "conditions": [text(), {"deep": [{"er": text()}]}], "conclusions": text(), "extra": {"k": []}} for _ in range(n)],
        "none": [],
    }


@pytest.mark.parametrize("chunk", [37, 900])
def test_equal_rows_for_all_ranges(spark, tmp_path, chunk):
    for i, indent in enumerate((None, 2)):
        (tmp_path / f"{i}.json").write_text(json.dumps(document(12, i), indent=indent, ensure_ascii=bool(i)))
        path = str(tmp_path / f"{i}.json")
        whole, parts = readers.read_annotations(spark, path), readers.read_annotations(spark, path, chunk_bytes=chunk)
        for a, b in zip(whole, parts, strict=True):
            assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.columns == b.columns
    got = bigjson.json_records(spark, str(tmp_path), chunk).collect()
    assert len(got) == 48 and {r.name for r in got} == {"dicoms", "studies"}
    assert [json.loads(r.text) for r in sorted((r for r in got if r.path.endswith("0.json") and r.name == "studies"), key=lambda r: r.place)] == document(12, 0)["studies"]


def test_one_file_takes_several_tasks(spark, tmp_path):
    doc = document(20_000)
    (tmp_path / "a.json").write_text(json.dumps(doc))
    size = (tmp_path / "a.json").stat().st_size
    spark.sparkContext.setJobGroup("big-json", "")
    items, studies = readers.read_annotations(spark, str(tmp_path / "a.json"), chunk_bytes=size // 12)
    assert items.count() == len({x["dicom_uuid"] for x in doc["dicoms"]})
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("big-json") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(tasks) == 13
    first = {}
    for x in doc["studies"]:
        first.setdefault(x["study_uuid"], x["conclusions"])
    assert {r.study_uuid: r.conclusions for r in studies.collect()} == first


def test_odd_documents(spark, tmp_path):
    (tmp_path / "cut.json").write_text('{"dicoms": [{"dicom_uuid": "a"}, {"dicom_uuid": "b"}, {"dicom_')
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "void.json").write_text("{}")
    got = bigjson.json_records(spark, str(tmp_path), 16).collect()
    assert [(r.name, json.loads(r.text)["dicom_uuid"]) for r in sorted(got, key=lambda r: r.place)] == [("dicoms", "a"), ("dicoms", "b")]
