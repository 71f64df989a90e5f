import json
import random

import pytest
from pyspark.sql import functions as F

from termloom.sources import json_array as J

SCHEMA = "id long, text string, deep struct<a: array<long>, b: string>"


@pytest.fixture
def small_blocks(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def made(n: int, seed: int = 3) -> list[dict]:
    deal = random.Random(seed)
    hard = ['}', '{', '"', "\\", "\\\"", '],[', ',', '"},{"', "é", "日本", "\n", "x" * 40, "[", "\\\\", "}" * 5]
    word = lambda: "".join(deal.choice(hard) for _ in range(deal.randrange(12)))
    rows = [{"id": k, "text": word(), "deep": {"a": [k, k + 1], "b": word()}} for k in range(n)]
    rows[n // 2]["text"] = "long }{\" " * 900  # longer than many blocks
    return rows


def plain(df):
    return sorted((r.id, r.text, r.deep and (tuple(r.deep.a), r.deep.b)) for r in df.collect())


@pytest.mark.parametrize("indent", [None, 2])
def test_blocks_give_what_one_reader_gives(spark, small_blocks, tmp_path, indent):
    folder = tmp_path / "arrays"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.json").write_text(json.dumps(made(120, k), indent=indent, ensure_ascii=k == 1) + "\n", encoding="utf-8-sig" if k == 2 else "utf-8")
    (folder / "none.json").write_text(" [ ] ")
    (folder / "empty.json").write_text("")
    found = J.read_json_array(spark, str(folder), SCHEMA)
    expected = sorted((r["id"], r["text"], (tuple(r["deep"]["a"]), r["deep"]["b"])) for k in range(3) for r in made(120, k))
    assert plain(found) == expected
    assert spark.read.option("lineSep", "}").text(str(folder)).select("_metadata.file_block_start").distinct().count() > 20


def test_equals_the_reader_of_whole_files(spark, small_blocks, tmp_path):
    path = tmp_path / "one.json"
    rows = made(200) + [{"id": 200 + k, "text": "é]},{" * (k % 5), "deep": None, "more": [1, {"a": [k]}]} for k in range(57)]
    path.write_text(json.dumps(rows, ensure_ascii=False, indent=1), encoding="utf-8-sig")
    assert plain(J.read_json_array(spark, str(path), SCHEMA)) == plain(spark.read.schema(SCHEMA).option("multiLine", True).json(str(path)))


def test_many_blocks_are_sorted_in_place_of_a_broadcast(spark, small_blocks, tmp_path, monkeypatch):
    path = tmp_path / "one.json"
    path.write_text(json.dumps(made(150)))
    whole = plain(J.read_json_array(spark, str(path), SCHEMA))
    monkeypatch.setattr(J, "BROADCAST_BLOCKS", 0)
    assert plain(J.read_json_array(spark, str(path), SCHEMA)) == whole and len(whole) == 150


@pytest.mark.parametrize("text", ['{"id": 1}', '[{"id": 1}', '[{"id": 1}, {"id": "x', '[{"id": 1}] [2]', 'x [{"id": 1}]', '[{"id": 1}]]'])
def test_what_is_no_whole_array_is_refused(spark, tmp_path, text):
    path = tmp_path / "bad.json"
    path.write_text(text)
    with pytest.raises(Exception, match="array"):
        J.read_json_array(spark, str(path), SCHEMA).collect()


def test_elements_that_are_no_objects_are_rows_of_nulls(spark, tmp_path):
    path = tmp_path / "mixed.json"
    path.write_text('[1, {"id": 7}, "a,b", null]')
    assert [r.text.strip() for r in J.array_elements(spark, str(path)).orderBy(F.length("text")).collect()] == ["1", "null", '"a,b"', '{"id": 7}']
    assert sorted((r.id or 0) for r in J.read_json_array(spark, str(path), SCHEMA).collect()) == [0, 0, 0, 7]
