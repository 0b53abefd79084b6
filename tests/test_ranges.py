"""Files scanned in byte ranges: JSON arrays, inventory, digests."""
import json
import random

import pytest

from textpairs.sources import ranges as R


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def messages(rng, n):
    bits = ["a", "é", "字", "}", "{", "[", "]", '"', "\\", "\n", "\t", ",", " ", "}, {", '"}', "\\\"", "😀", ":"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
    out = []
    for _ in range(n):
        m = {"src": text(), "trg": text(), "pred": text()}
        if rng.random() < 0.3:
            m["extra"] = {"deep": [{"x": text()}, [], {}, {"y": {"z": text()}}]}
        out.append(m)
    return out


@pytest.mark.parametrize("seed, indent, ascii_", [(1, None, True), (2, None, False), (3, 2, False)])
def test_json_array_equals_loads(spark, small_splits, tmp_path, seed, indent, ascii_):
    rng = random.Random(seed)
    expected = {}
    (tmp_path / "in").mkdir()
    for f, n in (("a.json", 40), ("b.json", 1), ("empty.json", 0)):
        text = json.dumps(messages(rng, n), indent=indent, ensure_ascii=ascii_)
        (tmp_path / "in" / f).write_text(text + ("\n" if f != "b.json" else ""))
        expected[f] = json.loads(text)
    assert len((tmp_path / "in" / "a.json").read_bytes()) > 5 * 97
    got = R.json_array_objects(spark, str(tmp_path / "in"), "*.json").collect()
    for f, objects in expected.items():
        rows = sorted((r["obj"], r["json"]) for r in got if r["file_path"].endswith(f))
        assert [json.loads(j) for _, j in rows] == objects and [o for o, _ in rows] == list(range(len(objects)))
    parsed = R.read_message_array(spark, str(tmp_path / "in"), "a.json").orderBy("obj").collect()
    assert [(r["src"], r["trg"], r["pred"]) for r in parsed] == [(m["src"], m["trg"], m["pred"]) for m in expected["a.json"]]
    assert all(r["src_tokens"] == list(r["src"]) for r in parsed)


@pytest.mark.parametrize("text", ['[{"a": 1} {"a": 2}]', '[{"a": 1}', '{"a": 1}', '[{"a": 1}, 3]', '[{"a": "}]', "[1]", '[{"a":1}]x'])
def test_other_texts_are_errors(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="not a JSON array"):
        R.json_array_objects(spark, str(tmp_path / "x.json")).collect()


def test_inventory_and_its_errors(spark, small_splits, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    files = {"a.txt": "one\n\n two\r\n" * 40, "deep/b.txt": "no end", "deep/none.txt": "", "c.csv": "x\n"}
    for f, t in files.items():
        (tmp_path / "in" / f).write_bytes(t.encode())
    got = {r["file_name"]: (r["n_bytes"], r["n_lines"], r["n_rows"]) for r in R.text_inventory(spark, str(tmp_path / "in"), "*.txt").collect()}
    assert got == {"a.txt": (440, 120, 80), "b.txt": (6, 1, 1)}
    with pytest.raises(FileNotFoundError):
        R.text_inventory(spark, str(tmp_path / "in"), "*.json")
    (tmp_path / "in" / "deep" / "d.example.txt").write_text("x")
    with pytest.raises(ValueError, match="example"):
        R.text_inventory(spark, str(tmp_path / "in"), "*.txt")
    assert R.text_inventory(spark, str(tmp_path / "in"), "*.txt", allow_example=True).count() == 3


def test_file_digests_follow_bytes_names_and_order(spark, small_splits, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "FAN", 4)
    lines = [f"line {i} \xff" for i in range(90)]

    def put(folder, files):
        for f, data in files.items():
            p = tmp_path / folder / f
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(data)
        rows = R.file_digests(spark, str(tmp_path / folder))
        total = R.corpus_digest(rows).first()
        return {r["name"]: (r["n_bytes"], r["n_lines"], r["digest"]) for r in rows.collect()}, total

    body = "\n".join(lines).encode("latin-1")
    base, total = put("v0", {"a.txt": body, "d/b.txt": b"x\n", "d/empty": b""})
    assert base["a.txt"][:2] == (len(body), 90) and total["n_files"] == 2  # none without bytes
    again, same = put("elsewhere", {"a.txt": body, "d/b.txt": b"x\n", "d/empty": b""})
    assert again == base and same["corpus_digest"] == total["corpus_digest"]
    moved = "\n".join([lines[1], lines[0], *lines[2:]]).encode("latin-1")
    for name, files in {"byte": {"a.txt": body[:-1] + b"\xfe", "d/b.txt": b"x\n", "d/empty": b""},
                        "feed": {"a.txt": body + b"\n", "d/b.txt": b"x\n", "d/empty": b""},
                        "cr": {"a.txt": body, "d/b.txt": b"x\r\n", "d/empty": b""},
                        "line": {"a.txt": moved, "d/b.txt": b"x\n", "d/empty": b""},
                        "name": {"a2.txt": body, "d/b.txt": b"x\n", "d/empty": b""},
                        "gone": {"a.txt": body}}.items():
        changed, other = put(name, files)
        assert other["corpus_digest"] != total["corpus_digest"]
        assert (changed.get("a.txt") == base["a.txt"]) == (name in ("cr", "gone"))
        if name == "name":
            assert changed["a2.txt"] == base["a.txt"]
