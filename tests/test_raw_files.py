import hashlib
import json
import os
import random

import pytest

from claimledger.session import materialize
from claimledger.sources import raw_files as rw
from claimledger.sources.fingerprint import byte_fingerprint, source_sizes


def tree(data: bytes, block: int, fan: int) -> str:
    level = [hashlib.sha256(b"\0" + data[i:i + block]).digest() for i in range(0, len(data), block)]
    while len(level) > 1:
        parts = [level[i:i + fan] for i in range(0, len(level), fan)]
        level = [p[0] if len(p) == 1 else hashlib.sha256(b"\1" + b"".join(p)).digest() for p in parts]
    return level[0].hex()


@pytest.fixture()
def files(tmp_path):
    rnd = random.Random(3)
    data = {"long one.bin": rnd.randbytes(100_003), "exact.bin": rnd.randbytes(3000), "short.bin": b"x"}
    for name, b in data.items():
        (tmp_path / name).write_bytes(b)
    (tmp_path / "none.bin").write_bytes(b"")
    return tmp_path, data


def test_hash_trees_equal_hashlib(spark, files):
    root, data = files
    blocks = materialize(rw.block_hashes(spark, str(root), 1000))
    assert blocks.count() == 101 + 3 + 1
    got = {r["path"].rsplit("/", 1)[1]: r for r in rw.tree_roots(blocks, 4).collect()}
    assert {n: (r["bytes"], r["n_blocks"], r["sha256"]) for n, r in got.items()} == {
        n: (len(b), -(-len(b) // 1000), tree(b, 1000, 4)) for n, b in data.items()}
    whole = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in rw.whole_hashes(rw.listing(spark, str(root))).collect()}
    assert whole == {n: hashlib.sha256(b).hexdigest() for n, b in data.items()}
    assert rw.tree_roots(blocks.where("false")).count() == 0


def test_changed_blocks_are_named(spark, files):
    root, data = files
    before = materialize(rw.block_hashes(spark, str(root), 1000))
    b = bytearray(data["long one.bin"])
    b[42_500] ^= 1
    (root / "long one.bin").write_bytes(bytes(b[:100_000]))
    (root / "short.bin").write_bytes(b"x" * 1001)
    got = rw.changed_blocks(before, rw.block_hashes(spark, str(root), 1000)).collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["block"], r["change"]) for r in got) == [
        ("long one.bin", 42, "changed"), ("long one.bin", 100, "removed"),
        ("short.bin", 0, "changed"), ("short.bin", 1, "added")]


def test_fingerprints_and_sizes(spark, files):
    root, data = files
    got = byte_fingerprint(spark, str(root)).first()
    assert (got["n_files"], got["bytes"]) == (3, sum(map(len, data.values())))
    one = byte_fingerprint(spark, str(root / "exact.bin")).first()
    assert one["sha256"] == hashlib.sha256(data["exact.bin"]).hexdigest()
    sizes = source_sizes(spark, {n: str(root / n) for n in data}).collect()
    assert {r["source"]: r["bytes"] for r in sizes} == {n: os.path.getsize(root / n) for n in data}
    with pytest.raises(ValueError):
        rw.open_file("other:/x/y")


def test_shapes_of_differing_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v,t\n1,2.5,"x, y"\n2,,true\n')
    (tmp_path / "wide ü.CSV").write_text("k,v,t,u\n1,2,true,\n")
    (tmp_path / "header.csv").write_text("k,v\n")
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "list.json").write_text(json.dumps([{"k": 1}, {"k": 2.5, "o": {"x": 1}}]))
    (tmp_path / "lines.json").write_text('{"k": 1}\n{"k": null, "b": true}\n')
    (tmp_path / "bad.json").write_text('{"k": ')
    (tmp_path / "bad.parquet").write_bytes(b"no parquet at all")
    (tmp_path / "notes.md").write_text("# no data")
    spark.createDataFrame([(1, "x")], "k int, s string").coalesce(1).write.parquet(str(tmp_path / "p"))
    rows = rw.file_shapes(spark, str(tmp_path)).collect()
    got = {r["path"].rsplit("/", 1)[1]: r for r in rows}
    cols = lambda n: [(c["name"], c["type"]) for c in got[n]["columns"]]
    assert cols("a.csv") == [("k", "integer"), ("v", "double"), ("t", "text")]
    assert cols("wide ü.CSV") == [("k", "integer"), ("v", "integer"), ("t", "boolean"), ("u", "null")]
    assert cols("header.csv") == [("k", "null"), ("v", "null")]
    assert cols("none.csv") == [] and got["none.csv"]["bytes"] == 0 and got["none.csv"]["error"] is None
    assert cols("list.json") == [("k", "double"), ("o", "text")]
    assert cols("lines.json") == [("k", "integer"), ("b", "boolean")]
    for name in ("bad.json", "bad.parquet"):
        assert got[name]["columns"] is None and got[name]["error"]
    part = next(n for n in got if n.endswith(".parquet") and n != "bad.parquet")
    assert cols(part) == [("k", "int32"), ("s", "string")] and "notes.md" not in got


def test_a_head_that_ends_inside_a_record(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n" + "1,2\n" * 100 + "1,xyz\n")
    (tmp_path / "b.json").write_text("[" + ",".join('{"k": %d}' % i for i in range(100)) + "]")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in rw.file_shapes(spark, str(tmp_path), 50).collect()}
    assert [c["type"] for c in rows["a.csv"]["columns"]] == ["integer", "integer"]
    assert [c["type"] for c in rows["b.json"]["columns"]] == ["integer"]
