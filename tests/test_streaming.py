"""Incremental rebuilds: only what changed is built, and a repeated batch gives the same."""

from tessera.streaming.incremental import chunked, incremental, rebuild, state


def test_rebuild(spark, tmp_path):
    uri, built = str(tmp_path / "state"), []
    rows = lambda *r: spark.createDataFrame(r, "path string, fingerprint string")
    build = lambda changed: built.append(sorted({r["path"] for r in changed.collect()}))
    first = rows(("0", "a"), ("0", "b"), ("1", "c"))
    assert {r["state"] for r in rebuild(first, uri, 0, build).collect()} == {"new"}
    second = rows(("0", "b"), ("0", "a"), ("1", "d"), ("2", "e"))
    for _ in range(2):
        got = {r["path"]: r["state"] for r in rebuild(second, uri, 1, build).collect()}
        assert got == {"0": "restore", "1": "rebuild", "2": "new"}
    rebuild(rows(("2", "e")), uri, 2, build)
    rebuild(rows(("2", "e")), uri, 3, build, config="other")
    assert built == [["0", "1"], ["1", "2"], ["1", "2"], [], ["2"]]
    assert {r["path"] for r in state(spark, uri).collect()} == {"0", "1", "2"}
    assert state(spark, str(tmp_path / "none")) is None


def test_stream(spark, tmp_path):
    source, uri, built = str(tmp_path / "in"), str(tmp_path / "state"), []
    for k in range(3):
        spark.createDataFrame([(str(k), "x"), ("9", f"v{k // 2}")], "path string, fingerprint string").coalesce(1).write.mode("append").parquet(source)
    stream = chunked(spark, source, "path string, fingerprint string", files=1)
    query = incremental(stream, uri, str(tmp_path / "checkpoint"), lambda rows, batch: built.append((batch, sorted(r["path"] for r in rows.collect()))))
    query.awaitTermination(120)
    assert query.exception() is None
    assert [b for b, _ in built] == [0, 1, 2] and sum(len(p) for _, p in built) == 5
    assert {r["path"] for r in state(spark, uri).collect()} == {"0", "1", "2", "9"}
