import os
import subprocess

import pytest
from pyspark.sql import functions as F

from lodestrata.functions.ids import content_hash
from lodestrata.lake import FactLake, inventory
from lodestrata.sources import files as sources
from lodestrata.sources import vcs
from lodestrata.streaming import feed


def listed(spark, texts):
    return spark.createDataFrame(list(texts.items()), "module string, text string").withColumn("contentHash", content_hash("text"))


@pytest.fixture()
def lake(spark, tmp_path):
    return FactLake(spark, f"file://{tmp_path}/lake", buckets=4)


def modules(df):
    return sorted(r.module for r in df.select("module").distinct().collect())


def test_ingest_and_reindex(spark, lake):
    first = {"a.py": "def f():\n    return g()\ndef g(): pass\n", "b.md": "# T\ntext\n", "c.json": '{"k": 1}', "x.unknown": "?"}
    lake.ingest(listed(spark, first), 1)
    assert modules(lake.read("symbols")) == ["a.py", "b.md", "c.json"] and modules(lake.read("files")) == ["a.py", "b.md", "c.json"]
    assert {r.module: r.content for r in lake.read("files").collect()} == {"a.py": "code", "b.md": "document", "c.json": "data"}
    held, old = lake.version(), lake.read("symbols").count()
    lake.ingest(listed(spark, first | {"a.py": "def h(): pass\n", "c.json": "{"}), 2)
    names = {r.name for r in lake.read("symbols").filter("module = 'a.py'").collect()}
    assert names == {"h"} and [r.module for r in lake.read("parse_failures").collect()] == ["c.json"]
    assert lake.read("symbols").filter("module = 'c.json'").count() == 1  # a file that doesn't parse keeps its facts
    assert {r.module: r.indexedAt for r in lake.read("files").collect()} == {"a.py": 2, "b.md": 1, "c.json": 1}
    assert lake.read("symbols", held).count() == old  # an open version doesn't change
    lake.ingest(listed(spark, {"c.json": '{"z": 2}'}), 3)
    assert lake.read("parse_failures").count() == 0 and {r.name for r in lake.read("symbols").filter("module = 'c.json'").collect()} == {"z"}
    lake.forget_modules(spark.createDataFrame([("a.py",), ("never.py",)], "module string"))
    assert modules(lake.read("symbols")) == ["b.md", "c.json"] and modules(lake.read("files")) == ["b.md", "c.json"]


def test_knowledge_tables(spark, lake):
    gap = lambda n: spark.createDataFrame([("s", "why", n, n)], "symbolId string, question string, askCount long, lastAsked long")
    lake.upsert("gaps", gap(1))
    lake.upsert("gaps", gap(5))
    assert [r.askCount for r in lake.read("gaps").collect()] == [5]
    blob = lambda b: spark.createDataFrame([("h", bytearray(b))], "hash string, bytes binary")
    lake.insert_absent("refactor_blobs", blob(b"1"))
    lake.insert_absent("refactor_blobs", blob(b"2"))
    assert [bytes(r.bytes) for r in lake.read("refactor_blobs").collect()] == [b"1"]
    lake.ingest(listed(spark, {"a.py": "x = 1\n"}), 1)
    lake.rebuild()
    assert lake.read("symbols").count() == 0 and lake.read("gaps").count() == 1
    lake.put_meta(scannedAt="5", files="1")
    assert lake.meta("scannedAt", "files") == {"scannedAt": "5", "files": "1"} and lake.meta("nope") is None
    assert [x["version"] for x in inventory(spark, lake.root.rsplit("/", 1)[0])] == [lake.version()]
    lake.drop()
    assert lake.version() == 0
    with pytest.raises(KeyError):
        lake.read("nope")


def test_files_and_history(spark, tmp_path):
    root = tmp_path / "w"
    (root / "src").mkdir(parents=True)
    (root / "node_modules").mkdir()
    for name, data in {"src/a.py": b"x = 1\n", "src/b.bin": b"a\0b", "node_modules/z.py": b"", ".gitignore": b"skip.py\n", "skip.py": b"y = 2\n"}.items():
        (root / name).write_bytes(data)
    assert sources.walk(str(root), {".py"}) == ["skip.py", "src/a.py"] and sources.tracked(str(root)) is None and vcs.log_text(str(root)) == ""
    assert sources.included(str(root), ["src/**"]) == ["src/a.py", "src/b.bin"]
    got = {r.module: (r.state, r.text) for r in sources.read_files(spark, str(root / "src")).collect()}
    assert got == {"a.py": ("ok", "x = 1\n"), "b.bin": ("binary", None)}
    env = os.environ | {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b.c", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b.c"}
    for args in (["init", "-q"], ["add", "src", ".gitignore"], ["commit", "-qm", "one\n\nbody"]):
        subprocess.run(["git", *args], cwd=root, env=env, check=True)
    assert "skip.py" not in sources.tracked(str(root)) and "src/a.py" in sources.tracked(str(root))
    assert {r.module: r.provider for r in sources.listing(spark, str(root)).collect()}["src/a.py"] == "python"
    commits, changes = vcs.history(spark, str(root))
    assert [r.message for r in commits.collect()] == ["one\n\nbody"] and {r.path: r.added for r in changes.collect()} == {"src/a.py": 1, "src/b.bin": 0, ".gitignore": 1}
    (root / "facts.json").write_text('{"deny": ["**/secret/**", 3], "include": ["x"]}')
    assert sources.scope_of(str(root)) == {"include": ["x"], "exclude": [], "deny": ["**/secret/**"], "bundles": []}


def test_change_feed(spark, tmp_path):
    schema = "module string, seq long, kind string, contentHash string, owners int"
    path, seen = str(tmp_path / "feed"), []
    held = {"b": "same"}
    files = lambda: spark.createDataFrame(list(held.items()) or [("-", "-")], "module string, contentHash string")

    def apply(decided, batch_id):
        for r in decided.collect():
            seen.append((r.module, r.action))
            held.pop(r.module, None) if r.action == "forget" else held.update({r.module: r.contentHash})

    def run():
        feed.apply_feed(feed.read_feed(spark, path, schema), files, apply, str(tmp_path / "cp")).awaitTermination()

    spark.createDataFrame([("a", 1, "changed", "h1", 1), ("a", 2, "changed", "h2", 1), ("b", 3, "changed", "same", 1)], schema).coalesce(1).write.parquet(path)
    run()
    spark.createDataFrame([("a", 4, "deleted", None, 0), ("b", 5, "changed", "new", 1)], schema).coalesce(1).write.mode("append").parquet(path)
    run()
    run()
    assert seen == [("a", "reindex"), ("a", "forget"), ("b", "reindex")] or sorted(seen[1:]) == [("a", "forget"), ("b", "reindex")]
    assert held == {"b": "new"}


def test_windows_over_a_stream(spark, tmp_path):
    path = str(tmp_path / "ev")
    rows = [("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:10:00"), ("u", "2024-01-01 05:00:00"), ("v", "2024-01-01 05:00:00")]
    spark.createDataFrame(rows, "user string, t string").select("user", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(path)
    source = lambda: spark.readStream.schema("user string, ts timestamp").parquet(path)
    for name, df, n in (("w", feed.windowed(source(), "ts", "1 hour", keys=("user",)), 3), ("c", feed.counted(source(), ["user"], "ts"), 2)):
        df.writeStream.format("memory").queryName(f"q_{name}").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
        assert spark.table(f"q_{name}").count() == n
    s = feed.sessions(source(), "ts", "30 minutes", ("user",))
    s.writeStream.format("memory").queryName("q_s").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("q_s").filter("n = 2").count() == 1


def test_two_writers(spark, tmp_path, monkeypatch):
    """A snapshot that somebody else publishes first is not lost: the write starts over on top of it."""
    from lodestrata import lake as m

    a, b = (m.FactLake(spark, f"file://{tmp_path}/lake", buckets=2) for _ in range(2))
    a.put_meta(x="1")
    publish, once = m.FactLake._publish, []

    def between(self, old, manifest):
        if not once:
            once.append(1)
            b.put_meta(y="2")
        return publish(self, old, manifest)

    monkeypatch.setattr(m.FactLake, "_publish", between)
    a.put_meta(z="3")
    assert a.meta("x", "y", "z") == {"x": "1", "y": "2", "z": "3"} and a.version() == 3
    with pytest.raises(m.Conflict):
        publish(a, 1, {})
    (tmp_path / "lake/current/v=4").touch()  # a writer that died before it named its manifest
    assert a.version() == 3 and a.put_meta(w="4") == 5 and a.meta("w") == {"w": "4"}


def test_files_written_together(tmp_path):
    from lodestrata.operators.refactor import write_sources

    (tmp_path / "old.py").write_bytes(b"x")
    assert write_sources(str(tmp_path), {"old.py": None, "a/b.py": b"1", "c.py": b"2"}) == ["a/b.py", "c.py", "old.py"]
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["a/b.py", "c.py"]
    with pytest.raises(ValueError):
        write_sources(str(tmp_path), {"c.py": b"3", "../d.py": b"4"})
    assert (tmp_path / "c.py").read_bytes() == b"2" and len(list(tmp_path.rglob("*.tmp"))) == 0
