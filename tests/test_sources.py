import json
import os
import subprocess
from pathlib import Path

import pytest

from lodestrata.__main__ import arguments, epoch, main
from lodestrata.plans import report
from lodestrata.sources import files, git, parsers
from lodestrata.sources.config import load_config
from lodestrata.sources.ingest import ingest
from lodestrata.streaming import changes

WHO = {f"GIT_{r}_{k}": v for r in ("AUTHOR", "COMMITTER") for k, v in (("NAME", "Ada"), ("EMAIL", "ada@lab.example"))}


def sh(repo, *args):
    subprocess.run(["git", "-C", str(repo), *args], check=True, capture_output=True, env=os.environ | WHO)


def commit(repo, message):
    sh(repo, "add", "-A")
    sh(repo, "commit", "-q", "--allow-empty", "-m", message)


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    r = tmp_path_factory.mktemp("git") / "r"
    r.mkdir()
    sh(r, "init", "-q", "-b", "main")
    (r / "a.lua").write_text("-- old comment\nlocal x = 1\n")
    (r / "k.py").write_text("class K:\n    def one(self, x):\n        if x and x > 1:\n            return 1\n        return 2\n\n\ndef two(y):\n    return y\n")
    commit(r, "Add files")
    (r / "a.lua").write_text("local x = 1\n")
    (r / "k.py").write_text((r / "k.py").read_text().replace("return 2", "return 3"))
    commit(r, "Fix #12: wrong value")
    sh(r, "mv", "k.py", "b c.py")
    (r / "ü.c").write_text("int f(int a) { if (a) { return 1; } return 0; }\n")
    (r / "empty.py").write_text("")
    commit(r, "rename")
    os.chmod(r / "ü.c", 0o755)
    (r / "x.bin").write_bytes(b"\0\1\2")
    (r / "k.py").write_text("def z():\n    return 1\n")
    commit(r, "mode and binary")
    sh(r, "checkout", "-q", "-b", "side")
    (r / "side.py").write_text("def s():\n    return 0\n")
    commit(r, "side")
    sh(r, "checkout", "-q", "main")
    commit(r, "empty")
    sh(r, "merge", "-q", "--no-ff", "-m", "Merge side", "side")
    return str(r)


def test_log(spark, repo):
    rows = git.log_rows(repo)
    assert [r[5] for r in rows] == ["Add files", "Fix #12: wrong value", "rename", "mode and binary", "empty", "Merge side"] and len(rows[-1][1]) == 2
    assert [r[5] for r in git.log_rows(repo, max_count=2)] == ["empty", "Merge side"]
    assert git.read_log(spark, repo).count() == 6


def test_diffs(spark, repo):
    rows = git.file_diffs(git.read_log(spark, repo), repo).collect()
    order = {r[0]: r[7] for r in git.log_rows(repo)}
    found = {(order[r.sha], r.new_path or r.old_path): r for r in rows}
    lua = found[1, "a.lua"]
    assert (lua.old_path, lua.add_total, lua.del_total, [tuple(x) for x in lua.removed]) == ("a.lua", 0, 1, [(1, 1)])
    assert (found[2, "b c.py"].status, found[2, "b c.py"].old_path) == ("R", "k.py")
    assert found[2, "empty.py"].status == "A" and (3, "ü.c") in found and found[3, "x.bin"].is_binary
    assert found[5, "side.py"].status == "A" and found[0, "k.py"].old_oid is None


def test_hunks():
    assert git.hunk("@@ -5 +5,2 @@") == (5, 1, 5, 2) and git.hunk("@@ x") is None
    patch = "diff --git a/x b/x\n@@ -1,2 +1,1 @@ f\n--- diff --git\n-@@ -9 +9 @@\n+diff --git a b\n@@ -7,0 +8 @@\n+Binary files\n\\ No newline at end of file\ndiff --git a/b b/b\nBinary files a/b and b/b differ\ndiff --git a/m b/m\nold mode 1\n"
    assert git.patch_hunks(patch) == [(False, [(1, 2, 1, 1), (7, 0, 8, 1)]), (True, []), (False, [])]
    assert git.patch_hunks("") == [] and git.changed_files("") == []
    listing = ":100644 100644 aa bb R090\0old name\0new\tname\0:100644 000000 cc 00 D\0gone\0:100644 120000 dd ee T\0kind"
    got = git.raw_entries(listing)
    assert [(e["status"], e["old_path"], e["new_path"], e["new_oid"], e["parts"]) for e in got] == [("R", "old name", "new\tname", "bb", 1), ("D", "gone", None, None, 1), ("M", "kind", "kind", "ee", 2)]


def test_parsers():
    units = parsers.parse_units("class A:\n    def f(self):\n        return [i for i in x if i or j]\n", "a.py", ".py")
    assert units == [("A::f", "A", 2, 3, 3, 2)]
    java = "class A {\n  // if (x) {\n  int f(int a) {\n    if (a > 0 && a < 9) { return 1; }\n    return 0;\n  }\n  void g() { }\n}\n"
    assert [(u[0], u[1], u[2], u[3], u[4]) for u in parsers.parse_units(java, "A.java", ".java")] == [("A::f", "A", 3, 6, 3), ("A::g", "A", 7, 7, 1)]
    assert parsers.parse_units("def (", "a.py", ".py") == []
    parsers.register("none", lambda text, path: [("u", "", 1, 1, 1, 1)], [".zz"])
    assert parsers.parse_units("", "a.zz", ".zz") == [("u", "", 1, 1, 1, 1)] and parsers.get_parser(".zz")[0] == "none"


def test_ingest_and_reports(spark, repo, tmp_path, monkeypatch):
    out = str(tmp_path / "history")
    monkeypatch.setattr(git, "LOG_PART", 4)
    seen = []
    write = files.write_text
    monkeypatch.setattr(files, "write_text", lambda s, path, text: (seen.append(text) if path.endswith("progress") else None, write(s, path, text)))
    first = {n: sorted(map(str, d.collect())) for n, d in ingest(spark, repo, out, progress_path=str(tmp_path / "progress")).items()}
    assert seen[0] == "0 6\n" and seen[-1] == "6 6\n" and seen.count("6 6\n") == 1 and len(seen) > 5
    diffs = spark.read.parquet(f"{out}/file_diffs.parquet").count()
    monkeypatch.setattr(git, "run_git", lambda r, *a, run=git.run_git, **k: pytest.fail("blamed again") if a[0] == "blame" else run(r, *a, **k))
    again = {n: sorted(map(str, d.collect())) for n, d in ingest(spark, repo, out).items()}
    assert first == again and spark.read.parquet(f"{out}/file_diffs.parquet").count() == diffs
    now = files.history_folder(spark, out)
    read = lambda name: spark.read.parquet(f"{now}/{name}.parquet")
    state = git.snapshot_state(spark, repo, "HEAD", read("file_alias"), spark.read.parquet(f"{out}/blob_cache.parquet"))
    alias = {r.path: r.file_id for r in read("file_alias").collect()}
    sizes = {r.file_id: (r.size, r.wmc) for r in state.collect()}
    assert sizes[alias["side.py"]] == (len("def s():\n    return 0\n"), 1.0) and sizes[alias["a.lua"]][0] == 12
    assert alias["k.py"] == alias["b c.py"] and len(set(alias.values())) == len(alias) - 1
    units = {(r.unit, r.kind): (r.cc, r.dlines, r.cost) for r in read("unit_changes").collect()}
    assert units["K::one", "godclass"] == (3, 4, 12) and units["K::one", "mutation"] == (3, 2, 6)
    log = git.log_rows(repo)
    links = {(r.fix_sha, r.inducing_sha) for r in read("bug_links").collect()}
    assert links == {(log[1][0], log[0][0])}
    merge = read("commits").where("is_merge").first()
    assert merge.files_changed == 1 and merge.impact_composite == 2
    with pytest.raises(ValueError):
        ingest(spark, repo, out, wmc_context="after")
    stats = report.analyze(spark, out, f"{out}-report", repo=repo)
    assert stats["n_files"] > 0 and stats["max_cc"] == 3 and json.loads(Path(f"{out}-report/stats.json").read_text())["name"] == "history"
    assert "## Signals and fixes" in Path(f"{out}-report/report.md").read_text() and "<svg" in Path(f"{out}-report/commits.html").read_text()
    rows = report.summarize(spark, str(tmp_path / "*-report/stats.json"), str(tmp_path))
    assert [(r.repo, r.commits, r.n_inducing, r.max_cc) for r in rows.collect()] == [("history", 6, 1, 3)] and len(rows.columns) == 29
    assert "repositories: 1" in (tmp_path / "summary.md").read_text() and "| history | 6 |" in (tmp_path / "summary.md").read_text()


def test_command_line(spark, repo, tmp_path):
    assert main(["analyze", str(tmp_path / "nothing")]) == 2 and main(["analyze-all", str(tmp_path)]) == 2
    args = arguments().parse_args(["scan", "r", "--fresh", "--max-commits", "3", "--ignore", "a", "--ignore", "b"])
    assert (args.repo, args.fresh, args.max_commits, args.ignore, args.until) == ("r", True, 3, ["a", "b"], "HEAD")
    assert arguments().parse_args(["analyze-all"]).folder and epoch("1970-01-02") == 86_400
    out = str(tmp_path / "h")
    assert main(["scan", repo, "--out", out, "--no-szz"]) == 0 and main(["scan", repo, "--out", out, "--no-szz", "--fresh"]) == 0
    assert main(["analyze", out]) == 0 and (tmp_path / "h-report" / "report.md").exists()


def test_numbers():
    assert [report.human(v) for v in (0, 12.4, 999, 1000, 25_300, 1e6, 4.2e9, 7e12)] == ["0", "12", "999", "1.0k", "25.3k", "1.0M", "4.2G", "7000.0G"]
    assert [report.number(v) for v in (None, float("nan"), 0.12345)] == ["n/a", "n/a", "0.123"]
    assert [report.chosen_ks(n) for n in (0, 5, 9, 30, 60)] == [[], [1], [1], [10, 25], [10, 25, 50]]


def test_config(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("ignore: ['**/x/**']\ntest_patterns_replace: ['t/*']\nrename_jaccard: 0.7\nlang_by_ext: {.zz: zed}\n")
    c = load_config(str(f), ["y"])
    assert c.ignore[-2:] == ["**/x/**", "y"] and c.test_patterns == ["t/*"] and c.rename_jaccard == 0.7 and c.lang_by_ext[".zz"] == "zed" and ".py" in c.lang_by_ext


def test_streams(spark, repo, tmp_path):
    spark.dataSource.register(git.GitLog)
    out = str(tmp_path / "log")
    read = lambda: spark.read.parquet(out) if Path(out).exists() else None
    for n in range(2):
        stream = spark.readStream.format("git_log").option("path", repo).load()
        changes.append_new(stream, out, str(tmp_path / f"state{n}"), ["sha"], read).awaitTermination()
    assert spark.read.parquet(out).count() == 6
    rows = [("2020-01-01 10:00:00", 3, 1), ("2020-01-01 11:00:00", 1, None), ("2020-01-09 00:00:00", 2, 2), ("2020-01-25 00:00:00", 1, 1)]
    spark.createDataFrame(rows, "t string, add_lines int, del_lines int").selectExpr("timestamp(t) ingested_at", "add_lines", "del_lines").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ingested_at timestamp, add_lines int, del_lines int").parquet(str(tmp_path / "in"))
    query = changes.daily_churn(source).writeStream.format("memory").queryName("days").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.day: (r.n_changes, r.churn) for r in spark.sql("select * from days").collect()}
    assert got["2020-01-01"] == (2, 5) and "2020-01-25" not in got
