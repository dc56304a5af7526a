"""The folder's changes as a stream: against plain differences, across restarts, into an index."""

import os
import random

from quillmesh.sources import feed
from quillmesh.sources.store import Store


def _write(root, path, text, at):
    os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
    with open(f"{root}/{path}", "w") as f:
        f.write(text)
    os.utime(f"{root}/{path}", (at, at))


def _seen(root):
    found = {}
    for base, _, names in os.walk(root):
        for n in names:
            p = os.path.relpath(f"{base}/{n}", root)
            if p.endswith((".py", ".ts")) and not p.startswith(("node_modules/", "a/dist/")):
                found[p] = (os.path.getsize(f"{root}/{p}"), int(os.path.getmtime(f"{root}/{p}")))
    return found


def _drain(spark, root, tmp, **options):
    """One query from the checkpoint on, ended after one look; its rows."""
    rows = []
    stream = feed.changes_stream(spark, str(root), f"{tmp}/looks", parts=4, **options)
    q = stream.writeStream.foreachBatch(lambda df, n: rows.extend(df.collect())).option("checkpointLocation", f"{tmp}/query").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return {x["file_path"]: (x["change"], x["file_size"]) for x in rows}, len(rows)


def test_stream_equals_differences(spark, tmp_path):
    """Random edits between queries that are started anew each time; excluded folders and other files tell nothing."""
    r, root, before = random.Random(3), tmp_path / "in", {}
    for step in range(4):
        for _ in range(12 if step else 25):
            path = r.choice(["", "a/", "a/b/", "node_modules/x/", "a/dist/"]) + f"f{r.randrange(12)}" + r.choice([".py", ".ts", ".txt", "+ é.py"])
            if r.random() < 0.4 and os.path.exists(root / path):
                os.remove(root / path)
            else:
                _write(root, path, "x" * r.randrange(9), 1_700_000_000 + 100 * step + r.randrange(3))
        now = _seen(root)
        want = {p: ("added" if p not in before else "changed", s[0]) for p, s in now.items() if before.get(p) != s} | {p: ("removed", s[0]) for p, s in before.items() if p not in now}
        got, n = _drain(spark, root, tmp_path, initial=True)
        assert got == want and n == len(want), step
        before = now
    assert _drain(spark, root, tmp_path, initial=True) == ({}, 0)
    assert len(os.listdir(tmp_path / "looks")) <= 2  # old looks go


def test_first_look_tells_nothing_unless_asked(spark, tmp_path):
    _write(tmp_path / "in", "a.py", "x", 1_700_000_000)
    assert _drain(spark, tmp_path / "in", tmp_path) == ({}, 0)
    _write(tmp_path / "in", "b.py", "xy", 1_700_000_000)
    assert _drain(spark, tmp_path / "in", tmp_path)[0] == {"b.py": ("added", 2)}


def test_restless_files_wait(tmp_path):
    """A burst is told when it has ended, a removal at once."""
    root, kept, globs = str(tmp_path / "in"), feed.Snapshots(str(tmp_path / "looks")), feed.Globs((), ())
    look = lambda settle: kept.take(feed.walk(root, globs), 3, settle)
    files = lambda n: {p: s for b in range(3) for p, (s, _) in kept.part(n, b).items()}
    _write(root, "a.py", "x", 1_700_000_000)
    _write(root, "b.py", "x", 1_700_000_000)
    assert look(10**9) == 1 and files(1) == {"a.py": 1, "b.py": 1}
    with open(f"{root}/a.py", "w") as f:
        f.write("longer")
    with open(f"{root}/new.py", "w") as f:
        f.write("new")
    os.remove(f"{root}/b.py")
    assert look(10**9) == 2 and files(2) == {"a.py": 1}
    assert look(10**9) == 2
    assert look(0) == 3 and files(3) == {"a.py": 6, "new.py": 3}
    assert look(0) == 3 and kept.numbers() == [1, 2, 3]


def test_an_empty_or_missing_folder(spark, tmp_path):
    assert _drain(spark, tmp_path / "none", tmp_path, initial=True) == ({}, 0)


def test_index_follows(spark, tmp_path):
    """A query indexes what there is; one started later from the same checkpoint only what has changed, and forgets what is gone."""
    root, store, reports = tmp_path / "in", Store(spark, str(tmp_path / "s")), []
    for i in range(4):
        _write(root, f"m{i}.py", f"def f{i}():\n    return {i}\n", 1_700_000_000)
    go = lambda: store.watching(str(root), str(tmp_path / "c"), settle_seconds=0, chains=True, told=reports.append).awaitTermination(180)
    assert go() and reports == [{"indexed": 4, "removed": 0, "failed": 0}]
    _write(root, "m1.py", "def other():\n    return f2()\n", 1_700_000_100)
    os.remove(root / "m3.py")
    assert go() and reports[1:] == [{"indexed": 1, "removed": 1, "failed": 0}]
    assert {x["name"] for x in store.read("symbols").filter("kind = 'function'").collect()} == {"f0", "other", "f2"}
    assert store.update_factors() == 0 and store.read("chain_counts").first()[0] == 3
