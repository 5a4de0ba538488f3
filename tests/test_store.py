"""The store: commits, one snapshot a reader, and stops after every step."""

import threading
from pathlib import Path

import pytest

from docloom import storage
from docloom.sources import store as module
from docloom.sources.store import Store
from docloom.streaming import ingest

SCHEMA = "doc_id string, content string"


def shown(df):
    return sorted((str(r.doc_id), r.content) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def test_changes(spark, store):
    assert store.read().collect() == [] and store.versions() == []
    store.add(rows(spark, ("a", "1"), ("b", "2"), (None, "0")))
    store.add(rows(spark, ("a", "1 again")))
    assert shown(store.read()) == [("None", "0"), ("a", "1"), ("a", "1 again"), ("b", "2")]
    store.replace(rows(spark, ("a", "3")))
    store.delete(rows(spark, ("b", None), ("x", None)))
    assert shown(store.read()) == [("None", "0"), ("a", "3")]
    store.add(rows(spark, ("b", "back"), ("a", "more")))
    store.delete(rows(spark, (None, None)))
    last = [("a", "3"), ("a", "more"), ("b", "back")]
    assert shown(store.read()) == last
    assert [len(shown(store.read(v))) for v in store.versions()] == [3, 4, 3, 2, 4, 3]
    assert {(r.doc_id, r.gone__) for r in store.read(marks=True).collect()} >= {(None, True), ("a", False)}
    before = store.read(2)
    store.compact()
    assert shown(store.read()) == last and len(store.snapshot()[1]["folders"]) == 1
    assert len(shown(before)) == 4
    store.replace(rows(spark, ("c", "new")))
    assert store.vacuum(keep=1) and store.versions() == [8]
    assert shown(store.read()) == [*last, ("c", "new")]
    assert store.vacuum(keep=1) == [] and store.compact() == 9


def test_columns_may_come_later(spark, store):
    store.add(rows(spark, ("a", "1")))
    store.add(spark.createDataFrame([("b", 2)], "doc_id string, n int"))
    assert sorted((r.doc_id, r.content, r.n) for r in store.read().collect()) == [("a", "1", None), ("b", None, 2)]
    with pytest.raises(ValueError):
        store.add(spark.createDataFrame([("b", "x")], "doc_id string, n string"))
    store.add(rows(spark, ("a", "1")).limit(0))
    assert store.read().count() == 2


def test_a_batch_counts_once(spark, store):
    for _ in range(3):
        store.replace(rows(spark, ("a", "1")), stream="s", batch=4)
    store.replace(rows(spark, ("a", "other")), stream="s", batch=3)
    store.replace(rows(spark, ("b", "1")), stream="t", batch=0)
    assert store.versions() == [1, 2] and shown(store.read()) == [("a", "1"), ("b", "1")]


def test_writers_at_once_all_count(spark, store):
    """Each commit goes on top of those that came first."""
    frames = [rows(spark, (f"d{k}", str(k))) for k in range(8)]
    failed = []

    def write(k):
        try:
            (store.add if k % 2 else store.replace)(frames[k])
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and store.versions() == list(range(1, 9))
    assert shown(store.read()) == [(f"d{k}", str(k)) for k in range(8)]


def test_a_name_is_given_once(spark, tmp_path):
    for at in (f"{tmp_path}/log/1", f"file:{tmp_path}/log/two words"):
        assert storage.publish(spark, at, "first") and not storage.publish(spark, at, "second")
        assert storage.read_text(spark, at) == "first"
    for k in range(2):
        storage.write_text(spark, f"{tmp_path}/log/x{k}", str(k))
        assert storage.renamed(spark, f"{tmp_path}/log/x{k}", f"{tmp_path}/log/3") == (k == 0)
    assert storage.read_text(spark, f"{tmp_path}/log/3") == "0"
    assert storage.names(spark, f"{tmp_path}/log") == ["1", "3", "two words", "x1"] and storage.names(spark, f"{tmp_path}/none") == []


def test_compaction_keeps_what_comes_meanwhile(spark, store, monkeypatch):
    store.add(rows(spark, ("a", "1"), ("b", "1")))
    store.replace(rows(spark, ("a", "2")))
    write = Store.write

    def and_another(self, *args):
        entry = write(self, *args)
        monkeypatch.setattr(Store, "write", write)
        Store(spark, store.path).delete(rows(spark, ("b", None)))
        return entry

    monkeypatch.setattr(Store, "write", and_another)
    store.compact()
    assert shown(store.read()) == [("a", "2")] and len(store.snapshot()[1]["folders"]) == 2
    folders = store.snapshot()[1]["folders"]

    def and_a_compaction(self, *args):
        entry = write(self, *args)
        monkeypatch.setattr(Store, "write", write)
        Store(spark, store.path).compact()
        return entry

    monkeypatch.setattr(Store, "write", and_a_compaction)
    store.compact()
    assert shown(store.read()) == [("a", "2")] and store.snapshot()[1]["folders"][0] not in folders


class Stop(Exception):
    pass


def stop_at(monkeypatch, step):
    """The step-th call of anything that changes files fails, before or after it is done."""
    calls = [0]

    def wrap(f):
        def run(*args, **kw):
            calls[0] += 1
            if calls[0] == step:
                raise Stop
            out = f(*args, **kw)
            calls[0] += 1
            if calls[0] == step:
                raise Stop
            return out

        return run

    monkeypatch.setattr(Store, "write", wrap(Store.write))
    monkeypatch.setattr(module, "publish", wrap(module.publish))
    monkeypatch.setattr(module, "remove", wrap(module.remove))


@pytest.mark.parametrize("what", ["replace", "delete", "compact"])
def test_a_stop_at_any_step(spark, tmp_path, what):
    """After a stop the store is as before or as after the change; the change can be made again, and nothing is lost."""
    actions = {"replace": lambda s: s.replace(rows(spark, ("a", "3"), ("d", "4")), stream="x", batch=1), "delete": lambda s: s.delete(rows(spark, ("b", None))), "compact": lambda s: (s.compact(), s.vacuum(keep=1, hours=0))}
    step, stopped = 0, True
    while stopped:
        step += 1
        store = Store(spark, str(tmp_path / f"{what}{step}"))
        store.add(rows(spark, ("a", "1"), ("b", "2")))
        store.replace(rows(spark, ("a", "2"), ("c", "3")))
        before = shown(store.read())
        after = {"replace": [("a", "3"), ("b", "2"), ("c", "3"), ("d", "4")], "delete": [("a", "2"), ("c", "3")], "compact": before}[what]
        with pytest.MonkeyPatch.context() as patch:
            stop_at(patch, step)
            try:
                actions[what](store)
                stopped = False
            except Stop:
                pass
        assert shown(Store(spark, store.path).read()) in (before, after)
        actions[what](store)
        assert shown(store.read()) == after
        store.vacuum(keep=1, hours=0)
        assert shown(store.read()) == after
        left = [str(p.relative_to(store.path)) for p in Path(store.path).glob("*/*") if p.is_dir()]
        assert sorted(left) == sorted(f["path"] for f in store.snapshot()[1]["folders"])
    assert step > 4


def test_streams_share_a_store(spark, tmp_path):
    """Two streams and a deletion; a batch that is run again after its commit changes nothing."""
    path = str(tmp_path / "store")
    for name, pairs in (("one", [("a", "x" * 15), ("b", "y")]), ("two", [("b", "z")])):
        rows(spark, *pairs).coalesce(1).write.parquet(str(tmp_path / name))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / name))
        ingest.start(stream, path, str(tmp_path / f"check-{name}"), name=name, size=10, overlap=0).awaitTermination()
        ingest.start(stream, path, str(tmp_path / f"again-{name}"), name=name, size=10, overlap=0).awaitTermination()
    assert shown(ingest.current(spark, path)) == [("a", "x" * 5), ("a", "x" * 10), ("b", "z")]
    Store(spark, path).delete(rows(spark, ("a", None)))
    ingest.compact(spark, path)
    assert shown(ingest.current(spark, path)) == [("b", "z")]
