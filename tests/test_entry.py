import importlib

import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "rank", "parent_id", "chunk_idx", "score"]
    assert df.count() > 0


def test_without_the_llm_subpackage(monkeypatch):
    found = importlib.util.find_spec

    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("docloom.llm", "corpus_pipeline") else found(name, *a))
    bare = importlib.reload(entry)
    assert not bare.HAS_LLM
    assert bare.queries() and set(bare.oracle_sql()) <= set(bare.queries())
    monkeypatch.undo()
    importlib.reload(entry)
