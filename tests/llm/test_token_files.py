import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pytest

from docloom.llm import token_files as K
from docloom.llm.queries import tokenizer_path

PIECES = ["a", "the", "é", " ", " ", " ", "\n", "\t", "<|endoftext|>", "x1", ",", ".", "'s", "😀", "\r", "  ", "\xa0", "\x85", "\x1c", "日本", "word word"]


def texts(n, seed=1, most=40):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, most))) for _ in range(n)]


def test_encoder_is_the_tokenizer():
    own, all_texts = K.Encoder(tokenizer_path(), remember=40), texts(4000)
    for at in range(0, len(all_texts), 100):
        part = all_texts[at : at + 100]
        assert [x.tolist() for x in own.encode(pa.array(part))] == [x.tolist() for x in own.direct(part)]


def ids_of(text):
    return np.append(K.encoder(tokenizer_path()).direct([text or ""])[0], 2).astype("<u4")


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    rows = [(k * 7 % 5003, t) for k, t in enumerate(texts(700, 2))] + [(None, "null id"), (None, None), (3, "long " * 200_000), (4, ""), (4, ""), (9, None)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, path string")
    to = str(tmp_path_factory.mktemp("tokens"))
    return rows, K.write(docs, tokenizer_path(), to=to, frame_ids=1000)


def test_read_back(written):
    rows, files = written
    got = sorted(K.read(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = sorted((str(i), len(ids_of(t)), zlib.crc32(ids_of(t).tobytes())) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want


def test_single_documents(written):
    rows, files = written
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, []).append(ids_of(t).tolist())
    for f in files.collect():
        reader = K.Reader(f.path)
        for i in set(reader.index[0].tolist()) - {K.NULL_ID}:
            assert sorted(x.tolist() for x in reader.document(i)) == sorted(by_id[i])
        assert reader.document(-77) == []


def test_only_asked_frames_are_read(written, monkeypatch):
    _, files = written
    reader, seen = max((K.Reader(f.path) for f in files.collect()), key=lambda r: len(r.sizes)), []
    assert len(reader.sizes) > 1 and reader.index[1, 0] == 0
    monkeypatch.setattr(reader, "read_frame", lambda k, real=reader.read_frame: seen.append(k) or real(k))
    reader.ids(0)
    assert seen == [0]


def test_damage_is_found(written, tmp_path):
    _, files = written
    data = bytearray(open(files.first().path, "rb").read())
    data[len(data) - 9 - 4] ^= 1  # the last frame's checksum in the seek table
    (tmp_path / "x.tok").write_bytes(bytes(data))
    bad = K.Reader(str(tmp_path / "x.tok"))
    with pytest.raises(ValueError, match="damaged"):
        bad.ids(bad.index.shape[1] - 1)
    (tmp_path / "y.tok").write_bytes(bytes(data[:-1]))
    with pytest.raises(ValueError):
        K.Reader(str(tmp_path / "y.tok"))


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert K.read(K.write(empty, tokenizer_path())).count() == 0


def test_other_tokenizers_get_whole_texts():
    """Only the kind whose ids follow from stretches is taken apart; ids are those of the tokenizer for any."""
    import json

    own = K.Encoder(tokenizer_path())
    assert own.stitched
    described = json.loads(own.tokenizer.to_str())
    changes = [("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("pre_tokenizer", None), ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}), ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False})]
    for name, value in changes:
        assert not K.stitches(json.dumps(described | {name: value}))
    words = K.Encoder(tokenizer_path("word_bpe_49k.json"))
    sample = texts(300, 4)
    assert not words.stitched and [x.tolist() for x in words.encode(pa.array(sample))] == [words.tokenizer.encode(t, add_special_tokens=False).ids for t in sample]


def test_a_name_that_is_taken(tmp_path):
    """A file system that doesn't replace files: the first complete file stays, the draft goes."""
    (tmp_path / "part.tok").write_bytes(b"first")
    (tmp_path / "part.tok.7.draft").write_bytes(b"first")

    class Refuses:
        def move(self, a, b):
            raise OSError("there is one")

        def get_file_info(self, path):
            return pa.fs.LocalFileSystem().get_file_info(path)

        def delete_file(self, path):
            pa.fs.LocalFileSystem().delete_file(path)

    K.settle(Refuses(), str(tmp_path / "part.tok.7.draft"), str(tmp_path / "part.tok"))
    assert [p.name for p in tmp_path.iterdir()] == ["part.tok"]
    with pytest.raises(OSError):
        K.settle(Refuses(), str(tmp_path / "gone.draft"), str(tmp_path / "gone.tok"))
    (tmp_path / "lost.tok.9.draft").write_bytes(b"half")
    K.clear_drafts(str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["part.tok"]
