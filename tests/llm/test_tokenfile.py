import zlib

import numpy as np
import public_tokenizers as P
import pytest

from surgecast.llm import rans, tokenfile

from .common import awkward, frame

SPEC = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 16_385, 65_536, 65_537, 140_000])
def test_coder_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.2, n), 49_407).astype(np.uint32)
    coder = rans.Coder(rans.normalise(np.bincount(ids, minlength=49_408)))
    packed = coder.pack(ids)
    assert (coder.unpack(packed) == ids).all()
    if n > 60_000:
        counts = np.bincount(ids)
        counts = counts[counts > 0]
        assert len(packed) < 1.1 * (counts * np.log2(n / counts)).sum() / 8


def test_checksums_and_unknown_ids():
    ids = np.arange(1000, dtype=np.uint32) % 7
    coder = rans.Coder(rans.normalise(np.bincount(ids)))
    packed = bytearray(coder.pack(ids))
    packed[len(packed) // 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        coder.unpack(bytes(packed))
    with pytest.raises(ValueError, match="frequency table"):
        rans.Coder(rans.normalise(np.array([5, 0, 5]))).pack(np.array([1], np.uint32))


def test_normalise_keeps_rare_ids():
    f = rans.normalise(np.array([10**12, 1, 0, 1, 3]))
    assert f.sum() == 1 << rans.SCALE and (f[[0, 1, 3, 4]] > 0).all() and f[2] == 0
    assert rans.normalise(np.zeros(4, np.int64)).sum() == 1 << rans.SCALE


def test_files_as_the_library(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfile, "ROW_IDS", 2_000)
    rows = [(i, t) for i, t in awkward() if i not in (7, None)]
    made = tokenfile.encoded(frame(spark, rows, ["part", "seq", "start"]), SPEC, end_id=1)
    path = tokenfile.write(made, str(tmp_path / "t"), 49_408)
    got = {}
    for r in tokenfile.read(spark, path).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, zlib.crc32(r.ids)))
    library, place = Tokenizer.from_str(SPEC), 0
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert (place, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) in got[i]
        place += len(ids)
    assert sum(map(len, got.values())) == len(rows)


def test_null_ids_come_first_and_empty_tables_work(spark, tmp_path):
    made = tokenfile.encoded(frame(spark, [(2, "b"), (None, None), (1, None)]), SPEC, end_id=1)
    rows = tokenfile.read(spark, tokenfile.write(made, str(tmp_path / "a"), 49_408)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2] and [r.n_tokens for r in rows] == [1, 1, 2]
    none = tokenfile.encoded(frame(spark, [(1, "a")]).limit(0), SPEC, end_id=1)
    assert tokenfile.read(spark, tokenfile.write(none, str(tmp_path / "b"), 49_408)).count() == 0
