import hashlib
import io
import random
import wave
import zlib

import numpy as np

from quillmesh.llm import media
from quillmesh.llm.queries import op8_media


def test_round_trip_and_features():
    r = random.Random(1)
    texts = ["", "a", "x" * 63, "y" * 64, "z" * 65, "é\n" * 500, "".join(chr(r.randint(32, 900)) for _ in range(20_000))]
    for t in texts:
        s = media.store(t)
        data = t.encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        with wave.open(io.BytesIO(s["media"])) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, payload)
        assert s["payload_bytes"] == len(payload) and s["payload_sha256"] == hashlib.sha256(payload).hexdigest() and s["tail_crc32"] == zlib.crc32(payload[-64:])
        assert np.array_equal(media.store(t)["codes"], s["codes"])


def test_peaks_do_not_depend_on_the_block(monkeypatch):
    r = np.random.default_rng(0)
    x = r.integers(0, 256, 9000).astype(np.uint8)
    whole = media.peaks(x)
    monkeypatch.setattr(media, "FRAMES_AT_ONCE", 7)
    assert all(np.array_equal(a, b) for a, b in zip(whole, media.peaks(x), strict=True))


def test_a_tone_has_its_peak():
    x = (128 + 100 * np.sin(2 * np.pi * 20 * np.arange(4096) / media.FRAME)).astype(np.uint8)
    assert np.bincount(media.peaks(x)[1]).argmax() == 20


def test_pairs_against_loops():
    r = np.random.default_rng(2)
    t = np.sort(r.integers(0, 30, 60))
    f = r.integers(1, 128, 60)
    code, time = media.pair_codes(t, f)
    want = []
    for i in range(60):
        later = [j for j in range(60) if t[j] > t[i]][: media.FAN]
        want += [(t[i], (f[i] << 16) | (f[j] << 8) | (t[j] - t[i])) for j in later if t[j] - t[i] <= media.REACH]
    assert sorted(zip(time.tolist(), code.tolist(), strict=True)) == sorted(want)


def test_query(spark, tmp_path):
    rows = [(1, "same", 1), (2, "same", 2), (None, None, 3), (4, "", 3), (5, "long " * 30_000, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, media int").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r.asDict() for r in op8_media(spark, str(tmp_path)).collect()}
    assert len(got) == 5 and {**got[1], "doc_id": 2} == got[2] and {**got[None], "doc_id": 4} == got[4]
    assert got[4]["payload_bytes"] == 64 and got[5]["n_bytes"] == 150_000
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert media.media_columns(spark, empty).count() == 0


def test_digests_are_those_of_the_columns(spark):
    docs = spark.createDataFrame([(1, "some text, " * 400, 1), (None, None, 2), (3, "", 3)], "doc_id long, text string, n_bytes int")
    key = lambda r: str(r["doc_id"])
    whole, short = (sorted(f(spark, docs).collect(), key=key) for f in (media.media_columns, media.digests))
    for a, b in zip(whole, short, strict=True):
        assert all(a[c] == b[c] for c in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "n_peaks"))
        assert (len(a["media"]), hashlib.sha256(a["media"]).hexdigest()) == (b["media_bytes"], b["media_sha256"])
        assert (len(a["codes"]), hashlib.sha256(np.array(a["codes"], "<i8").tobytes()).hexdigest()) == (b["n_codes"], b["codes_sha256"])
