"""The search command, the encoder behind it, and pictures by their headers."""

import struct
import zlib

import numpy as np
import pytest

from framewright import cli
from framewright.operators.encoder import encode_texts, fit_encoder, query_vector
from framewright.sources.artifacts import picture_size, read_pictures
from tests.oracle import DATA

tables = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@tables
@pytest.mark.parametrize("flags, column", [(["--captions"], "frames"), (["--captions", "--no-group"], "filename"), (["--semantic"], "score"), (["--visual"], "score"), (["--fused"], "score"), (["--fuzzy"], "faces")])
def test_search_command(spark, flags, column):
    lines = cli.main(["platform", "--folder", str(DATA), "--top-k", "7", *flags]).split("\n")
    assert column in lines[0] and "faces" in lines[0] and 2 <= len(lines) <= 9
    if flags[0] != "--fuzzy":
        assert len(lines) > 2


@tables
def test_html(spark):
    out = cli.main(["platform", "--folder", str(DATA), "--captions", "--html"])
    assert out.startswith("<table>") and out.endswith("</table>") and "<th>snippet</th>" in out


def test_encoder_places_words_by_their_company(spark):
    texts = [(i, f"the {a} {b} near {c}") for i, (a, b, c) in enumerate([("red", "train", "station"), ("red", "tram", "station"), ("blue", "tram", "station"), ("blue", "train", "station"), ("big", "dog", "garden"), ("big", "cat", "garden"), ("old", "cat", "garden"), ("old", "dog", "garden")] * 5)]
    df = spark.createDataFrame([*texts, (90, None), (91, ""), (92, "zzz")], "id int, t string")
    e = fit_encoder(df, "t", dim=6)
    v = {r.id: np.array(r.vector) for r in encode_texts(df, "id", "t", e).collect()}
    assert 90 not in v and 91 not in v and abs(np.linalg.norm(v[0]) - 1) < 1e-9
    q = np.array(query_vector(e, "tram"))
    assert min(v[i] @ q for i in range(4)) > max(v[i] @ q for i in range(4, 8)) and query_vector(e, "unheard") == []
    assert encode_texts(df, "id", "t", fit_encoder(df.where("1 = 0"), "t")).count() == 0


def _png(w, h):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (w + 1) * h)) + chunk(b"IEND", b"")


def _jpeg(w, h):
    return b"\xff\xd8\xff\xe0\x00\x10JFIF\0\x01\x01\0\0\x01\0\x01\0\0\xff\xc0\x00\x11\x08" + struct.pack(">HH", h, w) + b"\x03\x01\x22\x00\x02\x11\x01\x03\x11\x01\xff\xd9"


def test_pictures(spark, tmp_path):
    files = {"a.png": _png(7, 5), "b.jpg": _jpeg(640, 360), "c.jpg": _jpeg(10, 10)[:-6], "d.png": b"", "e.png": _png(9, 9)[:-9], "f.gif": b"GIF89a\x04\x00\x03\x00\x00\x00\x00;"}
    for n, b in files.items():
        (tmp_path / n).write_bytes(b)
    assert {n: picture_size(b) for n, b in files.items()} == {"a.png": (7, 5), "b.jpg": (640, 360), "c.jpg": None, "d.png": None, "e.png": None, "f.gif": (4, 3)} and picture_size(None) is None
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in read_pictures(spark, str(tmp_path)).collect()}
    assert got == {"a.png": (7, 5), "b.jpg": (640, 360), "f.gif": (4, 3)}
    blank = {r.path.rsplit("/", 1)[1]: r.content for r in read_pictures(spark, str(tmp_path), unreadable="blank").collect()}
    assert len(blank) == 5 and blank["c.jpg"] is None  # Spark does not list files of no bytes
