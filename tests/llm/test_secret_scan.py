"""Secret scan: patterns, layers, positions and edge cases."""

import base64
import bz2
import gzip
import hashlib
import lzma
import re
import urllib.parse
import zlib

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from harborline.llm import secret_scan as s

SECRET = "password=hunter2hunter2"


def brute_base(text):
    """The patterns as the contract words them, failing matches dropped afterwards."""
    assign = re.compile(
        "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
        "|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    )
    found = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda x: (x[1], s.KINDS.index(x[0])))


parts = st.sampled_from(
    ["password", "PassWd", "secret", "toKen", "api_key", "APIKEY", " ", "=", ":", '"', "'", "AKIA", "ABCDEFGH01234567", "abcdef", "0123456789ab", "é", "ſ", "/", "-", "x"]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(parts, max_size=14).map("".join))
def test_base_is_the_contract(text):
    assert s.base_spans(text) == brute_base(text)


def enc64(x):
    return base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()


WRAPS = {
    "percent": urllib.parse.quote,
    "every byte": lambda x: "".join(f"%{b:02X}" for b in x.encode()),
    "unicode": lambda x: "".join(f"\\u{ord(c):04x}" for c in x),
    "entity": lambda x: "".join(f"&#{ord(c)};" for c in x),
    "base64": enc64,
    "url-safe": lambda x: base64.urlsafe_b64encode(x.encode()).decode().rstrip("="),
    "gzip": lambda x: enc64(gzip.compress(x.encode())),
    "zlib": lambda x: enc64(zlib.compress(x.encode())),
    "twice packed": lambda x: enc64(gzip.compress(zlib.compress(x.encode()))),
}


@pytest.mark.parametrize("outer", WRAPS)
@pytest.mark.parametrize("inner", WRAPS)
def test_layers_lead_back_to_their_place(inner, outer):
    wrapped = WRAPS[outer](WRAPS[inner](SECRET))
    text = f"é und {wrapped} rest"
    spans = [x for x in s.all_spans(text) if x[0] == "assign"]
    assert spans
    assert all(6 <= start < end <= 6 + len(wrapped) for _, start, end in spans)
    assert SECRET[-8:] not in s.redact(text, s.all_spans(text))


def test_positions_in_base64_and_escapes_are_exact():
    plain = "héllo token=abcdefgh12 tail"
    at = plain.index("token")
    text = "".join(f"%{b:02x}" for b in plain.encode())
    begin = 3 * len(plain[:at].encode())
    assert ("assign", begin, begin + 3 * len("token=abcdefgh12")) in s.all_spans(text)
    coded = enc64(plain)
    (span,) = [x for x in s.all_spans("x " + coded) if x[0] == "assign"]
    assert span[1] - 2 == len(plain[:at].encode()) * 8 // 6 and span[2] <= 2 + len(coded)


def test_base_spans_stay_and_no_layer_is_no_span():
    text = 'token = "04dbebab91ab85687d33eeaa" and plain%20words tiontiontiontiontion'
    assert set(s.base_spans(text)) <= set(s.all_spans(text))
    assert s.all_spans("only plain words, 100% tiontiontiontiontion \\u00 &#; %zz") == []
    assert s.all_spans("") == []


def test_a_packed_text_far_larger_than_a_window():
    text = enc64(zlib.compress(b"a " * (5 << 20) + SECRET.encode() + b" b" * 100))
    assert [x for x in s.all_spans(text) if x[0] == "assign"] == [("assign", 0, len(text))]


def test_layers_that_repeat_end():
    assert s.all_spans("%25" * 200 + "41") == []
    nested = SECRET
    for _ in range(12):
        nested = enc64(nested)
    assert len(s.all_spans(nested)) == 1


def test_dataframe(spark):
    rows = [(1, SECRET, 0), (2, None, 0), (None, "", 0), (3, "x " + enc64(SECRET), 0), (3, "x " + enc64(SECRET), 0), (4, "w " * 200_000 + SECRET, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, base int")
    out = s.scan_secrets(df).collect()
    assert sorted((r.doc_id or 0, len(r.base), len(r.found)) for r in out) == [(0, 0, 0), (1, 1, 1), (2, 0, 0), (3, 0, 1), (3, 0, 1), (4, 1, 1)]
    assert s.scan_secrets(df.limit(0)).collect() == []
    docs = df.selectExpr("doc_id", "text", "0L as n_chars")
    masked = s.redact_secrets(docs).where("doc_id = 4").first()
    assert masked.text.endswith(s.REDACTED) and masked.n_chars == len(masked.text)


def test_query_on_the_table(spark, sf_small):
    from harborline.llm import queries as q

    rows = q.op1_secret_scan(spark, sf_small).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_base(texts[r.doc_id] or "")
        digest = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(digest.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w[0] == k for w in want) for k in s.KINDS)


KEY = "AKIA" + "ABCDEFGH01234567"


def kinds(text):
    return {k for k, _, _ in s.all_spans(text)}


@pytest.mark.parametrize("plain", [f"x {KEY} and more", "x^2 token=abcdefgh and", "x} token=abcdefgh", "BZh token=abcdefgh 1", "BZh91AY token=abcdefgh"])
def test_layers_that_only_look_packed(plain):
    text = "see " + enc64(plain)
    (span,) = s.all_spans(text)
    inner = s.base_spans(plain)[0]
    assert span[0] == inner[0] and span[1] == 4 + inner[1] * 8 // 6
    assert s.all_spans(enc64(gzip.compress(plain.encode())))


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, lambda x: zstandard.ZstdCompressor().compress(x)])
def test_every_member_and_what_follows(pack):
    three = pack(b"nothing") + pack(f"{KEY} second".encode()) + b" token=abcdefgh tail"
    assert kinds(enc64(three)) == {"access", "assign"}
    assert kinds(enc64(pack(pack(b"one ") + pack(KEY.encode() + b" ")))) == {"access"}


def test_packed_data_that_break_off():
    whole = gzip.compress(("w " * 400 + KEY + " " + " ".join(map(str, range(3000)))).encode())
    assert kinds(enc64(whole[: len(whole) // 2])) == {"access"}


def test_bytes_that_are_no_utf8():
    raw = "é token=abcdefgh12 ü".encode("latin-1")
    text = "w " + enc64(raw)
    (span,) = s.all_spans(text)
    assert span == ("assign", 2 + 2 * 8 // 6, 2 + (2 + len("token=abcdefgh12") - 1) * 8 // 6 + 2)
    assert kinds("%E9" + "".join(f"%{b:02x}" for b in b" token=abcdefgh12")) == {"assign"}
    assert kinds(enc64(gzip.compress(raw))) == {"assign"}


def test_packed_data_as_escapes():
    for packed in (gzip.compress(KEY.encode()), zlib.compress(KEY.encode()), bz2.compress(KEY.encode()), lzma.compress(KEY.encode()),
                   zstandard.ZstdCompressor().compress(KEY.encode())):
        for run in ("".join(f"%{b:02x}" for b in packed), urllib.parse.quote(packed), "".join(f"\\x{b:02x}" for b in packed), repr(packed)[2:-1]):
            text = f"data={run};"
            spans = [x for x in s.all_spans(text) if x[0] == "access"]
            assert spans and all(x[1] >= 5 and x[2] <= 5 + len(run) for x in spans), run[:20]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("width", [64, 76, 61])
def test_base64_over_lines(end, width):
    plain = "w " * 40 + f"token=abcdefghijkl {KEY}" + " v" * 90
    coded = enc64(plain)
    text = "begin\n" + end.join(coded[i : i + width] for i in range(0, len(coded), width)) + "\nend ."
    found = s.all_spans(text)
    for kind, start, stop in s.base_spans(plain):
        def at(i):
            return 6 + i + i // width * len(end)
        assert (kind, at(start * 8 // 6), at(((stop - 1) * 8 + 7) // 6) + 1) in found


def test_runs_across_windows(monkeypatch):
    monkeypatch.setattr(s, "WINDOW", 4000)
    monkeypatch.setattr(s, "CHUNK", 700)
    inner = enc64("p " * 9000 + KEY)
    for plain in (
        "a " * 5000 + inner + " b" * 5000, "x" * 30_000 + " " + inner, ("line\n" * 900 + "password  =  abcdefgh1 \n") * 3,
        "\n".join(inner[i : i + 64] for i in range(0, len(inner), 64)),
    ):
        packed = enc64(gzip.compress(plain.encode()))
        assert kinds(packed) == kinds(plain) != set()
        twice = enc64(bz2.compress(gzip.compress(plain.encode())))
        assert kinds(twice) == kinds(plain)


def test_data_that_unpack_without_end_stay_small():
    bomb = zlib.compress(b"a b\n" * (8 << 20) + KEY.encode())
    assert len(bomb) < 200_000 and kinds(enc64(bomb)) == {"access"}
