"""op1 and op2: round trips, damage, every odd case."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lensmap.llm import token_ids, warc
from lensmap.llm.token_ids import EliasFano, pack_block, read_blocks

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

PAGES = "page_id long, url string, html string, payload string, digest int, d string"


def pages():
    big, x = "<p>" + "ab" * 300 + "</p>", (None, 1, "z")
    return [r + x for r in [(5, "http://a/ü\n", big), (3, None, big), (9, "u", big), (9, "u", big), (1, "u", "short"), (2, "u", "short"),
                            (4, "u", None), (6, "u", ""), (None, "u", big), (None, "u", "WARC/1.1\r\nWARC-Type: x" * 9),
                            (7, "u", "é" * 5_000), (8, "u", "x" * 99), (10, "u", "x" * 99), (11, "u", "y" * 100), (12, "u", "y" * 100),
                            (13, "u", "long " * 400_000)]]


def read_back(spark, path):
    return warc.read_warc(spark, path).filter("kind = 'record'").select(
        warc.page_of(warc.F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of(warc.F.col("refers_to")).alias("refers_to")).collect()


def test_warc_round_trip(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame(pages(), PAGES).repartition(3), path)
    raw = [((r[2] or "").encode(), r[0]) for r in pages()]
    first = {}
    for b, i in raw:
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    want = Counter()
    for b, i in raw:
        later = b in first and first[b] != i
        want[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if later else "response", first[b] if later else None] += 1
    assert Counter(map(tuple, read_back(spark, path))) == want


def test_warc_empty(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame([], PAGES), path)
    assert read_back(spark, path) == []


def record(i, body=b"hello"):
    return warc.record_bytes(i, f"http://x/{i}", body, hashlib.sha256(body).hexdigest(), None, len(body))


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_after_damage(packed):
    rng = random.Random(2)
    units = [record(i, bytes(rng.randrange(256) for _ in range(50 + 40 * i))) for i in range(12)]
    units = [warc.member(u) if packed else u for u in units]
    whole = b"".join(units)
    assert sum(k == "record" for k, *_ in warc.salvage(whole)) == 12
    for _ in range(60):
        data = bytearray(whole)
        hit = rng.randrange(len(data))
        kind = rng.randrange(3)
        if kind == 0:
            data[hit] ^= 1 + rng.randrange(255)
        elif kind == 1:
            del data[hit:hit + rng.randrange(1, 30)]
        else:
            data[hit:hit] = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 30)))
        found = list(warc.salvage(bytes(data)))
        good = [x["record_id"] for k, _, _, x in found if k == "record"]
        assert len(good) >= 11 - (kind == 1)  # at most the damaged one (a cut may touch two) is lost
        at = 0  # records and gaps tile the file
        for k, lo, hi, x in found:
            if "in the member" not in str(x):
                assert lo == at and hi > lo
                at = hi
        assert at == len(data)


def test_salvage_odd_files():
    assert list(warc.salvage(b"")) == []
    assert [(k, lo, hi) for k, lo, hi, _ in warc.salvage(b"junk")] == [("gap", 0, 4)]
    mixed = b"noise" + record(1) + warc.member(record(2)) + warc.EMPTY_MEMBER + record(3)[:-9]
    assert [(k, x["record_id"] if k == "record" else None) for k, _, _, x in warc.salvage(mixed)] == [
        ("gap", None), ("record", "<urn:page:1>"), ("record", "<urn:page:2>"), ("gap", None)]
    inner = warc.member(b"broken" + record(4))
    got = list(warc.salvage(inner))
    assert [k for k, *_ in got] == ["gap", "record"]


def test_salvage_keeps_what_inflates_before_the_damage():
    """Several records in one member, cut off or broken near its end; the next member is whole."""
    rng = random.Random(8)
    rows = [warc.record_bytes(i, f"http://x/{i}", b, hashlib.sha256(b).hexdigest(), None, len(b))
            for i, b in enumerate(rng.randbytes(3_000) for _ in range(6))]
    one, after = warc.member(b"".join(rows)), warc.member(record(9))
    want = [x["record_id"] for r in rows[:5] for k, _, _, x in warc.salvage(r)]
    ids = lambda got: [x["record_id"] for k, _, _, x in got if k == "record"]
    cut = one[:-1_500]
    assert ids(warc.salvage(cut)) == want
    assert [(k, hi) for k, _, hi, _ in warc.salvage(cut)][-1] == ("gap", len(cut))
    broken = bytearray(one)
    broken[-1_500:-1_400] = b"\xff" * 100
    got = list(warc.salvage(bytes(broken) + after))
    assert ids(got)[:5] == want and len(ids(got)) == 6
    (gap,) = [(lo, hi) for k, lo, hi, _ in got if k == "gap"]
    assert gap[1] == len(one) and gap[0] > 10_000
    got = list(warc.salvage(cut + after))
    assert ids(got)[:5] == want and len(ids(got)) == 6
    plain = warc.member(b"".join(r.replace(b"WARC-Block-Digest", b"X-Digest") for r in rows))
    broken = plain[:-8] + b"\0" * 8  # nothing vouches for these records
    assert ids(warc.salvage(broken)) == []


@given(st.lists(st.integers(0, 5000), max_size=300), st.integers(0, 4))
@settings(max_examples=60, deadline=None)
def test_elias_fano(gaps, scale):
    v = np.cumsum(np.array(gaps, dtype=np.int64) * 10 ** scale) if gaps else np.zeros(0, np.int64)
    u = int(v[-1]) if len(v) else 0
    e, end = EliasFano.read(memoryview(EliasFano.of(v, u).to_bytes() + b"rest"), 0)
    assert e.all().tolist() == v.tolist() == [e.get(i) for i in range(len(v))]
    if len(v) > 50:  # near the information bound: 2 + log2(u / n) bits a value, and the samples
        assert (len(e.low) + len(e.high)) * 8 <= len(v) * (3 + max(0, np.log2(max(u, 1) / len(v)))) + 24


def test_block_access():
    ids = [np.arange(n, dtype=np.uint32) + n for n in (3, 0, 1, 700, 2)]
    (b,) = read_blocks(pack_block([None, -5, -5, 10, 2 ** 40], ids, 4) + b"\n")
    assert [b.doc_id(i) for i in range(5)] == [None, -5, -5, 10, 2 ** 40]
    assert [b.ids(i).tolist() for i in range(5)] == [x.tolist() for x in ids]


def want_ids(rows):
    tk = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    at, out = 0, []
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    for r in sorted(rows, key=key):
        ids = tk.encode(r[1] or "", add_special_tokens=False).ids + [2]
        out.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files(odd, odd_rows):
    rows = [r[:2] for r in odd_rows] + [(500, "it's we'll 'tis <|endoftext|> x"), (501, "tabs\t\tand  spaces \n\n end ")]
    more = odd.select("doc_id", "text", "key").unionByName(odd.sparkSession.createDataFrame(
        [(*r, 0) for r in rows[-2:]], "doc_id long, text string, key int"))
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_ids.token_files(more).collect()]
    assert sorted(got, key=lambda r: r[1]) == want_ids(rows)


def test_token_files_empty(none):
    assert token_ids.token_files(none).collect() == []


@given(st.lists(st.text(alphabet="ab 's't'll're\n\t19.,é-€ÿ ", max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_piece_encoder(texts):
    from lensmap.llm.bpe import PieceEncoder
    if not hasattr(test_piece_encoder, "e"):
        test_piece_encoder.e = PieceEncoder(public.path("byte_bpe_50k.json"))
    e = test_piece_encoder.e
    assert [x.tolist() for x in e.encode(texts)] == [e.tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_reading_time_grows_with_the_file():
    """Members cost what they hold, wherever they stand in the file."""
    import gzip
    import time
    block = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3000\r\n\r\n" + bytes(range(97, 122)) * 120 + b"\r\n\r\n"
    member = gzip.compress(block)

    def seconds(n):
        data, best = member * n, 1e9
        for _ in range(2):
            t = time.process_time()
            assert sum(1 for x in warc.salvage(data)) == n
            best = min(best, time.process_time() - t)
        return best
    filler = 16_000_000 // len(member)
    assert seconds(filler) < 6 * seconds(filler // 4)


def test_scans_drop_what_token_files_keep():
    """A worker that has encoded texts does not keep its tokenizer while it hashes shingles or pairs."""
    import pyarrow as pa
    from lensmap.llm import jaccard_join, textscan, token_ids
    batch = pa.RecordBatch.from_arrays([pa.array(["a b c d"])], names=["text"])
    for scan in (jaccard_join._prefixes(5, 80, 100, np.zeros(0, np.uint64)), jaccard_join._sets(5, 80, 100)):
        before = token_ids._encoder(None)
        assert any(x is before for x in textscan.process_cache().values())
        list(scan(iter([batch])))
        assert not any(x is before for x in textscan.process_cache().values())
