"""Fill-in-the-middle frames against a plain reference, whatever the frame size."""
import hashlib
import random
import re

import pytest

from storewatch.llm import fim


def reference(doc_id, text, seed=1):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(units), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def some_texts():
    rng = random.Random(4)
    parts = ["a", "Zebra", " ", "\n", "é", "한국", "😀", "<", "<P", "S>", "1", "<<", ">", "wordwordword", " ", "\x00"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 120)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "a<P>b"), (1003, "x" * 500), (1004, "é" * 300), (None, "no id here"), (5, "again five"),
             (5, rows[5][1]), (-7, "negative id, é"), (1005, "<" * 200), (1006, "<S<M<P" * 40)]
    return rows + [(2000 + i, "".join(rng.choice(parts) for _ in range(3000))) for i in range(5)]


@pytest.mark.parametrize("frame_bytes", [4, 7, 64, 1 << 16])
def test_against_reference(spark, docs_of, frame_bytes):
    rows = some_texts()
    made = fim.fill_in_middle(docs_of(rows).withColumnRenamed("lang", "frames"), frame_bytes=frame_bytes)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored)
                 for r in fim.texts(made).collect())
    want = sorted((i if i is not None else -1, *reference(i, t), t or "") for i, t in rows)
    key = lambda r: (r[0], r[-1])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_digests_are_of_outputs_and_texts(spark, docs_of):
    made = fim.fill_in_middle(docs_of(some_texts()), frame_bytes=50)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    both = sorted((sha(r.output), sha(r.restored)) for r in fim.texts(made).collect())
    assert both == sorted((r.output_sha256, r.restored_sha256) for r in fim.digests(made).collect())


def test_joined_frames_are_one_stream(spark, docs_of):
    import io

    import zstandard

    row = fim.fill_in_middle(docs_of([(3, "many words of a text " * 400)]), frame_bytes=512).first()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(b"".join(row.frames)), read_across_frames=True).read()
    assert whole.decode() == reference(3, "many words of a text " * 400)[-1]


def test_cut_frames_only_are_opened():
    text = "".join(f"w{'x' * (i % 7)} " for i in range(2000)).encode()
    import zstandard
    frames, at = [], 0
    units = re.findall(b"[A-Za-z]+|[^A-Za-z]", text)
    for lo in range(0, len(units), 100):
        part = b"".join(units[lo:lo + 100])
        frames.append({"units": lo, "chars": at, "joined": False, "data": zstandard.ZstdCompressor().compress(part)})
        at += len(part)
    one = fim.Frames(frames, len(units))
    a, b = one.cut(150), one.cut(905)
    assert list(one.open) == [1, 9]
    middle = list(one.between(a, b, zstandard.ZstdCompressor().compress))
    assert b"".join(fim.output_chunks(middle)) == b"".join(units[150:905])
    assert middle[1:-1] == [f["data"] for f in frames[2:9]]


def test_empty_table_and_damaged_output(spark, docs_of):
    assert fim.digests(fim.fill_in_middle(docs_of([]))).count() == 0
    with pytest.raises(ValueError):
        list(fim.restored_chunks([], "psm"))
