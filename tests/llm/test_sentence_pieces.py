import random

import pyarrow as pa
import pytest

from paddock.llm.sentence_pieces import BPE_PIECES, Encoded, PieceModel, decode, encode, load, word_nbest

MODEL = PieceModel()


def varint(data, i):
    value = shift = 0
    while True:
        value |= (data[i] & 127) << shift
        i, shift = i + 1, shift + 7
        if data[i - 1] < 128:
            return value, i


def fields(data):
    """(number, whole field, body) of a serialised message."""
    i = 0
    while i < len(data):
        tag, j = varint(data, i)
        if tag & 7 == 2:
            n, j = varint(data, j)
            end = j + n
        elif tag & 7 == 0:
            end = varint(data, j)[1]
        else:
            end = j + (4 if tag & 7 == 5 else 8)
        yield tag >> 3, data[i:end], data[j:end]
        i = end


def length(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


@pytest.fixture(scope="module")
def oracle():
    """The library's own lattice: the same pieces and scores, with the model kind set to unigram."""
    import sentencepiece
    with open(MODEL.path, "rb") as f:
        data = f.read()
    out = b""
    for number, whole, body in fields(data):
        if number == 2:
            spec = b"".join(b"\x18\x01" if n == 3 else w for n, w, _ in fields(body))
            whole = b"\x12" + length(len(spec)) + spec
        out += whole
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def texts():
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzéßñ "
    return ["Hello world", "  two  spaces ", "a", "日本語 テキスト", "emoji \U0001F600!", "tab\tnew\nline", "ab" * 600,
            "The quick brown fox"] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 120))) for _ in range(60)]


def score(oracle, ids):
    return sum(oracle.get_score(int(i)) for i in ids if not oracle.is_byte(int(i)))


def test_best_segmentation_against_the_library(oracle):
    given = texts()
    e = Encoded(pa.array(given), MODEL)
    at = 0
    for i, text in enumerate(given):
        ids = e.ids[at:at + e.count[i]].tolist()
        at += e.count[i]
        want = oracle.encode(text)
        assert ids == want or score(oracle, ids) == pytest.approx(score(oracle, want), abs=0.5)


def test_nbest_scores_against_the_library(oracle):
    given = [t for t in texts() if 3 < len(t) < 130 and not set(t) & set("\n\t\U0001F600") and "  " not in t.strip()]
    e = Encoded(pa.array(given), MODEL)
    for i, text in enumerate(given):
        want = [score(oracle, ids) for ids in oracle.nbest_encode_as_ids(text, MODEL.nbest)]
        got = [a["score"] for a in e.alternatives[i]]
        assert got == sorted(got, reverse=True)
        assert got == pytest.approx(want, abs=0.5), text


def test_word_search_against_all_segmentations():
    def every(word):
        from paddock.llm.sentence_pieces import load
        known = load(MODEL.path)
        if not word:
            return [(0.0, ())]
        out = []
        for k in range(1, len(word) + 1):
            found = known.score_of.get(word[:k])
            if found:
                out += [(found[0] + s, (found[1], *ids)) for s, ids in every(word[k:])]
        return out

    for word in ("▁hello", "▁thing", "▁aaaa", "ab"):
        want = sorted(every(word), key=lambda x: -x[0])[:5]
        got = word_nbest(word, MODEL.path, 5)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want])
        assert got[0][1] == want[0][1]


def test_round_trip(docs_of):
    rows = [(i, t) for i, t in enumerate(texts())] + [(500, None), (501, ""), (502, " "), (503, "x" * 50000),
                                                      (503, "x" * 50000), (None, "no id \x00 é")]
    encoded = encode(docs_of(rows))
    out = {r.doc_id: r for r in encoded.collect()}
    assert all(r.exact for r in out.values()) and out[500].n_tokens == 0 == out[501].n_tokens
    assert all(len(r.ids) == r.n_tokens and r.alternatives[0].score == pytest.approx(r.score) for r in out.values())
    back = {r.doc_id: r.text for r in decode(encoded).collect()}
    for i, t in rows:
        assert back[i] == (t or "")


def test_empty_table(docs_of):
    assert encode(docs_of([])).count() == 0 == decode(encode(docs_of([]))).count()


def test_zipf_pieces_are_close_to_the_models_own_encoding():
    """Tokens a word within 5 % of the library's merges, and whole words where the model has them."""
    import pyarrow.parquet as pq
    known = load(BPE_PIECES.path, BPE_PIECES.scores)
    given = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()]
    want = sum(map(len, known.sp.encode(given)))
    assert abs(int(Encoded(pa.array(given), BPE_PIECES).count.sum()) - want) < 0.05 * want
    e = Encoded(pa.array(["the house is small"]), BPE_PIECES)
    assert [known.sp.id_to_piece(int(i)) for i in e.ids] == ["▁the", "▁house", "▁is", "▁small"]


def test_zipf_order_is_exact():
    """All segmentations of words, by exact sums; many equal paths do not grow the agenda."""
    known = load(BPE_PIECES.path, BPE_PIECES.scores)

    def every(word):
        if not word:
            return [(0.0, ())]
        return [(known.score_of[word[:k]][0] + s, (known.score_of[word[:k]][1], *ids))
                for k in range(1, len(word) + 1) if word[:k] in known.score_of for s, ids in every(word[k:])]

    for word in ("▁hello", "▁thinking", "▁aaaa", "ab", "▁überall"):
        want = sorted((s for s, _ in every(word)), reverse=True)[:8]
        got = word_nbest(word, BPE_PIECES.path, 8, BPE_PIECES.scores)
        assert [s for s, _ in got] == want
        assert len({ids for _, ids in got}) == len(got) and all(x in every(word) for x in got)
    assert len(word_nbest("ab" * 5000, BPE_PIECES.path, 3, BPE_PIECES.scores)) == 3


def test_query_decodes_every_text(spark):
    import hashlib

    from paddock.llm.queries import op1_sentence_pieces
    got = {r.doc_id: r for r in op1_sentence_pieces(spark, "/root/testdata/sf0.001").collect()}
    known = load(BPE_PIECES.path)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        normal = known.sp.decode(known.sp.encode(text or ""))
        assert got[doc_id].text_sha256 == hashlib.sha256(normal.encode()).hexdigest() and got[doc_id].exact


def test_ids_that_are_no_utf8_and_null_lists(spark):
    known = load(BPE_PIECES.path)
    byte = int(known.byte_id[0xE9])
    given = spark.createDataFrame([(1, None), (2, []), (3, [byte]), (4, [int(known.sp.piece_to_id("▁the"))])],
                                  "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in decode(given, BPE_PIECES).collect()} == {1: None, 2: "", 3: "\ufffd", 4: "the"}


def test_memory_of_encoding_does_not_follow_the_batch():
    import tracemalloc

    from paddock.llm.sentence_pieces import _RUN_BYTES, encode_run
    from paddock.llm.text import pieces
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 12))) for _ in range(250)) for _ in range(2_000)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(2_000)), "text": texts})
    load(BPE_PIECES.path, BPE_PIECES.scores)
    tracemalloc.start()
    try:
        rows = sum(encode_run(part, BPE_PIECES, "id").num_rows for part in pieces(batch, "text", _RUN_BYTES))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 2_000
    assert peak < 90 << 20, peak
