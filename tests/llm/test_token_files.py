import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from conftest import rows_of
from tidemark.llm import queries, token_files
from tidemark.llm.wavelet import WaveletMatrix, build


@given(st.lists(st.one_of(st.integers(0, 9), st.integers(0, 70000)), max_size=1500), st.integers(1, 9))
@settings(max_examples=40, deadline=None)
def test_wavelet_matrix_against_a_list(ids, every):
    a = np.array(ids, np.int64)
    lengths = np.diff([*range(0, len(a), every), len(a)]) if len(a) else np.array([0])
    docs, known = np.arange(len(lengths)) * 3 - 5, np.arange(len(lengths)) % 2 == 0
    m = WaveletMatrix(build(a, lengths, docs, known))
    assert m.decode().tolist() == ids and m.lengths.tolist() == lengths.tolist()
    assert m.docs.tolist() == docs.tolist() and m.known.tolist() == known.tolist()
    for i in list(range(0, len(ids), 97)) + list(range(max(0, len(ids) - 3), len(ids))):
        assert m.access(i) == ids[i]
    for token in set(ids[:5]) | {0, 3, 70001, 1 << 20}:
        at = [k for k, x in enumerate(ids) if x == token]
        assert m.count(token) == len(at)
        assert m.count(token, len(ids) // 3, len(ids) // 2) == sum(len(ids) // 3 <= k < len(ids) // 2 for k in at)
        for j in {0, len(at) // 2, len(at) - 1} if at else ():
            assert m.find(token, j) == at[j]
        with pytest.raises(IndexError):
            m.find(token, len(at))


def expected(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, len(ids), zlib.crc32(ids.tobytes()), start))
        start += len(ids)
    return out, start


def test_special_tokens_in_other_letter_case():
    """Whatever spelling a worker meets first, texts and words apart or together."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    texts = ["a <|endoftext|> b", "A <|ENDOFTEXT|> B", "x<|EndOfText|>y <|startoftext|>, <|STARTOFTEXT|>!", "<| <", "<|",
             "<|endoftext|>", "<", "|", "Some<|endoftext|>THING <|EndOfText|><|endoftext|>", None]
    for some in (texts, texts[::-1], texts[1:] + texts[:1]):
        encoder = token_files.Encoder(queries.tokenizer_path())
        for part in (some[:4], some):
            ids, counts = encoder.encode(pa.array(part, pa.string()))
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [
                tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]


def test_odd_rows_round_trip(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want, total = expected(rows)
    shards = token_files.write_shards(odd, queries.tokenizer_path(), shard=700)
    assert shards.count() > 3
    got = [(r["doc_id"], r["n_tokens"], r["ids_crc32"], r["start"]) for r in rows_of(token_files.documents_of(shards))]
    assert sorted(x[:3] for x in map(lambda r: tuple(map(str, r)), got)) == sorted(
        x[:3] for x in map(lambda r: tuple(map(str, r)), want))
    got.sort(key=lambda r: r[3])
    start = 0
    for i, n, _, s in got:  # no gap, ids ascending
        assert s == start
        start += n
    assert start == total
    ids = [r[0] for r in got if r[0] is not None]
    assert ids == sorted(ids) and [r[0] for r in got[:2]] == [None, None]
    assert token_files.documents_of(token_files.write_shards(none, queries.tokenizer_path())).count() == 0


def test_encoder_starts_anew_when_full(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "KNOWN", 8)
    encoder = token_files.Encoder(queries.tokenizer_path())
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    for k in range(6):
        texts = [f"word{k} and\nothers{j} Of THE {k * j}" for j in range(4)]
        ids, counts = encoder.encode(pa.array(texts))
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [x for w in want for x in w] and counts.tolist() == [len(w) for w in want]


def test_pieces_are_encoded_as_whole_texts_are():
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    encoder = token_files.Encoder(queries.tokenizer_path())
    rng = random.Random(1)
    parts = "ab É é × ÷ — , . ! ' s t < | > 1 ½ Ω ́ 日 　 _ - \x01 ð <|endoftext|>".split(" ") + [" ", "\n"]
    texts = ["don't, stop's 'sure' a,'s ", "x—,y —, a×, ÷b. é,à;ñ É!", "abc<|endoftext|>def, <|startoftext|>.",
             "日本,語。x ${}~_`^", "12.5% $3.00 a_b-c", ""]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(2000)]
    for a in range(0, len(texts), 50):
        ids, counts = encoder.encode(pa.array(texts[a:a + 50]))
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts[a:a + 50]]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
