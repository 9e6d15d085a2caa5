import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinweave.llm import bpe
from tests.llm import cases

TOKENIZER = Tokenizer.from_file(bpe.default_vocabulary())
CODEC = bpe.codec(bpe.default_vocabulary())


def plain(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["ab cd", " the quick fox", "\n\n", "  ", "<|endoftext|>", "it's", "3.14", "\u3000"])), max_size=12).map("".join))
def test_any_text(text):
    e = bpe.Encoder(CODEC, bits=2)
    ids = e.encode(text).tolist()
    assert ids == plain(text)
    assert CODEC.decode(ids).decode("utf-8", "replace") == TOKENIZER.decode(plain(text), skip_special_tokens=False)


@pytest.mark.parametrize("run", [" ", "\n", "\u3000", " \n", "\n ", "\t\x85\xa0"])
@pytest.mark.parametrize("ends", [("", ""), ("x", "y"), ("1.", "'s"), ("word ", " \u00e9")])
def test_long_white_space(monkeypatch, run, ends):
    """Long runs of each kind; those handled by hand are shorter here, but for one of each kind."""
    monkeypatch.setattr(bpe, "LONG", 64)
    monkeypatch.setattr(bpe, "_LONG_WHITE", bpe.re.compile(f"[{bpe.WHITE}]{{64,}}"))
    for n in (30, 63, 64, 65, 700):
        text = ends[0] + (run * n)[:n] + ends[1]
        assert bpe.Encoder(CODEC).encode(text + text).tolist() == plain(text + text), n


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "x" + " \n\t" * 700_000 + "y", "x" + " " * 1_200_000 + "y"], ids=["spaces", "lines", "mixed", "between"])
def test_two_million_white_characters(text):
    assert bpe.Encoder(CODEC).encode(text).tolist() == plain(text)


@pytest.mark.parametrize("step", [3, 7, 50])
def test_bad_cuts_are_repaired(monkeypatch, step):
    text = "The quick brown foxes, they've jumped over 12345 lazy dogs -- and   then some more words followed. " * 5
    monkeypatch.setattr(bpe, "cuts", lambda data, bits: list(range(step, len(data), step)))
    e = bpe.Encoder(CODEC)
    assert e.encode(text).tolist() == plain(text)
    assert e.repaired > 0


def test_chunks_are_reused():
    e, shared = bpe.Encoder(CODEC, bits=6), " ".join(f"shared passage number {chr(97 + i % 26)} of many words" for i in range(300))
    e.encode("first text begins here " + shared)
    made = e.made
    e.encode("another one starts in its own way " + shared)
    assert e.reused > 10 * (e.made - made)


def test_memory_is_bounded():
    e = bpe.Encoder(CODEC, bits=5, most_bytes=2000)
    for i in range(50):
        e.encode(" ".join(f"w{i}x{j} and more" for j in range(200)))
    assert e.held <= 2000 or len(e.chunks) == 1


def test_given_ids_are_used_only_if_they_decode_to_the_chunk():
    data = "a passage of several plain words"
    right, wrong = bpe.Chunk(data.encode(), CODEC).ids, bpe.Chunk(b"another text", CODEC).ids
    for ids, taken in ((right, 1), (wrong, 0)):
        e = bpe.Encoder(CODEC, given={bpe.chunk_hash(data.encode()): ids})
        assert e.encode(data).tolist() == plain(data)
        assert (e.taken, e.made) == (taken, 1 - taken)


def test_shared_chunks_are_encoded_once_and_dealt_to_all_that_have_them(spark, tmp_path):
    passage = " ".join(f"shared passage number {chr(97 + i % 26)}{chr(97 + i // 26)} of many words" for i in range(200))
    texts = [f"{'begin ' * i} text {chr(97 + i)} {passage} end {chr(97 + i)}" for i in range(12)] + [None, "", "<|endoftext|>" + passage]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(6, "doc_id")
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    tasks = docs.rdd.getNumPartitions()
    assert tasks > 1
    bits, path = 6, bpe.default_vocabulary()
    dealt = spark.read.parquet(bpe.share_chunks(docs.select("text"), path, bits))
    of = {}
    for part in docs.select("text").rdd.glom().collect():
        lister = bpe.Lister(CODEC, bits)
        for h, data in lister.take([r.text for r in part]).items():
            of.setdefault(h, []).append(data)
    want = {h: (len(x), CODEC.encode(x[0])) for h, x in of.items() if len(x) > 1}
    got = {}
    for r in dealt.collect():
        n, _ = got.get(r.h, (0, None))
        got[r.h] = (n + 1, r.ids)
    assert len(want) > 20 and got == want
    assert {r.doc_id: r.tokens for r in bpe.encode_decode(docs, bits=bits).collect()} == {i: plain(t) for i, t in enumerate(texts)}


def test_documents(spark):
    for docs in (cases.docs(spark), cases.small(spark, 60)):
        out = bpe.encode_decode(docs)
        assert out.columns == [*docs.columns, "tokens", "decoded"]
        assert all(r.tokens == plain(r.text) and r.decoded == (r.text or "") for r in out.collect())
        for r in bpe.digests(out.where("text is not null")).join(docs.select("doc_id", "text"), "doc_id").collect():
            assert r.n_tokens == len(plain(r.text))
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, plain(r.text))).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert bpe.digests(bpe.encode_decode(cases.empty(spark))).count() == 0
