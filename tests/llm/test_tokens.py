"""Token counts, the segment-tree codec and the coded id store against the library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caliper.llm import bpe_codec, store, token_counts, token_store

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
TEXTS = [
    "", " ", "a", "Hello, World's best!!'s don't we're 'rest 'r 'l", "  lead  and trail \n", "x<|endoftext|>y <|startoftext|><|endoftext|> z",
    "<|ENDOFTEXT|> <|endoftex", "é é İstanbul ΣΑΣ ß ½ Ⅳ 中文字符テスト 안녕 👩‍👩‍👧", "a\x1cb\x85c\xa0d e\x00f", "12345 ٣٤ ｆｕｌｌ", "x\n y\t z\r\n\r\n", "a  b   c",
    "x" * 3000, " ".join(["again and again"] * 400), None,
]


def spelled(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    pieces = ["th", "er", "on", "!", "'s", "É", "ß", "9", " ", " ", "\n", "-", "Qu", "漢", "'"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE)


def test_every_prefix_has_its_count(word):
    counter = token_counts.Counter(WORD)
    for text in [t for t in TEXTS if t is not None and len(t) < 500] + spelled(60, 1):
        counts = counter.counts([text])[0]
        total = len(word.encode(text, add_special_tokens=False).ids)
        assert (counts[-1] if len(counts) else 0) == total, text
        if "<|" not in text:
            normal = word.normalizer.normalize_str(text)
            assert [len(word.encode(normal[: i + 1], add_special_tokens=False).ids) for i in range(len(normal))] == counts.tolist(), text


def test_special_strings_count_when_complete():
    counts = token_counts.Counter(WORD).counts(["a <|endoftext|> b", "a<|endoftext|>"])
    assert counts[0].tolist() == [1, 1] + [1] * 12 + [2, 2, 3]
    assert counts[1].tolist() == [1] + [1] * 12 + [2]


def test_long_runs_without_a_space(word):
    text = "".join(random.Random(3).choice("aeiostnr") for _ in range(40_000))
    assert token_counts.Counter(WORD).counts([text])[0][-1] == len(word.encode(text, add_special_tokens=False).ids)
    assert np.frombuffer(bpe_codec.Codec(WORD).encode([text])[0], "<u4").tolist() == word.encode(text, add_special_tokens=False).ids


def test_counts_answer_budgets(spark, table, word):
    texts = [t for t in spelled(20, 2) if "<|" not in t]
    got = token_counts.prefix_token_counts(table(texts), WORD)
    got = got.select("doc_id", token_counts.longest_within(F.col("prefix_counts"), 5).alias("fit"), token_counts.tokens_of_prefix(F.col("prefix_counts"), F.lit(7)).alias("seven"), token_counts.total_tokens(F.col("prefix_counts")).alias("n"))
    for r in got.collect():
        normal = word.normalizer.normalize_str(texts[r["doc_id"]])
        each = [len(word.encode(normal[: i + 1], add_special_tokens=False).ids) for i in range(len(normal))]
        assert r["n"] == (each[-1] if each else 0)
        assert r["fit"] == max((i + 1 for i, c in enumerate(each) if c <= 5), default=0)
        assert r["seven"] == (each[min(7, len(each)) - 1] if each else 0)


def test_counts_of_odd_rows(spark, table, word):
    docs = table(TEXTS + ["twice", "twice"], [None, *range(len(TEXTS) - 1), 77, 77]).withColumn("prefix_counts", F.lit(1)).withColumn("n_bytes", F.lit("x"))
    got = token_counts.prefix_token_counts(docs, WORD).select("doc_id", "n_bytes", token_counts.total_tokens(F.col("prefix_counts")).alias("n")).collect()
    assert len(got) == len(TEXTS) + 2 and sum(r["doc_id"] is None for r in got) == 1 and sum(r["doc_id"] == 77 for r in got) == 2
    want = sorted((len((t or "").encode()), len(word.encode(t or "", add_special_tokens=False).ids)) for t in TEXTS + ["twice", "twice"])
    assert sorted((r["n_bytes"], r["n"]) for r in got) == want
    assert token_counts.prefix_token_counts(docs.limit(0), WORD).count() == 0


def test_codec_equals_the_library(spark, table, word):
    texts = TEXTS + spelled(80, 4)
    docs = table(texts, [None, *range(1, len(texts))]).withColumn("ids", F.lit(0))
    got = bpe_codec.round_trip(docs, WORD).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = word.encode(texts[r["doc_id"] or 0] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        assert r["decoded"] == word.decode(ids, skip_special_tokens=False)
    both = bpe_codec.decode(bpe_codec.encode(docs, WORD), WORD).collect()
    assert sorted(map(tuple, both), key=str) == sorted(map(tuple, got), key=str) and bpe_codec.round_trip(docs.limit(0), WORD).count() == 0


def test_root_is_the_leftmost_lowest_merge():
    model = bpe_codec.load(WORD)
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("thaniser") for _ in range(rng.randint(1, 20))).encode()
        tokens = [*text[:-1], text[-1] + 256]
        while True:  # merges one by one, by definition
            merges = [(int(model.merged(np.array([a]), np.array([b]))[0]), i) for i, (a, b) in enumerate(zip(tokens, tokens[1:]))]
            best = min(((m, i) for m, i in merges if m >= 0), default=None)
            if best is None:
                break
            tokens[best[1] : best[1] + 2] = [best[0]]
        got = bpe_codec.Codec(WORD).solve([text])[0] if not _ else bpe_codec.codec(WORD).solve([text])[0]
        assert np.frombuffer(got, "<u4").tolist() == model.ids[tokens].tolist()


def test_library_words_are_independent(byte):
    texts = TEXTS + spelled(200, 6)
    ids, ends = token_store.Encoder(BYTE).encode(pa.array(texts))
    for text, a, b in zip(texts, [0, *ends.tolist()], ends.tolist()):
        assert ids[a:b].tolist() == byte.encode(text or "", add_special_tokens=False).ids, text


def test_words_are_learned_some_at_a_time_and_kept(byte, monkeypatch):
    own, asked = token_store.Encoder(BYTE, room=300), []

    class Counted:
        def encode_batch_fast(self, texts, add_special_tokens):
            asked.append(max(map(str.split, texts), key=len))
            return byte.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    own.tokenizer = Counted()
    runs = [[" ".join(f"w{i * i}x" for i in range(a, a + 400)), "a\x1cb \x85c", "d \u3000e f", None] for a in (0, 100, 500, 0)]
    for texts in runs:  # words of the last run but one are learned again, the others are known
        ids, ends = own.encode(pa.array(texts))
        for text, a, b in zip(texts, [0, *ends.tolist()], ends.tolist()):
            assert ids[a:b].tolist() == byte.encode(text or "", add_special_tokens=False).ids
    assert max(map(len, asked)) <= token_store.JOINED  # the library was given all new words as one text


def test_codes_are_packed_without_spreading_their_bits():
    code = token_store.Code(token_store.code_lengths({i: 1 + 2**26 // (i + 1) ** 3 for i in range(900)}))
    ids = np.random.default_rng(3).integers(0, 900, 5000)
    plain = "".join(f"{int(code.code[i]):0{int(code.length[i])}b}" for i in ids)
    data, rest, before = b"", 0, 0
    for part in np.split(ids, [0, 1, 2, 3, 40, 40, 3000]):
        more, rest, before = code.packed(part, rest, before)
        data += more
    assert "".join(f"{x:08b}" for x in data) + (f"{rest:0{before}b}" if before else "") == plain


def test_code_lengths_are_best_and_limited():
    counts = {i: 2**i for i in range(24)} | {100 + i: 1 for i in range(5)}
    lengths = token_store.code_lengths(counts, 12)
    assert max(lengths.values()) <= 12 and sum(2.0**-n for n in lengths.values()) <= 1
    free = token_store.code_lengths({1: 5, 2: 9, 3: 12, 4: 13, 5: 16, 6: 45}, 18)
    assert sum({1: 5, 2: 9, 3: 12, 4: 13, 5: 16, 6: 45}[i] * n for i, n in free.items()) == 224  # the textbook optimum
    assert token_store.code_lengths({7: 3}) == {7: 1} and token_store.code_lengths({}) == {}


def test_blocks_decode_by_themselves():
    rng = np.random.default_rng(7)
    ids = rng.zipf(1.3, 20_000) % 3000
    code = token_store.Code(token_store.code_lengths(dict(zip(*(x.tolist() for x in np.unique(ids, return_counts=True))))))
    again = token_store.Code.from_bytes(code.to_bytes())
    bits = code.bits(ids)
    begins = np.concatenate([[0], np.cumsum(code.length[ids].astype(np.int64))])
    payload = np.concatenate([np.packbits(bits), np.zeros(4, np.uint8)])
    for start in (0, 5 * 1024, 19 * 1024):
        n = min(1024, len(ids) - start)
        assert again.decode(payload, begins[[start]], np.array([n])).tolist() == ids[start : start + n].tolist()


@pytest.mark.parametrize("shards", [1, 5])
def test_store_round_trip(spark, table, byte, shards):
    rng = random.Random(8)
    texts = TEXTS + spelled(150, 8) + ["twice", "twice"]
    names = [None, *rng.sample(range(-50, 1000), len(texts) - 3), 2000, 2000]
    docs = table(texts, names).withColumn("ids", F.lit(1)).withColumn("start", F.lit("x"))
    folder = store.new_folder(spark, "test-ids")
    ids = store.written(token_store.encoded(docs, BYTE, 2), "test-encoded")
    listed = token_store.write(ids, token_store.Code(token_store.code_lengths(token_store.id_counts(ids))), folder, shards)
    got = token_store.read(spark, listed, folder, group=500).collect()
    assert len(got) == len(texts)
    order = sorted(range(len(texts)), key=lambda i: (names[i] is not None, names[i] or 0))
    start = 0
    by_start = {r["start"]: r for r in got}
    for i in order:
        want = np.array([*byte.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        r = by_start[start]
        assert (r["doc_id"], r["n_tokens"], zlib.crc32(r["ids"])) == (names[i], len(want) // 4, zlib.crc32(want))
        start += len(want) // 4


def test_store_of_an_empty_table(spark, table):
    folder, listed = token_store.store_ids(table(["x"]).limit(0), BYTE, 2)
    assert token_store.read(spark, listed, folder).count() == 0
